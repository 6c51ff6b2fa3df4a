"""What the text operators share: table reading, slices by bytes, the shared folder, query registration."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.session import materialize

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Bytes of text that a task works on at once, whatever the size of an Arrow batch.
SLICE_BYTES = 1 << 20


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows where there is one."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame below the folder that all executors share and read it back.

    Such files outlive executors, cut the lineage and give the planner true sizes.
    """
    return materialize(df, name)


def drawn(rows: DataFrame, key: str, bound: int, stratum: str | None = None, least: int = 0) -> DataFrame:
    """One row of each of about ``bound`` distinct keys, spread over the table by a 63-bit hash of the key.

    However many rows share a key, it counts once. Of each stratum come about ``least`` keys, or all it has, even if
    its share of ``bound`` is smaller. A row per stratum reaches the driver. Raises if nothing is drawn from a table
    that has rows.
    """
    kind = F.lit(0) if stratum is None else F.col(stratum)
    counted = rows.groupBy(kind.alias("stratum")).agg(F.approx_count_distinct(F.xxhash64(key)).alias("n")).collect()
    total = sum(r["n"] for r in counted)
    top = (1 << 63) - 1
    place = F.shiftrightunsigned(F.xxhash64(F.lit("train"), key), 1)
    shares = {r["stratum"]: max(bound * r["n"] / max(total, 1), least) / max(r["n"], 1) for r in counted}
    chosen = F
    for own, share in shares.items():
        chosen = chosen.when(kind.eqNullSafe(F.lit(own)), place < min(top, int(share * top)))
    some = rows.where(chosen) if shares else rows
    if counted and some.isEmpty():
        raise ValueError(f"no row was drawn for training, although there are about {total} distinct {key}")
    return some.dropDuplicates([key] if stratum is None else [key, stratum])


def unused(df: DataFrame, name: str) -> str:
    """``name`` behind so many underscores that no column of the frame is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def release() -> None:
    """Give freed memory back to the system. Python workers live on between tasks and stages: what their allocators
    keep would add up with the next stage's, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Memo(dict):
    """What a worker remembers of words: byte strings or numbers, bounded by their bytes and an entry's own.

    ``trim`` before a slice of texts starts it anew when it is full, so it holds ``limit`` and one slice at most.
    Workers live on between tasks: a task clears its memos when it ends.
    """

    ENTRY_BYTES = 200

    def __init__(self, limit: int = 32 << 20):
        super().__init__()
        self.limit, self.bytes = limit, 0

    def learn(self, words: list, values: list) -> None:
        self.update(zip(words, values, strict=True))
        held = sum(len(value) for value in values if not isinstance(value, int))
        self.bytes += sum(map(len, words)) + held + self.ENTRY_BYTES * len(words)

    def trim(self) -> None:
        if self.bytes > self.limit:
            self.clear()

    def clear(self) -> None:
        super().clear()
        self.bytes = 0


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Consecutive slices of about ``limit`` bytes as UTF-8 byte strings; null is the empty text.

    Balances the work by bytes, not rows. A text above the limit is a slice of its own, never cut.
    """
    held, size = [], 0
    for text in texts.cast(pa.large_binary()):
        raw = text.as_py() or b""
        if held and size + len(raw) > limit:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held
