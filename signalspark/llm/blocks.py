"""Blocks of documents that ask a sharded table about their keys, and get the answers in place.

Matching passages or shingles of all documents through rows of (key, document) costs a row for each place of each
text. Here the unit is a block of texts, a few megabytes, written once to the shared folder:

* each block lists its distinct keys (64-bit numbers) in order, with one number of its own for each;
* the key space is cut at splitters into ranges; a block sends each range one packed, compressed run;
* a range sorts what it received by key, combines the numbers of equal keys, and sends every run its answers,
  in the run's own order, so that keys needn't travel back;
* the block works out its keys again, and finds the answers lined up with them.

However many documents share a key, a range sees it once per block. A lost executor costs recomputing its runs
from the block files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.common import release, stored

#: UTF-8 bytes of text in a block (one longer text is a block of its own), and keys in a range. Raise both with
#: the input: the runs of one exchange number blocks x ranges.
BLOCK_BYTES = 1 << 21
RANGE_KEYS = 1 << 19
LEAST_RANGES = 32
#: Document ids are whole numbers of less than 2**62 in size; a null one sorts after all others.
ID_SHIFT = 1 << 62
NO_ID = ID_SHIFT - 1

KeysOf = Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]]
Combine = Callable[[np.ndarray, np.ndarray], np.ndarray]


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(numbers: np.ndarray, ordered: bool = False) -> bytes:
    """Compressed bytes of unsigned numbers, plane by plane; of an ordered run the steps."""
    steps = np.diff(numbers, prepend=numbers[:1] * 0) if ordered else numbers
    return squeeze(np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), -1).T).tobytes())


def unpack(data: bytes, kind=np.uint64, ordered: bool = False) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(width, -1)
    steps = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
    return np.cumsum(steps, dtype=kind) if ordered else steps


def to_blocks(docs: DataFrame, id_name: str, text_name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stored rows (block_id, ids, sizes, texts): packed documents in the order of the scan; null text is empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        held: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            return pa.record_batch(
                {
                    "block_id": pa.array([task << 32 | count], pa.int64()),
                    "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                    "sizes": pa.array([np.array([len(t) for t in held], np.int64).tobytes()], pa.binary()),
                    "texts": pa.array([squeeze(b"".join(held))], pa.binary()),
                }
            )

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
                raw = text.as_py() or b""
                if held and size + len(raw) > block_bytes:
                    yield block()
                    count, ids, held, size = count + 1, [], [], 0
                own = doc.as_py()
                ids.append(NO_ID if own is None else own)
                held.append(raw)
                size += len(raw)
        if held:
            yield block()
        release()

    chosen = docs.select(F.col(id_name).cast("long"), F.col(text_name).cast("string"))
    return stored(chosen.mapInArrow(cut, "block_id long, ids binary, sizes binary, texts binary"), "blocks")


def open_block(ids: bytes, sizes: bytes, texts: bytes) -> tuple[np.ndarray, list[bytes]]:
    ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
    whole = unsqueeze(texts)
    return np.frombuffer(ids, np.int64), [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def splitters(blocks: DataFrame, keys_of: KeysOf, keys: int, range_keys: int = RANGE_KEYS) -> np.ndarray:
    """Keys at which the ranges begin, so many that ``keys`` keys fill ranges of about ``range_keys``.

    They are quantiles of a sample of the keys, every 65,537th of each block's sorted ones at most and a bounded
    number in all. Only where ranges begin is sampled; any splitters give the same answers.
    """
    ranges = max(LEAST_RANGES, -(-keys // range_keys))
    step = max(1, min(65_537, keys // (ranges * 64)))

    def sample(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, texts = open_block(row["ids"], row["sizes"], row["texts"])
                own = keys_of(texts, ids)[0]
                # Offset by the block, else a block of few keys would give none or always its least.
                picked = own[int(row["block_id"] * 40_503) % step :: step]
                yield pa.record_batch({"key": pa.array((picked >> np.uint64(1)).astype(np.int64), pa.int64())})

    share = min(1.0, 64.0 * ranges * 64 / max(keys, 1))
    some = blocks.where(F.pmod(F.xxhash64("block_id"), F.lit(1_000_000)) < max(1, int(share * 1_000_000)))
    wanted = [k / ranges for k in range(1, ranges)]
    found = some.mapInArrow(sample, "key long").agg(F.percentile_approx("key", wanted, 100_000).alias("at")).first()
    return np.array(sorted(set(found["at"] or [])), np.int64).astype(np.uint64) << np.uint64(1)


def ask(blocks: DataFrame, keys_of: KeysOf, combine: Combine, cuts: np.ndarray, name: str) -> DataFrame:
    """(block_id, answers): for each block its packed answers, one byte string per range in order.

    ``keys_of(texts, ids)`` gives a block's ascending distinct keys and a number for each (both uint64), alike
    whenever it is called. ``combine(keys, numbers)`` gets a range's keys in ascending order, equal ones side by
    side, and gives a uint32 answer for each.
    """

    def of_row(row):
        ids, texts = open_block(row["ids"], row["sizes"], row["texts"])
        return keys_of(texts, ids)

    return ask_rows(blocks, of_row, combine, cuts, name)


def ask_rows(blocks: DataFrame, of_row: Callable[[dict], tuple], combine: Combine, cuts: np.ndarray, name: str) -> DataFrame:
    """``ask`` with a function of the block's whole row.

    The function may give a third array: rows of numbers that belong to the keys (``byte_rows``). Keys are then equal
    only if their rows are, so that a block may list one key with several rows, and ``combine`` gets a number for
    each distinct (key, row) in place of the key.
    """

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, numbers, *rows = of_row(row)
                at = np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])
                used = np.flatnonzero(at[1:] > at[:-1])
                yield pa.record_batch(
                    {
                        "range": pa.array(used, pa.int32()),
                        "block_id": pa.array([row["block_id"]] * len(used), pa.int64()),
                        "keys": pa.array([pack(keys[at[r] : at[r + 1]], True) for r in used], pa.binary()),
                        "numbers": pa.array([pack(numbers[at[r] : at[r + 1]]) for r in used], pa.binary()),
                        "rows": pa.array([squeeze(rows[0][at[r] : at[r + 1]].tobytes()) if rows else None for r in used], pa.binary()),
                    }
                )
        release()

    def answer(part: pa.Table) -> pa.Table:
        runs = [unpack(k.as_py(), ordered=True) for k in part.column("keys")]
        keys = np.concatenate(runs)
        numbers = np.concatenate([unpack(n.as_py()) for n in part.column("numbers")])
        replies = np.empty(len(keys), np.uint32)
        if part.column("rows").null_count:
            order = np.argsort(keys, kind="stable")
            replies[order] = combine(keys[order], numbers[order])
        else:
            packed = b"".join(unsqueeze(r.as_py()) for r in part.column("rows"))
            order, fresh = equal_rows(keys, np.frombuffer(packed, np.uint64).reshape(len(keys), -1))
            del packed
            replies[order] = combine(np.cumsum(fresh).astype(np.uint64), numbers[order])
        ends = np.cumsum([len(r) for r in runs])
        del keys, numbers, order
        release()
        return pa.table(
            {
                "block_id": part.column("block_id").cast(pa.int64()),
                "range": part.column("range").cast(pa.int32()),
                "reply": pa.array([pack(replies[e - len(r) : e]) for r, e in zip(runs, ends, strict=True)], pa.binary()),
            }
        )

    sent = blocks.mapInArrow(send, "range int, block_id long, keys binary, numbers binary, rows binary")
    replied = sent.groupBy("range").applyInArrow(answer, "block_id long, range int, reply binary")
    gathered = replied.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("range", "reply"))).alias("answers"))
    return stored(gathered.select("block_id", F.col("answers.reply").alias("answers")), name)


def read_answers(answers: list[bytes] | None) -> np.ndarray:
    parts = [unpack(a, np.uint32) for a in answers or []]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def first_of_equals(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    starts = np.ones(len(keys), bool)
    starts[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(starts)


def places(keys: np.ndarray) -> np.ndarray:
    """For each key its place among the distinct ones in ascending order, in which a block has asked about them."""
    order = np.argsort(keys)
    fresh = np.zeros(len(keys), np.int64)
    own = keys[order]
    fresh[1:] = own[1:] != own[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(fresh)
    return place


def byte_rows(data: np.ndarray, at: np.ndarray, lengths: np.ndarray, widest: int) -> np.ndarray:
    """The bytes of pieces of ``data`` as rows of numbers: padded with zeros, and with the length at the end."""
    words = -(-widest // 8)
    rows = np.zeros((len(at), words + 1), np.uint64)
    if len(at):
        whole = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(widest, np.uint8)]), widest)
        text = rows.view(np.uint8)[:, :widest]
        text[:] = whole[at]
        if lengths.min() < widest:
            text[np.arange(widest) >= lengths[:, None]] = 0
        rows[:, -1] = lengths
    return rows


def equal_rows(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key in which equal (key, row) stand side by side, and where in it distinct ones begin."""

    def fresh_in(order):
        fresh, other = np.ones(len(order), bool), np.ones(len(order), bool)
        own = keys[order]
        other[1:] = own[1:] != own[:-1]
        fresh[1:] = other[1:]
        near = np.flatnonzero(~other)
        fresh[near] = (rows[order[near]] != rows[order[near - 1]]).any(axis=1)
        return fresh, bool((fresh & ~other).any())

    order = np.argsort(keys, kind="stable")
    fresh, mixed = fresh_in(order)
    if mixed:  # one key for different rows: these are ordered too
        order = np.lexsort((*rows.T, keys))
        fresh, _ = fresh_in(order)
    return order, fresh
