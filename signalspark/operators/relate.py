"""Joins, set operations and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.functions import scalar as S


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last row per key in ``order``. A max over structs, so duplicates collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("_row")
    return df.groupBy(*keys).agg(last).select(*keys, "_row.*")


#: Columns that one number holds, a bit for each.
MASK_BITS = 63


def _task_bits(overview: DataFrame, id_col: str) -> tuple[DataFrame, Column]:
    """One row per ID with a bit for each column whose cell is anything but a dash, and the task names of the bits."""
    tasks = [c for c in overview.columns if c != id_col]
    groups = [tasks[i : i + MASK_BITS] for i in range(0, len(tasks), MASK_BITS)]

    def marked(column: str, bit: int) -> Column:
        cell = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("nan"))
        return F.when(S.strip(cell) != "-", F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")

    masks = [reduce(Column.bitwiseOR, [marked(c, i) for i, c in enumerate(g)]) for g in groups]
    rows = overview.select(
        S.strip(F.col(f"`{id_col}`").cast("string")).alias(id_col), *[m.alias(f"_mask{k}") for k, m in enumerate(masks)]
    )
    ids = rows.groupBy(f"`{id_col}`").agg(*[F.bit_or(f"_mask{k}").alias(f"_mask{k}") for k in range(len(groups))])
    names = [
        F.when(F.col(f"_mask{k}").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lower(S.strip(F.lit(c))))
        for k, g in enumerate(groups)
        for i, c in enumerate(g)
    ]
    # Columns may have one name once it is stripped and lower-cased.
    return ids, F.array_distinct(F.array_compact(F.array(*names))) if names else F.array().cast("array<string>")


def availability(overview: DataFrame, id_col: str = "ID") -> DataFrame:
    """(ID, task_key) pairs of a wide overview whose cell is anything but a dash, each once.

    A missing cell is not a dash, so it counts as available. Rows of one ID are put together as bits, one for each
    column, before the columns become rows: what is aggregated are IDs, not pairs.
    """
    ids, keys = _task_bits(overview, id_col)
    return ids.select(id_col, F.explode(keys).alias("task_key"))


def where_available(df: DataFrame, overview: DataFrame, id_col: str = "ID") -> DataFrame:
    """The rows whose (ID, task_key) is one of ``availability``.

    The join is by ID, with the bits: a size the planner has measured, where pairs unfolded behind an exchange would
    be taken for as small as the IDs they came from, and broadcast.
    """
    ids, keys = _task_bits(overview, id_col)
    return df.join(ids, id_col).where(F.array_contains(keys, F.col("task_key"))).select(*[f"`{c}`" for c in df.columns])


def task_order(overview: DataFrame, id_col: str = "ID") -> dict[str, int]:
    """Column position of each task: schema metadata, no data is read."""
    return {c.strip().lower(): i for i, c in enumerate(c for c in overview.columns if c != id_col)}


def order_of(key, order: Mapping[str, int], unknown: int = 10_000):
    if not order:
        return F.lit(unknown)
    pairs = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(unknown)).cast("int")


def attach_static(
    df: DataFrame,
    static: DataFrame | None,
    physiology: Sequence[str],
    use_static: bool,
    worker: str = "worker_id",
    specialization: str = "specialization_index",
    experience: str = "experience_level",
) -> DataFrame:
    """Profile columns onto every row: static value, else the frame's own, else 0, 1, 0 and 1.

    The profile table has one row per training worker. It carries no hint: the adaptive planner broadcasts it
    while small and otherwise splits the partition of a hot worker.
    """
    wanted = {specialization: 0, experience: 1}
    wanted |= {f"baseline_mu_{c}": 0.0 for c in physiology}
    wanted |= {f"baseline_sigma_{c}": 1.0 for c in physiology}
    own = set(df.columns)
    given: set[str] = set()
    if static is not None:
        given = {c for c in wanted if c in static.columns}
        side = static.select(F.col(worker), *[F.col(c).alias(f"_static_{c}") for c in given])
        df = df.join(side, worker, "left")

    def value(name: str, default):
        if name in (specialization, experience) and not use_static:
            return F.lit(default)
        sources = [F.col(f"_static_{name}")] if name in given else []
        sources += [F.col(name)] if name in own else []
        return F.coalesce(*sources, F.lit(default))

    types = {c: "int" if isinstance(d, int) else "double" for c, d in wanted.items()}
    filled = df.withColumns({c: value(c, d).cast(types[c]) for c, d in wanted.items()})
    return filled.drop(*[f"_static_{c}" for c in given])


def append_profiles(windows: DataFrame, static: DataFrame | None, worker: str = "worker_id") -> DataFrame:
    """Profile columns as features: 0 throughout for workers without a profile."""
    if static is None:
        return windows
    names = [c for c in static.columns if c != worker]
    side = static.select(worker, *[F.col(c).cast("double").alias(f"profile_{c}") for c in names])
    return windows.join(side, worker, "left").fillna(0.0, [f"profile_{c}" for c in names])


def baselines_or_global(rows: DataFrame, own: DataFrame, overall: DataFrame, columns: Sequence[str], worker: str):
    """Worker statistics where known, else the one-row overall ones (a proven broadcast)."""
    mine = own.select(worker, *[F.col(c).alias(f"_own_{c}") for c in columns])
    all_ = overall.select(*[F.col(c).alias(f"_all_{c}") for c in columns])
    joined = rows.join(mine, worker, "left").crossJoin(F.broadcast(all_))
    filled = joined.withColumns({c: F.coalesce(F.col(f"_own_{c}"), F.col(f"_all_{c}")) for c in columns})
    return filled.drop(*[f"_{p}_{c}" for p in ("own", "all") for c in columns])


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def in_several_splits(df: DataFrame, worker: str, split: str = "split") -> DataFrame:
    """Workers seen in more than one split."""
    return (
        df.groupBy(worker)
        .agg(F.countDistinct(split).alias("splits"))
        .where(F.col("splits") > 1)
    )


def absent(requested: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Requested keys that the data lacks. The data is reduced to its keys before the join."""
    return requested.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")


def unseen(train: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys that occur in the other frames but not in training."""
    seen = union_all(*[o.select(key).distinct() for o in others]).distinct()
    return absent(seen, train, key)
