"""Train/val/test assignment. The split is a column, not three frames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.layout import SeriesLayout, number_rows
from signalspark.operators import relate
from signalspark.schema import SignalSchema

SPLITS = ("train", "val", "test")


def by_time(
    df: DataFrame,
    schema: SignalSchema,
    train: float,
    val: float,
    test: float,
    layout: SeriesLayout,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Leading, middle and trailing share of each worker's rows.

    Adds ``split`` and the row's place in its part, ``_seg_pos`` of ``_seg_n``, by arithmetic on the position:
    later stages need no further numbering.
    """
    if abs(train + val + test - 1.0) > 1e-8 + 1e-5:
        raise ValueError("split ratios must sum to 1")
    rows = number_rows(df, [schema.worker], order or [schema.time_idx], layout)
    return place_by_time(rows, train, val).drop("_pos", "_n")


def place_by_time(rows: DataFrame, train: float, val: float, pos: str = "_pos", total: str = "_n") -> DataFrame:
    """The split of numbered rows. Bounds are truncated products of doubles."""
    n = F.col(total).cast("double")
    cut = rows.withColumns({"_a": F.floor(n * F.lit(float(train))), "_b": F.floor(n * F.lit(float(train + val)))})
    p, a, b = F.col(pos), F.col("_a"), F.col("_b")
    return cut.withColumns(
        {
            "split": F.when(p < a, "train").when(p < b, "val").otherwise("test"),
            "_seg_pos": F.when(p < a, p).when(p < b, p - a).otherwise(p - b).cast("long"),
            "_seg_n": F.when(p < a, a).when(p < b, b - a).otherwise(F.col(total) - b).cast("long"),
        }
    ).drop("_a", "_b")


def by_subject(
    df: DataFrame,
    schema: SignalSchema,
    assignment: DataFrame,
    layout: SeriesLayout,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Whole workers per split, from a (worker, split) table; rows of unlisted workers are dropped.

    ``check_assignment`` validates the table. The join has no hint: AQE broadcasts a small table and splits a
    hot worker's partition otherwise.
    """
    rows = df.join(assignment.select(schema.worker, "split"), schema.worker)
    numbered = number_rows(rows, [schema.worker], order or [schema.time_idx], layout, "_seg_pos", "_seg_n")
    return numbered


def check_assignment(df: DataFrame, schema: SignalSchema, assignment: DataFrame) -> DataFrame:
    """Raise when splits share a worker or name one that the data lacks; returns the assignment."""
    twice = relate.in_several_splits(assignment, schema.worker).first()
    if twice:
        raise ValueError(f"splits overlap: worker {twice[schema.worker]} is in more than one")
    lost = relate.absent(assignment, df, schema.worker).orderBy(schema.worker).first()
    if lost:
        raise ValueError(f"requested worker {lost[schema.worker]} is not in the data")
    return assignment


def assignment_table(spark, schema: SignalSchema, groups: Mapping[str, Iterable[str]]) -> DataFrame:
    pairs = [(str(w), split) for split, workers in groups.items() for w in workers]
    return spark.createDataFrame(pairs, f"`{schema.worker}` string, split string")


def manifest(df: DataFrame, schema: SignalSchema) -> DataFrame:
    return df.select(
        F.col(schema.worker).cast("string").alias("worker_id"),
        F.col(schema.time_idx).cast("int").alias("row_time_idx"),
        "split",
    )


def out_of_order(df: DataFrame, schema: SignalSchema) -> DataFrame:
    """Workers whose splits overlap in time; empty for a chronological split."""
    t = F.col(schema.time_idx)

    def edge(fn, split: str):
        return fn(F.when(F.col("split") == split, t))

    edges = df.groupBy(schema.worker).agg(
        edge(F.max, "train").alias("train_end"),
        edge(F.min, "val").alias("val_start"),
        edge(F.max, "val").alias("val_end"),
        edge(F.min, "test").alias("test_start"),
    )
    # A missing part makes its comparison null, hence no violation.
    return edges.where("val_start <= train_end or test_start <= val_end")


def require_chronological(df: DataFrame, schema: SignalSchema) -> DataFrame:
    found = out_of_order(df, schema).first()
    if found:
        raise ValueError(f"chronological split violated for worker {found[schema.worker]}")
    return df


def worker_load(df: DataFrame, schema: SignalSchema) -> DataFrame:
    """Rows and positive rows per worker."""
    return df.groupBy(F.col(schema.worker).cast("string").alias(schema.worker)).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(schema.stress).cast("long").alias("positives")
    )


def split_statistics(load: DataFrame, assignment: DataFrame, worker: str) -> DataFrame:
    """Subjects, rows and positive rows per split."""
    return (
        load.join(assignment, worker)
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("subjects"), F.sum("rows").alias("rows"), F.sum("positives").alias("positives")
        )
    )


def uncovered(df: DataFrame, schema: SignalSchema, min_val: int, min_test: int) -> DataFrame:
    """Splits lacking a class or the minimum of positives."""
    wanted = df.sparkSession.createDataFrame(
        [("train", 0), ("val", min_val), ("test", min_test)], "split string, _need int"
    )
    seen = df.groupBy("split").agg(
        F.max((F.col(schema.stress) == 0).cast("int")).alias("has_negative"),
        F.max((F.col(schema.stress) == 1).cast("int")).alias("has_positive"),
        F.sum(schema.stress).cast("long").alias("positives"),
    )
    # Three rows: a split without any row is still looked at.
    found = F.broadcast(wanted).join(seen, "split", "left").na.fill(0)
    short = (F.col("has_negative") == 0) | (F.col("has_positive") == 0) | (F.col("positives") < F.col("_need"))
    return found.where(short).drop("_need")


# Fixed values of the balanced holdout: fewest workers per split, weights of the distances to the targets in
# workers, positives and rows, and what a positive worker counts for in val and test.
LEAST_WORKERS = (3, 2, 2)
WEIGHTS = (0.5, 1.0, 0.5)
POSITIVE_BONUS = (0.0, 0.15, 0.15)


def balanced_holdout(
    load: DataFrame, schema: SignalSchema, train: float, val: float, min_val: int, min_test: int
) -> DataFrame:
    """Assign workers to splits so that worker, row and positive counts come near their targets.

    Workers of equal counts are interchangeable, so the rule is worked out on the *cells* of the (positives, rows)
    histogram, counted in parallel. One ordered pass over the cells deals each one's workers to the splits and says
    how many of them each split gets; inside a cell, workers are told apart by their number in it.
    """
    worker = schema.worker
    cells = load.groupBy("positives", "rows").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("positives")).alias("p"), F.sum(F.col("n") * F.col("rows")).alias("r")
    ).first()
    if (total["n"] or 0) < 9:
        raise ValueError("a three-way holdout needs at least 9 workers")
    targets = _targets((total["n"], total["p"], total["r"]), (train, val), (1, min_val, min_test))

    def deal(table: pd.DataFrame) -> pd.DataFrame:
        ordered = table.sort_values(["positives", "rows"], ascending=False, ignore_index=True)
        item = np.stack([np.ones(len(ordered)), ordered["positives"], ordered["rows"]], axis=1)
        share = _repaired(_dealt(item, ordered["n"].to_numpy(), targets), item[:, 1], (0, min_val, min_test))
        cell, split = np.nonzero(share)
        upto = share.cumsum(axis=1)
        return pd.DataFrame(
            {
                "positives": ordered["positives"].to_numpy()[cell],
                "rows": ordered["rows"].to_numpy()[cell],
                "low": (upto - share)[cell, split],
                "high": upto[cell, split],
                "split": np.array(SPLITS)[split],
            }
        )

    ranges = cells.groupBy().applyInPandas(deal, "positives long, rows long, low long, high long, split string")
    place = F.row_number().over(Window.partitionBy("positives", "rows").orderBy(worker)) - 1
    numbered = load.withColumn("_place", place)
    inside = (F.col("_place") >= F.col("low")) & (F.col("_place") < F.col("high"))
    return numbered.join(ranges, ["positives", "rows"]).where(inside).select(worker, "split")


def _targets(total: Sequence[int], shares: Sequence[float], least_positives: Sequence[int]) -> np.ndarray:
    """Targets by split (rows) of workers, positives and rows (columns)."""

    def parts(whole: int, least: Sequence[int]) -> np.ndarray:
        first = [round(whole * share) for share in shares]
        return np.maximum([*first, whole - sum(first)], least)

    # The test share of the workers is what the raised shares of the others leave.
    lifted = np.maximum([round(total[0] * share) for share in shares], LEAST_WORKERS[:2])
    workers = np.array([*lifted, max(LEAST_WORKERS[2], total[0] - lifted.sum())])
    workers[0] = max(LEAST_WORKERS[0], workers[0] + total[0] - workers.sum())
    positives = parts(total[1], least_positives)
    positives[0] = max(1, positives[0] - max(0, positives.sum() - total[1]))
    return np.stack([workers, positives, parts(total[2], (1, 1, 1))], axis=1).astype(float)


def _dealt(item: np.ndarray, n: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Workers of each cell that each split gets, one after the other to the split that it suits best.

    A split's distance after k more equal workers is convex in k: it stays the best choice for a first stretch of
    them, whose end is found by bisection.
    """
    have = np.zeros_like(targets)
    share = np.zeros((len(n), len(targets)), np.int64)
    scale = np.array(WEIGHTS) / np.maximum(targets, 1)

    def distance(split: int, one: np.ndarray, k: int) -> float:
        off = float((np.abs(have[split] + k * one - targets[split]) * scale[split]).sum())
        return off - (POSITIVE_BONUS[split] if one[1] > 0 else 0.0)

    for cell, one in enumerate(item):
        left = int(n[cell])
        while left:
            room = targets[:, 0] - have[:, 0]
            open_splits = [s for s in range(len(targets)) if room[s] > 0] or list(range(len(targets)))
            now = {s: distance(s, one, 1) for s in open_splits}
            best = min(open_splits, key=now.get)
            bars = [(value, s) for s, value in now.items() if s != best]
            low, high = 1, min(left, int(room[best])) if room[best] > 0 else left
            while low < high:
                middle = (low + high + 1) // 2
                if all((distance(best, one, middle), best) < bar for bar in bars):
                    low = middle
                else:
                    high = middle - 1
            share[cell, best] += low
            have[best] += low * one
            left -= low
    return share


def _repaired(share: np.ndarray, positives: np.ndarray, least: Sequence[int]) -> np.ndarray:
    """Lifts val, then test, to their least positives by exchanges of train's richest workers for their poorest.

    The k-th exchange takes the k-th richest for the k-th poorest as long as that is a gain. Cells are in falling
    order of positives, so stretches of equal exchanges follow from where cells begin and end.
    """
    for split in range(1, len(least)):
        lack = least[split] - int((share[:, split] * positives).sum())
        rich, poor = 0, len(positives) - 1
        given, taken = share[:, 0].copy(), share[:, split].copy()
        while lack > 0:
            while rich < len(given) and not given[rich]:
                rich += 1
            while poor >= 0 and not taken[poor]:
                poor -= 1
            if rich == len(given) or poor < 0 or positives[rich] <= positives[poor]:
                break
            gain = int(positives[rich] - positives[poor])
            k = int(min(given[rich], taken[poor], -(-lack // gain)))
            given[rich] -= k
            taken[poor] -= k
            share[rich, [0, split]] += (-k, k)
            share[poor, [0, split]] += (k, -k)
            lack -= k * gain
    return share
