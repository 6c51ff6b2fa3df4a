"""Row selection by position: strides, even-spaced caps, top-k, first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalspark.layout import SeriesLayout, number_rows


def stride(df: DataFrame, by: Sequence[str], order: Sequence[str], step: int, layout: SeriesLayout) -> DataFrame:
    """Every ``step``-th row of each series."""
    if step <= 1:
        return df
    return number_rows(df, by, order, layout).where(F.col("_pos") % step == 0).drop("_pos", "_n")


def evenly_spaced(pos: Column, n: Column, keep: int) -> Column:
    """True for the rows an even spacing of ``keep`` points over ``n`` rows falls on.

    Point i lies at ``trunc(i * (n - 1) / (keep - 1))``. Instead of listing the points, each row asks whether
    one of the two candidates around it does, so a series is never gathered.
    """
    if keep == 1:
        return (n <= 1) | (pos == 0)
    gap = (n - 1) / F.lit(float(keep - 1))

    def lands(i: Column) -> Column:
        at = F.when(i >= keep - 1, n - 1).otherwise(F.floor(i * gap))
        return (i >= 0) & (i <= keep - 1) & (at == pos)

    guess = F.floor(pos / gap)
    return (n <= keep) | lands(guess - 1) | lands(guess) | lands(guess + 1) | lands(guess + 2)


def cap(df: DataFrame, by: Sequence[str], order: Sequence[str], keep: int | None, layout: SeriesLayout) -> DataFrame:
    """At most ``keep`` evenly spaced rows per series."""
    if not keep or keep <= 0:
        return df
    rows = number_rows(df, by, order, layout)
    return rows.where(evenly_spaced(F.col("_pos"), F.col("_n"), keep)).drop("_pos", "_n")


def restride(
    df: DataFrame, by: Sequence[str], order: Sequence[str], step: int, out: str, layout: SeriesLayout
) -> DataFrame:
    """Keep every ``step``-th row and renumber ``out`` without gaps; kept positions are multiples of the step."""
    rows = number_rows(df, by, order, layout)
    kept = rows.where(F.col("_pos") % step == 0) if step > 1 else rows
    return kept.withColumn(out, F.floor(F.col("_pos") / step).cast("int")).drop("_pos", "_n")


def top_k(df: DataFrame, value: str, k: int, ties: Sequence[str]) -> DataFrame:
    return df.orderBy(F.desc(value), *ties).limit(k)


def first_rows(df: DataFrame, group: str, order: str, groups: int, rows: int) -> DataFrame:
    """The earliest ``rows`` rows of each of the first ``groups`` groups.

    The few wanted groups are looked up first. The rank filter becomes a group limit that runs before the
    exchange as well, so each task ships at most ``rows`` rows of a group, however hot it is.
    """
    chosen = df.select(group).distinct().orderBy(group).limit(groups)
    wanted = df.join(F.broadcast(chosen), group, "left_semi")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return wanted.withColumn("rank", rank).where(F.col("rank") <= rows)
