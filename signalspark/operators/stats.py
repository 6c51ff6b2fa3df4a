"""Diagnostics: per-column, per-class and per-worker summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.functions import scalar as S
from signalspark.schema import SignalSchema


def _long(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(*by, F.inline(F.array(*cells)))


def numeric_stats(df: DataFrame, columns: Sequence[str], by: str = "split") -> DataFrame:
    """Range, mean and population deviation of the finite cells, shares of missing and infinite ones.

    One aggregation over (split, column); partial sums keep the exchange at splits x columns rows.
    """
    x = S.finite(F.col("value"))
    infinite = F.abs(F.col("value")) == float("inf")
    absent = F.col("value").isNull() | F.isnan("value")
    zero = F.lit(0.0)
    return _long(df, columns, [by]).groupBy(by, "column").agg(
        F.coalesce(F.min(x), zero).alias("min"),
        F.coalesce(F.max(x), zero).alias("max"),
        F.coalesce(F.avg(x), zero).alias("mean"),
        F.coalesce(F.stddev_pop(x), zero).alias("std"),
        F.avg(absent.cast("double")).alias("nan_pct"),
        F.avg(F.coalesce(infinite, F.lit(False)).cast("double")).alias("inf_pct"),
    )


def profile_columns(df: DataFrame, schema: SignalSchema) -> list[str]:
    named = {c for c in df.columns if c.startswith(("baseline_mu_", "baseline_sigma_"))}
    return sorted(named | ({schema.specialization, schema.experience} & set(df.columns)))


def profile_stats(df: DataFrame, columns: Sequence[str], by: str = "split") -> DataFrame:
    """Mean, sample deviation, range, share of distinct values and share missing per split and column.

    Values are grouped first, so counting distinct ones needs no per-key set and a constant column collapses
    before the exchange.
    """
    x = S.number(F.col("value"))
    grouped = _long(df, columns, [by]).select(by, "column", x.alias("value")).groupBy(by, "column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    v, n = F.col("value"), F.col("n").cast("double")
    known = F.when(v.isNotNull(), n)
    sums = grouped.groupBy(by, "column").agg(
        F.coalesce(F.sum(known), F.lit(0.0)).alias("k"),
        F.sum(n).alias("rows"),
        F.count(v).alias("distinct"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("centre"),
        F.sum(v * n).alias("total"),
    )
    # The deviation is taken around a nearby centre in a second look at the grouped values.
    centred = grouped.join(F.broadcast(sums.select(by, "column", "centre")), [by, "column"])
    d = v - F.col("centre")
    moments = centred.groupBy(by, "column").agg(F.sum(d * n).alias("d1"), F.sum(d * d * n).alias("d2"))
    k = F.col("k")
    variance = (F.col("d2") - F.col("d1") * F.col("d1") / k) / (k - 1)
    joined = sums.join(moments, [by, "column"])
    return joined.select(
        by,
        "column",
        F.when(k > 0, F.col("total") / k).otherwise(0.0).alias("mean"),
        F.when(k > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).when(k == 0, 0.0).alias("std"),
        F.coalesce("min", F.lit(0.0)).alias("min"),
        F.coalesce("max", F.lit(0.0)).alias("max"),
        (F.col("distinct") / F.greatest(k, F.lit(1.0))).alias("unique_ratio"),
        (1.0 - k / F.col("rows")).alias("missing_pct"),
    )


def matrix_stats(df: DataFrame, columns: Sequence[str], by: str = "split") -> DataFrame:
    """Shape, missing, infinite and finite share of the feature matrix per split."""
    cells = _long(df, columns, [by])
    absent = F.col("value").isNull() | F.isnan("value")
    infinite = F.coalesce(F.abs(F.col("value")) == float("inf"), F.lit(False))
    return cells.groupBy(by).agg(
        F.floor(F.count(F.lit(1)) / len(columns)).alias("rows"),
        F.lit(len(columns)).cast("long").alias("columns"),
        F.sum(absent.cast("long")).alias("nan_count"),
        F.sum(infinite.cast("long")).alias("inf_count"),
        F.avg((~absent & ~infinite).cast("double")).alias("finite_ratio"),
    )


def class_summary(df: DataFrame, schema: SignalSchema) -> DataFrame:
    """Rows, workers and stress rate per class.

    Grouped by (class, worker) first: distinct workers become a plain count and a hot class is spread out.
    """
    pairs = df.groupBy(schema.protocol, schema.worker).agg(
        F.count(F.lit(1)).alias("n"), F.count(schema.stress).alias("k"), F.sum(schema.stress).alias("s")
    )
    return pairs.groupBy(schema.protocol).agg(
        F.sum("n").alias("rows"),
        F.count(schema.worker).alias("workers"),
        S.ratio(F.sum("s"), F.sum("k"), None).alias("stress_rate"),
    )


def worker_summary(df: DataFrame, schema: SignalSchema) -> DataFrame:
    return df.groupBy(schema.worker).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(schema.time_idx).alias("first_time"),
        F.max(schema.time_idx).alias("last_time"),
        F.avg(schema.stress).alias("stress_rate"),
    )


def table_summary(df: DataFrame, schema: SignalSchema) -> DataFrame:
    """One row: size, vocabulary, time range and missing shares of the core signals."""
    t = schema.time_idx

    def gaps(c: str):
        return F.avg(S.number(F.col(c)).isNull().cast("double")) if c in df.columns else F.lit(1.0)

    totals = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(t).alias("time_idx_min"),
        F.max(t).alias("time_idx_max"),
        *[gaps(c).alias(f"missing_{c}") for c in ("ecg", "eda", "temp")],
    )
    workers = df.select(schema.worker).distinct().agg(F.count(schema.worker).alias("workers"))
    classes = df.select(schema.protocol).distinct().agg(F.count(schema.protocol).alias("classes"))
    return totals.crossJoin(F.broadcast(workers)).crossJoin(F.broadcast(classes))


def label_counts(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per label value, missing labels included."""
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("rows"))
