"""Sinks, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark import sinks
from signalspark.catalog import fixtures as X
from signalspark.catalog import query
from signalspark.catalog.windowed import H, L, STEP, cutter
from signalspark.operators import split, windows
from signalspark.session import shared_folder


@query(
    f"""WITH {X.HELD_OUT}, {X.windows_sql("seg", L, H, STEP)}
SELECT split, CAST(count(*) FILTER (WHERE o = 0) AS BIGINT) AS windows,
  CAST(count(*) FILTER (WHERE o < {L}) AS BIGINT) AS samples, round(sum(eda) FILTER (WHERE o < {L}), 6) + 0.0 AS eda
FROM cell GROUP BY split"""
)
def window_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Window arrays, one folder per split."""
    layout = X.layout_of(spark, sf)
    path = shared_folder(spark, "windows")
    sinks.write_windows(windows.window_table(X.held_out(spark, sf, layout), cutter(layout)), path)
    back = spark.read.parquet(path)
    total = F.aggregate("eda", F.lit(0.0), lambda a, x: a + x)
    return back.groupBy("split").agg(
        F.count(F.lit(1)).alias("windows"), F.sum(F.size("eda")).alias("samples"), X.r6(F.sum(total)).alias("eda")
    )


@query(
    f"""WITH {X.HELD_OUT}, {X.windows_sql("seg", L, H, STEP)}
SELECT worker_id, split, CAST(min(start_idx) AS INTEGER) AS start_idx, CAST(max(time_idx) AS INTEGER) AS label_time_idx
FROM cell GROUP BY worker_id, split, s"""
)
def window_meta_sink(spark: SparkSession, sf: str) -> DataFrame:
    layout = X.layout_of(spark, sf)
    path = shared_folder(spark, "meta")
    sinks.write_meta(windows.window_meta(X.held_out(spark, sf, layout), cutter(layout)), path)
    fields = "worker_id string, start_idx int, end_idx int, label_time_idx int, split string"
    back = spark.read.option("header", True).schema(fields).csv(path)
    return back.select("worker_id", "split", "start_idx", "label_time_idx")


@query(f"WITH {X.TIMED} SELECT split, CAST(count(*) AS BIGINT) AS rows FROM seg GROUP BY split")
def manifest_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "splits")
    sinks.write_manifest(split.manifest(X.timed(spark, sf, X.layout_of(spark, sf)), X.SCHEMA), path)
    back = spark.read.option("header", True).schema("worker_id string, row_time_idx int, split string").csv(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {X.SIG} SELECT worker_id, event_id, CAST(time_idx AS INTEGER) AS time_idx FROM sig")
def raw_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A frame written once and read back."""
    rows = X.signals(spark, sf, X.layout_of(spark, sf)).select("worker_id", "event_id", "time_idx")
    return sinks.cache_raw(rows, shared_folder(spark, "raw"))


@query(
    """SELECT l_returnflag AS model, CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 6) + 0.0 AS mean
FROM lineitem GROUP BY 1"""
)
def metrics_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics as JSON lines."""
    path = shared_folder(spark, "metrics")
    table = X.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model"))
    sinks.write_metrics(table.agg(F.count(F.lit(1)).alias("n"), X.r6(F.avg("l_quantity")).alias("mean")), path)
    return spark.read.schema("model string, n long, mean double").json(path)
