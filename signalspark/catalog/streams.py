"""Stream forms, drained from the events files and closed by a heartbeat, compared with the batch recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.catalog import fixtures as X
from signalspark.catalog import query
from signalspark.catalog.series import ALPHA, SCALE, WARM, online_sql
from signalspark.session import shared_folder
from signalspark.streaming import online


#: Events spread over a month; a slice is a worker's week.
ARRIVAL = online.Arrival("1 hour", slice_ms=7 * 86_400_000, idle_ms=40 * 86_400_000)


def source(spark: SparkSession, sf: str) -> DataFrame:
    schema = X.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    v = F.col("value")
    return events.select(
        F.col("user_id").cast("string").alias("worker_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        "event_id",
        F.get_json_object("props", "$.k").cast("double").alias("eda"),
        ((F.col("event_type") == "error") | (v > 80)).cast("double").alias("y"),
    )


@query(
    f"""WITH RECURSIVE {X.filled_sql(X.HELD_OUT)}, {online_sql("eda")}
SELECT e.worker_id, s.event_id, round((e.x - e.mu) / greatest(e.sd, 1e-6::DOUBLE), 6) + 0.0 AS eda,
  round(e.mu, 6) + 0.0 AS baseline_mu_eda, round(e.sd, 6) + 0.0 AS baseline_sigma_eda
FROM ema_eda e JOIN filled s USING (worker_id, split, pos)"""
)
def stream_normalize(spark: SparkSession, sf: str) -> DataFrame:
    events = source(spark, sf).withColumn("eda", F.col("eda") / SCALE)
    folder = shared_folder(spark, "stream-normalize")
    events = online.with_heartbeats(events, f"{folder}/beats")
    rows = online.normalize_stream(events, ["eda"], "worker_id", ["at", "event_id"], ALPHA, WARM, ARRIVAL)
    done = online.drain(rows, folder, f"{folder}/beats", "at").rows
    named = ("eda", "baseline_mu_eda", "baseline_sigma_eda")
    return done.select("worker_id", "event_id", *[X.r6(c).alias(c) for c in named])


@query(
    f"""WITH {X.HELD_OUT}, {X.windows_sql("seg", 10, 2, 3)}
SELECT worker_id, CAST(min(start_idx) AS BIGINT) AS start_idx, CAST(max(time_idx) AS BIGINT) AS label_idx,
  round(avg(eda) FILTER (WHERE o < 10), 6) + 0.0 AS mean, max(y_stress) FILTER (WHERE o = 11) AS y
FROM cell GROUP BY worker_id, split, s"""
)
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "stream-windows")
    events = online.with_heartbeats(source(spark, sf), f"{folder}/beats")
    rows = online.window_stream(events, "eda", "y", "worker_id", ["at", "event_id"], 10, 2, 3, ARRIVAL)
    done = online.drain(rows, folder, f"{folder}/beats", "at").rows
    return done.withColumn("mean", X.r6("mean"))
