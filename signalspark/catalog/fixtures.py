"""The ``events`` table seen as a signal frame, in Spark and as SQL text for the comparison queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.layout import SeriesLayout, number_rows
from signalspark.operators import split
from signalspark.schema import SignalSchema

SCHEMA = SignalSchema()
ORDER = ("_at", "event_id")
RATIOS = (0.7, 0.15, 0.15)
TIME_CUTS = (RATIOS[0], RATIOS[0] + RATIOS[1])

SIG = """sig AS (
  SELECT CAST(user_id AS VARCHAR) AS worker_id, user_id, event_id,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS time_idx,
    CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n,
    CASE WHEN event_id % 37 = 0 THEN NULL ELSE value END AS ecg,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS eda,
    value / 10 + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS temp,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10 AS distance_to_robot,
    value / 100 AS robot_speed,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) < 20 THEN 1 ELSE 0 END AS hazard_zone,
    event_type AS task_phase, event_type AS protocol_label,
    CASE WHEN event_type = 'error' OR value > 80 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_stress,
    least(greatest(1 - value / 500, 0.0::DOUBLE), 1.0::DOUBLE) AS y_comfort_proxy,
    CAST(user_id % 4 AS INTEGER) AS specialization_index, CAST(1 + user_id % 5 AS INTEGER) AS experience_level,
    value
  FROM events)"""

TIMED = f"""{SIG}, seg0 AS (
  SELECT *, CASE WHEN time_idx < floor(n * {TIME_CUTS[0]!r}::DOUBLE) THEN 'train'
      WHEN time_idx < floor(n * {TIME_CUTS[1]!r}::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM sig
), seg AS (
  SELECT *, row_number() OVER (PARTITION BY worker_id, split ORDER BY time_idx) - 1 AS pos,
    count(*) OVER (PARTITION BY worker_id, split) AS seg_n FROM seg0
)"""

HELD_OUT = f"""{SIG}, seg AS (
  SELECT *, CASE WHEN user_id % 10 < 7 THEN 'train' WHEN user_id % 10 = 7 THEN 'val' ELSE 'test' END AS split,
    time_idx AS pos, n AS seg_n FROM sig
)"""


def filled_sql(base: str, columns=("ecg", "eda", "temp")) -> str:
    """``base`` plus ``filled``: gaps closed inside (worker, split)."""
    closed = ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY worker_id, split ORDER BY pos "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (PARTITION BY "
        f"worker_id, split ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) AS {c}"
        for c in columns
    )
    return f"{base}, filled AS (SELECT * EXCLUDE ({', '.join(columns)}), {closed} FROM seg)"


def scaled_sql(base: str, columns=("ecg", "eda", "temp")) -> str:
    """``filled_sql`` plus ``scaled``: z-scores by training statistics."""
    stats = ", ".join(
        f"avg({c}) AS mu_{c}, greatest(stddev_samp({c}) + 1e-6::DOUBLE, 1e-6::DOUBLE) AS sd_{c}" for c in columns
    )
    z = ", ".join(f"({c} - mu_{c}) / sd_{c} AS {c}" for c in columns)
    return (
        f"{filled_sql(base, columns)}, st AS (SELECT {stats} FROM filled WHERE split = 'train'), "
        f"scaled AS (SELECT * EXCLUDE ({', '.join(columns)}), {z} FROM filled, st)"
    )


def windows_sql(source: str, length: int, horizon: int, step: int) -> str:
    """``win``: window starts; ``cell``: every sample row of every window at offset ``o``."""
    return f"""win AS (
  SELECT worker_id, split, pos AS s, time_idx AS start_idx FROM {source}
  WHERE pos % {step} = 0 AND pos <= seg_n - {length + horizon}
), cell AS (
  SELECT w.worker_id, w.split, w.s, w.start_idx, f.pos - w.s AS o, f.* EXCLUDE (worker_id, split, pos)
  FROM win w JOIN {source} f ON f.worker_id = w.worker_id AND f.split = w.split
    AND f.pos BETWEEN w.s AND w.s + {length + horizon - 1}
)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(value: Column | str) -> Column:
    """Rounded for comparison; the addition turns a negative zero into a plain one."""
    return F.round(F.col(value) if isinstance(value, str) else value, 6) + F.lit(0.0)


def raw_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signal columns of every event, before time steps are numbered."""
    k = F.get_json_object("props", "$.k").cast("double")
    v = F.col("value")
    stressed = (F.col("event_type") == "error") | (v > 80)
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("worker_id"),
        "user_id",
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"),
        F.when(F.col("event_id") % 37 != 0, v).alias("ecg"),
        k.alias("eda"),
        (v / 10 + k / 100).alias("temp"),
        (k / 10).alias("distance_to_robot"),
        (v / 100).alias("robot_speed"),
        (k < 20).cast("int").alias("hazard_zone"),
        F.col("event_type").alias("task_phase"),
        F.col("event_type").alias("protocol_label"),
        stressed.cast("double").alias("y_stress"),
        F.least(F.greatest(1 - v / 500, F.lit(0.0)), F.lit(1.0)).alias("y_comfort_proxy"),
        (F.col("user_id") % 4).cast("int").alias("specialization_index"),
        (1 + F.col("user_id") % 5).cast("int").alias("experience_level"),
        "value",
    )


def layout_of(spark: SparkSession, sf: str) -> SeriesLayout:
    events = table(spark, sf, "events").select(
        "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at")
    )
    return SeriesLayout.fit(events, "user_id", "_at")


def signals(spark: SparkSession, sf: str, layout: SeriesLayout) -> DataFrame:
    """The signal frame with time steps."""
    rows = number_rows(raw_signals(spark, sf), ["worker_id"], ORDER, layout, "_pos", "_n")
    return rows.withColumns({"time_idx": F.col("_pos").cast("int"), "timestamp": F.col("_pos").cast("double")})


def timed(spark: SparkSession, sf: str, layout: SeriesLayout) -> DataFrame:
    """Split along time; the same numbering serves time steps and split."""
    return split.place_by_time(signals(spark, sf, layout), *RATIOS[:2])


def held_out(spark: SparkSession, sf: str, layout: SeriesLayout) -> DataFrame:
    """Split by subject: the user id decides, so the rule needs no join."""
    u = F.col("user_id") % 10
    rows = signals(spark, sf, layout).withColumn(
        "split", F.when(u < 7, "train").when(u == 7, "val").otherwise("test")
    )
    return rows.withColumnsRenamed({"_pos": "_seg_pos", "_n": "_seg_n"})
