"""Sources, typing and column cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.catalog import fixtures as X
from signalspark.catalog import query
from signalspark.functions import scalar as S
from signalspark.operators import clean, relate
from signalspark.schema import SignalSchema
from signalspark.session import shared_folder
from signalspark.sources import csv, records, router


@query(
    f"""WITH {X.SIG} SELECT worker_id, CAST(event_id AS DOUBLE) AS timestamp, CAST(event_id AS INTEGER) AS time_idx,
  'unknown' AS protocol_label, CASE WHEN (event_id % 10) / 10.0::DOUBLE >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    AS y_stress, round(least(greatest(1 - (event_id % 10) / 10.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE), 6) + 0.0
    AS y_comfort_proxy,
  round(value, 6) + 0.0 AS ecg, CASE WHEN event_id % 5 <> 0 THEN round(value / 2, 6) + 0.0 END AS eda,
  round(value / 3, 6) + 0.0 AS temp, 0.0::DOUBLE AS distance_to_robot, 0.0::DOUBLE AS robot_speed, 0 AS hazard_zone,
  'default' AS task_phase, CAST(('0x' || substr(md5(worker_id), 1, 8))::BIGINT % 5 AS INTEGER) AS specialization_index,
  CAST(('0x' || substr(md5(worker_id), 1, 8))::BIGINT % 5 + 1 AS INTEGER) AS experience_level FROM sig"""
)
def typed_projection_legacy(spark: SparkSession, sf: str) -> DataFrame:
    """Old signal names, a single target, text numbers with junk, and everything optional absent."""
    v = F.col("value")
    raw = X.table(spark, sf, "events").select(
        F.col("user_id").alias("worker_id"),
        F.col("event_id").alias("time_idx"),
        v.alias("hr"),
        F.when(F.col("event_id") % 5 == 0, "NaN").otherwise((v / 2).cast("string")).alias("gsr"),
        (v / 3).alias("hrv_rmssd"),
        (F.col("event_id") % 10 / 10).cast("string").alias("target"),
    )
    frame = clean.typed_projection(raw, X.SCHEMA)
    return frame.withColumns({c: X.r6(c) for c in ("ecg", "eda", "temp", "y_comfort_proxy")})


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN -2.5::DOUBLE
    WHEN 4 THEN NULL ELSE round(value, 6) + 0.0 END AS parsed,
  CASE event_id % 6 WHEN 3 THEN 0.0::DOUBLE WHEN 5 THEN least(greatest(value / 100, 0.0::DOUBLE), 1.0::DOUBLE)
    ELSE 0.0::DOUBLE END AS clipped FROM events"""
)
def number_coercion(spark: SparkSession, sf: str) -> DataFrame:
    """Text to number with errors, not-a-number and infinities to null, then the clamp to [0, 1]."""
    kind = F.col("event_id") % 6
    text = (
        F.when(kind == 0, "n/a")
        .when(kind == 1, "NaN")
        .when(kind == 2, "inf")
        .when(kind == 3, " -2.5 ")
        .when(kind == 4, "12d")
        .otherwise(F.col("value").cast("string"))
    )
    parsed = S.finite(text, text=True)
    scaled = F.when(kind == 5, parsed / 100).otherwise(parsed)
    return X.table(spark, sf, "events").select(
        "event_id", X.r6(parsed).alias("parsed"), S.unit_interval(scaled).alias("clipped")
    )


@query(
    """SELECT DISTINCT user_id, 'S' || user_id AS loose, 'S' || user_id AS strict FROM events"""
)
def subject_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Several spellings of one id become one: prefix case, blanks and, if strict, leading zeros."""
    u = F.col("user_id").cast("string")
    rows = X.table(spark, sf, "events")
    kind = F.col("event_id") % 3
    loose = F.when(kind == 0, u).when(kind == 1, F.concat(F.lit(" s"), u)).otherwise(F.concat(F.lit("S"), u))
    strict = F.when(kind == 0, F.concat(F.lit("00"), u)).otherwise(F.concat(F.lit("s0"), u, F.lit(" ")))
    return rows.select(
        "user_id", S.subject_id(loose).alias("loose"), S.strict_subject_id(strict).alias("strict")
    ).distinct()


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'baseline' WHEN 2 THEN 'stress' WHEN 3 THEN 'amusement'
    ELSE 'other' END AS name, CASE event_id % 5 WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE END AS stress,
  CASE event_id % 5 WHEN 3 THEN 0.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE END AS stress_all,
  CASE event_id % 5 WHEN 1 THEN 0.9::DOUBLE WHEN 2 THEN 0.2::DOUBLE WHEN 3 THEN 0.7::DOUBLE END AS comfort
FROM events"""
)
def protocol_recode(spark: SparkSession, sf: str) -> DataFrame:
    code = (F.col("event_id") % 5).cast("double")
    strict, full = (S.protocol_columns(code, include, names=False) for include in (False, True))
    return X.table(spark, sf, "events").select(
        "event_id",
        strict["name"].alias("name"),
        strict["stress"].alias("stress"),
        full["stress"].alias("stress_all"),
        strict["comfort"].alias("comfort"),
    )


@query(
    f"""WITH {X.SIG}, r AS (SELECT event_id, distance_to_robot AS d, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(
    0.6::DOUBLE * (value - 50) / 50 + 0.2::DOUBLE * robot_speed + 0.2::DOUBLE / (distance_to_robot + 0.3::DOUBLE))))
    AS risk FROM sig)
SELECT event_id, round(risk, 6) + 0.0 AS risk_score, CASE WHEN d < 2 THEN 1 ELSE 0 END AS hazard_zone,
  CASE WHEN d < 2 THEN 'critical' ELSE 'normal' END AS task_phase,
  CASE WHEN risk > 0.55 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_stress,
  round(least(greatest(1 - 0.8::DOUBLE * risk, 0.0::DOUBLE), 1.0::DOUBLE), 6) + 0.0 AS y_comfort_proxy FROM r"""
)
def risk_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.raw_signals(spark, sf).withColumn("state", (F.col("value") - 50) / 50)
    out = clean.risk_labels(rows, X.SCHEMA, "state")
    return out.select(
        "event_id",
        X.r6("risk_score").alias("risk_score"),
        "hazard_zone",
        "task_phase",
        "y_stress",
        X.r6("y_comfort_proxy").alias("y_comfort_proxy"),
    )


def _draw_sql(column: str) -> str:
    digest = f"md5('123|{column}|' || event_id)"
    return f"('0x' || substr({digest}, 1, 8))::BIGINT % 1000000 >= 200000"


@query(
    f"""WITH {X.SIG} SELECT event_id, CASE WHEN {_draw_sql("eda")} THEN round(eda, 6) + 0.0 END AS eda,
  CASE WHEN {_draw_sql("temp")} THEN round(temp, 6) + 0.0 END AS temp FROM sig"""
)
def random_missingness(spark: SparkSession, sf: str) -> DataFrame:
    """Cells nulled at a rate of one in five; the draw hashes seed, column and row key."""
    rows = clean.drop_at_random(X.raw_signals(spark, sf), ["eda", "temp"], ["event_id"], 0.2, 123)
    return rows.select("event_id", X.r6("eda").alias("eda"), X.r6("temp").alias("temp"))


@query(
    """SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-(value - 50) / 10))
  ELSE least(greatest(value / 100, 0.0::DOUBLE), 1.0::DOUBLE) END, 6) + 0.0 AS p FROM events"""
)
def score_link(spark: SparkSession, sf: str) -> DataFrame:
    """Logit-loss scores pass the logistic; others are only clamped."""
    v = F.col("value")
    linked = F.when(F.col("event_id") % 2 == 0, S.link_scores((v - 50) / 10, "bce")).otherwise(
        S.link_scores(v / 100, "quantile")
    )
    return X.table(spark, sf, "events").select("event_id", X.r6(linked).alias("p"))


@query(
    f"""WITH {X.SIG} SELECT CAST(user_id % 3 AS BIGINT) AS downsample, round(4.0::DOUBLE / greatest(1, user_id % 3), 6)
  + 0.0 AS hz, round(60 * greatest(1, user_id % 3) / 4.0::DOUBLE, 6) + 0.0 AS window_seconds,
  CAST(count(*) AS BIGINT) AS rows FROM sig GROUP BY 1, 2, 3"""
)
def sampling_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Effective rate and window length in seconds per downsampling factor."""
    k = F.col("user_id") % 3
    hz = S.recode(k, {i: S.effective_rate(4.0, i) for i in range(3)})
    rows = X.raw_signals(spark, sf).select(k.alias("downsample"), hz.alias("hz"))
    rates = rows.withColumn("window_seconds", 60 / F.col("hz")).groupBy("downsample", "hz", "window_seconds")
    out = rates.agg(F.count(F.lit(1)).alias("rows"))
    return out.withColumns({c: X.r6(c) for c in ("hz", "window_seconds")})


# A record's channels: chest ECG is missing for every third subject, the accelerometer has two axes and one
# sample less than the rest.
def subject_records(spark: SparkSession, sf: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    one = F.transform(e, lambda x: F.array(x))
    two = F.transform(F.slice(e, 1, 63), lambda x: F.array(x, x * 2))
    label = F.transform("embedding", lambda x, i: (i + F.col("vec_id")) % 5)
    ecg = F.when(F.col("vec_id") % 3 != 0, one)
    doubled = F.transform(e, lambda x: F.array(x * 10))
    return X.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("subject"),
        label.alias("label"),
        F.struct(
            F.struct(ecg.alias("ECG"), one.alias("EDA"), one.alias("Temp"), two.alias("ACC")).alias("chest"),
            F.struct(doubled.alias("BVP")).alias("wrist"),
        ).alias("signal"),
    )


@query(
    """WITH u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(64)) AS i FROM embeddings)
SELECT 'S' || vec_id AS worker_id, CAST(i AS INTEGER) AS time_idx,
  CASE (i + vec_id) % 5 WHEN 1 THEN 'baseline' WHEN 2 THEN 'stress' ELSE 'amusement' END AS protocol_label,
  CASE (i + vec_id) % 5 WHEN 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_stress,
  round(CASE WHEN vec_id % 3 = 0 THEN x * 10 ELSE x END, 6) + 0.0 AS ecg, round(x, 6) + 0.0 AS eda,
  round(x, 6) + 0.0 AS temp, round(x * 1.5::DOUBLE, 6) + 0.0 AS accel
FROM u WHERE i < 63 AND (i + vec_id) % 5 IN (1, 2, 3)"""
)
def nested_records(spark: SparkSession, sf: str) -> DataFrame:
    """Nested channels to rows: fallback channel, axis mean, shortest length, recode, unlabelled rows dropped."""
    rows = records.explode_records(subject_records(spark, sf), X.SCHEMA, include_amusement=True)
    signals = ("ecg", "eda", "temp", "accel")
    return rows.select(
        "worker_id", "time_idx", "protocol_label", "y_stress", *[X.r6(c).alias(c) for c in signals]
    )


def _exported(spark: SparkSession, sf: str, name: str, columns: list) -> str:
    """Events written as CSV folders in the shared folder, as another system would leave them."""
    path = shared_folder(spark, name)
    X.table(spark, sf, "events").select(*columns).write.option("header", True).csv(f"{path}/part")
    return path


@query(
    """SELECT CAST(user_id AS VARCHAR) AS worker_id, event_id, round(value, 6) + 0.0 AS ecg,
  CASE WHEN event_id % 2 = 0 THEN round(value * 2, 6) + 0.0 END AS eda FROM events"""
)
def csv_directory_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Two groups of CSV files with different columns, scanned as one table."""
    path = shared_folder(spark, "scan")
    events = X.table(spark, sf, "events")
    worker, ecg = F.col("user_id").alias("worker_id"), F.col("value").alias("ecg")
    even, odd = (events.where(F.col("event_id") % 2 == k) for k in (0, 1))
    even.select(worker, "event_id", ecg, (F.col("value") * 2).alias("eda")).write.option("header", True).csv(
        f"{path}/a"
    )
    odd.select("event_id", ecg, worker).write.option("header", True).csv(f"{path}/b/c")
    rows = csv.generic(spark, path, X.SCHEMA)
    number = {c: S.number(F.col(c), text=True) for c in ("ecg", "eda")}
    return rows.select(
        "worker_id", F.col("event_id").cast("long").alias("event_id"), *[X.r6(v).alias(c) for c, v in number.items()]
    )


@query(
    """SELECT 'S' || user_id AS worker_id, CAST(event_id AS INTEGER) AS time_idx,
  CASE event_id % 4 WHEN 1 THEN 'baseline' ELSE 'stress' END AS protocol_label,
  CASE event_id % 4 WHEN 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS y_stress,
  CASE event_id % 4 WHEN 1 THEN 0.9::DOUBLE ELSE 0.2::DOUBLE END AS y_comfort_proxy
FROM events WHERE event_id % 4 IN (1, 2)"""
)
def subject_csv_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Exports with a numeric protocol: recode, drop unlabelled and excluded rows, normalise ids."""
    columns = [
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("worker_id"),
        F.col("event_id").alias("time_idx"),
        (F.col("event_id") % 4).alias("protocol_label"),
        F.col("value").alias("ecg"),
    ]
    path = _exported(spark, sf, "exports", columns)
    rows = csv.subject_exports(csv.scan(spark, path, with_order=True), X.SCHEMA)
    return rows.select(
        "worker_id",
        F.col("time_idx").cast("int").alias("time_idx"),
        "protocol_label",
        "y_stress",
        "y_comfort_proxy",
    )


@query("SELECT user_id, event_id FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL")
def targets_present(spark: SparkSession, sf: str) -> DataFrame:
    schema = SignalSchema(stress="value", comfort="event_type")
    return clean.has_targets(X.table(spark, sf, "events"), schema).select("user_id", "event_id")


@query("SELECT CAST(user_id AS VARCHAR) AS subject FROM events GROUP BY 1 HAVING FALSE UNION ALL SELECT 'S999999999'")
def absent_requested_subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Ids asked for that no row carries."""
    have = X.table(spark, sf, "events").select(S.strict_subject_id(F.col("user_id")).alias("subject"))
    asked = spark.createDataFrame([("s0",), ("S001",), ("999999999",)], "raw string").select(
        S.strict_subject_id(F.col("raw")).alias("subject")
    )
    return relate.absent(asked, have, "subject")


@query(
    f"""WITH {X.SIG} SELECT worker_id, CAST(time_idx AS INTEGER) AS time_idx, round(value, 6) + 0.0 AS ecg,
  CAST(value > 50 AS DOUBLE) AS y_stress, CASE WHEN value > 50 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS y_comfort_proxy
FROM sig"""
)
def csv_without_time_index(spark: SparkSession, sf: str) -> DataFrame:
    """Legacy columns and a numeric timestamp, through the router: steps are counted in time order per worker."""
    path = shared_folder(spark, "legacy")
    value = F.col("value")
    legacy = X.table(spark, sf, "events").select(
        F.col("user_id").alias("worker_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"),
        *[value.alias(c) for c in ("hr", "gsr", "hrv_rmssd")],
        (value > 50).cast("int").alias("target"),
    )
    legacy.write.option("header", True).csv(path)
    raw = router.load(spark, {"dataset": {"name": "csv", "path": path}}, X.SCHEMA)
    typed = clean.typed_projection(raw, X.SCHEMA, **clean.time_axis(raw, X.SCHEMA))
    return typed.select("worker_id", "time_idx", X.r6("ecg").alias("ecg"), "y_stress", "y_comfort_proxy")


@query(
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events
  WHERE event_id % 4 IN (1, 2))
SELECT 'S' || user_id AS worker_id, CAST(event_id AS INTEGER) AS time_idx, CAST(event_id AS DOUBLE) AS timestamp,
  CASE event_id % 4 WHEN 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS y_stress, 'default' AS task_phase
FROM t WHERE k % 3 = 0"""
)
def subject_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Subject exports through the router: labelled rows, every third kept, missing columns by default."""
    columns = [
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("worker_id"),
        F.col("event_id").alias("time_idx"),
        (F.col("event_id") % 4).alias("protocol_label"),
        *[F.col("value").alias(c) for c in X.SCHEMA.physiology],
    ]
    path = _exported(spark, sf, "subjects", columns)
    cfg = {"dataset": {"name": "subjects", "path": path, "downsample_factor": 3, "stress_include_amusement": False}}
    typed = clean.typed_projection(router.load(spark, cfg, X.SCHEMA), X.SCHEMA)
    return typed.select("worker_id", "time_idx", "timestamp", "y_stress", "task_phase")
