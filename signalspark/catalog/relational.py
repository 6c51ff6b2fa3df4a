"""The feature-table dataset and its parts, built on events (signals), orders (labels), customer (availability)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.catalog import fixtures as X
from signalspark.catalog import query
from signalspark.functions import scalar as S
from signalspark.operators import clean, compare, relate, sample
from signalspark.sources import tables

# The task columns of the availability matrix.
TASKS = (
    [f"cobot-task-{i}" for i in range(1, 6)]
    + ["hanoi_0"]
    + [f"manual-task-{i}" for i in range(1, 6)]
    + ["mat_0", "meditation_0", "n-back_0", "rest-1", "rest-2", "rest_0", "stroopeasy_0", "stroophard_0"]
    + ["vr-job-sim_0", "vr-plank_0"]
)
# Class spellings as they occur in raw files, one per event type and order priority.
CLASSES = ["Cobot Task", "manual-task-3", "VR-Job Simulator", "Rest", "N-Back"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
OPTIONS = tables.TableOptions(stress_threshold=250000.0, min_rows=3)


def _spell(source: Column, values: list[str]) -> Column:
    return S.recode(source, dict(zip(values, CLASSES, strict=True)))


def _spell_sql(source: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN '{v}' THEN '{c}'" for v, c in zip(values, CLASSES, strict=True))
    return f"CASE {source} {cases} END"


def signal_table(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    v = F.col("value")
    return X.table(spark, sf, "events").select(
        F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("ID"),
        _spell(F.col("event_type"), EVENT_TYPES).alias("Class"),
        (F.col("event_id") % 5).cast("string").alias("Repetition"),
        F.col("event_id").alias("Window"),
        F.when(F.col("event_id") % 37 == 0, F.lit(float("inf"))).otherwise(v).alias("HRV_MeanNN"),
        k.cast("double").alias("EDA_mean"),
        (v / 10).alias("EMG_RMSE"),
        (v / 100).alias("RRV_MeanBB"),
    )


def label_table(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return X.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("ID"),
        _spell(F.col("o_orderpriority"), PRIORITIES).alias("Class"),
        F.when(key % 11 == 0, F.lit("n/a")).otherwise((key % 5).cast("string")).alias("Repetition"),
        F.when(key % 13 != 0, F.col("o_totalprice")).alias("NASA"),
        F.when(key % 7 != 0, key % 6).cast("double").alias("Valence"),
        key.alias("_ingest"),
    )


def overview_table(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    marks = [F.when((c + i) % 7 != 0, "x").otherwise(" - ").alias(t) for i, t in enumerate(TASKS)]
    return X.table(spark, sf, "customer").select(c.cast("string").alias("ID"), *marks)


def _class_sql(text: str) -> str:
    label = f"replace(lower(trim({text})), 'vr-job simulator', 'vr-job-sim')"
    for pattern, new in ((r"\s+", "-"), ("-{2,}", "-"), (r"-(\d+)$", "")):
        label = f"regexp_replace({label}, '{pattern}', '{new}', 'g')"
    return label


AVAILABLE = " UNION ALL ".join(
    f"SELECT CAST(c_custkey AS VARCHAR) AS ID, '{t}' AS task_key FROM customer WHERE (c_custkey + {i}) % 7 <> 0"
    for i, t in enumerate(TASKS)
)
ORDER_SQL = "CASE task_key " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TASKS)) + " ELSE 10000 END"
JOINED = f"""bio AS (
  SELECT CAST(user_id AS VARCHAR) AS ID, {_class_sql(_spell_sql("event_type", EVENT_TYPES))} AS class_norm,
    CAST(event_id % 5 + 1 AS INTEGER) AS rep_norm, event_id, CASE WHEN event_id % 37 <> 0 THEN value END AS ecg,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS eda, value / 10 AS temp, value / 100 AS resp FROM events
), lab AS (
  SELECT * FROM (
    SELECT CAST(o_custkey AS VARCHAR) AS ID, {_class_sql(_spell_sql("o_orderpriority", PRIORITIES))} AS class_norm,
      CAST(CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 5 END + 1 AS INTEGER) AS rep_norm, o_orderkey,
      CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS nasa,
      CAST(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 6 END AS DOUBLE) AS valence FROM orders)
  QUALIFY row_number() OVER (PARTITION BY ID, class_norm, rep_norm ORDER BY o_orderkey DESC) = 1
), av AS ({AVAILABLE}), merged AS (
  SELECT * FROM (
    SELECT b.*, nasa, valence, CASE WHEN b.class_norm IN ('cobot-task', 'manual-task')
      THEN b.class_norm || '-' || b.rep_norm ELSE b.class_norm || '_0' END AS task_key
    FROM bio b JOIN lab USING (ID, class_norm, rep_norm)) SEMI JOIN av USING (ID, task_key)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY ID ORDER BY {ORDER_SQL}, rep_norm, event_id) - 1 AS time_idx,
    dense_rank() OVER (ORDER BY class_norm) - 1 AS code FROM merged
)"""


@query(
    f"""WITH {JOINED} SELECT ID AS worker_id, CAST(time_idx AS INTEGER) AS time_idx, class_norm AS protocol_label,
  CASE WHEN coalesce(nasa, 0) >= 250000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_stress,
  CASE WHEN valence IS NULL THEN 0.5::DOUBLE
    ELSE least(greatest((valence - 1) / 4, 0.0::DOUBLE), 1.0::DOUBLE) END AS y_comfort_proxy,
  round(ecg, 6) + 0.0 AS ecg, round(eda, 6) + 0.0 AS eda, round(temp, 6) + 0.0 AS temp,
  round(resp, 6) + 0.0 AS resp, CASE WHEN class_norm IN ('cobot-task', 'manual-task') THEN 1 ELSE 0 END AS hazard_zone,
  CAST(code AS INTEGER) AS specialization_index
FROM placed WHERE ecg IS NOT NULL AND eda IS NOT NULL AND temp IS NOT NULL
QUALIFY count(*) OVER (PARTITION BY ID) >= 3"""
)
def feature_table_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Three-table join: labels with last-wins duplicates, availability, ordering, codes, labels, row minimum."""
    signals, labels, overview = signal_table(spark, sf), label_table(spark, sf), overview_table(spark, sf)
    frame = tables.feature_dataset(signals, labels, overview, X.SCHEMA, OPTIONS)
    return frame.select(
        "worker_id",
        "time_idx",
        "protocol_label",
        "y_stress",
        "y_comfort_proxy",
        *[X.r6(c).alias(c) for c in ("ecg", "eda", "temp", "resp")],
        "hazard_zone",
        "specialization_index",
    )


@query(f"""WITH {JOINED} SELECT class_norm AS protocol_label, CAST(count(*) AS BIGINT) AS rows,
  CAST(count(DISTINCT ID) AS BIGINT) AS workers FROM placed WHERE ecg IS NOT NULL GROUP BY 1""")
def feature_table_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and participants per class after the joins."""
    joined = tables.joined_rows(
        signal_table(spark, sf), label_table(spark, sf), overview_table(spark, sf), OPTIONS, "_ingest"
    )
    known = joined.where(S.finite(F.col("HRV_MeanNN")).isNotNull())
    pairs = known.groupBy("class_norm", "ID").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(F.col("class_norm").alias("protocol_label")).agg(
        F.sum("n").alias("rows"), F.count("ID").alias("workers")
    )


@query(f"SELECT ID, task_key FROM ({AVAILABLE})")
def availability_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return relate.availability(overview_table(spark, sf))


@query(
    f"""SELECT DISTINCT {_class_sql(_spell_sql("event_type", EVENT_TYPES))} AS class_norm,
  CAST(event_id % 5 + 1 AS INTEGER) AS rep_norm,
  CASE WHEN event_type IN ('click', 'error') THEN {_class_sql(_spell_sql("event_type", EVENT_TYPES))}
    || '-' || (event_id % 5 + 1) ELSE {_class_sql(_spell_sql("event_type", EVENT_TYPES))} || '_0' END AS task_key
FROM events"""
)
def task_keys(spark: SparkSession, sf: str) -> DataFrame:
    label, rep = S.class_label(F.col("Class")), S.shifted_repetition(F.col("Repetition"), 1, text=True)
    rows = signal_table(spark, sf).select(label.alias("class_norm"), rep.alias("rep_norm"))
    return rows.withColumn("task_key", S.task_key(F.col("class_norm"), F.col("rep_norm"))).distinct()


@query(
    """SELECT o_custkey, o_orderpriority, o_orderkey, round(o_totalprice, 6) + 0.0 AS o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) = 1"""
)
def keep_last_duplicate(spark: SparkSession, sf: str) -> DataFrame:
    orders = X.table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    last = relate.keep_last(orders, ["o_custkey", "o_orderpriority"], "o_orderkey")
    return last.withColumn("o_totalprice", X.r6("o_totalprice"))


@query(
    """SELECT l_returnflag AS flag, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS code,
  CAST(count(*) AS BIGINT) AS rows FROM lineitem GROUP BY l_returnflag"""
)
def category_codes(spark: SparkSession, sf: str) -> DataFrame:
    lines = X.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"))
    codes = clean.label_codes(lines, "flag")
    coded = clean.category_codes(lines, "flag", "code", codes)
    return coded.groupBy("flag", "code").agg(F.count(F.lit(1)).alias("rows"))


@query(
    """SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, l_orderkey, l_linenumber FROM lineitem
QUALIFY count(*) OVER (PARTITION BY l_suppkey) >= 600"""
)
def min_rows_per_group(spark: SparkSession, sf: str) -> DataFrame:
    lines = X.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return clean.min_rows_per_worker(lines, "l_suppkey", 600)


@query(
    """SELECT l_orderkey, l_linenumber, c AS measure, round(v, 6) + 0.0 AS value FROM (
  SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS c,
    unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem)"""
)
def unpivot_measures(spark: SparkSession, sf: str) -> DataFrame:
    lines = X.table(spark, sf, "lineitem")
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    long = lines.unpivot(["l_orderkey", "l_linenumber"], measures, "measure", "value")
    return long.withColumn("value", X.r6("value"))


@query(
    """SELECT o_orderkey, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"""
)
def allow_list_join(spark: SparkSession, sf: str) -> DataFrame:
    """Class filter written above the join; the optimiser moves it into the customer scan."""
    orders = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customer = X.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    kept = clean.allow(joined, "c_mktsegment", ["MACHINERY", "BUILDING"])
    return kept.select("o_orderkey", "c_custkey")


@query("SELECT CAST(user_id AS VARCHAR) AS worker FROM events EXCEPT SELECT CAST(o_custkey AS VARCHAR) FROM orders")
def missing_subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Requested ids that the data lacks."""
    asked = X.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("worker"))
    data = X.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("worker"))
    return relate.absent(asked, data, "worker")


@query(
    f"""WITH {X.HELD_OUT} SELECT DISTINCT worker_id FROM seg WHERE split <> 'train'
EXCEPT SELECT worker_id FROM seg WHERE split = 'train'"""
)
def unseen_workers(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id") % 10
    rows = X.raw_signals(spark, sf)
    train, val, test = rows.where(u < 7), rows.where(u == 7), rows.where(u > 7)
    return relate.unseen(train, [val, test], "worker_id")


@query(
    """SELECT 'order' AS kind, o_orderkey AS key, round(o_totalprice, 6) + 0.0 AS amount, NULL::VARCHAR AS segment
FROM orders UNION ALL
SELECT 'customer', c_custkey, round(c_acctbal, 6) + 0.0, c_mktsegment FROM customer"""
)
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Union of frames that share only part of their columns."""
    orders = X.table(spark, sf, "orders").select(
        F.lit("order").alias("kind"), F.col("o_orderkey").alias("key"), X.r6("o_totalprice").alias("amount")
    )
    customer = X.table(spark, sf, "customer").select(
        X.r6("c_acctbal").alias("amount"),
        F.lit("customer").alias("kind"),
        F.col("c_custkey").alias("key"),
        F.col("c_mktsegment").alias("segment"),
    )
    return relate.union_all(orders, customer)


@query("SELECT o_orderkey, round(o_totalprice, 6) + 0.0 AS o_totalprice FROM orders "
       "ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 15")
def top_orders(spark: SparkSession, sf: str) -> DataFrame:
    top = sample.top_k(X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 15,
                       ["o_orderkey"])
    return top.withColumn("o_totalprice", X.r6("o_totalprice"))


@query(
    f"""WITH {X.SIG}, g AS (SELECT DISTINCT worker_id FROM sig ORDER BY worker_id LIMIT 3)
SELECT worker_id, event_id, CAST(r AS INTEGER) AS rank FROM (
  SELECT worker_id, event_id, row_number() OVER (PARTITION BY worker_id ORDER BY event_id) AS r
  FROM sig SEMI JOIN g USING (worker_id)) WHERE r <= 100"""
)
def overlay_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred rows of the first three workers."""
    rows = X.raw_signals(spark, sf).select("worker_id", "event_id")
    return sample.first_rows(rows, "worker_id", "event_id", 3, 100)


@query(
    f"""WITH {X.SIG}, own AS (SELECT worker_id, avg(ecg) AS mu FROM sig WHERE user_id % 10 < 7 GROUP BY 1),
g AS (SELECT avg(ecg) AS mu FROM sig WHERE user_id % 10 < 7)
SELECT event_id, round(coalesce(own.mu, g.mu), 6) + 0.0 AS mu FROM sig LEFT JOIN own USING (worker_id), g"""
)
def baseline_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Per-worker mean with the overall one for workers outside training."""
    rows = X.raw_signals(spark, sf).select("worker_id", "user_id", "event_id", "ecg")
    train = rows.where(F.col("user_id") % 10 < 7)
    own = train.groupBy("worker_id").agg(F.avg("ecg").alias("mu"))
    overall = train.agg(F.avg("ecg").alias("mu"))
    joined = relate.baselines_or_global(rows, own, overall, ["mu"], "worker_id")
    return joined.select("event_id", X.r6("mu").alias("mu"))


@query(
    """SELECT model, round(max(value) FILTER (WHERE metric = 'auroc'), 6) + 0.0 AS auroc,
  round(max(value) FILTER (WHERE metric = 'rmse'), 6) + 0.0 AS rmse FROM (
    SELECT l_returnflag AS model, 'auroc' AS metric, avg(l_discount) AS value FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 'rmse', stddev_pop(l_quantity) FROM lineitem GROUP BY 1) GROUP BY model"""
)
def results_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Long metrics to one row per model."""
    lines = X.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model"))
    wide = lines.agg(F.avg("l_discount").alias("auroc"), F.stddev_pop("l_quantity").alias("rmse"))
    long = wide.withColumn("target", F.lit("stress")).unpivot(
        ["model", "target"], ["auroc", "rmse"], "metric", "value"
    )
    table = compare.results_table(long, ["auroc", "rmse"])
    return table.select("model", X.r6("auroc").alias("auroc"), X.r6("rmse").alias("rmse"))
