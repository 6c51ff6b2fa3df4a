"""Numbering, splits, gap filling, normalisation and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.catalog import fixtures as X
from signalspark.catalog import query
from signalspark.operators import clean, normalize, profiles, relate, sample, split, stats
from signalspark.layout import SeriesLayout

PHYS = X.SCHEMA.physiology


@query(
    f"WITH {X.SIG} SELECT worker_id, event_id, CAST(time_idx AS INTEGER) AS time_idx, n AS rows_of_worker FROM sig"
)
def row_numbering(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.signals(spark, sf, X.layout_of(spark, sf))
    return rows.select("worker_id", "event_id", "time_idx", F.col("_n").alias("rows_of_worker"))


@query(f"WITH {X.TIMED} SELECT worker_id, CAST(time_idx AS INTEGER) AS row_time_idx, split FROM seg")
def split_manifest_time(spark: SparkSession, sf: str) -> DataFrame:
    return split.manifest(X.timed(spark, sf, X.layout_of(spark, sf)), X.SCHEMA)


@query(f"WITH {X.HELD_OUT} SELECT worker_id, CAST(time_idx AS INTEGER) AS row_time_idx, split FROM seg")
def split_manifest_subject(spark: SparkSession, sf: str) -> DataFrame:
    """Assignment from a (worker, split) table, validated against the data first."""
    layout = X.layout_of(spark, sf)
    rows = X.signals(spark, sf, layout)
    u = F.col("user_id") % 10
    table = X.table(spark, sf, "events").select("user_id").distinct()
    assignment = table.select(
        F.col("user_id").cast("string").alias("worker_id"),
        F.when(u < 7, "train").when(u == 7, "val").otherwise("test").alias("split"),
    )
    split.check_assignment(X.raw_signals(spark, sf), X.SCHEMA, assignment)
    placed = split.by_subject(rows.drop("_pos", "_n"), X.SCHEMA, assignment, layout, ("_at", "event_id"))
    return split.manifest(placed, X.SCHEMA)


@query(
    f"""WITH {X.TIMED}, e AS (SELECT worker_id, max(time_idx) FILTER (WHERE split = 'train') AS a,
  min(time_idx) FILTER (WHERE split = 'val') AS b, max(time_idx) FILTER (WHERE split = 'val') AS c,
  min(time_idx) FILTER (WHERE split = 'test') AS d FROM seg GROUP BY worker_id)
SELECT CAST(count(*) AS BIGINT) AS violations FROM e WHERE b <= a OR d <= c"""
)
def split_chronology(spark: SparkSession, sf: str) -> DataFrame:
    found = split.out_of_order(X.timed(spark, sf, X.layout_of(spark, sf)), X.SCHEMA)
    return found.agg(F.count(F.lit(1)).alias("violations"))


@query(
    f"""WITH {X.TIMED} SELECT worker_id, CAST(count(DISTINCT split) AS BIGINT) AS splits FROM seg
GROUP BY worker_id HAVING count(DISTINCT split) > 1"""
)
def split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Workers in several splits: all of them under a time split."""
    return relate.in_several_splits(X.timed(spark, sf, X.layout_of(spark, sf)), "worker_id")


@query(
    f"""WITH {X.HELD_OUT} SELECT split, CAST(count(DISTINCT worker_id) AS BIGINT) AS subjects,
  CAST(count(*) AS BIGINT) AS rows, CAST(sum(y_stress) AS BIGINT) AS positives FROM seg GROUP BY split"""
)
def split_statistics(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.raw_signals(spark, sf)
    u = F.col("user_id") % 10
    assignment = rows.select(
        "worker_id", F.when(u < 7, "train").when(u == 7, "val").otherwise("test").alias("split")
    ).distinct()
    return split.split_statistics(split.worker_load(rows, X.SCHEMA), assignment, "worker_id")


@query(
    f"""WITH {X.HELD_OUT} SELECT split, CAST(max(CASE WHEN y_stress = 0 THEN 1 ELSE 0 END) AS INTEGER) AS has_negative,
  CAST(max(CASE WHEN y_stress = 1 THEN 1 ELSE 0 END) AS INTEGER) AS has_positive,
  CAST(sum(y_stress) AS BIGINT) AS positives FROM seg GROUP BY split
HAVING sum(y_stress) < CASE split WHEN 'val' THEN 1000000000 WHEN 'test' THEN 20 ELSE 0 END"""
)
def split_class_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Splits that fail coverage; the val minimum is out of reach on purpose, so that one is reported."""
    rows = X.raw_signals(spark, sf)
    u = F.col("user_id") % 10
    placed = rows.withColumn("split", F.when(u < 7, "train").when(u == 7, "val").otherwise("test"))
    return split.uncovered(placed, X.SCHEMA, 1_000_000_000, 20)


@query()
def balanced_holdout(spark: SparkSession, sf: str) -> DataFrame:
    load = split.worker_load(X.raw_signals(spark, sf), X.SCHEMA)
    chosen = split.balanced_holdout(load, X.SCHEMA, 0.7, 0.15, 20, 20)
    return split.split_statistics(load, chosen, "worker_id")


@query(
    f"""WITH {X.filled_sql(X.TIMED)} SELECT worker_id, CAST(time_idx AS INTEGER) AS time_idx, split,
  round(ecg, 6) + 0.0 AS ecg, round(eda, 6) + 0.0 AS eda, round(temp, 6) + 0.0 AS temp FROM filled"""
)
def fill_gaps(spark: SparkSession, sf: str) -> DataFrame:
    layout = X.layout_of(spark, sf)
    rows = normalize.fill_raw(X.timed(spark, sf, layout), X.SCHEMA, layout)
    return rows.select("worker_id", "time_idx", "split", *[X.r6(c).alias(c) for c in PHYS])


@query(
    f"""WITH {X.HELD_OUT}, t AS (SELECT {", ".join(f"coalesce(median({c}), 0.0) AS m_{c}" for c in PHYS)}
  FROM seg WHERE split = 'train')
SELECT worker_id, CAST(time_idx AS INTEGER) AS time_idx, split,
  {", ".join(f"round(coalesce({c}, m_{c}), 6) + 0.0 AS {c}" for c in PHYS)} FROM seg, t"""
)
def impute_train_medians(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.held_out(spark, sf, X.layout_of(spark, sf))
    raw = X.raw_signals(spark, sf).withColumn("split", F.when(F.col("user_id") % 10 < 7, "train").otherwise("rest"))
    filled = normalize.impute_medians(rows, normalize.train_medians(raw, PHYS))
    return filled.select("worker_id", "time_idx", "split", *[X.r6(c).alias(c) for c in PHYS])


@query(
    f"""WITH {X.scaled_sql(X.HELD_OUT)} SELECT worker_id, CAST(time_idx AS INTEGER) AS time_idx, split,
  {", ".join(f"round({c}, 6) + 0.0 AS {c}, round(mu_{c}, 6) + 0.0 AS baseline_mu_{c}, "
             f"round(sd_{c}, 6) + 0.0 AS baseline_sigma_{c}" for c in PHYS)} FROM scaled"""
)
def normalize_global(spark: SparkSession, sf: str) -> DataFrame:
    layout = X.layout_of(spark, sf)
    rows = normalize.fill_raw(X.held_out(spark, sf, layout), X.SCHEMA, layout)
    scaled = normalize.normalize(rows, X.SCHEMA, {"normalization": {"mode": "global"}}, layout)
    named = [c for s in PHYS for c in (s, f"baseline_mu_{s}", f"baseline_sigma_{s}")]
    return scaled.select("worker_id", "time_idx", "split", *[X.r6(c).alias(c) for c in named])


ALPHA, WARM = 0.1, 30


SCALE = 7


def online_sql(column: str) -> str:
    """Row-by-row recursion: the state a row sees, then its update.

    Signals are divided by 7 here, so that short decimals do not end up exactly between two rounded values.
    """
    value = f"(f.{column} / {SCALE})"
    a = f"{ALPHA}::DOUBLE"
    mean_after = f"((1 - {a}) * e.mu + {a} * e.x)"
    return f"""init_{column} AS (
  SELECT worker_id, split, avg({value}) AS mu, stddev_pop({value}) + 1e-6::DOUBLE AS sd FROM filled f
  WHERE pos < {WARM} GROUP BY worker_id, split
), ema_{column} AS (
  SELECT f.worker_id, f.split, f.pos, {value} AS x, i.mu, i.sd FROM filled f
    JOIN init_{column} i ON i.worker_id = f.worker_id AND i.split = f.split WHERE f.pos = 0
  UNION ALL
  SELECT f.worker_id, f.split, f.pos, {value}, {mean_after},
    sqrt(greatest((1 - {a}) * e.sd * e.sd + {a} * (e.x - {mean_after}) * (e.x - {mean_after}), 1e-6::DOUBLE))
  FROM ema_{column} e JOIN filled f ON f.worker_id = e.worker_id AND f.split = e.split AND f.pos = e.pos + 1
)"""


@query(
    f"""WITH RECURSIVE {X.filled_sql(X.HELD_OUT)}, {online_sql("ecg")}, {online_sql("eda")}
SELECT a.worker_id, a.split, CAST(a.pos AS INTEGER) AS time_idx,
  round((a.x - a.mu) / greatest(a.sd, 1e-6::DOUBLE), 6) + 0.0 AS ecg, round(a.mu, 6) + 0.0 AS baseline_mu_ecg,
  round(a.sd, 6) + 0.0 AS baseline_sigma_ecg,
  round((b.x - b.mu) / greatest(b.sd, 1e-6::DOUBLE), 6) + 0.0 AS eda, round(b.mu, 6) + 0.0 AS baseline_mu_eda,
  round(b.sd, 6) + 0.0 AS baseline_sigma_eda
FROM ema_ecg a JOIN ema_eda b USING (worker_id, split, pos)"""
)
def normalize_online(spark: SparkSession, sf: str) -> DataFrame:
    layout = X.layout_of(spark, sf)
    rows = normalize.fill_raw(X.held_out(spark, sf, layout), X.SCHEMA, layout)
    cfg = {"normalization": {"mode": "online", "warmup_steps": WARM}, "profile": {"ema_alpha": ALPHA}}
    scaled_down = [(F.col(c) / SCALE).alias(c) for c in PHYS]
    slim = rows.select("worker_id", "split", "time_idx", "_seg_pos", *scaled_down)
    scaled = normalize.normalize(slim, X.SCHEMA, cfg, layout)
    named = [c for s in ("ecg", "eda") for c in (s, f"baseline_mu_{s}", f"baseline_sigma_{s}")]
    return scaled.select("worker_id", "split", "time_idx", *[X.r6(c).alias(c) for c in named])


def baseline_sql(column: str, safe: str = "TRUE") -> str:
    """Exponential weights counted from the end; the first value keeps the remainder."""
    keep = f"{1 - ALPHA!r}::DOUBLE"
    weight = f"CASE WHEN i = 1 THEN pow({keep}, k - 1) ELSE {ALPHA}::DOUBLE * pow({keep}, k - i) END"
    return f"""base_{column} AS (
  SELECT worker_id, sum(w * x) AS mu_{column},
    sqrt(greatest(sum(w * x * x) - sum(w * x) * sum(w * x), 1e-6::DOUBLE)) AS sd_{column}
  FROM (SELECT worker_id, x, {weight} AS w FROM (
    SELECT worker_id, {column} AS x, row_number() OVER (PARTITION BY worker_id ORDER BY pos) AS i,
      count(*) OVER (PARTITION BY worker_id) AS k
    FROM seg WHERE split = 'train' AND {column} IS NOT NULL AND {safe}))
  GROUP BY worker_id)"""


PROFILE_SQL = f"""{", ".join(baseline_sql(c) for c in PHYS)}, prof AS (
  SELECT worker_id, min(specialization_index) AS specialization_id,
    least(greatest(min(experience_level), 1), 5) AS experience_level,
    {", ".join(f"min(mu_{c}) AS baseline_mu_{c}, min(sd_{c}) AS baseline_sigma_{c}" for c in PHYS)}
  FROM seg {" ".join(f"JOIN base_{c} USING (worker_id)" for c in PHYS)} WHERE split = 'train' GROUP BY worker_id)"""
BASELINES = [f"baseline_{s}_{c}" for c in PHYS for s in ("mu", "sigma")]


@query(
    f"""WITH {X.HELD_OUT}, {PROFILE_SQL} SELECT worker_id, specialization_id, experience_level,
  {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in BASELINES)} FROM prof"""
)
def profile_table(spark: SparkSession, sf: str) -> DataFrame:
    """Baselines straight from the raw training signals, gaps skipped."""
    layout = X.layout_of(spark, sf)
    table = profiles.profile_table(X.held_out(spark, sf, layout), X.SCHEMA, ALPHA, layout)
    return table.select(
        "worker_id", "specialization_id", "experience_level", *[X.r6(c).alias(c) for c in BASELINES]
    )


@query(
    f"""WITH {X.HELD_OUT}, safe AS (SELECT * FROM seg WHERE hazard_zone <> 0),
{baseline_sql("ecg", "hazard_zone <> 0").replace("base_ecg", "base_safe")},
{baseline_sql("ecg").replace("base_ecg", "base_all")},
any_safe AS (SELECT DISTINCT worker_id FROM safe WHERE split = 'train'),
overall AS (SELECT avg(ecg) AS mu, stddev_samp(ecg) + 1e-6::DOUBLE AS sd FROM safe WHERE split = 'train'),
chosen AS (SELECT * FROM base_safe UNION ALL SELECT * FROM base_all WHERE worker_id NOT IN (FROM any_safe))
SELECT worker_id, round(coalesce(mu_ecg, mu), 6) + 0.0 AS baseline_mu_ecg,
  round(coalesce(sd_ecg, sd), 6) + 0.0 AS baseline_sigma_ecg
FROM (SELECT DISTINCT worker_id FROM seg WHERE split = 'train') LEFT JOIN chosen USING (worker_id), overall"""
)
def profile_safe_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Baselines fitted on flagged rows; on all rows of workers that have none, and overall where no signal is left."""
    layout = X.layout_of(spark, sf)
    train = X.held_out(spark, sf, layout).where("split = 'train'")
    table = profiles.worker_baselines(train, ["ecg"], ALPHA, "worker_id", "_seg_pos", layout, "hazard_zone")
    return table.select("worker_id", *[X.r6(c).alias(c) for c in ("baseline_mu_ecg", "baseline_sigma_ecg")])


@query(
    f"""WITH {X.HELD_OUT}, {PROFILE_SQL}, g AS (SELECT {", ".join(
        f"avg({c}) AS gm_{c}, stddev_samp({c}) + 1e-6::DOUBLE AS gs_{c}" for c in PHYS)} FROM seg WHERE split = 'train')
SELECT worker_id, CAST(time_idx AS INTEGER) AS time_idx, {", ".join(
    f"round((s.{c} - coalesce(baseline_mu_{c}, gm_{c})) / coalesce(baseline_sigma_{c}, gs_{c}), 6) + 0.0 AS {c}"
    for c in PHYS)} FROM seg s LEFT JOIN prof USING (worker_id), g"""
)
def profile_zscore(spark: SparkSession, sf: str) -> DataFrame:
    """z-score by own baseline; workers outside training use the overall one."""
    layout = X.layout_of(spark, sf)
    rows = X.held_out(spark, sf, layout)
    table = profiles.profile_table(rows, X.SCHEMA, ALPHA, layout)
    overall = profiles.global_baselines(rows.where("split = 'train'"), PHYS)
    scaled = profiles.zscore(rows, table, overall, PHYS, "worker_id")
    return scaled.select("worker_id", "time_idx", *[X.r6(c).alias(c) for c in PHYS])


@query(
    f"""WITH {X.HELD_OUT}, {PROFILE_SQL} SELECT worker_id, CAST(time_idx AS INTEGER) AS time_idx,
  CAST(coalesce(p.specialization_id, s.specialization_index, 0) AS INTEGER) AS specialization_index,
  CAST(coalesce(p.experience_level, s.experience_level, 1) AS INTEGER) AS experience_level,
  {", ".join(f"round(coalesce(baseline_mu_{c}, 0.0::DOUBLE), 6) + 0.0 AS baseline_mu_{c}, "
             f"round(coalesce(baseline_sigma_{c}, 1.0::DOUBLE), 6) + 0.0 AS baseline_sigma_{c}" for c in PHYS)}
FROM seg s LEFT JOIN prof p USING (worker_id)"""
)
def attach_profiles(spark: SparkSession, sf: str) -> DataFrame:
    layout = X.layout_of(spark, sf)
    rows = X.held_out(spark, sf, layout)
    static = profiles.profile_table(rows, X.SCHEMA, ALPHA, layout).withColumnRenamed(
        "specialization_id", "specialization_index"
    )
    full = relate.attach_static(rows, static, PHYS, True)
    return full.select(
        "worker_id", "time_idx", "specialization_index", "experience_level", *[X.r6(c).alias(c) for c in BASELINES]
    )


STRIDE = 5


@query(
    f"""SELECT l_suppkey, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)
    - 1 AS i FROM lineitem) WHERE i % {STRIDE} = 0"""
)
def stride_downsample(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth line of each supplier."""
    lines = X.table(spark, sf, "lineitem").select(*LINE)
    layout = SeriesLayout.fit(lines, "l_suppkey", "l_orderkey")
    kept = sample.stride(lines, ["l_suppkey"], LINE_ORDER, STRIDE, layout)
    return kept.select("l_suppkey", "l_orderkey", "l_linenumber")


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
LINE = ["l_suppkey", *LINE_ORDER]
CAP = 100


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey,
    l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
picks AS (SELECT l_suppkey, n, unnest(range({CAP})) AS j FROM (SELECT DISTINCT l_suppkey, n FROM r)),
want AS (SELECT DISTINCT l_suppkey, CASE WHEN j = {CAP - 1} THEN n - 1
  ELSE CAST(floor(j * ((n - 1)::DOUBLE / {CAP - 1}::DOUBLE)) AS BIGINT) END AS i FROM picks)
SELECT r.l_suppkey, l_orderkey, l_linenumber FROM r LEFT JOIN want w ON w.l_suppkey = r.l_suppkey AND w.i = r.i
WHERE r.n <= {CAP} OR w.i IS NOT NULL"""
)
def even_cap(spark: SparkSession, sf: str) -> DataFrame:
    """At most 100 evenly spaced lines per supplier."""
    lines = X.table(spark, sf, "lineitem").select(*LINE)
    layout = SeriesLayout.fit(lines, "l_suppkey", "l_orderkey")
    kept = sample.cap(lines, ["l_suppkey"], LINE_ORDER, CAP, layout)
    return kept.select("l_suppkey", "l_orderkey", "l_linenumber")


@query(
    f"""WITH {X.SIG} SELECT worker_id, event_id, CAST(time_idx // 3 AS INTEGER) AS time_idx FROM sig
WHERE time_idx % 3 = 0"""
)
def restride_rows(spark: SparkSession, sf: str) -> DataFrame:
    layout = X.layout_of(spark, sf)
    kept = sample.restride(X.raw_signals(spark, sf), ["worker_id"], X.ORDER, 3, "time_idx", layout)
    return kept.select("worker_id", "event_id", "time_idx")


@query(
    f"""WITH {X.HELD_OUT} SELECT split, c AS "column", CAST(count(*) AS BIGINT) AS rows,
  CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS bad
FROM (SELECT split, unnest(['ecg', 'eda', 'temp']) AS c, unnest([ecg, eda, temp]) AS v FROM seg) GROUP BY 1, 2"""
)
def finite_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Missing or infinite cells before gap filling."""
    rows = X.held_out(spark, sf, X.layout_of(spark, sf))
    return clean.bad_numbers(rows, PHYS, "split")


def _describe(c: str, split_col: str = "split") -> str:
    return f"""SELECT {split_col} AS split, '{c}' AS "column", round(coalesce(min({c}), 0.0), 6) + 0.0 AS min,
  round(coalesce(max({c}), 0.0), 6) + 0.0 AS max, round(coalesce(avg({c}), 0.0), 6) + 0.0 AS mean,
  round(coalesce(stddev_pop({c}), 0.0), 6) + 0.0 AS std,
  round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) + 0.0 AS nan_pct,
  0.0::DOUBLE AS inf_pct FROM seg GROUP BY 1"""


@query(f"WITH {X.HELD_OUT} " + " UNION ALL ".join(_describe(c) for c in X.SCHEMA.signals))
def numeric_column_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.held_out(spark, sf, X.layout_of(spark, sf))
    table = stats.numeric_stats(rows, X.SCHEMA.signals)
    values = ["min", "max", "mean", "std", "nan_pct", "inf_pct"]
    return table.select("split", "column", *[X.r6(c).alias(c) for c in values])


def _profile_stat(c: str) -> str:
    return f"""SELECT split, '{c}' AS "column", round(avg({c}), 6) + 0.0 AS mean,
  round(stddev_samp({c}), 6) + 0.0 AS std, round(min({c}), 6) + 0.0 AS min, round(max({c}), 6) + 0.0 AS max,
  round(count(DISTINCT {c})::DOUBLE / count({c}), 6) + 0.0 AS unique_ratio,
  round(1 - count({c})::DOUBLE / count(*), 6) + 0.0 AS missing_pct FROM seg GROUP BY split"""


@query(
    f"WITH {X.HELD_OUT} "
    + " UNION ALL ".join(_profile_stat(c) for c in ("ecg", "experience_level", "specialization_index"))
)
def profile_column_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.held_out(spark, sf, X.layout_of(spark, sf))
    table = stats.profile_stats(rows, ["ecg", *stats.profile_columns(rows, X.SCHEMA)])
    values = ["mean", "std", "min", "max", "unique_ratio", "missing_pct"]
    return table.select("split", "column", *[X.r6(c).alias(c) for c in values])


@query(
    f"""WITH {X.SIG} SELECT protocol_label, CAST(count(*) AS BIGINT) AS rows,
  CAST(count(DISTINCT worker_id) AS BIGINT) AS workers, round(avg(y_stress), 6) + 0.0 AS stress_rate
FROM sig GROUP BY 1"""
)
def class_summary(spark: SparkSession, sf: str) -> DataFrame:
    table = stats.class_summary(X.raw_signals(spark, sf), X.SCHEMA)
    return table.withColumn("stress_rate", X.r6("stress_rate"))


@query(
    f"""WITH {X.SIG} SELECT worker_id, CAST(count(*) AS BIGINT) AS rows, CAST(min(time_idx) AS INTEGER) AS first_time,
  CAST(max(time_idx) AS INTEGER) AS last_time, round(avg(y_stress), 6) + 0.0 AS stress_rate FROM sig
GROUP BY 1 ORDER BY rows DESC, worker_id LIMIT 10"""
)
def worker_summary_top(spark: SparkSession, sf: str) -> DataFrame:
    """The ten workers with the most rows."""
    rows = X.signals(spark, sf, X.layout_of(spark, sf))
    table = stats.worker_summary(rows, X.SCHEMA).withColumn("stress_rate", X.r6("stress_rate"))
    return sample.top_k(table, "rows", 10, ["worker_id"])


@query(
    f"""WITH {X.SIG} SELECT CAST(count(*) AS BIGINT) AS rows, CAST(min(time_idx) AS INTEGER) AS time_idx_min,
  CAST(max(time_idx) AS INTEGER) AS time_idx_max,
  {", ".join(f"round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) + 0.0 AS missing_{c}"
             for c in PHYS)},
  CAST(count(DISTINCT worker_id) AS BIGINT) AS workers, CAST(count(DISTINCT protocol_label) AS BIGINT) AS classes
FROM sig"""
)
def table_summary(spark: SparkSession, sf: str) -> DataFrame:
    table = stats.table_summary(X.signals(spark, sf, X.layout_of(spark, sf)), X.SCHEMA)
    return table.withColumns({f"missing_{c}": X.r6(f"missing_{c}") for c in PHYS})


@query(f"WITH {X.HELD_OUT} SELECT split, y_stress, CAST(count(*) AS BIGINT) AS rows FROM seg GROUP BY 1, 2")
def split_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id") % 10
    rows = X.raw_signals(spark, sf).withColumn(
        "split", F.when(u < 7, "train").when(u == 7, "val").otherwise("test")
    )
    return stats.label_counts(rows, "y_stress", ["split"])
