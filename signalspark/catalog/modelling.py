"""Model training and scoring. Rows only: no SQL trains a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark import sinks
from signalspark.catalog import fixtures as X
from signalspark.catalog import query
from signalspark.catalog.evaluation import SCORED, scored
from signalspark.catalog.windowed import HZ, STEP, H, L, cutter, prepared
from signalspark.operators import features, models, normalize, profiles, sequences
from signalspark.plans import experiment
from signalspark.session import materialize, shared_folder

PARAMS = {"max_depth": 3, "n_estimators": 5, "learning_rate": 0.2, "calibration": "isotonic"}
CFG = {"xgboost": PARAMS, "tft": {"hidden_size": 8, "max_iter": 10}}


def training_table(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Window features, written once, with training medians in the gaps."""
    layout = X.layout_of(spark, sf)
    table = features.feature_table(prepared(spark, sf, layout), cutter(layout), HZ, frequency=False)
    table = materialize(table, "features")
    names = features.feature_names(table)
    return normalize.impute_medians(table, normalize.train_medians(table, names)), names


def _scores(df: DataFrame, fitted: models.Fitted) -> DataFrame:
    return fitted.score(df).select("worker_id", "split", "start_idx", "p")


@query()
def boosted_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Stress probability per window, isotonically calibrated on validation windows."""
    table, names = training_table(spark, sf)
    return _scores(table, models.fit_boosted(table, names, "y_stress", "classification", PARAMS))


@query()
def boosted_classifier_platt(spark: SparkSession, sf: str) -> DataFrame:
    table, names = training_table(spark, sf)
    params = {**PARAMS, "calibration": "platt"}
    return _scores(table, models.fit_boosted(table, names, "y_stress", "classification", params))


@query()
def boosted_regressor(spark: SparkSession, sf: str) -> DataFrame:
    table, names = training_table(spark, sf)
    return _scores(table, models.fit_boosted(table, names, "y_comfort", "regression", PARAMS))


@query(
    f"""WITH {X.HELD_OUT}, {X.windows_sql("seg", L, H, STEP)}
SELECT worker_id, split, CAST(start_idx AS INTEGER) AS start_idx, 0.0::DOUBLE AS isotonic, 0.0::DOUBLE AS platt,
  0.0::DOUBLE AS regressor FROM win"""
)
def reloaded_models(spark: SparkSession, sf: str) -> DataFrame:
    """How far the scores of written and reloaded models are from the fresh ones, for every window."""
    table, names = training_table(spark, sf)
    kinds = {"isotonic": ("y_stress", "classification"), "platt": ("y_stress", "classification")}
    kinds["regressor"] = ("y_comfort", "regression")
    out = table.select("worker_id", "split", "start_idx", *names)
    for kind, (label, task) in kinds.items():
        fitted = models.fit_boosted(table, names, label, task, {**PARAMS, "calibration": kind})
        path = shared_folder(spark, f"model-{kind}")
        sinks.write_model(fitted, spark, path)
        fresh = fitted.score(out).withColumnRenamed("p", "_fresh")
        again = sinks.read_model(spark, path).score(fresh)
        out = again.withColumn(kind, F.abs(F.col("p") - F.col("_fresh"))).drop("p", "_fresh")
    return out.select("worker_id", "split", "start_idx", *kinds)


@query()
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    table, names = training_table(spark, sf)
    return models.importance_table(spark, models.fit_boosted(table, names, "y_stress", "classification", PARAMS), 5)


@query(f"WITH {X.SIG} SELECT event_id, 1.0::DOUBLE AS p FROM sig")
def constant_model(spark: SparkSession, sf: str) -> DataFrame:
    """A training set with one class gives that class as a constant."""
    rows = X.raw_signals(spark, sf).withColumns({"split": F.lit("train"), "y": F.lit(1.0)})
    fitted = models.fit_boosted(rows, ["eda", "temp"], "y", "classification", PARAMS)
    return fitted.score(rows).select("event_id", "p")


# Isotonic regression as pooled blocks: its value at a score is the greatest, over starts at or below it, of
# the least mean up to any end at or above it.
@query(
    f"""WITH {X.SIG}, g AS (SELECT floor(value / 25) AS b, sum(y_stress) AS s, count(*) AS n FROM sig GROUP BY 1),
blocks AS (SELECT a.b AS lo, c.b AS hi, sum(g.s) / sum(g.n) AS m FROM g a JOIN g c ON c.b >= a.b
  JOIN g ON g.b BETWEEN a.b AND c.b GROUP BY 1, 2),
low AS (SELECT g.b, lo, min(m) AS m FROM g JOIN blocks ON lo <= g.b AND hi >= g.b GROUP BY 1, 2)
SELECT CAST(b AS DOUBLE) AS score, round(max(m), 6) + 0.0 AS p FROM low GROUP BY b"""
)
def isotonic_calibration(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.raw_signals(spark, sf).select(
        F.floor(F.col("value") / 25).cast("double").alias("p_raw"), F.col("y_stress").alias("y")
    )
    model = models.fit_calibrator(rows, "isotonic")
    out = model.transform(rows.select("p_raw").distinct())
    return out.select(F.col("p_raw").alias("score"), X.r6("p_calibrated").alias("p"))


# Newton steps for the intercept a and the slope b; the slope is held back by one row's weight.
PLATT_SQL = f"""WITH RECURSIVE {SCORED}, d AS (
  SELECT p, y, count(*)::DOUBLE AS w FROM scored GROUP BY p, y
), t AS (SELECT sum(w) AS n FROM d), newton(i, a, b) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT i + 1, a - (bb * ga - ab * gb) / (aa * bb - ab * ab), b - (aa * gb - ab * ga) / (aa * bb - ab * ab) FROM (
    SELECT i, a, b, sum(w * (m - y)) / n AS ga, (sum(w * (m - y) * p) + b) / n AS gb, sum(w * m * (1 - m)) / n AS aa,
      sum(w * m * (1 - m) * p) / n AS ab, (sum(w * m * (1 - m) * p * p) + 1) / n AS bb
    FROM (SELECT i, a, b, p, y, w, n, 1 / (1 + exp(-(a + b * p))) AS m FROM newton, d, t WHERE i < 40)
    GROUP BY i, a, b, n)
)
SELECT DISTINCT round(p, 6) + 0.0 AS p_raw, round(1 / (1 + exp(-(a + b * p))), 4) + 0.0 AS p
FROM newton, d WHERE i = 40"""


@query(PLATT_SQL)
def platt_calibration(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).select(F.col("p").alias("p_raw"), "y")
    fitted = models.Fitted(["p_raw"], None, constant=0.0, calibrator=models.fit_calibrator(rows, "platt"), platt=True)
    grid = rows.select("p_raw").distinct()
    vector = grid.withColumn("_score", models.array_to_vector(F.array("p_raw")))
    out = fitted.calibrator.transform(vector)
    calibrated = F.round(models.vector_to_array("probability")[1], 4) + F.lit(0.0)
    return out.select(X.r6("p_raw").alias("p_raw"), calibrated.alias("p"))


@query()
def sequence_forecaster(spark: SparkSession, sf: str) -> DataFrame:
    """The second model's probability per window."""
    layout = X.layout_of(spark, sf)
    rows = sequences.reindex(prepared(spark, sf, layout), X.SCHEMA, 1)
    examples = sequences.sequence_set(rows, cutter(layout), "y_stress", use_profiles=False)
    examples = materialize(examples, "sequences")
    fitted = models.fit_sequence_model(examples, "classification", CFG["tft"])
    return models.score_sequences(fitted, examples, "classification").select("worker_id", "split", "start_idx", "p")


@query()
def two_target_run(spark: SparkSession, sf: str) -> DataFrame:
    """Both targets trained, thresholded and measured: a long metrics table."""
    table, _ = training_table(spark, sf)
    return experiment.run_trees(table, None, X.SCHEMA, CFG)[0]


@query()
def profile_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """The same run with and without profile columns."""
    layout = X.layout_of(spark, sf)
    table, _ = training_table(spark, sf)
    static = profiles.profile_table(X.held_out(spark, sf, layout), X.SCHEMA, 0.1, layout)
    static = materialize(static, "profiles")
    on = experiment.run_trees(table, static, X.SCHEMA, CFG, "profiles_on")[0]
    off = experiment.run_trees(table, None, X.SCHEMA, CFG, "profiles_off")[0]
    return on.unionByName(off).where(F.col("metric").isin("auroc", "rmse"))
