"""Metrics, thresholds and curves on deterministic scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.catalog import fixtures as X
from signalspark.catalog import query
from signalspark.operators import compare, evaluate

SCORED = f"""{X.SIG}, sc AS (SELECT event_id, user_id, y_stress AS y,
  1.0::DOUBLE / (1.0::DOUBLE + exp(-(floor(value) - 50) / 50)) AS p0 FROM sig),
scored AS (SELECT *, least(greatest(p0, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p FROM sc)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a score that rises with the whole part of the value, so there are ties."""
    z = (F.floor("value") - 50) / 50
    return X.raw_signals(spark, sf).select(
        "event_id", "user_id", F.col("y_stress").alias("y"), (1.0 / (1.0 + F.exp(-z))).alias("p")
    )


LABELLED = """scored AS (SELECT l.doc_id, CAST(l.quality AS DOUBLE) AS y,
  least(greatest(n_chars / (n_chars + 2000.0::DOUBLE), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p
  FROM labels l JOIN documents d USING (doc_id))"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Document quality against a score from document length."""
    labels = X.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("y"))
    documents = X.table(spark, sf, "documents").select("doc_id", "n_chars")
    n = F.col("n_chars")
    return labels.join(documents, "doc_id").select("doc_id", "y", (n / (n + 2000.0)).alias("p"))


EDGES = [float(e) for e in np.linspace(0.0, 1.0, 16)[1:]]
BIN = " + ".join(f"CAST(p >= {e!r}::DOUBLE AS INTEGER)" for e in EDGES)
ROUNDED = ["auroc", "auprc", "accuracy", "precision", "recall", "f1", "brier", "ece", "default_positive_rate",
           "optimal_positive_rate", "prevalence", "prob_min", "prob_max", "prob_mean", "prob_std"]
COUNTS = ["tn_default", "fp_default", "fn_default", "tp_default", "tn_optimal", "fp_optimal", "fn_optimal",
          "tp_optimal", "n_samples", "n_pos", "n_neg"]


def metrics_sql(source: str, cut: float) -> str:
    def cell(y: int, test: str) -> str:
        return f"CAST(count(*) FILTER (WHERE y = {y} AND {test}) AS BIGINT)"

    return f"""WITH {source}, r AS (
  SELECT y, p, (rank() OVER (ORDER BY p) + rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE
    AS mid FROM scored
), g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY p), c AS (
  SELECT p, pos, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(n) OVER (ORDER BY p DESC) AS cn FROM g
), e AS (
  SELECT sum(abs(a)) AS gaps FROM (SELECT {BIN} AS b, sum(y) - sum(p) AS a FROM scored GROUP BY 1) WHERE b < 15
), u AS (
  SELECT (SELECT (sum(mid) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1)
      / 2.0::DOUBLE) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y <> 1)) FROM r) AS auroc,
    (SELECT sum(pos * cp / cn) / sum(pos) FROM c) AS auprc, (SELECT gaps FROM e) AS gaps
), s AS (SELECT {cell(0, "p < 0.5")} AS tn_default, {cell(0, "p >= 0.5")} AS fp_default,
  {cell(1, "p < 0.5")} AS fn_default, {cell(1, "p >= 0.5")} AS tp_default,
  {cell(0, f"p < {cut}::DOUBLE")} AS tn_optimal, {cell(0, f"p >= {cut}::DOUBLE")} AS fp_optimal,
  {cell(1, f"p < {cut}::DOUBLE")} AS fn_optimal, {cell(1, f"p >= {cut}::DOUBLE")} AS tp_optimal,
  CAST(count(*) AS BIGINT) AS n_samples, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg,
  avg((p - y) * (p - y)) AS brier, min(p) AS prob_min, max(p) AS prob_max, avg(p) AS prob_mean,
  stddev_pop(p) AS prob_std FROM scored
), m AS (SELECT s.*, auroc, auprc, gaps / n_samples AS ece, (tp_optimal + tn_optimal)::DOUBLE / n_samples AS accuracy,
  tp_optimal::DOUBLE / (tp_optimal + fp_optimal) AS precision, tp_optimal::DOUBLE / n_pos AS recall,
  2.0::DOUBLE * tp_optimal / (2 * tp_optimal + fp_optimal + fn_optimal) AS f1,
  (tp_default + fp_default)::DOUBLE / n_samples AS default_positive_rate,
  (tp_optimal + fp_optimal)::DOUBLE / n_samples AS optimal_positive_rate, n_pos::DOUBLE / n_samples AS prevalence
  FROM s, u)
SELECT {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ROUNDED)}, {", ".join(COUNTS)} FROM m"""


def metrics_row(rows: DataFrame, cut: float) -> DataFrame:
    table = evaluate.classification_metrics(rows, cut)
    return table.select(*[X.r6(c).alias(c) for c in ROUNDED], *COUNTS)


@query(metrics_sql(SCORED, 0.6))
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics_row(scored(spark, sf), 0.6)


@query(metrics_sql(LABELLED, 0.3))
def classification_metrics_labels(spark: SparkSession, sf: str) -> DataFrame:
    return metrics_row(labelled(spark, sf), 0.3)


@query(
    f"""WITH {X.SIG}, m AS (SELECT avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
  1 - sum((y - p) * (y - p)) / sum((y - my) * (y - my)) AS r2, corr(y, p) AS correlation FROM (
    SELECT y_comfort_proxy AS y, eda / 100 AS p, avg(y_comfort_proxy) OVER () AS my FROM sig))
SELECT round(mae, 6) + 0.0 AS mae, round(rmse, 6) + 0.0 AS rmse, round(r2, 6) + 0.0 AS r2,
  round(correlation, 6) + 0.0 AS correlation FROM m"""
)
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.raw_signals(spark, sf).select(F.col("y_comfort_proxy").alias("y"), (F.col("eda") / 100).alias("p"))
    table = evaluate.regression_metrics(rows)
    return table.select(*[X.r6(c).alias(c) for c in table.columns])


def threshold_sql(policy: str, source: str = SCORED) -> str:
    """Every candidate is judged against every row."""
    grid = ", ".join(f"{float(q)!r}::DOUBLE" for q in np.linspace(0.001, 0.999, 200))
    rule = {
        "f1": ("TRUE", "f1 DESC, prec DESC, rec DESC"),
        "recall_at_precision": ("prec >= 0.7", "rec DESC, prec DESC, -abs(t - 0.5) DESC"),
        "precision_at_recall": ("rec >= 0.7", "prec DESC, rec DESC, -abs(t - 0.5) DESC"),
    }[policy]
    return f"""WITH {source}, val AS (SELECT y, p FROM scored), cand AS (
  SELECT DISTINCT least(greatest(t, 0.0::DOUBLE), 1.0::DOUBLE) AS t FROM (
    SELECT unnest([{grid}]) AS t UNION ALL SELECT unnest(quantile_cont(p, [{grid}])) FROM val)
), g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM val GROUP BY p), hit AS (
  SELECT t, coalesce(sum(pos), 0) AS tp, coalesce(sum(n), 0) AS k FROM cand LEFT JOIN g ON p >= t GROUP BY t
), m AS (SELECT t, k::DOUBLE / (SELECT count(*) FROM val) AS rate, tp::DOUBLE / (SELECT sum(y) FROM val) AS rec,
  CASE WHEN k > 0 THEN tp::DOUBLE / k ELSE 0 END AS prec, 2.0::DOUBLE * tp / (k + (SELECT sum(y) FROM val)) AS f1
  FROM hit)
SELECT '{policy}' AS policy, round(t, 6) + 0.0 AS threshold, round(rate, 6) + 0.0 AS val_positive_rate,
  round(f1, 6) + 0.0 AS f1, round(prec, 6) + 0.0 AS precision, round(rec, 6) + 0.0 AS recall
FROM m WHERE rate BETWEEN 0.02 AND 0.98 AND {rule[0]} ORDER BY {rule[1]}, t LIMIT 1"""


def threshold_row(rows: DataFrame, policy: str) -> DataFrame:
    row = evaluate.select_threshold(rows, policy)
    return row.select(
        "policy",
        X.r6("threshold").alias("threshold"),
        X.r6("val_positive_rate").alias("val_positive_rate"),
        X.r6("val_f1_at_threshold").alias("f1"),
        X.r6("val_precision_at_threshold").alias("precision"),
        X.r6("val_recall_at_threshold").alias("recall"),
    )


@query(threshold_sql("f1"))
def threshold_f1(spark: SparkSession, sf: str) -> DataFrame:
    return threshold_row(scored(spark, sf), "f1")


@query(threshold_sql("recall_at_precision"))
def threshold_recall_at_precision(spark: SparkSession, sf: str) -> DataFrame:
    return threshold_row(scored(spark, sf), "recall_at_precision")


@query(threshold_sql("precision_at_recall", LABELLED))
def threshold_precision_at_recall(spark: SparkSession, sf: str) -> DataFrame:
    return threshold_row(labelled(spark, sf), "precision_at_recall")


GROUPED = f"""WITH {SCORED}, g AS (SELECT p0 AS p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY 1), c AS (
  SELECT p, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cn,
    sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g)"""


@query(
    f"""{GROUPED} SELECT round(p, 6) + 0.0 AS threshold, round(cn / nn, 6) + 0.0 AS fpr, round(cp / np, 6) + 0.0 AS tpr
FROM c UNION ALL SELECT NULL, 0.0, 0.0"""
)
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    points = evaluate.roc_points(scored(spark, sf))
    return points.select(*[X.r6(c).alias(c) for c in points.columns])


@query(
    f"""{GROUPED} SELECT round(p, 6) + 0.0 AS threshold, round(cp / (cp + cn), 6) + 0.0 AS precision,
  round(cp / np, 6) + 0.0 AS recall FROM c UNION ALL SELECT NULL, 1.0, 0.0"""
)
def pr_points(spark: SparkSession, sf: str) -> DataFrame:
    points = evaluate.pr_points(scored(spark, sf))
    return points.select(*[X.r6(c).alias(c) for c in points.columns])


BIN10 = " + ".join(f"CAST(p0 >= {float(e)!r}::DOUBLE AS INTEGER)" for e in np.linspace(0.0, 1.0, 11)[1:])


@query(
    f"""WITH {SCORED} SELECT CAST({BIN10} AS INTEGER) AS bin, round(avg(y), 6) + 0.0 AS accuracy,
  CAST(count(*) AS BIGINT) AS rows, round(({BIN10} + 0.5) / 10, 6) + 0.0 AS centre FROM scored GROUP BY ({BIN10})"""
)
def calibration_points(spark: SparkSession, sf: str) -> DataFrame:
    points = evaluate.calibration_points(scored(spark, sf))
    return points.select("bin", X.r6("accuracy").alias("accuracy"), "rows", X.r6("centre").alias("centre"))


@query(
    f"""WITH {SCORED} SELECT round(avg(CASE WHEN p0 >= 0.6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
    FILTER (WHERE user_id % 10 = 7), 6) + 0.0 AS val_positive_rate_at_threshold,
  round(avg(p0) FILTER (WHERE user_id % 10 = 7), 6) + 0.0 AS val_prob_mean,
  CAST(count(*) FILTER (WHERE user_id % 10 > 7 AND p0 >= 0.5) AS BIGINT) AS test_positive_count_default,
  CAST(count(*) FILTER (WHERE user_id % 10 > 7 AND p0 >= 0.6) AS BIGINT) AS test_positive_count_optimal,
  CAST(count(*) FILTER (WHERE user_id % 10 > 7) AS BIGINT) AS n_predictions FROM scored"""
)
def run_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf)
    u = F.col("user_id") % 10
    table = evaluate.run_diagnostics(rows.where(u == 7), rows.where(u > 7), 0.6)
    return table.select(
        X.r6("val_positive_rate_at_threshold").alias("val_positive_rate_at_threshold"),
        X.r6("val_prob_mean").alias("val_prob_mean"),
        "test_positive_count_default",
        "test_positive_count_optimal",
        "n_predictions",
    )


def _auroc_sql(score: str) -> str:
    return f"""(SELECT (sum(mid) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1)
      * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::DOUBLE)
      / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y <> 1)) FROM (
    SELECT y_stress AS y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE
      AS mid FROM sig))"""


@query(
    f"""WITH {X.SIG}, m AS (SELECT {_auroc_sql("round(value, 0)")} AS a, {_auroc_sql("eda")} AS b,
  sqrt(avg((y_comfort_proxy - 0.9) * (y_comfort_proxy - 0.9))) AS c,
  sqrt(avg((y_comfort_proxy - eda / 100) * (y_comfort_proxy - eda / 100))) AS d FROM sig)
SELECT CASE WHEN a >= b THEN 'trees' ELSE 'sequence' END AS stress_winner_by_auroc,
  round(b - a, 6) + 0.0 AS delta_stress_auroc,
  CASE WHEN c <= d THEN 'trees' ELSE 'sequence' END AS comfort_winner_by_rmse,
  round(d - c, 6) + 0.0 AS delta_comfort_rmse FROM m"""
)
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Two scorings of the same rows, compared on AUROC and RMSE."""
    rows = X.raw_signals(spark, sf)
    y, c = F.col("y_stress").alias("y"), F.col("y_comfort_proxy").alias("y")
    parts = [
        ("trees", "stress", evaluate.classification_metrics(rows.select(y, (F.round("value") / 1000).alias("p")))),
        ("sequence", "stress", evaluate.classification_metrics(rows.select(y, (F.col("eda") / 200).alias("p")))),
        ("trees", "comfort", evaluate.regression_metrics(rows.select(c, F.lit(0.9).alias("p")))),
        ("sequence", "comfort", evaluate.regression_metrics(rows.select(c, (F.col("eda") / 100).alias("p")))),
    ]
    long = None
    for model, target, table in parts:
        piece = compare.long_metrics(table, model, target)
        long = piece if long is None else long.unionByName(piece)
    best = compare.winners(long, "trees", "sequence")
    return best.withColumns({d: X.r6(d) for d in ("delta_stress_auroc", "delta_comfort_rmse")})


@query(
    f"""WITH {SCORED} SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model,
  avg(CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) BETWEEN 0.02 AND 0.98
    AND count(*) = (SELECT count(*) FROM scored WHERE user_id % 2 = 0) AS valid FROM scored GROUP BY 1"""
)
def validity_checks(spark: SparkSession, sf: str) -> DataFrame:
    """One model is measured on the full target count, the other is not."""
    rows = scored(spark, sf)
    parity = F.col("user_id") % 2
    even, odd = (evaluate.classification_metrics(rows.where(parity == k)) for k in (0, 1))
    long = compare.long_metrics(even, "even", "stress").unionByName(compare.long_metrics(odd, "odd", "stress"))
    return compare.validity(long, rows.where(parity == 0).count())
