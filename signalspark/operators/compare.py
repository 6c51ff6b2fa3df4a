"""Model comparison over a long metrics table (model, target, metric, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = "model string, target string, metric string, value double"


def long_metrics(metrics: DataFrame, model: str, target: str) -> DataFrame:
    """One row of metrics as (model, target, metric, value) rows."""
    names = [f.name for f in metrics.schema if f.dataType.typeName() not in ("string", "boolean")]
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]
    return metrics.select(F.lit(model).alias("model"), F.lit(target).alias("target"), F.inline(F.array(*cells)))


def results_table(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(model, target) by metric; the wanted names are given, so no pass looks for them."""
    return metrics.where(F.col("metric").isin(*names)).groupBy("model", "target").pivot("metric", names).agg(
        F.first("value")
    )


def winners(metrics: DataFrame, first: str, second: str, comfort: bool = True) -> DataFrame:
    """Better model per headline metric, and second minus first; a missing value loses.

    A defined AUROC wins ties for the first model, as does an RMSE that is not larger.
    """
    wanted = [("stress", "auroc")] + ([("comfort", "rmse")] if comfort else [])

    def value(model: str, target: str, metric: str):
        hit = (F.col("model") == model) & (F.col("target") == target) & (F.col("metric") == metric)
        return F.max(F.when(hit, F.when(~F.isnan("value"), F.col("value"))))

    cells = [value(m, t, k).alias(f"_{t}_{i}") for t, k in wanted for i, m in enumerate((first, second))]
    row = metrics.agg(*cells)

    def winner(better):
        return F.when(better, first).otherwise(second)

    a, b = F.col("_stress_0"), F.col("_stress_1")
    out = [
        winner(F.coalesce(a, F.lit(-1.0)) >= F.coalesce(b, F.lit(-1.0))).alias("stress_winner_by_auroc"),
        (b - a).alias("delta_stress_auroc"),
    ]
    if comfort:
        c, d = F.col("_comfort_0"), F.col("_comfort_1")
        far = F.lit(1e9)
        out += [
            winner(F.coalesce(c, far) <= F.coalesce(d, far)).alias("comfort_winner_by_rmse"),
            (d - c).alias("delta_comfort_rmse"),
        ]
    return row.select(*out)


def validity(metrics: DataFrame, test_windows: int, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Per model: targets counted in full, AUROC defined, positive rate within bounds."""
    stress = metrics.where(F.col("target") == "stress")
    wide = results_table(stress, ["n_samples", "auroc", "optimal_positive_rate"])
    rate = F.coalesce(F.col("optimal_positive_rate"), F.lit(0.0))
    checks = (F.col("n_samples") == test_windows) & F.col("auroc").isNotNull() & rate.between(low, high)
    return wide.select("model", F.coalesce(checks, F.lit(False)).alias("valid"))


def acceptance(balance: DataFrame, reports: DataFrame) -> DataFrame:
    """Reasons to reject a run: a model reported an error, or the test windows show one class. Empty is good."""
    errors = reports.where("error is not null").select(F.concat_ws(" failed: ", "model", "error").alias("reason"))
    classes = balance.where((F.col("split") == "test") & F.col("y_stress").isin(0.0, 1.0)).agg(
        F.countDistinct("y_stress").alias("classes")
    )
    single = classes.where("classes < 2").select(F.lit("test split has a single class").alias("reason"))
    return errors.unionByName(single)
