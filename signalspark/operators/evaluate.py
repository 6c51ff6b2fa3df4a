"""Threshold choice, metrics and curve points of scored rows (label ``y``, score ``p``).

Everything ranks *distinct scores*: rows are first collapsed to (score, positives, negatives) with map-side
sums, and only that table is put in order, in pieces when it is long.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalspark.functions import scalar as S
from signalspark.layout import add_piece, running_totals
from signalspark.session import materialize

EDGE = 1e-6
CANDIDATES = 200
CALIBRATION_BINS = 15


def clipped(p: Column) -> Column:
    return S.clip(p, EDGE, 1 - EDGE)


def by_score(scored: DataFrame, clip: bool = True) -> DataFrame:
    """(p, pos, neg): how many rows of either class share each score."""
    p = clipped(F.col("p")) if clip else F.col("p")
    y = F.col("y")
    return scored.select(p.alias("p"), y).groupBy("p").agg(
        F.sum((y == 1).cast("long")).alias("pos"),
        F.sum((y != 1).cast("long")).alias("neg"),
    )


def ranked(scored: DataFrame, clip: bool = True, task_rows: int | None = None) -> DataFrame:
    """Distinct scores with the counts at or above each: ``cum_pos`` and ``cum_neg``."""
    return running_totals(by_score(scored, clip), "p", ["pos", "neg"], descending=True, task_rows=task_rows)


def bin_of(p: Column, bins: int) -> Column:
    """Index of the half-open bin among equal ones over [0, 1): how many inner edges lie at or below p."""
    edges = [float(e) for e in np.linspace(0.0, 1.0, bins + 1)[1:]]
    return sum(((p >= F.lit(e)).cast("int") for e in edges), F.lit(0))


def classification_metrics(
    scored: DataFrame, threshold: float | None = None, task_rows: int | None = None
) -> DataFrame:
    """All metrics of one scored set in one row, from one ordering of its distinct scores.

    AUROC counts, for each negative, the positives above it (half for ties); AUPRC sums precision over the
    positives gained at each score. Both are null when a class is absent.
    """
    t = 0.5 if threshold is None else float(threshold)
    p, pos, neg = F.col("p"), F.col("pos"), F.col("neg")
    n = pos + neg

    def hits(what: Column, cut: float) -> Column:
        return F.sum(F.when(p >= cut, what).otherwise(0))

    per_bin = (
        ranked(scored, task_rows=task_rows)
        .withColumn("_bin", bin_of(p, CALIBRATION_BINS))
        .groupBy("_bin")
        .agg(
            F.sum(pos).alias("pos"),
            F.sum(neg).alias("neg"),
            F.sum(n * p).alias("sum_p"),
            F.sum(n * p * p).alias("sum_pp"),
            F.sum(pos * (1 - p) * (1 - p) + neg * p * p).alias("loss"),
            F.min(p).alias("low"),
            F.max(p).alias("high"),
            F.sum(neg * (F.col("cum_pos") - pos / 2)).alias("above"),
            F.sum(pos * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("gain"),
            hits(pos, 0.5).alias("tp_default"),
            hits(neg, 0.5).alias("fp_default"),
            hits(pos, t).alias("tp"),
            hits(neg, t).alias("fp"),
        )
    )
    gap = F.abs(F.col("pos") - F.col("sum_p"))
    sums = per_bin.agg(
        *[
            F.sum(c).alias(c)
            for c in ("pos", "neg", "sum_p", "sum_pp", "loss", "above", "gain", "tp_default", "fp_default", "tp", "fp")
        ],
        F.sum(F.when(F.col("_bin") < CALIBRATION_BINS, gap)).alias("gaps"),
        F.min("low").alias("prob_min"),
        F.max("high").alias("prob_max"),
    )
    n = F.col("n_samples")
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    mean = F.col("sum_p") / n
    precision = S.ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = S.ratio(F.col("tp"), F.col("pos"))
    counted = sums.withColumn("n_samples", F.col("pos") + F.col("neg")).where("n_samples > 0")
    return counted.select(
        F.when(both, F.col("above") / (F.col("pos") * F.col("neg"))).alias("auroc"),
        F.when(both, F.col("gain") / F.col("pos")).alias("auprc"),
        ((F.col("tp") + F.col("neg") - F.col("fp")) / n).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        S.ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")).alias("f1"),
        (F.col("loss") / n).alias("brier"),
        (F.col("gaps") / n).alias("ece"),
        (F.col("neg") - F.col("fp_default")).alias("tn_default"),
        F.col("fp_default"),
        (F.col("pos") - F.col("tp_default")).alias("fn_default"),
        F.col("tp_default"),
        F.lit(t).alias("chosen_threshold"),
        (F.col("neg") - F.col("fp")).alias("tn_optimal"),
        F.col("fp").alias("fp_optimal"),
        (F.col("pos") - F.col("tp")).alias("fn_optimal"),
        F.col("tp").alias("tp_optimal"),
        ((F.col("tp_default") + F.col("fp_default")) / n).alias("default_positive_rate"),
        ((F.col("tp") + F.col("fp")) / n).alias("optimal_positive_rate"),
        n.alias("n_samples"),
        F.col("pos").alias("n_pos"),
        F.col("neg").alias("n_neg"),
        (F.col("pos") / n).alias("prevalence"),
        F.col("prob_min"),
        F.col("prob_max"),
        mean.alias("prob_mean"),
        F.sqrt(F.greatest(F.col("sum_pp") / n - mean * mean, F.lit(0.0))).alias("prob_std"),
    )


def regression_metrics(scored: DataFrame) -> DataFrame:
    """MAE, RMSE, R2 and correlation of ``p`` against ``y``; correlation is 0 where undefined."""
    y, p = F.col("y"), F.col("p")
    sums = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.var_pop(y).alias("vy"),
        F.var_pop(p).alias("vp"),
        F.covar_pop(y, p).alias("cov"),
    )
    spread = F.col("vy") * F.col("vp")
    exact = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    return sums.select(
        "mae",
        F.sqrt("mse").alias("rmse"),
        F.when(F.col("n") < 2, F.lit(None))
        .when(F.col("vy") == 0, exact)
        .otherwise(1.0 - F.col("mse") / F.when(F.col("vy") != 0, F.col("vy")))
        .alias("r2"),
        F.when(spread > 0, F.col("cov") / F.sqrt(F.when(spread > 0, spread))).otherwise(0.0).alias("correlation"),
    )


def score_table(scored: DataFrame) -> DataFrame:
    """(p, pos, neg, n) of the distinct clipped scores, from files: the rows themselves are read once, here.

    Tables of several parts of the rows are merged by adding up. ``n`` counts rows without a label too.
    """
    rows = scored.select(clipped(F.col("p")).alias("p"), "y").where("p is not null")
    y = F.col("y")
    table = rows.groupBy("p").agg(
        F.coalesce(F.sum((y == 1).cast("long")), F.lit(0)).alias("pos"),
        F.coalesce(F.sum((y != 1).cast("long")), F.lit(0)).alias("neg"),
        F.count(F.lit(1)).alias("n"),
    )
    return materialize(table, "scores")


def score_quantiles(scores: DataFrame, shares: list[float], task_rows: int | None = None) -> list[float]:
    """Linearly interpolated quantiles of all rows, looked up in the running counts of a score table."""
    total = scores.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("scores")).first()
    if not total["n"]:
        return []
    places = [(total["n"] - 1) * s for s in shares]
    ranks = sorted({r for place in places for r in (math.floor(place), math.ceil(place))})
    upto = running_totals(scores, "p", ["n"], task_rows=task_rows, rows=total["scores"])
    inside = F.filter(F.array(*map(F.lit, ranks)), lambda r: (r >= F.col("cum_n") - F.col("n")) & (r < F.col("cum_n")))
    # At most two scores per share.
    at = {r["rank"]: r["p"] for r in upto.select("p", F.explode(inside).alias("rank")).collect()}
    low_high = [(at[math.floor(place)], at[math.ceil(place)], place - math.floor(place)) for place in places]
    return [low + (high - low) * part for low, high, part in low_high]


def threshold_candidates(scores: DataFrame, task_rows: int | None = None) -> list[float]:
    """Evenly spaced thresholds and score quantiles, sorted and distinct: at most twice CANDIDATES."""
    grid = [float(x) for x in np.linspace(0.001, 0.999, CANDIDATES)]
    found = score_quantiles(scores, grid, task_rows)
    return sorted({min(max(x, 0.0), 1.0) for x in [*grid, *found]})


def threshold_sweep(scores: DataFrame, candidates: list[float]) -> DataFrame:
    """Rates at every candidate threshold.

    Each score is counted once, in the interval between candidates it falls in; at most 401 interval counts are then
    summed from the top.
    """
    rows = add_piece(scores, "p", candidates, "step")
    counts = rows.groupBy("step").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # Step k holds the scores at or above exactly k candidates; candidate k is number k counted from 1.
    table = [(i, t) for i, t in enumerate([None, *candidates])]
    steps = scores.sparkSession.createDataFrame(table, "step int, threshold double").coalesce(1)
    full = steps.join(F.broadcast(counts), "step", "left").fillna(0, ["pos", "neg"])
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    tp, fp = F.col("tp"), F.col("fp")
    return (
        full.select(
            "threshold",
            F.sum("pos").over(above).alias("tp"),
            F.sum("neg").over(above).alias("fp"),
            F.sum("pos").over(whole).alias("n_pos"),
            F.sum(F.col("pos") + F.col("neg")).over(whole).alias("n"),
        )
        .where("threshold is not null")
        .select(
            "threshold",
            S.ratio(tp + fp, F.col("n")).alias("pred_rate"),
            S.ratio(tp, F.col("n_pos")).alias("recall"),
            S.ratio(tp, tp + fp).alias("precision"),
            S.ratio(2 * tp, tp + fp + F.col("n_pos")).alias("f1"),
        )
    )


def select_threshold(
    scored: DataFrame,
    policy: str = "f1",
    target_recall: float = 0.7,
    target_precision: float = 0.7,
    min_pred_rate: float = 0.02,
    max_pred_rate: float = 0.98,
    allow_pathological: bool = False,
    task_rows: int | None = None,
) -> DataFrame:
    """The threshold that serves ``policy`` best on validation rows, one row; 0.5 with a reason if none does.

    Ties go to the lowest threshold. Quantiles, rates and the share at one half all come from one table of scores.
    """
    scores = score_table(scored)
    sweep = threshold_sweep(scores, threshold_candidates(scores, task_rows))
    allowed = F.lit(bool(allow_pathological)) | F.col("pred_rate").between(min_pred_rate, max_pred_rate)
    centred = F.desc(-F.abs(F.col("threshold") - 0.5))
    if policy == "recall_at_precision":
        feasible = F.col("precision") >= target_precision
        best, reason = [F.desc("recall"), F.desc("precision"), centred], "no_threshold_meets_target_precision"
    elif policy == "precision_at_recall":
        feasible = F.col("recall") >= target_recall
        best, reason = [F.desc("precision"), F.desc("recall"), centred], "no_threshold_meets_target_recall"
    else:
        feasible, best, reason = F.lit(True), [F.desc("f1"), F.desc("precision"), F.desc("recall")], ""
    kept = sweep.where(allowed)
    chosen = kept.where(feasible).orderBy(*best, F.asc("threshold")).limit(1)
    some = kept.agg((F.count(F.lit(1)) > 0).alias("any_allowed"))
    above = F.sum(F.when(F.col("p") >= 0.5, F.col("n")).otherwise(0))
    single = (F.coalesce(F.sum("pos"), F.lit(0)) == 0) | (F.coalesce(F.sum("neg"), F.lit(0)) == 0)
    base = scores.agg(single.alias("one_class"), (above / F.sum("n")).alias("rate_at_half"))
    # All three sides are one row.
    row = base.crossJoin(F.broadcast(some)).join(F.broadcast(chosen), F.lit(True), "left")
    why = (
        F.when(F.col("one_class"), "validation_has_single_class")
        .when(~F.col("any_allowed"), "all_thresholds_filtered_by_pred_rate_guardrail")
        .when(F.col("threshold").isNull(), reason)
        .otherwise("")
    )
    failed = why != ""

    def unless_failed(c: str) -> Column:
        return F.when(~failed, F.col(c))

    return row.select(
        F.when(failed, 0.5).otherwise(F.col("threshold")).alias("threshold"),
        F.lit(policy).alias("policy"),
        failed.alias("fallback_used"),
        why.alias("fallback_reason"),
        F.when(failed, F.col("rate_at_half")).otherwise(F.col("pred_rate")).alias("val_positive_rate"),
        unless_failed("f1").alias("val_f1_at_threshold"),
        unless_failed("precision").alias("val_precision_at_threshold"),
        unless_failed("recall").alias("val_recall_at_threshold"),
    )


def roc_points(scored: DataFrame, task_rows: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, starting at the origin."""
    points = ranked(scored, clip=False, task_rows=task_rows)
    totals = by_score(scored, clip=False).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    curve = points.crossJoin(F.broadcast(totals)).select(
        F.col("p").alias("threshold"),
        S.ratio(F.col("cum_neg"), F.col("n_neg"), None).alias("fpr"),
        S.ratio(F.col("cum_pos"), F.col("n_pos"), None).alias("tpr"),
    )
    origin = scored.sparkSession.createDataFrame([(None, 0.0, 0.0)], curve.schema)
    return curve.unionByName(origin)


def pr_points(scored: DataFrame, task_rows: int | None = None) -> DataFrame:
    """(threshold, precision, recall) per distinct score, ending at (1, 0)."""
    points = ranked(scored, clip=False, task_rows=task_rows)
    totals = by_score(scored, clip=False).agg(F.sum("pos").alias("n_pos"))
    curve = points.crossJoin(F.broadcast(totals)).select(
        F.col("p").alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        S.ratio(F.col("cum_pos"), F.col("n_pos"), 1.0).alias("recall"),
    )
    end = scored.sparkSession.createDataFrame([(None, 1.0, 0.0)], curve.schema)
    return curve.unionByName(end)


def calibration_points(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Bin centre and mean label of each non-empty bin; a score of exactly 1 lies beyond the last."""
    binned = scored.withColumn("bin", bin_of(F.col("p"), bins)).where(F.col("bin") < bins)
    centre = (F.col("bin") + 0.5) / bins
    return binned.groupBy("bin").agg(F.avg("y").alias("accuracy"), F.count(F.lit(1)).alias("rows")).withColumn(
        "centre", centre
    )


def run_diagnostics(val: DataFrame, test: DataFrame, threshold: float) -> DataFrame:
    """Score ranges and positive counts reported next to the metrics, one row."""
    p = F.col("p")
    on_val = val.agg(
        F.avg((p >= threshold).cast("double")).alias("val_positive_rate_at_threshold"),
        F.min(p).alias("val_prob_min"),
        F.max(p).alias("val_prob_max"),
        F.avg(p).alias("val_prob_mean"),
        F.stddev_pop(p).alias("val_prob_std"),
    )
    on_test = test.agg(
        F.sum((p >= 0.5).cast("long")).alias("test_positive_count_default"),
        F.sum((p >= threshold).cast("long")).alias("test_positive_count_optimal"),
        F.min(p).alias("pred_min"),
        F.max(p).alias("pred_max"),
        F.count(p).alias("n_predictions"),
        F.count("y").alias("n_targets"),
    )
    return on_val.crossJoin(F.broadcast(on_test))
