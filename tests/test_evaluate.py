import numpy as np
import pytest

from signalspark.operators import compare, evaluate, models


def table(spark, y, p):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p, strict=True)], "y double, p double")


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(9)
    y = (rng.random(400) < 0.4).astype(float)
    p = np.clip(np.round(rng.normal(0.35 + 0.2 * y, 0.25), 2), 0, 1)
    return y, p


def auroc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def average_precision(y, p):
    total, before = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = y[hit].sum() / y.sum()
        total += (recall - before) * y[hit].mean()
        before = recall
    return total


@pytest.mark.parametrize("task_rows", [5, 100_000])
def test_classification_metrics(spark, sample, task_rows):
    y, p = sample
    p = np.clip(p, 1e-6, 1 - 1e-6)
    m = evaluate.classification_metrics(table(spark, *sample), 0.6, task_rows).first()
    hit = p >= 0.6
    tp, fp, fn = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum()
    ece = sum(
        (b := (p >= lo) & (p < hi)).sum() / len(y) * abs(y[b].mean() - p[b].mean())
        for lo, hi in zip(np.linspace(0, 1, 16)[:-1], np.linspace(0, 1, 16)[1:], strict=True)
        if ((p >= lo) & (p < hi)).any()
    )
    want = {
        "auroc": auroc(y, p),
        "auprc": average_precision(y, p),
        "f1": 2 * tp / (2 * tp + fp + fn),
        "precision": tp / (tp + fp),
        "recall": tp / (tp + fn),
        "brier": ((p - y) ** 2).mean(),
        "ece": ece,
        "prob_std": p.std(),
        "accuracy": (hit == (y == 1)).mean(),
    }
    for name, value in want.items():
        assert np.isclose(m[name], value, atol=1e-9), name
    assert (m.tp_optimal, m.fp_optimal, m.fn_optimal) == (tp, fp, fn)
    assert m.tn_default + m.fp_default + m.fn_default + m.tp_default == len(y)


def test_one_class_has_no_ranking_metric(spark):
    m = evaluate.classification_metrics(table(spark, [0, 0], [0.1, 0.9]), None).first()
    assert m.auroc is None and m.auprc is None and m.f1 == 0.0 and m.precision == 0.0 and m.accuracy == 0.5


def sweep(y, p, policy, low=0.02, high=0.98):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    grid = np.linspace(0.001, 0.999, 200)
    best = None
    for t in np.unique(np.concatenate([grid, np.quantile(p, grid)])):
        hit = p >= t
        tp = (hit & (y == 1)).sum()
        precision = tp / hit.sum() if hit.any() else 0.0
        recall, f1 = tp / y.sum(), 2 * tp / (hit.sum() + y.sum())
        rank = {
            "f1": (f1, precision, recall),
            "recall_at_precision": (recall, precision, -abs(t - 0.5)) if precision >= 0.7 else None,
            "precision_at_recall": (precision, recall, -abs(t - 0.5)) if recall >= 0.7 else None,
        }[policy]
        if rank and low <= hit.mean() <= high and (best is None or rank > best[0]):
            best = (rank, t)
    return best[1] if best else None


@pytest.mark.parametrize("policy", ["f1", "recall_at_precision", "precision_at_recall"])
@pytest.mark.parametrize("task_rows", [50, 100_000])
def test_threshold_choice_equals_a_full_sweep(spark, sample, policy, task_rows):
    row = evaluate.select_threshold(table(spark, *sample), policy, task_rows=task_rows).first()
    assert not row.fallback_used and np.isclose(row.threshold, sweep(*sample, policy), atol=1e-12)


@pytest.mark.parametrize(
    ("y", "options", "reason"),
    [
        ([1, 1], {}, "validation_has_single_class"),
        ([0, 1], {"min_pred_rate": 0.6, "max_pred_rate": 0.7}, "all_thresholds_filtered_by_pred_rate_guardrail"),
        ([1, 0], {"policy": "recall_at_precision"}, "no_threshold_meets_target_precision"),
        ([0, 1], {"policy": "precision_at_recall", "target_recall": 1.1}, "no_threshold_meets_target_recall"),
    ],
)
def test_threshold_fallbacks(spark, y, options, reason):
    row = evaluate.select_threshold(table(spark, y, [0.2, 0.8]), **options).first()
    assert (row.threshold, row.fallback_used, row.fallback_reason) == (0.5, True, reason)
    assert row.val_positive_rate == 0.5


def test_regression_metrics(spark):
    y, p = np.array([1.0, 2, 3, 5]), np.array([1.5, 2, 2, 4])
    m = evaluate.regression_metrics(table(spark, y, p)).first()
    assert np.allclose(
        [m.mae, m.rmse, m.r2, m.correlation],
        [0.625, np.sqrt(((y - p) ** 2).mean()), 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(),
         np.corrcoef(y, p)[0, 1]],
    )
    flat = evaluate.regression_metrics(table(spark, [1, 1], [2, 2])).first()
    assert flat.correlation == 0.0 and flat.r2 == 0.0


def test_curves_end_points(spark, sample):
    roc = evaluate.roc_points(table(spark, *sample)).toPandas().sort_values(["fpr", "tpr"])
    assert roc[["fpr", "tpr"]].iloc[0].tolist() == [0, 0] and roc[["fpr", "tpr"]].iloc[-1].tolist() == [1, 1]
    assert np.isclose(np.trapezoid(roc.tpr, roc.fpr), auroc(*sample))
    pr = evaluate.pr_points(table(spark, *sample))
    assert pr.where("threshold is null").select("precision", "recall").first() == (1.0, 0.0)


def test_a_missing_auroc_loses(spark):
    long = spark.createDataFrame(
        [("b", "stress", "auroc", 0.4), ("a", "stress", "auroc", float("nan")), ("a", "comfort", "rmse", 0.2),
         ("b", "comfort", "rmse", 0.2)],
        compare.LONG,
    )
    row = compare.winners(long, "a", "b").first()
    assert row.stress_winner_by_auroc == "b" and row.comfort_winner_by_rmse == "a"
    assert row.delta_stress_auroc is None and row.delta_comfort_rmse == 0.0


def test_acceptance(spark):
    good = spark.createDataFrame([("test", 0.0, 3), ("test", 1.0, 2)], "split string, y_stress double, windows long")
    fine = spark.createDataFrame([("trees", None)], "model string, error string")
    bad = spark.createDataFrame([("trees", "boom")], "model string, error string")
    assert compare.acceptance(good, fine).isEmpty()
    assert compare.acceptance(good.where("y_stress = 0"), bad).count() == 2


def test_platt_is_the_penalised_logistic_fit(spark, sample):
    y, p = sample
    fitted = models.fit_calibrator(table(spark, y, p).withColumnRenamed("p", "p_raw"), "platt")
    w, b = 0.0, 0.0
    for _ in range(50):
        s = 1 / (1 + np.exp(-(w * p + b)))
        g = np.array([(p * (s - y)).sum() + w, (s - y).sum()])
        v = s * (1 - s)
        h = np.array([[(p * p * v).sum() + 1, (p * v).sum()], [(p * v).sum(), v.sum()]])
        w, b = np.array([w, b]) - np.linalg.solve(h, g)
    assert np.allclose([fitted.coefficients[0], fitted.intercept], [w, b], atol=1e-4)


def test_importances_are_ranked(spark):
    fitted = models.Fitted(["a", "b", "c"], None, importances=[("a", 0.1), ("b", 0.6), ("c", 0.3)])
    assert [r.feature for r in models.importance_table(spark, fitted, 2).collect()] == ["b", "c"]
