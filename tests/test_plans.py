import json
import math
import random

import pytest
from helpers import rows

from signalspark import sinks
from signalspark.operators import compare
from signalspark.plans import diagnostics, experiment
from signalspark.schema import SignalSchema

SCHEMA = SignalSchema()
TREES = {"max_depth": 2, "n_estimators": 3, "learning_rate": 0.3, "calibration": "isotonic"}
CFG = {
    "task": {"horizon_steps": 2, "window_length": 8, "sampling_rate_hz": 4.0, "window_step": 2},
    "profiles": {"enabled": True, "use_static_meta": True},
    "xgboost": TREES,
    "tft": {"hidden_size": 4, "max_iter": 5},
}


@pytest.fixture(scope="module")
def frame(spark):
    """Workers whose latent state drifts; it drives signals, context and labels."""
    rng = random.Random(11)
    data = []
    for w in range(10):
        state = 0.0
        for t in range(160):
            state = 0.88 * state + rng.gauss(0, 0.5)
            data.append(
                (
                    f"w{w}", t, None if t % 17 == 3 else state + rng.gauss(0, 0.1), 2 + 1.8 * state, 33 - 0.4 * state,
                    4.0 - state, 1.0 + 0.5 * state, float(state > 0), max(0.0, min(1.0, 0.6 - 0.2 * state)),
                )
            )
    return spark.createDataFrame(
        data,
        "worker_id string, time_idx int, ecg double, eda double, temp double, distance_to_robot double, "
        "robot_speed double, y_stress double, y_comfort_proxy double",
    )


def long_table(metrics):
    return {(r.model, r.target, r.metric): r.value for r in metrics.collect()}


def test_time_split_run_writes_everything(spark, frame, tmp_path):
    out = str(tmp_path / "run")
    outcome = experiment.run(spark, CFG, frame, out)
    assert outcome.reports.where("error is not null").isEmpty(), outcome.reports.collect()
    values = long_table(outcome.metrics)
    for model in ("trees", "sequence"):
        assert 0.0 <= values[model, "stress", "auroc"] <= 1.0
        assert math.isfinite(values[model, "comfort", "rmse"])
    assert outcome.comparison.first().stress_winner_by_auroc in ("trees", "sequence")
    assert {r.model for r in outcome.ablation.collect()} == {"trees", "trees_profiles_off"}
    assert compare.acceptance(outcome.balance, outcome.reports).isEmpty()
    # 160 rows per worker: 112, 24 and 24 per split; 8 + 2 rows per window, every second start.
    counts = {r.split: r["count"] for r in spark.read.parquet(f"{out}/windows").groupBy("split").count().collect()}
    assert counts == {"train": 520, "val": 80, "test": 80}
    assert spark.read.option("header", True).csv(f"{out}/splits").count() == 1600
    assert spark.read.option("header", True).csv(f"{out}/meta").count() == 680
    facts = json.loads(spark.read.text(f"{out}/models/stress/facts").first()[0])
    again = sinks.read_model(spark, f"{out}/models/stress")
    assert again.names == facts["feature_names"] and len(again.importances) == len(again.names)
    assert "temp_slope" in facts["feature_names"] and "profile_baseline_mu_ecg" in facts["feature_names"]
    for name in ("numeric_stats", "profile_stats", "feature_stats", "matrix_stats", "metrics", "importance/stress"):
        assert not spark.read.json(f"{out}/{name}").isEmpty()


def test_training_statistics_ignore_test_rows(spark, frame):
    from pyspark.sql import functions as F

    def train_of(df):
        cfg = {**CFG, "split": {"mode": "subject_holdout", "train_subjects": ["w0", "w1"], "val_subjects": ["w2"],
                                "test_subjects": ["w3"]}}
        prepared = experiment.prepare(experiment.clean.typed_projection(df, SCHEMA), SCHEMA, cfg)
        return rows(prepared.rows.where("split = 'train'"), "worker_id", "time_idx")

    loud = frame.withColumn("ecg", F.when(F.col("worker_id") == "w3", 1e6).otherwise(F.col("ecg")))
    assert train_of(frame) == train_of(loud)


def test_cut_series_give_the_same_rows(spark, frame, cut_series):
    from signalspark.layout import TASK_ROWS_SETTING

    for mode in ("global", "online"):
        cfg = {**CFG, "normalization": {"mode": mode, "warmup_steps": 5}}
        typed = experiment.clean.typed_projection(frame, SCHEMA)
        cut = experiment.prepare(typed, SCHEMA, cfg)
        assert cut.cutter.layout.cut
        cut_rows = experiment.features_of(cut, cfg).toPandas()
        spark.conf.unset(TASK_ROWS_SETTING)
        whole = experiment.prepare(typed, SCHEMA, cfg)
        assert not whole.cutter.layout.cut
        whole_rows = experiment.features_of(whole, cfg).toPandas()
        spark.conf.set(TASK_ROWS_SETTING, "20")
        keys = ["worker_id", "split", "start_idx"]
        a, b = (t.sort_values(keys).reset_index(drop=True) for t in (cut_rows, whole_rows))
        assert a[keys].equals(b[keys])
        numbers = [c for c in a.columns if a[c].dtype.kind == "f"]
        assert ((a[numbers] - b[numbers]).abs().fillna(0) < 1e-9).all().all()


def test_balanced_run(spark, frame):
    outcome = experiment.run_balanced(
        spark, {**CFG, "models": {"run_tft": False}, "split": {"min_val_positive_windows": 5}}, frame
    )
    assert {r.split for r in outcome.balance.collect()} == {"train", "val", "test"}


def test_a_failing_model_is_reported(spark, frame):
    outcome = experiment.run(spark, {**CFG, "tft": {"hidden_size": -1}, "models": {"run_xgb": False}}, frame)
    report = outcome.reports.first()
    assert report.model == "sequence" and report.error
    assert not compare.acceptance(outcome.balance, outcome.reports).isEmpty()


def test_subject_holdout_needs_subjects(spark, frame):
    with pytest.raises(ValueError, match="subject"):
        experiment.run(spark, {**CFG, "split": {"mode": "subject_holdout"}}, frame)


def test_diagnostics(spark, frame):
    summary = diagnostics.summarize(experiment.clean.typed_projection(frame, SCHEMA), SCHEMA, 3)
    table = summary.table.first()
    assert (table.rows, table.workers, table.time_idx_max) == (1600, 10, 159)
    assert summary.top_workers.count() == 3 and summary.labels.count() == 2
    assert rows(summary.top_classes.select("protocol_label", "rows")) == [("unknown", 1600)]
