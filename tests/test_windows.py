import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from signalspark.layout import SeriesLayout
from signalspark.operators import features, sequences, windows
from signalspark.operators.windows import Cutter
from signalspark.schema import SignalSchema

SCHEMA = SignalSchema()


def placed(spark, sizes, split="train"):
    rng = np.random.default_rng(4)
    data = []
    for w, n in sizes.items():
        x = rng.normal(size=(n, 5)).tolist()
        data += [(w, split, i, n, 10 * i, *x[i], i % 3, float(i % 2), float(i)) for i in range(n)]
    return spark.createDataFrame(
        data,
        "worker_id string, split string, _seg_pos long, _seg_n long, time_idx int, ecg double, eda double, "
        "temp double, distance_to_robot double, robot_speed double, hazard_zone int, y_stress double, "
        "y_comfort_proxy double",
    )


@pytest.mark.parametrize("layout", [SeriesLayout(), SeriesLayout((), 5), SeriesLayout((), 1)])
@pytest.mark.parametrize(("length", "horizon", "step"), [(4, 1, 1), (4, 3, 2), (10, 2, 3), (1, 0, 1), (6, 1, 50)])
def test_windows_match_slices(spark, layout, length, horizon, step):
    sizes = {"a": 30, "b": length + horizon, "c": max(1, length + horizon - 1)}
    df = placed(spark, sizes)
    out = windows.window_table(df, Cutter(SCHEMA, length, horizon, step, layout)).cache()
    counts = {r.worker_id: r["count"] for r in out.groupBy("worker_id").count().collect()}
    for worker, n in sizes.items():
        assert counts.get(worker, 0) == max(0, (n - length - horizon) // step + 1)
    data = {w: df.where(F.col("worker_id") == w).orderBy("_seg_pos").toPandas() for w in sizes}
    for r in out.collect():
        start = r.start_idx // 10
        part = data[r.worker_id]
        assert r.end_idx == 10 * (start + length - 1) and r.label_time_idx == 10 * (start + length + horizon - 1)
        assert r.y_comfort == start + length + horizon - 1
        for channel in SCHEMA.channels(df.columns):
            assert list(r[channel]) == part[channel].iloc[start : start + length].astype(float).tolist()


def test_one_exchange_for_short_series(spark):
    cut = Cutter(SCHEMA, 10, 2, 1)
    table = features.feature_table(placed(spark, {"a": 40}), cut, 4.0, in_jvm=True)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BatchEvalPython" not in plan


def test_halo_rows_never_start_a_window(spark):
    cut = Cutter(SCHEMA, 4, 1, 1, SeriesLayout((), 6))
    meta = windows.window_meta(placed(spark, {"a": 50}), cut)
    assert meta.count() == meta.select("start_idx").distinct().count() == 46


def test_length_fit():
    assert windows.fitted_length(42, 60, 5) == 36
    assert windows.fitted_length(100, 60, 5) == 60
    assert windows.fitted_length(7, 60, 5) == 4
    with pytest.raises(ValueError, match="too short"):
        windows.fitted_length(5, 60, 5)


@pytest.mark.parametrize("layout", [SeriesLayout(), SeriesLayout((), 7)])
@pytest.mark.parametrize(("length", "hz"), [(3, 4.0), (12, 4.0), (30, 1.0), (40, 20.0)])
def test_features_agree_in_jvm_and_arrow(spark, layout, length, hz):
    df = placed(spark, {"a": 90, "b": 50})
    cut = Cutter(SCHEMA, length, 1, 2, layout)
    arrow, jvm = (features.feature_table(df, cut, hz, in_jvm=j, scr_distance=4).toPandas() for j in (False, True))
    keys = ["worker_id", "start_idx"]
    arrow, jvm = (t.sort_values(keys).reset_index(drop=True) for t in (arrow, jvm))
    assert list(arrow.columns) == list(jvm.columns) and len(arrow)
    for name in features.feature_names(arrow):
        a, b = arrow[name].astype(float), jvm[name].astype(float)
        assert np.allclose(a, b, atol=1e-9, equal_nan=True), name


def test_feature_order_and_context_rules(spark):
    df = placed(spark, {"a": 30})
    names = features.feature_names(features.feature_table(df, Cutter(SCHEMA, 10, 1), 4.0))
    assert names == [
        "meanHR", "RMSSD", "SDNN", "pNN50", "LF", "HF", "LF_HF", "scl_mean", "scl_var", "scr_count", "scr_mean_amp",
        "temp_mean", "temp_std", "temp_slope", "ttc_proxy", "distance_last", "speed_last",
    ]
    bare = features.feature_table(df, Cutter(SignalSchema(context=()), 10, 1), 4.0, False)
    assert "ttc_proxy" not in bare.columns and bare.where("distance_last <> 0 or speed_last <> 0").isEmpty()
    with pytest.raises(ValueError, match="ecg"):
        features.feature_table(df, Cutter(SignalSchema(physiology=("eda", "temp")), 10, 1), 4.0)


def test_moment_features_by_hand(spark):
    df = placed(spark, {"a": 12})
    table = features.feature_table(df, Cutter(SCHEMA, 10, 1), 4.0).orderBy("start_idx").toPandas()
    temp = df.orderBy("_seg_pos").toPandas()["temp"].to_numpy()
    for i, r in table.iterrows():
        part = temp[i : i + 10]
        assert np.allclose(
            [r.temp_mean, r.temp_std, r.temp_slope], [part.mean(), part.std(), np.polyfit(range(10), part, 1)[0]]
        )


def test_padding_adds_one_neutral_row_per_unseen_worker(spark):
    df = placed(spark, {"a": 4}).unionByName(placed(spark, {"b": 3}, "test"))
    df = df.withColumns({"task_phase": F.lit("p"), "specialization_index": F.lit(1), "experience_level": F.lit(2)})
    out = sequences.pad_unseen(sequences.reindex(df, SCHEMA), SCHEMA, "y_stress")
    added = rows(out.where("worker_id = 'b' and split = 'train'").select("time_idx", "ecg", "y_stress", "task_phase"))
    assert added == [(0, 0.0, 0.0, "p")] and out.count() == 8


def test_last_window_per_series(spark):
    meta = windows.window_meta(placed(spark, {"a": 20, "b": 9}), Cutter(SCHEMA, 4, 1))
    last = sequences.last_per_series(meta, "worker_id").select("worker_id", "start_idx")
    assert rows(last) == [("a", 150), ("b", 40)]


def test_length_fit_reports_series_shorter_than_the_horizon(spark, tmp_path):
    """Ten events of one worker: seven, one and two rows in the splits."""
    from datetime import datetime, timedelta

    from signalspark import catalog

    catalog.load_all()
    start = datetime(2024, 1, 1)
    data = [(i, start + timedelta(hours=i), 1, "view", float(i), '{"k": 1}') for i in range(10)]
    fields = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(data, fields).write.parquet(str(tmp_path / "events.parquet"))
    assert rows(catalog.QUERIES["window_length_fit"](spark, str(tmp_path))) == [(1, 4)]
    for n, fitted in ((5, 4), (42, 36), (61, 60)):
        assert rows(windows.length_fit(placed(spark, {"a": n, "b": 90}), "worker_id", 60, 5)) == [(n, fitted)]


def test_features_are_made_at_window_starts_only(spark):
    """No aggregate runs over a frame of each row; nulls, not-a-number and lone values agree with the frames."""
    df = placed(spark, {"a": 60})
    df = df.withColumn("temp", F.when(F.col("_seg_pos") < 12, None).when(F.col("_seg_pos") == 40, float("nan")).otherwise(F.col("temp")))
    df = df.withColumn("robot_speed", F.when(F.col("_seg_pos") % 7 > 0, F.col("robot_speed")))
    cut = Cutter(SCHEMA, 10, 2, 3)
    one, two = (features.feature_table(df, cut, 4.0, in_jvm=j) for j in (False, True))
    assert one._jdf.queryExecution().executedPlan().toString().count("specifiedwindowframe") <= 1
    names = [c for c in one.columns if c.startswith(("temp", "ttc", "distance", "speed"))]
    for a, b in zip(one.orderBy("start_idx").collect(), two.orderBy("start_idx").collect(), strict=True):
        for c in names:
            assert (a[c] is None) == (b[c] is None), c
            assert a[c] is None or np.isclose(a[c], b[c], equal_nan=True), c
