import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from signalspark.layout import SeriesLayout
from signalspark.operators import normalize, profiles
from signalspark.schema import SignalSchema

SCHEMA = SignalSchema(physiology=("x",), context=())
LAYOUTS = [SeriesLayout(), SeriesLayout((), 7), SeriesLayout((), 1)]


def frame(spark, values):
    data = [(w, "train", i, v) for w, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(data, "worker_id string, split string, _seg_pos long, x double")


def values_of(df, worker, column="x"):
    return [r[column] for r in df.where(F.col("worker_id") == worker).orderBy("_seg_pos").collect()]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_fill_gaps_stays_inside_the_worker(spark, layout):
    df = frame(spark, {"a": [None, None, 2.0, None, 3.0, None], "b": [None] * 9, "c": [5.0] + [None] * 20})
    out = normalize.fill_gaps(df, ["x", "y"], ["worker_id", "split"], "_seg_pos", layout)
    assert values_of(out, "a") == [2.0, 2.0, 2.0, 2.0, 3.0, 3.0]
    assert values_of(out, "b") == [0.0] * 9 and values_of(out, "c") == [5.0] * 21
    assert out.where("y <> 0.0").isEmpty()


def online(series, alpha, warm):
    """The recurrence, one row at a time."""
    head = [v for v in series[: max(3, warm)] if v is not None]
    mu, sigma = (np.mean(head), np.std(head) + 1e-6) if head else (0.0, 1.0)
    out = []
    for v in series:
        v = mu if v is None else v
        out.append(((v - mu) / max(sigma, 1e-6), mu, sigma))
        mu = (1 - alpha) * mu + alpha * v
        sigma = np.sqrt(max((1 - alpha) * sigma**2 + alpha * (v - mu) ** 2, 1e-6))
    return np.array(out)


@pytest.fixture(params=[3, 10_000])
def batch_rows(spark, request):
    """Arrow batches that split series and blocks, and ones that hold many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize(("alpha", "warm"), [(0.1, 30), (0.9, 4)])
def test_online_normalisation(spark, batch_rows, layout, alpha, warm):
    rng = random.Random(5)
    values = {
        "a": [rng.gauss(3, 2) for _ in range(60)],
        "b": [None if rng.random() < 0.3 else rng.gauss(0, 1) for _ in range(25)],
        "c": [1.0] * 12,
        "d": [None, None],
        "e": [4.0],
    }
    out = normalize.normalize_online(
        frame(spark, values), ["x"], ["worker_id", "split"], "_seg_pos", alpha, warm, layout
    ).cache()
    for worker, series in values.items():
        want = online(series, alpha, warm)
        for i, column in enumerate(("x", "baseline_mu_x", "baseline_sigma_x")):
            assert np.allclose(values_of(out, worker, column), want[:, i], atol=1e-9), (worker, column)


def test_global_normalisation_does_not_see_other_splits(spark):
    train = frame(spark, {"a": [1.0, 2.0, 3.0, 6.0]})
    base = normalize.normalize_global(train, ["x"])
    noisy = train.unionByName(
        spark.createDataFrame([("b", "test", 0, 1e9)], train.schema)
    )
    again = normalize.normalize_global(noisy, ["x"]).where("split = 'train'")
    assert rows(base) == rows(again.select(*base.columns))
    sigma = np.std([1.0, 2.0, 3.0, 6.0], ddof=1) + 1e-6
    assert np.allclose(values_of(base, "a"), (np.array([1.0, 2, 3, 6]) - 3) / sigma)


def test_medians_ignore_other_splits_and_empty_columns(spark):
    df = spark.createDataFrame(
        [("train", 1.0, None), ("train", 4.0, None), ("train", None, None), ("test", 100.0, 5.0)],
        "split string, a double, b double",
    )
    found = normalize.train_medians(df, ["a", "b"])
    assert found == {"a": 2.5, "b": 0.0}
    filled = normalize.impute_medians(df, found)
    assert rows(filled.select("a", "b"), "a", "b") == [(1.0, 0.0), (2.5, 0.0), (4.0, 0.0), (100.0, 5.0)]


def ema(series, alpha):
    mu, second = series[0], series[0] ** 2
    for v in series[1:]:
        mu, second = (1 - alpha) * mu + alpha * v, (1 - alpha) * second + alpha * v * v
    return mu, np.sqrt(max(second - mu * mu, 1e-6))


@pytest.mark.parametrize("layout", LAYOUTS)
def test_worker_baselines(spark, layout):
    rng = random.Random(2)
    values = {"a": [rng.gauss(0, 1) for _ in range(30)], "b": [None, 2.0, None, 5.0, 1.0], "c": [None, None]}
    df = frame(spark, values).withColumn("safe", (F.col("_seg_pos") % 2 == 1).cast("double"))
    everything = [v for vs in values.values() for v in vs if v is not None]
    out = profiles.worker_baselines(df, ["x"], 0.2, "worker_id", "_seg_pos", layout)
    got = {r.worker_id: (r.baseline_mu_x, r.baseline_sigma_x) for r in out.collect()}
    assert np.allclose(got["a"], ema(values["a"], 0.2))
    assert np.allclose(got["b"], ema([2.0, 5.0, 1.0], 0.2))
    assert np.allclose(got["c"], (np.mean(everything), np.std(everything, ddof=1) + 1e-6))
    safe = profiles.worker_baselines(df, ["x"], 0.2, "worker_id", "_seg_pos", layout, "safe")
    got = {r.worker_id: (r.baseline_mu_x, r.baseline_sigma_x) for r in safe.collect()}
    assert np.allclose(got["a"], ema(values["a"][1::2], 0.2)) and np.allclose(got["b"], ema([2.0, 5.0], 0.2))


def test_attributes_come_from_the_first_row(spark):
    df = spark.createDataFrame(
        [("a", 1, 3, 9), ("a", 0, 2, 0)],
        "worker_id string, _seg_pos long, specialization_index int, experience_level int",
    )
    assert rows(profiles.worker_attributes(df, SCHEMA, "_seg_pos")) == [("a", 2, 1)]
