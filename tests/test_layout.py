import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from signalspark.layout import SeriesLayout, exact_quantiles, number_rows, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    """One worker holds most rows; values repeat and have gaps."""
    rng = random.Random(3)
    data = [("hot", i, rng.choice([None, rng.gauss(0, 1)])) for i in rng.sample(range(5000), 900)]
    data += [(f"w{k}", i, float(i)) for k in range(30) for i in range(rng.randint(1, 12))]
    return spark.createDataFrame(data, "worker string, t long, x double").cache()


def test_fit_keeps_short_series_whole(skewed):
    assert not SeriesLayout.fit(skewed, "worker", "t", 10_000).cut


def test_fit_cuts_the_hot_series_evenly(skewed):
    layout = SeriesLayout.fit(skewed, "worker", "t", 50)
    assert layout.cut and len(layout.points) == 17
    from signalspark.layout import add_piece

    sizes = add_piece(skewed.where("worker = 'hot'"), "t", layout.points).groupBy("_piece").count().collect()
    assert max(r["count"] for r in sizes) <= 2 * 50


def test_numbering_is_the_same_cut_or_whole(skewed):
    whole = number_rows(skewed, ["worker"], ["t"], SeriesLayout())
    cut = number_rows(skewed, ["worker"], ["t"], SeriesLayout.fit(skewed, "worker", "t", 50))
    assert rows(whole.select("worker", "t", "_pos", "_n")) == rows(cut.select("worker", "t", "_pos", "_n"))


def test_cut_numbering_sends_no_series_to_one_task(skewed):
    layout = SeriesLayout.fit(skewed, "worker", "t", 50)
    plan = number_rows(skewed, ["worker"], ["t"], layout)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(worker" not in plan.split("_local")[0].split("row_number")[-1]
    assert "_piece" in plan


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    table = spark.range(1000).select((F.col("id") * 7919 % 1009).cast("double").alias("v"), F.col("id").alias("n"))
    small = running_totals(table, "v", ["n"], descending, task_rows=10_000)
    cut = running_totals(table, "v", ["n"], descending, task_rows=30)
    assert rows(small) == rows(cut.select(*small.columns))
    values = sorted(((r.v, r.n) for r in table.collect()), reverse=descending)
    assert [r[0] for r in sorted(((r.cum_n, r.v) for r in cut.collect()))] == list(np.cumsum([n for _, n in values]))


@pytest.mark.parametrize("task_rows", [10, 97, 100_000])
def test_exact_quantiles(spark, task_rows):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=501), rng.integers(0, 7, size=501).astype(float)
    data = [(float(x), None if i % 5 == 0 else float(y), None) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(data, "a double, b double, c double")
    shares = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    found = exact_quantiles(df, ["a", "b", "c"], shares, task_rows)
    kept = [y for i, y in enumerate(b) if i % 5]
    assert np.allclose(found["a"], np.quantile(a, shares), atol=1e-12)
    assert np.allclose(found["b"], np.quantile(kept, shares), atol=1e-12)
    assert found["c"] is None or found["c"] == [None] * len(shares)


def test_cut_numbering_keeps_null_keys_and_orders(spark):
    """Both forms give the same rows for null keys, null and not-a-number order values, and ties."""
    values = [None, float("nan"), *[float(i // 2) for i in range(40)]]
    data = [(k, v, i) for k in ("a", None) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "worker string, at double, id int")
    whole = number_rows(df, ["worker"], ["at", "id"], SeriesLayout())
    fitted = SeriesLayout.fit(df, "worker", "at", 10)
    assert fitted.cut and fitted.points
    cut = number_rows(df, ["worker"], ["at", "id"], fitted)
    key = lambda r: (str(r[0]), r[2])
    names = ["worker", "at", "id", "_pos", "_n"]
    assert sorted(map(str, whole.select(names).collect())) == sorted(map(str, cut.select(names).collect()))
    assert sorted(cut.select(names).collect(), key=key)[0] is not None


def test_cut_running_totals_keep_null_scores(spark):
    df = spark.createDataFrame([(None, 1), *[(float(i), 1) for i in range(20)]], "score double, n int")
    got = running_totals(df, "score", ["n"], task_rows=5)
    assert sorted(r.cum_n for r in got.collect()) == list(range(1, 22))
