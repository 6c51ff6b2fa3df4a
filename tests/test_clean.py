import pytest
from helpers import rows
from pyspark.sql import functions as F

from signalspark.operators import clean, relate, sample
from signalspark.layout import SeriesLayout
from signalspark.schema import SignalSchema

SCHEMA = SignalSchema()
WHOLE = SeriesLayout()


def test_legacy_target_and_names(spark):
    raw = spark.createDataFrame(
        [("a", 0, 60.0, "2.5", 1.0, "0.5"), ("a", 1, 61.0, "bad", 2.0, None), ("b", 0, 62.0, "3", 3.0, "1.7")],
        "worker_id string, time_idx int, hr double, gsr string, hrv_rmssd double, target string",
    )
    out = clean.typed_projection(raw, SCHEMA)
    got = rows(out.select("worker_id", "time_idx", "ecg", "eda", "y_stress", "y_comfort_proxy", "protocol_label"))
    assert got == [
        ("a", 0, 60.0, 2.5, 1.0, 0.5, "unknown"),
        ("a", 1, 61.0, None, 0.0, 1.0, "unknown"),
        ("b", 0, 62.0, 3.0, 1.0, 0.0, "unknown"),
    ]
    assert out.where("task_phase <> 'default' or hazard_zone <> 0 or experience_level not between 1 and 5").isEmpty()
    assert "resp" not in out.columns


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="worker_id"):
        clean.typed_projection(spark.range(1), SCHEMA)
    with pytest.raises(ValueError, match=r"\['ecg', 'eda', 'temp'\]"):
        clean.typed_projection(
            spark.createDataFrame([("a", 0, "1")], "worker_id string, time_idx int, target string"), SCHEMA
        )


def test_time_axis_from_ingest_order(spark):
    raw = spark.createDataFrame(
        [("a", 7, 1.0), ("b", 3, 2.0), ("a", 2, 3.0)], "worker_id string, line long, ecg double"
    ).withColumns({"eda": F.lit(1.0), "temp": F.lit(1.0), "target": F.lit(0.0)})
    out = clean.typed_projection(raw, SCHEMA, ingest_order="line")
    assert rows(out.select("worker_id", "time_idx", "timestamp", "ecg")) == [
        ("a", 0, 0.0, 3.0),
        ("a", 1, 1.0, 1.0),
        ("b", 0, 0.0, 2.0),
    ]
    with pytest.raises(ValueError, match="ingest_order"):
        clean.typed_projection(raw, SCHEMA)


def test_category_codes_with_null(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("abcdefgh",), ("abcdefga",)], "c string")
    want = [(None, -1), ("a", 0), ("abcdefga", 1), ("abcdefgh", 2), ("b", 3), ("b", 3)]
    coded = clean.category_codes(df, "c", "code", clean.label_codes(df, "c"))
    assert sorted(rows(coded.select("c", "code")), key=str) == sorted(want, key=str)
    assert clean.label_codes(df.where("false"), "c").count() == 0


def test_codes_of_a_million_labels_with_a_common_prefix(spark):
    labels = spark.range(1_000_000).select(F.format_string("a-long-common-prefix-ß-%07d", "id").alias("c"), "id")
    codes = clean.label_codes(labels.unionAll(labels), "c")
    joined = codes.join(labels, F.col("_label") == F.col("c"))
    assert joined.where("id = _code").count() == joined.count() == codes.count() == 1_000_000
    assert codes.withColumn("p", F.input_file_name()).groupBy("p").count().count() > 1


def test_min_rows(spark):
    df = spark.createDataFrame([(w,) for w in "aaabbc"], "w string")
    assert rows(clean.min_rows_per_worker(df, "w", 2)) == [("a",)] * 3 + [("b",)] * 2
    assert clean.min_rows_per_worker(df, "w", 1) is df


def test_finite_guard(spark):
    df = spark.createDataFrame([("train", 1.0), ("val", float("inf"))], "split string, x double")
    with pytest.raises(ValueError, match="val .* 'x'"):
        clean.require_finite(df, ["x"], "split")
    assert clean.require_finite(df.where("split = 'train'"), ["x"], "split")


@pytest.mark.parametrize("keep", [1, 2, 3, 7, 10, 49, 50, 51])
def test_even_cap_equals_truncated_linspace(spark, keep):
    import numpy as np

    for n in (1, 2, 13, 50, 97):
        df = spark.range(n).withColumn("w", F.lit("a")).withColumnRenamed("id", "t")
        got = [r.t for r in sample.cap(df, ["w"], ["t"], keep, WHOLE).orderBy("t").collect()]
        want = list(range(n)) if n <= keep else np.linspace(0, n - 1, keep).astype(int).tolist()
        assert got == want, (n, keep)


def test_keep_last_follows_the_order_column(spark):
    data = [("a", 1, "x"), ("a", 3, None), ("a", 2, "z"), ("b", 9, "q")]
    df = spark.createDataFrame(data, "k string, o int, v string")
    assert rows(relate.keep_last(df, ["k"], "o").select("k", "o", "v")) == [("a", 3, None), ("b", 9, "q")]


def test_availability_counts_anything_but_a_dash(spark):
    df = spark.createDataFrame([(" 1 ", "x", "-"), ("2", " - ", None)], "ID string, `Rest_0` string, `a-1` string")
    assert rows(relate.availability(df)) == [("1", "rest_0"), ("2", "a-1")]


def test_attach_static_prefers_profile_then_frame_then_default(spark):
    df = spark.createDataFrame([("a", 5, 6.0), ("b", 7, 8.0)], "worker_id string, specialization_index int, ecg double")
    static = spark.createDataFrame(
        [("a", 1, 2, 0.5, 0.25)],
        "worker_id string, specialization_index int, experience_level int, baseline_mu_ecg double, "
        "baseline_sigma_ecg double",
    )
    names = ["worker_id", "specialization_index", "experience_level", "baseline_mu_ecg", "baseline_sigma_ecg"]
    on = relate.attach_static(df, static, ["ecg"], True).select(*names)
    assert rows(on) == [("a", 1, 2, 0.5, 0.25), ("b", 7, 1, 0.0, 1.0)]
    off = relate.attach_static(df, static, ["ecg"], False).select(*names)
    assert rows(off) == [("a", 0, 1, 0.5, 0.25), ("b", 0, 1, 0.0, 1.0)]


def test_first_rows_limit_runs_before_the_exchange(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id")
    plan = sample.first_rows(events, "user_id", "event_id", 3, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_availability_aggregates_ids_and_not_pairs(spark):
    """More columns than a number has bits, two of one name, IDs on several rows, one without an ID."""
    names = [f"t{i}" for i in range(70)] + [" T0 "]
    data = [(" a", *["-"] * 70, "x"), ("a ", "x", *["-"] * 69, None), (None, *["-"] * 69, "y", "-"), ("b", *[" - "] * 71)]
    df = spark.createDataFrame(data, "ID string, " + ", ".join(f"`{n}` string" for n in names))
    pairs = relate.availability(df)
    assert sorted(map(str, rows(pairs))) == sorted(map(str, [("a", "t0"), (None, "t69")]))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    some = spark.createDataFrame([("a", "t0", 1), ("a", "t1", 2), ("b", "t0", 3), (None, "t69", 4), ("a", None, 5)], "ID string, task_key string, n int")
    assert rows(relate.where_available(some.unionAll(some), df)) == [("a", "t0", 1)] * 2
    assert plan.index("Generate") < plan.index("Aggregate") and "Expand" not in plan[plan.index("Aggregate") :]
