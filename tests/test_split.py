import pytest
from helpers import rows
from pyspark.sql import functions as F

from signalspark.layout import SeriesLayout
from signalspark.operators import split
from signalspark.schema import SignalSchema

SCHEMA = SignalSchema()


def series(spark, sizes):
    data = [(w, t) for w, n in sizes.items() for t in range(n)]
    return spark.createDataFrame(data, "worker_id string, time_idx int")


@pytest.mark.parametrize("n", [1, 2, 7, 90, 100])
def test_time_split_truncates_double_products(spark, n):
    parts = split.by_time(series(spark, {"a": n}), SCHEMA, 0.7, 0.15, 0.15, SeriesLayout())
    counts = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    first, second = int(n * 0.7), int(n * (0.7 + 0.15))
    assert [counts.get(s, 0) for s in split.SPLITS] == [first, second - first, n - second]
    assert parts.where("_seg_pos < 0 or _seg_pos >= _seg_n").isEmpty()
    assert split.out_of_order(parts, SCHEMA).isEmpty()


def test_ratios_must_sum_to_one(spark):
    with pytest.raises(ValueError, match="sum to 1"):
        split.by_time(series(spark, {"a": 3}), SCHEMA, 0.7, 0.2, 0.2, SeriesLayout())


def test_chronology_violation_is_raised(spark):
    df = series(spark, {"a": 4}).withColumn("split", F.when(F.col("time_idx") == 0, "val").otherwise("train"))
    with pytest.raises(ValueError, match="worker a"):
        split.require_chronological(df, SCHEMA)


def test_subject_split_drops_unlisted_and_checks_lists(spark):
    df = series(spark, {"a": 2, "b": 1, "c": 1})
    table = split.assignment_table(spark, SCHEMA, {"train": ["a"], "test": ["c"]})
    placed = split.by_subject(df, SCHEMA, split.check_assignment(df, SCHEMA, table), SeriesLayout())
    assert rows(split.manifest(placed, SCHEMA)) == [("a", 0, "train"), ("a", 1, "train"), ("c", 0, "test")]
    for groups, message in (({"train": ["a"], "val": ["a"]}, "overlap"), ({"train": ["zz"]}, "not in the data")):
        with pytest.raises(ValueError, match=message):
            split.check_assignment(df, SCHEMA, split.assignment_table(spark, SCHEMA, groups))


def load_of(spark, entries):
    return spark.createDataFrame([(f"w{i:02d}", r, p) for i, (r, p) in enumerate(entries)],
                                 "worker_id string, rows long, positives long")


def test_balanced_holdout_partitions_workers(spark):
    load = load_of(spark, [(50 + i % 7, (i * 13) % 40) for i in range(20)])
    chosen = split.balanced_holdout(load, SCHEMA, 0.7, 0.15, 20, 20)
    stats = {r["split"]: r for r in split.split_statistics(load, chosen, "worker_id").collect()}
    assert [stats[s]["subjects"] for s in split.SPLITS] == [14, 3, 3]
    assert stats["val"]["positives"] >= 20 and stats["test"]["positives"] >= 20


def test_balanced_holdout_first_steps_by_hand(spark):
    # Ten workers, goals 7/2/1 -> test is lifted to 2, train falls to 6. The richest worker (9 of 18 positives)
    # misses train's goal of 13 by 4/13, val's of 3 by 6/3 and test's of 2 by more: train takes it.
    load = load_of(spark, [(10, 9)] + [(10, 1)] * 9)
    chosen = {r["worker_id"]: r["split"] for r in split.balanced_holdout(load, SCHEMA, 0.7, 0.15, 1, 1).collect()}
    assert chosen["w00"] == "train"
    assert sorted(chosen.values()).count("train") == 6 and sorted(chosen.values()).count("val") == 2


def test_balanced_holdout_repairs_starved_splits(spark):
    load = load_of(spark, [(10, 30), (10, 20), (10, 10)] + [(10, 0)] * 9)
    chosen = split.balanced_holdout(load, SCHEMA, 0.7, 0.15, 8, 8)
    stats = {r["split"]: r for r in split.split_statistics(load, chosen, "worker_id").collect()}
    assert stats["val"]["positives"] >= 8 and stats["test"]["positives"] >= 8
    assert sum(s["subjects"] for s in stats.values()) == 12


def test_balanced_holdout_needs_nine_workers(spark):
    with pytest.raises(ValueError, match="9 workers"):
        split.balanced_holdout(load_of(spark, [(1, 1)] * 8), SCHEMA, 0.7, 0.15, 1, 1)


def test_uncovered_names_single_class_splits(spark):
    df = spark.createDataFrame(
        [("train", 0.0), ("train", 1.0), ("val", 1.0), ("test", 0.0), ("test", 1.0)], "split string, y_stress double"
    )
    assert [r["split"] for r in split.uncovered(df, SCHEMA, 1, 1).collect()] == ["val"]
    assert [r["split"] for r in split.uncovered(df, SCHEMA, 1, 2).orderBy("split").collect()] == ["test", "val"]


def test_uncovered_names_a_split_without_rows(spark):
    df = spark.createDataFrame([("train", 0.0), ("train", 1.0), ("test", 0.0), ("test", 1.0)], "split string, y_stress double")
    assert [r["split"] for r in split.uncovered(df, SCHEMA, 20, 1).collect()] == ["val"]


def test_balanced_holdout_deals_equal_workers_in_stretches(spark):
    load = load_of(spark, [(10, 3)] * 50 + [(10, 0)] * 50)
    chosen = split.balanced_holdout(load, SCHEMA, 0.7, 0.15, 5, 5)
    stats = {r["split"]: r["subjects"] for r in split.split_statistics(load, chosen, "worker_id").collect()}
    assert stats == {"train": 70, "val": 15, "test": 15}
