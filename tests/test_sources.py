import os

import pytest
from helpers import rows
from pyspark.sql import functions as F

from signalspark import sinks
from signalspark.operators import clean
from signalspark.schema import SignalSchema
from signalspark.sources import csv, records, router, tables

SCHEMA = SignalSchema()


def put(root, name, text, encoding="utf-8"):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)


def test_scan_mixes_columns_and_skips_empty_files(spark, tmp_path):
    root = str(tmp_path)
    put(root, "a.csv", "ecg,eda\n1,2\n3,4\n")
    put(root, "deep/b.csv", "eda,temp\n5,6\n")
    put(root, "empty.csv", "")
    put(root, "header.csv", "only\n")
    put(root, "notes.txt", "x,y\n1,2\n")
    out = csv.generic(spark, root, SCHEMA)
    assert sorted(out.columns) == ["ecg", "eda", "temp", "worker_id"]
    got = sorted(rows(out.select("ecg", "eda", "temp", "worker_id")), key=str)
    assert got == sorted([("1", "2", None, "0"), ("3", "4", None, "0"), (None, "5", "6", "0")], key=str)
    put(root, "none/notes.txt", "x,y\n1,2\n")
    with pytest.raises(FileNotFoundError):
        csv.scan(spark, os.path.join(root, "none"))


def test_scan_of_many_small_files_with_odd_headers(spark, tmp_path):
    root = str(tmp_path)
    heads = ["a,b", "b,`c d`,a", '"x, y",a', "a,a,"]
    for k in range(400):
        width = len(csv.header_names(heads[k % 4]))
        put(root, f"d{k % 7}/f{k}.csv", heads[k % 4] + "\n\n" + ",".join(f"{k}-{i}" for i in range(width)) + "\n" + heads[k % 4] + "\n")
    out = csv.scan(spark, root, with_order=True)
    assert set(out.columns) - {*csv.SOURCE_ORDER, "_columns"} == {"a", "b", "`c d`", "x, y", "a1", "_c2"}
    got = {r["a"]: r for r in out.collect()}
    assert out.count() == 800  # a repeated header line is a row like any other
    assert got["0-0"]["b"] == "0-1" and got["1-2"]["`c d`"] == "1-1" and got["2-1"]["x, y"] == "2-0"
    assert got["3-0"]["a1"] == "3-1" and got["3-0"]["_c2"] == "3-2" and got["3-0"]["b"] is None


def test_time_of_exports_is_counted_per_file(spark, tmp_path):
    root = str(tmp_path)
    put(root, "S1.csv", "protocol_label,ecg\n" + "".join(f"1,{i}\n" for i in range(12)))
    put(root, "S2.csv", "protocol_label,ecg,time_idx\n2,0,5\n1,1,7\n")
    put(root, "S3.csv", "protocol_label,ecg,timestamp\n2,0,0.5\n1,1,0.25\n")
    df = csv.subject_exports(csv.scan(spark, root, with_order=True), SCHEMA)
    got = rows(df.selectExpr("worker_id", "int(ecg) as ecg", "double(time_idx) as i", "double(timestamp) as t"))
    want = [("S1", i, float(i), float(i)) for i in range(12)]
    assert got == sorted([*want, ("S2", 0, 5.0, 5.0), ("S2", 1, 7.0, 7.0), ("S3", 0, 0.0, 0.5), ("S3", 1, 1.0, 0.25)])


@pytest.mark.parametrize("stamp", [None, "timestamp"])
def test_csv_without_time_index_through_the_router(spark, tmp_path, stamp, cut_series):
    """Legacy columns; rows follow the source order, or a timestamp whose text would sort otherwise."""
    root = str(tmp_path)
    for name, first in (("a", 0), ("b", 60)):
        lines = [f"{'w' if i % 3 else 'v'},{i},{i},{i},{i % 2}" + (f",{1000 - i}" if stamp else "") for i in range(first, first + 60)]
        put(root, f"{name}.csv", "worker_id,hr,gsr,hrv_rmssd,target" + (",timestamp" if stamp else "") + "\n" + "\n".join(lines) + "\n")
    raw = router.load(spark, {"dataset": {"name": "csv", "path": root}}, SCHEMA)
    typed = clean.typed_projection(raw, SCHEMA, **clean.time_axis(raw, SCHEMA))
    got = typed.select("worker_id", "time_idx", "timestamp", F.col("ecg").cast("int").alias("ecg"), "y_stress")
    want = []
    for w, rest in (("v", (0,)), ("w", (1, 2))):
        own = [i for i in range(120) if i % 3 in rest]
        own = own[::-1] if stamp else own
        want += [(w, k, float(1000 - i if stamp else k), i, float(i % 2)) for k, i in enumerate(own)]
    assert rows(got) == sorted(want)


def test_subject_exports_decide_per_file(spark, tmp_path):
    root = str(tmp_path)
    put(root, "s2.csv", "protocol_label,ecg,eda,temp,time_idx\n1,1,1,1,0\nx,1,1,1,1\n2,1,1,1,2\n3,1,1,1,3\n")
    put(root, "S3.csv", "protocol_label,ecg,eda,temp,time_idx\nBaseline,1,1,1,0\nstress,1,1,1,1\nother,1,1,1,2\n")
    scanned = csv.scan(spark, root, with_order=True)
    out = csv.subject_exports(scanned, SCHEMA).select("worker_id", "time_idx", "protocol_label", "y_stress")
    assert rows(out) == [
        ("S2", "0", "baseline", 0.0),
        ("S2", "2", "stress", 1.0),
        ("S3", "0", "baseline", 0.0),
        ("S3", "1", "stress", 1.0),
    ]
    with_fun = csv.subject_exports(scanned, SCHEMA, include_amusement=True)
    assert rows(with_fun.where("time_idx = '3'").select("y_stress", "y_comfort_proxy")) == [(0.0, 0.7)]


def test_subject_dataset_through_the_router(spark, tmp_path):
    root = str(tmp_path)
    lines = "".join(f"{1 + i % 2},{i},{i},{i},{i}\n" for i in range(20))
    for name in ("S2", "S11"):
        put(root, f"{name}/{name}.csv", "protocol_label,ecg,eda,temp,time_idx\n" + lines)
    cfg = {"dataset": {"name": "wesad", "path": root, "subjects": ["2"], "downsample_factor": 3,
                       "max_rows_per_subject": 4}}
    frame = clean.typed_projection(router.load(spark, cfg, SCHEMA), SCHEMA)
    assert rows(frame.select("worker_id", "time_idx")) == [("S2", 0), ("S2", 6), ("S2", 12), ("S2", 18)]
    with pytest.raises(ValueError, match="subject filter"):
        router.load(spark, {"dataset": {**cfg["dataset"], "subjects": ["S9"]}}, SCHEMA)


def test_subject_folders(spark, tmp_path):
    root = str(tmp_path)
    put(root, "S2/a.csv", "x\n1\n")
    put(root, "s003/b.csv", "x\n2\n")
    put(root, "S4x/c.csv", "x\n3\n")
    kept, lost = csv.subject_folders(csv.scan(spark, root, with_order=True), ["S2", "s3", "04"])
    assert rows(kept.select("subject", "x")) == [("S2", "1"), ("S3", "2")]
    assert rows(lost) == [("S4",)]


RECORD = (
    "subject string, label array<int>, signal struct<chest: struct<ECG: array<array<double>>, "
    "EDA: array<array<double>>, Temp: array<array<double>>, Resp: array<array<double>>, ACC: array<array<double>>>, "
    "wrist: struct<BVP: array<array<double>>, TEMP: array<array<double>>>>"
)


def test_records(spark):
    one = [[float(i)] for i in range(5)]
    chest = (None, one, one[:4], None, [[1.0, 2.0, 6.0]] * 6)
    df = spark.createDataFrame([(" s7", [0, 1, 2, 3, 1], (chest, ([[9.0]] * 5, None)))], RECORD)
    out = records.explode_records(df, SCHEMA)
    got = rows(out.select("worker_id", "time_idx", "ecg", "eda", "accel", "resp", "protocol_label", "y_stress"))
    assert got == [
        ("S7", 1, 9.0, 1.0, 3.0, None, "baseline", 0.0),
        ("S7", 2, 9.0, 2.0, 3.0, None, "stress", 1.0),
    ]
    assert records.explode_records(df, SCHEMA, include_amusement=True).count() == 3
    broken = spark.createDataFrame([("x", [1], ((None, None, None, None, None), (None, None)))], RECORD)
    with pytest.raises(Exception, match="incomplete record"):
        records.explode_records(broken, SCHEMA).collect()


def feature_folder(root):
    head = "ID,Class,Repetition,Window,HRV_MeanNN,EDA_mean,EMG_RMSE,RRV_MeanBB,unused\n"
    bio = [
        "7,Cobot Task,0,1,1,1,1,1,z", "7,Cobot Task,0,0,2,1,1,1,z", "7,Rest,null,0,3,1,1,1,z",
        "7,Rest,,1,inf,1,1,1,z", "7,VR-Job Simulator,0,0,4,1,1,1,z", "8,Rest,0,0,5,1,1,1,z", "9,Rest,0,0,6,1,1,1,z",
    ]
    labels = [
        "7,cobot-task-1,0,10,1", "7,cobot-task,0,50,5", "7,rest,0,,", "7,vr-job-sim,0,40,2",
        "8,rest,0,90,9", "9,rest,0,1,1",
    ]
    put(root, "features/bio_features_60s.csv", head + "\n".join(bio) + "\n")
    put(root, "features/labels.csv", "ID,Class,Repetition,NASA,Valence\n" + "\n".join(labels) + "\n")
    put(
        root,
        "participants_task_overview.csv",
        "ID,rest_0,cobot-task-1,vr-job-sim_0\n7,✓,x,-\n8 ,x,x,x\n9,-,x,x\n",
        encoding="utf-8",
    )


@pytest.mark.parametrize("cut", [False, True])
def test_feature_tables(spark, tmp_path, request, cut):
    if cut:
        request.getfixturevalue("cut_series")
    feature_folder(str(tmp_path))
    cfg = {"dataset": {"name": "multiphysio", "path": str(tmp_path), "multiphysio": {"min_rows_per_worker": 1}}}
    frame = router.load(spark, cfg, SCHEMA)
    columns = ["worker_id", "time_idx", "protocol_label", "ecg", "y_stress", "y_comfort_proxy", "hazard_zone"]
    # Rest comes first in the overview; its second window is infinite and dropped after numbering. The later of
    # two equal label keys wins. The simulator task is not available to participant 7, nor rest to 9.
    assert rows(frame.select(*columns)) == [
        ("7", 0, "rest", 3.0, 0.0, 0.5, 0),
        ("7", 2, "cobot-task", 2.0, 1.0, 1.0, 1),
        ("7", 3, "cobot-task", 1.0, 1.0, 1.0, 1),
        ("8", 0, "rest", 5.0, 1.0, 1.0, 0),
    ]
    assert rows(frame.select("protocol_label", "specialization_index").distinct()) == [("cobot-task", 0), ("rest", 1)]
    kept = {**cfg["dataset"], "multiphysio": {"min_rows_per_worker": 2, "classes": ["rest", "Cobot-Task"]}}
    assert {r.worker_id for r in router.load(spark, {"dataset": kept}, SCHEMA).collect()} == {"7"}


@pytest.mark.parametrize("cut", [False, True])
def test_feature_tables_with_late_windows(spark, tmp_path, request, cut):
    if cut:
        request.getfixturevalue("cut_series")
    root = str(tmp_path)
    windows = [100_000, 70_000, 9_000, 65_536, 65_535, *range(200_000, 200_030), 1_000_000]
    lines = [f"7,Rest,0,{w},{w},1,1,1" for w in windows] + [f"7,Rest,{r},0,{-r},1,1,1" for r in (100_000, 70_000)]
    put(root, "features/bio_features_60s.csv", "ID,Class,Repetition,Window,HRV_MeanNN,EDA_mean,EMG_RMSE,RRV_MeanBB\n" + "\n".join(lines) + "\n")
    labels = [f"7,rest,{r},50,3" for r in (0, 70_000, 100_000)]
    put(root, "features/labels.csv", "ID,Class,Repetition,NASA,Valence\n" + "\n".join(labels) + "\n")
    put(root, "participants_task_overview.csv", "ID,rest_0\n7,x\n")
    cfg = {"dataset": {"name": "multiphysio", "path": root, "multiphysio": {"min_rows_per_worker": 1}}}
    got = [r.ecg for r in router.load(spark, cfg, SCHEMA).orderBy("time_idx").collect()]
    assert got == [*map(float, sorted(windows)), -70_000.0, -100_000.0]


def test_labels_need_their_columns(spark):
    bio = spark.createDataFrame([("1", "rest", "0", 0)], "ID string, Class string, Repetition string, Window int")
    with pytest.raises(ValueError, match="NASA"):
        tables.joined_rows(bio, bio.withColumn("_ingest", F.lit(1)), bio, tables.TableOptions(), "_ingest")


def test_raw_cache_round_trip(spark, tmp_path):
    df = spark.range(3).withColumn("x", F.lit(1.5))
    assert rows(sinks.cache_raw(df, str(tmp_path / "raw"))) == rows(df)
    assert rows(router.load(spark, {"dataset": {"name": "raw"}, "paths": {"raw_cache": str(tmp_path / "raw")}},
                            SCHEMA)) == rows(df)
