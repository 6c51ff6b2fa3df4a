"""Rows in several triggers and out of order must give what one ordered batch gives; late ones come out apart."""

import numpy as np
import pytest
from test_normalize import online

from signalspark.streaming import online as stream

FIELDS = "worker_id string, t long, x double, y double"
MINUTE = 60_000_000
ARRIVAL = stream.Arrival("10 minutes", slice_ms=5 * 60_000, idle_ms=3_600_000)
DATA = {w: np.random.default_rng(len(w) + n).normal(size=n) for w, n in {"a": 60, "bb": 9, "c": 3, "dd": 1}.items()}


def files(spark, folder, parts):
    """One file and trigger for each list of (worker, minute)."""
    for i, part in enumerate(parts):
        rows = [(w, t * MINUTE, float(DATA[w][t]), float(t)) for w, t in part]
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.parquet(str(folder / f"in/{i}"))
    reader = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).option("latestFirst", False)
    df = reader.parquet(str(folder / "in/*"))
    return stream.with_heartbeats(df, str(folder / "beats"))


@pytest.fixture
def source(spark, tmp_path):
    """Each file holds the minutes of a range in any order, overlapping its neighbours by less than the delay."""
    rng = np.random.default_rng(0)
    due = {(w, t): min(3, (t + int(rng.integers(0, 8))) // 16) for w, v in DATA.items() for t in range(len(v))}
    parts = [[r for r in due if due[r] == i] for i in range(4)]
    for part in parts:
        rng.shuffle(part)
    return files(spark, tmp_path, [[(w, int(t)) for w, t in part] for part in parts])


def drained(df, tmp_path):
    return stream.drain(df, str(tmp_path / "out"), str(tmp_path / "beats"), "t")


def test_normalize_stream_equals_batch_for_all_workers(source, tmp_path):
    out = drained(stream.normalize_stream(source, ["x"], "worker_id", ["t"], 0.2, 6, ARRIVAL), tmp_path)
    got = out.rows.toPandas().sort_values(["worker_id", "t"])
    assert out.late_count() == 0
    for worker, x in DATA.items():
        part = got[got.worker_id == worker]
        assert part.t.tolist() == [t * MINUTE for t in range(len(x))]
        assert np.allclose(part[["x", "baseline_mu_x", "baseline_sigma_x"]].to_numpy(), online(list(x), 0.2, 6))


@pytest.mark.parametrize(("length", "horizon", "step"), [(4, 1, 1), (6, 2, 3)])
def test_window_stream(source, tmp_path, length, horizon, step):
    out = drained(stream.window_stream(source, "x", "y", "worker_id", ["t"], length, horizon, step, ARRIVAL), tmp_path)
    got = {(r.worker_id, r.start_idx): (r.mean, r.y) for r in out.rows.collect()}
    want = {
        (w, s): (v[s : s + length].mean(), float(s + length + horizon - 1))
        for w, v in DATA.items()
        for s in range(0, len(v) - length - horizon + 1, step)
    }
    assert got.keys() == want.keys() and out.late_count() == 0
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_late_rows_come_out_apart(spark, tmp_path):
    """Minutes 2 to 4 of one worker come after their slice was released; another worker's first row is as old, not late."""
    first = [("a", t) for t in (0, 1, *range(5, 60))]
    df = files(spark, tmp_path, [first, [("bb", 8)], [("a", 2), ("a", 3), ("a", 4), ("c", 1)]])
    out = drained(stream.normalize_stream(df, ["x"], "worker_id", ["t"], 0.2, 6, ARRIVAL), tmp_path)
    late = {(r.worker_id, r.t // MINUTE): r.x for r in out.late.collect()}
    assert late == {("a", t): DATA["a"][t] for t in (2, 3, 4)} and out.late_count() == 3
    got = out.rows.toPandas().sort_values(["worker_id", "t"])
    kept = [t for t in range(60) if t not in (2, 3, 4)]
    part = got[got.worker_id == "a"]
    assert part.t.tolist() == [t * MINUTE for t in kept]
    assert np.allclose(part[["x", "baseline_mu_x", "baseline_sigma_x"]].to_numpy(), online([DATA["a"][t] for t in kept], 0.2, 6))
    assert got[got.worker_id == "bb"].t.tolist() == [8 * MINUTE] and got[got.worker_id == "c"].t.tolist() == [MINUTE]


def test_open_slices_wait_for_the_next_call(source, tmp_path):
    df = stream.window_stream(source, "x", "y", "worker_id", ["t"], 4, 1, 1, ARRIVAL)
    some = {(r.worker_id, r.start_idx) for r in stream.drain(df, str(tmp_path / "out")).rows.collect()}
    every = {(r.worker_id, r.start_idx) for r in drained(df, tmp_path).rows.collect()}
    assert some < every and len(every) == 56 + 5


def test_rows_without_a_time_come_first(spark, tmp_path):
    """A null time beside known ones, a worker that has nothing else, and a time after the closing heartbeat's."""
    far = 9_000 * 365 * 24 * 60 * MINUTE
    data = [("a", t * MINUTE, float(t), float(t)) for t in range(1, 9)]
    data += [("a", None, 0.0, 0.0), ("a", far, 9.0, 9.0), ("bb", None, 1.0, 1.0), ("bb", None, 1.0, 2.0)]
    spark.createDataFrame(data, FIELDS).coalesce(1).write.parquet(str(tmp_path / "in"))
    df = stream.with_heartbeats(spark.readStream.schema(FIELDS).parquet(str(tmp_path / "in")), str(tmp_path / "beats"))
    out = drained(stream.window_stream(df, "x", "y", "worker_id", ["t"], 1, 1, 1, ARRIVAL), tmp_path)
    got = sorted((r.worker_id, r.start_idx, r.mean, r.y) for r in out.rows.collect())
    assert [g[:3] for g in got] == [("a", i, float(i)) for i in range(9)] + [("bb", 0, 1.0)]
    assert [g[3] for g in got[:9]] == [float(i + 1) for i in range(9)] and out.late_count() == 0
