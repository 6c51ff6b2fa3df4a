import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.functions import arrays as A
from signalspark.functions import samples as N
from signalspark.functions import scalar as S


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("VR-Job Simulator", "vr-job-sim"),
        ("cobot-task-1", "cobot-task"),
        ("  Manual  Task ", "manual-task"),
        ("a--b---3", "a-b"),
        (None, "nan"),
        ("hanoi", "hanoi"),
    ],
)
def test_class_label(spark, text, label):
    assert one(spark, S.class_label(F.lit(text).cast("string"))) == label


def test_task_key(spark):
    assert one(spark, S.task_key(F.lit("cobot-task"), F.lit(3))) == "cobot-task-3"
    assert one(spark, S.task_key(F.lit("rest"), F.lit(2))) == "rest_0"


@pytest.mark.parametrize(
    ("text", "value"),
    [("1.5", 1.5), (" -2e3 ", -2000.0), ("NaN", None), ("12d", None), ("", None), ("0x10", None), (".5", 0.5)],
)
def test_number(spark, text, value):
    assert one(spark, S.number(F.lit(text), text=True)) == value


def test_infinity_is_a_number_but_not_finite(spark):
    assert one(spark, S.number(F.lit("-inf"), text=True)) == float("-inf")
    assert one(spark, S.finite(F.lit("-inf"), text=True)) is None


def test_rating_and_threshold(spark):
    assert one(spark, S.rating_to_unit(F.lit(None).cast("double"))) == 0.5
    assert one(spark, S.rating_to_unit(F.lit(9.0))) == 1.0
    assert one(spark, S.threshold_label(F.lit(None).cast("double"), 40)) == 0.0
    assert one(spark, S.threshold_label(F.lit(40.0), 40)) == 1.0


@pytest.mark.parametrize(("raw", "loose", "strict"), [("s2", "S2", "S2"), (" S07", "S07", "S7"), ("x", "Sx", None)])
def test_subject_ids(spark, raw, loose, strict):
    assert one(spark, S.subject_id(F.lit(raw))) == loose
    assert one(spark, S.strict_subject_id(F.lit(raw))) == strict


def test_bucket_is_stable(spark):
    values = [one(spark, S.stable_bucket(F.lit(w), 5)) for w in ("a", "b", "a")]
    assert values[0] == values[2] and all(0 <= v < 5 for v in values)


@pytest.mark.parametrize(
    ("samples", "found"),
    [
        ([0.0, 1, 0], [1]),
        ([0.0, 1, 1, 1, 0], [2]),
        ([0.0, 1, 1, 0], [1]),
        ([1.0, 1, 0], []),
        ([0.0, 1, 1], []),
        ([0.0, 1, 1, 2, 0], [3]),
        ([3.0, 1, 2, 1, 5], [2]),
        ([1.0, 2], []),
    ],
)
def test_peaks(spark, samples, found):
    assert one(spark, A.peaks(F.array(*[F.lit(float(x)) for x in samples]))) == found
    assert np.nonzero(N.peak_mask(np.array([samples])))[1].tolist() == found


def greedy(positions, heights, distance):
    kept = []
    for p in sorted(positions, key=lambda p: (-heights[p], -p)):
        if all(abs(p - k) >= distance for k in kept):
            kept.append(p)
    return sorted(kept)


@pytest.mark.parametrize("distance", [1, 3, 5, 8])
def test_spaced_peaks(spark, distance):
    rng = np.random.default_rng(distance)
    windows = rng.integers(0, 6, size=(40, 50)).astype(float)
    mask = N.peak_mask(windows)
    kept = N.thin(mask, windows, distance)
    df = spark.createDataFrame([(w.tolist(),) for w in windows], "w array<double>").coalesce(1)
    jvm = [r.v for r in df.select(A.spaced(A.peaks(F.col("w")), F.col("w"), distance).alias("v")).collect()]
    for row in range(len(windows)):
        want = greedy(np.nonzero(mask[row])[0].tolist(), windows[row], distance)
        assert np.nonzero(kept[row])[0].tolist() == want == jvm[row]


@pytest.mark.parametrize("distance", [3, 30, 200, 5_000])
def test_spaced_peaks_at_large_distances(distance):
    rng = np.random.default_rng(distance)
    windows = np.stack([rng.normal(size=3_000), rng.integers(0, 3, 3_000), np.arange(3_000) + 9 * (-1.0) ** np.arange(3_000), np.zeros(3_000)])
    mask = N.peak_mask(windows)
    kept = N.thin(mask, windows, distance)
    for row in range(len(windows)):
        assert np.nonzero(kept[row])[0].tolist() == greedy(np.nonzero(mask[row])[0].tolist(), windows[row], distance)


@pytest.mark.parametrize(("length", "hz"), [(3, 4.0), (4, 4.0), (10, 4.0), (60, 4.0), (9, 0.02), (200, 64.0), (200, 32.0), (200, 32.5), (700, 250.0), (301, 1000.0)])
def test_tonic_is_a_same_size_convolution(spark, length, hz):
    x = np.random.default_rng(length).normal(size=length)
    want = x
    if length > 3:
        kernel = max(3, int(min(length - 1, hz * 2)))
        want = np.convolve(x, np.ones(kernel) / kernel, mode="same")
    assert np.allclose(N.tonic_level(x[None, :], hz)[0], want, atol=1e-12)
    if length <= 60:
        got = one(spark, A.tonic(F.array(*[F.lit(float(v)) for v in x]), length, hz))
        assert np.allclose(got, want, atol=1e-12)


def welch(x, fs=4.0):
    """Averaged one-sided Hann periodogram with half-overlapping segments and the mean removed."""
    n = min(64, len(x))
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    starts = range(0, len(x) - n + 1, n - n // 2)
    power = np.zeros(n // 2 + 1)
    for s in starts:
        part = x[s : s + n] - x[s : s + n].mean()
        p = np.abs(np.fft.rfft(part * taper)) ** 2 / (fs * (taper**2).sum())
        p[1 : (None if n % 2 else -1)] *= 2
        power += p
    return np.fft.rfftfreq(n, 1 / fs), power / len(starts)


@pytest.mark.parametrize("count", [7, 8, 21, 26, 64, 70, 150])
def test_beat_spectrum(spark, count):
    gaps = np.random.default_rng(count).uniform(0.4, 1.5, size=count)
    row = spark.range(1).select(F.array(*[F.lit(float(g)) for g in gaps]).alias("g"))
    jvm = row.select(*[v.alias(k) for k, v in A.beat_spectrum(F.col("g")).items()]).first().asDict()
    arrow = N._spectrum(np.zeros(count, dtype=int), gaps, np.array([count]))
    want = {}
    if count >= 8:
        freq, power = welch(gaps)
        for name, (low, high) in {"LF": (0.04, 0.15), "HF": (0.15, 0.40)}.items():
            inside = (freq >= low) & (freq < high)
            want[name] = np.trapezoid(power[inside], freq[inside]) if inside.any() else None
        if want["HF"] and want["LF"] is not None:
            want["LF_HF"] = want["LF"] / want["HF"]
    for name in ("LF", "HF", "LF_HF"):
        value = want.get(name)
        if value is None:
            assert jvm[name] is None and np.isnan(arrow[name][0])
        else:
            assert np.isclose(jvm[name], value) and np.isclose(arrow[name][0], value)
