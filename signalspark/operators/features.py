"""Signal features per window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.functions import arrays as A
from signalspark.functions import samples as N
from signalspark.operators.windows import Cutter

CORE = ("ecg", "eda", "temp")
LAST = ("distance_to_robot", "robot_speed")
KEYS = ("split", "start_idx", "end_idx", "label_time_idx", "y_stress", "y_comfort")


def _motion(cutter: Cutter) -> dict[str, Column]:
    """Context at the window's last row; a time-to-contact proxy when both columns exist."""
    return _motion_of(cutter, {c: cutter.last(c) for c in LAST if c in cutter.schema.signals})


def _motion_of(cutter: Cutter, last: dict[str, Column]) -> dict[str, Column]:
    present = set(cutter.schema.signals)
    distance, speed = (last[c] if c in present else F.lit(0.0) for c in LAST)
    out = {}
    if set(LAST) <= present:
        out["ttc_proxy"] = distance / F.greatest(speed, F.lit(1e-3))
    return out | {"distance_last": distance, "speed_last": speed}


def _slope(cutter: Cutter, column: str) -> Column:
    """Least-squares slope over the window; 0 where undefined. The aggregate centres x, so far rows are safe."""
    slope = F.regr_slope(F.col(column), F.col("_seg_pos").cast("double")).over(cutter.frame)
    return F.coalesce(slope, F.lit(0.0))


def feature_table(
    df: DataFrame,
    cutter: Cutter,
    hz: float,
    frequency: bool = True,
    scr_threshold: float = 0.05,
    scr_distance: int = 3,
    in_jvm: bool = False,
) -> DataFrame:
    """Keys, labels and one column per feature. Channels must be gap free.

    A window's samples are sliced out and summarised where they are, in one pass of each task over its sorted rows: the
    work falls with the step and the arrays are never shuffled. ``in_jvm`` takes frame aggregates of every row and
    array expressions instead, which give the same values more slowly.
    """
    schema = cutter.schema
    absent = sorted(set(CORE) - set(schema.signals))
    if absent:
        raise ValueError(f"features need the channels {absent}")
    extras = [c for c in ("resp", "accel") if c in schema.signals]
    beats = [*N.BEAT, *(N.SPECTRUM if frequency else ()), *N.SKIN]
    if not in_jvm:
        used = [c for c in LAST if c in schema.signals]
        ends = {f"_last_{c}": (F.col(c), cutter.length - 1) for c in used}
        runs = {"_ecg": cutter.run("ecg"), "_eda": cutter.run("eda")}
        runs |= {f"_{c}": cutter.known(c) for c in ("temp", *extras)}
        summary = N.window_summary(cutter.length, hz, frequency, scr_threshold, scr_distance, ("temp", *extras))
        windows = cutter.take(df, cutter.marks() | ends, runs, summary)
        motion = _motion_of(cutter, {c: F.col(f"_last_{c}") for c in used})
        temp = ["temp_mean", "temp_std", "temp_slope"]
        rest = [f"{c}_{m}" for c in extras for m in ("mean", "std")]
        return windows.select(schema.worker, *KEYS, *beats, *temp, *[v.alias(k) for k, v in motion.items()], *rest)
    frame = cutter.frame
    cheap = {"temp_mean": F.avg("temp").over(frame), "temp_std": F.stddev_pop("temp").over(frame)}
    cheap["temp_slope"] = _slope(cutter, "temp")
    cheap |= _motion(cutter)
    for extra in extras:
        cheap[f"{extra}_mean"] = F.avg(extra).over(frame)
        cheap[f"{extra}_std"] = F.stddev_pop(extra).over(frame)
    columns = [*cutter.meta(), *[v.alias(k) for k, v in cheap.items()]]
    columns += [cutter.samples("ecg").alias("_ecg"), cutter.samples("eda").alias("_eda")]
    windows = cutter.cut(df, columns)
    sampled = _sample_features(windows, cutter.length, hz, frequency, scr_threshold, scr_distance)
    return sampled.select(schema.worker, *KEYS, *beats, *cheap)


def _sample_features(
    windows: DataFrame, length: int, hz: float, frequency: bool, scr_threshold: float, scr_distance: int
) -> DataFrame:
    """Beat and skin features as array expressions, staged so that each intermediate is computed once."""
    staged = windows.withColumns(
        {"_beats": A.beats(F.col("_ecg"), hz), "_tonic": A.tonic(F.col("_eda"), length, hz)}
    ).withColumns(
        {
            "_gaps": A.intervals(F.col("_beats"), hz),
            "_phasic": F.zip_with("_eda", "_tonic", lambda raw, level: raw - level),
        }
    )
    staged = staged.withColumn("_scr", A.skin_responses(F.col("_phasic"), scr_threshold, scr_distance))
    out = A.beat_statistics(F.col("_gaps"), length)
    if frequency:
        out |= A.beat_spectrum(F.col("_gaps"))
    return staged.withColumns(
        out
        | {
            "scl_mean": A.mean(F.col("_tonic")),
            "scl_var": A.spread(F.col("_tonic")),
            "scr_count": F.size("_scr").cast("double"),
            "scr_mean_amp": F.coalesce(A.mean(F.col("_scr")), F.lit(0.0)),
        }
    )


def feature_names(table: DataFrame, worker: str = "worker_id") -> list[str]:
    return [c for c in table.columns if c not in KEYS and c != worker]
