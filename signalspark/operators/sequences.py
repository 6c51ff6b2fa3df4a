"""Encoder/decoder examples for sequence models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.operators import clean, relate, sample
from signalspark.operators.windows import Cutter
from signalspark.schema import SignalSchema


def categories(schema: SignalSchema) -> list[str]:
    return [schema.worker, schema.specialization, schema.experience, schema.phase]


def reindex(df: DataFrame, schema: SignalSchema, step: int = 1) -> DataFrame:
    """Text categories and a gap-free time index per (split, worker), keeping every ``step``-th row.

    Rows already know their place in the split, so this is arithmetic, not another numbering.
    """
    text = {c: F.col(c).cast("string") for c in categories(schema) if c in df.columns}
    step = max(1, step)
    kept = df.where(F.col("_seg_pos") % step == 0) if step > 1 else df
    return kept.withColumns(text).withColumns(
        {
            "_seg_pos": F.floor(F.col("_seg_pos") / step).cast("long"),
            "_seg_n": F.ceil(F.col("_seg_n") / step).cast("long"),
        }
    ).withColumn(schema.time_idx, F.col("_seg_pos").cast("int"))


def pad_unseen(df: DataFrame, schema: SignalSchema, target: str) -> DataFrame:
    """One neutral training row for each worker that training lacks, cloned from training's first row."""
    train, rest = df.where(F.col("split") == "train"), df.where(F.col("split") != "train")
    new = relate.unseen(train, [rest], schema.worker)
    template = sample.top_k(
        train.withColumn("_none", F.lit(0)), "_none", 1, [schema.worker, schema.time_idx]
    ).drop(schema.worker, "_none")
    blank = {c: F.lit(0.0) for c in schema.physiology if c in df.columns} | {target: F.lit(0.0)}
    blank[schema.time_idx] = F.lit(0).cast("int")
    places = {"_seg_pos": 0, "_seg_n": 1}
    blank |= {c: F.lit(v).cast("long") for c, v in places.items() if c in df.columns}
    # The template is one row: a proven broadcast.
    rows = new.crossJoin(F.broadcast(template)).withColumns(blank)
    return df.unionByName(rows.select(*df.columns))


def sequence_set(df: DataFrame, cutter: Cutter, target: str, use_profiles: bool) -> DataFrame:
    """Full encoder of ``length`` steps and decoder of ``horizon`` steps around every window.

    Unknown reals (signals) have an encoder only; known ones (context, hazard, profile, phase) both parts. A null
    keeps its step (in a signal or known real of the encoder as NaN).
    """
    schema = cutter.schema
    known = [*schema.context, schema.hazard]
    if use_profiles:
        known += [f"baseline_{s}_{c}" for s in ("mu", "sigma") for c in schema.physiology]
    label = cutter.length + cutter.horizon - 1
    time = F.col(schema.time_idx).cast("int")
    scalars = {"start_idx": (time, 0), "label_time_idx": (time, label)}
    scalars |= {c: (F.col(c), 0) for c in (schema.specialization, schema.experience)}
    arrays = {f"enc_{c}": cutter.run(c) for c in [*schema.physiology, *known]}
    arrays[f"enc_{schema.phase}"] = (F.col(schema.phase), 0, cutter.length)
    arrays |= {f"dec_{c}": (F.col(c), cutter.length, cutter.horizon) for c in [*known, schema.phase]}
    arrays["dec_target"] = (F.col(target), cutter.length, cutter.horizon)
    windows = cutter.take(df, scalars | {"y": (F.col(target), label)}, arrays)
    return windows.select(*[c for c in windows.columns if c != "y"], "y")


def last_per_series(windows: DataFrame, worker: str, order: str = "start_idx") -> DataFrame:
    """The latest window of each series: a max, so windows collapse before the exchange."""
    return relate.keep_last(windows, [worker, "split"], order)


def set_sizes(windows: DataFrame, worker: str, label: str) -> DataFrame:
    """Windows, series and label counts per split."""
    pairs = windows.groupBy("split", worker).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(label) == 1).cast("long")).alias("p")
    )
    return pairs.groupBy("split").agg(
        F.sum("n").alias("windows"),
        F.count(worker).alias("last_windows"),
        F.sum("p").alias("positives"),
        (F.sum("n") - F.sum("p")).alias("negatives"),
    )


def index_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Category indices in text order, fitted on training; unseen values and null share one extra slot.

    The labels stay in Spark: only their number reaches the driver, however many there are.
    """
    for c in columns:
        codes = clean.label_codes(df.where(F.col("split") == "train"), c)
        unseen = codes.count()
        joined = df.join(codes, F.col(c) == F.col("_label"), "left")
        df = joined.withColumn(f"{c}_code", F.coalesce("_code", F.lit(unseen)).cast("double")).drop("_label", "_code")
    return df
