"""Nested subject records (one row per subject, channels as arrays of axes) to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.functions import scalar as S
from signalspark.operators import clean
from signalspark.schema import SignalSchema

# Channel names of the record format, with the wrist stand-in of each chest channel.
CHANNELS = {
    "ecg": ("ECG", "BVP"),
    "eda": ("EDA", "EDA"),
    "temp": ("Temp", "TEMP"),
    "resp": ("Resp", None),
    "accel": ("ACC", "ACC"),
}


def _axis_mean(channel: Column) -> Column:
    return F.transform(channel, lambda axes: F.aggregate(axes, F.lit(0.0), lambda a, x: a + x) / F.size(axes))


def _channel(df: DataFrame, chest: str, wrist: str | None) -> Column:
    signal = df.schema["signal"].dataType
    sides = []
    for side, name in (("chest", chest), ("wrist", wrist)):
        if name and side in signal.fieldNames() and name in signal[side].dataType.fieldNames():
            sides.append(F.col(f"signal.{side}.{name}").cast("array<array<double>>"))
    return _axis_mean(F.coalesce(*sides)) if sides else F.lit(None).cast("array<double>")


def explode_records(
    df: DataFrame, schema: SignalSchema, subject: str = "subject", include_amusement: bool = False
) -> DataFrame:
    """One row per sample: chest channels, wrist ones where absent, cut to the shortest, labels recoded.

    Rows of unlabelled protocols are dropped. Exploding is narrow: nothing is shuffled.
    """
    channels = {c: _channel(df, *names) for c, names in CHANNELS.items()}
    wide = df.select(F.col(subject).alias("_subject"), F.col("label").alias("_label"), *[
        v.alias(c) for c, v in channels.items()
    ])
    core = ["_label", "ecg", "eda", "temp"]
    complete = F.lit(True)
    for c in core:
        complete = complete & F.col(c).isNotNull()
    whole = wide.withColumn(
        "_ok", F.when(complete & (F.size("_label") > 0), True).otherwise(
            F.raise_error(F.concat(F.lit("incomplete record of subject "), F.col("_subject").cast("string")))
            .cast("boolean")
        )
    )
    lengths = [F.size(c) for c in core] + [
        F.when(F.col(c).isNotNull(), F.size(c)).otherwise(F.lit(2**31 - 1)) for c in ("resp", "accel")
    ]
    n = F.least(*lengths)
    cells = F.arrays_zip(
        F.slice("_label", 1, n).alias("label"),
        *[F.slice(F.coalesce(c, F.array().cast("array<double>")), 1, n).alias(c) for c in CHANNELS],
    )
    rows = whole.where("_ok").select("_subject", F.posexplode(cells).alias("_at", "_row"))
    code = F.col("_row.label").cast("double")
    labels = S.protocol_columns(code, include_amusement, names=False)
    typed = rows.select(
        S.subject_id(F.col("_subject")).alias(schema.worker),
        F.col("_at").cast("double").alias(schema.timestamp),
        F.col("_at").alias(schema.time_idx),
        *[F.col(f"_row.{c}").alias(c) for c in CHANNELS],
        labels["name"].alias(schema.protocol),
        labels["stress"].alias(schema.stress),
        labels["comfort"].alias(schema.comfort),
    )
    return clean.has_targets(typed, schema)
