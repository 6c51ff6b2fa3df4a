"""Column defaults, typing and row guards of a signal frame."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalspark.functions import scalar as S
from signalspark.layout import SeriesLayout, number_rows, number_sorted
from signalspark.schema import OPTIONAL_CHANNELS, SignalSchema

# Older exports name the core signals differently.
LEGACY_SIGNALS = {"ecg": "hr", "eda": "gsr", "temp": "hrv_rmssd"}
#: Place of a row in its source, where that is known.
INGEST_ORDER = "ingest_order"


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def as_number(df: DataFrame, name: str, keep_infinite: bool = True):
    coerce = S.number if keep_infinite else S.finite
    return coerce(F.col(name), is_text(df, name))


def ensure_columns(
    df: DataFrame, schema: SignalSchema, ingest_order: str | None = None, layout: SeriesLayout | None = None
) -> DataFrame:
    """Fill in absent columns; raise for what cannot be derived.

    Row order is not a property of a distributed table, so a missing time axis needs ``ingest_order``, the
    column that carries the source order.
    """
    layout = layout or SeriesLayout()
    schema.require(df.columns, [schema.worker])
    if "target" in df.columns:
        target = F.coalesce(as_number(df, "target"), F.lit(0.0))
        if schema.stress not in df.columns:
            df = df.withColumn(schema.stress, (target >= 0.5).cast("double"))
        if schema.comfort not in df.columns:
            df = df.withColumn(schema.comfort, S.clip(1.0 - target, 0.0, 1.0))
    if schema.timestamp not in df.columns:
        if schema.time_idx not in df.columns:
            df = _count_up(df, schema, [ingest_order], schema.time_idx, layout)
        df = df.withColumn(schema.timestamp, F.col(schema.time_idx))
    if schema.time_idx not in df.columns:
        # Text would sort 10 before 9.
        df = df.withColumn("_time", as_number(df, schema.timestamp))
        df = _count_up(df, schema, ["_time", *([ingest_order] if ingest_order else [])], schema.time_idx, layout)
        df = df.drop("_time")
    for name, legacy in LEGACY_SIGNALS.items():
        if name not in df.columns and legacy in df.columns:
            df = df.withColumn(name, F.col(legacy))
    schema.require(df.columns)
    defaults = {
        schema.hazard: F.lit(0),
        schema.phase: F.lit("default"),
        schema.specialization: S.stable_bucket(F.col(schema.worker), 5),
        schema.experience: S.stable_bucket(F.col(schema.worker), 5) + 1,
    }
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def time_axis(df: DataFrame, schema: SignalSchema) -> dict:
    """What ``ensure_columns`` needs for a frame without a time index: its source order and how its series are cut."""
    if schema.time_idx in df.columns or INGEST_ORDER not in df.columns:
        return {}
    time = as_number(df, schema.timestamp) if schema.timestamp in df.columns else F.col(INGEST_ORDER)
    return {"ingest_order": INGEST_ORDER, "layout": SeriesLayout.fit(df.withColumn("_time", time), schema.worker, "_time")}


def _count_up(df: DataFrame, schema: SignalSchema, order: Sequence[str | None], out: str, layout) -> DataFrame:
    if None in order:
        raise ValueError(f"'{out}' is absent and no ingest_order column says how rows follow each other")
    return number_rows(df, [schema.worker], order, layout, pos=out, total="_n").drop("_n")


def typed_projection(df: DataFrame, schema: SignalSchema, **ensure) -> DataFrame:
    """The typed signal frame: known columns only, every one coerced, signals left nullable."""
    df = ensure_columns(df, schema, **ensure)

    def num(name: str):
        return as_number(df, name)

    def whole(name: str, default: int):
        return F.coalesce(num(name), F.lit(float(default))).cast("int").alias(name)

    def signal(name: str):
        if name not in df.columns:
            return F.lit(0.0).alias(name)
        return as_number(df, name, keep_infinite=False).alias(name)

    protocol = F.col(schema.protocol) if schema.protocol in df.columns else F.lit("unknown")
    extra = [c for c in OPTIONAL_CHANNELS if c in df.columns and c not in schema.signals]
    return df.select(
        F.col(schema.worker).cast("string").alias(schema.worker),
        F.coalesce(num(schema.timestamp), F.lit(0.0)).alias(schema.timestamp),
        whole(schema.time_idx, 0),
        protocol.cast("string").alias(schema.protocol),
        S.unit_interval(num(schema.stress)).alias(schema.stress),
        S.unit_interval(num(schema.comfort)).alias(schema.comfort),
        *[signal(c) for c in schema.signals],
        whole(schema.hazard, 0),
        F.coalesce(F.col(schema.phase).cast("string"), F.lit("default")).alias(schema.phase),
        whole(schema.specialization, 0),
        whole(schema.experience, 1),
        *[signal(c) for c in extra],
    )


def risk_labels(df: DataFrame, schema: SignalSchema, state: str) -> DataFrame:
    """Hazard, phase, risk score and both labels from a latent state and the robot context."""
    distance, speed = F.col("distance_to_robot"), F.col("robot_speed")
    risk = S.logistic(0.6 * F.col(state) + 0.2 * speed + 0.2 / (distance + 0.3))
    near = distance < 2.0
    return df.withColumn("risk_score", risk).withColumns(
        {
            schema.hazard: near.cast("int"),
            schema.phase: F.when(near, "critical").otherwise("normal"),
            schema.stress: (F.col("risk_score") > 0.55).cast("double"),
            schema.comfort: S.clip(1.0 - 0.8 * F.col("risk_score"), 0.0, 1.0),
        }
    )


def drop_at_random(df: DataFrame, columns: Sequence[str], keys: Sequence[str], rate: float, seed: int) -> DataFrame:
    """Null each cell with probability ``rate``, repeatably: the draw hashes the row key and the column name."""

    def draw(column: str):
        key = F.concat_ws("|", F.lit(str(seed)), F.lit(column), *[F.col(k).cast("string") for k in keys])
        return S.stable_bucket(key, 1_000_000) / 1_000_000.0

    return df.withColumns({c: F.when(draw(c) >= rate, F.col(c)) for c in columns})


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Each distinct label with its index in sorted order, from files; null is no label.

    However many labels there are, and whatever they share: ranges are split at whole labels.
    """
    labels = df.select(F.col(column).alias("_label")).where("_label is not null").distinct()
    return number_sorted(labels, ["_label"], "_code")


def category_codes(df: DataFrame, column: str, out: str, codes: DataFrame) -> DataFrame:
    """Index of the row's label; null gives -1."""
    joined = df.join(codes, F.col(column) == F.col("_label"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_code"), F.lit(-1)).cast("int")).drop("_code", "_label")


def has_targets(df: DataFrame, schema: SignalSchema) -> DataFrame:
    return df.dropna(subset=[schema.stress, schema.comfort])


def allow(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Allow-list filter; an empty list keeps everything."""
    values = sorted(set(values))
    return df.where(F.col(column).isin(*values)) if values else df


def min_rows_per_worker(df: DataFrame, worker: str, least: int) -> DataFrame:
    """Keep workers with at least ``least`` rows.

    Short series are counted first (map-side) and removed by an anti join: they are few rows each, so a
    hot worker never has to be gathered to be counted.
    """
    if least <= 1:
        return df
    short = df.groupBy(worker).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") < least).select(worker)
    return df.join(short, worker, "left_anti")


def require_rows(df: DataFrame, stage: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows left after {stage}")
    return df


def bad_numbers(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Missing or infinite cells per split and column."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(by, F.inline(entries))
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return long.groupBy(by, "column").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(bad.cast("long")).alias("bad")
    )


def require_finite(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    found = bad_numbers(df, columns, by).where("bad > 0").orderBy(by, "column").first()
    if found:
        raise ValueError(f"{found[by]} has missing or infinite values in '{found['column']}'")
    return df
