"""Feature-table dataset: signals joined to labels, restricted to the tasks a participant took."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.functions import scalar as S
from signalspark.layout import SeriesLayout, number_rows
from signalspark.operators import clean, relate
from signalspark.schema import SignalSchema
from signalspark.session import materialize
from signalspark.sources import csv

SERIES_ORDER = "_order"
#: The window as a number; windows that are none come after all others.
WINDOW_ORDER = "_window"


@dataclass(frozen=True)
class TableOptions:
    ecg: str = "HRV_MeanNN"
    eda: str = "EDA_mean"
    temp: str = "EMG_RMSE"
    resp: str = "RRV_MeanBB"
    repetition_offset: int = 1
    stress_label: str = "NASA"
    stress_threshold: float = 40.0
    comfort_label: str = "Valence"
    classes: tuple[str, ...] = field(default=())
    min_rows: int = 20

    @classmethod
    def from_config(cls, cfg: Mapping) -> TableOptions:
        names = {
            "ecg_col": "ecg",
            "eda_col": "eda",
            "temp_col": "temp",
            "resp_col": "resp",
            "repetition_offset": "repetition_offset",
            "stress_label_col": "stress_label",
            "stress_threshold": "stress_threshold",
            "comfort_label_col": "comfort_label",
            "min_rows_per_worker": "min_rows",
        }
        given = {ours: cfg[theirs] for theirs, ours in names.items() if theirs in cfg}
        given["classes"] = tuple(str(c).strip().lower() for c in cfg.get("classes", []))
        return cls(**given)


def _keyed(df: DataFrame, options: TableOptions) -> DataFrame:
    return df.withColumns(
        {
            "ID": S.strip(F.col("ID").cast("string")),
            "class_norm": S.class_label(F.col("Class")),
            "rep_norm": S.shifted_repetition(
                F.col("Repetition"), options.repetition_offset, clean.is_text(df, "Repetition")
            ),
        }
    )


def joined_rows(
    signals: DataFrame,
    labels: DataFrame,
    overview: DataFrame,
    options: TableOptions,
    ingest_order: str,
    tie: str | None = None,
) -> DataFrame:
    """Signals with their labels (last one per key), kept where the participant's task is available.

    The joins carry no hint: both label and availability tables grow with participants, so their size is left
    to the adaptive planner, which also splits a participant that holds many rows.
    """
    schema_names = ["ID", "Class", "Repetition", options.stress_label]
    SignalSchema().require(labels.columns, schema_names)
    taken = [c for c in (options.ecg, options.eda, options.temp, options.resp) if c and c in signals.columns]
    ties = [tie] if tie else []
    left = _keyed(signals.select("ID", "Class", "Repetition", "Window", *ties, *taken), options)
    left = left.drop("Class", "Repetition")
    right = _keyed(labels, options)
    left, right = (clean.allow(t, "class_norm", options.classes) for t in (left, right))
    optional = [c for c in (options.comfort_label, "experience_level") if c and c in labels.columns]
    keys = ["ID", "class_norm", "rep_norm"]
    right = relate.keep_last(right.select(*keys, options.stress_label, *optional, ingest_order), keys, ingest_order)
    order = relate.task_order(overview)
    merged = left.join(right.drop(ingest_order), keys).withColumn(
        "task_key", S.task_key(F.col("class_norm"), F.col("rep_norm"))
    )
    merged = merged.withColumn("task_order", relate.order_of(F.col("task_key"), order))
    return relate.where_available(merged, overview)


def with_series_order(rows: DataFrame) -> DataFrame:
    """The window as a number, and one number that never decreases along (task order, repetition, window).

    Long series are cut by the latter. Rows that share it (many windows beyond millions do) are ordered by the three
    themselves.
    """
    window = F.col("Window").try_cast("double")
    window = F.when(window.isNull() | F.isnan(window), F.lit(float("inf"))).otherwise(window)
    at = F.greatest(F.lit(0.0), F.least(window, F.lit(1e15)))
    middle = F.greatest(F.lit(0.0), F.least(F.col("rep_norm").cast("double"), F.lit(1048575.0)))
    order = F.col("task_order") * 1048576.0 + middle + at / (at + 65536.0)
    return rows.withColumns({WINDOW_ORDER: window, SERIES_ORDER: order})


def feature_dataset(
    signals: DataFrame,
    labels: DataFrame,
    overview: DataFrame,
    schema: SignalSchema,
    options: TableOptions,
    ingest_order: str = "_ingest",
    tie: str | None = None,
) -> DataFrame:
    """The signal frame of a feature-table dataset.

    ``ingest_order`` is the label table's row order (the last duplicate wins); ``tie`` orders signal rows that
    share task, repetition and window. The joined rows are measured, coded and numbered, so they are written
    to the shared folder once instead of being joined for each of these.
    """
    joined = with_series_order(joined_rows(signals, labels, overview, options, ingest_order, tie))
    return typed_frame(materialize(joined, "joined"), schema, options, tie)


def typed_frame(rows: DataFrame, schema: SignalSchema, options: TableOptions, tie: str | None = None) -> DataFrame:
    """Joined rows to the signal frame. Time steps are numbered before rows without signals are dropped."""
    layout = SeriesLayout.fit(rows, "ID", SERIES_ORDER)
    codes = clean.label_codes(rows, "class_norm")
    rows = clean.category_codes(rows, "class_norm", schema.specialization, codes)
    series = [SERIES_ORDER, "task_order", "rep_norm", WINDOW_ORDER, "Window", *([tie] if tie else [])]
    rows = number_rows(rows, ["ID"], series, layout, pos=schema.time_idx)

    def measured(name: str):
        return clean.as_number(rows, name, keep_infinite=False)

    stress = S.threshold_label(clean.as_number(rows, options.stress_label), options.stress_threshold)
    if options.comfort_label and options.comfort_label in rows.columns:
        comfort = S.rating_to_unit(clean.as_number(rows, options.comfort_label))
    else:
        comfort = 1.0 - stress
    experience = F.lit(1)
    if "experience_level" in rows.columns:
        experience = F.coalesce(clean.as_number(rows, "experience_level"), F.lit(1.0)).cast("int")
    extra = [measured(options.resp).alias("resp")] if options.resp in rows.columns else []
    frame = rows.select(
        F.col("ID").alias(schema.worker),
        F.col(schema.time_idx).cast("double").alias(schema.timestamp),
        F.col(schema.time_idx).cast("int").alias(schema.time_idx),
        F.col("class_norm").alias(schema.protocol),
        stress.alias(schema.stress),
        comfort.alias(schema.comfort),
        measured(options.ecg).alias("ecg"),
        measured(options.eda).alias("eda"),
        measured(options.temp).alias("temp"),
        F.col("class_norm").isin(*S.REPEATED_TASKS).cast("int").alias(schema.hazard),
        F.col("class_norm").alias(schema.phase),
        F.col(schema.specialization),
        experience.alias(schema.experience),
        *extra,
        *[F.lit(0.0).alias(c) for c in schema.context],
    )
    return clean.min_rows_per_worker(frame.dropna(subset=["ecg", "eda", "temp"]), schema.worker, options.min_rows)


def read_feature_dataset(spark: SparkSession, path: str, schema: SignalSchema, cfg: Mapping) -> DataFrame:
    """The dataset from its folder of CSV files."""
    options = TableOptions.from_config(cfg)
    signals = csv.read_file(spark, f"{path}/features/bio_features_60s.csv", with_order=True)
    labels = csv.read_file(spark, f"{path}/features/labels.csv", with_order=True)
    labels = labels.withColumn("_ingest", F.struct("_block_start", "_line"))
    signals = signals.withColumn("_tie", F.struct("_block_start", "_line"))
    overview = csv.participants_overview(spark, f"{path}/participants_task_overview.csv")
    frame = feature_dataset(signals, labels, overview, schema, options, tie="_tie")
    return clean.require_rows(frame, "joining signals, labels and availability")
