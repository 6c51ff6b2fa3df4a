"""Chooses the reader a configuration asks for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from signalspark.layout import SeriesLayout, number_sorted
from signalspark.operators import clean
from signalspark.schema import SignalSchema
from signalspark.sources import csv, records, tables


def load(spark: SparkSession, cfg: Mapping, schema: SignalSchema) -> DataFrame:
    """A lazy raw frame for ``dataset.name``: subjects (CSV exports or nested records), a feature-table
    dataset, generic CSV, or a cached raw table."""
    dataset = cfg.get("dataset", {})
    name, path = str(dataset.get("name", "raw")).lower(), dataset.get("path")
    if name in ("wesad", "subjects"):
        return _subjects(spark, dataset, path, schema)
    if name in ("multiphysio", "feature_tables"):
        if not path:
            raise FileNotFoundError("dataset.path is required for feature tables")
        return tables.read_feature_dataset(spark, path, schema, dataset.get(name, {}))
    paths = cfg.get("paths", {})
    if name == "csv":
        for candidate in (path, paths.get("raw_file"), paths.get("raw_dir")):
            if candidate:
                return _in_source_order(csv.generic(spark, candidate, schema, with_order=True), schema)
        raise FileNotFoundError("no CSV path configured")
    cached = paths.get("raw_cache")
    if not cached:
        raise FileNotFoundError(f"unknown dataset '{name}' and no paths.raw_cache to read")
    return spark.read.parquet(cached)


def _in_source_order(df: DataFrame, schema: SignalSchema) -> DataFrame:
    """Rows without a time index get their place in the source, from which one can be counted."""
    if schema.time_idx not in df.columns:
        df = number_sorted(df, csv.SOURCE_ORDER, clean.INGEST_ORDER)
    return df.drop(*csv.SOURCE_ORDER, "_columns")


def _subjects(spark: SparkSession, dataset: Mapping, path: str | None, schema: SignalSchema) -> DataFrame:
    if not path:
        raise FileNotFoundError("dataset.path is required for subject data")
    amusement = bool(dataset.get("stress_include_amusement", True))
    if str(dataset.get("format", "csv")) in ("records", "wesad_records"):
        rows = records.explode_records(spark.read.parquet(path), schema, include_amusement=amusement)
    else:
        rows = csv.subject_exports(csv.scan(spark, path, with_order=True), schema, amusement)
    layout = SeriesLayout.fit(rows, schema.worker, schema.time_idx)
    return csv.subject_dataset(
        rows,
        schema,
        layout,
        dataset.get("subjects") or None,
        int(dataset.get("max_rows_per_subject") or 0) or None,
        int(dataset.get("downsample_factor") or 0) or None,
    )
