"""Writers for windows, manifests, frames, metrics and fitted models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.operators.models import Fitted

META = ("start_idx", "end_idx", "label_time_idx", "split")


def write_windows(windows: DataFrame, path: str) -> None:
    """Sample arrays, labels and time marks, one folder per split."""
    windows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_meta(windows: DataFrame, path: str, worker: str = "worker_id") -> None:
    windows.select(F.col(worker).alias("worker_id"), *META).write.mode("overwrite").option("header", True).csv(path)


def write_manifest(manifest: DataFrame, *paths: str) -> None:
    for path in paths:
        manifest.write.mode("overwrite").option("header", True).csv(path)


def write_frame(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def cache_raw(df: DataFrame, path: str) -> DataFrame:
    """Write a frame and read it back: later stages start from the files."""
    write_frame(df, path)
    return df.sparkSession.read.parquet(path)


def write_model(fitted: Fitted, spark, path: str) -> None:
    """Model and calibrator stages, with the feature names next to them."""
    fitted.save(path)
    spark.createDataFrame([(json.dumps(fitted.facts()),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/facts"
    )


def read_model(spark, path: str) -> Fitted:
    """A scorer written by ``write_model``; it scores as it did before."""
    return Fitted.load(path, json.loads(spark.read.text(f"{path}/facts").first()["value"]))
