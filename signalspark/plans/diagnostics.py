"""Ingest diagnostics of a typed signal frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from signalspark.operators import sample, stats
from signalspark.schema import SignalSchema


@dataclass
class Summary:
    table: DataFrame
    labels: DataFrame
    top_classes: DataFrame
    top_workers: DataFrame


def summarize(frame: DataFrame, schema: SignalSchema, k: int = 10) -> Summary:
    """Size, label counts, and the largest classes and workers."""
    return Summary(
        stats.table_summary(frame, schema),
        stats.label_counts(frame, schema.stress),
        sample.top_k(stats.class_summary(frame, schema), "rows", k, [schema.protocol]),
        sample.top_k(stats.worker_summary(frame, schema), "rows", k, [schema.worker]),
    )
