"""Spark jobs for per-subject sensor series: load, split, normalise, window, model, evaluate."""

from signalspark.schema import SignalSchema

__all__ = ["SignalSchema"]
