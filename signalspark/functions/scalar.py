"""Scalar column expressions: coercion, labels, keys, recodes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must match the data sets' own vocabulary.
PROTOCOL_NAMES = {1: "baseline", 2: "stress", 3: "amusement"}
STRESS_OF_PROTOCOL = {1: 0.0, 2: 1.0, 3: None}
STRESS_OF_PROTOCOL_WITH_AMUSEMENT = {1: 0.0, 2: 1.0, 3: 0.0}
COMFORT_OF_PROTOCOL = {1: 0.9, 2: 0.2, 3: 0.7}
REPEATED_TASKS = ("cobot-task", "manual-task")

_NUMBER_TEXT = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf(inity)?)\s*$"


def number(value: Column, text: bool = False) -> Column:
    """Double or null; NaN is null. ``text`` guards spellings such as ``1d`` that the cast would accept."""
    cast = value.try_cast("double")
    clean = F.when(~F.isnan(cast), cast)
    return F.when(value.rlike(_NUMBER_TEXT), clean) if text else clean


def finite(value: Column, text: bool = False) -> Column:
    """Like ``number`` with infinities folded to null as well."""
    parsed = number(value, text)
    return F.when(F.abs(parsed) != F.lit(float("inf")), parsed)


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp, keeping null (``least``/``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def unit_interval(value: Column) -> Column:
    """Null to 0, then clamp to [0, 1]."""
    return clip(F.coalesce(value, F.lit(0.0)), 0.0, 1.0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def class_label(text: Column) -> Column:
    """Canonical class name: lower case, dashes for blanks, no trailing repetition number."""
    label = F.lower(strip(F.coalesce(text.cast("string"), F.lit("nan"))))
    label = F.replace(label, F.lit("vr-job simulator"), F.lit("vr-job-sim"))
    label = F.regexp_replace(label, r"\s+", "-")
    label = F.regexp_replace(label, r"-{2,}", "-")
    return F.regexp_replace(label, r"-(\d+)$", "")


def task_key(label: Column, repetition: Column) -> Column:
    repeated = F.concat_ws("-", label, repetition.cast("string"))
    return F.when(label.isin(*REPEATED_TASKS), repeated).otherwise(F.concat(label, F.lit("_0")))


def shifted_repetition(value: Column, offset: int, text: bool = False) -> Column:
    return F.coalesce(number(value, text), F.lit(0.0)).cast("int") + F.lit(offset)


def threshold_label(score: Column, threshold: float) -> Column:
    """1.0 at or above the threshold; a missing score counts as 0."""
    return (F.coalesce(score, F.lit(0.0)) >= F.lit(float(threshold))).cast("double")


def rating_to_unit(value: Column, low: float = 1.0, high: float = 5.0, missing: float = 0.5) -> Column:
    return F.coalesce(clip((value - F.lit(low)) / F.lit(high - low), 0.0, 1.0), F.lit(missing))


def subject_id(raw: Column) -> Column:
    """``S`` plus the id, whatever the case of a leading s."""
    return F.concat(F.lit("S"), F.regexp_replace(strip(raw.cast("string")), r"^[sS]", ""))


def strict_subject_id(raw: Column) -> Column:
    """As ``subject_id`` but digits only, leading zeros dropped; null when malformed."""
    digits = F.regexp_extract(strip(raw.cast("string")), r"^[sS]?(\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit("S"), digits.cast("decimal(38,0)").cast("string")))


def recode(key: Column, table: Mapping, default=None) -> Column:
    """Lookup in a small fixed table."""
    out = None
    for source, target in table.items():
        hit, value = key == F.lit(source), F.lit(target)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.lit(default))


def protocol_columns(code: Column, include_amusement: bool, names: bool) -> dict[str, Column]:
    """Stress, comfort and name of a protocol given as a number (``names=False``) or as lower-case text."""
    stress = STRESS_OF_PROTOCOL_WITH_AMUSEMENT if include_amusement else STRESS_OF_PROTOCOL

    def keyed(table: Mapping) -> Mapping:
        return {PROTOCOL_NAMES[k]: v for k, v in table.items()} if names else table

    return {
        "stress": recode(code, keyed(stress)).cast("double"),
        "comfort": recode(code, keyed(COMFORT_OF_PROTOCOL)).cast("double"),
        "name": code if names else recode(code, PROTOCOL_NAMES, "other"),
    }


def stable_bucket(text: Column, buckets: int) -> Column:
    """Repeatable hash bucket, equal in every process and engine."""
    head = F.conv(F.substring(F.md5(text.cast("string")), 1, 8), 16, 10).cast("long")
    return (head % buckets).cast("int")


def logistic(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def link_scores(value: Column, loss: str) -> Column:
    """Model output to probability: logistic for a logit loss, then clamp."""
    return clip(logistic(value) if loss == "bce" else value, 0.0, 1.0)


def effective_rate(hz: float, downsample: int | None) -> float:
    return hz / max(1, int(downsample or 1))


def ratio(top: Column, bottom: Column, otherwise: float | None = 0.0) -> Column:
    """Division with a defined value for an empty denominator."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(otherwise).cast("double"))


def missing(columns: Iterable[str], wanted: Iterable[str]) -> list[str]:
    present = set(columns)
    return [c for c in wanted if c not in present]
