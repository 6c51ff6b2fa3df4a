"""Expressions over one window's samples, held as an array. They run in the JVM on bounded arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BEAT_SPECTRUM_HZ = 4.0
LOW_BAND = (0.04, 0.15)
HIGH_BAND = (0.15, 0.40)
SEGMENT = 64


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def spread(values: Column) -> Column:
    """Population variance."""

    def squares(centre: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - centre) * (x - centre))

    return F.when(F.size(values) > 0, bind(mean(values), squares) / F.size(values))


def peaks(values: Column) -> Column:
    """0-based positions of interior local maxima; a flat top counts once, at its middle.

    One pass: a rise opens a candidate, the next fall closes it.
    """
    start = F.struct(F.lit(-1).alias("top"), F.array().cast("array<int>").alias("found"))

    def step(state: Column, i: Column) -> Column:
        now, before = F.element_at(values, i + 1), F.element_at(values, i)
        rise, fall = now > before, now < before
        closed = fall & (state["top"] >= 0)
        middle = F.floor((state["top"] + i - 1) / 2).cast("int")
        return F.struct(
            F.when(rise, i).when(fall, F.lit(-1)).otherwise(state["top"]).alias("top"),
            F.when(closed, F.array_append(state["found"], middle)).otherwise(state["found"]).alias("found"),
        )

    steps = F.when(F.size(values) > 1, F.sequence(F.lit(1), F.size(values) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(steps, start, step, lambda state: state["found"])


def spaced(positions: Column, values: Column, distance: int) -> Column:
    """Keep the tallest peaks at least ``distance`` apart; among equals the later one goes first.

    Local maxima are at least two samples apart, so a distance of 1 or 2 keeps them all.
    """
    if distance <= 2:
        return positions
    tallest = F.array_sort(
        F.transform(positions, lambda p: F.struct((-F.element_at(values, p + 1)).alias("h"), (-p).alias("p")))
    )

    def keep(kept: Column, entry: Column) -> Column:
        here = -entry["p"]
        crowded = F.exists(kept, lambda k: F.abs(k - here) < distance)
        return F.when(crowded, kept).otherwise(F.array_append(kept, here))

    return F.array_sort(F.aggregate(tallest, F.array().cast("array<int>"), keep))


def beats(signal: Column, hz: float) -> Column:
    """Positions of heart beats."""
    return spaced(peaks(signal), signal, max(1, int(0.3 * hz)))


def intervals(positions: Column, hz: float) -> Column:
    """Seconds between neighbouring beats; empty below two beats."""
    n = F.size(positions)
    later = F.slice(positions, 2, F.greatest(n - 1, F.lit(0)))
    earlier = F.slice(positions, 1, F.greatest(n - 1, F.lit(0)))
    return F.zip_with(later, earlier, lambda b, a: (b - a).cast("double") / F.lit(max(hz, 1e-6)))


def beat_statistics(gaps: Column, length: int) -> dict[str, Column]:
    """Heart-rate features of the beat gaps; null below three samples or three beats."""
    ms = F.transform(gaps, lambda g: g * 1000.0)
    n = F.size(gaps)
    jumps = F.zip_with(
        F.slice(ms, 2, F.greatest(n - 1, F.lit(0))),
        F.slice(ms, 1, F.greatest(n - 1, F.lit(0))),
        lambda b, a: b - a,
    )
    large = F.size(F.filter(jumps, lambda d: F.abs(d) > 50.0)).cast("double")
    enough = (n >= 2) & F.lit(length >= 3)
    return {
        "meanHR": F.when(enough, 60.0 / F.greatest(mean(gaps), F.lit(1e-6))),
        "RMSSD": F.when(enough, F.sqrt(mean(F.transform(jumps, lambda d: d * d)))),
        "SDNN": F.when(enough, F.sqrt(spread(ms))),
        "pNN50": F.when(enough, large / F.size(jumps)),
    }


def _segment_power(segment: Column, n: Column, bins: Column) -> Column:
    """One-sided Hann periodogram of one segment at the given bins."""
    turn = F.lit(2 * math.pi) / n

    def shape(centre: Column, taper: Column) -> Column:
        return F.zip_with(segment, taper, lambda x, w: (x - centre) * w)

    def power(shaped: Column, weight: Column, m: Column) -> Column:
        def part(wave) -> Column:
            return total(F.transform(shaped, lambda x, k: x * wave(m * k * turn)))

        return bind(part(F.cos), lambda re: re * re) + bind(part(F.sin), lambda im: im * im)

    def spectrum(taper: Column) -> Column:
        weight = total(F.transform(taper, lambda w: w * w))
        scale = F.lit(2.0) / (F.lit(BEAT_SPECTRUM_HZ) * weight)
        shaped = bind(mean(segment), lambda centre: shape(centre, taper))
        return bind(
            F.struct(shaped.alias("x"), scale.alias("scale")),
            lambda b: F.transform(bins, lambda m: power(b["x"], weight, m) * b["scale"]),
        )

    taper = F.transform(F.sequence(F.lit(0), n - 1), lambda k: 0.5 - 0.5 * F.cos(k * turn))
    return bind(taper, spectrum)


def _band(gaps: Column, low: float, high: float) -> Column:
    """Area below the averaged spectrum between two frequencies; null when no bin falls inside."""
    n = F.least(F.size(gaps), F.lit(SEGMENT))
    hop = n - F.floor(n / 2).cast("int")
    first = F.ceil(F.lit(low) * n / F.lit(BEAT_SPECTRUM_HZ)).cast("int")
    upto = F.ceil(F.lit(high) * n / F.lit(BEAT_SPECTRUM_HZ)).cast("int") - 1
    width = F.lit(BEAT_SPECTRUM_HZ) / n

    def averaged(bins: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(gaps) - n) / hop).cast("int"))
        spectra = F.transform(starts, lambda s: _segment_power(F.slice(gaps, s * hop + 1, n), n, bins))
        return bind(
            spectra,
            lambda found: F.transform(
                bins, lambda m, i: mean(F.transform(found, lambda spectrum: F.element_at(spectrum, i + 1)))
            ),
        )

    def area(power: Column) -> Column:
        n_bins = F.size(power)
        steps = F.zip_with(
            F.slice(power, 2, n_bins - 1), F.slice(power, 1, n_bins - 1), lambda b, a: (a + b) / 2.0 * width
        )
        return total(steps)

    return F.when(upto >= first, bind(bind(F.sequence(first, upto), averaged), area))


def beat_spectrum(gaps: Column) -> dict[str, Column]:
    """Low and high band power of the beat gaps and their ratio; null below eight gaps or three beats."""
    enough = F.size(gaps) >= 8
    low = F.when(enough, _band(gaps, *LOW_BAND))
    high = F.when(enough, _band(gaps, *HIGH_BAND))
    return {"LF": low, "HF": high, "LF_HF": F.when(high > 0, low / high)}


def tonic(signal: Column, length: int, hz: float) -> Column:
    """Moving average with zero padding and a constant divisor; short windows are their own tonic level."""
    if length <= 3:
        return signal
    kernel = max(3, int(min(length - 1, hz * 2)))
    back, ahead = kernel // 2, (kernel - 1) // 2

    def at(i: Column) -> Column:
        first = F.greatest(i - back, F.lit(0))
        last = F.least(i + ahead, F.lit(length - 1))
        return total(F.slice(signal, first + 1, last - first + 1)) / kernel

    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at)


def skin_responses(phasic: Column, height: float, distance: int) -> Column:
    """Heights of the phasic peaks that reach ``height``, thinned to ``distance``."""
    tall = F.filter(peaks(phasic), lambda p: F.element_at(phasic, p + 1) >= F.lit(float(height)))
    return F.transform(spaced(tall, phasic, max(1, distance)), lambda p: F.element_at(phasic, p + 1))
