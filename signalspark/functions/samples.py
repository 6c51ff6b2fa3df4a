"""Beat and skin features of a batch of windows at once, on Arrow arrays.

The array expressions next door give the same values inside the JVM, but Spark interprets their lambdas step
by step; over a batch of windows the same steps are a few vector operations. Spark still cuts, places and
ships the windows: this sees one batch of equally long sample arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from signalspark.functions.arrays import BEAT_SPECTRUM_HZ, HIGH_BAND, LOW_BAND, SEGMENT

CELLS_PER_SLICE = 4_000_000
BEAT = ("meanHR", "RMSSD", "SDNN", "pNN50")
SPECTRUM = ("LF", "HF", "LF_HF")
SKIN = ("scl_mean", "scl_var", "scr_count", "scr_mean_amp")


def peak_mask(windows: np.ndarray) -> np.ndarray:
    """Interior local maxima of each row; a flat top counts once, at its middle."""
    mask = np.zeros(windows.shape, dtype=bool)
    if windows.shape[1] < 3:
        return mask
    slope = np.sign(np.diff(windows, axis=1))
    at = np.where(slope != 0, np.arange(slope.shape[1]), -1)
    before = np.maximum.accumulate(at, axis=1)[:, :-1]
    row, fall = np.nonzero(slope[:, 1:] == -1)
    rise = before[row, fall]
    hit = (rise >= 0) & (slope[row, np.maximum(rise, 0)] == 1)
    # The fall lies behind sample fall + 1 and the rise ahead of sample rise + 1.
    mask[row[hit], (rise[hit] + 1 + fall[hit] + 1) // 2] = True
    return mask


def _best_nearby(rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest rank in each range low:high, from maxima over runs of powers of two."""
    width = high - low
    level = np.frexp(width)[1] - 1
    out, runs = np.empty_like(rank), rank
    for k in range(int(level.max()) + 1):
        if k:
            runs = np.maximum(runs[: len(rank) - (1 << k) + 1], runs[1 << (k - 1) :][: len(rank) - (1 << k) + 1])
        at = np.flatnonzero(level == k)
        out[at] = np.maximum(runs[low[at]], runs[high[at] - (1 << k)])
    return out


def thin(mask: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Tallest peaks first, none closer than ``distance``; among equals the later one goes first.

    Per round every peak that beats its open neighbours is kept and closes them: the same choice as going through the
    peaks by height one at a time. Only peaks are looked at. A round takes their number times the logarithm of how
    many lie within the distance, and a window of n samples needs n / distance rounds at most.
    """
    if distance <= 2:
        return mask
    row, at = np.nonzero(mask)
    # Rows lie too far apart to meet.
    place = row * (mask.shape[1] + distance) + at
    rank = np.empty(len(place), np.int64)
    rank[np.lexsort((place, height[row, at]))] = np.arange(len(place))
    kept, open_ = np.zeros_like(mask), np.arange(len(place))
    while len(open_):
        here = place[open_]
        low = np.searchsorted(here, here - distance + 1, "left")
        high = np.searchsorted(here, here + distance - 1, "right")
        best = _best_nearby(rank[open_], low, high) == rank[open_]
        kept[row[open_[best]], at[open_[best]]] = True
        closing = np.concatenate([[0], np.cumsum(best)])
        open_ = open_[closing[high] == closing[low]]
    return kept


def _per_row(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)


def beat_features(ecg: np.ndarray, hz: float, frequency: bool) -> dict[str, np.ndarray]:
    n = len(ecg)
    row, at = np.nonzero(thin(peak_mask(ecg), ecg, max(1, int(0.3 * hz))))
    same = row[1:] == row[:-1]
    gap_row, gap = row[1:][same], np.diff(at)[same] / max(hz, 1e-6)
    near = gap_row[1:] == gap_row[:-1]
    jump_row, jump = gap_row[1:][near], np.diff(gap * 1000.0)[near]
    gaps, jumps = np.bincount(gap_row, minlength=n), np.bincount(jump_row, minlength=n)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = _per_row(gap_row, gap, n) / gaps
        off = (gap - mean[gap_row]) * 1000.0
        out = {
            "meanHR": 60.0 / np.maximum(mean, 1e-6),
            "RMSSD": np.sqrt(_per_row(jump_row, jump**2, n) / jumps),
            "SDNN": np.sqrt(_per_row(gap_row, off**2, n) / gaps),
            "pNN50": _per_row(jump_row, (np.abs(jump) > 50.0).astype(float), n) / jumps,
        }
    few = gaps < 2
    for values in out.values():
        values[few] = np.nan
    return out | (_spectrum(gap_row, gap, gaps) if frequency else {})


def _band(power: np.ndarray, bins: range, width: float) -> np.ndarray:
    if not len(bins):
        return np.full(len(power), np.nan)
    inside = power[:, bins.start : bins.stop]
    return ((inside[:, 1:] + inside[:, :-1]) / 2.0 * width).sum(axis=1)


def _spectrum(gap_row: np.ndarray, gap: np.ndarray, gaps: np.ndarray) -> dict[str, np.ndarray]:
    """Band powers of the beat gaps, windows with equally many gaps together."""
    low, high = np.full(len(gaps), np.nan), np.full(len(gaps), np.nan)
    for count in np.unique(gaps[gaps >= 8]):
        rows = np.nonzero(gaps == count)[0]
        series = gap[np.isin(gap_row, rows)].reshape(len(rows), count)
        size = min(SEGMENT, count)
        parts = np.lib.stride_tricks.sliding_window_view(series, size, axis=1)[:, :: size - size // 2]
        taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        shaped = (parts - parts.mean(axis=2, keepdims=True)) * taper
        edges = [int(np.ceil(f * size / BEAT_SPECTRUM_HZ)) for f in (*LOW_BAND, *HIGH_BAND)]
        wave = np.exp(-2j * np.pi * np.outer(np.arange(size), np.arange(edges[-1])) / size)
        power = (2.0 * np.abs(shaped @ wave) ** 2 / (BEAT_SPECTRUM_HZ * (taper**2).sum())).mean(axis=1)
        width = BEAT_SPECTRUM_HZ / size
        low[rows] = _band(power, range(edges[0], edges[1]), width)
        high[rows] = _band(power, range(edges[2], edges[3]), width)
    with np.errstate(invalid="ignore", divide="ignore"):
        return {"LF": low, "HF": high, "LF_HF": np.where(high > 0, low / high, np.nan)}


def tonic_level(eda: np.ndarray, hz: float) -> np.ndarray:
    """Moving average with zero padding and a constant divisor; short windows are their own level.

    The padded samples are cut into blocks as long as the kernel. A kernel reaches over the end of one block and the
    beginning of the next, so its sum is a running sum from the right and one from the left: two additions a sample,
    whatever the kernel, and nothing is ever subtracted.
    """
    length = eda.shape[1]
    if length <= 3:
        return eda
    kernel = max(3, int(min(length - 1, hz * 2)))
    back = kernel // 2
    blocks = -(-(length + kernel - 1) // kernel) + 1
    padded = np.zeros((len(eda), blocks * kernel))
    padded[:, back : back + length] = eda
    cut = padded.reshape(len(eda), blocks, kernel)
    upto = np.cumsum(cut, axis=2).reshape(len(eda), -1)
    onward = np.cumsum(cut[:, :, ::-1], axis=2)[:, :, ::-1].reshape(len(eda), -1)
    # A kernel that starts with a block is that block.
    ends = np.where(np.arange(length) % kernel == 0, 0.0, upto[:, kernel - 1 : kernel - 1 + length])
    return (onward[:, :length] + ends) / kernel


def skin_features(eda: np.ndarray, hz: float, threshold: float, distance: int) -> dict[str, np.ndarray]:
    level = tonic_level(eda, hz)
    phasic = eda - level
    tall = peak_mask(phasic) & (phasic >= threshold)
    kept = thin(tall, phasic, max(1, distance))
    count = kept.sum(axis=1).astype(float)
    heights = np.where(kept, phasic, 0.0).sum(axis=1)
    return {
        "scl_mean": level.mean(axis=1),
        "scl_var": level.var(axis=1),
        "scr_count": count,
        "scr_mean_amp": heights / np.maximum(count, 1.0),
    }


def _matrix(samples: pa.Array, length: int) -> np.ndarray:
    return samples.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _signals(
    ecg: pa.Array, eda: pa.Array, length: int, hz: float, frequency: bool, threshold: float, distance: int
) -> dict[str, pa.Array]:
    """Beat and skin features of equally long sample arrays; null where undefined."""
    names = [*BEAT, *(SPECTRUM if frequency else ()), *SKIN]
    flat = [_matrix(a, length) for a in (ecg, eda)]
    step = max(1, CELLS_PER_SLICE // length)
    parts = []
    for i in range(0, len(flat[0]), step):
        heart, skin = (m[i : i + step] for m in flat)
        parts.append(beat_features(heart, hz, frequency) | skin_features(skin, hz, threshold, distance))
    columns = [np.concatenate([p[name] for p in parts]) if parts else np.empty(0) for name in names]
    return {name: pa.array(v, mask=np.isnan(v)) for name, v in zip(names, columns, strict=True)}


def _moments(samples: pa.Array, length: int, slope: bool) -> list[pa.Array]:
    """Mean, deviation and (0 where undefined) least-squares slope of each window; nulls are left out, as SQL does."""
    x = _matrix(samples, length)
    known = samples.flatten().is_valid().to_numpy(zero_copy_only=False).reshape(x.shape)
    count = known.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(known, x, 0.0).sum(axis=1) / count
        off = np.where(known, x - mean[:, None], 0.0)
        out = [pa.array(v, mask=count == 0) for v in (mean, np.sqrt((off * off).sum(axis=1) / count))]
        if slope:
            steps = np.arange(length, dtype=float)
            steps = np.where(known, steps - (np.where(known, steps, 0.0).sum(axis=1) / count)[:, None], 0.0)
            wide = (steps * steps).sum(axis=1)
            out.append(pa.array(np.where(wide > 0, (steps * off).sum(axis=1) / wide, 0.0)))
    return out


def window_signals(
    ecg: Column, eda: Column, length: int, hz: float, frequency: bool, threshold: float, distance: int
) -> Column:
    """A struct of beat and skin features per pair of sample arrays."""
    names = [*BEAT, *(SPECTRUM if frequency else ()), *SKIN]

    def compute(ecg: pa.Array, eda: pa.Array) -> pa.Array:
        found = _signals(ecg, eda, length, hz, frequency, threshold, distance)
        return pa.StructArray.from_arrays(list(found.values()), names=list(found))

    return F.arrow_udf(compute, ", ".join(f"`{name}` double" for name in names))(ecg, eda)


def window_summary(
    length: int, hz: float, frequency: bool, threshold: float, distance: int, moments: tuple[str, ...]
) -> tuple[list[str], Callable[[dict[str, pa.Array]], list[pa.Array]]]:
    """Names of the features made from a window's sample arrays, and what makes them, for ``Cutter.take``.

    Beat and skin features come from ``_ecg`` and ``_eda``; of each of ``moments`` (column c in ``_c``) mean and
    deviation, of ``temp`` the slope too.
    """
    names = [*BEAT, *(SPECTRUM if frequency else ()), *SKIN]
    for c in moments:
        names += [f"{c}_mean", f"{c}_std", *([f"{c}_slope"] if c == "temp" else [])]

    def summarise(arrays: dict[str, pa.Array]) -> list[pa.Array]:
        out = list(_signals(arrays["_ecg"], arrays["_eda"], length, hz, frequency, threshold, distance).values())
        for c in moments:
            out += _moments(arrays[f"_{c}"], length, c == "temp")
        return out

    return names, summarise
