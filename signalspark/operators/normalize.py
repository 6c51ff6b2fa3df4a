"""Gap filling, train-fitted imputation and normalisation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.functions import scalar as S
from signalspark.layout import add_block, exact_quantiles, join_on_keys, SeriesLayout
from signalspark.schema import SignalSchema
from signalspark.session import materialize

VARIANCE_FLOOR = 1e-6


def fill_gaps(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], pos: str, layout: SeriesLayout
) -> DataFrame:
    """Last known value of the series, else its first known one, else 0.

    In blocks: each block's first and last known values form a small table, whose running form tells a block
    what came before it.
    """
    by, known = list(by), [c for c in columns if c in df.columns]
    series = Window.partitionBy(*by)
    zeros = {c: F.lit(0.0) for c in columns if c not in known}
    if not layout.cut:
        upto = series.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        whole = series.orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        filled = {
            c: F.coalesce(F.last(c, True).over(upto), F.first(c, True).over(whole), F.lit(0.0)) for c in known
        }
        return df.withColumns(filled | zeros)
    rows = add_block(df, layout, pos)
    at = {c: F.when(F.col(c).isNotNull(), F.col(pos)) for c in known}
    ends = rows.groupBy(*by, "_block").agg(
        *[F.min_by(c, at[c]).alias(f"_first_{c}") for c in known],
        *[F.max_by(c, at[c]).alias(f"_last_{c}") for c in known],
    )
    before = series.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = series.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = ends.select(
        *by,
        "_block",
        *[F.last(f"_last_{c}", True).over(before).alias(f"_before_{c}") for c in known],
        *[F.first(f"_first_{c}", True).over(whole).alias(f"_start_{c}") for c in known],
    )
    upto = Window.partitionBy(*by, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"_here_{c}": F.last(c, True).over(upto) for c in known})
    joined = join_on_keys(local, carried, [*by, "_block"])
    filled = {
        c: F.coalesce(F.col(f"_here_{c}"), F.col(f"_before_{c}"), F.col(f"_start_{c}"), F.lit(0.0)) for c in known
    }
    return joined.withColumns(filled | zeros).select(*df.columns, *zeros)


def fill_raw(df: DataFrame, schema: SignalSchema, layout: SeriesLayout) -> DataFrame:
    """Gap filling of every channel inside (worker, split)."""
    filled = fill_gaps(df, schema.fillable(df.columns), [schema.worker, "split"], "_seg_pos", layout)
    return filled.withColumns(
        {
            schema.hazard: F.coalesce(F.col(schema.hazard), F.lit(0)).cast("int"),
            schema.phase: F.coalesce(F.col(schema.phase), F.lit("default")),
        }
    )


def train_medians(df: DataFrame, columns: Sequence[str], task_rows: int | None = None) -> dict[str, float]:
    """Median per feature over training rows; 0 for a feature that has none."""
    clean = df.where(F.col("split") == "train").select(*[S.number(F.col(c)).alias(c) for c in columns])
    found = exact_quantiles(clean, columns, [0.5], task_rows)
    return {c: found[c][0] if found[c] else 0.0 for c in columns}


def impute_medians(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(S.number(F.col(c)), F.lit(m)) for c, m in medians.items()})


def global_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of training mean and spread per signal; (0, 1) for a signal without values.

    The spread is the sample deviation; a single value leaves it undefined and it becomes 1.
    """
    train = F.col("split") == "train"
    out = []
    for c in columns:
        x = F.when(train, S.finite(F.col(c)))
        out.append(F.coalesce(F.avg(x), F.lit(0.0)).alias(f"baseline_mu_{c}"))
        out.append(F.coalesce(F.stddev_samp(x) + 1e-6, F.lit(1.0)).alias(f"baseline_sigma_{c}"))
    return df.agg(*out)


def normalize_global(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-score by training statistics; the one statistics row is broadcast."""
    stats = global_statistics(df, columns)
    joined = df.drop(*stats.columns).crossJoin(F.broadcast(stats))
    sigma = {f"baseline_sigma_{c}": F.greatest(F.col(f"baseline_sigma_{c}"), F.lit(1e-6)) for c in columns}
    scaled = {c: (F.col(c) - F.col(f"baseline_mu_{c}")) / F.col(f"baseline_sigma_{c}") for c in columns}
    return joined.withColumns(sigma).withColumns(scaled)


def running_maps(scale, shift, floor=None, fresh=None):
    """Prefix compositions of the maps x -> max(scale * x + shift, floor), by doubling.

    Such maps are closed under composition, so a recurrence over a long series splits into blocks. ``fresh``
    marks rows where composing starts anew.
    """
    scale, shift = scale.astype(float).copy(), shift.astype(float).copy()
    floor = None if floor is None else floor.astype(float).copy()
    closed = np.zeros(len(scale), dtype=bool) if fresh is None else fresh.copy()
    width = 1
    while width < len(scale):
        later, earlier = slice(width, None), slice(None, -width)
        joins = ~closed[later]
        s, t = scale[later].copy(), shift[later].copy()
        if floor is not None:
            both = np.maximum(s * floor[earlier] + t, floor[later])
            floor[later] = np.where(joins, both, floor[later])
        shift[later] = np.where(joins, s * shift[earlier] + t, t)
        scale[later] = np.where(joins, s * scale[earlier], s)
        closed[later] = closed[later] | closed[earlier]
        width *= 2
    return scale, shift, floor


def _scan(carry: float, fresh: np.ndarray, start: np.ndarray, scale, shift, floor=None):
    """States before and after each step over many series in a row.

    Where a series starts, its first map is applied to its own start value ahead of time and becomes a
    constant: nothing of the previous series passes it.
    """
    first = scale * start + shift
    if floor is not None:
        first = np.maximum(first, floor)
    maps = running_maps(np.where(fresh, 0.0, scale), np.where(fresh, first, shift), floor)
    after = maps[0] * carry + maps[1]
    if floor is not None:
        after = np.maximum(after, maps[2])
    before = np.where(fresh, start, np.concatenate([[carry], after[:-1]]))
    return before, after


def _mean_maps(x: np.ndarray, alpha: float):
    known = np.isfinite(x)
    return np.where(known, 1 - alpha, 1.0), np.where(known, alpha * np.where(known, x, 0.0), 0.0)


def _variance_maps(x: np.ndarray, mean_before: np.ndarray, mean_after: np.ndarray, alpha: float):
    value = np.where(np.isfinite(x), x, mean_before)
    return np.full(len(x), 1 - alpha), alpha * (value - mean_after) ** 2, np.full(len(x), VARIANCE_FLOOR)


def warm_start(x: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of the first rows; (0, 1) where undefined."""
    known = x[~np.isnan(x)]
    if not len(known):
        return 0.0, 1.0
    with np.errstate(invalid="ignore"):
        mu, sigma = float(np.mean(known)), float(np.std(known) + 1e-6)
    return (mu if np.isfinite(mu) else 0.0), (sigma if np.isfinite(sigma) and sigma > 0 else 1.0)


def series_states(x, fresh, mu, variance, carry, alpha: float):
    """Mean and variance in force before each step of consecutive series, and those after the last step.

    ``fresh`` marks first rows, ``mu`` and ``variance`` hold each row's start values, ``carry`` the state of a
    series that began earlier.
    """
    before, after = _scan(carry[0], fresh, mu, *_mean_maps(x, alpha))
    var_before, var_after = _scan(carry[1], fresh, variance, *_variance_maps(x, before, after, alpha))
    return before, var_before, (float(after[-1]), float(var_after[-1]))


def online_states(x: np.ndarray, mu: float, variance: float, alpha: float):
    """Mean and deviation before each step of one series, and the final mean and variance."""
    none = np.zeros(len(x), dtype=bool)
    before, var_before, last = series_states(x, none, mu, variance, (mu, variance), alpha)
    return before, np.sqrt(var_before), last


def _zscore(x: np.ndarray, mu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    return (np.where(np.isfinite(x), x, mu) - mu) / np.maximum(sigma, 1e-6)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(float)


def _flags(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("_fresh").to_numpy(zero_copy_only=False).astype(bool)


def _block_maps(columns: Sequence[str], keys: Sequence[str], alpha: float, variance: bool):
    """Sorted rows to one row per block: the map that the block's rows amount to, per column.

    The mean's map, or with ``variance`` the variance's, which needs the mean at the block's start in ``_mu_``.
    """
    parts = ("scale", "shift", "floor") if variance else ("scale", "shift")

    def maps_of(batch, fresh, c, carry):
        x = _numbers(batch, c)
        step = _mean_maps(x, alpha)
        if not variance:
            return running_maps(*step, None, fresh)[:2], None
        before, after = _scan(carry, fresh, _numbers(batch, f"_mu_{c}"), *step)
        return running_maps(*_variance_maps(x, before, after, alpha), fresh), float(after[-1])

    def after_open(maps, open_, head):
        """Rows that continue the block of the previous batch come after what it amounted to so far."""
        out = [m.copy() for m in maps]
        if variance:
            out[2][head] = np.maximum(maps[0][head] * open_[2] + maps[1][head], maps[2][head])
        out[1][head] = maps[0][head] * open_[1] + maps[1][head]
        out[0][head] = maps[0][head] * open_[0]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, open_, waiting = dict.fromkeys(columns, 0.0), {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = _flags(batch)
            head = np.cumsum(fresh) == 0
            values = {}
            for c in columns:
                maps, last = maps_of(batch, fresh, c, means[c])
                if c in open_ and head.any():
                    maps = after_open(maps, open_[c], head)
                means[c] = means[c] if last is None else last
                open_[c] = [float(m[-1]) for m in maps]
                values |= {f"{p}_{c}": pa.array(m) for p, m in zip(parts, maps, strict=True)}
            arrays = [batch.column(k) for k in keys] + list(values.values())
            done = pa.RecordBatch.from_arrays(arrays, names=[*keys, *values])
            if waiting is not None and fresh[0]:
                yield waiting
            ends = np.nonzero(fresh[1:])[0]
            if len(ends):
                yield done.take(pa.array(ends))
            waiting = done.slice(batch.num_rows - 1, 1)
        if waiting is not None:
            yield waiting

    return run


def _block_starts(columns: Sequence[str], keys: Sequence[str], what: str):
    """Sorted block maps to the state at each block's start, given the series' own start in ``_<what>_``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = dict.fromkeys(columns, 0.0)
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh, found = _flags(batch), {}
            for c in columns:
                maps = [_numbers(batch, f"{p}_{c}") for p in ("scale", "shift")]
                floor = _numbers(batch, f"floor_{c}") if f"floor_{c}" in batch.schema.names else None
                before, after = _scan(carry[c], fresh, _numbers(batch, f"_{what}_{c}"), *maps, floor)
                carry[c] = float(after[-1])
                found[f"_{what}_{c}"] = pa.array(before)
            arrays = [batch.column(k) for k in keys] + list(found.values())
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *found])

    return run


def _normalize_sorted(columns: Sequence[str], alpha: float):
    """Batches of rows in series order to batches with z-scores; only the running state is kept between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = dict.fromkeys(columns, (0.0, 1.0))
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = _flags(batch)
            done, marks = {}, {}
            for c in columns:
                x, mu, sigma = (_numbers(batch, n) for n in (c, f"_mu_{c}", f"_sigma_{c}"))
                mean, variance, carry[c] = series_states(x, fresh, mu, sigma**2, carry[c], alpha)
                deviation = np.sqrt(variance)
                done[c] = pa.array(_zscore(x, mean, deviation))
                marks[f"baseline_mu_{c}"], marks[f"baseline_sigma_{c}"] = pa.array(mean), pa.array(deviation)
            kept = [n for n in batch.schema.names if not n.startswith(("_mu_", "_sigma_", "_fresh"))]
            arrays = [done[n] if n in done else batch.column(n) for n in kept]
            yield pa.RecordBatch.from_arrays([*arrays, *marks.values()], names=[*kept, *marks])

    return run


def _number(column: str):
    """The value, or null where it is not a finite number: such rows are no part of the starting statistics."""
    value = F.col(column)
    return F.when(F.isnan(value) | (F.abs(value) == math.inf), None).otherwise(value)


def normalize_online(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str],
    pos: str,
    alpha: float,
    warmup: int,
    layout: SeriesLayout,
) -> DataFrame:
    """z-score by an exponential mean and deviation that each row sees before it updates them.

    The recurrence has no built-in form, so it runs on Arrow batches. Short series pass through one after the
    other, in sorted partitions. Long ones are cut into blocks: one pass reduces blocks to mean maps, one to
    variance maps (they need the mean at the block's start), and the last emits rows; between passes only
    block summaries move.
    """
    by, columns, warm = list(by), list(columns), max(3, int(warmup))
    df = df.drop(*[f"baseline_{s}_{c}" for s in ("mu", "sigma") for c in columns])
    added = ", ".join(f"baseline_{s}_{c} double" for c in columns for s in ("mu", "sigma"))
    fields = ", ".join(f"`{f.name}` {'double' if f.name in columns else f.dataType.simpleString()}" for f in df.schema)
    out_schema = f"{fields}, {added}"
    df = df.withColumns({c: F.col(c).cast("double") for c in columns})

    if not layout.cut:
        ordered = Window.partitionBy(*by).orderBy(pos)
        head = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        place = df.withColumn("_place", F.row_number().over(ordered))
        early = {c: F.when(F.col("_place") <= warm, _number(c)) for c in columns}
        started = place.withColumns(
            {"_fresh": F.col("_place") == 1}
            | {f"_mu_{c}": F.coalesce(F.avg(x).over(head), F.lit(0.0)) for c, x in early.items()}
            | {f"_sigma_{c}": F.coalesce(F.stddev_pop(x).over(head) + 1e-6, F.lit(1.0)) for c, x in early.items()}
        ).drop("_place")
        # The windows above leave each partition with whole series; the sort is theirs, so it costs nothing.
        return started.sortWithinPartitions(*by, pos).mapInArrow(_normalize_sorted(columns, alpha), out_schema)

    return _normalize_blocks(df, columns, by, pos, alpha, warm, layout, out_schema)


def _in_order(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Partitions of whole groups, sorted, with each group's first row marked."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_fresh", place == 1).sortWithinPartitions(*by, order)


def _normalize_blocks(df: DataFrame, columns, by, pos: str, alpha: float, warm: int, layout, out_schema: str):
    rows = add_block(df, layout, pos)
    keys = [*by, "_block"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def typed(*prefixes: str) -> str:
        fields = [f"`{k}` {kinds[k]}" for k in keys] + [f"`{p}_{c}` double" for c in columns for p in prefixes]
        return ", ".join(fields)

    early = rows.where(F.col(pos) < warm).groupBy(*by).agg(
        *[F.coalesce(F.avg(_number(c)), F.lit(0.0)).alias(f"_mu_{c}") for c in columns],
        *[F.pow(F.coalesce(F.stddev_pop(_number(c)) + 1e-6, F.lit(1.0)), 2).alias(f"_var_{c}") for c in columns],
    )

    def starts(maps: DataFrame, what: str) -> DataFrame:
        own = early.select(*by, *[f"_{what}_{c}" for c in columns])
        return _in_order(join_on_keys(maps, own, list(by)), by, "_block").mapInArrow(
            _block_starts(columns, keys, what), typed(f"_{what}")
        )

    slim = rows.select(*keys, pos, *columns)
    mean_maps = _in_order(slim, keys, pos).mapInArrow(
        _block_maps(columns, keys, alpha, variance=False), typed("scale", "shift")
    )
    # Block tables are small and used again: from files, their makers run once and their size is known.
    means = materialize(starts(mean_maps, "mu"), "block-means")
    variance_maps = _in_order(join_on_keys(slim, means, keys), keys, pos).mapInArrow(
        _block_maps(columns, keys, alpha, variance=True), typed("scale", "shift", "floor")
    )
    variances = materialize(starts(variance_maps, "var"), "block-variances")
    ready = _in_order(join_on_keys(join_on_keys(rows, means, keys), variances, keys), keys, pos)
    ready = ready.withColumns({f"_sigma_{c}": F.sqrt(f"_var_{c}") for c in columns})
    kept = [*df.columns, "_fresh", *[f"{p}_{c}" for c in columns for p in ("_mu", "_sigma")]]
    return ready.select(*kept).mapInArrow(_normalize_sorted(columns, alpha), out_schema)


def mode_of(cfg: dict) -> str:
    """``online``, or ``global`` for anything else; ``normalization.mode`` wins over ``profiles.mode``."""
    mode = cfg.get("normalization", {}).get("mode", cfg.get("profiles", {}).get("mode", "global"))
    return "online" if str(mode).lower() == "online" else "global"


def normalize(df: DataFrame, schema: SignalSchema, cfg: dict, layout: SeriesLayout) -> DataFrame:
    """Normalise physiology in the configured mode."""
    if mode_of(cfg) == "global":
        return normalize_global(df, schema.physiology)
    profiles, norm = cfg.get("profiles", {}), cfg.get("normalization", {})
    return normalize_online(
        df,
        schema.physiology,
        [schema.worker, "split"],
        "_seg_pos",
        float(cfg.get("profile", {}).get("ema_alpha", 0.1)),
        int(norm.get("warmup_steps", profiles.get("warmup_steps", 30))),
        layout,
    )
