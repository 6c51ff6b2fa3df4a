"""How long series are cut, so that no task ever holds an unbounded one.

A plain ``Window.partitionBy(worker)`` sends a whole series to one task. That is the cheapest plan while every
series is known to be small: one exchange on the worker. Once a worker may hold a large share of all rows it
is a bottleneck, so each ordered computation here has a second, exact form which works on *pieces* of a
series and carries a small summary from piece to piece. ``SeriesLayout.fit`` measures the data and says which
form to use; both give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.session import materialize

TASK_ROWS = 1_000_000
TASK_ROWS_SETTING = "signalspark.task.rows"
MAX_PIECES = 10_000
SAMPLES_PER_PIECE = 100


def task_rows_of(df: DataFrame, given: int | None = None) -> int:
    """Most rows of one ordered group that a task should hold: an argument, else the session's setting."""
    return given or int(df.sparkSession.conf.get(TASK_ROWS_SETTING, str(TASK_ROWS)))


def split_points(df: DataFrame, value: str, total: int, task_rows: int) -> tuple[float, ...]:
    """About equally filled cut points of ``value``; at most MAX_PIECES numbers reach the driver.

    Only the choice of cut points is sampled. Any points give the same result, better ones give evener tasks.
    """
    pieces = min(MAX_PIECES, math.ceil(total / task_rows))
    if pieces < 2:
        return ()
    fraction = SAMPLES_PER_PIECE * pieces / total
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    picked = known if fraction >= 1 else known.sample(fraction, seed=17)
    shares = [i / pieces for i in range(1, pieces)]
    found = picked.agg(F.percentile_approx(F.col(value).cast("double"), shares, 10 * MAX_PIECES).alias("p")).first()
    return tuple(sorted(set(found["p"] or [])))


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null being equal to null; the keys are kept once, as the left side has them.

    Series without a key are series like the others: an ordinary join would lose them.
    """
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    joined = left.join(renamed, same[0] if len(same) == 1 else _all(same), how)
    return joined.drop(*[f"_right_{k}" for k in keys])


def _all(conditions):
    whole = conditions[0]
    for one in conditions[1:]:
        whole = whole & one
    return whole


def add_piece(df: DataFrame, value: str, points: Sequence[float], out: str = "_piece") -> DataFrame:
    """Number of cut points at or below ``value``: non-decreasing in it, found by binary search in the JVM.

    As in an ascending order, null comes before all values (piece 0) and not-a-number after them (the last one).
    """
    if not points:
        return df.withColumn(out, F.lit(0))
    cuts = [-math.inf, *points, math.inf]
    number = F.col(value).cast("double")
    placed = F.when(number.isNull(), F.lit(-math.inf)).when(F.isnan(number), F.lit(math.inf)).otherwise(number)
    numeric = df.withColumn("_cut_by", placed)
    cut = Bucketizer(splits=cuts, inputCol="_cut_by", outputCol="_cut", handleInvalid="error").transform(numeric)
    return cut.withColumn(out, F.col("_cut").cast("int")).drop("_cut", "_cut_by")


@dataclass(frozen=True)
class SeriesLayout:
    """``points`` cut the ordering value of long series; ``block`` is the row count of a positional block.

    Both are empty when every series fits a task.
    """

    points: tuple[float, ...] = ()
    block: int | None = None

    @classmethod
    def fit(cls, df: DataFrame, by: str, value: str, task_rows: int | None = None) -> SeriesLayout:
        """Measure series lengths (one pre-aggregated pass); sample cut points only if one is too long.

        The cut points split *all* rows of long series evenly, hence bound each one's share per piece too.
        """
        task_rows = task_rows_of(df, task_rows)
        sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_rows"))
        over = F.col("_rows") > task_rows
        seen = sizes.agg(
            F.max("_rows").alias("longest"), F.sum(F.when(over, F.col("_rows"))).alias("hot_rows")
        ).first()
        if not seen["longest"] or seen["longest"] <= task_rows:
            return cls()
        long = sizes.where(over).select(F.col(by).alias("_long"))
        hot = df.join(long, F.col(by).eqNullSafe(F.col("_long")), "left_semi")
        return cls(split_points(hot, value, seen["hot_rows"], task_rows), task_rows)

    @property
    def cut(self) -> bool:
        return self.block is not None


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    layout: SeriesLayout,
    pos: str = "_pos",
    total: str = "_n",
) -> DataFrame:
    """0-based position of each row in its series and the series length.

    ``order`` must be unique within ``by``; its first column is the value ``layout`` was fitted on. In pieces:
    rows are numbered inside (series, piece), and a small table of piece sizes gives each piece its offset.
    """
    by = list(by)
    if not layout.cut:
        whole = Window.partitionBy(*by)
        return df.withColumn(pos, F.row_number().over(whole.orderBy(*order)) - 1).withColumn(
            total, F.count(F.lit(1)).over(whole).cast("long")
        )
    pieces = add_piece(df, order[0], layout.points)
    sizes = pieces.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *by,
        "_piece",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(whole).alias(total),
    )
    local = F.row_number().over(Window.partitionBy(*by, "_piece").orderBy(*order))
    numbered = join_on_keys(pieces.withColumn("_local", local), offsets, [*by, "_piece"])
    return numbered.withColumn(pos, (F.col("_offset") + F.col("_local") - 1).cast("long")).drop(
        "_piece", "_local", "_offset"
    )


def number_sorted(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """The rows with ``out``: 0, 1, 2, ... in ascending order of columns that tell all rows apart.

    Spark deals the rows to ranges at sampled values of ``order`` and sorts each; the rows are written with their place
    in their range, and the sizes of the ranges before it, one number a task, give the rest. The result is read from
    files, so that a small one is known to be small.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_place", F.monotonically_increasing_id()), "sorted-ranges")
    # The upper bits of such a number are the task's, the lower 33 count its rows.
    placed = placed.withColumn("_range", F.shiftright("_place", 33))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    number = F.col("_offset") + F.col("_place").bitwiseAND((1 << 33) - 1)
    return materialize(placed.join(offsets, "_range").select(*df.columns, number.alias(out)), "numbered")


def add_block(df: DataFrame, layout: SeriesLayout, pos: str, out: str = "_block") -> DataFrame:
    """Positional block of a row; one single block when series are short."""
    return df.withColumn(out, F.floor(F.col(pos) / F.lit(layout.block)) if layout.cut else F.lit(0).cast("long"))


def add_halo(df: DataFrame, layout: SeriesLayout, pos: str, ahead: int) -> DataFrame:
    """Give each block the ``ahead`` rows that follow it, so frames never cross a block border.

    Adds ``_block`` and ``_own`` (false for the copied rows). Without a cut nothing is copied.
    """
    if not layout.cut or ahead <= 0:
        return add_block(df, layout, pos).withColumn("_own", F.lit(True))
    size = max(layout.block, ahead)
    home = F.floor(F.col(pos) / F.lit(size))
    copied = (F.col(pos) % size < ahead) & (home > 0)
    blocks = F.when(copied, F.array(home, home - 1)).otherwise(F.array(home))
    return df.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == home)


def running_totals(
    df: DataFrame,
    value: str,
    sums: Sequence[str],
    descending: bool = False,
    task_rows: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Exact running sums ``cum_<s>`` (inclusive) over a table ordered by the unique column ``value``.

    Small tables are ordered in one task, whose size has been counted. Larger ones are cut into evenly filled
    pieces: sums per piece, a running sum over that small table, then running sums inside each piece.
    """
    rows = df.count() if rows is None else rows
    points = split_points(df, value, rows, task_rows_of(df, task_rows))
    order = F.desc(value) if descending else F.asc(value)
    upto = (Window.unboundedPreceding, Window.currentRow)
    if not points:
        local = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(*upto)
        return df.select("*", *[F.sum(s).over(local).alias(f"cum_{s}") for s in sums])
    pieces = add_piece(df, value, points)
    step = F.desc("_piece") if descending else F.asc("_piece")
    before = Window.partitionBy(F.lit(0)).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.groupBy("_piece").agg(*[F.sum(s).alias(f"_all_{s}") for s in sums])
    carried = totals.select(
        "_piece", *[F.coalesce(F.sum(f"_all_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums]
    )
    local = Window.partitionBy("_piece").orderBy(order).rowsBetween(*upto)
    within = pieces.select("*", *[F.sum(s).over(local).alias(f"_in_{s}") for s in sums])
    # At most MAX_PIECES + 1 rows: a proven bound for the broadcast.
    joined = within.join(F.broadcast(carried), "_piece")
    cums = [(F.col(f"_before_{s}") + F.col(f"_in_{s}")).alias(f"cum_{s}") for s in sums]
    return joined.select(*df.columns, *cums)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], shares: Sequence[float], task_rows: int | None = None
) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles of each column over its non-null values; None when it has none.

    The exact ``percentile`` aggregate keeps every distinct value in one task, so it serves only counted,
    bounded inputs. Beyond that the columns are cut into evenly filled pieces, pieces are counted, and only
    the few pieces that hold a wanted rank are ranked.
    """
    columns, shares = list(columns), [float(s) for s in shares]
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    task_rows = task_rows_of(df, task_rows)
    largest = max(counts.values(), default=0)
    if largest <= task_rows:
        row = df.agg(*[F.percentile(F.col(c), F.array(*[F.lit(s) for s in shares])).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns}

    ranks = {c: sorted({r for s in shares for r in _neighbours(counts[c], s)}) for c in columns if counts[c]}
    points = _column_points(df, list(ranks), largest, task_rows)
    entries = []
    for c in ranks:
        df = add_piece(df.withColumn(f"_v_{c}", F.coalesce(F.col(c), F.lit(0.0))), f"_v_{c}", points[c], f"_p_{c}")
        entries.append(
            F.struct(
                F.lit(c).alias("name"), F.col(c).cast("double").alias("value"), F.col(f"_p_{c}").alias("piece")
            )
        )
    long = df.select(F.inline(F.array(*entries))).where("value is not null")
    # (column, piece) counts: bounded by columns x MAX_PIECES, so they may be looked at on the driver.
    sizes = sorted((r["name"], r["piece"], r["count"]) for r in long.groupBy("name", "piece").count().collect())
    wanted, start, current = [], 0, None
    for name, piece, size in sizes:
        start = start if name == current else 0
        current = name
        inside = [r - start for r in ranks[name] if start <= r < start + size]
        if inside:
            wanted.append((name, piece, start, inside))
        start += size
    needed = df.sparkSession.createDataFrame(wanted, "name string, piece int, start long, inside array<long>")
    tied = long.join(F.broadcast(needed), ["name", "piece"]).groupBy("name", "piece", "value").agg(
        F.count(F.lit(1)).alias("ties"), F.first("start").alias("start"), F.first("inside").alias("inside")
    )
    upto = Window.partitionBy("name", "piece").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = tied.withColumn("upto", F.sum("ties").over(upto))
    hits = placed.select(
        "name",
        "value",
        "start",
        F.explode(F.filter("inside", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("ties")))).alias("r"),
    )
    at = {(h["name"], h["start"] + h["r"]): h["value"] for h in hits.collect()}
    result: dict[str, list[float] | None] = dict.fromkeys(columns)
    for c in ranks:
        values = []
        for share in shares:
            place = (counts[c] - 1) * share
            low, high = _neighbours(counts[c], share)
            values.append(at[c, low] + (at[c, high] - at[c, low]) * (place - low))
        result[c] = values
    return result


def _neighbours(count: int, share: float) -> tuple[int, int]:
    place = (count - 1) * share
    return math.floor(place), math.ceil(place)


def _column_points(df: DataFrame, columns: list[str], total: int, task_rows: int) -> dict[str, tuple[float, ...]]:
    pieces = min(MAX_PIECES, math.ceil(total / task_rows))
    fraction = SAMPLES_PER_PIECE * pieces / total
    picked = df if fraction >= 1 else df.sample(fraction, seed=17)
    shares = [i / pieces for i in range(1, pieces)]
    row = picked.agg(
        *[F.percentile_approx(F.col(c).cast("double"), shares, 10 * MAX_PIECES).alias(c) for c in columns]
    ).first()
    return {c: tuple(sorted(set(row[c] or []))) for c in columns}
