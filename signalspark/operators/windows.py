"""Sliding windows with a forecast horizon, per worker and split."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalspark.layout import SeriesLayout, add_halo
from signalspark.schema import SignalSchema


#: Sample cells of the windows that are returned at once.
CELLS = 1 << 20


#: Names of doubles made from a window's arrays, by name, and what makes them.
Summary = tuple[list[str], Callable[[dict[str, pa.Array]], list[pa.Array]]]


def _cut_sorted(
    span: int, scalars: list[tuple[int, int]], arrays: list[tuple[int, int, int]], names: list[str], summary: Summary | None
) -> Callable:
    """Slices windows out of sorted rows: worker, split, whether the row is its block's first, whether it starts a
    window, and the source columns.

    ``scalars`` are (column, offset) and ``arrays`` (column, first offset, count). A window's rows follow its start
    without a gap. Only the rows that a later window may need are carried from batch to batch. With a ``summary`` its
    values stand in for the arrays, which then never leave the task's process.
    """
    width = sum(count for *_, count in arrays) + len(scalars) + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            rows = rows.combine_chunks()
            columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns]
            block = np.cumsum(columns[2].to_numpy(zero_copy_only=False))
            starts = np.flatnonzero(columns[3].to_numpy(zero_copy_only=False))
            starts = starts[starts + span <= len(rows)]
            starts = starts[block[starts] == block[starts + span - 1]]
            step = max(1, CELLS // width)
            for i in range(0, len(starts), step):
                some = starts[i : i + step]
                out = [c.take(pa.array(some)) for c in columns[:2]]
                out += [columns[4 + c].take(pa.array(some + offset)) for c, offset in scalars]
                for c, first, count in arrays:
                    at = (some[:, None] + np.arange(first, first + count)).ravel()
                    ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * count)
                    out.append(pa.ListArray.from_arrays(ends, columns[4 + c].take(pa.array(at))))
                if summary is None:
                    yield pa.RecordBatch.from_arrays(out, names=names)
                    continue
                first = 2 + len(scalars)
                made = summary[1](dict(zip(names[first:], out[first:], strict=True)))
                yield pa.RecordBatch.from_arrays([*out[:first], *made], names=[*names[:first], *summary[0]])
            # Starts among the last span - 1 rows are still open; those in front of them have been cut.
            held = rows.slice(max(0, len(rows) - span + 1))
            if span == 1:
                held = None

    return cut


@dataclass(frozen=True)
class Cutter:
    """Window geometry over rows placed by ``_seg_pos`` of ``_seg_n``.

    Single values of a window are frames starting at its first row; sample arrays are slices of the sorted rows, made
    at window starts only, so their work falls with the step. Both share one sort and one exchange on (worker, split,
    block). Long series are cut into blocks that also hold the rows just after them; window starts stay with the block
    that owns the row.
    """

    schema: SignalSchema
    length: int
    horizon: int
    step: int = 1
    layout: SeriesLayout = SeriesLayout()

    @property
    def series(self) -> Window:
        return Window.partitionBy(self.schema.worker, "split", "_block").orderBy("_seg_pos")

    @property
    def frame(self):
        return self.series.rowsBetween(0, self.length - 1)

    def at(self, column: str, offset: int) -> Column:
        return F.lead(column, offset).over(self.series)

    def last(self, column: str) -> Column:
        return self.at(column, self.length - 1)

    def label(self, column: str) -> Column:
        return self.at(column, self.length + self.horizon - 1)

    def samples(self, column: str) -> Column:
        """The window's samples in order; NaN stands in for null, which a collected list would skip."""
        return F.collect_list(F.coalesce(F.col(column).cast("double"), F.lit(float("nan")))).over(self.frame)

    def meta(self) -> list[Column]:
        t = self.schema.time_idx
        return [
            F.col(t).cast("int").alias("start_idx"),
            self.last(t).cast("int").alias("end_idx"),
            self.label(t).cast("int").alias("label_time_idx"),
            self.label(self.schema.stress).alias("y_stress"),
            self.label(self.schema.comfort).alias("y_comfort"),
        ]

    def _haloed(self, df: DataFrame) -> tuple[DataFrame, Column]:
        if not {"_seg_pos", "_seg_n"} <= set(df.columns):
            raise ValueError("rows must be placed in their split first")
        haloed = add_halo(df, self.layout, "_seg_pos", self.length + self.horizon - 1)
        starts = F.col("_own") & (F.col("_seg_pos") % max(1, self.step) == 0)
        return haloed, starts & (F.col("_seg_pos") <= F.col("_seg_n") - (self.length + self.horizon))

    def cut(self, df: DataFrame, columns: Sequence[Column]) -> DataFrame:
        """One row per window start: worker, split and the given frame columns."""
        haloed, starts = self._haloed(df)
        wide = haloed.select(self.schema.worker, "split", starts.alias("_start"), *columns)
        return wide.where("_start").drop("_start")

    def take(
        self,
        df: DataFrame,
        scalars: Mapping[str, tuple[Column, int]],
        arrays: Mapping[str, tuple[Column, int, int]],
        summary: Summary | None = None,
    ) -> DataFrame:
        """One row per window start: worker, split, values at an offset, and runs of ``count`` values from one on.

        Nulls keep their place in a run. A value at offset 0 may be a frame column. With a ``summary`` the row has the
        doubles that it makes from the runs, instead of the runs.
        """
        haloed, starts = self._haloed(df)
        named = [c.alias(f"_c{i}") for i, (c, *_) in enumerate([*scalars.values(), *arrays.values()])]
        # The window leaves each partition with whole blocks in order; sorting by the same costs nothing.
        first = (F.row_number().over(self.series) == 1).alias("_first")
        rows = haloed.select(self.schema.worker, "split", first, starts.alias("_start"), *named, "_block", "_seg_pos")
        rows = rows.sortWithinPartitions(self.schema.worker, "split", "_block", "_seg_pos").drop("_block", "_seg_pos")
        kinds = [f.dataType.simpleString() for f in rows.schema]
        fields = [f"`{self.schema.worker}` {kinds[0]}", f"split {kinds[1]}"]
        fields += [f"`{n}` {kinds[4 + i]}" for i, n in enumerate(scalars)]
        if summary is None:
            fields += [f"`{n}` array<{kinds[4 + len(scalars) + i]}>" for i, n in enumerate(arrays)]
        else:
            fields += [f"`{n}` double" for n in summary[0]]
        at = [(i, offset) for i, (_, offset) in enumerate(scalars.values())]
        runs = [(len(at) + i, first, count) for i, (_, first, count) in enumerate(arrays.values())]
        names = [self.schema.worker, "split", *scalars, *arrays]
        return rows.mapInArrow(_cut_sorted(self.length + self.horizon, at, runs, names, summary), ", ".join(fields))

    def marks(self) -> dict[str, tuple[Column, int]]:
        """The columns of ``meta`` as values at an offset."""
        schema, label = self.schema, self.length + self.horizon - 1
        time = F.col(schema.time_idx).cast("int")
        return {
            "start_idx": (time, 0),
            "end_idx": (time, self.length - 1),
            "label_time_idx": (time, label),
            "y_stress": (F.col(schema.stress), label),
            "y_comfort": (F.col(schema.comfort), label),
        }

    def run(self, column: str) -> tuple[Column, int, int]:
        """The window's samples; NaN stands in for null."""
        return F.coalesce(F.col(column).cast("double"), F.lit(float("nan"))), 0, self.length

    def known(self, column: str) -> tuple[Column, int, int]:
        """The window's samples, nulls included."""
        return F.col(column).cast("double"), 0, self.length


def window_meta(df: DataFrame, cutter: Cutter) -> DataFrame:
    return cutter.cut(df, cutter.meta())


def window_table(df: DataFrame, cutter: Cutter) -> DataFrame:
    """Windows with one sample array per channel, labels and time marks."""
    channels = cutter.schema.channels(df.columns)
    return cutter.take(df, cutter.marks(), {c: cutter.run(c) for c in channels})


def shortest_series(df: DataFrame, worker: str) -> int:
    """Fewest rows of any (worker, split)."""
    return df.groupBy(worker, "split").count().agg(F.min("count")).first()[0] or 0


def fitted_length(shortest: int, length: int, horizon: int) -> int:
    """The window length the shortest series allows."""
    if shortest <= horizon:
        raise ValueError("split segments are too short for the horizon")
    return max(4, shortest - horizon - 1) if shortest <= length else length


def length_fit(df: DataFrame, worker: str, length: int, horizon: int) -> DataFrame:
    """One row: the fewest rows of any (worker, split), and the window length they allow, 4 at least.

    The rule of ``fitted_length`` as a report: series too short for the horizon are shown, not refused.
    """
    shortest = F.col("shortest")
    shrunk = F.greatest(F.lit(4), shortest - (horizon + 1))
    fitted = F.when(shortest <= length, shrunk).otherwise(length).cast("long")
    rows = df.groupBy(worker, "split").count().agg(F.min("count").alias("shortest"))
    return rows.withColumn("window_length", fitted)


def require_windows(counts: DataFrame) -> DataFrame:
    """The window counts of ``balance``, unless there is no window at all: a look at a few stored rows."""
    if counts.isEmpty():
        raise ValueError("no windows: every series is shorter than a window and its horizon")
    return counts


def balance(windows: DataFrame, label: str = "y_stress") -> DataFrame:
    return windows.groupBy("split", label).agg(F.count(F.lit(1)).alias("windows"))
