"""Online normalisation and window cutting on a stream of signal rows.

Rows may arrive in any order within the watermark's delay. Each worker's rows wait in its state until the watermark has
passed their slice of event time; then they go, in order, to the recurrence or the window cutter. A worker thus needs
the rows of its open slices, which are in memory together, and a state of fixed size: the warm-up rows and moments, or
the last rows of the open window. A worker is called once in a trigger and its state comes with its rows, so that short
workers, however many, cost no talk with the state store of their own.

Rows of a slice that has been released are late. They are not dropped: they come out at once, marked ``late``, and
``drain`` writes them to a folder of their own, with their number. Rows without a worker are heartbeats, which only
move the watermark; ``drain`` ends with one, so that the last slices and short workers come out too.

State lives in RocksDB, which ``drain`` sets for its query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from signalspark.operators.normalize import online_states, warm_start

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1000
DAY = 86_400_000 * MICROS
#: Event time of the closing heartbeat, in microseconds: the year 2260. No later time moves the watermark.
CLOSING = 105_920 * DAY
#: Rows from the year 2250 on wait in one slice for the closing heartbeat.
LAST = CLOSING - 3_650 * DAY
#: Rows without a time come before all others.
FIRST = -(1 << 62)
WHOLE = ("tinyint", "smallint", "int", "bigint")
#: One window around all event times up to the year 2262: length, slide and start.
ALL_TIME = ("7300000 days", "7300000 days", "-7193349 days")


@dataclass(frozen=True)
class Arrival:
    """How rows are put in order: the watermark's ``delay``, the length of a slice, and after how long without newer
    rows a worker counts as ended (this may be noticed later, never sooner)."""

    delay: str = "1 hour"
    slice_ms: int = 3_600_000
    idle_ms: int = 86_400_000


class InOrder:
    """Hands each worker's rows to ``release`` as their slices close, sorted, and calls ``finish`` once it has ended.

    ``order`` columns sort the rows; the first is a time in microseconds. ``values`` are doubles. The state of a worker
    is the first slice that is not released, its newest row's time, whether it has ended, the columns of its waiting
    rows, and what a subclass keeps in ``own``.
    """

    def __init__(self, order: Sequence[str], kinds: Sequence[str], values: Sequence[str], worker: str, arrival: Arrival):
        self.worker, self.order, self.kinds, self.values = worker, list(order), list(kinds), list(values)
        self.names, self.arrival = [*order, *values], arrival

    def _row_fields(self, prefix: str) -> list[str]:
        kinds = [*self.kinds, *["double"] * len(self.values)]
        return [f"{prefix}{i} array<{k}>" for i, k in enumerate(kinds)]

    def own_fields(self) -> list[str]:
        raise NotImplementedError

    def own_start(self) -> list:
        raise NotImplementedError

    def release(self, rows: pd.DataFrame, own: list) -> pd.DataFrame:
        raise NotImplementedError

    def finish(self, own: list) -> pd.DataFrame:
        raise NotImplementedError

    def late_rows(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def state_fields(self) -> str:
        return ", ".join(["opened long, newest long, ended boolean", *self._row_fields("w"), *self.own_fields()])

    def columns_of(self, rows: pd.DataFrame) -> list[list]:
        out = []
        for c, kind in zip(self.order, self.kinds, strict=True):
            column = rows[c].tolist()
            # Whole numbers with nulls among them come as floats.
            if kind in WHOLE and rows[c].dtype.kind not in "iu":
                column = [None if v is None or v != v else int(v) for v in column]
            out.append(column)
        return out + [rows[c].to_numpy(dtype=float).tolist() for c in self.values]

    def _times(self, rows: pd.DataFrame) -> np.ndarray:
        at = rows[self.order[0]]
        if at.dtype.kind not in "iu":
            at = at.astype(float).fillna(float(FIRST))
        return np.minimum(at.to_numpy(dtype=np.int64), LAST)

    def _sorted(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(self.order, kind="stable", ignore_index=True)
        timeless = rows[self.order[0]].isna()
        return pd.concat([rows[timeless], rows[~timeless]], ignore_index=True) if timeless.any() else rows

    def rows_of(self, columns: Sequence[list]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(self.names, columns, strict=True)))

    def __call__(self, key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] is None or key[0] != key[0]:
            return
        width, slice_ms = len(self.names), self.arrival.slice_ms
        if state.exists:
            opened, newest, ended, *held = state.get
            parts, own = ([self.rows_of(held[:width])] if len(held[0]) else []), held[width:]
        else:
            opened, newest, ended, parts, own = -(1 << 62), None, False, [], self.own_start()
        for chunk in () if state.hasTimedOut else chunks:
            at = self._times(chunk)
            late = at // (slice_ms * MICROS) < opened
            if late.any():
                yield self._named(key, self.late_rows(chunk[late]), True)
            if not late.all():
                last = int(at[~late].max())
                newest, ended = last if newest is None else max(newest, last), False
                parts.append(chunk.loc[~late, self.names])
        now = max(0, state.getCurrentWatermarkMs())
        waiting = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True) if parts else None
        if waiting is not None:
            piece = self._times(waiting) // (slice_ms * MICROS)
            ready = (piece + 1) * slice_ms <= now
            if ready.any():
                opened = int(piece[ready].max()) + 1
                yield self._named(key, self.release(self._sorted(waiting[ready]), own), False)
                waiting, piece = waiting[~ready], piece[~ready]
        left = waiting is not None and len(waiting) > 0
        due = (int(piece.min()) + 1) * slice_ms if left else newest // MICROS + self.arrival.idle_ms
        if not left and not ended and due <= now:
            ended = True
            yield self._named(key, self.finish(own), False)
        state.update((opened, newest, ended, *(self.columns_of(waiting) if left else [[]] * width), *own))
        if left or not ended:
            state.setTimeoutTimestamp(due)

    def _named(self, key, out: pd.DataFrame, late: bool) -> pd.DataFrame:
        out.insert(0, self.worker, pd.Series([key[0]] * len(out), index=out.index, dtype=object))
        out["late"] = late
        return out


class Normalizer(InOrder):
    """``own``: the columns of the warm-up rows released before, then means and variances once it is complete."""

    def __init__(self, *args, alpha: float, warm: int):
        super().__init__(*args)
        self.alpha, self.warm = alpha, warm

    def own_fields(self) -> list[str]:
        return [*self._row_fields("h"), "mu array<double>", "var array<double>"]

    def own_start(self) -> list:
        return [*[[] for _ in self.names], None, None]

    def _frame(self, rows: pd.DataFrame, z: dict | None) -> pd.DataFrame:
        out = rows[self.order].reset_index(drop=True)
        for c in self.values:
            x = rows[c].to_numpy(dtype=float)
            out[c], out[f"baseline_mu_{c}"], out[f"baseline_sigma_{c}"] = (x, np.nan, np.nan) if z is None else z[c]
        return out

    def late_rows(self, rows: pd.DataFrame) -> pd.DataFrame:
        return self._frame(rows, None)

    def release(self, rows: pd.DataFrame, own: list) -> pd.DataFrame:
        if own[-1] is None:
            if len(own[0]):
                rows = pd.concat([self.rows_of(own[:-2]), rows], ignore_index=True)
            if len(rows) < self.warm:
                own[:-2] = self.columns_of(rows)
                return self._frame(rows[:0], None)
            self._start(rows, own)
        return self._scored(rows, own)

    def finish(self, own: list) -> pd.DataFrame:
        """A worker that ended before its warm-up was complete: started from the rows it has."""
        rows = self.rows_of(own[:-2])
        if not len(rows):
            return self._frame(rows, None)
        self._start(rows, own)
        return self._scored(rows, own)

    def _start(self, rows: pd.DataFrame, own: list) -> None:
        starts = [warm_start(rows[c].to_numpy(dtype=float)[: self.warm]) for c in self.values]
        own[:] = [*[[] for _ in self.names], [float(m) for m, _ in starts], [float(s) ** 2 for _, s in starts]]

    def _scored(self, rows: pd.DataFrame, own: list) -> pd.DataFrame:
        mu, var = (list(m) for m in own[-2:])
        z = {}
        for j, c in enumerate(self.values):
            x = rows[c].to_numpy(dtype=float)
            means, sigmas, (mu[j], var[j]) = online_states(x, mu[j], var[j], self.alpha)
            z[c] = (np.where(np.isfinite(x), x, means) - means) / np.maximum(sigmas, 1e-6), means, sigmas
        own[-2:] = [float(m) for m in mu], [float(v) for v in var]
        return self._frame(rows, z)


class WindowCutter(InOrder):
    """``own``: the number of rows released, and both values of the last ones, which open windows need."""

    def __init__(self, *args, length: int, horizon: int, step: int):
        super().__init__(*args)
        self.length, self.span, self.step = length, length + horizon, max(1, step)

    def own_fields(self) -> list[str]:
        return ["seen long", "x array<double>", "y array<double>"]

    def own_start(self) -> list:
        return [0, [], []]

    def _frame(self, starts, means, labels) -> pd.DataFrame:
        starts = np.asarray(starts, dtype=np.int64)
        return pd.DataFrame({"start_idx": starts, "label_idx": starts + self.span - 1, "mean": means, "y": labels})

    def late_rows(self, rows: pd.DataFrame) -> pd.DataFrame:
        """A late row has no place; its value and label stand in the window's columns."""
        out = self._frame(np.zeros(len(rows)), rows[self.values[0]].to_numpy(float), rows[self.values[1]].to_numpy(float))
        return out.assign(start_idx=-1, label_idx=-1)

    def release(self, rows: pd.DataFrame, own: list) -> pd.DataFrame:
        seen, x, y = own
        x, y = (np.concatenate([old, rows[c].to_numpy(float)]) for old, c in zip((x, y), self.values, strict=True))
        first = seen - (len(x) - len(rows))
        seen += len(rows)
        starts = np.arange(first + (-first) % self.step, seen - self.span + 1, self.step)
        kept = max(0, len(x) - (self.span - 1))
        own[:] = int(seen), x[kept:].tolist(), y[kept:].tolist()
        if not len(starts):
            return self._frame([], [], [])
        views = np.lib.stride_tricks.sliding_window_view(x, self.length)[starts - first]
        return self._frame(starts, views.mean(axis=1), y[starts - first + self.span - 1])

    def finish(self, own: list) -> pd.DataFrame:
        """Windows come out as soon as their label is known; an ended worker has none left."""
        return self._frame([], [], [])


def _keyed(df: DataFrame, worker: str, order: Sequence[str], values: Sequence[str], arrival: Arrival, make, fields: str) -> DataFrame:
    """Runs a processor per worker.

    The watermark moves with the event time, but the rows carry the time of a window around all of it: Spark would
    silently drop rows behind the watermark otherwise, and they are late only if their own worker's slice is gone.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    at = F.coalesce(F.least(F.col(order[0]), F.lit(CLOSING)), F.lit(0))
    event = F.timestamp_micros(at)
    timed = df.withColumn("_event", event).withWatermark("_event", arrival.delay)
    timed = timed.withColumn("_all_time", F.window("_event", *ALL_TIME))
    numbers = [F.col(c).cast("double").alias(c) for c in values]
    rows = timed.select(worker, *order, *numbers, F.window_time("_all_time").alias("_lasting"))
    processor = make(order, [kinds[c] for c in order], values, worker, arrival)
    schema = f"`{worker}` {kinds[worker]}, {fields}, late boolean"

    def step(key, chunks, state):
        return processor(key, chunks, state)

    timeout = GroupStateTimeout.EventTimeTimeout
    out = rows.groupBy(worker).applyInPandasWithState(step, schema, processor.state_fields(), "append", timeout)
    # The writer sorts by late, and Spark's sort can't take the rows as they come from Arrow; a projection copies them.
    return out.withColumn("late", F.coalesce("late", F.lit(False)))


def normalize_stream(
    df: DataFrame, columns: Sequence[str], worker: str, order: Sequence[str], alpha: float, warmup: int, arrival: Arrival = Arrival()
) -> DataFrame:
    """Exponential z-score per worker, as the batch form gives it for the rows in order.

    The first of ``order`` is a time in microseconds, and ``order`` tells a worker's rows apart. Rows wait until the
    warm-up is complete, or until the worker has ended with fewer. Late rows keep their values and have no baseline.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    fields = [f"`{c}` {kinds[c]}" for c in order]
    fields += [f"`{c}` double, `baseline_mu_{c}` double, `baseline_sigma_{c}` double" for c in columns]

    def make(*args) -> Normalizer:
        return Normalizer(*args, alpha=alpha, warm=max(3, warmup))

    return _keyed(df, worker, list(order), list(columns), arrival, make, ", ".join(fields))


def window_stream(
    df: DataFrame, column: str, label: str, worker: str, order: Sequence[str], length: int, horizon: int, step: int = 1,
    arrival: Arrival = Arrival(),
) -> DataFrame:
    """Windows of ``length`` rows with the label ``horizon`` rows later, once that row's slice is released.

    A late row comes out with start -1, its value as ``mean`` and its label as ``y``.
    """

    def make(*args) -> WindowCutter:
        return WindowCutter(*args, length=length, horizon=horizon, step=step)

    fields = "start_idx long, label_idx long, mean double, y double"
    return _keyed(df, worker, list(order), [column, label], arrival, make, fields)


def with_heartbeats(df: DataFrame, folder: str) -> DataFrame:
    """The stream and the heartbeats that ``drain`` puts into ``folder``."""
    df.sparkSession.createDataFrame([], df.schema).write.mode("ignore").parquet(folder)
    return df.unionByName(df.sparkSession.readStream.schema(df.schema).parquet(folder))


@dataclass(frozen=True)
class Drained:
    """``rows`` in time, the side output ``late``, and how many rows that has."""

    rows: DataFrame
    late: DataFrame

    def late_count(self) -> int:
        return self.late.count()


def drain(stream: DataFrame, path: str, heartbeats: str | None = None, time: str | None = None) -> Drained:
    """Process what the source holds now, into files, and read the results.

    With the folder and time column of ``with_heartbeats`` the stream is closed: a heartbeat from the far future
    releases all that waits. Otherwise the rows of open slices stay in the state for the next call.
    """
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS_DB)

    def run() -> None:
        query = (
            stream.writeStream.format("parquet")
            .partitionBy("late")
            .option("path", f"{path}/rows")
            .option("checkpointLocation", f"{path}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    try:
        run()
        if heartbeats is not None:
            empty = spark.read.parquet(heartbeats).schema
            closing = spark.range(1).select(
                *[F.lit(CLOSING if f.name == time else None).cast(f.dataType).alias(f.name) for f in empty]
            )
            closing.write.mode("append").parquet(heartbeats)
            run()
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
    rows = spark.read.schema(stream.schema).parquet(f"{path}/rows")
    return Drained(*[rows.where(F.col("late") == late).drop("late") for late in (False, True)])
