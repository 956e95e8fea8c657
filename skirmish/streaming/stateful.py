"""Streams with state of their own: rows of a key folded in order of time, with timers and expiry.

Rows wait in the state of their key until the watermark has passed them, so the fold sees them in order, whichever batches they
arrived in, and a stream gives what its batch form gives. A key that has had no row for ``idle_s`` is forgotten. These jobs
need the RocksDB state store (``with_state_store``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: State, row -> state and rows that go out; the state is a tuple, or None at a key's first row.
Fold = Callable[[tuple | None, tuple], tuple[tuple, list[tuple]]]


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class OrderedFold(StatefulProcessor):
    """Folds each key's rows (key, event time, then ``columns``) in the order of these; the first of them is the time in microseconds."""

    def __init__(self, fold: Fold, columns: dict[str, str], state_type: str, out: list[str], idle_s: float):
        self.fold, self.columns, self.state_type, self.out, self.idle_us = fold, columns, state_type, out, int(idle_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"`{c}` {t}" for c, t in self.columns.items()))
        self.kept = handle.getValueState("kept", f"last long, {self.state_type}")

    def close(self) -> None:
        pass

    def _alarm(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        plain = {"bigint": int, "int": int, "double": float, "float": float, "boolean": bool, "string": str}  # pandas has longs beside nulls as floats
        kinds = [plain[t] for t in self.columns.values()]
        new = [tuple(None if pd.isna(x) else k(x) for k, x in zip(kinds, r, strict=True)) for frame in rows for r in frame.iloc[:, 2:].itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            self._alarm(min(r[0] for r in new))
        yield pd.DataFrame(columns=[*self.out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in waiting if r[0] < now), key=lambda r: tuple((x is not None, x) for x in r))
        later = [r for r in waiting if r[0] >= now]
        kept = tuple(self.kept.get()) if self.kept.exists() else None
        rows: list[tuple] = []
        for r in due:
            state = kept[1:] if kept is not None and r[0] - kept[0] <= self.idle_us else None
            state, out = self.fold(state, r)
            kept = (r[0], *state)
            rows += [(*key, *x) for x in out]
        if due:
            self.kept.update(kept)
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if later:
            self._alarm(min(r[0] for r in later))
        elif kept is not None:
            if kept[0] + self.idle_us < now:
                self.kept.clear()
            else:
                self._alarm(kept[0] + self.idle_us)
        yield pd.DataFrame(rows, columns=[*self.out])


def folded(stream: DataFrame, key: str, ts: str, columns: list[str], fold: Fold, state_type: str, out_type: str, idle_s: float, watermark: str) -> DataFrame:
    """(key, columns of out_type) that ``fold`` gives for the rows (_us, columns) of each key in order; times go in and out as microseconds."""
    rows = stream.withWatermark(ts, watermark).select(key, ts, F.unix_micros(ts).alias("_us"), *columns)
    types = dict(rows.dtypes)
    own = {c: types[c] for c in ("_us", *columns)}
    kind = StructType.fromDDL(f"`{key}` {types[key]}, {out_type}")
    processor = OrderedFold(fold, own, state_type, kind.names, idle_s)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=kind, outputMode="Append", timeMode="EventTime")


def _time(column: str) -> Column:
    return F.timestamp_micros(column).alias(column)


def family_backoff(stream: DataFrame, group: str, ts: str, order: list[str], gain: str, limit: int = 25, hold_s: int = 45 * 60, idle_s: int = 6 * 3600, watermark: str = "1 hour") -> DataFrame:
    """(group, at, until) whenever a group begins a back-off; the batch form is ``ordered.backoffs``.

    State of a group: results in a row without gain, and whether its run has had a gain. A constant group gives the global form.
    """

    def fold(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        streak, gained = state or (0, False)
        if (row[-1] or 0) > 0:
            return (0, True), []
        if gained or streak + 1 < limit:
            return (0 if gained else streak + 1, gained), []
        return (0, False), [(row[0], row[0] + hold_s * 1_000_000)]

    found = folded(stream, group, ts, [*order, gain], fold, "streak int, gained boolean", "at long, until long", idle_s, watermark)
    return found.select(group, _time("at"), _time("until"))


def state_changes(stream: DataFrame, key: str, ts: str, order: list[str], state: Column, idle_s: float = 30 * 86400, watermark: str = "1 hour") -> DataFrame:
    """(key, ts, the order's columns) of rows whose state differs from the one before of their key; the batch form is ``discovery.state_changes``.

    State of a key: the last hash. A key that was forgotten counts as new.
    """

    def fold(before: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        return (row[-1],), [] if before is not None and before[0] == row[-1] else [row[:-1]]

    rows = stream.withColumn("_state", F.xxhash64(state))
    types = dict(rows.dtypes)
    out = ", ".join(["_us long", *(f"`{c}` {types[c]}" for c in order)])
    found = folded(rows, key, ts, [*order, "_state"], fold, "state long", out, idle_s, watermark)
    return found.select(key, F.timestamp_micros("_us").alias(ts), *order)


def snapshot_deltas(stream: DataFrame, ts: str, done: Column, version: Column, size: str = "1 day", idle_s: float = 365 * 86400, watermark: str = "1 day") -> DataFrame:
    """A snapshot for each window that has events (totals so far, of all and of ``done``, and the last version in it) and its difference to the one before.

    The windows are counted first, in parallel; their rows, one a window, are then folded. The batch form is ``discovery.snapshot_deltas``
    over running totals. State: totals and version of the last snapshot.
    """

    def fold(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        start, n, finished, version = row[1:]
        total, all_done = (state[1] + n, state[2] + finished) if state else (n, finished)
        hours = (start - state[0]) / 3.6e9 if state else None
        more = (n, n if version == state[3] else None, n / hours if hours else None, 100.0 * n / finished if finished > 0 else None) if state else (None,) * 4
        return (start, total, all_done, version), [(start, total, *more)]

    w = F.window(ts, size)
    rows = stream.withWatermark(ts, watermark).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(done).alias("finished"), F.max(version.cast("string")).alias("version"))
    rows = rows.select(F.lit("all").alias("scope"), F.window_time("w").alias("_at"), F.unix_micros("w.start").alias("start"), "n", "finished", "version")
    kind = StructType.fromDDL("scope string, start long, total long, delta long, version_delta long, per_hour double, yield_per_100 double")
    columns = {"_us": "bigint", "start": "bigint", "n": "bigint", "finished": "bigint", "version": "string"}
    rows = rows.select("scope", "_at", F.unix_micros("_at").alias("_us"), "start", "n", "finished", "version")
    processor = OrderedFold(fold, columns, "start long, total long, finished long, version string", kind.names, idle_s)
    found = rows.groupBy("scope").transformWithStateInPandas(statefulProcessor=processor, outputStructType=kind, outputMode="Append", timeMode="EventTime")
    return found.drop("scope").withColumn("start", F.timestamp_micros("start"))


def sent_alarms(stream: DataFrame, key: str, ts: str, triggered: Column, cooldown_s: float, watermark: str = "1 hour") -> DataFrame:
    """(key, at) of triggered rows that are a cooldown after the last one sent of their key; the batch form is ``ordered.cooled_down``.

    State of a key: the time of the last one sent, forgotten once a cooldown has passed without a trigger.
    """

    def fold(sent: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        if sent is None or row[0] - sent[0] >= cooldown_s * 1e6:
            return (row[0],), [(row[0],)]
        return sent, []

    found = folded(stream.where(triggered), key, ts, [], fold, "sent long", "at long", cooldown_s, watermark)
    return found.select(key, _time("at"))


def best_of_sources(streams: list[DataFrame], key: str, ts: str, wait: str = "1 hour", watermark: str = "1 hour", ties: tuple[str, ...] = ()) -> DataFrame:
    """One record of each key, from the first of the sources (in the order given) that has one, and from it the earliest.

    Records of a key less than ``wait`` apart belong together and are held until the watermark has passed the last of them by that time, so the order of arrival
    doesn't matter. Batch and stream; a key that comes again later than that is a new record. Source and time are those of the record. Of
    records of one source and time the least by the columns ``ties`` counts.
    """
    both = None
    for rank, rows in enumerate(streams):
        rows = rows.withColumn("source_rank", F.lit(rank))
        both = rows if both is None else both.unionByName(rows)
    columns = [c for c in both.columns if c not in (key, ts)]
    rows = both.withColumn("_ts", F.col(ts)).withWatermark(ts, watermark)
    best = F.min_by(F.struct(F.col("_ts").alias(ts), *columns), F.struct("source_rank", "_ts", *ties)).alias("r")
    found = rows.groupBy(F.session_window(ts, wait).alias("w"), key).agg(best)
    return found.select(key, f"r.{ts}", *[f"r.{c}" for c in columns])
