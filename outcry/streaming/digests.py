"""Digests of alerts: one message for each saved search and day or week, once the period is over.

Alerts of frequency ``immediate`` pass as they come. For the others a state holds the open periods of each search with their
counts and a timer at the end of each; when the watermark passes it, the digest comes out and the state of the period goes. A
period is closed ``delay`` after its end, counted in the time alerts happen, so a replay gives the same digests as the first run.

Tasks fold the alerts of a batch to one row for each search and period before any of them is shuffled, so a search that matches a
third of all rows sends as many rows as there are tasks. Null search ids, times and unknown frequencies take no part.

The time of an alert is the time it was raised, so it lies behind earlier batches by no more than the delay; what lies further behind
would be dropped by the watermark (``late.DropWatch`` counts such rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from outcry.operators.series import week_start
from outcry.streaming.base import run_available, write_batch
from outcry.streaming.windows import event_time, wall_time

PERIODS = ("daily", "weekly")
_KEYS = ["search_id", "period_start", "period_end"]
#: Searches and periods that a task holds before it sends them on, and periods of a search that are merged before its state is asked.
HELD_ROWS = 100_000
_PARTIAL = "search_id string, period_start timestamp, period_end timestamp, first_at timestamp, last_at timestamp, n long"
_OUT = T.StructType([T.StructField("search_id", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("period_start", "first_at", "last_at", "n"))])


def period(frequency: Column, at: Column) -> tuple[Column, Column]:
    """(first day, day behind the last) of the period that a time falls in; weeks begin on Sunday."""
    day = F.when(frequency == "daily", at.cast("date")).when(frequency == "weekly", week_start(at))
    return day, F.date_add(day, F.when(frequency == "daily", 1).otherwise(7))


def _folded(alerts: DataFrame, at: str) -> DataFrame:
    """Partial counts of each task, by search and period."""
    start, end = period(F.col("frequency"), F.col(at))
    rows = alerts.where(F.col("frequency").isin(*PERIODS) & F.col("search_id").isNotNull() & F.col(at).isNotNull()).select(
        F.col("search_id").cast("string").alias("search_id"), event_time(start.cast("timestamp_ntz")).alias("period_start"), event_time(end.cast("timestamp_ntz")).alias("period_end"), event_time(F.col(at)).alias("at"))

    def merged(parts: pa.Table, first: str, last: str, n: tuple[str, str]) -> pa.Table:
        found = parts.group_by(_KEYS).aggregate([(first, "min"), (last, "max"), n])
        return found.select([*_KEYS, f"{first}_min", f"{last}_max", "_".join(n)]).rename_columns([*_KEYS, "first_at", "last_at", "n"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the counts of the task so far, and parts not merged into them yet
        held, waiting, size = [], [], 0
        for batch in batches:
            waiting.append(merged(pa.Table.from_batches([batch]), "at", "at", ("at", "count")))
            size += waiting[-1].num_rows
            if size >= HELD_ROWS:
                table = merged(pa.concat_tables(held + waiting), "first_at", "last_at", ("n", "sum"))
                held, waiting, size = [table], [], 0
                if table.num_rows >= HELD_ROWS:
                    yield from table.combine_chunks().to_batches()
                    held = []
        if held or waiting:
            yield from merged(pa.concat_tables(held + waiting), "first_at", "last_at", ("n", "sum")).combine_chunks().to_batches()

    return rows.mapInArrow(fold, _PARTIAL)


class Digest(StatefulProcessor):
    """Open periods of a search by their end, in microseconds; a search has one frequency, so an end names a period."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField(c, T.LongType()) for c in ("start", "first_at", "last_at", "n")]
        self.open = handle.getMapState("open", T.StructType([T.StructField("ends", T.LongType())]), T.StructType(fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # parts of one period from several tasks are merged over chunks: the state is asked once for a period, not once for each chunk
        held = None
        for chunk in rows:
            held = chunk if held is None else pd.concat([held, chunk])
            held = held.groupby(["period_start", "period_end"], as_index=False).agg({"first_at": "min", "last_at": "max", "n": "sum"})
            if len(held) >= HELD_ROWS:
                self._add(held)
                held = None
        if held is not None:
            self._add(held)
        yield pd.DataFrame({f.name: pd.Series(dtype="object" if f.name == "search_id" else "int64") for f in _OUT})

    def _add(self, periods: pd.DataFrame) -> None:
        for start, end, first, last, n in periods[["period_start", "period_end", "first_at", "last_at", "n"]].itertuples(index=False, name=None):
            start, end, first, last, n = (*(int(x.value // 1000) for x in (start, end, first, last)), int(n))
            if self.open.containsKey((end,)):
                _, before, latest, seen = self.open.getValue((end,))
                first, last, n = min(first, before), max(last, latest), n + seen
            else:
                self.handle.registerTimer(end // 1000)
            self.open.updateValue((end,), (start, first, last, n))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = (expiredTimerInfo.getExpiryTimeInMs() * 1000,)
        start, first, last, n = self.open.getValue(end)
        self.open.removeKey(end)
        yield pd.DataFrame([(key[0], start, first, last, n)], columns=_OUT.names)

    def close(self) -> None:
        pass


def stream_digests(alerts: DataFrame, delay: str = "1 day", *, at: str = "happened_at") -> DataFrame:
    """search_id, period_start, first_at, last_at and n of each period that is over; ``alerts`` has search_id, frequency and ``at``.

    The session must use the RocksDB state store (``windows.use_rocks``).
    """
    held = _folded(alerts, at).withWatermark("last_at", delay)
    found = held.groupBy("search_id").transformWithStateInPandas(statefulProcessor=Digest(), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
    moment = lambda c: wall_time(F.timestamp_micros(c))
    return found.select("search_id", moment("period_start").cast("date").alias("period_start"), moment("first_at").alias("first_at"), moment("last_at").alias("last_at"), "n")


def run_digests(alerts: DataFrame, base: str, checkpoint: str, delay: str = "1 day", *, at: str = "happened_at") -> None:
    """Digests to ``base``/digests, immediate alerts to ``base``/immediate."""
    immediate = alerts.where((F.col("frequency") == "immediate") & F.col("search_id").isNotNull())
    run_available(immediate, lambda b, n: write_batch(b, f"{base}/immediate", n), f"{checkpoint}/immediate")
    run_available(stream_digests(alerts, delay, at=at), lambda b, n: write_batch(b, f"{base}/digests", n), f"{checkpoint}/digests")
