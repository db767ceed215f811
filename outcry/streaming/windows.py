"""Windowed counts and alerts over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from outcry.operators import alerts, detect
from outcry.operators.series import indexed, week_start
from outcry.streaming.base import read_batches, run_available, write_batch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_time(c: Column) -> Column:
    """Wall-clock time as the instant it would be in UTC. Watermarks want instants, and week borders must not move with
    the session zone."""
    return F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone())


def wall_time(c: Column) -> Column:
    return F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz")


def stream_weekly_counts(stream: DataFrame, delay: str, *, key: str = "cluster_id", date: str = "date_added") -> DataFrame:
    """Counts per group and Sunday week. Rows older than the watermark are dropped, so history goes through the batch
    job first; :func:`weekly_partials` is the form that drops nothing."""
    week = F.window("event_time", "7 days", "7 days", "3 days")
    counts = (stream.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), event_time(F.col(date)).alias("event_time"))
              .withWatermark("event_time", delay).groupBy(week.alias("w"), "key").agg(F.count("*").alias("v")))
    return counts.select("key", wall_time(F.col("w.start")).cast("date").alias("wk"), "v")


def latest_updates(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The last update of each key over all batches."""
    return df.groupBy(*keys).agg(*[F.max_by(v, "batch").alias(v) for v in values])


def run_weekly_counts(stream: DataFrame, delay: str, base: str, checkpoint: str, **cols: str) -> None:
    run_available(stream_weekly_counts(stream, delay, **cols), lambda b, n: write_batch(b, base, n), checkpoint, "update")


def weekly_partials(stream: DataFrame, base: str, checkpoint: str, *, key: str = "cluster_id", date: str = "date_added",
                    alerts: str | None = None, window: int = 4, threshold: float = 3.0) -> None:
    """Keep one partial count per group, week and batch; their sum is the series, however late a row arrives.

    With ``alerts``, the groups touched by a batch are checked for spikes in their latest week.
    """

    def handle(batch: DataFrame, number: int) -> None:
        part = batch.where(F.col(key).isNotNull()).groupBy(
            F.col(key).alias("key"), week_start(F.col(date)).alias("wk")).agg(F.count("*").alias("v"))
        write_batch(part, base, number)
        if alerts:
            spark = batch.sparkSession
            mine = spark.read.parquet(f"{base}/batch={number}").select("key", "wk").distinct()
            upto = read_batches(spark, base).where(F.col("batch") <= number)
            touched = upto.join(mine.select("key").distinct(), "key", "left_semi")
            spikes = detect.detect_spikes(sum_partials(touched), window, threshold)
            write_batch(spikes.join(mine, ["key", "wk"], "left_semi"), alerts, number)

    run_available(stream, handle, checkpoint)


def sum_partials(partials: DataFrame) -> DataFrame:
    """The weekly series from its partial counts."""
    return indexed(partials.groupBy("key", "wk").agg(F.sum("v").alias("v")))


def late_rows(batch: DataFrame, newest_before, delay_days: int, date: str = "date_added") -> DataFrame:
    """Rows that a watermark of ``delay_days`` behind ``newest_before`` would drop, for the repair job."""
    from outcry.functions.fields import ntz

    week_end = F.date_add(week_start(F.col(date)), 7).cast("timestamp_ntz")
    return batch.where(week_end <= ntz(newest_before) - F.expr(f"interval {delay_days} days"))


def stream_audit_windows(stream: DataFrame, delay: str = "1 hour", *, size: str = "24 hours", slide: str | None = "1 hour",
                         keys: list[str], ts: str = "ts", limit: int | None = None) -> DataFrame:
    """Events per window and key; only windows above ``limit`` when one is given. Without ``slide`` windows do not
    overlap."""
    win = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    timed = stream.select(*keys, event_time(F.col(ts)).alias("event_time"))
    counts = timed.withWatermark("event_time", delay).groupBy(win.alias("w"), *keys).agg(F.count("*").alias("events"))
    out = counts.select(wall_time(F.col("w.start")).alias("window_start"), *keys, "events")
    return out if limit is None else out.where(F.col("events") > limit)


def stream_search_alerts(stream: DataFrame, searches, base: str, checkpoint: str, keep: list[str] | None = None) -> None:
    """Alerts of type "new complaints": the rows of each batch that a saved search matches. ``searches(spark)`` gives the
    searches to use, afresh for each batch."""

    def handle(batch: DataFrame, number: int) -> None:
        # rows with the same searches follow one another: a tenth of their size with zstd
        write_batch(alerts.match_searches(batch, searches(batch.sparkSession), keep), base, number, compression="zstd")

    run_available(stream, handle, checkpoint)


class Crossing(StatefulProcessor):
    """Counts the rows of a key across batches and reports each time the count passes a multiple of the threshold."""

    def __init__(self, key: str, key_type: T.DataType, threshold: int):
        self.key, self.key_type, self.threshold = key, key_type, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.seen.get()[0] if self.seen.exists() else 0
        now = before + sum(int(chunk["n"].sum()) for chunk in rows)
        self.seen.update((now,))
        crossed = now // self.threshold - before // self.threshold
        if crossed > 0:
            yield pd.DataFrame({self.key: [key[0]], "count": [now], "crossed": [int(crossed)]})

    def close(self) -> None:
        pass


def stream_threshold_alerts(stream: DataFrame, key: str, threshold: int) -> DataFrame:
    """An alert whenever the running count of a key passes a multiple of ``threshold``. The session must use the
    RocksDB state store (``use_rocks``)."""
    key_type = stream.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField("count", T.LongType()), T.StructField("crossed", T.LongType())])
    # One number per row is all that reaches Python.
    return stream.select(key, F.lit(1).alias("n")).groupBy(key).transformWithStateInPandas(
        statefulProcessor=Crossing(key, key_type, threshold), outputStructType=schema, outputMode="Update", timeMode="None")


def use_rocks(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
