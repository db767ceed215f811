"""Weekly counts that lose no row to the watermark: what comes behind it is set aside and folded back.

Three steps, each restartable, run one after the other by :func:`run_repaired_counts`:

1. The router takes every landed row and sends it to ``ontime`` or, if its week was closed by the watermark when it came, to
   ``late``. The watermark of a batch is the newest date of all batches before it less the delay, as the engine's own is. It is
   kept in ``frontier`` by batch, so a batch that is run again decides as it did before.
2. The watermarked windows count the rows on time. Their watermark never is ahead of the router's, which has seen the same rows
   and more, so they drop nothing; :class:`DropWatch` reports if they ever do.
3. The repair counts the late rows of each router batch by group and week. The counts of a batch lie in a folder of its number,
   so each late row is folded once however often the repair runs.

The series is the last update of each window plus its repairs. Rows without a group or a date belong to no week and are left out.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType, TimestampNTZType

from outcry.functions.fields import ntz
from outcry.operators.series import indexed, week_start
from outcry.streaming.base import file_stream, read_batches, run_available, write_batch
from outcry.streaming.windows import latest_updates, stream_weekly_counts

FRONTIER = StructType([StructField("newest", TimestampNTZType())])


class DropWatch(StreamingQueryListener):
    """Rows dropped behind the watermark by each query that runs while the listener is on."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self._ended = threading.Semaphore(0)

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        lost = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.dropped[str(event.progress.id)] = self.dropped.get(str(event.progress.id), 0) + lost

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended.release()

    def watch(self, spark: SparkSession, run, wait: float = 60.0) -> int:
        """Rows that the query started by ``run()`` drops; events come after the query's end, so that is waited for."""
        before = sum(self.dropped.values())
        spark.streams.addListener(self)
        try:
            run()
            if not self._ended.acquire(timeout=wait):
                raise TimeoutError("the end of the query was not reported")
        finally:
            spark.streams.removeListener(self)
        return sum(self.dropped.values()) - before


def _written(spark: SparkSession, base: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def closed_week(date: str, newest, delay_days: int):
    """Whether the week of a date was closed when ``newest`` was the newest date seen."""
    week_end = F.date_add(week_start(F.col(date)), 7).cast("timestamp_ntz")
    return week_end <= ntz(newest) - F.expr(f"interval {int(delay_days)} days")


def route(stream: DataFrame, delay_days: int, base: str, checkpoint: str, *, key: str = "cluster_id", date: str = "date_added") -> None:
    """Send rows to ``base``/ontime or ``base``/late, by the watermark at the batch they come in."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = read_batches(spark, f"{base}/frontier", FRONTIER, before=number).agg(F.max("newest")).first()[0] if number else None
        rows = batch.where(F.col(key).isNotNull() & F.col(date).isNotNull())
        late = F.lit(False) if newest is None else closed_week(date, newest, delay_days)
        write_batch(rows.where(late), f"{base}/late", number)
        write_batch(rows.agg(F.max(F.col(date).cast("timestamp_ntz")).alias("newest")), f"{base}/frontier", number)
        write_batch(rows.where(~late), f"{base}/ontime", number)

    run_available(stream, handle, checkpoint)


def fold_late(spark: SparkSession, base: str, schema: StructType, *, key: str = "cluster_id", date: str = "date_added") -> list[int]:
    """Count the late rows of the router batches that are not folded yet; their numbers."""
    if not _written(spark, f"{base}/late"):
        return []
    late = read_batches(spark, f"{base}/late", schema)
    counts = StructType([StructField("key", schema[key].dataType), StructField("wk", DateType()), StructField("v", LongType())])
    done = read_batches(spark, f"{base}/repairs", counts).select("batch").distinct() if _written(spark, f"{base}/repairs") else None
    waiting = late.select("batch").distinct()
    if done is not None:
        waiting = waiting.join(done, "batch", "left_anti")
    # one number for each batch since the last repair
    numbers = sorted(r.batch for r in waiting.collect())
    for number in numbers:
        part = late.where(F.col("batch") == number).groupBy(F.col(key).alias("key"), week_start(F.col(date)).alias("wk")).agg(F.count("*").alias("v"))
        write_batch(part, f"{base}/repairs", number)
    return numbers


def repaired_counts(spark: SparkSession, base: str, key_type=StringType()) -> DataFrame:
    """key, wk, v, i, n: the weekly series with the late rows in it."""
    counts = StructType([StructField("key", key_type), StructField("wk", DateType()), StructField("v", LongType())])
    seen = latest_updates(read_batches(spark, f"{base}/counts", counts), ["key", "wk"], ["v"])
    if _written(spark, f"{base}/repairs"):
        seen = seen.unionByName(read_batches(spark, f"{base}/repairs", counts).select("key", "wk", "v"))
    return indexed(seen.groupBy("key", "wk").agg(F.sum("v").alias("v")))


def run_repaired_counts(stream: DataFrame, delay_days: int, base: str, checkpoint: str, *, key: str = "cluster_id", date: str = "date_added", watch: DropWatch | None = None) -> int:
    """Take all that has landed; returns how many rows the windows dropped, which must be none."""
    spark, watch = stream.sparkSession, watch or DropWatch()
    route(stream, delay_days, base, f"{checkpoint}/route", key=key, date=date)
    if not _written(spark, f"{base}/ontime"):
        return 0  # nothing has landed
    ontime = file_stream(spark, f"{base}/ontime", stream.schema, recursiveFileLookup="true")
    windows = stream_weekly_counts(ontime, f"{int(delay_days)} days", key=key, date=date)
    dropped = watch.watch(spark, lambda: run_available(windows, lambda b, n: write_batch(b, f"{base}/counts", n), f"{checkpoint}/count", "update"))
    fold_late(spark, base, stream.schema, key=key, date=date)
    return dropped
