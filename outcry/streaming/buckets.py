"""State tables in buckets: a batch reads and writes the buckets of its keys only.

A key belongs to the bucket of its hash. ``data/version=v/bucket=b`` holds the rows of a bucket as version v left them, and
``pointer/version=v`` says for each bucket which version to read. A batch writes new files for the buckets it touches and a new
pointer; what it does not touch stays where it is. A batch that is run again starts from the same version, overwrites its own
files and leaves the same table; a reader of an older version sees that version until :meth:`BucketTable.vacuum` drops it.

A bucket is one file after each batch that touches it, so files do not pile up. The number of buckets is fixed when the table is
made; it bounds what the driver reads of a pointer. Choose it so that a bucket is some 100 MB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from outcry.streaming.base import run_available

POINTER = StructType([StructField("bucket", IntegerType()), StructField("at", IntegerType())])
Fold = Callable[[DataFrame, DataFrame], DataFrame]


class BucketTable:
    """Rows of ``schema`` by ``key``, in ``buckets`` buckets below the folder ``base``."""

    def __init__(self, spark: SparkSession, base: str, key: str, schema: StructType, buckets: int = 64):
        self.spark, self.base, self.key, self.schema, self.buckets = spark, base.rstrip("/"), key, schema, buckets

    def bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(sc._jsc.hadoopConfiguration()), place

    def _there(self, path: str) -> bool:
        fs, place = self._fs(path)
        return fs.exists(place)

    def newest(self) -> int | None:
        """The newest version, or None before the first."""
        if not self._there(f"{self.base}/pointer"):
            return None
        return self.spark.read.schema(StructType([*POINTER.fields, StructField("version", IntegerType())])).parquet(f"{self.base}/pointer").agg(F.max("version")).first()[0]

    def pointers(self, version: int) -> dict[int, int]:
        """For each bucket with rows the version that wrote it."""
        path = f"{self.base}/pointer/version={version}"
        # one row a bucket
        return {r.bucket: r.at for r in self.spark.read.schema(POINTER).parquet(path).collect() if r.bucket is not None}

    def read(self, version: int, only: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets, as a version left it."""
        at = self.pointers(version)
        paths = [f"{self.base}/data/version={v}/bucket={b}" for b, v in sorted(at.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def create(self, rows: DataFrame | None = None) -> None:
        """Version 0, from ``rows`` or empty, unless the table is there."""
        if self.newest() is None:
            rows = self.spark.createDataFrame([], self.schema) if rows is None else rows
            self._write(0, rows, {}, list(range(self.buckets)))

    def _write(self, version: int, rows: DataFrame, before: dict[int, int], touched: list[int]) -> None:
        path = f"{self.base}/data/version={version}"
        tasks = max(1, min(len(touched), self.buckets))
        (rows.select(*self.schema.names).withColumn("bucket", self.bucket()).repartition(tasks, "bucket").sortWithinPartitions("bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(path))
        made = [b for b in touched if self._there(f"{path}/bucket={b}")]
        after = {b: v for b, v in before.items() if b not in touched} | dict.fromkeys(made, version)
        pointer = self.spark.createDataFrame(sorted(after.items()) or [(None, None)], POINTER)
        pointer.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/pointer/version={version}")

    def update(self, version: int, changes: DataFrame, fold: Fold) -> list[int]:
        """Makes ``version`` from the one before it; ``fold(rows of the touched keys, changes)`` gives the new rows of these keys.

        Returns the buckets written. Rows of other keys in the same buckets go on unchanged.
        """
        # as many numbers as buckets at most
        touched = sorted(r.bucket for r in changes.select(self.bucket().alias("bucket")).distinct().collect())
        before = self.pointers(version - 1)
        held, keys = self.read(version - 1, touched), changes.select(self.key).distinct()
        new = fold(held.join(keys, self.key, "left_semi"), changes).select(*self.schema.names)
        kept = held.join(keys, self.key, "left_anti").select(*self.schema.names)
        self._write(version, new.unionByName(kept), before, touched)
        return touched

    def vacuum(self, keep: int = 1) -> list[int]:
        """Drops the files that none of the ``keep`` newest versions reads, and older pointers; the versions whose data went."""
        newest = self.newest()
        if newest is None:
            return []
        kept = range(max(0, newest - keep + 1), newest + 1)
        used = {(v, b) for version in kept for b, v in self.pointers(version).items()}
        gone = []
        for version in range(newest + 1):
            data = f"{self.base}/data/version={version}"
            if version not in kept and self._there(f"{self.base}/pointer/version={version}"):
                self._drop(f"{self.base}/pointer/version={version}")
            if not self._there(data):
                continue
            for b in range(self.buckets):
                if (version, b) not in used and self._there(f"{data}/bucket={b}"):
                    self._drop(f"{data}/bucket={b}")
            if not any(v == version for v, _ in used) and version not in kept:
                self._drop(data)
                gone.append(version)
        return gone

    def _drop(self, path: str) -> None:
        fs, place = self._fs(path)
        fs.delete(place, True)


def run_bucketed(stream: DataFrame, table: BucketTable, fold: Fold, checkpoint: str, seed: DataFrame | None = None) -> None:
    """Keep ``table`` up to date from a stream: batch n makes version n + 1 from version n; ``seed`` is the table before the first."""
    table.create(seed)

    def handle(batch: DataFrame, number: int) -> None:
        BucketTable(batch.sparkSession, table.base, table.key, table.schema, table.buckets).update(number + 1, batch, fold)

    run_available(stream, handle, checkpoint)
