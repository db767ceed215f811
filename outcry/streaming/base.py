"""Running streams and keeping their results exactly once.

Every micro-batch writes a folder named by its number and overwrites it when the batch is run again after a failure, so
a repeated batch leaves the same rows. ``AvailableNow`` takes all that has landed and stops, like a scheduled job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

Handler = Callable[[DataFrame, int], None]


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options: str) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def run_available(stream: DataFrame, handle: Handler, checkpoint: str, mode: str = "append") -> None:
    """Process all landed data through ``handle`` and return."""
    (stream.writeStream.outputMode(mode).foreachBatch(handle).trigger(availableNow=True)
     .option("checkpointLocation", checkpoint).start().awaitTermination())


def write_batch(df: DataFrame, base: str, batch: int, **options: str) -> None:
    df.write.mode("overwrite").options(**options).parquet(f"{base}/batch={batch}")


def read_batches(spark: SparkSession, base: str, schema: StructType | None = None, before: int | None = None) -> DataFrame:
    """All batches written so far (those before a number), with their ``batch``."""
    reader = spark.read if schema is None else spark.read.schema(
        StructType(schema.fields + [StructField("batch", IntegerType())]))
    df = reader.parquet(base)
    return df if before is None else df.where(F.col("batch") < before)


def read_version(spark: SparkSession, base: str, batch: int) -> DataFrame:
    """The table as batch ``batch`` left it."""
    return spark.read.parquet(f"{base}/batch={batch}")
