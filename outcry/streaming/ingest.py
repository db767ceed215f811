"""Continuous ingestion of the bulk feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outcry.operators.clean import check_bulk, good, quarantine
from outcry.schemas import COMPLAINT, RAW_BULK
from outcry.session import cut_lineage
from outcry.sources.sync import first_per_key, insert_new
from outcry.streaming.base import file_stream, read_batches, run_available, write_batch
from outcry.streaming.known import KnownKeys


def landed_feed(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Raw records with the time their file landed."""
    return file_stream(spark, path, RAW_BULK, fmt, recursiveFileLookup="true").select(
        "*", F.col("_metadata.file_modification_time").alias("landed_at"))


def stream_dedupe(stream: DataFrame, key: str = "cmplid", horizon: str = "30 days") -> DataFrame:
    """First record per key within the horizon, counted in landing time.

    The date inside a record must not be used here: a record of an old date is not late, it has only just landed.
    """
    return stream.withWatermark("landed_at", horizon).dropDuplicatesWithinWatermark([key])


def stream_ingest(spark: SparkSession, source: str, target: str, rejected: str, checkpoint: str, fmt: str = "json",
                  order: list[Column] | None = None, dedupe_horizon: str | None = None) -> None:
    """Take all new files: clean, set bad rows aside, append rows whose key is new.

    The checkpoint knows which files were read, so nothing depends on the newest date seen, and nothing is capped.
    """
    raw = landed_feed(spark, source, fmt)
    if dedupe_horizon:
        raw = stream_dedupe(raw, horizon=dedupe_horizon)

    def handle(batch: DataFrame, number: int) -> None:
        checked = check_bulk(batch)
        write_batch(quarantine(checked), rejected, number)
        new = good(checked)
        if number > 0:
            # Only the key column of earlier batches is read; a batch run again does not see its own rows.
            known = read_batches(batch.sparkSession, target, COMPLAINT, before=number)
            new = insert_new(new, known, order=order)
        else:
            new = insert_new(new, batch.sparkSession.createDataFrame([], COMPLAINT), order=order)
        write_batch(new, target, number)

    run_available(raw, handle, checkpoint)


def stream_ingest_known(spark: SparkSession, source: str, target: str, rejected: str, known: str, checkpoint: str, fmt: str = "json",
                        order: list[Column] | None = None, key: str = "source_id", buckets: int = 64, blocks: int = 16,
                        compact_every: int = 50) -> list[list[int]]:
    """As :func:`stream_ingest`, with the keys of earlier rows in buckets behind Bloom filters below ``known``.

    A batch opens the keys of a bucket only where its filter may hold one of the batch's keys. Returns the buckets that each batch
    opened. Batch n adds version n of the keys; every ``compact_every`` batches the versions are merged before the batch starts.
    ``blocks`` is the least number of blocks of a bucket's filter; a batch or merge of more keys than they hold takes more.
    """
    opened: list[list[int]] = []

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        keys = KnownKeys(session, known, key, COMPLAINT[key].dataType, buckets, blocks)
        if number and number % compact_every == 0 and number - 1 > keys.merged():
            keys.drop_from(number)
            keys.compact(keys.blocks_for(keys.read(number).count()))
            keys.blocks = blocks
        checked = check_bulk(batch)
        write_batch(quarantine(checked), rejected, number)
        first = cut_lineage(first_per_key(good(checked), key, order or [F.asc("date_added")]))
        new, used = keys.unknown(first, number)
        write_batch(new, target, number)
        added = session.read.schema(COMPLAINT).parquet(f"{target}/batch={number}")
        keys.add(added, number, keys.blocks_for(added.count()))
        opened.append(used)

    run_available(landed_feed(spark, source, fmt), handle, checkpoint)
    return opened
