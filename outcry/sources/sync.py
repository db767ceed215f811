"""Batch ingestion: keep what is known, add what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcry.functions.fields import ntz
from outcry.operators.clean import check_bulk, good, quarantine
from outcry.operators.paging import one_row, top_per_group
from outcry.sources.readers import high_severity_raw


def first_per_key(batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in arrival order; copies are dropped before the shuffle as well."""
    return top_per_group(batch, key, order, 1).drop("rank_in_group")


def insert_new(batch: DataFrame, target: DataFrame, key: str = "source_id", order: list[Column] | None = None) -> DataFrame:
    """The rows of ``batch`` to append to ``target``: first of each key, key not present yet."""
    return first_per_key(batch, key, order or [F.asc("date_added")]).join(target.select(key), key, "left_anti")


def sync_incremental(raw: DataFrame, target: DataFrame, as_of, order: list[Column] | None = None,
                     key: str = "source_id", default_days: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to append, rejected rows, status) of the records after the newest row of ``target``.

    The high-water mark is a scalar of the plan, so it reaches the scan of the feed. Nothing is capped, so a large backlog is taken whole.
    """
    mark = target.agg(F.coalesce(F.max("date_added"), ntz(as_of) - F.expr(f"interval {default_days} days")).alias("mark"))
    fetched = raw.where(F.col("datea") > mark.select(F.date_format("mark", "yyyyMMdd")).scalar())
    checked = check_bulk(fetched)
    new, bad = insert_new(good(checked), target, key, order), quarantine(checked)
    status = one_row(
        mark.select(F.col("mark").alias("last_sync_date")),
        checked.agg(F.count("*").alias("total_complaints"), F.count("error").alias("errors")),
        new.agg(F.count("*").alias("new_complaints")),
    )
    return new, bad, status


def backfill_vehicle(raw: DataFrame, target: DataFrame, make: str, model: str, year_from: int, year_to: int,
                     order: list[Column] | None = None) -> DataFrame:
    """Rows to append for one vehicle and a range of years, read in one scan."""
    rows = good(check_bulk(raw)).where((F.col("make") == make.upper()) & (F.lower("model") == model.lower())
                                       & F.col("model_year").between(year_from, year_to))
    return insert_new(rows, target, order=order)


def sync_high_severity(raw: DataFrame, target: DataFrame, order: list[Column] | None = None,
                       limit: int | None = None) -> DataFrame:
    return insert_new(good(check_bulk(high_severity_raw(raw, limit))), target, order=order)


def seed_upsert(rows: DataFrame, target: DataFrame, key: str = "source_id", order: list[Column] | None = None) -> DataFrame:
    """Target plus the rows it lacks; present rows stay as they are."""
    return target.unionByName(insert_new(rows, target, key, order).select(*target.columns))


def append(rows: DataFrame, path: str, partition: list[str] | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
