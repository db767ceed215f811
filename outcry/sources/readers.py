"""Readers of the raw feeds and the feed's own selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcry.functions.fields import positive
from outcry.schemas import RAW_API, RAW_BULK

CORRUPT = "corrupt_record"


def read_bulk_complaints(spark: SparkSession, path: str, fmt: str = "json", *, select: list[str] | None = None,
                         where: Column | str | None = None, order: list[Column] | None = None, limit: int | None = None,
                         offset: int = 0, **options: str) -> DataFrame:
    """Flat records with projection, predicate, sort and page, all declared, so the scan reads only what is asked."""
    df = spark.read.schema(RAW_BULK).format(fmt).options(**options).load(path)
    if where is not None:
        df = df.where(where)
    if order:
        df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*select) if select else df


def read_api_complaints(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested responses to one record per row. Line-delimited files are split between tasks; set ``multi_line`` for
    files that hold one pretty-printed response each."""
    responses = spark.read.schema(RAW_API).option("multiLine", multi_line).json(path)
    return responses.select(F.explode("results").alias("r")).select("r.*")


def read_all_pages(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """All landed page files of a folder in parallel, with the file each record came from."""
    return (spark.read.schema(RAW_BULK).format(fmt).option("recursiveFileLookup", "true").load(path)
            .withColumn("page_file", F.input_file_name()))


def read_flat_file(spark: SparkSession, path: str, sep: str = "\t", header: bool = False) -> DataFrame:
    """Delimited history file; a line that does not fit is kept whole in ``corrupt_record``."""
    schema = T.StructType(RAW_BULK.fields + [T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).csv(path))


def newest(raw: DataFrame, limit: int | None) -> DataFrame:
    out = raw.orderBy(F.desc("datea"), "cmplid")
    return out if limit is None else out.limit(limit)


def complaints_since(raw: DataFrame, day: str, limit: int | None = None) -> DataFrame:
    """Filed after ``day`` (yyyymmdd), newest first."""
    return newest(raw.where(F.col("datea") > day), limit)


def complaints_in_range(raw: DataFrame, first: str, last: str, limit: int | None = None) -> DataFrame:
    return newest(raw.where(F.col("datea").between(first, last)), limit)


def complaints_by_make(raw: DataFrame, make: str, limit: int | None = None) -> DataFrame:
    return newest(raw.where(F.upper("maketxt") == make.upper()), limit)


def complaints_by_component(raw: DataFrame, component: str, limit: int | None = None) -> DataFrame:
    return newest(raw.where(F.upper("compdesc").contains(component.upper())), limit)


def high_severity_raw(raw: DataFrame, limit: int | None = None) -> DataFrame:
    bad = (F.col("crash") == "Y") | (F.col("fire") == "Y") | positive(F.col("injured")) | positive(F.col("deaths"))
    return newest(raw.where(bad), limit)


def count_where(raw: DataFrame, where: Column | str | None = None) -> DataFrame:
    return (raw if where is None else raw.where(where)).agg(F.count("*").alias("count"))


def distinct_makes_raw(raw: DataFrame, limit: int | None = None) -> DataFrame:
    out = raw.select("maketxt").where(F.col("maketxt") != "").distinct().orderBy("maketxt")
    return out if limit is None else out.limit(limit)
