"""Exports and their manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outcry.functions.fields import ntz


def export_result(df: DataFrame, path: str, fmt: str = "json", by: str | None = None, **options: str) -> None:
    """Write as JSON, CSV or Parquet, one folder per value of ``by``."""
    writer = df.write.mode("overwrite").options(**options)
    if by:
        writer = writer.partitionBy(by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def export_scope(df: DataFrame, org, since=None, until=None, custodians: list | None = None, *,
                 org_col: str = "organization_id", date: str = "created_at", user: str = "created_by") -> DataFrame:
    """Rows of one tenant in a date range, of named custodians when given."""
    out = df.where(F.col(org_col) == org)
    if since is not None:
        out = out.where(F.col(date) >= ntz(since))
    if until is not None:
        out = out.where(F.col(date) <= ntz(until))
    return out.where(F.col(user).isin(*custodians)) if custodians else out


# A digest tree over the hex prefix of the row digests: a node has at most 16**3 children, whatever the table size.
PREFIXES = [9, 6, 3, 0]


def integrity_digest(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Record count and digest per group, independent of row order and partitioning.

    Equal rows become one leaf with a count, so copies of one row never pile up in a list. Each value goes in with its
    length, a null as a mark of its own, so no two different rows give one text.
    """
    values = [F.col(c).cast("string") for c in columns]
    text = F.concat(*[F.when(v.isNull(), "n").otherwise(F.concat(F.length(v).cast("string"), F.lit(":"), v)) for v in values])
    leaves = (rows.select(*group, F.sha2(text, 256).alias("h")).groupBy(*group, "h").agg(F.count("*").alias("c"))
              .select(*group, "h", F.sha2(F.concat("h", F.lit(":"), F.col("c").cast("string")), 256).alias("d"), "c"))
    nodes = leaves.withColumn("prefix", F.col("h"))
    for length in PREFIXES:
        nodes = (nodes.select(*group, F.substring("prefix", 1, length).alias("prefix"), F.col("prefix").alias("child"), "d", "c")
                 .groupBy(*group, "prefix")
                 .agg(F.array_sort(F.collect_list(F.struct("child", "d"))).alias("kids"), F.sum("c").alias("c"))
                 .select(*group, "prefix", F.sha2(F.concat_ws("", F.transform("kids", lambda k: k["d"])), 256).alias("d"), "c"))
    return nodes.select(*group, F.col("c").alias("records"), F.col("d").alias("digest"))


def export_with_manifest(resources: dict[str, tuple[DataFrame, list[str]]], path: str | None = None,
                         fmt: str = "json") -> DataFrame:
    """Write each resource and return its manifest: records and digest per resource, of an empty one too. ``resources`` maps a name to its
    rows and the columns that enter the digest."""
    manifest = None
    for name, (rows, columns) in resources.items():
        if path:
            export_result(rows, f"{path}/{name}", fmt)
        part = integrity_digest(rows.withColumn("export_name", F.lit(name)), ["export_name"], columns)
        part = part.withColumnRenamed("export_name", "resource")
        manifest = part if manifest is None else manifest.unionByName(part)
    if manifest is None:
        raise ValueError("nothing to export")
    names = manifest.sparkSession.createDataFrame([(name,) for name in resources], "resource string")
    empty = F.sha2(F.lit(""), 256)
    return names.join(manifest, "resource", "left").select(
        "resource", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("digest", empty).alias("digest"))
