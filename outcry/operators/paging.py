"""Sorting, pages and single-row summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_LIMIT = 100


def one_row(*frames: DataFrame) -> DataFrame:
    """Put single-row frames side by side without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def clamp_page(page: int = 1, limit: int = 20, strict: bool = False) -> tuple[int, int]:
    """A page number from 1 and a limit from 1 to 100; out of range is an error when ``strict``."""
    if strict and (page < 1 or not 1 <= limit <= MAX_LIMIT):
        raise ValueError(f"page must be at least 1 and limit between 1 and {MAX_LIMIT}")
    return max(1, page), min(max(1, limit), MAX_LIMIT)


def order_columns(sort: list[tuple[str, str]]) -> list[Column]:
    return [F.col(name).desc() if way == "desc" else F.col(name).asc() for name, way in sort]


def sort_spec(field: str | None, way: str | None, allowed: list[str], default: tuple[str, str]) -> tuple[str, str]:
    """The asked-for sort when it is allowed, else the default."""
    if field in allowed:
        return field, way if way in ("asc", "desc") else default[1]
    return default


def paginate(df: DataFrame, sort: list[tuple[str, str]], page: int = 1, limit: int = 20,
             strict: bool = False) -> DataFrame:
    """One page in the order of ``sort``, whose last entry must make the order total."""
    page, limit = clamp_page(page, limit, strict)
    return df.orderBy(*order_columns(sort)).offset((page - 1) * limit).limit(limit)


def page_info(df: DataFrame, page: int = 1, limit: int = 20) -> DataFrame:
    page, limit = clamp_page(page, limit)
    total = F.count("*")
    pages = F.ceil(total / limit)
    return df.agg(total.alias("total"), F.lit(page).alias("page"), F.lit(limit).alias("limit"),
                  pages.cast("long").alias("total_pages"), (F.lit(page) < pages).alias("has_more"))


def page_after(df: DataFrame, sort: list[tuple[str, str]], last: dict, limit: int = 20) -> DataFrame:
    """The page after row ``last``: a filter on the sort keys, so deep pages cost as little as the first."""
    conditions, equal = [], F.lit(True)
    for name, way in sort:
        value = F.lit(last[name])
        conditions.append(equal & (F.col(name) < value if way == "desc" else F.col(name) > value))
        equal = equal & (F.col(name) == value)
    return df.where(reduce(lambda a, b: a | b, conditions)).orderBy(*order_columns(sort)).limit(limit)


def top_per_group(df: DataFrame, group: list[str] | str, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group. The rank filter is applied before the shuffle as well, so at most
    ``n`` rows per group and task are moved however large the group is."""
    group = [group] if isinstance(group, str) else group
    ranked = df.withColumn("rank_in_group", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("rank_in_group") <= n)


def number_rows(df: DataFrame, sort: list[tuple[str, str]]) -> DataFrame:
    """Adds ``row_no`` from 1 in the order of ``sort`` and ``total``, without a window over the table.

    Rows are range-partitioned by the whole sort key, so even rows of one value spread out, and sorted where they are.
    The result is written before its partitions are counted, as a repeated range split need not fall alike.
    """
    from outcry.session import cut_lineage

    order = order_columns(sort)
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()))
    part, inside = F.shiftright("at_", 33), F.col("at_").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("part_")).agg(F.count("*").alias("c_"))
    # One row per partition of the sort.
    starts = counts.select("part_", (F.sum("c_").over(W.orderBy("part_")) - F.col("c_")).alias("start_"),
                           F.sum("c_").over(W.partitionBy()).alias("total"))
    return (placed.withColumn("part_", part).join(F.broadcast(starts), "part_")
            .withColumn("row_no", F.col("start_") + inside + 1).drop("part_", "start_", "at_"))


# Order of alert kinds.
PRIORITY = {"critical": 0, "warning": 1, "info": 2}


def by_priority(df: DataFrame, kind: str = "type", *then: str) -> DataFrame:
    rank = F.lit(len(PRIORITY))
    for name, value in PRIORITY.items():
        rank = F.when(F.col(kind) == name, value).otherwise(rank)
    return df.orderBy(rank, *then)
