"""Weekly series per group and their window statistics.

A series is a long frame ``(key, wk, v, i, n)``: one row per group and week with data, ``i`` its 0-based position and
``n`` the length. Windows here see weeks, never complaints, so a group with a third of all complaints costs no more
than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outcry.functions.fields import ntz

TREND_WEEKS = 12
ALERT_DAYS = 90


def week_start(c: Column) -> Column:
    """Sunday of the week."""
    day = c.cast("date")
    return F.date_sub(day, F.dayofweek(day) - 1)


def weekly_counts(complaints: DataFrame, as_of, *, key: str = "cluster_id", date: str = "date_added",
                  days: int = TREND_WEEKS * 7, fill_gaps: bool = False) -> DataFrame:
    """Complaints per group and week over the ``days`` before ``as_of``.

    Weeks without complaints are absent, and positions close up over them, unless ``fill_gaps``.
    """
    since = ntz(as_of) - F.expr(f"interval {int(days)} days")
    counts = (
        complaints.where(F.col(key).isNotNull() & (F.col(date) >= since))
        .groupBy(F.col(key).alias("key"), week_start(F.col(date)).alias("wk"))
        .agg(F.count("*").alias("v"))
    )
    if fill_gaps:
        spans = counts.groupBy("key").agg(F.min("wk").alias("a"), F.max("wk").alias("b"))
        weeks = spans.select("key", F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("wk"))
        counts = weeks.join(counts, ["key", "wk"], "left").select("key", "wk", F.coalesce("v", F.lit(0)).alias("v"))
    return indexed(counts)


def indexed(series: DataFrame) -> DataFrame:
    by_key = W.partitionBy("key")
    return series.select(
        "key", "wk", "v",
        (F.row_number().over(by_key.orderBy("wk")) - 1).alias("i"),
        F.count("*").over(by_key).alias("n"),
    )


def frame(start: int, end: int):
    return W.partitionBy("key").orderBy("i").rowsBetween(start, end)


def window_sums(start: int, end: int) -> tuple[Column, Column, Column]:
    """Count, sum and sum of squares over a row frame; whole numbers in doubles, hence exact."""
    v = F.col("v").cast("double")
    w = frame(start, end)
    return (F.count("v").over(w).cast("double"), F.coalesce(F.sum(v).over(w), F.lit(0.0)),
            F.coalesce(F.sum(v * v).over(w), F.lit(0.0)))


def rolling_stats(series: DataFrame, k: int = 4) -> DataFrame:
    """Trailing mean and population deviation of ``k`` points, null before the first full window."""
    c, s, q = window_sums(-(k - 1), 0)
    full = F.col("i") >= k - 1
    return series.select(
        "*",
        F.when(full, s / c).alias("mean"),
        F.when(full, F.sqrt(F.greatest(c * q - s * s, F.lit(0.0))) / c).alias("std_dev"),
    )


def z_score(value: Column, mean: Column, std_dev: Column) -> Column:
    return F.when(std_dev == 0, F.lit(0.0)).otherwise((value - mean) / F.nullif(std_dev, F.lit(0.0)))


def growth_wow(series: DataFrame) -> DataFrame:
    """Relative change against the row before."""
    prev = F.lag("v").over(W.partitionBy("key").orderBy("wk"))
    return series.select("*", prev.alias("prev_v"),
                         ((F.col("v") - prev).cast("double") / F.nullif(prev, F.lit(0))).alias("growth"))
