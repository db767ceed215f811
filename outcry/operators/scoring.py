"""Weighted severity scores and ranks of patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outcry.functions.fields import ntz
from outcry.operators.detect import fit_from_sums, trend_direction
from outcry.operators.paging import number_rows
from outcry.operators.series import TREND_WEEKS, week_start
from outcry.operators.stats import outcome_aggregates, pattern_stats

# Fixed values.
DEFAULT_WEIGHTS = {"deaths": 100, "injuries": 20, "crashes": 10, "fires": 15, "complaint_count": 1, "trend_score": 5}


def weighted_score(weights: dict | None = None) -> Column:
    """Sum of the six factors in a fixed order of addition."""
    total = None
    for name, weight in {**DEFAULT_WEIGHTS, **(weights or {})}.items():
        part = F.col(name).cast("double") * F.lit(float(weight))
        total = part if total is None else total + part
    return total


def with_score(metrics: DataFrame, weights: dict | None = None) -> DataFrame:
    """Adds the score and the part of each factor to a frame that carries the six factors."""
    parts = {f"part_{name}": F.col(name).cast("double") * F.lit(float(weight))
             for name, weight in {**DEFAULT_WEIGHTS, **(weights or {})}.items()}
    return metrics.withColumn("score", weighted_score(weights)).withColumns(parts)


def pattern_metrics(complaints: DataFrame, as_of, *, key: str = "cluster_id", date: str = "date_added", days: int = TREND_WEEKS * 7,
                    carry: tuple[str, ...] = (), strict_fit: bool = False) -> DataFrame:
    """Outcome totals and recent trend of every pattern from one scan and one shuffle of the complaints.

    Complaints are summed per pattern and week first. That small table gives the totals over all weeks and, over the
    weeks inside the window, the positions and sums of the trend. ``carry`` names columns that are constant per pattern.
    """
    recent = F.col(date) >= ntz(as_of) - F.expr(f"interval {int(days)} days")
    # Carried columns are grouping keys: a minimum over texts would turn the hash aggregate into a sort.
    rollup = complaints.where(F.col(key).isNotNull()).groupBy(
        F.col(key).alias("key"), *carry, week_start(F.col(date)).alias("wk")).agg(*outcome_aggregates(), F.count_if(recent).alias("v"))
    inside = F.col("v") > 0
    placed = rollup.withColumn("i", F.sum(inside.cast("int")).over(W.partitionBy("key").orderBy("wk")) - 1)
    v, i = F.when(inside, F.col("v").cast("double")), F.when(inside, F.col("i").cast("double"))

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0.0))

    sums = placed.groupBy("key", *carry).agg(
        F.sum("total").alias("complaint_count"), F.sum("crashes").alias("crashes"), F.sum("fires").alias("fires"),
        F.sum("injuries").alias("injuries"), F.sum("deaths").alias("deaths"),
        F.count_if(inside).cast("double").alias("n"), total(i).alias("si"), total(v).alias("sv"), total(i * i).alias("sii"),
        total(v * v).alias("svv"), total(i * v).alias("siv"))
    return trend_direction(fit_from_sums(sums, strict_fit)).withColumnRenamed("key", key)


def severity_score(patterns: DataFrame, complaints: DataFrame, weights: dict | None = None, *,
                   pattern_key: str = "pattern_id", key: str = "cluster_id", normalize: str | None = None) -> DataFrame:
    """Metrics, the part of each factor, and the score of every pattern.

    ``patterns`` carries ``trend_score``. ``normalize='0-10'`` adds ``score_10``, the score between its extremes.
    """
    per_key = pattern_stats(complaints, key).withColumnRenamed("total", "complaint_count")
    counts = ("complaint_count", "crashes", "fires", "injuries", "deaths")
    scored = (
        patterns.join(per_key, F.col(pattern_key) == F.col(key), "left").drop(key)
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
        .withColumn("trend_score", F.coalesce("trend_score", F.lit(0.0)))
        .transform(with_score, weights)
    )
    if normalize == "0-10":
        range_ = scored.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi")).alias("r")).scalar()
        lo, hi = range_["lo"], range_["hi"]
        scored = scored.withColumn("score_10", F.coalesce((F.col("score") - lo) * 10 / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)))
    return scored


def rank_patterns(scored: DataFrame, limit: int = 100, min_score: float = 0.0, pattern_key: str = "pattern_id") -> DataFrame:
    """Active patterns by score. The order runs over the ``limit`` rows that survive the top-k, not over the table."""
    best = (scored.where(F.col("is_active") & (F.col("score") >= min_score))
            .orderBy(F.desc("score"), pattern_key).limit(limit))
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), pattern_key)))


def relative_severity(scored: DataFrame, pattern_key: str = "pattern_id") -> DataFrame:
    """Score, rank and percentile of every active pattern."""
    ranked = number_rows(scored.where("is_active").select(pattern_key, "score"), [("score", "desc"), (pattern_key, "asc")])
    share = (F.col("total") - F.col("row_no") + 1) / F.col("total") * 100
    return ranked.select(pattern_key, "score", F.floor(share + 0.5).cast("long").alias("percentile"),
                         F.col("row_no").alias("rank"), F.col("total").alias("total_patterns"))


def refresh_severity(scored: DataFrame, as_of, pattern_key: str = "pattern_id", pattern_id=None) -> DataFrame:
    """The new version of the severity columns, for one pattern or all."""
    rows = scored if pattern_id is None else scored.where(F.col(pattern_key) == pattern_id)
    return rows.select(pattern_key, F.col("score").alias("severity_score"), "complaint_count",
                       ntz(as_of).alias("last_updated"))
