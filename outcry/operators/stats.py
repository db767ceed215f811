"""Counts and sums. Every report is one pass with conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcry.functions.fields import ntz
from outcry.operators.paging import one_row, order_columns

PERIOD_DAYS = {"7d": 7, "30d": 30, "90d": 90}


def outcome_aggregates() -> list[Column]:
    return [
        F.count("*").alias("total"),
        F.count_if("crash").alias("crashes"),
        F.count_if("fire").alias("fires"),
        F.coalesce(F.sum("injuries"), F.lit(0)).alias("injuries"),
        F.coalesce(F.sum("deaths"), F.lit(0)).alias("deaths"),
    ]


def vehicle_statistics(complaints: DataFrame, make: str, model: str | None = None, year: int | None = None) -> DataFrame:
    cond = F.lower("make") == make.lower()
    if model is not None:
        cond = cond & (F.lower("model") == model.lower())
    if year is not None:
        cond = cond & (F.col("model_year") == year)
    return complaints.where(cond).agg(*outcome_aggregates())


def pattern_stats(complaints: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Outcome totals of all patterns in one pass."""
    return complaints.where(F.col(key).isNotNull()).groupBy(key).agg(*outcome_aggregates())


def cluster_stats(patterns: DataFrame, complaints: DataFrame, pattern_key: str = "pattern_id",
                  key: str = "cluster_id") -> DataFrame:
    """Outcome totals and date range per pattern; zeros and no range for a pattern without complaints."""
    per_key = complaints.groupBy(F.col(key).alias("k")).agg(
        *outcome_aggregates(), F.min("date_added").alias("first_date"), F.max("date_added").alias("last_date"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total", "crashes", "fires", "injuries", "deaths")}
    return (patterns.select(pattern_key).join(per_key, F.col(pattern_key) == F.col("k"), "left").drop("k")
            .withColumns(zero))


def top_makes(complaints: DataFrame, limit: int = 10) -> DataFrame:
    return complaints.groupBy("make").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "make").limit(limit)


def complaints_by_year(complaints: DataFrame, limit: int = 20) -> DataFrame:
    return (complaints.groupBy("model_year").agg(F.count("*").alias("count"))
            .orderBy(F.desc("model_year")).limit(limit))


def sync_stats(complaints: DataFrame) -> DataFrame:
    """Total, last date, largest makes and years in one row."""
    total = complaints.agg(F.count("*").alias("total_complaints"), F.max("date_added").alias("last_sync_date"))

    def packed(df: DataFrame, name: str, *cols: str) -> DataFrame:
        return df.agg(F.concat_ws(",", F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col(cols[1])).alias("o"), F.col(cols[0]).alias("k"),
                                                 F.col("count").alias("c")))),
            lambda s: F.concat_ws(":", s["k"].cast("string"), s["c"].cast("string")))).alias(name))

    return one_row(total, packed(top_makes(complaints), "top_makes", "make", "count"),
                   packed(complaints_by_year(complaints), "by_year", "model_year", "model_year"))


def severity_breakdown(complaints: DataFrame) -> DataFrame:
    return complaints.agg(F.count_if(F.col("deaths") > 0).alias("with_deaths"),
                          F.count_if(F.col("injuries") > 0).alias("with_injuries"),
                          F.count_if("crash").alias("with_crash"), F.count_if("fire").alias("with_fire"))


def dashboard_stats(patterns: DataFrame, complaints: DataFrame, documents: DataFrame, as_of, period: str = "30d",
                    org: str = "organization_id") -> DataFrame:
    """Dashboard figures of every organisation; complaint figures are global and repeat on each row."""
    start = ntz(as_of) - F.expr(f"interval {PERIOD_DAYS.get(period, 30)} days")
    by_org = patterns.groupBy(org).agg(
        F.count("*").alias("total_patterns"),
        F.count_if(F.col("severity_score") >= 7).alias("high_severity_patterns"),
        F.count_if(F.col("trend_direction") == "INCREASING").alias("upward_trend_patterns"),
        F.count_if(F.col("created_at") >= start).alias("recent_patterns"))
    docs = documents.groupBy(org).agg(F.count("*").alias("generated_documents"))
    everywhere = complaints.agg(F.count("*").alias("total_complaints"),
                                F.count_if(F.col("date_added") >= start).alias("complaints_in_period"))
    joined = by_org.join(docs, org, "full").select(
        org, *[F.coalesce(c, F.lit(0)).alias(c) for c in
               ("total_patterns", "high_severity_patterns", "upward_trend_patterns", "recent_patterns",
                "generated_documents")])
    return joined.withColumns({c: everywhere.select(c).scalar() for c in everywhere.columns})


def embedding_coverage(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    have, total = F.count(vec), F.count("*")
    share = F.when(total > 0, F.round(have * 100.0 / F.nullif(total, F.lit(0)), 1)).otherwise(F.lit(0.0))
    return vectors.agg(total.alias("total"), have.alias("with_embedding"), (total - have).alias("without_embedding"),
                       share.cast("double").alias("percent_complete"))


def distinct_makes(complaints: DataFrame) -> DataFrame:
    return complaints.select("make").distinct().orderBy("make")


def models_for_make(complaints: DataFrame, make: str) -> DataFrame:
    return complaints.where(F.lower("make") == make.lower()).select("model").distinct().orderBy("model")


def latest_date(complaints: DataFrame) -> DataFrame:
    return complaints.agg(F.max("date_added").alias("latest_date"))


def count_since(complaints: DataFrame, since) -> DataFrame:
    return complaints.where(F.col("date_added") >= ntz(since)).agg(F.count("*").alias("count"))


def org_counts(orgs: DataFrame, users: DataFrame, patterns: DataFrame, org: str = "organization_id") -> DataFrame:
    """Users and patterns per organisation, zero kept."""
    u = users.groupBy(org).agg(F.count("*").alias("users"))
    p = patterns.groupBy(org).agg(F.count("*").alias("patterns"))
    return orgs.select(org, "plan").join(u, org, "left").join(p, org, "left").select(
        org, "plan", F.coalesce("users", F.lit(0)).alias("users"), F.coalesce("patterns", F.lit(0)).alias("patterns"))


def count_by_plan(orgs: DataFrame) -> DataFrame:
    return orgs.groupBy("plan").agg(F.count("*").alias("organizations"))


def audit_activity(events: DataFrame, grain: str = "day", user: str = "user_id", action: str = "event_type",
                   ts: str = "ts", approximate: bool = False) -> DataFrame:
    """Events and active users per action and day, week or month.

    ``approximate`` counts users with a sketch, for when they are too many to count exactly.
    """
    users = F.approx_count_distinct(user) if approximate else F.count_distinct(user)
    return (events.groupBy(F.date_trunc(grain, F.col(ts)).cast("date").alias("period"), F.col(action).alias("action"))
            .agg(F.count("*").alias("events"), users.alias("active_users")))


def pattern_metrics_ext(complaints: DataFrame, place: str = "model", key: str = "cluster_id") -> DataFrame:
    """Time span and spread over places per pattern."""
    day = F.col("date_added").cast("date")
    return complaints.groupBy(key).agg(
        F.datediff(F.max(day), F.min(day)).cast("long").alias("span_days"), F.count_distinct(place).alias("places"))


def sorted_top(df: DataFrame, sort: list[tuple[str, str]], limit: int) -> DataFrame:
    return df.orderBy(*order_columns(sort)).limit(limit)
