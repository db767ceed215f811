"""Activity feeds and dashboard alerts of all tenants at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outcry.operators.paging import top_per_group

# Fixed values.
CRITICAL_USE, WARNING_USE = 0.9, 0.75
HIGH_SEVERITY = 8
MANY_DRAFTS = 5


def activity_feed(patterns: DataFrame, documents: DataFrame, limit: int = 20, org: str = "organization_id") -> DataFrame:
    """The newest ``limit`` events per organisation. Each branch is cut to ``limit`` per organisation before the union."""
    p = top_per_group(patterns, org, [F.desc("updated_at"), F.asc("pattern_id")], limit)
    new = F.col("created_at") == F.col("updated_at")
    from_patterns = p.select(
        org, F.concat(F.lit("pattern-"), F.col("pattern_id").cast("string")).alias("id"),
        F.when(new, "pattern_created").otherwise("pattern_updated").alias("type"),
        F.when(new, "Pattern Created").otherwise("Pattern Updated").alias("title"),
        F.concat("name", F.when(F.coalesce("make", F.lit("")) != "", F.concat(F.lit(" - "), "make")).otherwise(""),
                 F.when(F.coalesce("model", F.lit("")) != "", F.concat(F.lit(" "), "model")).otherwise("")).alias("description"),
        F.col("updated_at").alias("happened_at"))
    d = top_per_group(documents, org, [F.desc("created_at"), F.asc("document_id")], limit)
    names = patterns.select("pattern_id", F.col("name").alias("pattern_name"))
    final = F.col("status") == "FINALIZED"
    from_documents = d.join(names, "pattern_id", "left").select(
        org, F.concat(F.lit("complaint-"), F.col("document_id").cast("string")).alias("id"),
        F.when(final, "complaint_finalized").otherwise("complaint_generated").alias("type"),
        F.when(final, "Complaint Finalized").otherwise("Complaint Generated").alias("title"),
        F.concat("title", F.when(F.col("pattern_name").isNotNull(), F.concat(F.lit(" from "), "pattern_name")).otherwise(""))
        .alias("description"),
        F.col("created_at").alias("happened_at"))
    return top_per_group(from_patterns.unionByName(from_documents), org, [F.desc("happened_at"), F.asc("id")], limit)


def dashboard_alerts(usage: DataFrame, patterns: DataFrame, documents: DataFrame, org: str = "organization_id") -> DataFrame:
    """Alerts of every organisation: use of limits, severe rising patterns, drafts left lying."""
    share = F.col("current") / F.col("limit")
    # A limit of 0 or less and a use of 0 raise nothing.
    used = usage.where((F.col("limit") > 0) & (F.col("current") > 0)).withColumn("share", share).where(F.col("share") >= WARNING_USE)
    critical = F.col("share") >= CRITICAL_USE
    level = F.when(critical, "critical").otherwise("warning")
    percent = F.floor(F.col("share") * 100 + 0.5).cast("long").cast("string")
    now, top = F.col("current").cast("string"), F.col("limit").cast("string")
    limits = used.where(F.col("resource").isin("patterns", "complaintsPerMonth")).select(
        org,
        F.concat(F.when(F.col("resource") == "patterns", "pattern-limit-").otherwise("complaint-limit-"), level).alias("id"),
        level.alias("type"),
        F.concat(F.when(F.col("resource") == "patterns", "Pattern Limit ").otherwise("Monthly Complaint Limit "),
                 F.when(critical, "Almost Reached").otherwise("Warning")).alias("title"),
        F.when(F.col("resource") == "patterns",
               F.concat(F.lit("You've used "), now, F.lit(" of "), top, F.lit(" patterns ("), percent, F.lit("%)")))
        .otherwise(F.concat(F.lit("You've generated "), now, F.lit(" of "), top, F.lit(" complaints this month"))).alias("message"))
    rising = patterns.where((F.col("severity_score") >= HIGH_SEVERITY) & (F.col("trend_direction") == "INCREASING")) \
        .groupBy(org).agg(F.count("*").alias("c")).select(
            org, F.lit("high-severity-patterns").alias("id"), F.lit("warning").alias("type"),
            F.lit("High-Severity Patterns Trending Up").alias("title"),
            F.concat(F.col("c").cast("string"), F.lit(" pattern(s) with severity ≥8 are showing upward trends")).alias("message"))
    drafts = documents.where(F.col("status") == "DRAFT").groupBy(org).agg(F.count("*").alias("c")) \
        .where(F.col("c") > MANY_DRAFTS).select(
            org, F.lit("draft-complaints").alias("id"), F.lit("info").alias("type"),
            F.lit("Draft Complaints Pending").alias("title"),
            F.concat(F.lit("You have "), F.col("c").cast("string"), F.lit(" draft complaints awaiting review")).alias("message"))
    return limits.unionByName(rising).unionByName(drafts)
