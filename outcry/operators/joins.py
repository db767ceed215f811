"""Lookups between complaints, patterns, documents and tenants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcry.operators.paging import top_per_group


def salted_join(big: DataFrame, small: DataFrame, key: str, salt: Column, salts: int = 16, how: str = "inner") -> DataFrame:
    """Join where one key of ``big`` may hold a large part of all rows and ``small`` has one row per key.

    Each key is cut into ``salts`` parts; only ``small`` is repeated.
    """
    left = big.withColumn("salt_", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    right = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "salt_"], how).drop("salt_")


def complaint_with_pattern(complaints: DataFrame, patterns: DataFrame, key: str = "cluster_id",
                           pattern_key: str = "pattern_id") -> DataFrame:
    """Each complaint with name and severity of its pattern. The join strategy is left to runtime statistics."""
    p = patterns.select(F.col(pattern_key).alias(key), F.col("name").alias("pattern_name"),
                        F.col("severity_score").alias("pattern_severity"))
    return complaints.join(p, key, "left")


def pattern_top_complaints(patterns: DataFrame, complaints: DataFrame, n: int = 50, key: str = "cluster_id",
                           pattern_key: str = "pattern_id") -> DataFrame:
    """The newest ``n`` complaints of each pattern, patterns without any kept."""
    best = top_per_group(complaints.where(F.col(key).isNotNull()), key,
                         [F.desc("date_added"), F.asc("source_id")], n)
    return patterns.select(F.col(pattern_key).alias(key), "name").join(best, key, "left")


def pattern_complaint_counts(patterns: DataFrame, complaints: DataFrame, key: str = "cluster_id",
                             pattern_key: str = "pattern_id") -> DataFrame:
    """Patterns with their counted complaints in place of the stored count."""
    counts = complaints.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("counted"))
    return (patterns.join(counts, F.col(pattern_key) == F.col("k"), "left")
            .withColumn("complaint_count", F.coalesce("counted", F.lit(0))).drop("k", "counted"))


def document_with_pattern(documents: DataFrame, patterns: DataFrame, pattern_key: str = "pattern_id") -> DataFrame:
    p = patterns.select(pattern_key, F.col("name").alias("pattern_name"), F.col("severity_score").alias("pattern_severity"))
    return documents.join(p, pattern_key)


def org_profile(orgs: DataFrame, users: DataFrame, subscriptions: DataFrame | None = None,
                org: str = "organization_id") -> DataFrame:
    """A row for each user of each organisation, or one without user, with subscription state and user count."""
    counts = users.groupBy(org).agg(F.count("*").alias("user_count"))
    people = users.select(org, "user_id", F.col("created_at").alias("user_since"))
    out = orgs
    if subscriptions is not None:
        out = out.join(subscriptions, org, "left")
    out = out.join(counts, org, "left").withColumn("user_count", F.coalesce("user_count", F.lit(0)))
    spread = people.where(F.col(org).isNotNull())
    known = salted_join(spread, out, org, F.col("user_id"))
    return known.unionByName(out.where(F.col("user_count") == 0), allowMissingColumns=True)


def user_with_org(users: DataFrame, orgs: DataFrame, org: str = "organization_id") -> DataFrame:
    return users.join(orgs, org, "left")


def anti_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet."""
    return rows.join(known.select(key), key, "left_anti")


def semi_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return rows.join(members, key, "left_semi")


def link_to_patterns(complaints: DataFrame, rules: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Fill the cluster of unlinked rows by equality on make, model and component. ``rules`` has one row per triple."""
    target = rules.select("make", "model", "component", F.col(key).alias("linked"))
    return (complaints.join(target, ["make", "model", "component"], "left")
            .withColumn(key, F.coalesce(key, "linked")).drop("linked"))
