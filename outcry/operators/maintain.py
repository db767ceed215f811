"""New versions of tables instead of updates in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outcry.functions import codes
from outcry.functions.fields import ntz
from outcry.operators.joins import salted_join
from outcry.operators.paging import top_per_group
from outcry.operators.stats import outcome_aggregates, pattern_stats

# ---- fixed values: what a plan allows; -1 is unlimited -------------------------------------------------------------
PLAN_LIMITS = {
    "FREE": {"users": 1, "patterns": 5, "complaintsPerMonth": 0, "searches": 50},
    "BASIC": {"users": 3, "patterns": 25, "complaintsPerMonth": 5, "searches": 500},
    "PRO": {"users": 10, "patterns": 100, "complaintsPerMonth": 25, "searches": 2500},
    "ENTERPRISE": {"users": -1, "patterns": -1, "complaintsPerMonth": -1, "searches": -1},
}
PLAN_FEATURES = {
    "FREE": [],
    "BASIC": ["semanticSearch", "complaintGeneration"],
    "PRO": ["semanticSearch", "patternAlerts", "complaintGeneration", "apiAccess"],
    "ENTERPRISE": ["semanticSearch", "patternAlerts", "complaintGeneration", "apiAccess", "prioritySupport"],
}
PATTERN_DEFAULTS = {"complaint_count": 0, "severity_score": 0.0, "trend_score": 0.0, "trend_direction": "STABLE",
                    "is_active": True}
FINAL_ATTEMPTS = 4
# -------------------------------------------------------------------------------------------------------------------


def assign_clusters(complaints: DataFrame, assignment: DataFrame, id_col: str = "source_id", key: str = "cluster_id") -> DataFrame:
    """Rows named in ``assignment`` (one row per id) get its cluster, others keep theirs."""
    new = assignment.select(id_col, F.col(key).alias("new_"), F.lit(True).alias("named_"))
    return (complaints.join(new, id_col, "left")
            .withColumn(key, F.when(F.col("named_"), F.col("new_")).otherwise(F.col(key))).drop("new_", "named_"))


def refresh_patterns(patterns: DataFrame, complaints: DataFrame, trends: DataFrame, as_of, key: str = "cluster_id",
                     pattern_key: str = "pattern_id") -> DataFrame:
    """The next version of the pattern table: counts, trend and time of change."""
    stats = pattern_stats(complaints, key).withColumnRenamed(key, pattern_key)
    t = trends.select(pattern_key, F.col("direction").alias("new_direction"), F.col("trend_score").alias("new_trend"))
    kept = patterns.drop("complaint_count", "crash_count", "fire_count", "injury_count", "death_count", "trend_score",
                         "trend_direction", "last_updated")
    return (
        kept.join(stats, pattern_key, "left").join(t, pattern_key, "left")
        .select(*kept.columns, *[F.coalesce(F.col(a), F.lit(0)).alias(b) for a, b in (
            ("total", "complaint_count"), ("crashes", "crash_count"), ("fires", "fire_count"), ("injuries", "injury_count"),
            ("deaths", "death_count"))],
            F.coalesce("new_trend", F.lit(0.0)).alias("trend_score"),
            F.coalesce("new_direction", F.lit("STABLE")).alias("trend_direction"), ntz(as_of).alias("last_updated"))
    )


def write_version(df: DataFrame, base: str, version: str) -> str:
    """Write a whole version beside the old ones; readers move on when the new folder is complete."""
    path = f"{base}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def create_pattern(patterns: DataFrame, new: DataFrame, as_of) -> DataFrame:
    """Append patterns; missing columns get their defaults."""
    filled = new
    for name, value in PATTERN_DEFAULTS.items():
        filled = filled.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in new.columns else F.lit(value))
    for name in ("first_seen", "last_updated"):
        if name not in new.columns:
            filled = filled.withColumn(name, ntz(as_of))
    filled = filled.select(*[F.col(f.name).cast(f.dataType) if f.name in filled.columns
                             else F.lit(None).cast(f.dataType).alias(f.name) for f in patterns.schema.fields])
    return patterns.unionByName(filled)


# ---- dimensions from events ---------------------------------------------------------------------------------------

CREATED, UPDATED, DELETED, MEMBER = "user.created", "user.updated", "user.deleted", "membership.created"


def upsert_users(users: DataFrame, events: DataFrame, orgs: DataFrame) -> DataFrame:
    """User table after a batch of identity events ``(seq, type, user_id, organization_id, email, role)``.

    A user appears with a creation or a membership in a known organisation, and not without an email. Later creations
    and updates change the email, memberships change organisation and role, a deletion removes the user until the next
    creation. Only the newest facts per user are kept in the shuffle; the step back to the events is salted, as one
    user may have sent most of them.
    """
    known = orgs.select("organization_id").distinct()
    valid = events.where(
        (F.col("type") == DELETED)
        | (F.col("email").isNotNull() & F.col("type").isin(CREATED, UPDATED, MEMBER)))
    needs_org = valid.where(F.col("type").isin(CREATED, MEMBER)).join(known, "organization_id", "left_semi")
    usable = valid.where(F.col("type").isin(UPDATED, DELETED)).unionByName(needs_org).select(
        "seq", "type", "user_id", "organization_id", "email", codes.map_role(F.col("role")).alias("role"))
    base = users.select(F.lit(-1).cast(events.schema["seq"].dataType).alias("seq"), F.lit("present").alias("type"), "user_id",
                        "organization_id", "email", "role")
    everything = base.unionByName(usable)
    gone = everything.groupBy("user_id").agg(F.max(F.when(F.col("type") == DELETED, F.col("seq"))).alias("gone"))
    since = salted_join(everything, gone, "user_id", F.col("seq")).where(
        F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
    seq, creates = F.col("seq"), F.col("type").isin("present", CREATED, MEMBER)
    mails, member = F.col("type").isin("present", CREATED, UPDATED), F.col("type") == MEMBER

    def last(value: str, cond: Column) -> Column:
        return F.max_by(value, F.when(cond, seq))

    def first(value: str, cond: Column) -> Column:
        return F.min_by(value, F.when(cond, seq))

    facts = since.groupBy("user_id").agg(
        F.min(F.when(creates, seq)).alias("born"), F.max(F.when(mails, seq)).alias("mailed"),
        last("email", mails).alias("new_email"), first("email", creates).alias("first_email"),
        last("organization_id", member).alias("member_org"), first("organization_id", creates).alias("first_org"),
        last("role", member).alias("member_role"), F.max(F.when(F.col("type") == "present", F.col("role"))).alias("old_role"))
    return facts.where(F.col("born").isNotNull()).select(
        "user_id", F.coalesce("member_org", "first_org").alias("organization_id"),
        F.when(F.col("mailed") >= F.col("born"), F.col("new_email")).otherwise(F.col("first_email")).alias("email"),
        F.coalesce("member_role", "old_role", F.lit("VIEWER")).alias("role"))


def upsert_orgs(orgs: DataFrame, events: DataFrame) -> DataFrame:
    """Organisation table after ``org.created`` and ``org.updated`` events ``(seq, type, organization_id, name)``."""
    base = orgs.select(F.lit(-1).cast(events.schema["seq"].dataType).alias("seq"), F.lit("present").alias("type"),
                       "organization_id", "name", "plan")
    new = events.where(F.col("type").isin("org.created", "org.updated")).select(
        "seq", "type", "organization_id", "name", F.lit("FREE").alias("plan"))
    facts = base.unionByName(new).groupBy("organization_id").agg(
        F.min(F.when(F.col("type") != "org.updated", F.col("seq"))).alias("born"), F.max("seq").alias("named"),
        F.max_by("name", "seq").alias("new_name"),
        F.min_by("name", F.when(F.col("type") != "org.updated", F.col("seq"))).alias("first_name"),
        F.max(F.when(F.col("type") == "present", F.col("plan"))).alias("old_plan"))
    return facts.where(F.col("born").isNotNull()).select(
        "organization_id", F.when(F.col("named") >= F.col("born"), F.col("new_name")).otherwise(F.col("first_name")).alias("name"),
        F.coalesce("old_plan", F.lit("FREE")).alias("plan"))


# ---- subscriptions ------------------------------------------------------------------------------------------------

CHECKOUT, CHANGED, ENDED, FAILED = ("checkout.session.completed", "customer.subscription.updated",
                                    "customer.subscription.deleted", "invoice.payment_failed")
HELD = "state.held"


STATE_COLUMNS = ["customer", "organization_id", "status", "price", "plan", "subscription", "period_start", "period_end", "last_seq"]


def subscription_state(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """State per customer after all billing events ``(seq, ts, type, customer, organization_id, mode, subscription,
    price, status, period_start, period_end, attempts, next_attempt)``.

    Each field is the last value set for it, so it is a partial aggregate. Only the plan needs the price before an
    event: that is looked up inside one customer's hour, and across hours through one row per hour, so the events of a
    customer never meet in one place.

    ``state`` is the result over earlier events: it counts as one event per customer that sets every field, and events
    up to its ``last_seq`` are taken as seen.
    """
    if state is not None:
        kinds = {f.name: f.dataType for f in events.schema.fields}
        held = state.select(
            F.col("last_seq").alias("seq"), F.lit(None).cast(kinds["ts"]).alias("ts"), F.lit(HELD).alias("type"), "customer",
            "organization_id", F.lit("subscription").alias("mode"), "subscription", "price", "status", "period_start", "period_end",
            F.lit(None).cast(kinds["attempts"]).alias("attempts"), F.lit(None).cast(kinds["next_attempt"]).alias("next_attempt"),
            F.col("plan").alias("held_plan"))
        seen = state.select("customer", F.col("last_seq").alias("seen_"))
        fresh = salted_join(events, seen, "customer", F.col("seq"), how="left").where(
            F.col("seen_").isNull() | (F.col("seq") > F.col("seen_"))).drop("seen_")
        events = fresh.withColumn("held_plan", F.lit(None).cast("string")).unionByName(held)
    else:
        events = events.withColumn("held_plan", F.lit(None).cast("string"))
    usable = events.where(
        F.col("customer").isNotNull()
        & ((F.col("type") == CHECKOUT) & (F.col("mode") == "subscription") & F.col("organization_id").isNotNull()
           & F.col("subscription").isNotNull()
           | (F.col("type") == CHANGED) & F.col("status").isNotNull() | F.col("type").isin(ENDED, FAILED, HELD)))
    opened = usable.where(F.col("type").isin(CHECKOUT, HELD)).groupBy("customer").agg(
        F.min("seq").alias("opened"), F.min_by("organization_id", "seq").alias("org_"))
    live = (salted_join(usable.drop("organization_id"), opened, "customer", F.col("seq"))
            .where(F.col("seq") >= F.col("opened")).withColumn("hour", F.coalesce(F.date_trunc("hour", "ts"), F.expr("timestamp_ntz'0001-01-01'"))))

    priced = F.when(F.col("type").isin(CHECKOUT, CHANGED, HELD), F.col("price"))
    inside = W.partitionBy("customer", "hour").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    per_hour = live.groupBy("customer", "hour").agg(F.max_by(priced, F.when(priced.isNotNull(), F.col("seq"))).alias("closing"))
    over_hours = W.partitionBy("customer").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
    carried = per_hour.select("customer", "hour", F.last("closing", ignorenulls=True).over(over_hours).alias("carried"))
    placed = live.withColumn("earlier", F.last(priced, ignorenulls=True).over(inside)).join(carried, ["customer", "hour"])
    before = F.coalesce("earlier", "carried")

    kind = F.col("type")
    plan = (F.when(kind == HELD, F.col("held_plan"))
            .when((kind == CHECKOUT) & F.col("price").isNotNull(), codes.map_price(F.col("price")))
            .when((kind == CHANGED) & F.col("price").isNotNull() & ~F.col("price").eqNullSafe(before), codes.map_price(F.col("price")))
            .when(kind == ENDED, F.lit("FREE"))
            .when((kind == FAILED) & F.col("next_attempt").isNull() & (F.coalesce("attempts", F.lit(0)) >= FINAL_ATTEMPTS), F.lit("FREE")))
    status = (F.when(kind == CHECKOUT, F.lit("ACTIVE")).when(kind == CHANGED, codes.map_status(F.col("status")))
              .when(kind == ENDED, F.lit("CANCELED")).when(kind == HELD, F.col("status")).otherwise(F.lit("PAST_DUE")))
    linked = F.when(kind.isin(CHECKOUT, HELD), F.col("subscription"))

    def newest(value: Column, where: Column) -> Column:
        return F.max_by(value, F.when(where, F.col("seq")))

    started = F.when(kind.isin(CHANGED, HELD), F.col("period_start"))
    ended = F.when(kind.isin(CHANGED, HELD), F.col("period_end"))
    return placed.withColumn("plan", plan).groupBy("customer").agg(
        F.min("org_").alias("organization_id"),
        F.max_by(status, F.col("seq")).alias("status"),
        newest(priced, priced.isNotNull()).alias("price"),
        F.coalesce(newest(F.col("plan"), F.col("plan").isNotNull()), F.lit("FREE")).alias("plan"),
        newest(linked, kind.isin(CHECKOUT, ENDED, HELD)).alias("subscription"),
        newest(started, started.isNotNull()).alias("period_start"),
        newest(ended, ended.isNotNull()).alias("period_end"),
        F.max("seq").alias("last_seq"))


# ---- removal ------------------------------------------------------------------------------------------------------


def deactivate(patterns: DataFrame, ids: list | DataFrame, pattern_key: str = "pattern_id") -> DataFrame:
    if isinstance(ids, DataFrame):
        off = ids.select(pattern_key).distinct().withColumn("off_", F.lit(True))
        return (patterns.join(off, pattern_key, "left")
                .withColumn("is_active", F.col("is_active") & F.col("off_").isNull()).drop("off_"))
    return patterns.withColumn("is_active", F.col("is_active") & ~F.col(pattern_key).isin(*ids))


def delete_document(documents: DataFrame, requests: DataFrame, key: str = "document_id",
                    org: str = "organization_id") -> tuple[DataFrame, DataFrame]:
    """(documents left, refused requests with the reason). A finalised document and one of another tenant stay."""
    asked = requests.select(key, F.col(org).alias("asker"))
    judged = asked.join(documents.select(key, org, "status"), key, "left").select(
        key, "asker", F.when(F.col("status").isNull() | (F.col(org) != F.col("asker")), "Document not found")
        .when(F.col("status") == "FINALIZED", "Cannot delete finalized document").alias("reason"))
    left = documents.join(judged.where(F.col("reason").isNull()).select(key).distinct(), key, "left_anti")
    return left, judged.where(F.col("reason").isNotNull())


def cascade_delete(dependents: dict[str, DataFrame], gone: DataFrame, key: str = "organization_id") -> dict[str, DataFrame]:
    """Each dependent table without the rows of the deleted organisations."""
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in dependents.items()}


def retention_purge(rows: DataFrame, holds: DataFrame, as_of, days: int, *, resource_type: str, key: str = "document_id",
                    org: str = "organization_id", custodian: str = "created_by", date: str = "created_at") -> DataFrame:
    """Every row with its fate: ``keep`` (young), ``held`` (old but under an active hold) or ``purge``.

    ``holds`` is ``(organization_id, status, resource_type, resource_id, custodian_id)``; an empty id or custodian means
    all. Holds are split by which of the two they name, so that each part is a plain equality join.
    """
    active = holds.where((F.col("status") == "ACTIVE") & (F.col("resource_type") == resource_type))
    out, flags = rows, []
    for by_id in (False, True):
        for by_person in (False, True):
            part = active.where((F.col("resource_id").isNotNull() == F.lit(by_id))
                                & (F.col("custodian_id").isNotNull() == F.lit(by_person)))
            keys, flag = [F.col(org)], f"held_{int(by_id)}{int(by_person)}"
            if by_id:
                keys.append(F.col("resource_id").alias(key))
            if by_person:
                keys.append(F.col("custodian_id").alias(custodian))
            names = [org] + ([key] if by_id else []) + ([custodian] if by_person else [])
            out = out.join(part.select(*keys).distinct().withColumn(flag, F.lit(True)), names, "left")
            flags.append(F.col(flag).isNotNull())
    held = flags[0] | flags[1] | flags[2] | flags[3]
    old = F.col(date) < ntz(as_of) - F.expr(f"interval {days} days")
    return out.withColumn("fate", F.when(~old, "keep").when(held, "held").otherwise("purge")).select(*rows.columns, "fate")


# ---- plans --------------------------------------------------------------------------------------------------------


def limits_table(spark) -> DataFrame:
    rows = [(plan, resource, limit) for plan, table in PLAN_LIMITS.items() for resource, limit in table.items()]
    return spark.createDataFrame(rows, "plan string, resource string, limit int")


def plan_usage(orgs: DataFrame, users: DataFrame, patterns: DataFrame, documents: DataFrame, as_of, *,
               searches: DataFrame | None = None, org: str = "organization_id") -> DataFrame:
    """Use against limit of every organisation and resource; documents count from the start of the month."""
    month = F.date_trunc("month", ntz(as_of))
    parts = [
        users.groupBy(org).agg(F.count("*").alias("current")).withColumn("resource", F.lit("users")),
        patterns.groupBy(org).agg(F.count("*").alias("current")).withColumn("resource", F.lit("patterns")),
        documents.where((F.col("created_at") >= month) & (F.col("created_at") <= ntz(as_of))).groupBy(org)
        .agg(F.count("*").alias("current")).withColumn("resource", F.lit("complaintsPerMonth")),
    ]
    if searches is not None:
        parts.append(searches.groupBy(org).agg(F.count("*").alias("current")).withColumn("resource", F.lit("searches")))
    current = parts[0]
    for part in parts[1:]:
        current = current.unionByName(part)
    # The limits table has one row per plan and resource.
    allowed = (F.col("limit") == -1) | (F.col("current") < F.col("limit"))
    return (orgs.select(org, "plan").join(F.broadcast(limits_table(orgs.sparkSession)), "plan")
            .join(current, [org, "resource"], "left").withColumn("current", F.coalesce("current", F.lit(0)))
            .select(org, "plan", "resource", "current", "limit", allowed.alias("allowed")))


def plan_features(orgs: DataFrame, org: str = "organization_id") -> DataFrame:
    names = PLAN_FEATURES["ENTERPRISE"]
    return orgs.select(org, "plan", *[F.col("plan").isin(*[p for p, fs in PLAN_FEATURES.items() if n in fs]).alias(n) for n in names])


# ---- cases --------------------------------------------------------------------------------------------------------

CRASH_SHARE, FIRE_SHARE = 0.3, 0.05   # fixed values: shares assumed in a case


def case_facts(patterns: DataFrame, complaints: DataFrame, as_of_year: int, *, excerpts: int = 5,
               key: str = "cluster_id", pattern_key: str = "pattern_id", id_col: str = "source_id") -> DataFrame:
    """The facts behind a case document for every pattern at once.

    Injuries and deaths are totals over all complaints, crash and fire counts are assumed shares with the true totals
    beside them; excerpts come from the first complaints by id.
    """
    head = top_per_group(complaints.where(F.col(key).isNotNull()), key, [F.asc(id_col), F.asc("date_added")], excerpts)
    texts = F.when(F.coalesce("description", F.lit("")) != "", F.struct("rank_in_group", "description"))
    sampled = head.groupBy(F.col(key).alias("k")).agg(
        F.transform(F.array_sort(F.collect_list(texts)), lambda x: x["description"]).alias("representative_complaints"))
    true = complaints.groupBy(F.col(key).alias("k")).agg(*outcome_aggregates()).select(
        "k", F.col("total").alias("true_total"), F.col("crashes").alias("true_crashes"), F.col("fires").alias("true_fires"),
        F.col("injuries").alias("true_injuries"), F.col("deaths").alias("true_deaths"))
    named = patterns.withColumn("year_range", codes.format_year_range(F.col("year_start"), F.col("year_end")))
    first, last = codes.year_range(F.col("year_range"), as_of_year)
    count, name = F.col("complaint_count"), F.col("name")
    return (
        named.join(sampled, F.col(pattern_key) == F.col("k"), "left").drop("k")
        .join(true, F.col(pattern_key) == F.col("k"), "left").drop("k")
        .select(
            pattern_key, F.concat(F.lit("Class Action Complaint: "), "make", F.lit(" "), "model", F.lit(" "), "name").alias("title"),
            F.concat("make", F.lit(" "), "model", F.lit(" ("), "year_range", F.lit(")")).alias("vehicle"),
            F.concat("make", F.lit(" Motor Corporation")).alias("defendant"),
            first.alias("year_start"), last.alias("year_end"), codes.component_keyword(name).alias("component"),
            codes.failure_mode(name).alias("failure_mode"), codes.consequence_band(F.col("severity_score")).alias("consequences"),
            codes.class_size_band(count).alias("class_size"), count.alias("total_complaints"),
            F.floor(count * CRASH_SHARE).alias("crash_complaints"), F.floor(count * FIRE_SHARE).alias("fire_complaints"),
            F.coalesce("true_injuries", F.lit(0)).alias("injury_count"), F.coalesce("true_deaths", F.lit(0)).alias("death_count"),
            F.coalesce("representative_complaints", F.array().cast("array<string>")).alias("representative_complaints"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("true_total", "true_crashes", "true_fires", "true_injuries", "true_deaths")],
        )
    )
