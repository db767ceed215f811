"""Table maintenance, plans, cases and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from outcry.functions import codes
from outcry.operators import detect, feeds, maintain, paging, quality
from outcry.plans.registry import query
from outcry.plans.tenants import (DOCUMENTS_SQL, K_SQL, ORGS_SQL, TENANT_PATTERNS_SQL, USERS_SQL, documents, k_value, orgs,
                                  tenant_patterns, users)
from outcry.plans.views import (AS_OF, AS_OF_TREND, COMPLAINTS_SQL, FIT_SQL, PATTERNS_SQL, complaints, patterns, series_sql,
                                table)


@query("assign_clusters", f"""WITH {COMPLAINTS_SQL}, n AS (SELECT source_id, max(model) AS cluster_id FROM complaints WHERE deaths > 0 GROUP BY 1)
SELECT CASE WHEN n.source_id IS NOT NULL THEN n.cluster_id ELSE c.cluster_id END AS cluster_id, count(*) AS complaints
FROM complaints c LEFT JOIN n ON n.source_id = c.source_id GROUP BY 1""")
def assign_clusters(spark, sf):
    c = complaints(spark, sf)
    named = c.where("deaths > 0").groupBy("source_id").agg(F.max("model").alias("cluster_id"))
    return maintain.assign_clusters(c, named).groupBy("cluster_id").agg(F.count("*").alias("complaints"))


@query("refresh_patterns", f"""WITH {PATTERNS_SQL}, {series_sql(84, AS_OF_TREND)}, {FIT_SQL},
s AS (SELECT cluster_id, count(*) FILTER (crash) AS crash_count, count(*) FILTER (fire) AS fire_count,
  CAST(sum(injuries) AS BIGINT) AS injury_count, CAST(sum(deaths) AS BIGINT) AS death_count, count(*) AS c FROM complaints GROUP BY 1)
SELECT pattern_id, name, make, model, year_start, year_end, severity_score, is_active, first_seen, s.c AS complaint_count,
  crash_count, fire_count, injury_count, death_count, round(coalesce(t.trend_score, 0), 6) AS trend_score,
  coalesce(t.direction, 'STABLE') AS trend_direction, TIMESTAMP '{AS_OF}' AS last_updated
FROM patterns JOIN s ON s.cluster_id = pattern_id LEFT JOIN trends t ON t.key = pattern_id""")
def refresh_patterns(spark, sf):
    c, p = complaints(spark, sf), patterns(spark, sf)
    trends = detect.pattern_trends(p.drop("trend_score"), c, AS_OF_TREND)
    return maintain.refresh_patterns(p, c, trends, AS_OF).withColumn("trend_score", F.round("trend_score", 6))


@query("create_pattern", f"""WITH {PATTERNS_SQL}
SELECT pattern_id, name, make, complaint_count, severity_score, is_active, first_seen FROM patterns
UNION ALL SELECT 'new:' || make, 'New ' || make, make, 0, 0.0, TRUE, TIMESTAMP '{AS_OF}' FROM (SELECT DISTINCT make FROM complaints)""")
def create_pattern(spark, sf):
    new = complaints(spark, sf).select("make").distinct().select(
        F.concat(F.lit("new:"), "make").alias("pattern_id"), F.concat(F.lit("New "), "make").alias("name"), "make")
    return maintain.create_pattern(patterns(spark, sf), new, AS_OF).select(
        "pattern_id", "name", "make", "complaint_count", "severity_score", "is_active", "first_seen")


# ---- dimensions ---------------------------------------------------------------------------------------------------


def identity_events(spark, sf):
    kind = F.col("event_type")
    k = F.col("k")
    return table(spark, sf, "events").withColumn("k", k_value()).select(
        F.col("event_id").alias("seq"), "ts",
        codes.first_match([(kind == "signup", F.lit("user.created")), (kind == "click", F.lit("user.updated")),
                           (kind == "error", F.lit("user.deleted")), (kind == "purchase", F.lit("membership.created"))],
                          "session.started").alias("type"),
        "user_id", k.alias("organization_id"),
        F.when(k >= 5, F.concat(F.lit("u"), F.col("event_id").cast("string"), F.lit("@mail.test"))).alias("email"),
        F.when(k < 10, "org:admin").when(k < 20, "org:analyst").otherwise("org:member").alias("role"))


IDENTITY_SQL = f"""idev AS (SELECT event_id AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'user.created' WHEN 'click' THEN 'user.updated' WHEN 'error' THEN 'user.deleted'
       WHEN 'purchase' THEN 'membership.created' ELSE 'session.started' END AS type, user_id, {K_SQL} AS organization_id,
  CASE WHEN {K_SQL} >= 5 THEN 'u' || event_id || '@mail.test' END AS email,
  CASE WHEN {K_SQL} < 10 THEN 'ADMIN' WHEN {K_SQL} < 20 THEN 'ANALYST' ELSE 'VIEWER' END AS role FROM events)"""


@query("upsert_users", f"""WITH {ORGS_SQL}, {USERS_SQL}, {IDENTITY_SQL},
every AS (SELECT -1 AS seq, 'present' AS type, user_id, organization_id, email, role FROM users
  UNION ALL SELECT seq, type, user_id, organization_id, email, role FROM idev
  WHERE type = 'user.deleted' OR (type = 'user.updated' AND email IS NOT NULL)
     OR (type IN ('user.created', 'membership.created') AND email IS NOT NULL AND organization_id IN (SELECT organization_id FROM orgs))),
alive AS (SELECT e.* FROM every e LEFT JOIN (SELECT user_id, max(seq) AS gone FROM every WHERE type = 'user.deleted' GROUP BY 1) g
  ON g.user_id = e.user_id WHERE gone IS NULL OR seq > gone),
born AS (SELECT user_id, min(seq) AS born FROM alive WHERE type IN ('present', 'user.created', 'membership.created') GROUP BY 1),
live AS (SELECT a.*, born FROM alive a JOIN born b ON a.user_id = b.user_id WHERE seq >= born)
SELECT user_id,
  arg_max(organization_id, seq) FILTER (type = 'membership.created' OR seq = born) AS organization_id,
  arg_max(email, seq) FILTER (type IN ('present', 'user.created', 'user.updated') OR seq = born) AS email,
  coalesce(arg_max(role, seq) FILTER (type IN ('membership.created', 'present')), 'VIEWER') AS role FROM live GROUP BY 1""")
def upsert_users(spark, sf):
    return maintain.upsert_users(users(spark, sf), identity_events(spark, sf), orgs(spark, sf))


@query("upsert_orgs", f"""WITH {ORGS_SQL}, ev AS (SELECT event_id AS seq, CASE WHEN event_type = 'signup' THEN 'org.created' ELSE 'org.updated' END AS type,
  {K_SQL} AS organization_id, 'Org ' || event_id AS name FROM events WHERE event_type IN ('signup', 'click') AND {K_SQL} < 60),
every AS (SELECT -1 AS seq, 'present' AS type, organization_id, name, plan FROM orgs UNION ALL SELECT seq, type, organization_id, name, NULL FROM ev),
born AS (SELECT organization_id, min(seq) AS born FROM every WHERE type <> 'org.updated' GROUP BY 1)
SELECT organization_id, arg_max(name, seq) AS name, coalesce(max(plan), 'FREE') AS plan FROM every JOIN born USING (organization_id)
WHERE seq >= born GROUP BY 1""")
def upsert_orgs(spark, sf):
    ev = table(spark, sf, "events").withColumn("organization_id", k_value()).where(
        F.col("event_type").isin("signup", "click") & (F.col("organization_id") < 60)).select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "org.created").otherwise("org.updated").alias("type"),
        "organization_id", F.concat(F.lit("Org "), F.col("event_id").cast("string")).alias("name"))
    return maintain.upsert_orgs(orgs(spark, sf), ev)


def billing_events(spark, sf):
    return billing_columns(table(spark, sf, "events"))


def billing_columns(events):
    kind, k = F.col("event_type"), F.col("k")
    return events.withColumn("k", k_value()).select(
        F.col("event_id").alias("seq"), "ts",
        codes.first_match([(kind == "signup", F.lit(maintain.CHECKOUT)), (kind == "purchase", F.lit(maintain.CHANGED)),
                           (kind == "click", F.lit(maintain.ENDED)), (kind == "error", F.lit(maintain.FAILED))],
                          "invoice.paid").alias("type"),
        F.col("user_id").alias("customer"), F.when(k > 3, F.concat(F.lit("org"), F.col("user_id").cast("string"))).alias("organization_id"),
        F.when(k > 8, "subscription").otherwise("payment").alias("mode"),
        F.concat(F.lit("sub"), F.col("event_id").cast("string")).alias("subscription"),
        F.when(k < 25, "price_basic_monthly").when(k < 50, "price_pro_monthly").when(k < 75, "price_enterprise_yearly").alias("price"),
        F.when(k < 40, "active").when(k < 60, "past_due").when(k < 80, "paused").when(k < 95, "canceled").alias("status"),
        F.when(k > 20, F.col("event_id") * 100).alias("period_start"), F.when(k > 30, F.col("event_id") * 100 + 50).alias("period_end"),
        F.when(k > 10, (k / 12).cast("int")).alias("attempts"), F.when(k < 55, F.col("event_id")).alias("next_attempt"))


BILLING_SQL = f"""bill AS (SELECT event_id AS seq, ts, event_type AS t, user_id AS customer, k,
  CASE WHEN k > 3 THEN 'org' || user_id END AS organization_id, 'sub' || event_id AS subscription,
  CASE WHEN k < 25 THEN 'price_basic_monthly' WHEN k < 50 THEN 'price_pro_monthly' WHEN k < 75 THEN 'price_enterprise_yearly' END AS price,
  CASE WHEN k < 25 THEN 'BASIC' WHEN k < 50 THEN 'PRO' WHEN k < 75 THEN 'ENTERPRISE' END AS price_plan,
  CASE WHEN k < 40 THEN 'ACTIVE' WHEN k < 60 THEN 'PAST_DUE' WHEN k < 80 THEN 'INACTIVE' WHEN k < 95 THEN 'CANCELED' END AS status,
  CASE WHEN k > 20 THEN event_id * 100 END AS period_start, CASE WHEN k > 30 THEN event_id * 100 + 50 END AS period_end,
  CASE WHEN k > 10 THEN k // 12 END AS attempts, CASE WHEN k < 55 THEN event_id END AS next_attempt
  FROM (SELECT *, {K_SQL} AS k FROM events)),
usable AS (SELECT * FROM bill WHERE (t = 'signup' AND k > 8) OR (t = 'purchase' AND status IS NOT NULL) OR t IN ('click', 'error')),
opened AS (SELECT customer, min(seq) AS opened, arg_min(organization_id, seq) AS org FROM usable WHERE t = 'signup' GROUP BY 1),
live AS (SELECT u.*, org, CASE WHEN t IN ('signup', 'purchase') THEN price END AS p FROM usable u JOIN opened o ON o.customer = u.customer WHERE seq >= opened),
prev AS (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY customer ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM live),
marked AS (SELECT *, CASE WHEN t = 'signup' AND p IS NOT NULL THEN price_plan WHEN t = 'purchase' AND p IS NOT NULL AND p IS DISTINCT FROM before THEN price_plan
  WHEN t = 'click' THEN 'FREE' WHEN t = 'error' AND next_attempt IS NULL AND coalesce(attempts, 0) >= 4 THEN 'FREE' END AS plan,
  CASE t WHEN 'signup' THEN 'ACTIVE' WHEN 'purchase' THEN status WHEN 'click' THEN 'CANCELED' ELSE 'PAST_DUE' END AS st FROM prev),
subscriptions AS (SELECT customer, min(org) AS organization_id, arg_max(st, seq) AS status, arg_max(p, seq) FILTER (p IS NOT NULL) AS price,
  coalesce(arg_max(plan, seq) FILTER (plan IS NOT NULL), 'FREE') AS plan,
  nullif(arg_max(CASE WHEN t = 'signup' THEN subscription ELSE '' END, seq) FILTER (t IN ('signup', 'click')), '') AS subscription,
  arg_max(period_start, seq) FILTER (t = 'purchase' AND period_start IS NOT NULL) AS period_start,
  arg_max(period_end, seq) FILTER (t = 'purchase' AND period_end IS NOT NULL) AS period_end, max(seq) AS last_seq FROM marked GROUP BY 1)"""


@query("subscription_state", f"WITH {BILLING_SQL} SELECT * FROM subscriptions")
def subscription_state(spark, sf):
    return maintain.subscription_state(billing_events(spark, sf))


# ---- removal ------------------------------------------------------------------------------------------------------


@query("deactivate", f"""WITH {PATTERNS_SQL} SELECT pattern_id, is_active AND model <> 'PROMO' AS is_active FROM patterns""")
def deactivate(spark, sf):
    p = patterns(spark, sf)
    return maintain.deactivate(p, p.where("model = 'PROMO'")).select("pattern_id", "is_active")


REQUESTS_SQL = "requests AS (SELECT document_id, CAST(CASE WHEN document_id > 5000 THEN organization_id ELSE 3 END AS INT) AS asker FROM documents_made WHERE created_at < TIMESTAMP '1997-01-01')"


def delete_requests(spark, sf):
    old = documents(spark, sf).where(F.col("created_at") < F.expr("timestamp_ntz'1997-01-01'"))
    return old.select("document_id", F.when(F.col("document_id") > 5000, F.col("organization_id")).otherwise(3).alias("organization_id"))


@query("delete_document", f"""WITH {DOCUMENTS_SQL}, {REQUESTS_SQL} SELECT d.* FROM documents_made d WHERE NOT EXISTS
(SELECT 1 FROM requests r WHERE r.document_id = d.document_id AND r.asker = d.organization_id AND d.status <> 'FINALIZED')""")
def delete_document(spark, sf):
    return maintain.delete_document(documents(spark, sf), delete_requests(spark, sf))[0]


@query("delete_document_refused", f"""WITH {DOCUMENTS_SQL}, {REQUESTS_SQL} SELECT r.document_id, r.asker,
CASE WHEN d.organization_id <> r.asker THEN 'Document not found' ELSE 'Cannot delete finalized document' END AS reason
FROM requests r JOIN documents_made d ON d.document_id = r.document_id WHERE d.organization_id <> r.asker OR d.status = 'FINALIZED'""")
def delete_document_refused(spark, sf):
    return maintain.delete_document(documents(spark, sf), delete_requests(spark, sf))[1]


@query("cascade_delete", f"""WITH {COMPLAINTS_SQL}, {ORGS_SQL}, {USERS_SQL}, {TENANT_PATTERNS_SQL}, {DOCUMENTS_SQL},
gone AS (SELECT organization_id FROM orgs WHERE plan = 'FREE')
SELECT 'users' AS kind, organization_id, count(*) AS rows FROM users WHERE organization_id NOT IN (SELECT * FROM gone) GROUP BY 2
UNION ALL SELECT 'patterns', organization_id, count(*) FROM tenant_patterns WHERE organization_id NOT IN (SELECT * FROM gone) GROUP BY 2
UNION ALL SELECT 'documents', organization_id, count(*) FROM documents_made WHERE organization_id NOT IN (SELECT * FROM gone) GROUP BY 2""")
def cascade_delete(spark, sf):
    left = maintain.cascade_delete({"users": users(spark, sf), "patterns": tenant_patterns(spark, sf), "documents": documents(spark, sf)},
                                   orgs(spark, sf).where("plan = 'FREE'"))
    out = None
    for kind, df in left.items():
        part = df.groupBy("organization_id").agg(F.count("*").alias("rows")).select(F.lit(kind).alias("kind"), "organization_id", "rows")
        out = part if out is None else out.unionByName(part)
    return out


HOLDS_SQL = """holds AS (
  SELECT c_nationkey AS org, CASE WHEN c_acctbal > 9000 THEN 'RELEASED' ELSE 'ACTIVE' END AS status, CAST(NULL AS BIGINT) AS rid, c_custkey AS cust
  FROM customer WHERE c_acctbal > 8000
  UNION ALL SELECT c_nationkey, 'ACTIVE', o_orderkey, NULL FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 400000
  UNION ALL SELECT n_nationkey, 'ACTIVE', NULL, NULL FROM nation WHERE n_regionkey = 2)"""


def holds(spark, sf):
    c = table(spark, sf, "customer")
    none = F.lit(None).cast("long")
    people = c.where("c_acctbal > 8000").select(
        F.col("c_nationkey").alias("organization_id"), F.when(F.col("c_acctbal") > 9000, "RELEASED").otherwise("ACTIVE").alias("status"),
        none.alias("resource_id"), F.col("c_custkey").alias("custodian_id"))
    single = table(spark, sf, "orders").where("o_totalprice > 400000").join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_nationkey").alias("organization_id"), F.lit("ACTIVE").alias("status"), F.col("o_orderkey").alias("resource_id"),
        none.alias("custodian_id"))
    whole = table(spark, sf, "nation").where("n_regionkey = 2").select(
        F.col("n_nationkey").alias("organization_id"), F.lit("ACTIVE").alias("status"), none.alias("resource_id"), none.alias("custodian_id"))
    return people.unionByName(single).unionByName(whole).withColumn("resource_type", F.lit("GENERATED"))


@query("retention_purge", f"""WITH {DOCUMENTS_SQL}, {HOLDS_SQL} SELECT organization_id, status,
CASE WHEN created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1000 DAY THEN 'keep' WHEN EXISTS (SELECT 1 FROM holds h WHERE h.org = d.organization_id AND h.status = 'ACTIVE'
  AND (rid IS NULL OR rid = document_id) AND (cust IS NULL OR cust = created_by)) THEN 'held' ELSE 'purge' END AS fate, count(*) AS documents
FROM documents_made d GROUP BY 1, 2, 3""")
def retention_purge(spark, sf):
    judged = maintain.retention_purge(documents(spark, sf), holds(spark, sf), AS_OF, 1000, resource_type="GENERATED")
    return judged.groupBy("organization_id", "status", "fate").agg(F.count("*").alias("documents"))


# ---- plans and feeds ----------------------------------------------------------------------------------------------

MONTH_AS_OF = "2001-06-28"
LIMITS_SQL = "limits AS (" + " UNION ALL ".join(
    f"SELECT '{p}' AS plan, '{r}' AS resource, {n} AS lim" for p, t in maintain.PLAN_LIMITS.items() for r, n in t.items()) + ")"
USAGE_SQL = f"""{LIMITS_SQL}, cur AS (
  SELECT organization_id, 'users' AS resource, count(*) AS c FROM users GROUP BY 1
  UNION ALL SELECT organization_id, 'patterns', count(*) FROM tenant_patterns GROUP BY 1
  UNION ALL SELECT organization_id, 'complaintsPerMonth', count(*) FROM documents_made
    WHERE created_at >= TIMESTAMP '2001-06-01' AND created_at <= TIMESTAMP '{MONTH_AS_OF}' GROUP BY 1),
usage AS (SELECT o.organization_id, o.plan, l.resource, coalesce(c, 0) AS current, lim AS "limit", lim = -1 OR coalesce(c, 0) < lim AS allowed
  FROM orgs o JOIN limits l USING (plan) LEFT JOIN cur ON cur.organization_id = o.organization_id AND cur.resource = l.resource)"""
TENANTS = f"WITH {COMPLAINTS_SQL}, {ORGS_SQL}, {USERS_SQL}, {TENANT_PATTERNS_SQL}, {DOCUMENTS_SQL}"


def usage(spark, sf):
    return maintain.plan_usage(orgs(spark, sf), users(spark, sf), tenant_patterns(spark, sf), documents(spark, sf), MONTH_AS_OF)


@query("plan_usage", f"{TENANTS}, {USAGE_SQL} SELECT * FROM usage")
def plan_usage(spark, sf):
    return usage(spark, sf)


@query("plan_features", f"""WITH {ORGS_SQL} SELECT organization_id, plan, plan <> 'FREE' AS "semanticSearch", plan IN ('PRO', 'ENTERPRISE') AS "patternAlerts",
plan <> 'FREE' AS "complaintGeneration", plan IN ('PRO', 'ENTERPRISE') AS "apiAccess", plan = 'ENTERPRISE' AS "prioritySupport" FROM orgs""")
def plan_features(spark, sf):
    return maintain.plan_features(orgs(spark, sf))


@query("dashboard_alerts", f"""{TENANTS}, {USAGE_SQL}, used AS (SELECT *, current::DOUBLE / "limit" AS share,
  CASE WHEN current::DOUBLE / "limit" >= 0.9 THEN 'critical' ELSE 'warning' END AS level FROM usage WHERE "limit" > 0 AND current > 0)
SELECT organization_id, 'pattern-limit-' || level AS id, level AS type, CASE level WHEN 'critical' THEN 'Pattern Limit Almost Reached' ELSE 'Pattern Limit Warning' END AS title,
  'You''ve used ' || current || ' of ' || "limit" || ' patterns (' || CAST(floor(share*100 + 0.5) AS BIGINT) || '%)' AS message
FROM used WHERE resource = 'patterns' AND share >= 0.75
UNION ALL SELECT organization_id, 'complaint-limit-' || level, level, CASE level WHEN 'critical' THEN 'Monthly Complaint Limit Almost Reached' ELSE 'Monthly Complaint Limit Warning' END,
  'You''ve generated ' || current || ' of ' || "limit" || ' complaints this month' FROM used WHERE resource = 'complaintsPerMonth' AND share >= 0.75
UNION ALL SELECT organization_id, 'high-severity-patterns', 'warning', 'High-Severity Patterns Trending Up',
  count(*) || ' pattern(s) with severity ≥8 are showing upward trends' FROM tenant_patterns WHERE severity_score >= 8 AND trend_direction = 'INCREASING' GROUP BY 1
UNION ALL SELECT organization_id, 'draft-complaints', 'info', 'Draft Complaints Pending', 'You have ' || count(*) || ' draft complaints awaiting review'
FROM documents_made WHERE status = 'DRAFT' GROUP BY 1 HAVING count(*) > 5""")
def dashboard_alerts(spark, sf):
    alerts = feeds.dashboard_alerts(usage(spark, sf), tenant_patterns(spark, sf), documents(spark, sf))
    return paging.by_priority(alerts, "type", "organization_id", "id")


@query("activity_feed", f"""WITH {COMPLAINTS_SQL}, {TENANT_PATTERNS_SQL}, {DOCUMENTS_SQL}, acts AS (
  SELECT organization_id, 'pattern-' || pattern_id AS id, CASE WHEN created_at = updated_at THEN 'pattern_created' ELSE 'pattern_updated' END AS type,
    CASE WHEN created_at = updated_at THEN 'Pattern Created' ELSE 'Pattern Updated' END AS title, name || ' - ' || make || ' ' || model AS description, updated_at AS happened_at
  FROM tenant_patterns
  UNION ALL SELECT d.organization_id, 'complaint-' || document_id, CASE WHEN status = 'FINALIZED' THEN 'complaint_finalized' ELSE 'complaint_generated' END,
    CASE WHEN status = 'FINALIZED' THEN 'Complaint Finalized' ELSE 'Complaint Generated' END,
    title || CASE WHEN p.name IS NOT NULL THEN ' from ' || p.name ELSE '' END, d.created_at
  FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY created_at DESC, document_id) AS k FROM documents_made) d
  LEFT JOIN tenant_patterns p ON p.pattern_id = d.pattern_id WHERE k <= 20)
SELECT organization_id, id, type, title, description, happened_at, rank_in_group FROM
(SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY happened_at DESC, id) AS rank_in_group FROM acts) WHERE rank_in_group <= 20""")
def activity_feed(spark, sf):
    out = feeds.activity_feed(tenant_patterns(spark, sf), documents(spark, sf))
    return out.withColumn("rank_in_group", F.col("rank_in_group").cast("long"))


# ---- cases --------------------------------------------------------------------------------------------------------


def when_sql(rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in rules) + f" ELSE '{default}' END"


CASE_SQL = f"""WITH {PATTERNS_SQL.replace("make || ' ' || model AS name", "make || ' ' || model || CASE model WHEN 'PROMO' THEN ' Brake fade' WHEN 'ECONOMY' THEN ' engine stall' ELSE '' END AS name")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY source_id, date_added) AS k FROM complaints),
s AS (SELECT cluster_id, string_agg(description, '|' ORDER BY k) AS excerpts FROM ranked WHERE k <= 5 GROUP BY 1),
t AS (SELECT cluster_id, count(*) AS n, count(*) FILTER (crash) AS cr, count(*) FILTER (fire) AS fi, CAST(sum(injuries) AS BIGINT) AS inj,
  CAST(sum(deaths) AS BIGINT) AS de FROM complaints GROUP BY 1)
SELECT pattern_id, 'Class Action Complaint: ' || make || ' ' || model || ' ' || name AS title, make || ' ' || model || ' (' || year_start || '-' || year_end || ')' AS vehicle,
make || ' Motor Corporation' AS defendant, year_start, year_end,
{when_sql([(f"contains(lower(name), '{w}')", w.capitalize() + ' System') for w in codes.COMPONENT_WORDS], codes.DEFAULT_COMPONENT)} AS component,
{when_sql([(f"contains(lower(name), '{w}')", v) for w, v in codes.FAILURE_MODES.items()], codes.DEFAULT_FAILURE_MODE)} AS failure_mode,
{when_sql([(f"severity_score >= {n}", v) for n, v in codes.CONSEQUENCES], codes.DEFAULT_CONSEQUENCE)} AS consequences,
{when_sql([(f"complaint_count * 100 >= {n}", v + codes.CLASS_SIZE_SUFFIX) for n, v in codes.CLASS_SIZES], codes.CLASS_SIZE_DEFAULT + codes.CLASS_SIZE_SUFFIX)} AS class_size,
complaint_count AS total_complaints, CAST(floor(complaint_count * 0.3::DOUBLE) AS BIGINT) AS crash_complaints,
CAST(floor(complaint_count * 0.05::DOUBLE) AS BIGINT) AS fire_complaints, inj AS injury_count, de AS death_count, excerpts AS representative_complaints,
n AS true_total, cr AS true_crashes, fi AS true_fires, inj AS true_injuries, de AS true_deaths
FROM patterns JOIN s ON s.cluster_id = pattern_id JOIN t ON t.cluster_id = pattern_id"""


def facts(spark, sf):
    note = F.when(F.col("model") == "PROMO", " Brake fade").when(F.col("model") == "ECONOMY", " engine stall").otherwise("")
    named = patterns(spark, sf).withColumn("name", F.concat("name", note))
    return maintain.case_facts(named, complaints(spark, sf), 2001)


@query("case_facts", CASE_SQL)
def case_facts(spark, sf):
    return facts(spark, sf).withColumn("representative_complaints", F.concat_ws("|", "representative_complaints"))


@query("severity_band", f"""WITH {PATTERNS_SQL}, x AS (SELECT 10.0::DOUBLE * (severity_score - min(severity_score) OVER ()) / nullif(max(severity_score) OVER () - min(severity_score) OVER (), 0) AS s FROM patterns)
SELECT CASE WHEN s >= 7 THEN 'high' WHEN s >= 4 THEN 'medium' ELSE 'low' END AS band,
CASE WHEN s >= 8 THEN 'critical' WHEN s >= 5 THEN 'high' WHEN s >= 3 THEN 'medium' ELSE 'low' END AS fine, count(*) AS patterns FROM x GROUP BY 1, 2""")
def severity_band(spark, sf):
    from outcry.operators.scoring import severity_score

    scored = severity_score(patterns(spark, sf).drop("complaint_count", "severity_score"), complaints(spark, sf), normalize="0-10")
    return scored.groupBy(codes.severity_band(F.col("score_10")).alias("band"), codes.severity_band_fine(F.col("score_10")).alias("fine")).agg(
        F.count("*").alias("patterns"))


@query("parse_year_range", f"""WITH {PATTERNS_SQL}, x AS (SELECT pattern_id, CASE WHEN model = 'PROMO' THEN '' WHEN model = 'ECONOMY' THEN year_start || '+'
  WHEN model = 'SMALL' THEN year_start || ' – ' || year_end ELSE year_start || '-' || year_end END AS r, year_start, year_end, model FROM patterns)
SELECT pattern_id, r AS text, CASE WHEN model = 'PROMO' THEN 1998 ELSE year_start END AS first_year,
CASE WHEN model = 'PROMO' THEN 2001 WHEN model = 'ECONOMY' THEN year_start ELSE year_end END AS last_year FROM x""")
def parse_year_range(spark, sf):
    model = F.col("model")
    a, b = F.col("year_start"), F.col("year_end")
    text = F.when(model == "PROMO", codes.format_year_range(F.lit(None).cast("int"), F.lit(None).cast("int"))) \
        .when(model == "ECONOMY", codes.format_year_range(a, F.lit(None).cast("int"))) \
        .when(model == "SMALL", F.concat(a.cast("string"), F.lit(" – "), b.cast("string"))).otherwise(codes.format_year_range(a, b))
    first, last = codes.year_range(F.col("text"), 2001)
    return patterns(spark, sf).withColumn("text", text).select("pattern_id", "text", first.alias("first_year"), last.alias("last_year"))


@query("validate_case", f"""SELECT pattern_id, total_complaints >= 0 AND component <> 'Safety System' AND year_start <= 1971 AS is_valid,
concat_ws(';', CASE WHEN component = 'Safety System' THEN 'defectComponent is required' END,
 CASE WHEN year_start > 1971 THEN 'vehicleYearStart must be before or equal to vehicleYearEnd' END) AS errors FROM ({CASE_SQL})""")
def validate_case(spark, sf):
    filled = facts(spark, sf)
    columns = {name: F.lit("[GIVEN LATER]") for name in quality.CASE_REQUIRED}
    columns.update({
        "vehicleMake": F.col("vehicle"), "defectComponent": F.when(F.col("component") == "Safety System", " ").otherwise(F.col("component")),
        "failureMode": F.col("failure_mode"), "consequences": F.col("consequences"), "estimatedClassSize": F.col("class_size"),
        "vehicleYearStart": F.col("year_start"), "vehicleYearEnd": F.lit(1971), "totalComplaints": F.col("total_complaints"),
        "crashComplaints": F.col("crash_complaints"), "fireComplaints": F.col("fire_complaints"), "injuryCount": F.col("injury_count"),
        "deathCount": F.col("death_count"), "causesOfAction": F.array(F.lit("NEGLIGENCE")), "reliefRequested": F.array(F.lit("DAMAGES"))})
    checked = quality.validate_case(filled.select("pattern_id", *[c.alias(n) for n, c in columns.items()]))
    return checked.select("pattern_id", "is_valid", F.concat_ws(";", "errors").alias("errors"))


@query("case_totals", f"SELECT pattern_id, injury_count, death_count, crash_complaints, fire_complaints, true_crashes, true_fires FROM ({CASE_SQL})")
def case_totals(spark, sf):
    return facts(spark, sf).select("pattern_id", "injury_count", "death_count", "crash_complaints", "fire_complaints",
                                   "true_crashes", "true_fires")
