"""Searches, pages, lookups, counts and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from outcry.operators import detect, filters, joins, paging, stats
from outcry.plans.registry import query
from outcry.plans.tenants import (AUDIT_SQL, DOCUMENTS_SQL, ORGS_SQL, TENANT_PATTERNS_SQL, USERS_SQL, audit, documents,
                                  orgs, tenant_patterns, users)
from outcry.plans.views import AS_OF, AS_OF_TREND, COMPLAINTS_SQL, FIT_SQL, PATTERNS_SQL, complaints, patterns, series_sql, table

C = f"WITH {COMPLAINTS_SQL} "
P = f"WITH {PATTERNS_SQL} "
COLS = ", ".join(filters.LIST_COLUMNS)


@query("search_complaints", C + f"""SELECT {COLS} FROM complaints
WHERE lower(make) LIKE '%brand#1%' AND lower(model) LIKE '%eco%' AND model_year >= 1975 AND model_year <= 2010 AND crash
  AND injuries > 0 AND (lower(description) LIKE '%widget%' OR lower(component) LIKE '%widget%')""")
def search_complaints(spark, sf):
    return filters.search_complaints(complaints(spark, sf), make="BRAND#1", model="Eco", year_from=1975, year_to=2010,
                                     has_crash=True, has_injury=True, search="Widget")


@query("filter_complaints", C + f"""SELECT {COLS} FROM complaints
WHERE lower(make) = 'brand#2' AND lower(component) LIKE '%ring%' AND NOT fire AND deaths = 0 AND injuries > 0
  AND date_added >= TIMESTAMP '1997-01-01' AND date_added <= TIMESTAMP '2000-12-31'
  AND lower(description) LIKE '%failed%'""")
def filter_complaints(spark, sf):
    return filters.filter_complaints(complaints(spark, sf), make="BRAND#2", component="RING", fire=False, deaths=False,
                                     injuries=True, since="1997-01-01", until="2000-12-31",
                                     text="FAILED").select(*filters.LIST_COLUMNS)


@query("filter_patterns", P + """SELECT pattern_id, name, severity_score FROM patterns
WHERE lower(model) = 'economy' AND is_active AND severity_score >= 3000 ORDER BY severity_score DESC, pattern_id LIMIT 20""")
def filter_patterns(spark, sf):
    return filters.filter_patterns(patterns(spark, sf), model="Economy", active=True, min_severity=3000,
                                   sort="severity_score", limit=20).select("pattern_id", "name", "severity_score")


SEVERE_ORDER = "deaths DESC, injuries DESC, crash DESC, source_id, date_added, cluster_id"


@query("severe_complaints", C + f"""SELECT {COLS} FROM complaints
WHERE (crash OR fire OR injuries > 0 OR deaths > 0) AND lower(make) = 'brand#3' ORDER BY {SEVERE_ORDER} LIMIT 100""")
def severe_complaints(spark, sf):
    return filters.severe_complaints(complaints(spark, sf), make="brand#3").select(*filters.LIST_COLUMNS)


@query("complaint_detail", P + """SELECT c.source_id, c.make, c.description, p.name AS pattern_name,
p.severity_score AS pattern_severity FROM complaints c LEFT JOIN patterns p ON p.pattern_id = c.cluster_id
WHERE c.source_id = '17-1'""")
def complaint_detail(spark, sf):
    one = complaints(spark, sf).where(F.col("source_id") == "17-1")
    return joins.complaint_with_pattern(one, patterns(spark, sf)).select(
        "source_id", "make", "description", "pattern_name", "pattern_severity")


@query("complaint_with_pattern", P + """SELECT p.name AS pattern_name, c.crash, count(*) AS complaints,
max(p.severity_score) AS pattern_severity FROM complaints c LEFT JOIN patterns p ON p.pattern_id = c.cluster_id GROUP BY 1, 2""")
def complaint_with_pattern(spark, sf):
    return (joins.complaint_with_pattern(complaints(spark, sf), patterns(spark, sf)).groupBy("pattern_name", "crash")
            .agg(F.count("*").alias("complaints"), F.max("pattern_severity").alias("pattern_severity")))


@query("pattern_top_complaints", P + """SELECT name, date_added, source_id, rank_in_group FROM (
  SELECT p.name, c.date_added, c.source_id, row_number() OVER (PARTITION BY c.cluster_id ORDER BY c.date_added DESC,
         c.source_id) AS rank_in_group
  FROM patterns p LEFT JOIN complaints c ON p.pattern_id = c.cluster_id) WHERE rank_in_group <= 50""")
def pattern_top_complaints(spark, sf):
    out = joins.pattern_top_complaints(patterns(spark, sf), complaints(spark, sf))
    return out.select("name", "date_added", "source_id", F.col("rank_in_group").cast("long").alias("rank_in_group"))


@query("pattern_complaint_counts", P + """SELECT pattern_id, coalesce(n, 0) AS complaint_count FROM patterns LEFT JOIN
(SELECT cluster_id, count(*) AS n FROM complaints WHERE fire AND deaths > 0 GROUP BY 1) ON cluster_id = pattern_id""")
def pattern_complaint_counts(spark, sf):
    worst = complaints(spark, sf).where(F.col("fire") & (F.col("deaths") > 0))
    return joins.pattern_complaint_counts(patterns(spark, sf), worst).select("pattern_id", "complaint_count")


@query("anti_known", """SELECT doc_id, source, n_chars FROM documents
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)""")
def anti_known(spark, sf):
    return joins.anti_known(table(spark, sf, "documents").select("doc_id", "source", "n_chars"),
                            table(spark, sf, "labels"), "doc_id")


@query("semi_members", """SELECT doc_id, source, n_chars FROM documents
WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND toxic = 1)""")
def semi_members(spark, sf):
    return joins.semi_members(table(spark, sf, "documents").select("doc_id", "source", "n_chars"),
                              table(spark, sf, "labels").where("toxic = 1"), "doc_id")


@query("link_to_patterns", C + """, rules AS (SELECT make, model, component, min(cluster_id) AS linked FROM complaints
  WHERE deaths > 0 GROUP BY 1, 2, 3)
SELECT coalesce(CASE WHEN deaths > 0 THEN cluster_id END, linked) AS cluster_id, count(*) AS complaints
FROM complaints LEFT JOIN rules USING (make, model, component) GROUP BY 1""")
def link_to_patterns(spark, sf):
    c = complaints(spark, sf)
    rules = c.where("deaths > 0").groupBy("make", "model", "component").agg(F.min("cluster_id").alias("cluster_id"))
    unlinked = c.withColumn("cluster_id", F.when(F.col("deaths") > 0, F.col("cluster_id")))
    return (joins.link_to_patterns(unlinked, rules).groupBy("cluster_id").agg(F.count("*").alias("complaints")))


# ---- pages and sorts ----------------------------------------------------------------------------------------------

@query("paginate", C + f"SELECT {COLS} FROM complaints WHERE deaths > 0 ORDER BY date_added DESC, source_id, make, model, model_year, component "
       "LIMIT 50 OFFSET 100")
def paginate(spark, sf):
    rows = filters.search_complaints(complaints(spark, sf), has_death=True)
    sort = [("date_added", "desc"), ("source_id", "asc"), ("make", "asc"), ("model", "asc"), ("model_year", "asc"),
            ("component", "asc")]
    return paging.paginate(rows, sort, page=3, limit=50)


@query("page_info", C + """SELECT count(*) AS total, 3 AS page, 50 AS "limit", CAST(ceil(count(*)/50.0) AS BIGINT) AS total_pages,
3 < ceil(count(*)/50.0) AS has_more FROM complaints WHERE deaths > 0""")
def page_info(spark, sf):
    return paging.page_info(filters.search_complaints(complaints(spark, sf), has_death=True), page=3, limit=50)


@query("page_after", C + """SELECT source_id, date_added, component FROM complaints WHERE deaths > 0 AND
(date_added < TIMESTAMP '2000-06-01' OR (date_added = TIMESTAMP '2000-06-01' AND source_id > '5'))
ORDER BY date_added DESC, source_id, component LIMIT 50""")
def page_after(spark, sf):
    rows = complaints(spark, sf).where("deaths > 0").select("source_id", "date_added", "component")
    import datetime as dt

    late = paging.page_after(rows.withColumn("date_added", F.col("date_added").cast("date")),
                             [("date_added", "desc"), ("source_id", "asc"), ("component", "asc")],
                             {"date_added": dt.date(2000, 6, 1), "source_id": "5", "component": "~"}, limit=50)
    return late.withColumn("date_added", F.col("date_added").cast("timestamp_ntz"))


@query("sort_by", P + "SELECT pattern_id, complaint_count FROM patterns ORDER BY complaint_count ASC, pattern_id LIMIT 25")
def sort_by(spark, sf):
    chosen = paging.sort_spec("complaint_count", "asc", filters.PATTERN_SORTS, ("severity_score", "desc"))
    return paging.paginate(patterns(spark, sf), [chosen, ("pattern_id", "asc")], limit=25).select(
        "pattern_id", "complaint_count")


@query("top_by_severity", P + "SELECT pattern_id, severity_score FROM patterns WHERE is_active "
       "ORDER BY severity_score DESC, pattern_id LIMIT 10")
def top_by_severity(spark, sf):
    active = patterns(spark, sf).where("is_active")
    return stats.sorted_top(active, [("severity_score", "desc"), ("pattern_id", "asc")], 10).select(
        "pattern_id", "severity_score")


@query("multi_key_sort", C + f"SELECT {COLS} FROM complaints ORDER BY {SEVERE_ORDER} LIMIT 200")
def multi_key_sort(spark, sf):
    sort = [("deaths", "desc"), ("injuries", "desc"), ("crash", "desc"), ("source_id", "asc"), ("date_added", "asc"),
            ("cluster_id", "asc")]
    return stats.sorted_top(complaints(spark, sf), sort, 200).select(*filters.LIST_COLUMNS)


# ---- aggregates ---------------------------------------------------------------------------------------------------

OUTCOMES = ("count(*) AS total, count(*) FILTER (crash) AS crashes, count(*) FILTER (fire) AS fires, "
            "CAST(coalesce(sum(injuries), 0) AS BIGINT) AS injuries, CAST(coalesce(sum(deaths), 0) AS BIGINT) AS deaths")


@query("vehicle_statistics", C + f"SELECT {OUTCOMES} FROM complaints WHERE lower(make) = 'brand#4' AND lower(model) = 'promo' "
       "AND model_year = 1990")
def vehicle_statistics(spark, sf):
    return stats.vehicle_statistics(complaints(spark, sf), "BRAND#4", "Promo", 1990)


@query("pattern_stats", C + f"SELECT cluster_id, {OUTCOMES} FROM complaints GROUP BY cluster_id")
def pattern_stats(spark, sf):
    return stats.pattern_stats(complaints(spark, sf))


@query("cluster_stats", P + f""", s AS (SELECT cluster_id, {OUTCOMES}, min(date_added) AS first_date,
  max(date_added) AS last_date FROM complaints WHERE date_added >= TIMESTAMP '2001-09-01' GROUP BY 1)
SELECT pattern_id, coalesce(total, 0) AS total, coalesce(crashes, 0) AS crashes, coalesce(fires, 0) AS fires,
coalesce(injuries, 0) AS injuries, coalesce(deaths, 0) AS deaths, first_date, last_date
FROM patterns LEFT JOIN s ON cluster_id = pattern_id""")
def cluster_stats(spark, sf):
    recent = filters.filter_complaints(complaints(spark, sf), since="2001-09-01")
    return stats.cluster_stats(patterns(spark, sf), recent)


@query("top_makes", C + "SELECT make, count(*) AS count FROM complaints GROUP BY make ORDER BY count DESC, make LIMIT 10")
def top_makes(spark, sf):
    return stats.top_makes(complaints(spark, sf))


@query("complaints_by_year", C + "SELECT model_year, count(*) AS count FROM complaints GROUP BY 1 ORDER BY 1 DESC LIMIT 20")
def complaints_by_year(spark, sf):
    return stats.complaints_by_year(complaints(spark, sf))


@query("sync_stats", C + """, m AS (SELECT make, count(*) AS c FROM complaints GROUP BY 1 ORDER BY c DESC, make LIMIT 10),
y AS (SELECT model_year, count(*) AS c FROM complaints GROUP BY 1 ORDER BY 1 DESC LIMIT 20)
SELECT count(*) AS total_complaints, max(date_added) AS last_sync_date,
       (SELECT string_agg(make || ':' || c, ',' ORDER BY c DESC, make) FROM m) AS top_makes,
       (SELECT string_agg(model_year || ':' || c, ',' ORDER BY model_year DESC) FROM y) AS by_year FROM complaints""")
def sync_stats(spark, sf):
    return stats.sync_stats(complaints(spark, sf))


@query("severity_breakdown", C + """SELECT count(*) FILTER (deaths > 0) AS with_deaths, count(*) FILTER (injuries > 0) AS with_injuries,
count(*) FILTER (crash) AS with_crash, count(*) FILTER (fire) AS with_fire FROM complaints""")
def severity_breakdown(spark, sf):
    return stats.severity_breakdown(complaints(spark, sf))


@query("distinct_makes", C + "SELECT DISTINCT make FROM complaints")
def distinct_makes(spark, sf):
    return stats.distinct_makes(complaints(spark, sf))


@query("models_for_make", C + "SELECT DISTINCT model FROM complaints WHERE lower(make) = 'brand#7'")
def models_for_make(spark, sf):
    return stats.models_for_make(complaints(spark, sf), "BRAND#7")


@query("latest_date", C + "SELECT max(date_added) AS latest_date FROM complaints")
def latest_date(spark, sf):
    return stats.latest_date(complaints(spark, sf))


@query("count_since", C + "SELECT count(*) AS count FROM complaints WHERE date_added >= TIMESTAMP '2001-01-01'")
def count_since(spark, sf):
    return stats.count_since(complaints(spark, sf), "2001-01-01")


@query("pattern_metrics_ext", C + """SELECT cluster_id, date_diff('day', CAST(min(date_added) AS DATE), CAST(max(date_added) AS DATE)) AS span_days,
count(DISTINCT supplier_id) AS places FROM complaints GROUP BY 1""")
def pattern_metrics_ext(spark, sf):
    return stats.pattern_metrics_ext(complaints(spark, sf), place="supplier_id")


@query("embedding_coverage", """SELECT count(*) AS total, count(embedding) AS with_embedding, count(*) - count(embedding) AS without_embedding,
CAST(round(count(embedding) * 100.0 / count(*), 1) AS DOUBLE) AS percent_complete
FROM documents LEFT JOIN embeddings ON vec_id = doc_id""")
def embedding_coverage(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return stats.embedding_coverage(docs.join(vectors, "doc_id", "left"))


# ---- tenants ------------------------------------------------------------------------------------------------------


@query("dashboard_stats", f"""WITH {COMPLAINTS_SQL}, {ORGS_SQL}, {TENANT_PATTERNS_SQL}, {DOCUMENTS_SQL},
p AS (SELECT organization_id, count(*) AS total_patterns, count(*) FILTER (severity_score >= 7) AS high_severity_patterns,
             count(*) FILTER (trend_direction = 'INCREASING') AS upward_trend_patterns,
             count(*) FILTER (created_at >= TIMESTAMP '2001-11-05' - INTERVAL 90 DAY) AS recent_patterns
      FROM tenant_patterns GROUP BY 1),
d AS (SELECT organization_id, count(*) AS generated_documents FROM documents_made GROUP BY 1)
SELECT organization_id, coalesce(total_patterns, 0) AS total_patterns, coalesce(high_severity_patterns, 0) AS high_severity_patterns,
       coalesce(upward_trend_patterns, 0) AS upward_trend_patterns, coalesce(recent_patterns, 0) AS recent_patterns,
       coalesce(generated_documents, 0) AS generated_documents,
       (SELECT count(*) FROM complaints) AS total_complaints,
       (SELECT count(*) FROM complaints WHERE date_added >= TIMESTAMP '2001-11-05' - INTERVAL 90 DAY) AS complaints_in_period
FROM p FULL JOIN d USING (organization_id)""")
def dashboard_stats(spark, sf):
    return stats.dashboard_stats(tenant_patterns(spark, sf), complaints(spark, sf), documents(spark, sf), AS_OF, "90d")


@query("org_counts", f"""WITH {COMPLAINTS_SQL}, {ORGS_SQL}, {TENANT_PATTERNS_SQL}, {USERS_SQL}
SELECT organization_id, plan, (SELECT count(*) FROM users u WHERE u.organization_id = o.organization_id) AS users,
       (SELECT count(*) FROM tenant_patterns t WHERE t.organization_id = o.organization_id) AS patterns FROM orgs o""")
def org_counts(spark, sf):
    return stats.org_counts(orgs(spark, sf), users(spark, sf), tenant_patterns(spark, sf))


@query("count_by_plan", f"WITH {ORGS_SQL} SELECT plan, count(*) AS organizations FROM orgs GROUP BY 1")
def count_by_plan(spark, sf):
    return stats.count_by_plan(orgs(spark, sf))


@query("org_profile", f"""WITH {ORGS_SQL}, {USERS_SQL},
n AS (SELECT organization_id, count(*) AS n FROM users GROUP BY 1)
SELECT o.organization_id, o.name, o.plan, coalesce(n, 0) AS user_count, u.user_id, u.created_at AS user_since
FROM orgs o LEFT JOIN n USING (organization_id) LEFT JOIN users u ON u.organization_id = o.organization_id""")
def org_profile(spark, sf):
    out = joins.org_profile(orgs(spark, sf), users(spark, sf))
    return out.select("organization_id", "name", "plan", "user_count", "user_id", "user_since")


@query("user_with_org", f"""WITH {ORGS_SQL}, {USERS_SQL} SELECT user_id, u.organization_id, role, name, plan
FROM users u LEFT JOIN orgs o ON o.organization_id = u.organization_id""")
def user_with_org(spark, sf):
    return joins.user_with_org(users(spark, sf), orgs(spark, sf)).select("user_id", "organization_id", "role", "name", "plan")


@query("document_with_pattern", f"""WITH {COMPLAINTS_SQL}, {TENANT_PATTERNS_SQL}, {DOCUMENTS_SQL}
SELECT document_id, title, status, name AS pattern_name, severity_score AS pattern_severity
FROM documents_made d JOIN tenant_patterns p ON p.pattern_id = d.pattern_id""")
def document_with_pattern(spark, sf):
    return joins.document_with_pattern(documents(spark, sf), tenant_patterns(spark, sf)).select(
        "document_id", "title", "status", "pattern_name", "pattern_severity")


@query("list_documents", f"""WITH {COMPLAINTS_SQL}, {TENANT_PATTERNS_SQL}, {DOCUMENTS_SQL}
SELECT document_id, title, status, d.created_at, name AS pattern_name FROM documents_made d
LEFT JOIN tenant_patterns p ON p.pattern_id = d.pattern_id
WHERE d.organization_id = 3 AND status = 'FINALIZED' ORDER BY d.created_at DESC, document_id LIMIT 20 OFFSET 20""")
def list_documents(spark, sf):
    mine = filters.tenant_scope(documents(spark, sf), 3).where("status = 'FINALIZED'")
    page = paging.paginate(mine, [("created_at", "desc"), ("document_id", "asc")], page=2, limit=20)
    names = tenant_patterns(spark, sf).select("pattern_id", F.col("name").alias("pattern_name"))
    return page.join(names, "pattern_id", "left").select("document_id", "title", "status", "created_at", "pattern_name")


@query("tenant_scope", f"""WITH {COMPLAINTS_SQL}, {TENANT_PATTERNS_SQL}
SELECT pattern_id, organization_id, name FROM tenant_patterns WHERE organization_id = 5
UNION ALL SELECT DISTINCT make, CAST(NULL AS INT), make FROM complaints""")
def tenant_scope(spark, sf):
    own = tenant_patterns(spark, sf).select("pattern_id", "organization_id", "name")
    shared = complaints(spark, sf).select("make").distinct().select(
        F.col("make").alias("pattern_id"), F.lit(None).cast("int").alias("organization_id"), F.col("make").alias("name"))
    return filters.tenant_scope(own.unionByName(shared), 5, include_global=True)


@query("search_patterns", f"""WITH {COMPLAINTS_SQL}, {TENANT_PATTERNS_SQL}
SELECT pattern_id, name, severity_score FROM tenant_patterns
WHERE (organization_id = 7 OR NOT EXISTS (SELECT 1 FROM tenant_patterns WHERE organization_id = 7)) AND severity_score >= 500
AND (lower(name) LIKE '%brand#1%' OR lower(make) LIKE '%brand#1%' OR lower(model) LIKE '%brand#1%')""")
def search_patterns(spark, sf):
    everything = tenant_patterns(spark, sf)
    return filters.search_patterns(filters.tenant_scope(everything, 7), 500, "Brand#1", defaults=everything).select(
        "pattern_id", "name", "severity_score")


@query("search_patterns_fallback", f"""WITH {COMPLAINTS_SQL}, {TENANT_PATTERNS_SQL}
SELECT pattern_id, name, severity_score FROM tenant_patterns WHERE severity_score >= 500
AND (lower(name) LIKE '%brand#1%' OR lower(make) LIKE '%brand#1%' OR lower(model) LIKE '%brand#1%')""")
def search_patterns_fallback(spark, sf):
    everything = tenant_patterns(spark, sf)
    return filters.search_patterns(filters.tenant_scope(everything, -1), 500, "Brand#1", defaults=everything).select(
        "pattern_id", "name", "severity_score")


# ---- audit --------------------------------------------------------------------------------------------------------


@query("filter_audit", f"""WITH {AUDIT_SQL} SELECT id, user_id, action, resource, created_at FROM audit
WHERE organization_id = 4 AND action = 'READ' AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-25'
ORDER BY created_at DESC, id DESC LIMIT 50""")
def filter_audit(spark, sf):
    return filters.filter_audit(audit(spark, sf), 4, action="READ", since="2024-01-05", until="2024-01-25").select(
        "id", "user_id", "action", "resource", "created_at")


@query("access_matrix", f"""WITH {AUDIT_SQL} SELECT role, resource, access AS action, count(*) AS violations FROM audit
WHERE role <> 'ADMIN' AND NOT ((role = 'ANALYST' AND ((resource = 'complaints' AND access IN ('read', 'search'))
   OR (resource = 'patterns' AND access IN ('read', 'create', 'update'))
   OR (resource = 'generated_complaints' AND access IN ('read', 'create', 'update', 'delete'))
   OR (resource IN ('users', 'organizations') AND access = 'read')))
  OR (role = 'VIEWER' AND ((resource = 'complaints' AND access IN ('read', 'search'))
   OR (resource IN ('patterns', 'generated_complaints', 'organizations') AND access = 'read'))))
GROUP BY 1, 2, 3""")
def access_matrix(spark, sf):
    accesses = audit(spark, sf).select("id", "role", "resource", F.col("access").alias("action"))
    return filters.access_violations(accesses).groupBy("role", "resource", "action").agg(F.count("*").alias("violations"))


@query("failed_logins", f"""WITH {AUDIT_SQL} SELECT user_id, count(*) AS failed, max(created_at) AS last_failed_at FROM audit
WHERE action = 'LOGIN_FAILED' AND created_at >= TIMESTAMP '2024-01-29' AND created_at <= TIMESTAMP '2024-01-30' GROUP BY 1""")
def failed_logins(spark, sf):
    return filters.failed_logins(audit(spark, sf), "2024-01-30")


@query("user_actions", f"""WITH {AUDIT_SQL} SELECT id, action, resource, created_at FROM audit WHERE user_id = 12""")
def user_actions(spark, sf):
    return filters.user_actions(audit(spark, sf), 12).select("id", "action", "resource", "created_at")


@query("resource_accesses", f"""WITH {AUDIT_SQL} SELECT id, user_id, action, created_at FROM audit
WHERE resource = 'patterns' AND resource_id = '40'""")
def resource_accesses(spark, sf):
    return filters.resource_accesses(audit(spark, sf), "patterns", "40").select("id", "user_id", "action", "created_at")


@query("audit_activity", """SELECT CAST(date_trunc('day', ts) AS DATE) AS period, event_type AS action, count(*) AS events,
count(DISTINCT user_id) AS active_users FROM events GROUP BY 1, 2""")
def audit_activity(spark, sf):
    return stats.audit_activity(table(spark, sf, "events"))


@query("audit_activity_weekly", """SELECT CAST(date_trunc('week', ts) AS DATE) AS period, event_type AS action, count(*) AS events,
count(DISTINCT user_id) AS active_users FROM events GROUP BY 1, 2""")
def audit_activity_weekly(spark, sf):
    return stats.audit_activity(table(spark, sf, "events"), "week")


# ---- further pattern lists ----------------------------------------------------------------------------------------


@query("trending_patterns", f"""WITH {PATTERNS_SQL}, {series_sql(84, AS_OF_TREND)}, {FIT_SQL}
SELECT pattern_id, direction, round(t.trend_score, 6) AS trend_score FROM patterns JOIN trends t ON t.key = pattern_id
WHERE is_active ORDER BY round(t.trend_score, 6) DESC, pattern_id LIMIT 10""")
def trending_patterns(spark, sf):
    active = patterns(spark, sf).where("is_active").drop("trend_score")
    scored = detect.pattern_trends(active, complaints(spark, sf), AS_OF_TREND).withColumn("trend_score", F.round("trend_score", 6))
    return stats.sorted_top(scored, [("trend_score", "desc"), ("pattern_id", "asc")], 10).select("pattern_id", "direction", "trend_score")


@query("global_patterns", f"""WITH {COMPLAINTS_SQL}, {TENANT_PATTERNS_SQL}, every AS (
  SELECT pattern_id, organization_id, severity_score FROM tenant_patterns
  UNION ALL SELECT make, CAST(NULL AS INT), CAST(count(*) AS DOUBLE) FROM complaints GROUP BY make)
SELECT pattern_id, severity_score FROM every WHERE organization_id IS NULL ORDER BY severity_score DESC, pattern_id LIMIT 20""")
def global_patterns(spark, sf):
    own = tenant_patterns(spark, sf).select("pattern_id", "organization_id", "severity_score")
    shared = complaints(spark, sf).groupBy("make").agg(F.count("*").cast("double").alias("severity_score")).select(
        F.col("make").alias("pattern_id"), F.lit(None).cast("int").alias("organization_id"), "severity_score")
    return filters.filter_patterns(own.unionByName(shared), org=None, sort="severity_score", limit=20).select(
        "pattern_id", "severity_score")
