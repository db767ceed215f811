"""Tenant-shaped views: nations as organisations, customers as users, orders as documents, events as audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outcry.functions.codes import first_match
from outcry.plans.views import complaints, table

def k_value():
    return F.get_json_object(F.col("props"), "$.k").cast("int")


K_SQL = "CAST(json_extract_string(props, '$.k') AS INT)"


def orgs(spark: SparkSession, sf: str) -> DataFrame:
    region = F.col("n_regionkey")
    plan = first_match([(region == 1, F.lit("BASIC")), (region == 2, F.lit("PRO")), (region == 3, F.lit("ENTERPRISE"))],
                       "FREE")
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("organization_id"), F.col("n_name").alias("name"),
                                             plan.alias("plan"))


ORGS_SQL = """orgs AS (SELECT n_nationkey AS organization_id, n_name AS name,
  CASE n_regionkey WHEN 1 THEN 'BASIC' WHEN 2 THEN 'PRO' WHEN 3 THEN 'ENTERPRISE' ELSE 'FREE' END AS plan FROM nation)"""


def users(spark: SparkSession, sf: str) -> DataFrame:
    balance = F.col("c_acctbal")
    role = F.when(balance > 8000, "ADMIN").when(balance > 3000, "ANALYST").otherwise("VIEWER")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("organization_id"),
        F.col("c_name").alias("email"), role.alias("role"), F.col("c_custkey").alias("created_at"))


USERS_SQL = """users AS (SELECT c_custkey AS user_id, c_nationkey AS organization_id, c_name AS email,
  CASE WHEN c_acctbal > 8000 THEN 'ADMIN' WHEN c_acctbal > 3000 THEN 'ANALYST' ELSE 'VIEWER' END AS role,
  c_custkey AS created_at FROM customer)"""


def tenant_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns per nation (of the supplier) and make."""
    nation = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier_id"),
                                                 F.col("s_nationkey").alias("organization_id"))
    c = complaints(spark, sf).join(nation, "supplier_id")
    late = F.count_if(F.col("date_added") >= F.expr("timestamp_ntz'2001-01-01'"))
    return c.groupBy("organization_id", "make").agg(
        F.count("*").alias("complaint_count"),
        (F.sum("deaths") * 100 + F.sum("injuries") * 20 + F.count("*")).cast("double").alias("severity_score"),
        F.when(late * 8 > F.count("*"), "INCREASING").otherwise("STABLE").alias("trend_direction"),
        F.min("date_added").alias("created_at"), F.max("date_added").alias("updated_at"),
    ).select(
        F.concat(F.col("organization_id").cast("string"), F.lit(":"), F.col("make")).alias("pattern_id"),
        "organization_id", F.concat(F.lit("Failures of "), "make").alias("name"), "make", F.lit("ANY").alias("model"),
        "complaint_count", "severity_score", "trend_direction", "created_at", "updated_at")


TENANT_PATTERNS_SQL = """tenant_patterns AS (
  SELECT CAST(s_nationkey AS VARCHAR) || ':' || make AS pattern_id, s_nationkey AS organization_id,
         'Failures of ' || make AS name, make, 'ANY' AS model, count(*) AS complaint_count,
         CAST(sum(deaths) * 100 + sum(injuries) * 20 + count(*) AS DOUBLE) AS severity_score,
         CASE WHEN count(*) FILTER (date_added >= TIMESTAMP '2001-01-01') * 8 > count(*) THEN 'INCREASING' ELSE 'STABLE' END AS trend_direction,
         min(date_added) AS created_at, max(date_added) AS updated_at
  FROM complaints JOIN supplier ON s_suppkey = supplier_id GROUP BY s_nationkey, make)"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as generated documents of the customer's nation, on the pattern named by the order priority's digit."""
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                                   F.col("c_nationkey").alias("organization_id"))
    status = first_match([(F.col("o_orderstatus") == "F", F.lit("FINALIZED")), (F.col("o_orderstatus") == "P", F.lit("FILED"))],
                         "DRAFT")
    make = F.concat(F.lit("Brand#"), F.substring("o_orderpriority", 1, 1))
    return table(spark, sf, "orders").join(customer, "o_custkey").select(
        F.col("o_orderkey").alias("document_id"), "organization_id",
        F.concat(F.col("organization_id").cast("string"), F.lit(":"), make).alias("pattern_id"),
        F.concat(F.lit("Case "), F.col("o_orderkey").cast("string")).alias("title"), status.alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("created_by"))


DOCUMENTS_SQL = """documents_made AS (
  SELECT o_orderkey AS document_id, c_nationkey AS organization_id,
         CAST(c_nationkey AS VARCHAR) || ':Brand#' || substr(o_orderpriority, 1, 1) AS pattern_id,
         'Case ' || CAST(o_orderkey AS VARCHAR) AS title,
         CASE o_orderstatus WHEN 'F' THEN 'FINALIZED' WHEN 'P' THEN 'FILED' ELSE 'DRAFT' END AS status,
         o_orderdate AS created_at, o_custkey AS created_by
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def audit(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    action = first_match([(kind == "signup", F.lit("LOGIN")), (kind == "error", F.lit("LOGIN_FAILED")),
                          (kind == "view", F.lit("READ")), (kind == "click", F.lit("UPDATE"))], "EXPORT")
    access = first_match([(kind == "click", F.lit("update")), (kind == "purchase", F.lit("create")),
                          (kind == "signup", F.lit("search")), (kind == "error", F.lit("delete"))], "read")
    k = F.col("k")
    resource = (F.when(k < 20, "complaints").when(k < 50, "patterns").when(k < 70, "generated_complaints")
                .when(k < 85, "users").otherwise("organizations"))
    log = table(spark, sf, "events").withColumn("k", k_value()).select(
        F.col("event_id").alias("id"), "user_id", action.alias("action"), access.alias("access"),
        resource.alias("resource"), F.when(k > 30, k.cast("string")).alias("resource_id"), F.col("ts").alias("created_at"))
    who = users(spark, sf).select("user_id", "organization_id", "role")
    return log.join(who, "user_id")


AUDIT_SQL = f"""audit AS (
  SELECT event_id AS id, e.user_id,
         CASE event_type WHEN 'signup' THEN 'LOGIN' WHEN 'error' THEN 'LOGIN_FAILED' WHEN 'view' THEN 'READ'
              WHEN 'click' THEN 'UPDATE' ELSE 'EXPORT' END AS action,
         CASE event_type WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'create' WHEN 'signup' THEN 'search'
              WHEN 'error' THEN 'delete' ELSE 'read' END AS access,
         CASE WHEN k < 20 THEN 'complaints' WHEN k < 50 THEN 'patterns' WHEN k < 70 THEN 'generated_complaints'
              WHEN k < 85 THEN 'users' ELSE 'organizations' END AS resource,
         CASE WHEN k > 30 THEN CAST(k AS VARCHAR) END AS resource_id, ts AS created_at,
         c_nationkey AS organization_id,
         CASE WHEN c_acctbal > 8000 THEN 'ADMIN' WHEN c_acctbal > 3000 THEN 'ANALYST' ELSE 'VIEWER' END AS role
  FROM (SELECT *, {K_SQL} AS k FROM events) e JOIN customer ON c_custkey = e.user_id)"""
