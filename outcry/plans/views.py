"""Complaint-shaped views over the driver tables, and the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outcry.operators import stats

AS_OF_TREND = "2001-03-26"     # 84 days after 2001-01-01
AS_OF_ALERT = "2001-04-01"     # 90 days after 2001-01-01
AS_OF = "2001-11-05"
YEAR_DAYS = 308                # 2001-01-01 to AS_OF


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("source_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("p_brand").alias("make"),
        F.col("p_type").alias("model"),
        (F.lit(1970) + F.col("p_size")).alias("model_year"),
        F.col("p_name").alias("component"),
        F.concat(F.lit("The "), F.col("p_name"), F.lit(" of my "), F.col("p_brand"), F.lit(" failed, status "),
                 F.col("l_linestatus")).alias("description"),
        (F.col("l_returnflag") == "R").alias("crash"),
        ((F.col("l_linestatus") == "F") & (F.col("l_discount") >= 0.09)).alias("fire"),
        F.when(F.col("l_quantity") >= 45, F.col("l_quantity").cast("int") - 44).otherwise(0).alias("injuries"),
        F.when(F.col("l_quantity") >= 50, 1).otherwise(0).alias("deaths"),
        F.col("l_shipdate").alias("date_added"),
        F.concat(F.col("p_brand"), F.lit("/"), F.col("p_type")).alias("cluster_id"),
    )


COMPLAINTS_SQL = """complaints AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS source_id,
         l_orderkey AS order_id, l_suppkey AS supplier_id,
         p_brand AS make, p_type AS model, 1970 + p_size AS model_year, p_name AS component,
         'The ' || p_name || ' of my ' || p_brand || ' failed, status ' || l_linestatus AS description,
         l_returnflag = 'R' AS crash, (l_linestatus = 'F' AND l_discount >= 0.09) AS fire,
         CASE WHEN l_quantity >= 45 THEN CAST(l_quantity AS INT) - 44 ELSE 0 END AS injuries,
         CASE WHEN l_quantity >= 50 THEN 1 ELSE 0 END AS deaths,
         l_shipdate AS date_added, p_brand || '/' || p_type AS cluster_id
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One global pattern per cluster with its totals; active unless it has no death."""
    c = complaints(spark, sf_dir)
    per = c.groupBy("cluster_id", "make", "model").agg(
        *stats.outcome_aggregates(), F.min("date_added").alias("first_seen"), F.max("date_added").alias("last_updated"),
        F.min("model_year").alias("year_start"), F.max("model_year").alias("year_end"))
    return per.select(
        F.col("cluster_id").alias("pattern_id"), F.concat("make", F.lit(" "), "model").alias("name"), "make", "model",
        "year_start", "year_end", F.col("total").alias("complaint_count"),
        (F.col("deaths") * 100 + F.col("injuries") * 20 + F.col("crashes") * 10 + F.col("fires") * 15
         + F.col("total")).cast("double").alias("severity_score"),
        F.lit(0.0).alias("trend_score"), (F.col("deaths") > 0).alias("is_active"), "first_seen", "last_updated")


PATTERNS_SQL = COMPLAINTS_SQL + """,
patterns AS (
  SELECT cluster_id AS pattern_id, make || ' ' || model AS name, make, model,
         min(model_year) AS year_start, max(model_year) AS year_end, count(*) AS complaint_count,
         CAST(sum(deaths) * 100 + sum(injuries) * 20 + sum(CAST(crash AS INT)) * 10 + sum(CAST(fire AS INT)) * 15
              + count(*) AS DOUBLE) AS severity_score,
         0.0::DOUBLE AS trend_score, sum(deaths) > 0 AS is_active,
         min(date_added) AS first_seen, max(date_added) AS last_updated
  FROM complaints GROUP BY cluster_id, make, model)"""


def with_sql(*views: str) -> str:
    return "WITH " + ", ".join(views)


def series_sql(days: int, as_of: str, name: str = "series") -> str:
    """The weekly series as SQL, on top of the complaints view."""
    return f"""weeks_{name} AS (
  SELECT cluster_id AS key, CAST(date_added AS DATE) - CAST(extract(dow FROM date_added) AS INT) AS wk, count(*) AS v
  FROM complaints WHERE date_added >= TIMESTAMP '{as_of}' - INTERVAL {days} DAY GROUP BY 1, 2),
{name} AS (
  SELECT key, wk, v, row_number() OVER (PARTITION BY key ORDER BY wk) - 1 AS i, count(*) OVER (PARTITION BY key) AS n
  FROM weeks_{name})"""


FIT_SQL = """sums AS (
  SELECT key, CAST(count(*) AS DOUBLE) AS n, sum(CAST(i AS DOUBLE)) AS si, sum(CAST(v AS DOUBLE)) AS sv,
         sum(CAST(i AS DOUBLE) * i) AS sii, sum(CAST(v AS DOUBLE) * v) AS svv, sum(CAST(i AS DOUBLE) * v) AS siv
  FROM series GROUP BY key),
abc AS (SELECT *, n*siv - si*sv AS a, n*sii - si*si AS b, n*svv - sv*sv AS c FROM sums),
fit AS (
  SELECT key, CAST(n AS BIGINT) AS n,
         CASE WHEN n >= 3 THEN a/b ELSE 0 END AS slope,
         CASE WHEN n >= 3 THEN (sv - a/b*si)/n ELSE 0 END AS intercept,
         CASE WHEN n >= 3 AND c > 0 THEN a*a/(b*c) ELSE 0 END AS r2,
         CASE WHEN n < 3 THEN 1.0 WHEN c <= 0 OR b*c - a*a <= 0 THEN 0.5
              WHEN (n-2)*a*a > 6.25*(b*c-a*a) THEN 0.01 WHEN (n-2)*a*a > 4*(b*c-a*a) THEN 0.05
              WHEN (n-2)*a*a > 2.25*(b*c-a*a) THEN 0.1 ELSE 0.5 END::DOUBLE AS p_value
  FROM abc),
trends AS (
  SELECT *, slope*r2*10 AS trend_score,
         CASE WHEN n >= 3 AND p_value < 0.1 AND slope > 0.5 THEN 'INCREASING'
              WHEN n >= 3 AND p_value < 0.1 AND slope < -0.5 THEN 'DECREASING' ELSE 'STABLE' END AS direction,
         CASE WHEN n >= 3 AND r2 > 0.7 AND p_value < 0.05 THEN 'HIGH'
              WHEN n >= 3 AND r2 > 0.4 AND p_value < 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
  FROM fit)"""
