"""Weekly series, detectors, scores and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from outcry.operators import detect, scoring, series
from outcry.plans.registry import query
from outcry.plans.views import (AS_OF, AS_OF_ALERT, AS_OF_TREND, COMPLAINTS_SQL, FIT_SQL, PATTERNS_SQL, YEAR_DAYS,
                                complaints, patterns, series_sql)

YEAR = f"WITH {COMPLAINTS_SQL}, {series_sql(YEAR_DAYS, AS_OF)}"


def r6(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


def _year(spark, sf):
    return series.weekly_counts(complaints(spark, sf), AS_OF, days=YEAR_DAYS)


@query("weekly_counts", YEAR + " SELECT key, wk, v, i, n FROM series")
def weekly_counts(spark, sf):
    return _year(spark, sf)


@query("weekly_counts_filled", f"""WITH {COMPLAINTS_SQL}, {series_sql(YEAR_DAYS, AS_OF)},
spans AS (SELECT key, min(wk) AS a, max(wk) AS b FROM series GROUP BY key),
grid AS (SELECT key, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS wk FROM spans),
filled AS (SELECT g.key, g.wk, coalesce(s.v, 0) AS v FROM grid g LEFT JOIN series s ON s.key = g.key AND s.wk = g.wk)
SELECT key, wk, v, row_number() OVER (PARTITION BY key ORDER BY wk) - 1 AS i, count(*) OVER (PARTITION BY key) AS n
FROM filled""")
def weekly_counts_filled(spark, sf):
    return series.weekly_counts(complaints(spark, sf), AS_OF, days=YEAR_DAYS, fill_gaps=True)


@query("rolling_stats", YEAR + """
SELECT key, wk, v, i, CASE WHEN i >= 3 THEN round(s/c, 6) END AS mean,
       CASE WHEN i >= 3 THEN round(sqrt(greatest(c*q-s*s, 0))/c, 6) END AS std_dev
FROM (SELECT *, CAST(count(*) OVER w AS DOUBLE) AS c, sum(CAST(v AS DOUBLE)) OVER w AS s,
             sum(CAST(v AS DOUBLE)*v) OVER w AS q FROM series
      WINDOW w AS (PARTITION BY key ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))""")
def rolling_stats(spark, sf):
    return series.rolling_stats(_year(spark, sf)).select("key", "wk", "v", "i", *r6("mean", "std_dev"))


@query("z_score", YEAR + """
SELECT key, wk, v, CASE WHEN q*c - s*s <= 0 THEN 0 ELSE round((v - s/c)/(sqrt(c*q-s*s)/c), 6) END AS z
FROM (SELECT *, CAST(count(*) OVER w AS DOUBLE) AS c, sum(CAST(v AS DOUBLE)) OVER w AS s,
             sum(CAST(v AS DOUBLE)*v) OVER w AS q FROM series
      WINDOW w AS (PARTITION BY key ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE i >= 3""")
def z_score(spark, sf):
    s = series.rolling_stats(_year(spark, sf)).where("mean IS NOT NULL")
    return s.select("key", "wk", "v", F.round(series.z_score(F.col("v"), F.col("mean"), F.col("std_dev")), 6).alias("z"))


SPIKE = """(SELECT *, CAST(count(*) OVER w AS DOUBLE) AS c, coalesce(sum(CAST(v AS DOUBLE)) OVER w, 0) AS s,
            coalesce(sum(CAST(v AS DOUBLE)*v) OVER w, 0) AS q FROM series
     WINDOW w AS (PARTITION BY key ORDER BY i ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING))"""


@query("detect_spikes", YEAR + f"""
SELECT key, wk, v, i, round((c*v-s)/sqrt(c*q-s*s), 6) AS z, s/c AS expected FROM {SPIKE.format(k=4)}
WHERE i >= 4 AND c*q-s*s > 0 AND c*v-s > 0 AND (c*v-s)*(c*v-s) > 9*(c*q-s*s)""")
def detect_spikes(spark, sf):
    return detect.detect_spikes(_year(spark, sf)).select("key", "wk", "v", "i", *r6("z"), "expected")


@query("linear_trend", YEAR + f", {FIT_SQL} SELECT key, n, round(slope,6) AS slope, round(intercept,6) AS intercept, "
       "round(r2,6) AS r2, p_value FROM fit")
def linear_trend(spark, sf):
    return detect.linear_trend(_year(spark, sf)).select("key", "n", *r6("slope", "intercept", "r2"), "p_value")


@query("trend_direction", YEAR + f", {FIT_SQL} SELECT key, n, direction, confidence, round(trend_score,6) AS trend_score "
       "FROM trends")
def trend_direction(spark, sf):
    t = detect.trend_direction(detect.linear_trend(_year(spark, sf)))
    return t.select("key", "n", "direction", "confidence", *r6("trend_score"))


TREND_SPIKES = " UNION ALL ".join(
    f"SELECT * FROM (SELECT key, wk, v, i, n, c, s, q, {k} AS k FROM {SPIKE.format(k=k)}) "
    f"WHERE least(4, n // 2) = {k} AND i >= {k} AND c*q-s*s > 0 AND c*v-s > 0 AND (c*v-s)*(c*v-s) > 9*(c*q-s*s)"
    for k in (2, 3, 4))


@query("trend_spikes", f"""WITH {COMPLAINTS_SQL}, {series_sql(84, AS_OF_TREND)}
SELECT key, wk, v, i, round((c*v-s)/sqrt(c*q-s*s), 6) AS z, round(s/c, 6) AS expected FROM ({TREND_SPIKES})""")
def trend_spikes(spark, sf):
    s = series.weekly_counts(complaints(spark, sf), AS_OF_TREND)
    return detect.trend_spikes(s).select("key", "wk", "v", "i", *r6("z", "expected"))


def pattern_trends_sql(days: int, as_of: str) -> str:
    return f"""WITH {PATTERNS_SQL}, {series_sql(days, as_of)}, {FIT_SQL},
hits AS (SELECT key, count(*) AS spike_count FROM ({TREND_SPIKES}) GROUP BY key),
lists AS (SELECT key, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS weekly_values FROM series GROUP BY key)
SELECT pattern_id, name, coalesce(t.n, 0) AS n, coalesce(direction, 'STABLE') AS direction,
       coalesce(confidence, 'LOW') AS confidence, round(coalesce(t.slope, 0), 6) AS slope,
       round(coalesce(r2, 0), 6) AS r2, round(coalesce(t.trend_score, 0), 6) AS trend_score,
       coalesce(spike_count, 0) AS spike_count, coalesce(weekly_values, '') AS weekly_values
FROM patterns LEFT JOIN trends t ON t.key = pattern_id LEFT JOIN hits h ON h.key = pattern_id
LEFT JOIN lists l ON l.key = pattern_id"""


def _trend_report(df):
    return df.select("pattern_id", "name", "n", "direction", "confidence", *r6("slope", "r2", "trend_score"),
                     F.col("spike_count").cast("long").alias("spike_count"),
                     F.concat_ws(",", F.col("weekly_values").cast("array<string>")).alias("weekly_values"))


@query("pattern_trends", pattern_trends_sql(84, AS_OF_TREND) + " WHERE pattern_id = 'Brand#1/ECONOMY'")
def pattern_trends(spark, sf):
    one = patterns(spark, sf).where(F.col("pattern_id") == "Brand#1/ECONOMY").drop("trend_score")
    return _trend_report(detect.pattern_trends(one, complaints(spark, sf), AS_OF_TREND))


@query("all_pattern_trends", pattern_trends_sql(84, AS_OF_TREND) + " WHERE is_active")
def all_pattern_trends(spark, sf):
    active = patterns(spark, sf).where("is_active").drop("trend_score")
    return _trend_report(detect.pattern_trends(active, complaints(spark, sf), AS_OF_TREND))


QUARTILES = """ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY v, i) - 1 AS r FROM series),
quart AS (SELECT key, CAST(max(CASE WHEN r = CAST(floor(n*0.25) AS BIGINT) THEN v END) AS DOUBLE) AS q1,
                 CAST(max(CASE WHEN r = CAST(floor(n*0.75) AS BIGINT) THEN v END) AS DOUBLE) AS q3
          FROM ranked GROUP BY key),
outl AS (SELECT s.key, wk, v, i, q1 - 1.5::DOUBLE*(q3-q1) AS lower_bound, q3 + 1.5::DOUBLE*(q3-q1) AS upper_bound
         FROM series s JOIN quart USING (key)
         WHERE n >= 4 AND (v < q1 - 1.5::DOUBLE*(q3-q1) OR v > q3 + 1.5::DOUBLE*(q3-q1)))"""


@query("iqr_outliers", YEAR + f", {QUARTILES} SELECT key, wk, v, i, lower_bound, upper_bound FROM outl")
def iqr_outliers(spark, sf):
    return detect.iqr_outliers(_year(spark, sf))


@query("level_shifts", YEAR + """
SELECT key, wk, i, b/4 AS before_mean, a/4 AS after_mean, round((a-b)/b*100, 6) AS change_percent
FROM (SELECT *, sum(CAST(v AS DOUBLE)) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b,
             sum(CAST(v AS DOUBLE)) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS a
      FROM series)
WHERE n >= 8 AND i >= 4 AND i <= n-4 AND b <> 0 AND abs(a-b)*100 >= 50*abs(b)""")
def level_shifts(spark, sf):
    return detect.level_shifts(_year(spark, sf)).select("key", "wk", "i", "before_mean", "after_mean",
                                                        *r6("change_percent"))


def all_days_sql() -> str:
    return f"WITH {COMPLAINTS_SQL}, {series_sql(3000, AS_OF)}"


@query("seasonal_outliers", all_days_sql() + """, st AS (
  SELECT *, i % 4 AS season, CAST(count(*) OVER w AS DOUBLE) AS c, sum(CAST(v AS DOUBLE)) OVER w AS s,
         sum(CAST(v AS DOUBLE)*v) OVER w AS q FROM series WHERE n >= 8 WINDOW w AS (PARTITION BY key, i % 4))
SELECT key, wk, v, i, season, round(s/c, 6) AS expected, round((c*v-s)/sqrt((c*q-s*s)*c/(c-1)), 6) AS deviation
FROM st WHERE c > 1 AND c*q-s*s > 0 AND (c-1)*(c*v-s)*(c*v-s) > 9*c*(c*q-s*s)""")
def seasonal_outliers(spark, sf):
    s = series.weekly_counts(complaints(spark, sf), AS_OF, days=3000)
    return (detect.seasonal_outliers(s, season_length=4)
            .select("key", "wk", "v", "i", F.col("season").cast("long").alias("season"), *r6("expected", "deviation")))


ANOMALIES = """ctx AS (
  SELECT *, CAST(count(*) OVER p4 AS DOUBLE) AS c4, coalesce(sum(CAST(v AS DOUBLE)) OVER p4, 0) AS s4,
         coalesce(sum(CAST(v AS DOUBLE)*v) OVER p4, 0) AS q4,
         CAST(count(*) OVER n3 AS DOUBLE) AS c3, coalesce(sum(CAST(v AS DOUBLE)) OVER n3, 0) AS s3,
         sum(CAST(v AS DOUBLE)) OVER pa / nullif(count(*) OVER pa, 0) AS all_mean
  FROM series
  WINDOW p4 AS (PARTITION BY key ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
         n3 AS (PARTITION BY key ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING),
         pa AS (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (
  SELECT c.key, c.wk, c.v, c.i,
         coalesce(nullif(CASE WHEN c.i >= 4 THEN s4/c4 END, 0), nullif(all_mean, 0), 0) AS expected,
         coalesce(nullif(CASE WHEN c.i >= 4 THEN sqrt(greatest(c4*q4-s4*s4, 0))/c4 END, 0), 1) AS sd,
         CASE WHEN c3 >= 3 AND s3/c3 > 2*(CASE WHEN c4 > 0 THEN s4/c4 ELSE 0 END)
                   AND abs(s3/c3 - c.v) < c.v*0.3::DOUBLE THEN 'LEVEL_SHIFT' ELSE 'SPIKE' END AS type
  FROM ctx c JOIN outl o ON o.key = c.key AND o.i = c.i),
anomalies AS (SELECT key, wk, v, i, expected, (v - expected)/sd AS deviation, type FROM judged)"""


@query("detect_anomalies", YEAR + f", {QUARTILES}, {ANOMALIES} SELECT key, wk, v, i, round(expected,6) AS expected, "
       "round(deviation,6) AS deviation, type FROM anomalies")
def detect_anomalies(spark, sf):
    return detect.detect_anomalies(_year(spark, sf)).select("key", "wk", "v", "i", *r6("expected", "deviation"), "type")


@query("classify_anomaly", YEAR + f", {QUARTILES}, {ANOMALIES} SELECT type, count(*) AS anomalies FROM anomalies GROUP BY type")
def classify_anomaly(spark, sf):
    return detect.detect_anomalies(_year(spark, sf)).groupBy("type").agg(F.count("*").alias("anomalies"))


@query("anomaly_alerts", f"""WITH {PATTERNS_SQL}, {series_sql(90, AS_OF_ALERT)}, {QUARTILES}, {ANOMALIES},
per AS (SELECT key, bool_or(type = 'LEVEL_SHIFT') AS shifted, bool_or(type = 'SPIKE' AND deviation > 5) AS spiked,
               count(*) AS anomaly_count FROM anomalies GROUP BY key)
SELECT pattern_id, name, severity_score AS severity, anomaly_count,
       CASE WHEN shifted THEN 'Investigate sustained increase in complaints'
            WHEN spiked THEN 'Urgent review needed - significant spike detected'
            ELSE 'Monitor closely' END AS recommended_action
FROM patterns JOIN per ON key = pattern_id WHERE is_active""")
def anomaly_alerts(spark, sf):
    alerts = detect.anomaly_alerts(patterns(spark, sf), complaints(spark, sf), AS_OF_ALERT)
    return alerts.drop("anomalies").orderBy(F.desc("severity"), "pattern_id")


@query("pattern_anomalies", f"""WITH {COMPLAINTS_SQL}, {series_sql(84, AS_OF_TREND)}, {QUARTILES}, {ANOMALIES}
SELECT key, wk, v, i, round(expected,6) AS expected, round(deviation,6) AS deviation, type FROM anomalies""")
def pattern_anomalies(spark, sf):
    found = detect.pattern_anomalies(complaints(spark, sf), None, AS_OF_TREND)
    return found.select("key", "wk", "v", "i", *r6("expected", "deviation"), "type")


@query("global_daily_analysis", f"""WITH {COMPLAINTS_SQL},
pts AS (SELECT date_added AS d, md5(source_id) AS h, source_id,
               CAST(injuries + deaths*10 + (CASE WHEN crash THEN 5 ELSE 0 END) + (CASE WHEN fire THEN 5 ELSE 0 END)
                    AS BIGINT) AS v
        FROM complaints WHERE date_added >= TIMESTAMP '{AS_OF_ALERT}' - INTERVAL 90 DAY),
series AS (SELECT 0 AS key, v, row_number() OVER (ORDER BY d, h, source_id, v) - 1 AS i, count(*) OVER () AS n FROM pts),
{QUARTILES.replace('wk, ', '')}, {FIT_SQL}
SELECT n AS complaints_analyzed, direction AS trend_direction, round(slope, 9) AS trend_slope,
       (SELECT count(*) FROM outl) AS anomaly_count FROM trends""")
def global_daily_analysis(spark, sf):
    out = detect.global_daily_analysis(complaints(spark, sf), AS_OF_ALERT)
    return out.withColumn("trend_slope", F.round("trend_slope", 9))


@query("growth_wow", YEAR + """
SELECT key, wk, v, lag(v) OVER w AS prev_v, round(CAST(v - lag(v) OVER w AS DOUBLE)/lag(v) OVER w, 6) AS growth
FROM series WINDOW w AS (PARTITION BY key ORDER BY wk)""")
def growth_wow(spark, sf):
    return series.growth_wow(_year(spark, sf)).select("key", "wk", "v", "prev_v", *r6("growth"))


def scored(spark, sf):
    """Patterns with their trend and severity score: the flagship plan, one scan of the complaints."""
    metrics = scoring.pattern_metrics(complaints(spark, sf), AS_OF_TREND, carry=("make", "model"))
    named = metrics.withColumnRenamed("cluster_id", "pattern_id").withColumns({
        "name": F.concat("make", F.lit(" "), "model"), "is_active": F.col("deaths") > 0})
    return named.transform(scoring.with_score)


SCORED_SQL = f"""WITH {PATTERNS_SQL}, {series_sql(84, AS_OF_TREND)}, {FIT_SQL},
metrics AS (SELECT cluster_id, count(*) AS complaint_count, CAST(sum(CAST(crash AS INT)) AS BIGINT) AS crashes,
                   CAST(sum(CAST(fire AS INT)) AS BIGINT) AS fires, CAST(sum(injuries) AS BIGINT) AS injuries,
                   CAST(sum(deaths) AS BIGINT) AS deaths FROM complaints GROUP BY cluster_id),
scored AS (
  SELECT pattern_id, name, is_active, coalesce(direction, 'STABLE') AS direction, coalesce(t.trend_score, 0) AS trend_score,
         m.complaint_count, crashes, fires, injuries, deaths,
         CAST(deaths AS DOUBLE)*100 + CAST(injuries AS DOUBLE)*20 + CAST(crashes AS DOUBLE)*10
         + CAST(fires AS DOUBLE)*15 + CAST(m.complaint_count AS DOUBLE) + coalesce(t.trend_score, 0)*5 AS score
  FROM patterns p JOIN metrics m ON m.cluster_id = pattern_id LEFT JOIN trends t ON t.key = pattern_id)"""


@query("severity_score", SCORED_SQL + """ SELECT pattern_id, complaint_count, crashes, fires, injuries, deaths,
round(trend_score, 6) AS trend_score, round(score, 6) AS score, round(trend_score*5, 6) AS part_trend_score FROM scored""")
def severity_score(spark, sf):
    return scored(spark, sf).select("pattern_id", "complaint_count", "crashes", "fires", "injuries", "deaths",
                                    *r6("trend_score", "score", "part_trend_score"))


@query("severity_score_joined", SCORED_SQL + """ SELECT pattern_id, complaint_count, round(trend_score, 6) AS trend_score,
round(score, 6) AS score FROM scored""")
def severity_score_joined(spark, sf):
    """The same scores from a given pattern table and its trends."""
    c = complaints(spark, sf)
    trends = detect.pattern_trends(patterns(spark, sf).drop("trend_score"), c, AS_OF_TREND)
    return scoring.severity_score(trends.drop("complaint_count", "severity_score"), c).select(
        "pattern_id", "complaint_count", *r6("trend_score", "score"))


@query("rank_patterns", SCORED_SQL + """, best AS (SELECT * FROM scored WHERE is_active AND score >= 0
ORDER BY score DESC, pattern_id LIMIT 100)
SELECT row_number() OVER (ORDER BY score DESC, pattern_id) AS rank, pattern_id, name, direction,
       round(score, 6) AS score, round(trend_score, 6) AS trend_score, complaint_count FROM best""")
def rank_patterns(spark, sf):
    ranked = scoring.rank_patterns(scored(spark, sf))
    return ranked.select(F.col("rank").cast("long").alias("rank"), "pattern_id", "name", "direction",
                         *r6("score", "trend_score"), "complaint_count")


@query("relative_severity", SCORED_SQL + """
SELECT pattern_id, round(score, 6) AS score, total_patterns, rank,
       CAST(floor((CAST(total_patterns - rank + 1 AS DOUBLE))/total_patterns*100 + 0.5) AS BIGINT) AS percentile
FROM (SELECT *, count(*) OVER () AS total_patterns, row_number() OVER (ORDER BY score DESC, pattern_id) AS rank
      FROM scored WHERE is_active)""")
def relative_severity(spark, sf):
    return scoring.relative_severity(scored(spark, sf)).withColumn("score", F.round("score", 6))


@query("refresh_severity", SCORED_SQL + f""" SELECT pattern_id, round(score, 6) AS severity_score, complaint_count,
TIMESTAMP '{AS_OF}' AS last_updated FROM scored""")
def refresh_severity(spark, sf):
    out = scoring.refresh_severity(scored(spark, sf), AS_OF)
    return out.withColumn("severity_score", F.round("severity_score", 6))
