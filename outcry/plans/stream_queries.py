"""Streams over files rendered from the driver tables; each run takes what has landed, as the scheduled job would."""

from __future__ import annotations

from pyspark.sql import functions as F

from outcry.plans.clean_queries import CLEAN_SQL, NEW_COLS, ORDER, QUARANTINE_SQL, RAW_BULK_SQL, arrival
from outcry.plans.feeds_raw import packed, raw_bulk
from outcry.plans.registry import ORACLES, query
from outcry.plans.series_queries import SPIKE, r6
from outcry.plans.table_queries import BILLING_SQL, billing_columns, identity_events
from outcry.plans.tenants import orgs, users
from outcry.plans.vector_queries import CENTROIDS, cos, vecs
from outcry.plans.views import AS_OF, COMPLAINTS_SQL, complaints, series_sql, table
from outcry.operators import vectors
from outcry.schemas import COMPLAINT, EVENTS
from outcry.session import scratch_path
from outcry.streaming import base, digests, ingest, late, state, windows


def in_steps(parts, path: str, run, fmt: str = "parquet"):
    """Land each part and let the stream take it."""
    for part in parts:
        writer = part.write.mode("append").format(fmt)
        (packed(writer) if fmt == "json" else writer).save(path)
        run()


def event_parts(df, ts: str = "ts"):
    day = F.expr("timestamp_ntz'2024-01-11'"), F.expr("timestamp_ntz'2024-01-21'")
    return [df.where(F.col(ts) < day[0]), df.where((F.col(ts) >= day[0]) & (F.col(ts) < day[1])), df.where(F.col(ts) >= day[1])]


def _ingest(spark, sf, horizon=None):
    raw, out = raw_bulk(spark, sf), scratch_path(spark, "ingest")
    parts = [raw.where("crash <> 'N'"), raw.where("crash = 'N'")]
    in_steps(parts, f"{out}/in", lambda: ingest.stream_ingest(spark, f"{out}/in", f"{out}/rows", f"{out}/bad", f"{out}/ck",
                                                             order=arrival(), dedupe_horizon=horizon), "json")
    return out


@query("stream_ingest", f"""WITH {CLEAN_SQL} SELECT {', '.join(NEW_COLS)} FROM (SELECT *, row_number() OVER
(PARTITION BY source_id ORDER BY crash DESC, {', '.join(ORDER)}) AS k FROM clean) WHERE k = 1""")
def stream_ingest(spark, sf):
    return base.read_batches(spark, _ingest(spark, sf) + "/rows", COMPLAINT).select(*NEW_COLS)


@query("stream_ingest_known", f"""WITH {CLEAN_SQL} SELECT {', '.join(NEW_COLS)} FROM (SELECT *, row_number() OVER
(PARTITION BY source_id ORDER BY crash DESC, {', '.join(ORDER)}) AS k FROM clean) WHERE k = 1""")
def stream_ingest_known(spark, sf):
    """As stream_ingest, the keys of earlier landings behind Bloom filters; the first landing comes again at the end."""
    raw, out = raw_bulk(spark, sf), scratch_path(spark, "ingest-known")
    parts = [raw.where("crash <> 'N'"), raw.where("crash = 'N'"), raw.where("crash <> 'N'")]
    in_steps(parts, f"{out}/in", lambda: ingest.stream_ingest_known(spark, f"{out}/in", f"{out}/rows", f"{out}/bad", f"{out}/known", f"{out}/ck",
                                                                   order=arrival(), buckets=8, compact_every=2), "json")
    return base.read_batches(spark, f"{out}/rows", COMPLAINT).select(*NEW_COLS)


@query("stream_ingest_quarantine", f"WITH {RAW_BULK_SQL} {QUARANTINE_SQL}")
def stream_ingest_quarantine(spark, sf):
    return base.read_batches(spark, _ingest(spark, sf) + "/bad").select("source_id", "error")


@query("stream_dedupe", f"""WITH {RAW_BULK_SQL} SELECT cmplid, count(DISTINCT cmplid) AS records FROM raw_bulk GROUP BY 1""")
def stream_dedupe(spark, sf):
    raw, out = raw_bulk(spark, sf), scratch_path(spark, "dedupe")

    def run():
        # only the keys are asked for, so no more is moved
        rows = ingest.stream_dedupe(ingest.landed_feed(spark, f"{out}/in").select("cmplid", "landed_at"))
        base.run_available(rows, lambda b, n: base.write_batch(b.select("cmplid"), f"{out}/rows", n), f"{out}/ck")

    in_steps([raw.where("crash <> 'N'"), raw.where("crash = 'N'")], f"{out}/in", run, "json")
    return base.read_batches(spark, f"{out}/rows").groupBy("cmplid").agg(F.count("*").alias("records"))


def _complaint_parts(spark, sf):
    """All complaints in three landings: those of the early years, those after, and rows of the early years that come late."""
    c = complaints(spark, sf).select("source_id", "cluster_id", "date_added")
    cut = F.expr("timestamp_ntz'1998-06-01'")
    late = F.col("source_id").like("1%") & (F.col("date_added") < cut)
    return [c.where((F.col("date_added") < cut) & ~late), c.where(F.col("date_added") >= cut), c.where(late)]


# all years
ALL_SQL = f"WITH {COMPLAINTS_SQL}, {series_sql(36500, AS_OF)}"


@query("stream_weekly_counts", ALL_SQL + " SELECT key, wk, v, i, n, 0::BIGINT AS dropped FROM series")
def stream_weekly_counts(spark, sf):
    """A watermark of two weeks; rows years behind it come in by the repair."""
    out = scratch_path(spark, "weekly")
    parts, dropped = _complaint_parts(spark, sf), []

    def run():
        s = base.file_stream(spark, f"{out}/in", parts[0].schema)
        dropped.append(late.run_repaired_counts(s, 14, out, f"{out}/ck"))

    in_steps(parts, f"{out}/in", run)
    return late.repaired_counts(spark, out).withColumn("dropped", F.lit(sum(dropped)).cast("long"))


@query("stream_late_rows", f"""WITH {COMPLAINTS_SQL}, w AS (SELECT cluster_id AS key, date_added, CAST(date_added AS DATE) - CAST(extract(dow FROM date_added) AS INT) AS wk,
  source_id LIKE '1%' AND date_added < TIMESTAMP '1998-06-01' AS held FROM complaints), f AS (SELECT max(date_added) AS newest FROM w WHERE NOT held)
SELECT key, wk, count(*) AS v FROM w, f WHERE held AND CAST(wk + 7 AS TIMESTAMP) <= newest - INTERVAL 14 DAY GROUP BY 1, 2""")
def stream_late_rows(spark, sf):
    """What the repair folds in."""
    out = scratch_path(spark, "late")
    parts = _complaint_parts(spark, sf)

    def run():
        late.route(base.file_stream(spark, f"{out}/in", parts[0].schema), 14, out, f"{out}/ck")

    in_steps(parts, f"{out}/in", run)
    late.fold_late(spark, out, parts[0].schema)
    return base.read_batches(spark, f"{out}/repairs").groupBy("key", "wk").agg(F.sum("v").alias("v"))


def _partials(spark, sf):
    out = scratch_path(spark, "partials")
    parts = _complaint_parts(spark, sf)

    def run():
        s = base.file_stream(spark, f"{out}/in", parts[0].schema)
        windows.weekly_partials(s, f"{out}/counts", f"{out}/ck", alerts=f"{out}/alerts")

    in_steps(parts, f"{out}/in", run)
    return out


@query("stream_weekly_partials", ALL_SQL + " SELECT key, wk, v, i, n FROM series")
def stream_weekly_partials(spark, sf):
    return windows.sum_partials(base.read_batches(spark, _partials(spark, sf) + "/counts"))


@query("stream_alerts", ALL_SQL + f""", cut AS (SELECT * FROM {SPIKE.format(k=4)}
WHERE i >= 4 AND c*q-s*s > 0 AND c*v-s > 0 AND (c*v-s)*(c*v-s) > 9*(c*q-s*s))
SELECT key, wk, v, i, round((c*v-s)/sqrt(c*q-s*s), 6) AS z FROM cut WHERE wk IN
(SELECT wk FROM series s2 WHERE s2.key = cut.key AND EXISTS (SELECT 1 FROM complaints c WHERE c.cluster_id = cut.key AND source_id LIKE '1%'
  AND date_added < TIMESTAMP '1998-06-01'
  AND CAST(date_added AS DATE) - CAST(extract(dow FROM date_added) AS INT) = s2.wk))""")
def stream_alerts(spark, sf):
    """Alerts of the last batch, which repairs the early years with the rows that came late."""
    alerts = base.read_version(spark, _partials(spark, sf) + "/alerts", 2)
    return alerts.select("key", "wk", "v", "i", *r6("z"))


def saved_searches(spark, sf):
    """One for each customer, from a few criteria to many."""
    c, n = table(spark, sf, "customer"), F.col("c_custkey")
    words, types = ["WIDGET", "ring", "Bolt", "gear", "plate"], ["eco", "SMALL", "medium", "promo", "large"]
    pick = lambda names, by: F.element_at(F.array(*[F.lit(x) for x in names]), (by % len(names) + 1).cast("int"))
    return c.select(
        n.cast("string").alias("search_id"), F.concat(F.lit("BRAND#"), (n % 25 + 1).cast("string")).alias("make"), F.when(n % 2 == 0, pick(types, n)).alias("model"),
        F.when(n % 3 == 0, pick(["red ", "small ", "HOT ", "old "], n)).alias("component"), F.when(n % 4 != 0, (1970 + n % 40).cast("int")).alias("year_from"),
        (1975 + n % 40).cast("int").alias("year_to"), (n % 5 == 0).alias("has_crash"), (n % 7 == 0).alias("has_fire"), (n % 11 != 0).alias("has_death"), (n % 3 == 1).alias("has_injury"),
        F.when(n % 2 == 1, pick(words, n)).otherwise("").alias("search"), (n % 13 == 0).alias("paused"))


def pick_sql(names: list[str], by: str) -> str:
    return f"({names!r})[{by} % {len(names)} + 1]"


SEARCHES_SQL = f"""searches AS (SELECT CAST(c_custkey AS VARCHAR) AS search_id, 'brand#' || (c_custkey % 25 + 1) AS s_make,
  CASE WHEN c_custkey % 2 = 0 THEN {pick_sql(["eco", "small", "medium", "promo", "large"], "c_custkey")} ELSE '' END AS s_model,
  CASE WHEN c_custkey % 3 = 0 THEN {pick_sql(["red ", "small ", "hot ", "old "], "c_custkey")} ELSE '' END AS s_component,
  CASE WHEN c_custkey % 4 <> 0 THEN 1970 + c_custkey % 40 ELSE 0 END AS low, 1975 + c_custkey % 40 AS high,
  CASE WHEN c_custkey % 2 = 1 THEN {pick_sql(["widget", "ring", "bolt", "gear", "plate"], "c_custkey")} ELSE '' END AS s_text, c_custkey AS n
  FROM customer WHERE c_custkey % 13 <> 0)"""


@query("stream_search_alerts", f"""WITH {COMPLAINTS_SQL}, {SEARCHES_SQL} SELECT search_id, source_id, date_added FROM complaints JOIN searches
ON contains(lower(make), s_make) AND contains(lower(model), s_model) AND contains(lower(component), s_component) AND model_year BETWEEN low AND high
AND (crash OR n % 5 <> 0) AND (fire OR n % 7 <> 0) AND (deaths > 0 OR n % 11 = 0) AND (injuries > 0 OR n % 3 <> 1)
AND (contains(lower(description), s_text) OR contains(lower(component), s_text))""")
def stream_search_alerts(spark, sf):
    out, cut = scratch_path(spark, "searches"), F.expr("timestamp_ntz'1998-06-01'")
    rows = complaints(spark, sf).drop("order_id", "supplier_id", "cluster_id")

    def run():
        s = base.file_stream(spark, f"{out}/in", rows.schema)
        windows.stream_search_alerts(s, lambda session: saved_searches(session, sf), f"{out}/alerts", f"{out}/ck", ["source_id", "date_added"])

    in_steps([rows.where(F.col("date_added") < cut), rows.where(F.col("date_added") >= cut)], f"{out}/in", run)
    return base.read_batches(spark, f"{out}/alerts").select("search_id", "source_id", "date_added")


@query("stream_alert_digests", f"""WITH {COMPLAINTS_SQL}, a AS (SELECT CAST(supplier_id % 4 AS VARCHAR) AS search_id, supplier_id % 2 = 0 AS daily, date_added FROM complaints),
p AS (SELECT *, CAST(date_added AS DATE) - CASE WHEN daily THEN 0 ELSE CAST(extract(dow FROM date_added) AS INT) END AS period_start FROM a)
SELECT search_id, period_start, min(date_added) AS first_at, max(date_added) AS last_at, count(*) AS n FROM p GROUP BY search_id, daily, period_start
HAVING CAST(period_start + CASE WHEN daily THEN 1 ELSE 7 END AS TIMESTAMP) <= (SELECT max(date_added) FROM a) - INTERVAL 36 HOUR""")
def stream_alert_digests(spark, sf):
    """Daily and weekly digests of alerts that are raised when their complaint comes in."""
    windows.use_rocks(spark)
    out, cut, supplier = scratch_path(spark, "digests"), F.expr("timestamp_ntz'1998-06-01'"), F.col("supplier_id")
    raised = complaints(spark, sf).select((supplier % 4).cast("string").alias("search_id"), F.when(supplier % 2 == 0, "daily").otherwise("weekly").alias("frequency"), F.col("date_added").alias("happened_at"))

    def run():
        digests.run_digests(base.file_stream(spark, f"{out}/in", raised.schema), out, f"{out}/ck", "36 hours")

    in_steps([raised.where(F.col("happened_at") < cut), raised.where(F.col("happened_at") >= cut)], f"{out}/in", run)
    return base.read_batches(spark, f"{out}/digests").select("search_id", "period_start", "first_at", "last_at", "n")


@query("stream_subscription_state", f"WITH {BILLING_SQL} SELECT * FROM subscriptions")
def stream_subscription_state(spark, sf):
    out = scratch_path(spark, "billing")

    def run():
        s = base.file_stream(spark, f"{out}/in", EVENTS)
        tables.append(state.stream_subscription_buckets(billing_columns(s), f"{out}/state", f"{out}/ck", 8))

    tables = []
    in_steps(event_parts(table(spark, sf, "events")), f"{out}/in", run)
    return tables[-1].read(tables[-1].newest())


@query("stream_assign", f"""WITH {CENTROIDS}, scored AS (SELECT e.vec_id, c.label, {cos('e.embedding', 'c.c')} AS s FROM embeddings e, centroids c),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM scored)
SELECT vec_id, CASE WHEN s >= 0.2 THEN label END AS cluster_id, CASE WHEN s >= 0.2 THEN round(s, 6) END AS similarity FROM best WHERE k = 1""")
def stream_assign(spark, sf):
    out = scratch_path(spark, "assign")
    rows = vecs(spark, sf).select("vec_id", "embedding")

    def centroids(session):
        return vectors.pattern_centroids(vecs(session, sf).withColumnRenamed("label", "cluster_id"), id_col="vec_id")

    def run():
        s = base.file_stream(spark, f"{out}/in", rows.schema)
        state.stream_assign(s, centroids, f"{out}/rows", f"{out}/ck", 0.2, id_col="vec_id")

    in_steps([rows.where("vec_id < 200"), rows.where("vec_id >= 200")], f"{out}/in", run)
    return base.read_batches(spark, f"{out}/rows").select("vec_id", "cluster_id", *r6("similarity"))


def _windows(spark, sf, make):
    out = scratch_path(spark, "windows")

    def run():
        s = base.file_stream(spark, f"{out}/in", EVENTS)
        base.run_available(make(s), lambda b, n: base.write_batch(b, f"{out}/counts", n), f"{out}/ck", "update")

    in_steps(event_parts(table(spark, sf, "events")), f"{out}/in", run)
    return base.read_batches(spark, f"{out}/counts")


@query("stream_audit_windows", """SELECT window_start, user_id, count(*) AS events FROM
(SELECT user_id, date_trunc('hour', ts) - to_hours(CAST(unnest(range(24)) AS INT)) AS window_start FROM events WHERE event_type = 'error')
GROUP BY 1, 2 HAVING count(*) > 2""")
def stream_audit_windows(spark, sf):
    found = _windows(spark, sf, lambda s: windows.stream_audit_windows(
        s.where("event_type = 'error'"), "2 days", keys=["user_id"], limit=2))
    return windows.latest_updates(found, ["window_start", "user_id"], ["events"])


@query("stream_rate_limits", """SELECT window_start, event_type, count(*) AS events FROM
(SELECT event_type, date_trunc('minute', ts) AS window_start FROM events) GROUP BY 1, 2 HAVING count(*) > 1""")
def stream_rate_limits(spark, sf):
    found = _windows(spark, sf, lambda s: windows.stream_audit_windows(
        s, "2 days", size="1 minute", slide=None, keys=["event_type"], limit=1))
    return windows.latest_updates(found, ["window_start", "event_type"], ["events"])


@query("stream_threshold_alerts", """SELECT event_type, count(*) // 500 AS crossed FROM events GROUP BY 1 HAVING count(*) >= 500""")
def stream_threshold_alerts(spark, sf):
    windows.use_rocks(spark)
    found = _windows(spark, sf, lambda s: windows.stream_threshold_alerts(s, "event_type", 500))
    return found.groupBy("event_type").agg(F.sum("crossed").alias("crossed"))


@query("stream_upsert_dimension", ORACLES["upsert_users"])
def stream_upsert_dimension(spark, sf):
    out = scratch_path(spark, "users")
    events = identity_events(spark, sf)

    def run():
        s = base.file_stream(spark, f"{out}/in", events.schema)
        tables.append(state.stream_user_buckets(s, users(spark, sf), orgs(spark, sf), f"{out}/users", f"{out}/ck", 8))

    tables = []
    in_steps(event_parts(events), f"{out}/in", run)
    return tables[-1].read(tables[-1].newest())

