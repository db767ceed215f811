"""Cleaning jobs, quality reports, feed readers, batch ingestion and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from outcry.functions import codes, fields, text
from outcry.functions.fields import BLANK
from outcry.operators import clean, quality
from outcry.plans.feeds_raw import RAW_API_SQL, RAW_BULK_SQL, land
from outcry.plans.registry import query
from outcry.plans.tenants import AUDIT_SQL, DOCUMENTS_SQL, K_SQL, audit, documents, k_value
from outcry.plans.views import AS_OF, COMPLAINTS_SQL, complaints, table
from outcry.session import scratch_path
from outcry.sources import readers, sync, writers


def norm_sql(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{BLANK}+', ' ', 'g'))"


def int0_sql(c: str) -> str:
    return f"coalesce(TRY_CAST(regexp_extract({c}, '^\\s*([+-]?[0-9]+)', 1) AS INT), 0)"


def date_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^[0-9]{{8}}$') THEN try_strptime({c}, '%Y%m%d') END"


def yn_sql(c: str) -> str:
    return f"coalesce(upper(regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')) IN ('Y', 'YES'), FALSE)"


def component_sql(c: str) -> str:
    return f"coalesce(nullif({norm_sql(f'split_part({c}, chr(58), 1)')}, ''), 'UNKNOWN')"


def bulk_columns(date: str) -> str:
    return f"""cmplid AS source_id, coalesce(odino, '') AS odi_number, {norm_sql('mfr_name')} AS manufacturer,
upper({norm_sql('maketxt')}) AS make, {norm_sql('modeltxt')} AS model, {int0_sql('yeartxt')} AS model_year,
{component_sql('compdesc')} AS component, {norm_sql('cdescr')} AS description, {yn_sql('crash')} AS crash,
{yn_sql('fire')} AS fire, {int0_sql('injured')} AS injuries, {int0_sql('deaths')} AS deaths,
{date_sql('faildate')} AS fail_date, {date} AS date_added"""


CLEAN_SQL = f"{RAW_BULK_SQL}, clean AS (SELECT * FROM (SELECT {bulk_columns(date_sql('datea'))} FROM raw_bulk) " \
            "WHERE date_added IS NOT NULL)"
QUARANTINE_SQL = f"""SELECT cmplid AS source_id, 'Invalid date for complaint ' || cmplid || ': ' || datea AS error
FROM raw_bulk WHERE {date_sql('datea')} IS NULL"""
ORDER = ["date_added", "make", "model", "model_year", "component", "description", "crash", "fire", "injuries", "deaths"]


def landed(spark, sf):
    return readers.read_bulk_complaints(spark, land(spark, sf, "json"))


def arrival():
    return [F.asc(c) for c in ORDER]


@query("clean_bulk", f"WITH {CLEAN_SQL} SELECT * FROM clean")
def clean_bulk(spark, sf):
    return clean.clean_bulk_table(landed(spark, sf))[0]


@query("clean_bulk_quarantine", f"WITH {RAW_BULK_SQL} {QUARANTINE_SQL}")
def clean_bulk_quarantine(spark, sf):
    return clean.clean_bulk_table(landed(spark, sf))[1]


ROLL_SQL = """CASE WHEN regexp_matches(datea, '^[0-9]{8}$') THEN
  CAST(make_date(CAST(substr(datea, 1, 4) AS INT), 1, 1) + to_months(CAST(substr(datea, 5, 2) AS INT) - 1)
       + to_days(CAST(substr(datea, 7, 2) AS INT) - 1) AS TIMESTAMP) END"""


@query("clean_bulk_rollover", f"""WITH {RAW_BULK_SQL} SELECT date_added, count(*) AS complaints
FROM (SELECT {ROLL_SQL} AS date_added FROM raw_bulk) WHERE date_added IS NOT NULL GROUP BY 1""")
def clean_bulk_rollover(spark, sf):
    rows = clean.clean_bulk_table(landed(spark, sf), rollover=True)[0]
    return rows.groupBy("date_added").agg(F.count("*").alias("complaints"))


API_DATE = """CASE WHEN coalesce(nullif(filed, ''), nullif(incident, '')) IS NULL THEN TIMESTAMP '2002-01-01'
  ELSE coalesce(try_strptime(coalesce(nullif(filed, ''), nullif(incident, '')), '%m/%d/%Y'),
                try_strptime(coalesce(nullif(filed, ''), nullif(incident, '')), '%Y-%m-%d')) END"""
API_SQL = f"""{RAW_API_SQL}, api AS (SELECT *, {API_DATE} AS date_added FROM raw_api)"""


@query("clean_api", f"""WITH {API_SQL} SELECT odi AS source_id, upper(make) AS make, model, year AS model_year,
{component_sql('components')} AS component, {norm_sql('summary')} AS description, {yn_sql('crash')} AS crash,
injured AS injuries, 0 AS deaths, try_strptime(nullif(incident, ''), '%Y-%m-%d') AS fail_date, date_added FROM api
WHERE make IS NOT NULL AND date_added IS NOT NULL""")
def clean_api(spark, sf):
    records = readers.read_api_complaints(spark, land(spark, sf, "api"))
    return clean.clean_api_table(records, "2002-01-01")[0].select(
        "source_id", "make", "model", "model_year", "component", "description", "crash", "injuries", "deaths",
        "fail_date", "date_added")


@query("clean_api_quarantine", f"""WITH {API_SQL} SELECT odi AS source_id,
CASE WHEN make IS NULL THEN 'No product info for complaint ' ELSE 'Invalid date for complaint ' END || odi AS error FROM api
WHERE make IS NULL OR date_added IS NULL""")
def clean_api_quarantine(spark, sf):
    records = readers.read_api_complaints(spark, land(spark, sf, "api"))
    return clean.clean_api_table(records, "2002-01-01")[1]




@query("validate_complaint", f"""WITH {CLEAN_SQL} SELECT source_id, 'Invalid year: ' || model_year AS errors FROM clean
WHERE model_year < 1900 OR model_year > 2100""")
def validate_complaint(spark, sf):
    checked = quality.validate_complaint(clean.clean_bulk_table(landed(spark, sf))[0])
    return checked.where(F.size("errors") > 0).select("source_id", F.concat_ws(";", "errors").alias("errors"))


@query("quality_report", f"""WITH {CLEAN_SQL}, bad AS (SELECT source_id FROM clean WHERE model_year < 1900 OR model_year > 2100)
SELECT 'year' AS rule, (SELECT count(*) FROM bad) AS violations, string_agg(source_id, ',' ORDER BY source_id) AS sample_keys
FROM (SELECT DISTINCT source_id FROM bad ORDER BY 1 LIMIT 5)""")
def quality_report(spark, sf):
    report = quality.quality_report(clean.clean_bulk_table(landed(spark, sf))[0])
    return report.withColumn("sample_keys", F.concat_ws(",", "sample_keys"))


@query("offending_keys", f"""WITH {CLEAN_SQL} SELECT 'year' AS rule, source_id AS key, count(*) AS copies FROM clean
WHERE model_year < 1900 OR model_year > 2100 GROUP BY 2""")
def offending_keys(spark, sf):
    return quality.offending_keys(clean.clean_bulk_table(landed(spark, sf))[0])


@query("parse_fields", f"""WITH {RAW_BULK_SQL} SELECT datea, yeartxt, injured, crash, compdesc, {date_sql('datea')} AS day, {ROLL_SQL} AS rolled_day,
{int0_sql('yeartxt')} AS year, {int0_sql('injured')} AS injuries, {yn_sql('crash')} AS crashed, {component_sql('compdesc')} AS component, count(*) AS records
FROM raw_bulk GROUP BY ALL""")
def parse_fields(spark, sf):
    """The single field parsers side by side over every distinct raw value."""
    raw = landed(spark, sf).groupBy("datea", "yeartxt", "injured", "crash", "compdesc").agg(F.count("*").alias("records"))
    return raw.select(
        "datea", "yeartxt", "injured", "crash", "compdesc", fields.parse_yyyymmdd(F.col("datea")).alias("day"),
        fields.parse_yyyymmdd(F.col("datea"), rollover=True).alias("rolled_day"), fields.parse_int0(F.col("yeartxt")).alias("year"),
        fields.parse_int0(F.col("injured")).alias("injuries"), fields.parse_yn(F.col("crash")).alias("crashed"),
        fields.primary_component(F.col("compdesc")).alias("component"), "records")


SEVERITY_SQL = """least(200, 10 + CASE WHEN crash THEN 30 ELSE 0 END + CASE WHEN fire THEN 40 ELSE 0 END
 + CASE WHEN injuries > 0 THEN 20 + least(injuries*10, 50) ELSE 0 END
 + CASE WHEN deaths > 0 THEN 50 + least(deaths*25, 100) ELSE 0 END)"""


@query("complaint_severity", f"WITH {COMPLAINTS_SQL} SELECT {SEVERITY_SQL} AS severity, count(*) AS complaints FROM complaints GROUP BY 1")
def complaint_severity(spark, sf):
    return clean.severity_scores(complaints(spark, sf)).groupBy("severity").agg(F.count("*").alias("complaints"))


@query("severity_profile", f"""WITH {COMPLAINTS_SQL}, s AS (SELECT make, {SEVERITY_SQL} AS severity FROM complaints)
SELECT make, CASE WHEN severity >= 140 THEN 'high' WHEN severity >= 80 THEN 'medium' ELSE 'low' END AS band,
CASE WHEN severity >= 160 THEN 'critical' WHEN severity >= 100 THEN 'high' WHEN severity >= 60 THEN 'medium' ELSE 'low' END AS band_fine,
count(*) AS complaints, min(severity) AS lowest, max(severity) AS highest FROM s GROUP BY 1, 2, 3""")
def severity_profile(spark, sf):
    return clean.severity_profile(complaints(spark, sf))


@query("normalize_text", f"SELECT doc_id, md5({norm_sql('text')}) AS digest FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(fields.normalize_text(F.col("text"))).alias("digest"))


@query("embedding_input", f"""WITH p AS (SELECT doc_id, regexp_replace({norm_sql('text')}, '[^\\x20-\\x7E]', '', 'g') AS t FROM documents)
SELECT doc_id, t AS text,
       CASE WHEN t = '' THEN 'Text cannot be empty' END AS error FROM p""")
def embedding_input(spark, sf):
    return clean.embedding_input(table(spark, sf, "documents"), "doc_id", F.col("text"))


@query("embedding_text", f"""WITH {COMPLAINTS_SQL} SELECT source_id, md5('Vehicle: ' || model_year || ' ' || make || ' ' || model || chr(10)
|| 'Component: ' || component || chr(10) || 'Issue: ' || description) AS digest FROM complaints""")
def embedding_text(spark, sf):
    return complaints(spark, sf).select("source_id", F.md5(fields.embedding_text()).alias("digest"))


def lines_sql(c: str) -> str:
    return f"list_transform(string_split({c}, chr(10)), lambda x: regexp_replace(x, '^{BLANK}+|{BLANK}+$', '', 'g'))"


@query("extract_numbered_lines", f"""SELECT doc_id, array_to_string(list_transform(list_filter({lines_sql('text')},
  lambda x: regexp_matches(x, '^[0-9]+\\.|^[A-Z]') AND length(x) > 20), lambda x: regexp_replace(x, '^[0-9]+\\.\\s*', '')), '|') AS allegations
FROM documents""")
def extract_numbered_lines(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.concat_ws("|", text.numbered_allegations(F.col("text"))).alias("allegations"))


@query("extract_relief_items", f"""SELECT page_id, array_to_string(list_transform(list_filter({lines_sql("regexp_replace(html, '<[^>]*>', chr(10), 'g')")},
  lambda x: regexp_matches(x, '^[0-9]+\\.|^[a-z]\\)|^•') AND length(x) > 10), lambda x: regexp_replace(x, '^[0-9]+\\.\\s*|^[a-z]\\)\\s*|^•\\s*', '')), '|') AS items
FROM pages""")
def extract_relief_items(spark, sf):
    plain = F.regexp_replace("html", "<[^>]*>", "\n")
    return table(spark, sf, "pages").select("page_id", F.concat_ws("|", text.relief_items(plain)).alias("items"))


def regex_chain(c: str, patterns) -> str:
    for p in patterns:
        p = p.replace("'", "''")
        c = f"regexp_replace({c}, '{p}', '', 'g')"
    return c


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


HTML_SQL = regex_chain("html", (text.SCRIPT_BLOCK, text.SCRIPT_BROKEN, text.EVENT_HANDLER, text.SCRIPT_URL, text.SCRIPT_WORD))


@query("sanitize_html", f"SELECT page_id, md5({HTML_SQL}) AS digest, {HTML_SQL} <> html AS changed FROM pages")
def sanitize_html(spark, sf):
    out = clean.sanitize_table(table(spark, sf, "pages"), html=["html"])
    return out.select("page_id", F.md5("html").alias("digest"), F.col("changed_html").alias("changed"))


STRING_SQL = trim_sql(f"nfc_normalize({regex_chain('text', (text.CONTROL_CHARS,))})")


@query("sanitize_string", f"SELECT doc_id, md5({STRING_SQL}) AS digest, {STRING_SQL} <> text AS changed FROM documents")
def sanitize_string(spark, sf):
    out = clean.sanitize_table(table(spark, sf, "documents").select("doc_id", "text"), plain=["text"])
    return out.select("doc_id", F.md5("text").alias("digest"), F.col("changed_text").alias("changed"))


SEARCH_SQL = trim_sql("substr(" + regex_chain("url", (r"""[<>;"'(){}\[\]\\]""", "--", r"/\*", r"\*/")) + ", 1, 500)")
FILE_SQL = regex_chain("url", (r"\x00", r"\.\.", r"[/\\]", r"^\.+|\.+$", r"[^a-zA-Z0-9._-]"))


@query("sanitize_table", f"""SELECT page_id, {SEARCH_SQL} AS search, {FILE_SQL} AS filename, {SEARCH_SQL} <> url AS changed_search,
{FILE_SQL} <> url AS changed_filename FROM pages""")
def sanitize_table(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("search"), F.col("url").alias("filename"))
    return clean.sanitize_table(pages, search=["search"], filename=["filename"])


ESCAPE_SQL = "html"
for _c, _e in text.ENTITIES.items():
    ESCAPE_SQL = f"replace({ESCAPE_SQL}, '{_c.replace(chr(39), chr(39) * 2)}', '{_e}')"


@query("escape_html", f"SELECT page_id, md5({ESCAPE_SQL}) AS digest FROM pages")
def escape_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.escape_html(F.col("html"))).alias("digest"))


@query("sanitize_struct", f"""SELECT conv_id, turn, role, {trim_sql(f"nfc_normalize({regex_chain('text', (text.CONTROL_CHARS,))})")} AS body
FROM conversations""")
def sanitize_struct(spark, sf):
    nested = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.struct("role", F.struct(F.col("text").alias("body")).alias("inner")).alias("message"))
    out = clean.sanitize_table(nested, nested=["message"])
    return out.select("conv_id", "turn", "message.role", "message.inner.body")


@query("validate_format", " UNION ALL ".join(
    f"SELECT '{k}' AS kind, count(*) FILTER (regexp_matches(url, '{p}')) AS valid, "
    f"count(*) FILTER (NOT regexp_matches(url, '{p}')) AS invalid FROM pages" for k, p in text.FORMATS.items()))
def validate_format(spark, sf):
    return quality.validate_format(table(spark, sf, "pages"), "url")


PII_SQL = {k: p.replace("'", "''") for k, p in text.PII.items()}


@query("detect_pii", "SELECT source, lang, " + ", ".join(
    f"CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS {k}, count(*) FILTER (regexp_matches(text, '{p}')) AS rows_{k}"
    for k, p in PII_SQL.items()) + " FROM documents GROUP BY 1, 2")
def detect_pii(spark, sf):
    return clean.pii_report(table(spark, sf, "documents"), "text", ["source", "lang"])


REDACT_SQL = "text"
for _k in ("ssn", "card", "phone", "email"):
    REDACT_SQL = f"regexp_replace({REDACT_SQL}, '{PII_SQL[_k]}', '[REDACTED]', 'g')"


@query("redact_table", f"""SELECT doc_id, md5({REDACT_SQL}) AS digest, len(regexp_extract_all(text, '{PII_SQL["email"]}')) AS found_email
FROM documents""")
def redact_table(spark, sf):
    out = clean.redact_table(table(spark, sf, "documents"), text_cols=["text"])
    return out.select("doc_id", F.md5("text").alias("digest"), "found_email")


@query("redact_sensitive", f"""SELECT event_id, '[REDACTED]' AS session, event_type AS kind, CAST({K_SQL} AS VARCHAR) AS k FROM events""")
def redact_sensitive(spark, sf):
    meta = F.create_map(F.lit("sessionTokenId"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"),
                        F.lit("k"), k_value().cast("string"))
    out = clean.redact_table(table(spark, sf, "events").select("event_id", meta.alias("meta")), map_cols=["meta"])
    return out.select("event_id", F.col("meta")["sessionTokenId"].alias("session"), F.col("meta")["kind"].alias("kind"),
                      F.col("meta")["k"].alias("k"))


VERB_SQL = "CASE action " + " ".join(f"WHEN '{a}' THEN '{v}'" for a, v in codes.ACTION_VERBS.items()) + " ELSE lower(action) END"


@query("audit_timeline", f"""WITH {AUDIT_SQL} SELECT organization_id, created_at, id, 'User ' || user_id || ' ' || {VERB_SQL} ||
CASE WHEN action IN ('LOGIN', 'LOGOUT', 'LOGIN_FAILED') THEN '' ELSE ' ' || resource ||
  CASE WHEN coalesce(resource_id, '') <> '' THEN ' (' || resource_id || ')' ELSE '' END END
|| ' at ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS line FROM audit""")
def audit_timeline(spark, sf):
    return clean.audit_timeline(audit(spark, sf))


def case_map(c: str, table_: dict, default: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{v}'" for a, v in table_.items()) + f" ELSE '{default}' END"


CODE_INPUT = f"""SELECT event_id, CASE WHEN {K_SQL} < 20 THEN 'active' WHEN {K_SQL} < 40 THEN 'unpaid' WHEN {K_SQL} < 60 THEN 'paused'
  WHEN {K_SQL} < 80 THEN 'incomplete_expired' ELSE 'other' END AS status,
 CASE WHEN {K_SQL} < 30 THEN 'price_basic_yearly' WHEN {K_SQL} < 50 THEN 'my_pro_price' WHEN {K_SQL} < 70 THEN 'enterprise-x' ELSE 'gold' END AS price,
 CASE WHEN {K_SQL} < 30 THEN 'org:admin' WHEN {K_SQL} < 60 THEN 'org:analyst' WHEN {K_SQL} < 90 THEN 'org:member' ELSE 'guest' END AS role FROM events"""


@query("conform_codes", f"""SELECT event_id, {case_map('status', codes.SUBSCRIPTION_STATUS, 'INACTIVE')} AS status,
CASE WHEN price = 'price_basic_yearly' THEN 'BASIC' WHEN contains(price, 'basic') THEN 'BASIC' WHEN contains(price, 'pro') THEN 'PRO'
     WHEN contains(price, 'enterprise') THEN 'ENTERPRISE' ELSE 'FREE' END AS price,
{case_map('role', codes.ORG_ROLE, 'VIEWER')} AS role, status = 'other' AS unmapped_status, price = 'gold' AS unmapped_price,
role = 'guest' AS unmapped_role FROM ({CODE_INPUT})""")
def conform_codes(spark, sf):
    k = F.col("k")
    rows = table(spark, sf, "events").select("event_id", k_value().alias("k")).select(
        "event_id",
        F.when(k < 20, "active").when(k < 40, "unpaid").when(k < 60, "paused").when(k < 80, "incomplete_expired")
        .otherwise("other").alias("status"),
        F.when(k < 30, "price_basic_yearly").when(k < 50, "my_pro_price").when(k < 70, "enterprise-x").otherwise("gold")
        .alias("price"),
        F.when(k < 30, "org:admin").when(k < 60, "org:analyst").when(k < 90, "org:member").otherwise("guest").alias("role"))
    return clean.conform_codes(rows, {"status": "status", "price": "price", "role": "role"})


# ---- feed readers -------------------------------------------------------------------------------------------------

R = f"WITH {RAW_BULK_SQL} "


@query("read_bulk_complaints", R + """SELECT cmplid, maketxt, datea FROM raw_bulk WHERE maketxt = 'brand#9 ' AND datea >= '2000'
ORDER BY datea DESC, cmplid LIMIT 500""")
def read_bulk_complaints(spark, sf):
    return readers.read_bulk_complaints(
        spark, land(spark, sf, "json"), select=["cmplid", "maketxt", "datea"],
        where=(F.col("maketxt") == "brand#9 ") & (F.col("datea") >= "2000"), order=[F.desc("datea"), F.asc("cmplid")], limit=500)


@query("read_api_complaints", f"""WITH {RAW_API_SQL} SELECT odi AS "odiNumber", filed AS "dateComplaintFiled", lower(make) AS make,
CASE WHEN make IS NOT NULL THEN year END AS year FROM raw_api""")
def read_api_complaints(spark, sf):
    records = readers.read_api_complaints(spark, land(spark, sf, "api"))
    product = F.get("products", F.lit(0))
    return records.select("odiNumber", "dateComplaintFiled", product["make"].alias("make"), product["year"].alias("year"))


@query("read_all_pages", R + "SELECT state, city, count(*) AS records FROM raw_bulk GROUP BY 1, 2")
def read_all_pages(spark, sf):
    pages = readers.read_all_pages(spark, land(spark, sf, "pages"))
    city = F.regexp_extract("page_file", "city=([^/]+)/", 1)
    return pages.groupBy("state", city.alias("city")).agg(F.count("*").alias("records"))


@query("read_flat_file", R + f"""SELECT maketxt, min(cmplid) AS first_id, count(*) AS records, count(fire) AS fires FROM raw_bulk GROUP BY 1""")
def read_flat_file(spark, sf):
    flat = readers.read_flat_file(spark, land(spark, sf, "csv"))
    return flat.where("corrupt_record IS NULL").groupBy("maketxt").agg(
        F.min("cmplid").alias("first_id"), F.count("*").alias("records"), F.count("fire").alias("fires"))


@query("complaints_since", R + "SELECT cmplid, datea FROM raw_bulk WHERE datea > '20010601'")
def complaints_since(spark, sf):
    return readers.complaints_since(landed(spark, sf), "20010601").select("cmplid", "datea")


@query("complaints_in_range", R + """SELECT cmplid, datea FROM raw_bulk WHERE datea >= '20000101' AND datea <= '20000630'""")
def complaints_in_range(spark, sf):
    return readers.complaints_in_range(landed(spark, sf), "20000101", "20000630").select("cmplid", "datea")


@query("complaints_by_make", R + """SELECT cmplid, datea FROM raw_bulk WHERE upper(maketxt) = 'BRAND#11 '""")
def complaints_by_make(spark, sf):
    return readers.complaints_by_make(landed(spark, sf), "Brand#11 ").select("cmplid", "datea")


@query("complaints_by_component", R + """SELECT cmplid, datea FROM raw_bulk WHERE upper(compdesc) LIKE '%BOLT%'""")
def complaints_by_component(spark, sf):
    return readers.complaints_by_component(landed(spark, sf), "bolt").select("cmplid", "datea")


@query("high_severity_raw", R + """SELECT cmplid, datea FROM raw_bulk WHERE crash = 'Y' OR fire = 'Y' OR TRY_CAST(injured AS INT) > 0
OR TRY_CAST(deaths AS INT) > 0""")
def high_severity_raw(spark, sf):
    return readers.high_severity_raw(landed(spark, sf)).select("cmplid", "datea")


@query("count_where", R + "SELECT count(*) AS count FROM raw_bulk WHERE crash = 'Y' AND yeartxt = '9999'")
def count_where(spark, sf):
    return readers.count_where(landed(spark, sf), "crash = 'Y' AND yeartxt = '9999'")


@query("distinct_makes_raw", R + "SELECT DISTINCT maketxt FROM raw_bulk WHERE maketxt <> ''")
def distinct_makes_raw(spark, sf):
    return readers.distinct_makes_raw(landed(spark, sf))


# ---- ingestion ----------------------------------------------------------------------------------------------------

NEW_COLS = ["source_id"] + ORDER
FIRST = f"row_number() OVER (PARTITION BY source_id ORDER BY {', '.join(ORDER)})"
# The target table as an earlier sync left it: the first row of each key.
KNOWN_SQL = f"known AS (SELECT * FROM (SELECT *, {FIRST} AS k FROM clean WHERE date_added <= TIMESTAMP '2001-06-30') WHERE k = 1)"


def new_sql(where: str) -> str:
    return f"""SELECT {', '.join(NEW_COLS)} FROM (SELECT *, {FIRST} AS k FROM clean WHERE {where}) x
WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM known WHERE known.source_id = x.source_id)"""


def known_rows(spark, sf):
    rows = clean.clean_bulk_table(landed(spark, sf))[0]
    old = rows.where(F.col("date_added") <= fields.ntz("2001-06-30"))
    return sync.first_per_key(old, "source_id", arrival())


@query("insert_new", f"WITH {CLEAN_SQL}, {KNOWN_SQL} {new_sql('TRUE')}")
def insert_new(spark, sf):
    rows = clean.clean_bulk_table(landed(spark, sf))[0]
    return sync.insert_new(rows, known_rows(spark, sf), order=arrival()).select(*NEW_COLS)


@query("sync_incremental", f"WITH {CLEAN_SQL}, {KNOWN_SQL} " + new_sql(
    "strftime(date_added, '%Y%m%d') > (SELECT strftime(max(date_added), '%Y%m%d') FROM known)"))
def sync_incremental(spark, sf):
    return sync.sync_incremental(landed(spark, sf), known_rows(spark, sf), AS_OF, arrival())[0].select(*NEW_COLS)


@query("sync_status", f"""WITH {CLEAN_SQL}, {KNOWN_SQL},
mark AS (SELECT max(date_added) AS m FROM known),
fetched AS (SELECT * FROM raw_bulk WHERE datea > (SELECT strftime(m, '%Y%m%d') FROM mark)),
news AS ({new_sql("strftime(date_added, '%Y%m%d') > (SELECT strftime(m, '%Y%m%d') FROM mark)")})
SELECT (SELECT m FROM mark) AS last_sync_date, (SELECT count(*) FROM fetched) AS total_complaints,
(SELECT count(*) FROM news) AS new_complaints, (SELECT count(*) FROM fetched WHERE {date_sql('datea')} IS NULL) AS errors""")
def sync_status(spark, sf):
    return sync.sync_incremental(landed(spark, sf), known_rows(spark, sf), AS_OF, arrival())[2]


@query("backfill_vehicle", f"WITH {CLEAN_SQL}, {KNOWN_SQL} " + new_sql(
    "make = 'BRAND#5' AND lower(model) = 'promo' AND model_year BETWEEN 1980 AND 2010"))
def backfill_vehicle(spark, sf):
    return sync.backfill_vehicle(landed(spark, sf), known_rows(spark, sf), "Brand#5", "PROMO", 1980, 2010, arrival()).select(*NEW_COLS)


HIGH_SQL = f"""WITH {RAW_BULK_SQL}, clean AS (SELECT * FROM (SELECT {bulk_columns(date_sql('datea'))} FROM raw_bulk
 WHERE crash = 'Y' OR fire = 'Y' OR TRY_CAST(injured AS INT) > 0 OR TRY_CAST(deaths AS INT) > 0) WHERE date_added IS NOT NULL),
known AS (SELECT cmplid AS source_id FROM raw_bulk WHERE {date_sql('datea')} <= TIMESTAMP '2001-06-30') """


@query("sync_high_severity", HIGH_SQL + new_sql("TRUE"))
def sync_high_severity(spark, sf):
    return sync.sync_high_severity(landed(spark, sf), known_rows(spark, sf), arrival()).select(*NEW_COLS)


@query("seed_upsert", f"""WITH {CLEAN_SQL}, {KNOWN_SQL}, news AS ({new_sql('TRUE')}),
olds AS (SELECT {', '.join(NEW_COLS)} FROM (SELECT *, {FIRST} AS k FROM clean WHERE date_added <= TIMESTAMP '2001-06-30') WHERE k = 1)
SELECT make, model, count(*) AS complaints, min(date_added) AS first_date FROM (SELECT * FROM olds UNION ALL SELECT * FROM news) GROUP BY 1, 2""")
def seed_upsert(spark, sf):
    rows = clean.clean_bulk_table(landed(spark, sf))[0]
    merged = sync.seed_upsert(rows, known_rows(spark, sf), order=arrival())
    return merged.groupBy("make", "model").agg(F.count("*").alias("complaints"), F.min("date_added").alias("first_date"))


# ---- exports ------------------------------------------------------------------------------------------------------


@query("export_result", f"""WITH {AUDIT_SQL} SELECT organization_id, action, count(*) AS entries FROM audit GROUP BY 1, 2""")
def export_result(spark, sf):
    path = scratch_path(spark, "export")
    log = audit(spark, sf).select("id", "organization_id", "action", "resource", "created_at")
    writers.export_result(log, path, "csv", by="organization_id")
    back = spark.read.schema("id long, action string, resource string, created_at string, organization_id int").option(
        "header", True).csv(path)
    return back.groupBy("organization_id", "action").agg(F.count("*").alias("entries"))


def digest_sql(name: str, rows: str, columns: list[str]) -> str:
    text_ = " || ".join(f"CASE WHEN {c} IS NULL THEN 'n' ELSE length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in columns)
    sql = f"""SELECT h AS p, sha256(h || ':' || count(*)) AS d, count(*) AS c FROM (SELECT sha256({text_}) AS h FROM ({rows})) GROUP BY h"""
    for n in writers.PREFIXES:
        sql = f"SELECT substr(p, 1, {n}) AS p, sha256(string_agg(d, '' ORDER BY p)) AS d, CAST(sum(c) AS BIGINT) AS c FROM ({sql}) GROUP BY substr(p, 1, {n})"
    return f"SELECT '{name}' AS resource, coalesce(max(c), 0) AS records, coalesce(max(d), sha256('')) AS digest FROM ({sql})"


@query("export_with_manifest", f"WITH {DOCUMENTS_SQL}, {AUDIT_SQL} " + digest_sql(
    "documents", "SELECT * FROM documents_made WHERE organization_id = 3 AND created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '2000-01-01'",
    ["document_id", "pattern_id", "title", "status"]) + " UNION ALL " + digest_sql(
    "audit", "SELECT * FROM audit WHERE organization_id = 3", ["id", "user_id", "action", "resource", "resource_id"])
    + " UNION ALL SELECT 'nothing', 0, sha256('')")
def export_with_manifest(spark, sf):
    docs = writers.export_scope(documents(spark, sf), 3, "1996-01-01", "2000-01-01")
    log = writers.export_scope(audit(spark, sf), 3)
    return writers.export_with_manifest({
        "documents": (docs, ["document_id", "pattern_id", "title", "status"]),
        "audit": (log, ["id", "user_id", "action", "resource", "resource_id"]),
        "nothing": (docs.limit(0), ["document_id"])}, scratch_path(spark, "manifest"))
