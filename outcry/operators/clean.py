"""Cleaning jobs: a raw table in, clean rows and rejected rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcry.functions import codes, fields, text

# ---- raw feeds ----------------------------------------------------------------------------------------------------


def check_bulk(raw: DataFrame, rollover: bool = False) -> DataFrame:
    """Flat feed to complaint columns plus ``error``, which is null on good rows."""
    c = F.col
    added = fields.parse_yyyymmdd(c("datea"), rollover)
    message = F.concat(F.lit("Invalid date for complaint "), F.coalesce("cmplid", F.lit("")), F.lit(": "),
                       F.coalesce("datea", F.lit("")))
    return raw.select(
        c("cmplid").alias("source_id"),
        F.coalesce("odino", F.lit("")).alias("odi_number"),
        fields.normalize_text(c("mfr_name")).alias("manufacturer"),
        F.upper(fields.normalize_text(c("maketxt"))).alias("make"),
        fields.normalize_text(c("modeltxt")).alias("model"),
        fields.parse_int0(c("yeartxt")).alias("model_year"),
        fields.primary_component(c("compdesc")).alias("component"),
        fields.normalize_text(c("cdescr")).alias("description"),
        fields.parse_yn(c("crash")).alias("crash"),
        fields.parse_yn(c("fire")).alias("fire"),
        fields.parse_int0(c("injured")).alias("injuries"),
        fields.parse_int0(c("deaths")).alias("deaths"),
        fields.parse_yyyymmdd(c("faildate"), rollover).alias("fail_date"),
        added.alias("date_added"),
        F.when(added.isNull(), message).alias("error"),
    )


def parse_feed_date(c: Column) -> Column:
    """ISO or month/day/year text to a timestamp, null when neither."""
    us = F.try_to_date(F.when(c.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), c), "M/d/yyyy")
    iso = F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), c).try_cast("timestamp_ntz")
    return F.coalesce(us.cast("timestamp_ntz"), iso)


def check_api(records: DataFrame, as_of) -> DataFrame:
    """Nested feed (one record per row) to complaint columns plus ``error``.

    The date is the filing date, else the incident date, else ``as_of``; a given but unreadable date rejects the row.
    """
    c = F.col
    product = F.get("products", F.lit(0))
    stamp = F.coalesce(F.nullif("dateComplaintFiled", F.lit("")), F.nullif("dateOfIncident", F.lit("")))
    added = F.when(stamp.isNull(), fields.ntz(as_of)).otherwise(parse_feed_date(stamp))
    number = F.coalesce("odiNumber", F.lit(""))
    error = F.when(product.isNull(), F.concat(F.lit("No product info for complaint "), number)) \
        .when(added.isNull(), F.concat(F.lit("Invalid date for complaint "), number))
    return records.select(
        c("odiNumber").alias("source_id"),
        c("odiNumber").alias("odi_number"),
        fields.normalize_text(c("manufacturer")).alias("manufacturer"),
        F.upper(fields.normalize_text(product["make"])).alias("make"),
        fields.normalize_text(product["model"]).alias("model"),
        product["year"].alias("model_year"),
        fields.primary_component(c("components")).alias("component"),
        fields.normalize_text(c("summary")).alias("description"),
        fields.parse_yn(c("crash")).alias("crash"),
        fields.parse_yn(c("fire")).alias("fire"),
        F.coalesce("numberOfInjured", F.lit(0)).alias("injuries"),
        F.coalesce("numberOfDeaths", F.lit(0)).alias("deaths"),
        parse_feed_date(c("dateOfIncident")).alias("fail_date"),
        added.alias("date_added"),
        error.alias("error"),
    )


def good(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("error").isNull()).drop("error")


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("error").isNotNull()).select("source_id", "error")


def clean_bulk_table(raw: DataFrame, rollover: bool = False) -> tuple[DataFrame, DataFrame]:
    checked = check_bulk(raw, rollover)
    return good(checked), quarantine(checked)


def clean_api_table(records: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    checked = check_api(records, as_of)
    return good(checked), quarantine(checked)


# ---- scores and texts ---------------------------------------------------------------------------------------------


def severity_scores(complaints: DataFrame) -> DataFrame:
    return complaints.withColumn("severity", fields.complaint_severity())


def severity_profile(complaints: DataFrame) -> DataFrame:
    """Complaints per make and score band; the score of 0-200 is read on the 0-10 scale of the bands."""
    scaled = F.col("severity") / 20
    return (severity_scores(complaints)
            .groupBy("make", codes.severity_band(scaled).alias("band"), codes.severity_band_fine(scaled).alias("band_fine"))
            .agg(F.count("*").alias("complaints"), F.min("severity").alias("lowest"), F.max("severity").alias("highest")))


def embedding_input(complaints: DataFrame, key: str = "source_id", text_col: Column | None = None,
                    max_chars: int | None = None) -> DataFrame:
    """Key and prepared text; ``error`` marks rows that have no text left."""
    source = fields.embedding_text() if text_col is None else text_col
    prepared = complaints.select(key, fields.prepare_text(source, max_chars).alias("text"))
    return prepared.withColumn("error", F.when(F.col("text") == "", "Text cannot be empty"))


# ---- sanitising and redaction -------------------------------------------------------------------------------------


def sanitize_table(df: DataFrame, html: list[str] = (), plain: list[str] = (), search: list[str] = (),
                   filename: list[str] = (), nested: list[str] = ()) -> DataFrame:
    """Clean the named columns and add ``changed_<column>``."""
    jobs = [(c, text.sanitize_html(F.col(c))) for c in html]
    jobs += [(c, text.sanitize_string(F.col(c))) for c in plain]
    jobs += [(c, text.sanitize_search(F.col(c))) for c in search]
    jobs += [(c, text.sanitize_filename(F.col(c))) for c in filename]
    jobs += [(c, text.sanitize_struct(F.col(c), df.schema[c].dataType)) for c in nested]
    out = df
    for name, cleaned in jobs:
        out = out.withColumn("clean_", cleaned)
        if not isinstance(df.schema[name].dataType, (T.StructType, T.ArrayType)):
            out = out.withColumn(f"changed_{name}", ~F.col("clean_").eqNullSafe(F.col(name)))
        out = out.withColumn(name, F.col("clean_")).drop("clean_")
    return out


def redact_table(df: DataFrame, text_cols: list[str] = (), map_cols: list[str] = (),
                 nested: list[str] = ()) -> DataFrame:
    """Blank personal data in texts and sensitive keys in maps and structs; ``found_<kind>`` counts text findings."""
    out = df
    for kind in text.PII:
        counts = [text.pii_counts(F.coalesce(F.col(c), F.lit("")))[kind] for c in text_cols]
        if counts:
            total = counts[0]
            for extra in counts[1:]:
                total = total + extra
            out = out.withColumn(f"found_{kind}", total.cast("long"))
    changes = {c: text.redact_pii(F.col(c)) for c in text_cols}
    changes.update({c: text.redact_map(F.col(c)) for c in map_cols})
    changes.update({c: text.redact_struct(F.col(c), df.schema[c].dataType) for c in nested})
    return out.withColumns(changes)


def pii_report(df: DataFrame, text_col: str, by: list[str]) -> DataFrame:
    """Findings and affected rows per kind, one pass."""
    counts = text.pii_counts(F.coalesce(F.col(text_col), F.lit("")))
    aggregates = []
    for kind, expr in counts.items():
        aggregates += [F.sum(expr).cast("long").alias(kind), F.count_if(expr > 0).alias(f"rows_{kind}")]
    return df.groupBy(*by).agg(*aggregates)


# ---- audit and codes ----------------------------------------------------------------------------------------------


def audit_timeline(events: DataFrame) -> DataFrame:
    """Readable audit lines per tenant."""
    line = codes.audit_line(F.col("user_id").cast("string"), F.col("action"), F.col("resource"), F.col("resource_id"),
                            F.col("created_at"))
    return events.select("organization_id", "created_at", "id", line.alias("line"))


CODE_MAPS = {"status": codes.map_status, "price": codes.map_price, "role": codes.map_role}
KNOWN_CODES = {
    "status": lambda c: c.isin(*codes.SUBSCRIPTION_STATUS),
    "price": lambda c: c.isin(*codes.PRICE_PLAN) | c.rlike("|".join(codes.PRICE_PLAN_WORDS)),
    "role": lambda c: c.isin("org:member", *codes.ORG_ROLE),
}


def conform_codes(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Replace external codes; ``columns`` maps a column to the kind of code it holds. ``unmapped_<column>`` marks
    values that only got the default."""
    changes = {}
    for name, kind in columns.items():
        changes[f"unmapped_{name}"] = ~F.coalesce(KNOWN_CODES[kind](F.col(name)), F.lit(False))
    out = df.withColumns(changes)
    return out.withColumns({name: CODE_MAPS[kind](F.col(name)) for name, kind in columns.items()})
