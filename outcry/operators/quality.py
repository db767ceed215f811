"""Rule checks over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcry.functions.fields import strip_blanks
from outcry.functions.text import FORMATS
from outcry.operators.paging import top_per_group

# Required texts and counts of a case.
CASE_REQUIRED = [
    "courtName", "plaintiffName", "plaintiffState", "plaintiffCity", "vehiclePurchaseDate", "dealerName",
    "defendantName", "defendantStateOfIncorp", "defendantHQ", "vehicleMake", "vehicleModel", "defectComponent",
    "defectDescription", "failureMode", "consequences", "classDefinition", "estimatedClassSize", "firmName",
    "attorneyName", "barNumber", "firmAddress", "firmPhone", "firmEmail",
]
CASE_COUNTS = ["totalComplaints", "crashComplaints", "fireComplaints", "injuryCount", "deathCount"]


def missing(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def complaint_rules() -> dict[str, tuple[Column, Column]]:
    """Rule name -> (violated, message)."""
    year = F.col("model_year")
    return {
        "source_id": (missing("source_id"), F.lit("Missing source_id")),
        "make": (missing("make"), F.lit("Missing make")),
        "model": (missing("model"), F.lit("Missing model")),
        "year": (F.coalesce((year < 1900) | (year > 2100), F.lit(True)),
                 F.concat(F.lit("Invalid year: "), F.coalesce(year.cast("string"), F.lit("null")))),
        "component": (missing("component"), F.lit("Missing component")),
        "description": (missing("description"), F.lit("Missing description")),
        "date_added": (F.col("date_added").isNull(), F.lit("Missing date_added")),
    }


def messages(rules: dict[str, tuple[Column, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, text) for bad, text in rules.values()]))


def validate_complaint(complaints: DataFrame) -> DataFrame:
    return complaints.withColumn("errors", messages(complaint_rules()))


def offending_keys(complaints: DataFrame, key: str = "source_id") -> DataFrame:
    """Every key that breaks a rule (rule, key, copies). Copies of a bad row are one row."""
    rules = complaint_rules()
    broken = (
        complaints.select(F.col(key).alias("key"),
                          F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, (bad, _) in rules.items()]))
                          .alias("rules"))
        .where(F.size("rules") > 0)
        .select("key", F.explode("rules").alias("rule"))
    )
    return broken.groupBy("rule", "key").agg(F.count("*").alias("copies"))


def quality_report(complaints: DataFrame, samples: int = 5, key: str = "source_id") -> DataFrame:
    """Violations per rule with the smallest offending keys as a sample; ``offending_keys`` has them all."""
    per_key = offending_keys(complaints, key)
    counts = per_key.groupBy("rule").agg(F.sum("copies").alias("violations"))
    first = (top_per_group(per_key, "rule", [F.asc("key")], samples)
             .groupBy("rule").agg(F.array_sort(F.collect_list("key")).alias("sample_keys")))
    return counts.join(first, "rule")


def validate_format(df: DataFrame, column: str, kinds: list[str] | None = None) -> DataFrame:
    """Valid and invalid values per format, long form, one pass."""
    kinds = kinds or list(FORMATS)
    flags = [F.count_if(F.coalesce(F.col(column).rlike(FORMATS[k]), F.lit(False))).alias(k) for k in kinds]
    wide = df.agg(F.count("*").alias("total"), *flags)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("valid")) for k in kinds]))
    return wide.select("total", pairs.alias("p")).select("p.kind", "p.valid", (F.col("total") - F.col("p.valid")).alias("invalid"))


def validate_case(cases: DataFrame) -> DataFrame:
    """Checks a case: required texts, year order, non-negative counts, at least one claim and one relief."""
    rules = {c: (strip_blanks(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(f"{c} is required")) for c in CASE_REQUIRED}
    rules["years"] = (F.coalesce(F.col("vehicleYearStart") > F.col("vehicleYearEnd"), F.lit(False)),
                      F.lit("vehicleYearStart must be before or equal to vehicleYearEnd"))
    rules.update({c: (F.coalesce(F.col(c) < 0, F.lit(False)), F.lit(f"{c} must be non-negative")) for c in CASE_COUNTS})
    rules["claims"] = (F.coalesce(F.size("causesOfAction"), F.lit(0)) <= 0, F.lit("At least one cause of action is required"))
    rules["relief"] = (F.coalesce(F.size("reliefRequested"), F.lit(0)) <= 0,
                       F.lit("At least one type of relief must be requested"))
    return cases.withColumn("errors", messages(rules)).withColumn("is_valid", F.size("errors") == 0)


def embedding_quality(vectors: DataFrame, dims: int, vec: str = "embedding", low: float = 0.9, high: float = 1.1) -> DataFrame:
    """Width, length and emptiness of vectors in one row."""
    from outcry.functions.vectors import norm

    measured = vectors.select(F.col(vec).isNull().alias("absent"), F.size(vec).alias("width"), norm(F.col(vec)).alias("length"))
    return measured.agg(
        F.count("*").alias("total"),
        F.count_if("absent").alias("null_vectors"),
        F.count_if(~F.col("absent") & (F.col("width") != dims)).alias("wrong_dimension"),
        F.count_if(F.col("length") == 0).alias("zero_vectors"),
        F.count_if((F.col("length") < low) | (F.col("length") > high)).alias("norm_out_of_range"),
    )
