"""Inputs that once gave a wrong answer behind a matching SQL counterpart."""

from pyspark.sql import functions as F

from outcry.functions import fields, text
from outcry.operators import joins, quality, vectors
from outcry.sources import readers, writers


def apply(spark, fn, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "c string").select(fn(F.col("c"))).collect()]


def test_blanks_of_every_kind_count_in_flags(spark):
    assert apply(spark, fields.parse_yn, ["Y\t", " yes\n", "　y", "n\t", "", None]) == [True, True, True, False, False, False]


def test_required_texts_of_blanks_only_are_missing(spark):
    row = {c: "x" for c in quality.CASE_REQUIRED} | {"vehicleMake": " \t"}
    row |= {c: 1 for c in quality.CASE_COUNTS} | {"vehicleYearStart": 1, "vehicleYearEnd": 2, "causesOfAction": ["a"], "reliefRequested": ["b"]}
    assert quality.validate_case(spark.createDataFrame([row])).first()["errors"] == ["vehicleMake is required"]


def test_script_patterns_see_every_blank(spark):
    assert apply(spark, text.sanitize_html, ["a javascript :b", "< script x", "<p onclick = 'x'>y"]) == ["a b", " x", "<p>y"]


def test_formats_see_every_blank(spark):
    frame = spark.createDataFrame([("a@b.c",), ("a b@c.d",), ("http://x.y/ z",), ("http://x.y/z",)], "c string")
    got = {r["kind"]: r["valid"] for r in quality.validate_format(frame, "c", ["email", "url"]).collect()}
    assert got == {"email": 1, "url": 1}


def test_nested_texts_are_cleaned_at_any_depth(spark):
    schema = "s struct<a:array<string>,m:map<string,string>,l:array<struct<x:string,n:int>>>"
    frame = spark.createDataFrame([((["é\x01 ", None], {"k": " é\x02"}, [("é ", 1)]),), (None,), ((None, None, None),)], schema)
    got = frame.select(text.sanitize_struct(F.col("s"), frame.schema["s"].dataType).alias("s")).collect()
    assert got[0]["s"].asDict(True) == {"a": ["é", None], "m": {"k": "é"}, "l": [{"x": "é", "n": 1}]}
    assert got[1]["s"] is None and got[2]["s"].asDict() == {"a": None, "m": None, "l": None}


def test_long_texts_stay_whole_when_composed(spark):
    long = "óx " * 5000 + "end"
    assert apply(spark, text.sanitize_string, [long, "plain"]) == ["óx " * 5000 + "end", "plain"]


def test_redaction_plan_has_each_pattern_once(spark):
    frame = spark.createDataFrame([("a",)], "c string").repartition(2).select(text.redact_pii(F.col("c")).alias("r"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 4


def test_digest_tells_nulls_and_borders(spark):
    rows = [("a", None, "x"), ("b", "", "x"), ("c", "p|q", "r"), ("d", "p", "q|r"), ("e", "1:p", "q"), ("f", "1:", "pq")]
    got = writers.integrity_digest(spark.createDataFrame(rows, "g string, u string, v string"), ["g"], ["u", "v"]).collect()
    assert len({r["digest"] for r in got}) == 6


def test_manifest_names_empty_resources(spark):
    frame = spark.createDataFrame([(1,)], "id long")
    got = {r["resource"]: r["records"] for r in writers.export_with_manifest({"one": (frame, ["id"]), "none": (frame.limit(0), ["id"])}).collect()}
    assert got == {"one": 1, "none": 0}


def test_drift_counts_rows_of_one_run(spark):
    old = spark.createDataFrame([(i, [1.0, 0.0], "a") for i in range(10)], "id int, embedding array<double>, cluster_id string")
    new = spark.createDataFrame([(i, [1.0, 0.0], "a") for i in range(5, 12)], "id int, embedding array<double>, cluster_id string")
    got = vectors.embedding_drift(old, new).first()
    assert (got["rows"], got["gone"], got["added"], got["mean_shift"]) == (5, 5, 2, 0.0)
    assert abs(got["moved_share"] - 7 / 12) < 1e-12


def test_no_reader_cuts_by_itself(spark):
    raw = spark.range(1500).select(F.col("id").cast("string").alias("cmplid"), F.lit("20200101").alias("datea"), F.concat(F.lit("m"), "id").alias("maketxt"),
                                   F.lit("bolt").alias("compdesc"), F.lit("Y").alias("crash"), F.lit("").alias("fire"), F.lit("0").alias("injured"), F.lit("0").alias("deaths"))
    assert readers.complaints_since(raw, "20190101").count() == readers.high_severity_raw(raw).count() == readers.distinct_makes_raw(raw).count() == 1500
    assert readers.complaints_by_component(raw, "bolt").count() == 1500 and readers.complaints_by_component(raw, "bolt", limit=7).count() == 7


def test_all_lines_and_users_and_keys(spark):
    many = "\n".join(f"{i}. A sufficiently long allegation" for i in range(30))
    assert len(apply(spark, text.numbered_allegations, [many])[0]) == 30 and len(apply(spark, text.relief_items, [many])[0]) == 30
    orgs = spark.createDataFrame([(1, "one"), (2, "two")], "organization_id int, name string")
    users = spark.createDataFrame([(i, 1) for i in range(40)], "user_id int, organization_id int").withColumn("created_at", F.lit("2020-01-01"))
    got = joins.org_profile(orgs, users).collect()
    assert len(got) == 41 and {r["user_count"] for r in got if r["organization_id"] == 1} == {40}


def test_long_texts_are_embedded_whole(spark):
    assert len(apply(spark, fields.prepare_text, ["x" * 50_000])[0]) == 50_000
    assert apply(spark, lambda c: fields.prepare_text(c, 5), ["x" * 9]) == ["xxxxx..."]
