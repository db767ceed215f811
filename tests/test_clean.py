"""Fields, codes, sanitising, redaction, quality rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from outcry.functions import codes, fields, text
from outcry.operators import clean, quality
from outcry.schemas import RAW_API_RECORD, RAW_BULK


def apply(spark, expr, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_normalize_text(spark):
    assert apply(spark, fields.normalize_text, None, "", "  a \t b\r\n\n c  d ") == ["", "", "a b c d"]


def test_dates(spark):
    day = dt.datetime
    given = ("20240229", "20231345", "2023", "20a30101", None)
    assert apply(spark, fields.parse_yyyymmdd, *given) == [day(2024, 2, 29), None, None, None, None]
    rolled = apply(spark, lambda c: fields.parse_yyyymmdd(c, rollover=True), *given)
    assert rolled == [day(2024, 2, 29), day(2024, 2, 14), None, None, None]


def test_flags_and_numbers(spark):
    assert apply(spark, fields.parse_yn, "Y", " yes ", "N", "", None, "yup") == [True, True, False, False, False, False]
    assert apply(spark, fields.parse_int0, "12abc", " -3 ", "", None, "x", "99999999999") == [12, -3, 0, 0, 0, 0]
    assert apply(spark, fields.primary_component, "AIR  BAGS:FRONTAL", ":x", None, "  ") == ["AIR BAGS", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_severity(spark):
    df = spark.createDataFrame([(False, False, 0, 0), (True, True, 1, 0), (True, True, 9, 9), (False, False, 0, 1)],
                               "crash boolean, fire boolean, injuries int, deaths int")
    assert [r["severity"] for r in clean.severity_scores(df).collect()] == [10, 110, 200, 85]


def test_prepare_text(spark):
    got = apply(spark, lambda c: fields.prepare_text(c, 6), "  a é b ", "abcdefgh", "éé")
    assert got == ["a  b", "abcdef...", ""]


def test_codes(spark):
    assert apply(spark, codes.component_keyword, "Ford AIRBAG brake", "Paint") == ["Airbag System", "Safety System"]
    assert apply(spark, codes.failure_mode, "my Engine dies", "x")[0] == "Engine stalling, losing power, or failing during vehicle operation"
    assert [x.split()[0] for x in apply(spark, codes.class_size_band, 10000, 1000, 100, 5, kind="int")] == ["Millions", "Hundreds", "Tens", "Thousands"]
    assert apply(spark, codes.map_price, "price_pro_yearly", "my-basic", "pro", "gold", None) == ["PRO", "BASIC", "PRO", "FREE", "FREE"]
    assert apply(spark, codes.map_status, "trialing", "unpaid", "?", None) == ["ACTIVE", "PAST_DUE", "INACTIVE", "INACTIVE"]
    assert apply(spark, codes.map_role, "org:admin", "org:analyst", "org:member", "x") == ["ADMIN", "ANALYST", "VIEWER", "VIEWER"]
    assert apply(spark, lambda c: codes.year_range(c, 2024)[0], "2018-2020", "2018 – 2020", "2019+", "", None) == [2018, 2018, 2019, 2021, 2021]
    assert apply(spark, lambda c: codes.year_range(c, 2024)[1], "2018-2020", "2018 – 2020", "2019+", "", None) == [2020, 2020, 2019, 2024, 2024]


def test_sanitize(spark):
    got = apply(spark, text.sanitize_html, "<p>Hi</p><script>alert('x')</script>", '<img src="x" onerror="alert(1)">',
                '<a href="javascript:alert(1)">x</a>', "<scr<script>ipt>alert(1)</script>", "plain")
    assert got[0] == "<p>Hi</p>" and got[4] == "plain"
    assert not any("script" in g.lower() or "onerror" in g for g in got)
    assert apply(spark, text.sanitize_string, "a\x00b\x07", "  café ", None, "x\ny") == ["ab", "café", "", "x\ny"]
    assert apply(spark, text.sanitize_search, "brake; DROP TABLE--", "a/* b */ (c)", "x" * 600) == ["brake DROP TABLE", "a b  c", "x" * 500]
    assert apply(spark, text.sanitize_filename, "../../etc/passwd", "my file!.pdf", "..hidden.", None) == ["etcpasswd", "myfile.pdf", "hidden", ""]
    assert apply(spark, text.escape_html, "<a href=\"/x\">'&`</a>") == [
        "&lt;a href&#x3D;&quot;&#x2F;x&quot;&gt;&#39;&amp;&#x60;&lt;&#x2F;a&gt;"]


def test_lines(spark):
    body = "1. The brakes fail without any warning\nshort\nThis is a long paragraph of text\n2. tiny\nlower case line that is long enough"
    assert apply(spark, text.numbered_allegations, body)[0] == ["The brakes fail without any warning", "This is a long paragraph of text"]
    assert apply(spark, text.relief_items, "1. Damages in full\na) Costs of the suit\n• Any other relief\nnothing")[0] == [
        "Damages in full", "Costs of the suit", "Any other relief"]


def test_formats(spark):
    df = spark.createDataFrame([("a@b.co",), ("abc1",), ("-1.5",), ("2024-01-01",), ("https://x.y/z",),
                                ("123E4567-e89b-12d3-a456-426614174000",), (None,)], "x string")
    got = {r["kind"]: (r["valid"], r["invalid"]) for r in quality.validate_format(df, "x").collect()}
    assert got == {"email": (1, 6), "alphanumeric": (1, 6), "number": (1, 6), "uuid": (1, 6), "url": (1, 6), "date": (1, 6)}


def test_redaction_of_keys(spark):
    m = F.create_map(*[F.lit(x) for x in ("userPassword", "a", "API_KEY", "b", "name", "c")])
    got = spark.range(1).select(text.redact_map(m)).first()[0]
    assert got == {"userPassword": "[REDACTED]", "API_KEY": "[REDACTED]", "name": "c"}
    df = spark.sql("""SELECT named_struct('user', named_struct('name', 'x', 'accessToken', 't'), 'items',
                      array(named_struct('token', 'kept')), 'ssnNumber', 5) AS s""")
    out = clean.redact_table(df, nested=["s"]).first()["s"]
    assert out["user"]["accessToken"] == "[REDACTED]" and out["user"]["name"] == "x"
    assert out["items"][0]["token"] == "kept" and out["ssnNumber"] == "[REDACTED]"


def test_redaction_of_personal_data(spark):
    df = spark.createDataFrame([("Call 555-123-4567, ssn 123-45-6789, card 1234-5678-9012-3456, mail Joe.X@mail.org é555-123-4567",)], "t string")
    out = clean.redact_table(df, text_cols=["t"]).first()
    assert out["t"] == "Call [REDACTED], ssn [REDACTED], card [REDACTED], mail [REDACTED] é[REDACTED]"
    assert (out["found_ssn"], out["found_card"], out["found_email"], out["found_phone"]) == (1, 1, 1, 2)


def test_nested_sanitising(spark):
    df = spark.sql("SELECT named_struct('a', ' x\\u0007 ', 'b', array(' y ', named_struct('c', 'z').c), 'n', 3) AS s")
    out = clean.sanitize_table(df, nested=["s"]).first()["s"]
    assert (out["a"], out["b"], out["n"]) == ("x", ["y", "z"], 3)


def raw(spark, *records):
    return spark.createDataFrame([tuple(r.get(f) for f in RAW_BULK.names) for r in records], RAW_BULK)


def test_bulk_rows_split(spark):
    df = raw(spark, {"cmplid": "1", "maketxt": "ford ", "datea": "20240101", "yeartxt": "2020", "crash": "Y", "injured": "2x"},
             {"cmplid": "2", "datea": "bad"}, {"cmplid": "3"})
    ok, bad = clean.clean_bulk_table(df)
    row = ok.first()
    assert ok.count() == 1 and (row["make"], row["crash"], row["injuries"], row["component"]) == ("FORD", True, 2, "UNKNOWN")
    assert sorted(r["error"] for r in bad.collect()) == ["Invalid date for complaint 2: bad", "Invalid date for complaint 3: "]
    assert ok.count() + bad.count() == df.count()


def test_api_rows(spark):
    product = [("VEHICLE", "F", "ford", "F-150", 2020)]
    base = ("F", "Yes", "No", 1, None)
    records = [("1", *base, "2023-05-01", "06/02/2023", None, "BRAKES:X", "s", product),
               ("2", *base, "2023-05-01", None, None, None, "s", product), ("3", *base, "", "", None, None, "s", product),
               ("4", *base, "2023-05-01", "garbage", None, None, "s", product), ("5", *base, None, None, None, None, "s", []),
               ("6", *base, None, None, None, None, "s", None)]
    ok, bad = clean.clean_api_table(spark.createDataFrame(records, RAW_API_RECORD), "2024-01-01")
    got = {r["source_id"]: r["date_added"] for r in ok.collect()}
    assert got == {"1": dt.datetime(2023, 6, 2), "2": dt.datetime(2023, 5, 1), "3": dt.datetime(2024, 1, 1)}
    assert sorted(r["source_id"] for r in bad.collect()) == ["4", "5", "6"]


def test_complaint_rules(spark):
    df = spark.createDataFrame([("1", "F", "M", 2020, "C", "d", dt.datetime(2024, 1, 1)), ("2", "", None, 1800, "C", "d", None)],
                               "source_id string, make string, model string, model_year int, component string, description string, date_added timestamp_ntz")
    got = {r["source_id"]: r["errors"] for r in quality.validate_complaint(df).collect()}
    assert got["1"] == [] and got["2"] == ["Missing make", "Missing model", "Invalid year: 1800", "Missing date_added"]
    report = {r["rule"]: (r["violations"], r["sample_keys"]) for r in quality.quality_report(df).collect()}
    assert report["make"] == (1, ["2"]) and "source_id" not in report


def test_case_rules(spark):
    full = {c: F.lit("x") for c in quality.CASE_REQUIRED}
    full.update({"vehicleYearStart": F.lit(2018), "vehicleYearEnd": F.lit(2020), **{c: F.lit(1) for c in quality.CASE_COUNTS},
                 "causesOfAction": F.array(F.lit("A")), "reliefRequested": F.array(F.lit("B"))})

    def errors(**change):
        df = spark.range(1).select(*[v.alias(k) for k, v in {**full, **change}.items()])
        return quality.validate_case(df).first()["errors"]

    assert errors() == []
    assert errors(courtName=F.lit("  ")) == ["courtName is required"]
    assert errors(vehicleYearStart=F.lit(2021)) == ["vehicleYearStart must be before or equal to vehicleYearEnd"]
    assert errors(deathCount=F.lit(-1), causesOfAction=F.array().cast("array<string>")) == [
        "deathCount must be non-negative", "At least one cause of action is required"]


@pytest.mark.parametrize("action, resource_id, line", [
    ("LOGIN", "7", "User u1 logged in at 2024-01-02T03:04:05.006Z"),
    ("UPDATE", "7", "User u1 updated patterns (7) at 2024-01-02T03:04:05.006Z"),
    ("UNDO", None, "User u1 undo patterns at 2024-01-02T03:04:05.006Z"),
])
def test_audit_line(spark, action, resource_id, line):
    df = spark.createDataFrame([("u1", action, "patterns", resource_id, dt.datetime(2024, 1, 2, 3, 4, 5, 6000))],
                               "u string, a string, r string, i string, t timestamp_ntz")
    assert df.select(codes.audit_line(*[F.col(c) for c in "uarit"])).first()[0] == line


def test_composition(spark):
    given = ("été", "Å", "한", "déjà", "plain")
    assert apply(spark, text.sanitize_string, *given) == ["été", "Å", "한", "déjà", "plain"]
