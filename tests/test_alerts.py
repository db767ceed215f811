"""Saved searches: the same rows as one search after another."""

import datetime as dt
import random

from pyspark.sql import functions as F

from outcry.operators import alerts, filters
from outcry.streaming import base, digests, windows

ROW = "source_id string, make string, model string, model_year int, component string, description string, crash boolean, fire boolean, injuries int, deaths int, date_added timestamp_ntz, term string, s string"


def complaints(spark, rng, n):
    pick = lambda *xs: rng.choice([*xs, None])
    return spark.createDataFrame([(
        str(i), pick("Ford", "FORD F", "Kia", "Ki", ""), pick("Focus", "Rio", "focus rs"), pick(1999, 2005, 2020), pick("BRAKES", "brake line", "engine", "éngine"),
        pick("the brakes failed", "It BURNT", "", "nothing"), pick(True, False), pick(True, False), pick(0, 1), pick(0, 2), dt.datetime(2024, 1, 1 + i % 28), "x", "y") for i in range(n)], ROW)


def searches(spark, rng, n):
    pick = lambda p, *xs: rng.choice(xs) if rng.random() < p else None
    rows = [(str(i), pick(0.4, "ford", "KI", "", "zz"), pick(0.3, "FOCUS", "rio"), pick(0.3, "brake", "Éng"), pick(0.3, 1990, 2005), pick(0.3, 2005, 2019), pick(0.2, True, False),
             pick(0.2, True), pick(0.2, True), pick(0.2, True), pick(0.4, "BRAKE", "burnt", "", "never", "e"), pick(0.1, True, False)) for i in range(n)]
    return spark.createDataFrame([*rows, ("all", *[None] * 11), ("year", None, None, None, 2000, None, *[None] * 6)], alerts.SEARCH)


def one_by_one(rows, asked):
    found = []
    for s in asked.where(~F.coalesce("paused", F.lit(False))).collect():
        criteria = {k: v for k, v in s.asDict().items() if k not in ("search_id", "paused") and v is not None}
        found += [(s.search_id, r.source_id) for r in filters.search_complaints(rows, **criteria).select("source_id").collect()]
    return sorted(found)


def test_all_searches_at_once_equal_one_after_another(spark):
    rng = random.Random(3)
    rows, asked = complaints(spark, rng, 120).persist(), searches(spark, rng, 30)
    want = one_by_one(rows, asked)
    for size in (alerts.NEEDLES, 3):
        got = alerts.match_searches(rows.repartition(3), asked, ["source_id"], per_automaton=size)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 300
    assert alerts.match_searches(rows.limit(0), asked).count() == 0 and alerts.match_searches(rows, asked.limit(0)).count() == 0
    assert alerts.match_searches(rows, asked).columns == ["search_id", *rows.columns]


def test_rows_meet_only_searches_of_their_rarest_term(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("source_id"), F.lit("ford").alias("make"), F.lit("m").alias("model"), F.lit(2000).alias("model_year"), F.lit("c").alias("component"),
                                    F.when(F.col("id") == 7, "rareword").otherwise("common").alias("description"), F.lit(True).alias("crash"), F.lit(False).alias("fire"), F.lit(0).alias("injuries"), F.lit(0).alias("deaths"))
    asked = spark.createDataFrame([(str(i), "ford", None, None, None, None, True, None, None, None, "rareword", False) for i in range(50)], alerts.SEARCH)
    numbered = rows.withColumn("row", F.col("source_id").cast("long"))
    terms = alerts.row_terms(numbered, asked)
    under = alerts.filed(asked, terms.groupBy("term").agg(F.count("*").alias("rows")), rows.select("model_year").distinct())
    assert under.count() == 50 and terms.join(under, "term").count() == 50  # not 50,000
    assert alerts.match_searches(rows, asked, ["source_id"]).where("source_id = '7'").count() == 50


def test_rows_meet_only_searches_whose_texts_and_flags_they_hold(spark):
    rows = spark.range(1000).select(F.col("id").alias("row"), F.col("id").cast("string").alias("source_id"), F.lit("Ford").alias("make"), F.lit("m").alias("model"), F.lit(2000).alias("model_year"), F.when(F.col("id") < 501, "red").otherwise("blue").alias("component"),
                                    F.when(F.col("id") >= 500, "a BOLT").otherwise("a ring").alias("description"), (F.col("id") % 2 == 0).alias("crash"), F.lit(False).alias("fire"), F.lit(0).alias("injuries"), F.lit(0).alias("deaths"))
    # each of the things they ask for is in half of all rows, all of them only in row 500
    asked = spark.createDataFrame([(str(i), "ford", None, "RED", 1990 + i % 20, None, True, None, None, None, "bolt", False) for i in range(50)], alerts.SEARCH)
    terms = alerts.row_terms(rows, asked)
    under = alerts.filed(asked, terms.groupBy("term").agg(F.count("*").alias("rows")), rows.select("model_year").distinct())
    assert terms.join(under, "term").select("row").distinct().collect()[0].row == 500 and terms.count() == 1  # a row for each of 500 before
    assert sorted(int(r.search_id) for r in alerts.match_searches(rows, asked, ["source_id"]).collect()) == [i for i in range(50) if i % 20 <= 10]


def test_searches_in_many_turns_lists_and_parts(spark, monkeypatch):
    rng = random.Random(11)
    rows, asked = complaints(spark, rng, 150).persist(), searches(spark, rng, 20)
    # equal but for their ids
    asked = asked.crossJoin(spark.range(5)).withColumn("search_id", F.concat("search_id", F.lit("-"), F.col("id").cast("string"))).drop("id").persist()
    want = one_by_one(rows, asked)
    for name, value in (("SETS", 7), ("REMEMBERED", 2), ("HANDED", 3), ("PAIRS", 10), ("IDS", 2)):
        monkeypatch.setattr(alerts, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = alerts.match_searches(rows.repartition(3), asked, ["source_id"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == want and len(want) > 1000


def test_equal_searches_are_written_as_one_list(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    rows = complaints(spark, rng, 50).persist()
    asked = spark.range(300).select(F.col("id").cast("string").alias("search_id"), F.lit("ford").alias("make"), *[F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in alerts.SEARCH.split(", ")[2:])])
    monkeypatch.setattr(alerts, "scratch_path", lambda session, name: str(tmp_path / name))
    found = alerts.match_searches(rows, asked, ["source_id"])
    assert [len(r.ids) for r in spark.read.parquet(str(tmp_path / "search-lists")).collect()] == [300]
    assert found.count() == 300 * rows.where("lower(make) LIKE '%ford%'").count() > 0


def test_alerts_of_rows_with_null_years_and_texts(spark):
    rows = spark.createDataFrame([("a", None, None, None, None, None, None, None, None, None), ("b", "Ford", None, None, None, None, None, None, None, None), ("c", None, None, 2000, None, "Ford", True, None, 1, None)],
                                 "source_id string, make string, model string, model_year int, component string, description string, crash boolean, fire boolean, injuries int, deaths int")
    ask = lambda i, **k: tuple([i, *(k.get(n.split()[0]) for n in alerts.SEARCH.split(", ")[1:])])
    asked = spark.createDataFrame([ask("all"), ask("from", year_from=1990), ask("upto", year_to=1990), ask("ford", make="FORD"), ask("text", search="for", has_injury=True), ask("both", make="ford", year_to=2020), ask(None)], alerts.SEARCH)
    got = sorted(map(tuple, alerts.match_searches(rows, asked, ["source_id"]).collect()))
    assert got == [("all", "a"), ("all", "b"), ("all", "c"), ("ford", "b"), ("from", "c"), ("text", "c")]


def test_only_matching_pairs_take_texts_along(spark):
    rng = random.Random(5)
    rows, asked = complaints(spark, rng, 120).withColumn("row", F.monotonically_increasing_id()).persist(), searches(spark, rng, 30).where("NOT coalesce(paused, false)").persist()
    pairs = alerts.candidates(rows, alerts.row_terms(rows, asked).persist(), asked)
    found = sorted((r.search_id, r.source_id) for r in pairs.join(rows, "row").select("search_id", "source_id").collect())
    assert found == one_by_one(rows, asked) and len(found) > 200


def test_search_alerts_of_a_stream(spark, tmp_path):
    rng = random.Random(9)
    rows, asked = complaints(spark, rng, 60).persist(), searches(spark, rng, 10)
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for part in (rows.where("source_id < '3'"), rows.where("source_id >= '3'")):
        part.write.mode("append").parquet(src)
        for _ in range(2):
            windows.stream_search_alerts(base.file_stream(spark, src, rows.schema), lambda session: asked, out, ck, ["source_id"])
    got = base.read_batches(spark, out)
    assert sorted((r.search_id, r.source_id) for r in got.collect()) == one_by_one(rows, asked)
    assert {r.batch for r in got.select("batch").distinct().collect()} == {0, 1}


def test_digests_come_once_when_their_period_is_over(spark, tmp_path):
    windows.use_rocks(spark)
    spec = "search_id string, frequency string, happened_at timestamp_ntz"
    at = lambda day, hour=9: dt.datetime(2024, 3, day, hour)
    # 3 March 2024 is a Sunday
    parts = [[("a", "daily", at(4)), ("a", "daily", at(4, 11)), ("w", "weekly", at(4)), ("i", "immediate", at(4)), (None, "daily", at(4)), ("x", "never", at(4))],
             [("a", "daily", at(4, 23)), ("a", "daily", at(5)), ("w", "weekly", at(9)), ("a", "daily", None)],
             [("a", "daily", at(10)), ("w", "weekly", at(12)), ("b", "daily", at(12))], [("b", "daily", at(20))]]
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    seen = []
    for part in parts:
        spark.createDataFrame(part, spec).coalesce(1).write.mode("append").parquet(src)
        digests.run_digests(base.file_stream(spark, src, spark.createDataFrame([], spec).schema), out, ck)
        seen.append(sorted((r.search_id, r.period_start.day, r.n, r.first_at, r.last_at) for r in base.read_batches(spark, f"{out}/digests").collect()))
    assert seen[0] == [] and [x[:3] for x in seen[1]] == [("a", 4, 3), ("a", 5, 1)]
    assert seen[-1] == [("a", 4, 3, at(4), at(4, 23)), ("a", 5, 1, at(5), at(5)), ("a", 10, 1, at(10), at(10)), ("b", 12, 1, at(12), at(12)), ("w", 3, 2, at(4), at(9)), ("w", 10, 1, at(12), at(12))]
    assert [r.search_id for r in base.read_batches(spark, f"{out}/immediate").collect()] == ["i"]


def test_a_task_sends_one_row_for_a_search_and_period(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = spark.range(0, 600, 1, 1).select(
            (F.col("id") % 2).cast("string").alias("search_id"), F.lit("daily").alias("frequency"),
            F.expr("timestamp_ntz'2024-03-04' + make_dt_interval(cast(id % 3 as int), 0, cast(id div 3 as int))").alias("happened_at"))
        got = sorted((r.search_id, r.period_start.day, r.n, r.first_at.minute + 60 * r.first_at.hour, r.last_at.minute + 60 * r.last_at.hour)
                     for r in digests._folded(rows, "happened_at").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 6 and {x[2] for x in got} == {100} and {x[4] - x[3] for x in got} == {198}


def test_more_searches_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(digests, "HELD_ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = spark.range(0, 300, 1, 1).select((F.col("id") % 30).cast("string").alias("search_id"), F.lit("weekly").alias("frequency"), F.expr("timestamp_ntz'2024-03-04'").alias("happened_at"))
        got = digests._folded(rows, "happened_at").groupBy("search_id").agg(F.sum("n").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 30 and {r.n for r in got} == {10}
