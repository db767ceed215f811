"""Streams give what the batch jobs give, in any number of steps, and again after a repeated batch."""

import datetime as dt

from pyspark.sql import functions as F

from helpers import rows
from outcry.operators import maintain, series
from outcry.operators.clean import check_bulk, good
from outcry.schemas import COMPLAINT, RAW_BULK
from outcry.streaming import base, ingest, late, state, windows
from test_tables import EVENT, FIELDS, plain_fold, random_events


def feed(spark, *records):
    return spark.createDataFrame([tuple(r.get(f) for f in RAW_BULK.names) for r in records], RAW_BULK)


def record(key, day="20240101", **more):
    return {"cmplid": key, "datea": day, "maketxt": "ford", **more}


def test_ingest_in_steps(spark, tmp_path):
    src, out, bad, ck = (str(tmp_path / n) for n in ("in", "rows", "bad", "ck"))

    def land(*records):
        feed(spark, *records).write.mode("append").json(src)
        ingest.stream_ingest(spark, src, out, bad, ck)

    land(record("1"), record("1", "20240102"), record("2"), record("9", "oops"))
    # An older date that lands later is new, a known key is not.
    land(record("3", "20100101"), record("2", "20240303"))
    got = base.read_batches(spark, out, COMPLAINT)
    assert rows(got, "source_id", "batch") == [("1", 0), ("2", 0), ("3", 1)]
    assert rows(base.read_batches(spark, bad), "source_id") == [("9",)]
    before = rows(got, "source_id", "date_added", "batch")
    ingest.stream_ingest(spark, src, out, bad, ck)
    assert rows(base.read_batches(spark, out, COMPLAINT), "source_id", "date_added", "batch") == before


def test_repeated_batch_leaves_one_copy(spark, tmp_path):
    df = good(check_bulk(feed(spark, record("1"), record("2"))))
    for _ in range(2):
        base.write_batch(df, str(tmp_path / "rows"), 0)
    assert base.read_batches(spark, str(tmp_path / "rows")).count() == 2
    assert base.read_batches(spark, str(tmp_path / "rows"), COMPLAINT, before=0).isEmpty()


def complaints(spark, *data):
    return spark.createDataFrame([(k, dt.datetime.fromisoformat(d)) for k, d in data], "cluster_id string, date_added timestamp_ntz")


def test_late_rows_count_in_partials_and_are_found(spark, tmp_path):
    early = complaints(spark, ("a", "2024-01-02"), ("a", "2024-03-05"))
    late = complaints(spark, ("a", "2024-01-03"), ("b", "2024-03-06"))
    src, sums, kept = (str(tmp_path / n) for n in ("in", "sums", "windows"))
    for part in (early, late):
        part.write.mode("append").parquet(src)
        stream = base.file_stream(spark, src, early.schema)
        windows.weekly_partials(stream, sums, str(tmp_path / "ck1"))
        windows.run_weekly_counts(stream, "7 days", kept, str(tmp_path / "ck2"))
    everything = early.unionByName(late)
    want = rows(series.weekly_counts(everything, "2024-03-31", days=365), "key", "wk", "v", "i", "n")
    assert rows(windows.sum_partials(base.read_batches(spark, sums)), "key", "wk", "v", "i", "n") == want
    # The watermark form drops the old row; the repair job can tell which.
    dropped = windows.late_rows(late, "2024-03-05", 7)
    assert rows(dropped, "cluster_id", "date_added") == [("a", dt.datetime(2024, 1, 3))]
    seen = windows.latest_updates(base.read_batches(spark, kept), ["key", "wk"], ["v"])
    repaired = seen.unionByName(series.weekly_counts(dropped, "2024-03-31", days=365).select("key", "wk", "v"))
    assert rows(repaired.groupBy("key", "wk").agg(F.sum("v").alias("v")), "key", "wk", "v") == [w[:3] for w in want]


def test_rows_behind_the_watermark_are_folded_back(spark, tmp_path):
    parts = [complaints(spark, ("a", "2024-01-02"), ("a", "2024-03-05"), ("b", "2024-02-01")),
             complaints(spark, ("a", "2024-01-03"), ("a", "2024-03-06"), ("c", "2020-02-29"), (None, "2024-03-01")),
             complaints(spark, ("a", "2024-03-20"), ("a", "2024-01-03"), ("b", "2024-03-06"))]
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    seen, watch = parts[0].limit(0), late.DropWatch()
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(src)
        seen = seen.unionByName(part)
        for _ in range(2):  # a second run finds nothing new and changes nothing
            assert late.run_repaired_counts(base.file_stream(spark, src, part.schema), 7, out, ck, watch=watch) == 0
        want = rows(series.weekly_counts(seen, "2024-03-31", days=3650), "key", "wk", "v", "i", "n")
        assert rows(late.repaired_counts(spark, out), "key", "wk", "v", "i", "n") == want
    # the windows alone lack the rows that came late
    alone = windows.latest_updates(base.read_batches(spark, f"{out}/counts"), ["key", "wk"], ["v"])
    assert alone.agg(F.sum("v")).first()[0] == 9 - 3
    assert rows(base.read_batches(spark, f"{out}/late"), "cluster_id", "batch") == [("a", 1), ("a", 2), ("c", 1)]


def test_the_watch_sees_dropped_rows(spark, tmp_path):
    src, out, watch, lost = str(tmp_path / "in"), str(tmp_path / "out"), late.DropWatch(), []
    for day in ("2024-03-05", "2024-01-03"):
        complaints(spark, ("a", day)).write.mode("append").parquet(src)
        stream = base.file_stream(spark, src, complaints(spark, ("a", day)).schema)
        lost.append(watch.watch(spark, lambda s=stream: windows.run_weekly_counts(s, "7 days", out, str(tmp_path / "ck"))))
    assert lost == [0, 1] and sum(watch.dropped.values()) == 1


def test_landing_time_keeps_old_records(spark, tmp_path):
    src = str(tmp_path / "in")

    def run():
        stream = ingest.stream_dedupe(ingest.landed_feed(spark, src))
        base.run_available(stream, lambda b, n: base.write_batch(b.select("cmplid", "datea"), str(tmp_path / "rows"), n), str(tmp_path / "ck"))

    for part in ([record("1", "20240101"), record("1", "20240101")], [record("2", "19990101"), record("1", "20240202")]):
        feed(spark, *part).write.mode("append").json(src)
        run()
    assert rows(base.read_batches(spark, str(tmp_path / "rows")), "cmplid") == [("1",), ("2",)]


def test_subscription_stream_equals_batch(spark, tmp_path):
    events = random_events(400, seed=21)
    df = spark.createDataFrame(events, EVENT)
    for lo, hi in ((0, 150), (150, 151), (151, 400)):
        df.where((F.col("seq") >= lo) & (F.col("seq") < hi)).write.mode("append").parquet(str(tmp_path / "in"))
        state.stream_subscription_state(base.file_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "state"), str(tmp_path / "ck"))
    last = base.read_version(spark, str(tmp_path / "state"), state.stream_batches(spark, str(tmp_path / "state")))
    assert {r["customer"]: tuple(r[f] for f in FIELDS) for r in last.collect()} == plain_fold(events)
    assert last.columns == maintain.STATE_COLUMNS


def test_alert_only_for_touched_groups(spark, tmp_path):
    days = [f"2024-01-{d:02d}" for d in (1, 8, 15, 22)]
    counts = [3, 4, 3, 4]
    first = complaints(spark, *[(k, d) for k in "ab" for d, c in zip(days, counts) for _ in range(c)])
    second = complaints(spark, *[("a", "2024-01-29")] * 40)
    src, alerts = str(tmp_path / "in"), str(tmp_path / "alerts")
    for part in (first, second):
        part.write.mode("append").parquet(src)
        windows.weekly_partials(base.file_stream(spark, src, first.schema), str(tmp_path / "sums"), str(tmp_path / "ck"), alerts=alerts)
    assert rows(base.read_version(spark, alerts, 1), "key", "v") == [("a", 40)]
    assert base.read_version(spark, alerts, 0).isEmpty()


def test_threshold_crossings(spark, tmp_path):
    windows.use_rocks(spark)
    schema = "k string, x long"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (7, 2, 15):
        spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("x")).write.mode("append").parquet(src)
        stream = windows.stream_threshold_alerts(base.file_stream(spark, src, spark.createDataFrame([], schema).schema), "k", 5)
        base.run_available(stream, lambda b, i: base.write_batch(b, out, i), str(tmp_path / "ck"), "update")
    got = [(r["count"], r["crossed"]) for r in base.read_batches(spark, out).orderBy("batch").collect()]
    assert got == [(7, 1), (24, 3)]
