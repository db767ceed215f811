"""State in buckets: the same rows as the whole table, fewer files written."""

import os

from pyspark.sql import functions as F

from outcry.operators import maintain
from outcry.streaming import base, buckets, state
from test_tables import EVENT, FIELDS, plain_fold, random_events

ROW = "k string, n long"


def files(path):
    """Data files of a folder, by path below it."""
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def add(held, changes):
    return held.unionByName(changes).groupBy("k").agg(F.sum("n").alias("n"))


def test_one_key_writes_one_bucket(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).cast("long").alias("n"))
    t = buckets.BucketTable(spark, str(tmp_path / "t"), "k", rows.schema, 16)
    t.create(rows)
    t.create(rows.limit(0))  # there already
    first = files(tmp_path / "t" / "data" / "version=0")
    assert len(first) == 16 and t.newest() == 0
    one = spark.createDataFrame([("k7", 5), ("k7", 1)], ROW)
    written = t.update(1, one, add)
    assert len(written) == 1 and [os.path.dirname(f) for f in files(tmp_path / "t" / "data" / "version=1")] == [f"bucket={written[0]}"]
    assert {r.k: r.n for r in t.read(1).collect()} == {f"k{i}": 7 if i == 7 else 1 for i in range(200)}
    # run again: the same table; the version before is as it was
    assert t.update(1, one, add) == written and t.read(1).where("k = 'k7'").first().n == 7 and t.read(0).where("k = 'k7'").first().n == 1
    t.update(2, spark.createDataFrame([("new", 1), (None, 3)], ROW), add)
    assert t.read(2).count() == 202
    before = {r.k: r.n for r in t.read(2).collect()}
    t.vacuum()
    assert {r.k: r.n for r in t.read(2).collect()} == before and len(files(tmp_path / "t" / "data")) == 16
    assert not os.path.exists(tmp_path / "t" / "pointer" / "version=0")


def test_bucket_that_loses_its_rows(spark, tmp_path):
    t = buckets.BucketTable(spark, str(tmp_path / "t"), "k", spark.createDataFrame([], ROW).schema, 4)
    t.create()
    assert t.read(0).count() == 0
    t.update(1, spark.createDataFrame([("a", 1)], ROW), add)
    t.update(2, spark.createDataFrame([("a", 1)], ROW), lambda held, changes: held.limit(0))
    assert t.read(2).count() == 0 and t.read(1).count() == 1 and t.vacuum(2) == [0]


def test_subscription_buckets_equal_batch(spark, tmp_path):
    events = random_events(400, seed=22)
    df = spark.createDataFrame(events, EVENT)
    for lo, hi in ((0, 150), (150, 151), (151, 400)):
        df.where((F.col("seq") >= lo) & (F.col("seq") < hi)).write.mode("append").parquet(str(tmp_path / "in"))
        t = state.stream_subscription_buckets(base.file_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "state"), str(tmp_path / "ck"), 8)
    last = t.read(t.newest())
    assert t.newest() == 3 and last.columns == maintain.STATE_COLUMNS
    assert {r["customer"]: tuple(r[f] for f in FIELDS) for r in last.collect()} == plain_fold(events)
    assert len({os.path.dirname(f) for f in files(tmp_path / "state" / "data" / "version=2")}) <= 1  # the batch of one event
