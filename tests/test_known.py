"""Known keys behind Bloom filters: the same rows as an anti join, only the buckets opened that may hold a key."""

import os
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from outcry.operators.clean import check_bulk, good
from outcry.plans.feeds_raw import raw_bulk
from outcry.schemas import COMPLAINT
from outcry.sources.sync import insert_new
from outcry.streaming import base, ingest, known
from outcry.streaming.known import KnownKeys

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
ROW = "k string, bucket int, n long"


def rows(spark, keys):
    """One row a key, with a column whose name the table of keys uses itself."""
    return spark.createDataFrame([(k, 7, i) for i, k in enumerate(keys)], ROW)


def names(df):
    return sorted(r.k or "" for r in df.collect())


def table(spark, path, buckets=8, blocks=2):
    return KnownKeys(spark, str(path), "k", StringType(), buckets, blocks)


def folders(path):
    return sorted(re.sub(r"/part-.*", "", os.path.relpath(os.path.join(d, f), path)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_new_keys_open_no_bucket(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.unknown(rows(spark, ["a"]), 0)[1] == []
    t.add(rows(spark, [f"old{i}" for i in range(2000)]), 0)
    fresh = rows(spark, [f"new{i}" for i in range(40)])
    got, opened = t.unknown(fresh, 1)
    assert names(got) == sorted(f"new{i}" for i in range(40)) and opened == [] and got.columns == fresh.columns
    got, opened = t.unknown(rows(spark, ["old5", "new1"]), 1)
    home = rows(spark, ["old5"]).select(t.bucket().alias("b")).first().b
    assert names(got) == ["new1"] and opened == [home]
    # the bucket's files and no others are read
    assert {int(re.search("bucket=([0-9]+)", f).group(1)) for f in t.read(1, opened).inputFiles()} == {home}


def test_full_filters_cost_reading_not_rightness(spark, tmp_path):
    t = table(spark, tmp_path / "t", 2, 1)
    t.add(spark.range(60_000).select(F.concat(F.lit("old"), "id").alias("k")), 0)
    got, opened = t.unknown(rows(spark, [f"new{i}" for i in range(300)] + ["old7", "old59999"]), 1)
    assert names(got) == sorted(f"new{i}" for i in range(300)) and opened == [0, 1]


def test_batch_run_again_and_merge(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    for version, keys in enumerate((["a", "b"], ["c", None], ["d"])):
        t.add(rows(spark, keys), version)
    t.add(rows(spark, ["d"]), 2)
    assert names(t.read(3)) == ["a", "b", "c", "d"]
    # a batch does not see itself; null is never known
    assert names(t.unknown(rows(spark, ["a", "d", None]), 2)[0]) == ["", "d"]
    # a merge without its end does not count
    os.makedirs(tmp_path / "t" / "merged" / "upto=9" / "keys")
    assert t.merged() == -1 and names(t.read(3)) == ["a", "b", "c", "d"]
    assert t.compact(blocks=5) == 2 and t.merged() == 2
    assert not [f for f in folders(tmp_path / "t") if "version=" in f]
    t = table(spark, tmp_path / "t")  # two numbers of blocks from here on
    t.add(rows(spark, ["e"]), 3)
    assert names(t.unknown(rows(spark, list("abcdef")), 4)[0]) == ["f"]
    assert names(t.unknown(rows(spark, list("abcdef")), 3)[0]) == ["e", "f"]
    t.drop_from(3)
    assert names(t.unknown(rows(spark, list("abcdef")), 4)[0]) == ["e", "f"] and t.compact() == 2


def test_empty(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.compact() == -1 and t.read(5).count() == 0 and t.filters(5).count() == 0
    t.add(rows(spark, []), 0)
    assert t.unknown(rows(spark, []), 1)[0].count() == 0 and names(t.unknown(rows(spark, ["x"]), 1)[0]) == ["x"]
    assert t.compact() == 0


def test_stream_opens_buckets_of_repeats_only(spark, tmp_path):
    raw = raw_bulk(spark, SF).where("cmplid is not null")
    once = raw.dropDuplicates(["cmplid"])
    one = once.orderBy("cmplid").limit(1)
    out = str(tmp_path)
    opened = []
    for part in (once.where("crash <> 'N'"), once.where("crash = 'N'"), one):
        part.write.mode("append").json(f"{out}/in")
        opened += ingest.stream_ingest_known(spark, f"{out}/in", f"{out}/rows", f"{out}/bad", f"{out}/known", f"{out}/ck", buckets=16, blocks=8, compact_every=2)
    plain = str(tmp_path / "plain")
    ingest.stream_ingest(spark, f"{out}/in", f"{plain}/rows", f"{plain}/bad", f"{plain}/ck")
    got, want = (sorted(r.source_id for r in base.read_batches(spark, f"{at}/rows", COMPLAINT).select("source_id").collect()) for at in (out, plain))
    assert got == want and len(got) == len(set(got)) > 100
    assert opened[0] == [] and len(opened[1]) < 16 and len(opened[2]) == (1 if good(check_bulk(one)).count() else 0)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sets(st.text("abé0", min_size=0, max_size=3), max_size=25), min_size=2, max_size=3))
def test_equals_anti_join(spark, tmp_path_factory, batches):
    t = table(spark, tmp_path_factory.mktemp("known"), 4, 1)
    held = set()
    for version, keys in enumerate(batches):
        batch = rows(spark, sorted(keys))
        want = insert_new(batch, spark.createDataFrame([(k,) for k in sorted(held)], "k string"), "k", [F.asc("n")])
        got = t.unknown(batch, version)[0]
        assert names(got) == names(want) == sorted(keys - held)
        t.add(got, version)
        held |= keys


def test_filters_grow_with_their_keys(spark, tmp_path):
    t = table(spark, tmp_path / "t", 2, 1)
    old = spark.range(40_000).select(F.concat(F.lit("old"), "id").alias("k"))
    assert (t.blocks_for(0), t.blocks_for(6_000), t.blocks_for(6_001), t.blocks_for(40_000)) == (1, 1, 2, 8)
    fresh = rows(spark, [f"new{i}" for i in range(8)])
    t.add(old, 0, t.blocks_for(40_000))
    assert t.filters(1).count() == 16 and t.unknown(fresh, 1)[1] == []
    assert t.unknown(old.limit(50).select("k", F.lit(7).alias("bucket"), F.lit(0).alias("n")), 1)[0].count() == 0


def test_large_buckets_are_written_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(known, "FILE_KEYS", 500)
    monkeypatch.setattr(known, "BLOCK_KEYS", 250)
    t = table(spark, tmp_path / "t", 2, 8)
    for version in (0, 1):  # the same keys twice
        t.add(spark.range(4_000).select(F.concat(F.lit("old"), "id").alias("k")), version)
    assert all(len(os.listdir(tmp_path / "t" / "keys" / "version=0" / f"bucket={b}")) > 2 for b in (0, 1))
    t.compact()
    assert t.read(2).count() == 4_000 == t.read(2).select("k").distinct().count()


def test_stream_sizes_its_filters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(known, "BLOCK_KEYS", 20)
    out, opened = str(tmp_path), []
    line = lambda i: (f"{i}", "ford", "20200101")
    for n, part in enumerate((range(400), range(400, 500), range(300, 301))):
        spark.createDataFrame([line(i) for i in part], "cmplid string, maketxt string, datea string").coalesce(1).write.mode("append").json(f"{out}/in")
        opened += ingest.stream_ingest_known(spark, f"{out}/in", f"{out}/rows", f"{out}/bad", f"{out}/known", f"{out}/ck", buckets=2, blocks=1, compact_every=2)
        if n == 0:
            assert KnownKeys(spark, f"{out}/known", "source_id", StringType(), 2, 1).filters(1).select("blocks").distinct().collect() == [(16,)]
    merged = KnownKeys(spark, f"{out}/known", "source_id", StringType(), 2, 1).filters(2)
    assert base.read_batches(spark, f"{out}/rows", COMPLAINT).count() == 500 and {r.blocks for r in merged.collect()} == {16}
    assert len(opened[2]) == 1
