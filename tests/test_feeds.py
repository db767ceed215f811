"""Landed feeds: packed files, all records in them."""

import datetime as dt
import glob
import gzip
import os
import re
import zlib

from pyspark.sql import functions as F

from outcry.plans import clean_queries, feeds_raw, stream_queries
from outcry.sources import readers


def tables(spark, folder, n=60):
    """Lines and parts as the test tables have them; one key twice, one line without part."""
    day = dt.datetime(1999, 1, 1)
    lines = [(i // 4, i % 7, i % 3, i % 4, float(i % 51), 100.0, 0.09 if i % 3 else 0.0, (i % 9) / 100, "RAN"[i % 3], "FO"[i % 2], day + dt.timedelta(days=i * 20)) for i in range(n)]
    lines += [lines[0], (n, None, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", day)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                          "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{folder}/lineitem.parquet")
    parts = [(i, "small bolt", f"Brand#{i + 1}", "ECO", i, 1.0) for i in range(7)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def files(path):
    return glob.glob(f"{path}/**/part-*", recursive=True)


def test_landed_feeds_are_packed_and_whole(spark, tmp_path, monkeypatch):
    sf = tables(spark, tmp_path)
    monkeypatch.setattr(feeds_raw, "FILE_ROWS", 10)
    want = sorted(map(str, feeds_raw.raw_bulk(spark, sf).select("cmplid", "cdescr", "datea").collect()))
    assert len(want) == 61
    for kind in ("json", "pages"):
        path = feeds_raw.land(spark, sf, kind)
        assert len(files(path)) > 6 and all(f.endswith(".json.gz") for f in files(path))
        assert sorted(map(str, readers.read_all_pages(spark, path).select("cmplid", "cdescr", "datea").collect())) == want
    assert all(f.endswith(".csv.gz") for f in files(feeds_raw.land(spark, sf, "csv")))
    flat = readers.read_flat_file(spark, feeds_raw.land(spark, sf, "csv")).select("cmplid", "corrupt_record").collect()
    assert len(flat) == 61 and not any(r.corrupt_record for r in flat)
    api = feeds_raw.land(spark, sf, "api")
    assert all(f.endswith(".json.gz") for f in files(api)) and len(readers.read_api_complaints(spark, api).select("odiNumber").collect()) == 61


def test_lines_are_not_sorted_to_meet_their_parts(spark, tmp_path):
    sf = tables(spark, tmp_path)
    plan = feeds_raw.raw_bulk(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_landings_of_a_stream_are_packed(spark, tmp_path):
    feed = feeds_raw.raw_bulk(spark, tables(spark, tmp_path / "sf"))
    taken = []
    stream_queries.in_steps([feed.where(F.col("crash") == "N"), feed.where(F.col("crash") != "N")], str(tmp_path / "in"), lambda: taken.append(len(files(tmp_path / "in"))), "json")
    assert len(taken) == 2 and all(f.endswith(".json.gz") for f in files(tmp_path / "in"))
    assert len(readers.read_bulk_complaints(spark, str(tmp_path / "in")).select("cmplid").collect()) == 61


def test_landings_are_packed_at_level_three(spark, tmp_path):
    """The packing took as long as rendering the records at the default level."""
    path = feeds_raw.land(spark, tables(spark, tmp_path, 4_000), "json")
    text = max((gzip.open(f).read() for f in files(path)), key=len)
    packed = sum(len(open(f, "rb").read()) for f in files(path) if gzip.open(f).read() == text)
    sizes = {level: len(zlib.compress(text, level)) for level in (3, 6)}
    assert abs(packed - sizes[3]) < abs(packed - sizes[6])


#: Sizes of parts that have no component, an unreadable year or one that breaks the rules.
SIZES = dict(enumerate((1, 2, 3, 10, 20, 49, 50)))


def grown(spark, folder, query):
    """What the query returns on a feed and on one of four times the records, and lines with a part, feed by feed. Landed bytes grow no
    faster than records and stay below a third of the text."""
    out, per_record = [], []
    for n in (2_000, 8_000):
        sf = tables(spark, folder / str(n), n)
        spark.createDataFrame([(i, ("small bolt", "wide nut")[i % 2], f"Brand#{i + 1}", "ECO", size, 1.0) for i, size in SIZES.items()],
                              "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.mode("overwrite").parquet(f"{sf}/part.parquet")
        got = [tuple(r) for r in query(spark, sf).collect()]
        lines = [r for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect() if r.l_partkey is not None]
        per_record.append(sum(map(os.path.getsize, files(feeds_raw.land(spark, sf, "json")))) / len(lines))
        out.append((got, lines))
    assert per_record[1] <= 1.1 * per_record[0] and max(per_record) < 100, per_record
    return out


def landed_day(line):
    return "2023" if line.l_tax >= 0.08 else "20231345" if line.l_tax >= 0.07 else f"{line.l_shipdate:%Y%m%d}"


def key(line):
    return f"{line.l_orderkey}-{line.l_linenumber}"


def test_complaints_since_moves_no_more_than_its_feed(spark, tmp_path):
    for got, lines in grown(spark, tmp_path, clean_queries.complaints_since):
        want = [(key(r), landed_day(r)) for r in lines if landed_day(r) > "20010601"]
        assert sorted(got) == sorted(want) and len(want) > 1_000 and [d for _, d in got] == sorted((d for _, d in want), reverse=True)


def test_complaints_by_component_moves_no_more_than_its_feed(spark, tmp_path):
    for got, lines in grown(spark, tmp_path, clean_queries.complaints_by_component):
        want = [(key(r), landed_day(r)) for r in lines if SIZES[r.l_partkey] not in (1, 2) and r.l_partkey % 2 == 0]
        assert sorted(got) == sorted(want) and len(want) > 500 and [d for _, d in got] == sorted((d for _, d in want), reverse=True)

def test_validate_complaint_moves_no_more_than_its_feed(spark, tmp_path):
    years = {49: 0, 50: 9999}
    for got, lines in grown(spark, tmp_path, clean_queries.validate_complaint):
        want = [(key(r), f"Invalid year: {years[SIZES[r.l_partkey]]}") for r in lines if r.l_tax < 0.07 and SIZES[r.l_partkey] in years]
        assert sorted(got) == sorted(want) and len(want) > 400

def test_count_where_moves_no_more_than_its_feed(spark, tmp_path):
    for got, lines in grown(spark, tmp_path, clean_queries.count_where):
        want = sum(r.l_returnflag == "R" and SIZES[r.l_partkey] == 50 for r in lines)
        assert got == [(want,)] and want > 50



def stretches(path):
    """Of each landed file, how many stretches of records of one part it has, and of how many parts."""
    for f in files(path):
        seen = re.findall(rb"brand#(\d+)", gzip.open(f).read())
        yield sum(a != b for a, b in zip(seen, [None, *seen])), len(set(seen))


def test_complaints_since_reads_records_in_order_of_their_part(spark, tmp_path):
    sf = tables(spark, tmp_path, 4_000)
    assert clean_queries.complaints_since(spark, sf).count() > 2_000
    path = feeds_raw.land(spark, sf, "json")
    assert all(a == b for a, b in stretches(path)) and len(readers.read_bulk_complaints(spark, path).select("cmplid").collect()) == 4_001


def test_complaints_by_component_lands_less_than_in_order_of_lines(spark, tmp_path):
    """Parts whose texts are so many that a line seldom finds its part's among those just before."""
    sf = tables(spark, tmp_path / "sf")
    many = spark.range(24_000).selectExpr("id as l_orderkey", "id * 7919 % 2000 as l_partkey", "1 as l_linenumber", "id % 51 as l_quantity", "'R' as l_returnflag", "'O' as l_linestatus",
                                          "0.0D as l_discount", "0.0D as l_tax", "timestamp_ntz'2001-01-01' + make_dt_interval(cast(id % 900 as int)) as l_shipdate")
    many.write.mode("overwrite").parquet(f"{sf}/lineitem.parquet")
    names = spark.range(2_000).selectExpr("id as p_partkey", "concat(md5(cast(id as string)), ' bolt') as p_name", "concat('Brand#', id) as p_brand", "'ECO' as p_type", "10 as p_size")
    names.write.mode("overwrite").parquet(f"{sf}/part.parquet")
    assert clean_queries.complaints_by_component(spark, sf).count() == 24_000
    raw = readers.read_bulk_complaints(spark, feeds_raw.land(spark, sf, "json"))
    feeds_raw.packed(raw.orderBy(F.col("odino").cast("int")).coalesce(1).write).json(str(tmp_path / "lines"))
    landed, lines = (sum(map(os.path.getsize, files(x))) for x in (feeds_raw.land(spark, sf, "json"), tmp_path / "lines"))
    assert landed < 0.7 * lines, (landed, lines)


def test_validate_complaint_meets_every_copy_of_a_part(spark, tmp_path):
    """A part listed twice, and one that most lines have."""
    sf = tables(spark, tmp_path / "first", 600)
    line = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_partkey", F.expr("CASE WHEN l_orderkey < 120 THEN 2 ELSE l_partkey END"))
    part = spark.read.parquet(f"{sf}/part.parquet").withColumn("p_size", F.expr("CASE p_partkey WHEN 1 THEN 49 WHEN 2 THEN 50 ELSE 10 END"))
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    part.union(part.where("p_partkey = 1")).write.parquet(f"{tmp_path}/part.parquet")
    got = [r.errors for r in clean_queries.validate_complaint(spark, str(tmp_path)).collect()]
    good = [r.l_partkey for r in line.collect() if r.l_tax < 0.07]
    assert got.count("Invalid year: 9999") == good.count(2) > 300 and got.count("Invalid year: 0") == 2 * good.count(1) > 20 and len(set(got)) == 2
    assert all(a == b for a, b in stretches(feeds_raw.land(spark, str(tmp_path), "json")))


def test_count_where_and_the_other_feeds_have_records_in_order_of_their_part(spark, tmp_path):
    sf = tables(spark, tmp_path / "first", 4_000)
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{sf}/part.parquet").withColumn("p_size", F.expr("CASE WHEN p_partkey = 3 THEN 50 ELSE 10 END")).write.parquet(f"{tmp_path}/part.parquet")
    want = sum(r.l_returnflag == "R" and r.l_partkey == 3 for r in line.collect())
    assert [tuple(r) for r in clean_queries.count_where(spark, str(tmp_path)).collect()] == [(want,)] and want > 100
    for kind in ("json", "csv", "api"):
        assert all(a == b for a, b in stretches(feeds_raw.land(spark, str(tmp_path), kind))), kind
