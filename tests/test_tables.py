"""Filters, pages, ingestion, exports, maintenance, feeds and plans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from outcry.operators import feeds, filters, joins, maintain, paging, stats
from outcry.schemas import COMPLAINT
from outcry.sources import readers, sync, writers

DAY = dt.datetime(2024, 1, 1)


def complaint(key, **change):
    base = {"source_id": key, "odi_number": "", "manufacturer": "M", "make": "FORD", "model": "F-150", "model_year": 2020,
            "component": "BRAKES", "description": "Brake pedal", "crash": False, "fire": False, "injuries": 0, "deaths": 0,
            "fail_date": None, "date_added": DAY}
    base.update(change)
    return tuple(base[f] for f in COMPLAINT.names)


@pytest.fixture(scope="module")
def some(spark):
    return spark.createDataFrame([
        complaint("a"), complaint("b", make="Ford", crash=True, model_year=2018), complaint("c", make="TESLA", deaths=2),
        complaint("d", component="ENGINE", injuries=3, fire=True, description=None),
        complaint("e", make="FORDSON", date_added=DAY + dt.timedelta(days=40))], COMPLAINT)


def ids(df):
    return sorted(r["source_id"] for r in df.collect())


def test_loose_search(some):
    s = filters.search_complaints
    assert ids(s(some)) == list("abcde")
    assert ids(s(some, make="ford")) == list("abde")
    assert ids(s(some, year_from=2019, has_crash=False)) == list("acde")
    assert ids(s(some, has_death=True)) == ["c"] and ids(s(some, has_injury=True, has_fire=True)) == ["d"]
    assert ids(s(some, search="ENGINE")) == ["d"] and ids(s(some, search="pedal")) == list("abce")
    assert s(some).columns == filters.LIST_COLUMNS


def test_strict_filter(some):
    f = filters.filter_complaints
    assert ids(f(some, make="ford")) == list("abd")
    assert ids(f(some, year=2018)) == ["b"]
    # A range replaces the exact year.
    assert ids(f(some, year=2018, year_from=2019)) == list("acde")
    assert ids(f(some, crash=False, deaths=False, injuries=False)) == list("ae")
    assert ids(f(some, since="2024-01-15")) == ["e"] and ids(f(some, until="2024-01-15", text="BRAKE")) == list("abc")


def test_severe_order(some):
    df = some.withColumn("cluster_id", F.lit("x"))
    assert [r["source_id"] for r in filters.severe_complaints(df).collect()] == ["c", "d", "b"]


def test_pages(spark):
    df = spark.range(45).withColumn("k", F.col("id") % 5)
    sort = [("k", "desc"), ("id", "asc")]
    everything = [r["id"] for r in df.orderBy(*paging.order_columns(sort)).collect()]
    assert [r["id"] for r in paging.paginate(df, sort, 3, 20).collect()] == everything[40:]
    assert tuple(paging.page_info(df, 2, 20).first()) == (45, 2, 20, 3, True)
    assert tuple(paging.page_info(df.where("id < 0"), 1, 20).first()) == (0, 1, 20, 0, False)
    last = {"k": 3, "id": everything[12]}
    assert [r["id"] for r in paging.page_after(df, sort, last, 10).collect()] == everything[13:23]
    assert paging.clamp_page(0, 1000) == (1, 100)
    with pytest.raises(ValueError):
        paging.paginate(df, sort, 0, 20, strict=True)
    assert paging.sort_spec("x; drop", "asc", ["id"], ("id", "desc")) == ("id", "desc")


def test_top_per_group_moves_little(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 3))
    top = paging.top_per_group(df, "g", [F.desc("id")], 3)
    assert {(r["g"], r["id"]) for r in top.collect()} == {(0, 999), (0, 996), (0, 993), (1, 997), (1, 994), (1, 991), (2, 998), (2, 995), (2, 992)}
    plan = df._jdf.sparkSession().sessionState().executePlan(
        top._jdf.queryExecution().logical(), df._jdf.queryExecution().mode()).executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_priority(spark):
    df = spark.createDataFrame([("info",), ("critical",), ("warning",)], "type string")
    assert [r["type"] for r in paging.by_priority(df).collect()] == ["critical", "warning", "info"]


def test_fallback_patterns(spark):
    have = spark.createDataFrame([("p", "Brake", "F", "M", 3.0)], "pattern_id string, name string, make string, model string, severity_score double")
    spare = spark.createDataFrame([("d", "Engine", "F", "M", 9.0)], have.schema)
    pick = lambda df, **k: [r["pattern_id"] for r in filters.search_patterns(df, defaults=spare, **k).collect()]
    assert pick(have) == ["p"] and pick(have, min_severity=5) == []
    assert pick(have.where("false")) == ["d"] and pick(have.where("false"), search="brake") == []


def test_global_patterns(spark):
    df = spark.createDataFrame([("a", None, 5.0), ("b", "o1", 7.0), ("c", "o2", 1.0)], "pattern_id string, organization_id string, severity_score double")
    got = lambda x: sorted(r["pattern_id"] for r in x.collect())
    assert got(filters.tenant_scope(df, "o1")) == ["b"] and got(filters.tenant_scope(df, "o1", True)) == ["a", "b"]
    assert got(filters.filter_patterns(df, org=None)) == ["a"] and got(filters.filter_patterns(df)) == ["a", "b", "c"]


def test_violations(spark):
    df = spark.createDataFrame([("ADMIN", "users", "delete"), ("ANALYST", "patterns", "update"), ("VIEWER", "patterns", "update"),
                                ("VIEWER", "users", "read")], "role string, resource string, action string")
    assert sorted((r["role"], r["resource"]) for r in filters.access_violations(df).collect()) == [("VIEWER", "patterns"), ("VIEWER", "users")]


def test_cluster_stats(spark):
    df = spark.createDataFrame([("p", dt.datetime(2024, 1, 1), True, False, 1, 0), ("p", dt.datetime(2024, 1, 15), True, True, 2, 1),
                                ("p", dt.datetime(2024, 2, 1), False, False, 0, 0)],
                               "cluster_id string, date_added timestamp_ntz, crash boolean, fire boolean, injuries int, deaths int")
    patterns = spark.createDataFrame([("p",), ("q",)], "pattern_id string")
    got = {r["pattern_id"]: tuple(r)[1:] for r in stats.cluster_stats(patterns, df).collect()}
    assert got == {"p": (3, 2, 1, 3, 1, dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)), "q": (0, 0, 0, 0, 0, None, None)}


def test_salted_join_equals_plain_join(spark):
    big = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("x"))
    small = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    for how in ("inner", "left"):
        a = joins.salted_join(big, small, "k", F.col("x"), how=how).select("k", "x", "y")
        b = big.join(small, "k", how).select("k", "x", "y")
        assert a.count() == b.count() and a.exceptAll(b).isEmpty()


# ---- ingestion ----------------------------------------------------------------------------------------------------


def test_insert_new_first_wins_and_is_repeatable(spark, some):
    batch = spark.createDataFrame([complaint("x", model="late", date_added=DAY + dt.timedelta(days=1)), complaint("x", model="early"),
                                   complaint("a", model="changed"), complaint("y")], COMPLAINT)
    new = sync.insert_new(batch, some)
    assert sorted((r["source_id"], r["model"]) for r in new.collect()) == [("x", "early"), ("y", "F-150")]
    merged = sync.seed_upsert(batch, some)
    assert merged.count() == 7 and sync.insert_new(batch, merged).isEmpty()


def test_sync_without_history(spark):
    from outcry.schemas import RAW_BULK

    def rec(key, day):
        return tuple({"cmplid": key, "datea": day, "maketxt": "ford"}.get(f) for f in RAW_BULK.names)

    raw = spark.createDataFrame([rec("1", "20240110"), rec("2", "20240101"), rec("3", "99")], RAW_BULK)
    new, bad, status = sync.sync_incremental(raw, spark.createDataFrame([], COMPLAINT), "2024-01-12")
    assert [r["source_id"] for r in new.collect()] == ["1"] and [r["source_id"] for r in bad.collect()] == ["3"]
    row = status.first()
    assert (row["total_complaints"], row["errors"], row["new_complaints"]) == (2, 1, 1)
    assert row["last_sync_date"] == dt.datetime(2024, 1, 5)


def test_flat_file_keeps_odd_lines(spark, tmp_path):
    from outcry.schemas import RAW_BULK

    good = "\t".join(f"v{i}" for i in range(len(RAW_BULK.names)))
    (tmp_path / "f.txt").write_text(good + "\nonly\ttwo\n")
    df = readers.read_flat_file(spark, str(tmp_path)).cache()
    assert df.count() == 2 and [r["corrupt_record"] for r in df.where("corrupt_record is not null").collect()] == ["only\ttwo"]


def test_digest_depends_on_rows_only(spark):
    random.seed(4)
    data = [("a", random.randint(0, 50), random.choice("xyz")) for _ in range(500)] + [("a", 1, "x")] * 300
    df = spark.createDataFrame(data, "g string, n int, s string")
    one = writers.integrity_digest(df, ["g"], ["n", "s"]).first()
    two = writers.integrity_digest(df.repartition(11).orderBy(F.rand(5)), ["g"], ["n", "s"]).first()
    fewer = writers.integrity_digest(df.limit(799), ["g"], ["n", "s"]).first()
    assert tuple(one) == tuple(two) and one["records"] == 800 and one["digest"] != fewer["digest"]


def test_export_scope_and_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "o1", dt.datetime(2024, 1, 1), 5), (2, "o1", dt.datetime(2024, 3, 1), 6), (3, "o2", dt.datetime(2024, 1, 1), 5)],
                               "id int, organization_id string, created_at timestamp_ntz, created_by int")
    scope = writers.export_scope(df, "o1", "2024-01-01", "2024-02-01", [5])
    assert [r["id"] for r in scope.collect()] == [1]
    for fmt in ("json", "csv", "parquet"):
        writers.export_result(df, str(tmp_path / fmt), fmt, by="organization_id")
        assert sorted(p.name for p in (tmp_path / fmt).glob("organization_id=*")) == ["organization_id=o1", "organization_id=o2"]
    manifest = writers.export_with_manifest({"docs": (df, ["id"])}, str(tmp_path / "out")).first()
    assert manifest["records"] == 3 and spark.read.json(str(tmp_path / "out" / "docs")).count() == 3


# ---- maintenance --------------------------------------------------------------------------------------------------

EVENT = ("seq long, ts timestamp_ntz, type string, customer string, organization_id string, mode string, subscription string, "
         "price string, status string, period_start long, period_end long, attempts int, next_attempt long")


def bill(seq, kind, customer="c", **change):
    base = dict(seq=seq, ts=DAY + dt.timedelta(minutes=25 * seq), type=kind, customer=customer, organization_id=None, mode=None,
                subscription=None, price=None, status=None, period_start=None, period_end=None, attempts=None, next_attempt=None)
    base.update(change)
    return tuple(base.values())


def checkout(seq, price="price_pro_monthly", **change):
    return bill(seq, maintain.CHECKOUT, organization_id="o", mode="subscription", subscription=f"s{seq}", price=price, **change)


def state_of(spark, *events):
    df = spark.createDataFrame(list(events), EVENT)
    got = maintain.subscription_state(df).collect()
    return {r["customer"]: r for r in got}


def test_checkout_rules(spark):
    assert state_of(spark, checkout(1))["c"].asDict()["plan"] == "PRO"
    assert state_of(spark, checkout(1))["c"]["status"] == "ACTIVE"
    assert state_of(spark, bill(1, maintain.CHECKOUT, organization_id="o", mode="payment", subscription="s")) == {}
    # Nothing counts before the first checkout.
    assert state_of(spark, bill(0, maintain.ENDED), checkout(1))["c"]["plan"] == "PRO"


def test_same_price_does_not_bring_a_plan_back(spark):
    final = bill(2, maintain.FAILED, attempts=4)
    same = bill(3, maintain.CHANGED, status="active", price="price_pro_monthly")
    other = bill(3, maintain.CHANGED, status="active", price="price_basic_monthly", period_start=5)
    assert (state_of(spark, checkout(1), final)["c"]["plan"], state_of(spark, checkout(1), final)["c"]["status"]) == ("FREE", "PAST_DUE")
    assert state_of(spark, checkout(1), final, same)["c"]["plan"] == "FREE"
    assert state_of(spark, checkout(1), final, other)["c"]["plan"] == "BASIC"
    assert state_of(spark, checkout(1), bill(2, maintain.FAILED, attempts=4, next_attempt=9))["c"]["plan"] == "PRO"
    gone = state_of(spark, checkout(1), bill(2, maintain.ENDED))["c"]
    assert (gone["status"], gone["plan"], gone["subscription"]) == ("CANCELED", "FREE", None)


def plain_fold(events):
    """The same state by walking through the events."""
    out = {}
    plan_of = {"price_basic_monthly": "BASIC", "price_pro_monthly": "PRO"}
    status_of = {"active": "ACTIVE", "past_due": "PAST_DUE", "paused": "INACTIVE"}
    for e in sorted(events):
        seq, _, kind, cust, org, mode, sub, price, status, ps, pe, attempts, nxt = e
        s = out.get(cust)
        if kind == maintain.CHECKOUT and mode == "subscription" and org and sub:
            s = out.setdefault(cust, {"org": org, "price": None, "plan": "FREE", "ps": None, "pe": None})
            s.update(status="ACTIVE", sub=sub, price=price or s["price"])
            if price:
                s["plan"] = plan_of[price]
        elif s is None:
            continue
        elif kind == maintain.CHANGED and status:
            if price and price != s["price"]:
                s["plan"] = plan_of[price]
            s.update(status=status_of[status], price=price or s["price"], ps=ps or s["ps"], pe=pe or s["pe"])
        elif kind == maintain.ENDED:
            s.update(status="CANCELED", sub=None, plan="FREE")
        elif kind == maintain.FAILED:
            s["status"] = "PAST_DUE"
            if nxt is None and (attempts or 0) >= 4:
                s["plan"] = "FREE"
    return {c: (s["org"], s["status"], s["price"], s["plan"], s["sub"], s["ps"], s["pe"]) for c, s in out.items()}


def random_events(n=600, seed=9):
    rnd = random.Random(seed)
    out = []
    for seq in range(1, n):
        cust = "hot" if rnd.random() < 0.4 else f"c{rnd.randint(0, 20)}"
        kind = rnd.choice([maintain.CHECKOUT, maintain.CHANGED, maintain.CHANGED, maintain.ENDED, maintain.FAILED, "other"])
        price = rnd.choice([None, "price_basic_monthly", "price_pro_monthly"])
        out.append(bill(seq, kind, cust, organization_id=rnd.choice([f"o-{cust}", None]), mode=rnd.choice(["subscription", "payment"]),
                        subscription=f"s{seq}", price=price, status=rnd.choice(["active", "past_due", "paused", None]),
                        period_start=rnd.choice([None, seq]), period_end=rnd.choice([None, seq]), attempts=rnd.choice([None, 3, 5]),
                        next_attempt=rnd.choice([None, 1])))
    return out


FIELDS = ("organization_id", "status", "price", "plan", "subscription", "period_start", "period_end")


def test_subscription_state_equals_the_fold(spark):
    events = random_events()
    df = spark.createDataFrame(events, EVENT).repartition(9)
    got = {r["customer"]: tuple(r[f] for f in FIELDS) for r in maintain.subscription_state(df).collect()}
    assert got == plain_fold(events)


def test_subscription_state_in_steps(spark):
    events = random_events(seed=10)
    first, second = events[:250], events[250:]
    state = maintain.subscription_state(spark.createDataFrame(first, EVENT))
    # The second step sees old events again: they must not count twice.
    again = maintain.subscription_state(spark.createDataFrame(first[-30:] + second, EVENT), state)
    got = {r["customer"]: tuple(r[f] for f in FIELDS) for r in again.collect()}
    want = plain_fold(events)
    assert {c: v for c, v in got.items()} == want


def test_users_from_events(spark):
    users = spark.createDataFrame([(1, 10, "old@x", "ADMIN")], "user_id int, organization_id int, email string, role string")
    orgs = spark.createDataFrame([(10,), (11,)], "organization_id int")
    ev = spark.createDataFrame([
        (1, maintain.UPDATED, 1, None, "new@x", None), (2, maintain.CREATED, 2, 10, "two@x", "org:admin"),
        (3, maintain.MEMBER, 2, 11, "ignored@x", "org:analyst"), (4, maintain.CREATED, 3, 99, "three@x", None),
        (5, maintain.UPDATED, 4, None, "nobody@x", None), (6, maintain.CREATED, 5, 10, None, None),
        (7, maintain.CREATED, 6, 10, "six@x", None), (8, maintain.DELETED, 6, None, None, None),
        (9, maintain.UPDATED, 6, None, "after@x", None), (10, maintain.MEMBER, 6, 10, "back@x", "org:admin"),
        (11, maintain.CREATED, 1, 11, "again@x", None)],
        "seq long, type string, user_id int, organization_id int, email string, role string")
    got = {r["user_id"]: (r["organization_id"], r["email"], r["role"]) for r in maintain.upsert_users(users, ev, orgs).collect()}
    assert got == {1: (10, "again@x", "ADMIN"), 2: (11, "two@x", "ANALYST"), 6: (10, "back@x", "ADMIN")}


def test_delete_rules(spark):
    docs = spark.createDataFrame([(1, "o1", "DRAFT"), (2, "o1", "FINALIZED"), (3, "o2", "DRAFT")], "document_id int, organization_id string, status string")
    ask = spark.createDataFrame([(1, "o1"), (2, "o1"), (3, "o1"), (9, "o1")], "document_id int, organization_id string")
    left, refused = maintain.delete_document(docs, ask)
    assert sorted(r["document_id"] for r in left.collect()) == [2, 3]
    assert {r["document_id"]: r["reason"] for r in refused.collect()} == {
        2: "Cannot delete finalized document", 3: "Document not found", 9: "Document not found"}


def test_versions(spark, tmp_path):
    df = spark.range(3)
    path = maintain.write_version(df, str(tmp_path), "1")
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception):
        maintain.write_version(df, str(tmp_path), "1")


def test_usage_alerts(spark):
    usage = spark.createDataFrame([("a", "patterns", 95, 100), ("b", "patterns", 80, 100), ("c", "patterns", 10, 100),
                                   ("d", "patterns", 500, -1), ("a", "complaintsPerMonth", 0, 0), ("b", "complaintsPerMonth", 5, 5)],
                                  "organization_id string, resource string, current long, limit int")
    patterns = spark.createDataFrame([("c", 9.0, "INCREASING")] * 7 + [("d", 9.0, "STABLE")],
                                     "organization_id string, severity_score double, trend_direction string")
    docs = spark.createDataFrame([("a", "DRAFT")] * 10 + [("b", "DRAFT")] * 5, "organization_id string, status string")
    got = {(r["organization_id"], r["id"]): r["message"] for r in feeds.dashboard_alerts(usage, patterns, docs).collect()}
    assert set(got) == {("a", "pattern-limit-critical"), ("b", "pattern-limit-warning"), ("b", "complaint-limit-critical"),
                        ("c", "high-severity-patterns"), ("a", "draft-complaints")}
    assert got["a", "pattern-limit-critical"] == "You've used 95 of 100 patterns (95%)"
    assert got["c", "high-severity-patterns"].startswith("7 pattern(s)")


def test_plan_limits(spark):
    orgs = spark.createDataFrame([("a", "FREE"), ("b", "ENTERPRISE")], "organization_id string, plan string")
    users = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "organization_id string, user_id int")
    none = spark.createDataFrame([], "organization_id string, created_at timestamp_ntz")
    got = {(r["organization_id"], r["resource"]): r["allowed"] for r in maintain.plan_usage(orgs, users, none, none, "2024-01-31").collect()}
    assert got["a", "users"] is False and got["a", "patterns"] is True and got["a", "complaintsPerMonth"] is False
    assert all(v for (o, _), v in got.items() if o == "b")
    features = {r["organization_id"]: r for r in maintain.plan_features(orgs).collect()}
    assert features["b"]["prioritySupport"] and not features["a"]["semanticSearch"]


def test_row_numbers_over_one_hot_value(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("v")).repartition(9)
    got = paging.number_rows(df, [("v", "desc"), ("id", "asc")]).collect()
    want = [r["id"] for r in df.orderBy(F.desc("v"), "id").collect()]
    assert [r["id"] for r in sorted(got, key=lambda r: r["row_no"])] == want
    assert sorted(r["row_no"] for r in got) == list(range(1, 5001)) and {r["total"] for r in got} == {5000}
