"""Golden series and what the detectors must say about them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import START, complaint_rows, rows, series_frame
from outcry.operators import detect, scoring, series

RISING, WAVY = [10, 12, 15, 18, 22, 25, 30], [10, 11, 10, 11, 10, 11, 10]


def test_rolling_stats(spark):
    s = series_frame(spark, a=[10, 12, 11, 15, 20, 18, 25, 30], b=[1, 2])
    got = {(r["key"], r["i"]): (r["mean"], r["std_dev"]) for r in series.rolling_stats(s, 4).collect()}
    assert [got["a", i][0] for i in range(4)] == [None, None, None, 12.0]
    assert got["a", 3][1] == pytest.approx(1.8708286933869707)
    assert got["b", 0] == got["b", 1] == (None, None)


def test_z_score(spark):
    df = spark.createDataFrame([(15.0, 10.0, 2.0), (15.0, 10.0, 0.0), (5.0, 10.0, 2.0)], "v double, m double, s double")
    z = df.select(series.z_score(F.col("v"), F.col("m"), F.col("s")).alias("z"))
    assert [r["z"] for r in z.collect()] == [2.5, 0.0, -2.5]


def test_spikes(spark):
    s = series_frame(spark, hit=[10, 12, 11, 10, 50], calm=[10, 11, 10, 12, 11], drop=[50, 51, 50, 52, 1], flat=[5, 5, 5, 5, 9])
    got = detect.detect_spikes(s).collect()
    assert [(r["key"], r["wk"]) for r in got] == [("hit", START + dt.timedelta(weeks=4))]
    assert got[0]["z"] > 3 and got[0]["expected"] == 10.75


def test_point_at_the_threshold_is_no_spike(spark):
    # mean 2, deviation 1: 5 is exactly three deviations above.
    s = series_frame(spark, edge=[1, 3, 1, 3, 5], over=[1, 3, 1, 3, 6])
    assert [r["key"] for r in detect.detect_spikes(s).collect()] == ["over"]


def test_trend_direction(spark):
    s = series_frame(spark, up=RISING, down=RISING[::-1], flat=WAVY, short=[10, 11], line=[1, 2, 3, 4, 5])
    got = {r["key"]: r for r in detect.trend_direction(detect.linear_trend(s)).collect()}
    assert got["up"]["direction"] == "INCREASING" and got["up"]["p_value"] < 0.05 and got["up"]["confidence"] == "HIGH"
    assert got["down"]["direction"] == "DECREASING"
    assert got["flat"]["direction"] == "STABLE"
    assert (got["short"]["direction"], got["short"]["confidence"], got["short"]["p_value"]) == ("STABLE", "LOW", 1.0)
    # A perfect line has no residual; by default that counts as no evidence.
    assert got["line"]["direction"] == "STABLE" and got["line"]["r2"] == 1.0
    strict = {r["key"]: r for r in detect.trend_direction(detect.linear_trend(s, strict_fit=True)).collect()}
    assert strict["line"]["direction"] == "INCREASING"


def test_trend_score(spark):
    df = spark.range(1).select(detect.trend_score(F.lit(2.5), F.lit(0.85)).alias("a"), detect.trend_score(F.lit(-2.5), F.lit(0.85)).alias("b"))
    assert tuple(df.first()) == (pytest.approx(21.25), pytest.approx(-21.25))


def test_pattern_trends(spark):
    c = complaint_rows(spark, {"p1": [10, 12, 15, 20, 25]})
    patterns = spark.createDataFrame([("p1",), ("p2",)], "pattern_id string")
    got = {r["pattern_id"]: r for r in detect.pattern_trends(patterns, c, "2024-03-31").collect()}
    assert got["p1"]["direction"] == "INCREASING" and got["p1"]["slope"] == pytest.approx(3.8)
    assert got["p1"]["r2"] == pytest.approx(0.96783, abs=1e-5) and got["p1"]["weekly_values"] == [10, 12, 15, 20, 25]
    assert (got["p2"]["direction"], got["p2"]["trend_score"], got["p2"]["confidence"]) == ("STABLE", 0.0, "LOW")


def test_iqr_outliers(spark):
    s = series_frame(spark, hit=[10, 11, 10, 12, 11, 10, 100], calm=[10, 11, 12, 11, 10, 12, 11, 10], short=[1, 2, 100])
    assert rows(detect.iqr_outliers(s), "key", "i", "v") == [("hit", 6, 100)]


def test_level_shift(spark):
    s = series_frame(spark, up=[10, 11, 10, 12, 50, 52, 48, 51], flat=[10] * 8, short=[1, 1, 1, 1, 50, 50, 50])
    got = detect.level_shifts(s).collect()
    assert [(r["key"], r["i"]) for r in got] == [("up", 4)] and got[0]["change_percent"] > 100


def test_seasonal(spark):
    values = [10, 20, 30, 40] * 12
    values[20] = 90
    got = detect.seasonal_outliers(series_frame(spark, a=values, b=values[:7]), 4).collect()
    assert [(r["key"], r["i"], r["season"]) for r in got] == [("a", 20, 0)]


@pytest.mark.parametrize("v, prev, after, related, kind", [
    (100, [10, 11, 10, 12], [11, 10, 12], 0, "SPIKE"),
    (50, [10, 11, 10, 12], [48, 52, 50], 0, "LEVEL_SHIFT"),
    (50, [10, 11, 10, 12], [48, 52, 50], 3, "COLLECTIVE"),
    (50, [], [48, 52, 50], 0, "LEVEL_SHIFT"),
    (50, [10], [48, 52], 0, "SPIKE"),
])
def test_classify(spark, v, prev, after, related, kind):
    c = detect.classify_anomaly(*[F.lit(float(x)) for x in (v, sum(prev), len(prev), sum(after), len(after))], F.lit(related))
    assert spark.range(1).select(c).first()[0] == kind


def test_detect_anomalies(spark):
    got = detect.detect_anomalies(series_frame(spark, a=[10, 11, 100, 12, 10])).collect()
    assert [(r["i"], r["type"], r["expected"], r["deviation"]) for r in got] == [(2, "SPIKE", 10.5, 89.5)]


def test_anomaly_alerts_by_severity(spark):
    c = complaint_rows(spark, {"p1": [10, 10, 11, 10, 100], "p2": [5, 6, 5, 6, 5], "p3": [10, 10, 11, 10, 100]})
    patterns = spark.createDataFrame([("p1", "one", 100.0, True), ("p2", "two", 50.0, True), ("p3", "off", 1.0, False)],
                                     "pattern_id string, name string, severity_score double, is_active boolean")
    got = detect.anomaly_alerts(patterns, c, "2024-03-31").collect()
    assert [r["pattern_id"] for r in got] == ["p1"]
    assert got[0]["recommended_action"] == "Urgent review needed - significant spike detected"


def test_weekly_counts_gaps_and_zone(spark):
    c = complaint_rows(spark, {"a": [3, 0, 2]})
    closed = rows(series.weekly_counts(c, "2024-03-31"), "v", "i", "n")
    assert closed == [(2, 1, 2), (3, 0, 2)]
    filled = rows(series.weekly_counts(c, "2024-03-31", fill_gaps=True), "i", "v", "n")
    assert filled == [(0, 3, 3), (1, 0, 3), (2, 2, 3)]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert rows(series.weekly_counts(c, "2024-03-31"), "v", "i", "n") == closed
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_series_does_not_depend_on_partitions(spark):
    random.seed(1)
    c = complaint_rows(spark, {k: [random.randint(0, 9) for _ in range(12)] for k in "abcde"})
    plain = rows(detect.detect_anomalies(series.weekly_counts(c, "2024-03-31")), "key", "i", "expected", "deviation", "type")
    mixed = c.repartition(13).orderBy(F.rand(3))
    assert rows(detect.detect_anomalies(series.weekly_counts(mixed, "2024-03-31")), "key", "i", "expected", "deviation", "type") == plain


def test_global_analysis_matches_a_plain_loop(spark):
    import hashlib

    random.seed(2)
    data = []
    for n in range(400):
        # A third of all rows on one day, and copies of one id.
        day = dt.datetime(2024, 3, 1) if n % 3 == 0 else dt.datetime(2024, 1, 10) + dt.timedelta(days=n % 60)
        data.append((f"id{n % 350}", day, random.random() < 0.3, random.random() < 0.1, random.choice([0, 0, 0, 1, 5]), random.choice([0] * 9 + [2])))
    df = spark.createDataFrame(data, "source_id string, date_added timestamp_ntz, crash boolean, fire boolean, injuries int, deaths int")
    got = detect.global_daily_analysis(df, "2024-03-31").first()
    points = sorted((d, hashlib.md5(i.encode()).hexdigest(), i, inj + 10 * dead + 5 * c + 5 * f) for i, d, c, f, inj, dead in data)
    v = [p[3] for p in points]
    n = len(v)
    mx, my = (n - 1) / 2, sum(v) / n
    slope = sum((i - mx) * (x - my) for i, x in enumerate(v)) / sum((i - mx) ** 2 for i in range(n))
    q = sorted(v)
    q1, q3 = q[int(n * 0.25)], q[int(n * 0.75)]
    out = sum(x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1) for x in v)
    assert got["complaints_analyzed"] == n and got["anomaly_count"] == out
    assert got["trend_slope"] == pytest.approx(slope, rel=1e-9)


# ---- scores -------------------------------------------------------------------------------------------------------


def scored_frame(spark, data):
    return spark.createDataFrame(data, "pattern_id string, is_active boolean, score double")


@pytest.mark.parametrize("weights, metrics, score", [
    (None, (2, 10, 50, 5, 100, 3.0), 1090),
    ({"deaths": 200, "injuries": 40, "crashes": 20, "fires": 30, "complaint_count": 2, "trend_score": 10}, (1, 5, 10, 2, 50, 2.0), 780),
])
def test_weighted_score(spark, weights, metrics, score):
    df = spark.createDataFrame([metrics], "deaths int, injuries int, crashes int, fires int, complaint_count int, trend_score double")
    assert df.select(scoring.weighted_score(weights)).first()[0] == score


def test_rank_and_percentile(spark):
    df = scored_frame(spark, [("p1", True, 10.0), ("p2", True, 500.0), ("p3", True, 100.0), ("off", False, 999.0)])
    assert [(r["pattern_id"], r["rank"]) for r in scoring.rank_patterns(df).orderBy("rank").collect()] == [("p2", 1), ("p3", 2), ("p1", 3)]
    got = {r["pattern_id"]: (r["rank"], r["percentile"], r["total_patterns"]) for r in scoring.relative_severity(df).collect()}
    assert got == {"p2": (1, 100, 3), "p3": (2, 67, 3), "p1": (3, 33, 3)}


def test_percentile_over_equal_scores(spark):
    df = scored_frame(spark, [(f"p{i:03d}", True, 5.0 if i % 3 == 0 else float(i)) for i in range(300)])
    got = scoring.relative_severity(df).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 301))
    assert [r["pattern_id"] for r in got] == [r["pattern_id"] for r in df.orderBy(F.desc("score"), "pattern_id").collect()]
