"""Spikes, trends, outliers, level shifts and seasonal deviations over weekly series.

Tests that sit on a threshold are made on whole numbers (sums and counts), never on a rounded mean or deviation, so
that a point exactly at the threshold is judged alike on every engine and in every partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outcry.functions.fields import ntz
from outcry.operators.paging import one_row
from outcry.operators.series import ALERT_DAYS, frame, weekly_counts, window_sums

SPIKE_WINDOW, SPIKE_THRESHOLD = 4, 3.0


def _spike_columns(k: int, threshold: float) -> tuple[Column, Column, Column]:
    """(is spike, z, expected) against the k points before."""
    c, s, q = window_sums(-k, -1)
    v = F.col("v").cast("double")
    spread, lead = c * q - s * s, c * v - s
    hit = (F.col("i") >= k) & (spread > 0) & (lead > 0) & (lead * lead > threshold * threshold * spread)
    return hit, F.coalesce(F.try_divide(lead, F.sqrt(F.greatest(spread, F.lit(0.0)))), F.lit(0.0)), F.try_divide(s, c)


def detect_spikes(series: DataFrame, k: int = SPIKE_WINDOW, threshold: float = SPIKE_THRESHOLD) -> DataFrame:
    """Points more than ``threshold`` deviations above the mean of the ``k`` points before."""
    hit, z, expected = _spike_columns(k, threshold)
    return (series.withColumns({"hit": hit, "z": z, "expected": expected}).where("hit")
            .select("key", "wk", "v", "i", "z", "expected"))


def linear_trend(series: DataFrame, strict_fit: bool = False) -> DataFrame:
    """Least squares of the value on its position, one row per group.

    A perfect fit has no residual and is reported with p = 0.5; ``strict_fit=True`` gives it p = 0.01 instead.
    """
    v, i = F.col("v").cast("double"), F.col("i").cast("double")
    sums = series.groupBy("key").agg(
        F.count("*").cast("double").alias("n"), F.sum(i).alias("si"), F.sum(v).alias("sv"),
        F.sum(i * i).alias("sii"), F.sum(v * v).alias("svv"), F.sum(i * v).alias("siv"),
    )
    return fit_from_sums(sums, strict_fit)


def fit_from_sums(sums: DataFrame, strict_fit: bool = False) -> DataFrame:
    """Slope, intercept, r2 and p band from ``n, si, sv, sii, svv, siv``."""
    n = F.col("n")
    a = n * F.col("siv") - F.col("si") * F.col("sv")
    b = n * F.col("sii") - F.col("si") * F.col("si")
    c = n * F.col("svv") - F.col("sv") * F.col("sv")
    rest = F.col("b") * F.col("c") - F.col("a") * F.col("a")
    t2 = (n - 2) * F.col("a") * F.col("a")
    long_enough = n >= 3
    perfect = F.lit(0.01) if strict_fit else F.lit(0.5)
    band = (F.when(~long_enough, 1.0)
            .when((F.col("c") <= 0), 0.5)
            .when(rest <= 0, perfect)
            .when(t2 > 6.25 * rest, 0.01).when(t2 > 4.0 * rest, 0.05).when(t2 > 2.25 * rest, 0.1).otherwise(0.5))
    return (
        sums.withColumns({"a": a, "b": b, "c": c})
        .select(
            *[col for col in sums.columns if col not in ("n", "si", "sv", "sii", "svv", "siv")],
            n.cast("long").alias("n"),
            F.when(long_enough, F.col("a") / F.nullif(F.col("b"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("slope"),
            F.when(long_enough, (F.col("sv") - F.col("a") / F.nullif(F.col("b"), F.lit(0.0)) * F.col("si")) / n)
            .otherwise(F.lit(0.0)).alias("intercept"),
            F.when(long_enough & (F.col("c") > 0), F.col("a") * F.col("a") / F.nullif(F.col("b") * F.col("c"), F.lit(0.0)))
            .otherwise(F.lit(0.0)).alias("r2"),
            band.alias("p_value"),
        )
    )


def trend_direction(fit: DataFrame) -> DataFrame:
    """Direction, confidence and score of a fitted trend."""
    slope, r2, p, n = F.col("slope"), F.col("r2"), F.col("p_value"), F.col("n")
    return fit.withColumns({
        "direction": F.when((n >= 3) & (p < 0.1) & (slope > 0.5), "INCREASING")
        .when((n >= 3) & (p < 0.1) & (slope < -0.5), "DECREASING").otherwise("STABLE"),
        "confidence": F.when((n >= 3) & (r2 > 0.7) & (p < 0.05), "HIGH")
        .when((n >= 3) & (r2 > 0.4) & (p < 0.1), "MEDIUM").otherwise("LOW"),
        "trend_score": trend_score(slope, r2),
    })


def trend_score(slope: Column, r2: Column) -> Column:
    return slope * r2 * 10


def trend_spikes(series: DataFrame, threshold: float = SPIKE_THRESHOLD) -> DataFrame:
    """Spikes with a window that shrinks on short series: half the length, four at most."""
    return _mark_spikes(series, threshold).where("hit").select("key", "wk", "v", "i", "z", "expected")


def _mark_spikes(series: DataFrame, threshold: float) -> DataFrame:
    hits = {k: _spike_columns(k, threshold) for k in (2, 3, 4)}
    k = F.least(F.lit(4), F.floor(F.col("n") / 2)).cast("int")

    def pick(part: int) -> Column:
        return F.when(k == 2, hits[2][part]).when(k == 3, hits[3][part]).when(k == 4, hits[4][part])

    return series.withColumns({"hit": F.coalesce(pick(0), F.lit(False)), "z": pick(1), "expected": pick(2)})


def pattern_trends(patterns: DataFrame, complaints: DataFrame, as_of, *, pattern_key: str = "pattern_id",
                   key: str = "cluster_id", days: int = 84, threshold: float = SPIKE_THRESHOLD,
                   strict_fit: bool = False) -> DataFrame:
    """Trend of every pattern in one plan; a pattern without recent complaints is STABLE with zeros."""
    series = weekly_counts(complaints, as_of, key=key, days=days)
    marked = _mark_spikes(series, threshold)
    v, i = F.col("v").cast("double"), F.col("i").cast("double")
    sums = marked.groupBy("key").agg(
        F.count("*").cast("double").alias("n"), F.sum(i).alias("si"), F.sum(v).alias("sv"),
        F.sum(i * i).alias("sii"), F.sum(v * v).alias("svv"), F.sum(i * v).alias("siv"),
        F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct("wk", "v", "z", "expected")))).alias("spikes"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("weekly_values"),
    )
    trends = trend_direction(fit_from_sums(sums, strict_fit))
    return (
        patterns.join(trends, F.col(pattern_key) == F.col("key"), "left").drop("key")
        .withColumns({
            "n": F.coalesce("n", F.lit(0)), "slope": F.coalesce("slope", F.lit(0.0)),
            "intercept": F.coalesce("intercept", F.lit(0.0)), "r2": F.coalesce("r2", F.lit(0.0)),
            "p_value": F.coalesce("p_value", F.lit(1.0)), "direction": F.coalesce("direction", F.lit("STABLE")),
            "confidence": F.coalesce("confidence", F.lit("LOW")), "trend_score": F.coalesce("trend_score", F.lit(0.0)),
            "spike_count": F.coalesce(F.size("spikes"), F.lit(0)),
        })
    )


def with_quartiles(series: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """Adds lower and upper bounds from the values at ranks n/4 and 3n/4 (0-based, no interpolation)."""
    ranked = series.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("v", "i")) - 1)
    by_key = W.partitionBy("key")
    q1 = F.max(F.when(F.col("r") == F.floor(F.col("n") * 0.25), F.col("v"))).over(by_key).cast("double")
    q3 = F.max(F.when(F.col("r") == F.floor(F.col("n") * 0.75), F.col("v"))).over(by_key).cast("double")
    bounded = ranked.withColumns({"q1": q1, "q3": q3}).drop("r")
    spread = multiplier * (F.col("q3") - F.col("q1"))
    return bounded.withColumns({"lower_bound": F.col("q1") - spread, "upper_bound": F.col("q3") + spread})


def _outlier() -> Column:
    return (F.col("n") >= 4) & ((F.col("v") < F.col("lower_bound")) | (F.col("v") > F.col("upper_bound")))


def iqr_outliers(series: DataFrame, multiplier: float = 1.5) -> DataFrame:
    return (with_quartiles(series, multiplier).where(_outlier())
            .select("key", "wk", "v", "i", "lower_bound", "upper_bound"))


def level_shifts(series: DataFrame, k: int = 4, min_change: float = 50.0) -> DataFrame:
    """Points where the mean of the next ``k`` values differs from the mean of the ``k`` before by ``min_change`` %."""
    _, before, _ = window_sums(-k, -1)
    _, after, _ = window_sums(0, k - 1)
    return (
        series.withColumns({"before": before, "after": after})
        .where((F.col("n") >= 2 * k) & (F.col("i") >= k) & (F.col("i") <= F.col("n") - k) & (F.col("before") != 0))
        .where(F.abs(F.col("after") - F.col("before")) * 100 >= min_change * F.abs(F.col("before")))
        .select("key", "wk", "i", (F.col("before") / k).alias("before_mean"), (F.col("after") / k).alias("after_mean"),
                ((F.col("after") - F.col("before")) / F.col("before") * 100).alias("change_percent"))
    )


def seasonal_outliers(series: DataFrame, season_length: int = 52, threshold: float = 3.0) -> DataFrame:
    """Points far from the mean of their season (position modulo ``season_length``), by sample deviation."""
    season = F.pmod(F.col("i"), F.lit(season_length))
    w = W.partitionBy("key", "season")
    v = F.col("v").cast("double")
    full = series.withColumn("season", season).where(F.col("n") >= 2 * season_length)
    full = full.withColumns({"c": F.count("*").over(w).cast("double"), "s": F.sum(v).over(w), "q": F.sum(v * v).over(w)})
    spread = F.col("c") * F.col("q") - F.col("s") * F.col("s")
    lead = F.col("c") * v - F.col("s")
    z = F.try_divide(lead, F.sqrt(F.try_divide(spread * F.col("c"), F.col("c") - 1)))
    return (
        full.where((F.col("c") > 1) & (spread > 0))
        .where((F.col("c") - 1) * lead * lead > threshold * threshold * F.col("c") * spread)
        .select("key", "wk", "v", "i", "season", (F.col("s") / F.col("c")).alias("expected"), z.alias("deviation"))
    )


def classify_anomaly(v: Column, prev_sum: Column, prev_count: Column, next_sum: Column, next_count: Column,
                     related: Column | None = None) -> Column:
    related = F.lit(0) if related is None else related
    avg_prev = F.when(prev_count > 0, prev_sum / F.nullif(prev_count, F.lit(0.0))).otherwise(F.lit(0.0))
    avg_next = next_sum / F.nullif(next_count, F.lit(0.0))
    shift = (next_count >= 3) & (avg_next > avg_prev * 2) & (F.abs(avg_next - v) < v * 0.3)
    return F.when(related >= 3, "COLLECTIVE").when(F.coalesce(shift, F.lit(False)), "LEVEL_SHIFT").otherwise("SPIKE")


def detect_anomalies(series: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """Outliers with what was expected, how far off they are, and their kind.

    Expected is the mean of the four points before, or of all points before while there are fewer, or 0.
    """
    c4, s4, q4 = window_sums(-4, -1)
    c3, s3, _ = window_sums(1, 3)
    v = F.col("v").cast("double")
    everything = W.partitionBy("key").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    all_mean = F.try_divide(F.sum(v).over(everything), F.count("v").over(everything))
    mean4 = F.when(F.col("i") >= 4, F.try_divide(s4, c4))
    sd4 = F.when(F.col("i") >= 4, F.try_divide(F.sqrt(F.greatest(c4 * q4 - s4 * s4, F.lit(0.0))), c4))
    expected = F.coalesce(F.nullif(mean4, F.lit(0.0)), F.nullif(all_mean, F.lit(0.0)), F.lit(0.0))
    deviation = (v - F.col("expected")) / F.coalesce(F.nullif(F.col("sd4"), F.lit(0.0)), F.lit(1.0))
    return (
        with_quartiles(series, multiplier)
        .withColumns({"expected": expected, "sd4": sd4, "kind": classify_anomaly(v, s4, c4, s3, c3)})
        .where(_outlier())
        .select("key", "wk", "v", "i", "expected", deviation.alias("deviation"), F.col("kind").alias("type"))
    )


def anomaly_alerts(patterns: DataFrame, complaints: DataFrame, as_of, *, pattern_key: str = "pattern_id",
                   key: str = "cluster_id", days: int = ALERT_DAYS) -> DataFrame:
    """One alert per active pattern with an anomaly, with the advice that its worst anomaly calls for."""
    found = detect_anomalies(weekly_counts(complaints, as_of, key=key, days=days))
    per_key = found.groupBy("key").agg(
        F.bool_or(F.col("type") == "LEVEL_SHIFT").alias("shifted"),
        F.bool_or((F.col("type") == "SPIKE") & (F.col("deviation") > 5)).alias("spiked"),
        F.count("*").alias("anomaly_count"),
        F.array_sort(F.collect_list(F.struct("wk", "v", "expected", "deviation", "type"))).alias("anomalies"),
    )
    action = F.when(F.col("shifted"), "Investigate sustained increase in complaints") \
        .when(F.col("spiked"), "Urgent review needed - significant spike detected").otherwise("Monitor closely")
    return (
        patterns.where("is_active").join(per_key, F.col(pattern_key) == F.col("key"))
        .select(F.col(pattern_key), "name", F.coalesce("severity_score", F.lit(0.0)).alias("severity"),
                "anomaly_count", action.alias("recommended_action"), "anomalies")
    )


def pattern_anomalies(complaints: DataFrame, pattern_id, as_of, *, weeks: int = 12, key: str = "cluster_id") -> DataFrame:
    """Anomalies in the last ``weeks`` of one pattern, or of every pattern where ``pattern_id`` is None."""
    only = complaints if pattern_id is None else complaints.where(F.col(key) == pattern_id)
    return detect_anomalies(weekly_counts(only, as_of, key=key, days=weeks * 7))


def global_daily_analysis(complaints: DataFrame, as_of, *, days: int = ALERT_DAYS, id_col: str = "source_id",
                          date: str = "date_added", min_points: int = 11) -> DataFrame:
    """Trend and outlier count over the sequence of all recent complaints, in time order.

    The sequence is ordered by (day, md5 of the id, id, value). Equal rows are folded into runs first; a run's place
    comes from counts per day and per md5 slice of a day, so no window ever spans more than one slice and a day with a
    third of all rows is spread over 4096 of them.
    """
    value = (F.col("injuries") + F.col("deaths") * 10 + F.when(F.col("crash"), 5).otherwise(0)
             + F.when(F.col("fire"), 5).otherwise(0)).cast("long")
    rows = complaints.where(F.col(date) >= ntz(as_of) - F.expr(f"interval {int(days)} days")).select(
        F.col(date).alias("d"), F.md5(F.col(id_col).cast("string")).alias("h"), F.col(id_col).alias("id"),
        value.alias("v"))
    runs = rows.groupBy("d", F.substring("h", 1, 3).alias("slice"), "h", "id", "v").agg(F.count("*").alias("c"))
    per_slice = runs.groupBy("d", "slice").agg(F.sum("c").alias("slice_rows"))
    per_day = per_slice.groupBy("d").agg(F.sum("slice_rows").alias("day_rows"))
    before_day = per_day.select("d", (F.sum("day_rows").over(W.orderBy("d")) - F.col("day_rows")).alias("day_start"))
    starts = per_slice.join(before_day, "d").select(
        "d", "slice", (F.col("day_start") - F.col("slice_rows")
                       + F.sum("slice_rows").over(W.partitionBy("d").orderBy("slice"))).alias("start"))
    inside = F.sum("c").over(W.partitionBy("d", "slice").orderBy("h", "id", "v")) - F.col("c")
    placed = runs.withColumn("off", inside).join(starts, ["d", "slice"])
    c, v, first = (F.col(x).cast("double") for x in ("c", "v", "first"))
    sums = placed.withColumn("first", F.col("start") + F.col("off")).agg(
        F.coalesce(F.sum(c), F.lit(0.0)).alias("n"),
        F.sum(c * first + c * (c - 1) / 2).alias("si"), F.sum(c * v).alias("sv"),
        F.sum(c * first * first + first * c * (c - 1) + (c - 1) * c * (2 * c - 1) / 6).alias("sii"),
        F.sum(c * v * v).alias("svv"), F.sum(v * (c * first + c * (c - 1) / 2)).alias("siv"),
    )
    fit = trend_direction(fit_from_sums(sums))
    outliers = _histogram_outliers(runs.groupBy("v").agg(F.sum("c").alias("c")))
    enough = F.col("n") >= min_points
    return one_row(fit, outliers).select(
        F.col("n").alias("complaints_analyzed"),
        F.when(enough, F.col("direction")).otherwise("STABLE").alias("trend_direction"),
        F.when(enough, F.col("slope")).otherwise(F.lit(0.0)).alias("trend_slope"),
        F.when(enough, F.coalesce("outliers", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("anomaly_count"),
    )


def _histogram_outliers(histogram: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """Outlier count from (value, count); the histogram has one row per distinct score, a few hundred at most."""
    up_to = F.sum("c").over(W.orderBy("v"))
    h = histogram.withColumns({"hi": up_to, "n": F.sum("c").over(W.partitionBy())})

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("hi")) & (rank >= F.col("hi") - F.col("c")), F.col("v"))).over(W.partitionBy())

    h = h.withColumns({"q1": at(F.floor(F.col("n") * 0.25)), "q3": at(F.floor(F.col("n") * 0.75))})
    spread = multiplier * (F.col("q3") - F.col("q1"))
    return h.agg(F.sum(F.when((F.col("v") < F.col("q1") - spread) | (F.col("v") > F.col("q3") + spread), F.col("c"))
                       .otherwise(0)).alias("outliers"))
