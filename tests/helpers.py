import datetime as dt

START = dt.date(2024, 1, 7)   # a Sunday


def series_frame(spark, **groups):
    """Weekly series from value lists."""
    from outcry.operators.series import indexed

    rows = [(key, START + dt.timedelta(weeks=i), v) for key, values in groups.items() for i, v in enumerate(values)]
    return indexed(spark.createDataFrame(rows, "key string, wk date, v long"))


def complaint_rows(spark, groups, end=dt.date(2024, 3, 31)):
    """Complaints whose weekly counts per cluster are the given lists, the last week ending before ``end``."""
    rows = []
    for key, values in groups.items():
        for back, count in enumerate(reversed(values)):
            day = dt.datetime.combine(end - dt.timedelta(days=7 * (back + 1)), dt.time())
            rows += [(f"{key}-{back}-{n}", key, day, False, False, 0, 0) for n in range(count)]
    return spark.createDataFrame(
        rows, "source_id string, cluster_id string, date_added timestamp_ntz, crash boolean, fire boolean, injuries int, deaths int")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
