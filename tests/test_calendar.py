"""Business days against a plain walk over days; fingerprints against reordering, change and repetition."""

import datetime as dt

from pyspark.sql import functions as F

from poolwise.operators import calendar, fingerprints

ORIGIN = "2024-02-07 06:30:00"


def plain_workday(day, changes):
    rule = None
    for since, business in sorted(changes, key=lambda c: c[0]):
        if since <= day:
            rule = business
    return int(day.weekday() < 5) if rule is None else int(rule)


CHANGES = [("2024-02-04", True), ("2024-02-05", None), ("2024-02-10", False), ("2024-02-18", True), ("2024-02-19", None), ("2024-03-30", False)]


def table(spark, rows=CHANGES):
    return spark.createDataFrame([(dt.date.fromisoformat(d), b) for d, b in rows], "from_day date, business boolean")


def test_categories_follow_the_table(spark):
    changes = [(dt.date.fromisoformat(d), b) for d, b in CHANGES]
    seconds = [x * 5400.0 - 400_000 for x in range(1200)]
    rows = spark.createDataFrame([(s,) for s in seconds], "t double")
    origin = dt.datetime.fromisoformat(ORIGIN)
    for given, rule in ((table(spark), changes), (None, []), (table(spark, []), [])):
        got = {r.t: (r.workday, r.weekday, r.hour) for r in calendar.time_categories(rows, "t", ORIGIN, given).collect()}
        for s in seconds:
            at = origin + dt.timedelta(seconds=s)
            assert got[s] == (plain_workday(at.date(), rule), at.weekday(), at.hour)
    flags = {r.day_index: r.workday for r in calendar.day_flags(-3, 60, ORIGIN, table(spark)).collect()}
    assert flags == {k: plain_workday(origin.date() + dt.timedelta(days=k), changes) for k in range(-3, 61)}


def test_two_changes_on_a_day(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 6),), (dt.date(2024, 1, 8),)], "day date")
    both = table(spark, [("2024-01-06", True), ("2024-01-06", False), ("2024-01-08", None)])
    assert {(r.day.day, r.workday) for r in calendar.business_days(days, both).collect()} == {(6, 0), (8, 1)}


def test_fingerprints_tell_multisets_apart(spark):
    def of(values):
        text = fingerprints.canonical_text({"a": F.col("a"), "b": F.col("b")})
        return spark.createDataFrame(values, "a string, b long").repartition(3).agg(fingerprints.multiset_fingerprint(text).alias("f")).first().f

    rows = [("x", 1), ("y", 2), (None, 3), ("", None)]
    assert of(rows) == of(rows[::-1])
    for other in (rows[:-1], rows + rows, [*rows, ("x", 1)], [("x", 2), ("y", 1), *rows[2:]], [("x", 1), ("y", 2), ("", 3), (None, None)], [*rows, ("z", 1), ("z", 1)]):
        assert of(other) != of(rows)
    assert of([*rows, ("z", 1), ("z", 1)]) != of([*rows, ("w", 1), ("w", 1)])
