"""As-of joins and orphan references against their definitions."""

import datetime as dt
import random

from tests.conftest import rows
from wardloom.operators import asof, orphans
from pyspark.sql import functions as F

DAY = dt.date(2020, 1, 1)
day = lambda n: DAY + dt.timedelta(days=n)


def test_asof_against_brute_force(spark):
    rng = random.Random(3)
    revisions = []
    for i in range(200):
        s = rng.randint(-800, 800)
        revisions.append((i, rng.choice("abc"), day(s), rng.choice([None, day(s + rng.randint(0, 500))]), day(s + rng.randint(-100, 300))))
    events = [(n, rng.choice("abcd"), day(rng.randint(-1000, 1200))) for n in range(500)]
    want = []
    for n, code, at in events:
        live = [(p, i) for i, c, s, e, p in revisions if c == code and s <= at and (e is None or at <= e) and p <= at]
        if live:
            want.append((n, max(live)[1]))
    known = asof.known_intervals(
        spark.createDataFrame(revisions, "rid long, code string, s date, e date, p date"), "code", "s", "e", "p", ["p", "rid"]
    )
    ev = spark.createDataFrame(events, "n long, code string, at date")
    for size in (30, 366):
        assert rows(asof.asof_join(ev, known, "code", "at", size), "n", "rid") == sorted(want, key=str)


def test_asof_edges(spark):
    schema = "rid long, code string, s date, e date, p date"
    data = [(1, "a", day(0), day(10), day(-5)), (1, "a", day(0), day(10), day(-5)), (2, "a", day(5), day(3), day(0)), (3, None, day(0), None, day(0)), (4, "a", None, None, day(0)), (5, "a", day(0), None, None)]
    known = asof.known_intervals(spark.createDataFrame(data, schema), "code", "s", "e", "p", ["p", "rid"])
    ev = spark.createDataFrame(
        [(1, "a", day(0)), (2, "a", day(10)), (3, "a", day(11)), (4, None, day(1)), (5, "a", None), (6, "a", dt.date(1900, 1, 1)), (1, "a", day(0))],
        "n long, code string, at date",
    )
    assert rows(asof.asof_join(ev, known, "code", "at"), "n", "rid") == [(1, 1), (1, 1), (2, 1)]
    assert asof.asof_join(ev.limit(0), known, "code", "at").count() == 0
    empty = asof.known_intervals(spark.createDataFrame([], schema), "code", "s", "e", "p", ["p", "rid"])
    assert asof.asof_join(ev, empty, "code", "at").count() == 0


def test_asof_clashing_columns(spark):
    known = asof.known_intervals(
        spark.createDataFrame([(1, "a", day(0), None, day(0))], "rid long, code string, s date, e date, p date"), "code", "s", "e", "p", ["p", "rid"]
    )
    ev = spark.createDataFrame([(7, "a", day(3), "x", "y")], "rid long, entity string, at date, from_day string, p string")
    got = asof.asof_join(ev, known, "entity", "at").first().asDict()
    assert got["rid"] == 7 and got["rid_known"] == 1 and got["from_day"] == "x" and got["p"] == "y"


def test_code_key(spark):
    df = spark.createDataFrame([(" i69.3",), ("I693",), ("",), (None,), (" . ",)], "c string")
    assert [r[0] for r in df.select(asof.code_key(F.col("c"))).collect()] == ["I693", "I693", None, None, None]


T = lambda h: dt.datetime(2020, 1, 31, 12) + dt.timedelta(hours=h)


def test_orphan_kinds(spark):
    refs = spark.createDataFrame(
        [(1, " p1 ", T(0)), (2, "P2", T(0)), (3, "P3", T(0)), (4, "P4", T(0)), (5, "", T(0)), (6, None, T(0)), (7, "p9", None), (8, "P3", None), (2, "P2", T(0)), (9, "P5", T(24)), (10, "P6", T(0))],
        "rid long, patient string, at timestamp",
    ).withColumn("key", F.lit("clash"))
    people = spark.createDataFrame(
        [("P1", T(-1), None), ("P3", T(1), None), ("P4", T(-5), T(0)), ("P5", T(0), T(24.5)), ("P6", T(5), None), ("p6", T(-5), None), (None, T(0), None)],
        "patient string, r timestamp, d timestamp",
    )
    key = orphans.text_key(F.col("patient"))
    got = orphans.orphans(orphans.references(refs, "t", "rid", key, "at"), orphans.parents(people, key, "r", "d"))
    assert rows(got) == sorted(
        [("t", 2, "2020-01", "missing"), ("t", 3, "2020-01", "late"), ("t", 4, "2020-01", "deleted"), ("t", 7, None, "missing")], key=str
    )
    assert rows(orphans.orphan_report(got)) == sorted(
        [("t", "2020-01", "missing", 1), ("t", "2020-01", "late", 1), ("t", "2020-01", "deleted", 1), ("t", None, "missing", 1)], key=str
    )
    assert orphans.orphans(orphans.references(refs.limit(0), "t", "rid", key, "at"), orphans.parents(people, key, "r", "d")).count() == 0
    alone = orphans.orphans(orphans.references(refs, "t", "rid", key, "at"), orphans.parents(people.limit(0), key, "r", "d"))
    assert {r["kind"] for r in alone.collect()} == {"missing"} and alone.count() == 8


def test_several_intervals_of_a_key(spark):
    """A key deleted and received again is absent in between; overlaps and repeats change nothing."""
    people = spark.createDataFrame(
        [("a", T(5), T(10)), ("a", T(20), None), ("b", T(0), T(30)), ("b", T(5), T(10)), ("b", T(5), T(10)), ("b", T(5), T(20)), ("c", None, T(3)), ("c", T(3), T(4))],
        "k string, r timestamp, d timestamp",
    )
    at = {1: ("a", 0, "late"), 2: ("a", 5, None), 3: ("a", 10, "deleted"), 4: ("a", 15, "deleted"), 5: ("a", 20, None), 6: ("b", 25, None), 7: ("b", 30, "deleted"), 8: ("c", 1, None), 9: ("c", 3, None), 10: ("c", 4, "deleted")}
    refs = spark.createDataFrame([(i, k, T(h)) for i, (k, h, _) in at.items()] + [(11, "a", None)], "rid long, k string, at timestamp")
    got = orphans.orphans(orphans.references(refs, "t", "rid", F.col("k"), "at"), orphans.parents(people, F.col("k"), "r", "d"))
    assert rows(got, "record_id", "kind") == sorted(((i, kind) for i, (_, _, kind) in at.items() if kind), key=str)


def test_hot_key_and_always_present(spark):
    refs = spark.range(3000).select(F.col("id").alias("rid"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit(T(0)).alias("at"))
    keys = orphans.merge_intervals(
        orphans.parents(spark.createDataFrame([("HOT", T(-1))], "k string, r timestamp"), F.upper("k"), "r"),
        orphans.parents(spark.createDataFrame([("1",), ("2",)], "k string"), F.col("k")),
    )
    got = orphans.orphans(orphans.references(refs, "t", "rid", F.upper("k"), "at"), keys)
    assert got.count() == 2000 - 2
