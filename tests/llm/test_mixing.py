"""Water-filling and sampling against their definitions."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from wardloom.llm import mixing

amounts = st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.floats(0, 1), st.integers(0, 1000)), min_size=1)


@given(amounts, st.floats(0, 3000))
def test_fill_is_feasible_and_proportional(sources, total):
    weights = {s: w for s, (w, _) in sources.items()}
    limits = {s: float(n) for s, (_, n) in sources.items()}
    plan = mixing.fill(weights, limits, total)
    assert all(-1e-9 <= plan[s] <= limits[s] + 1e-6 for s in plan)
    room = sum(limits[s] for s in plan if weights[s] > 0)
    assert sum(plan.values()) == pytest.approx(min(total, room), abs=1e-4 * max(1, total))
    free = [s for s in plan if weights[s] > 1e-6 and plan[s] < limits[s] - 1e-6]
    rates = [plan[s] / weights[s] for s in free]
    assert not rates or max(rates) == pytest.approx(min(rates), rel=1e-6)


def frames(spark):
    docs = [(i, "big", 10) for i in range(4000)] + [(10_000 + i, "small", 7 + i % 3) for i in range(100)]
    docs += [(20_000 + i, None, 5) for i in range(10)] + [(30_000, "big", 0), (1, "big", 10)]
    weights = [("Big", 0.5, 1), ("small ", 0.4, 3), ("absent", 0.1, 2), (None, 0.3, 1)]
    return (
        spark.createDataFrame(docs, "id long, source string, tokens long"),
        spark.createDataFrame(weights, "source string, target_share double, max_repeats int"),
    )


def test_mixture_and_report(spark):
    docs, weights = frames(spark)
    used, report = mixing.mix(docs, weights, total=5000)
    got = {r["source"]: r for r in report.collect()}
    assert got["small"]["planned_tokens"] == 5000 * 4 // 9 or got["small"]["most_copies"] <= 3
    assert abs(got["big"]["mixed_tokens"] - got["big"]["planned_tokens"]) <= 10
    assert got["absent"]["mixed_tokens"] == 0 and got[None]["available_tokens"] == 50
    assert sum(r["actual_share"] for r in got.values()) == pytest.approx(1, abs=1e-5)
    by = {}
    for r in used.collect():
        assert r["id"] not in by and r["tokens"] > 0
        by[r["id"]] = r["copies"]
    assert max(by.values()) <= 3


def test_same_seed_same_mixture(spark):
    docs, weights = frames(spark)
    a = rows(mixing.mix(docs.withColumn("place", F.rand(3)).withColumn("copies", F.lit(9)), weights, 3000, seed=1)[0])
    assert a == rows(mixing.mix(docs.repartition(7), weights, 3000, seed=1)[0])
    assert a != rows(mixing.mix(docs, weights, 3000, seed=2)[0])


def test_empty(spark):
    docs, weights = frames(spark)
    used, report = mixing.mix(docs.limit(0), weights)
    assert used.count() == 0 and report.count() == 4
    used, report = mixing.mix(docs, weights.limit(0))
    assert used.count() == 0 and report.count() == 1


def test_tokens(spark):
    df = spark.createDataFrame(
        [(1, "A-b ", "hello world", 1), (2, None, None, 1), (3, "x", "", 1), (None, "x", "y", 1), (4, "x", "word " * 50_000, 1)],
        "doc_id long, source string, text string, tokens long",
    )
    got = rows(mixing.sized(df, "doc_id", "source", "text"))
    assert got[:3] == [(1, "a_b", 2), (2, None, 0), (3, "x", 0)] and got[3][2] >= 50_000
