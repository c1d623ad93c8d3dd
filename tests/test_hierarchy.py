"""Tree contraction against walking the parents one by one."""

import random

import pytest

from tests.conftest import rows
from wardloom.operators import hierarchy as h


def brute(parent):
    out = {}
    for n in set(parent) | set(parent.values()):
        seen, x = [n], n
        while x in parent and parent[x] not in seen:
            x = parent[x]
            seen.append(x)
        if x not in parent:
            out[n] = (x, len(seen) - 1, None, tuple(reversed(seen)))
        else:
            ring = seen[seen.index(parent[x]) :]
            out[n] = (min(ring), -1 if n in ring else -2, len(seen) - len(ring), tuple(reversed(seen[: seen.index(min(ring)) + 1])))
    return out


def pairs(parent):
    out = []
    for n in set(parent):
        x, steps, seen = n, 0, {n}
        while x in parent and parent[x] not in seen:
            x, steps = parent[x], steps + 1
            seen.add(x)
            out.append((x, n, steps))
    return sorted(out, key=str)


def resolved(spark, parent, extra=(), core=h.CORE):
    df = spark.createDataFrame([*parent.items(), *extra], "node long, parent long")
    got = h.resolve(df, paths=True, core=core)
    assert got.columns == ["node", "root", "depth", "steps", "from_cycle", "path"]
    found = got.collect()
    assert all(r["steps"] == len(r["path"]) - 1 for r in found)
    assert len({r["node"] for r in found}) == len(found)
    bare = h.resolve(df, core=core)
    assert sorted(map(tuple, bare.collect()), key=str) == sorted((tuple(r)[:5] for r in found), key=str)
    return {r["node"]: (r["root"], r["depth"], r["from_cycle"], tuple(r["path"])) for r in found}


@pytest.mark.parametrize("seed, core", [(1, 0), (2, 40), (3, h.CORE)])
def test_random_forest_with_cycles(spark, seed, core):
    rng = random.Random(seed)
    parent = {n: rng.randrange(0, n) for n in range(5, 300)}
    parent |= {n: n - 1 for n in range(1001, 1060)}  # a long chain
    parent |= {n: n + 1 for n in range(1101, 1130)}  # and one that falls
    parent |= {2000: 2001, 2001: 2002, 2002: 2000, 2003: 2002, 2004: 2003, 2005: 2004, 2006: 2003, 2007: 2001, 2008: 2005}
    parent |= {3000: 3001, 3001: 3000}
    ring = rng.sample(range(4000, 4040), 25)
    parent |= dict(zip(ring, ring[1:] + ring[:1])) | {n: rng.choice(ring) for n in range(4100, 4120)}
    assert resolved(spark, parent, core=core) == brute(parent)
    df = spark.createDataFrame([*parent.items()], "node long, parent long")
    assert rows(h.descendants(h.resolve(df, paths=True))) == pairs(parent)


def test_star_of_a_third_of_all_rows(spark):
    parent = {n: 0 for n in range(1, 400)} | {n: n - 400 for n in range(401, 500)}
    assert resolved(spark, parent) == brute(parent)


def test_repeats_nulls_self_edges_and_several_parents(spark):
    extra = [(2, 1), (None, 1), (5, None), (7, 7), (3, 9)]
    got = resolved(spark, {2: 1, 3: 2}, extra)
    assert got == {1: (1, 0, None, (1,)), 2: (1, 1, None, (1, 2)), 3: (1, 2, None, (1, 2, 3)), 9: (9, 0, None, (9,))}
    assert resolved(spark, {}, [(None, None)]) == {}


def test_every_link_is_reported(spark):
    df = spark.createDataFrame(
        [(2, 1), (2, 1), (3, 2), (3, 9), (5, 6), (6, 5), (7, 5), (None, 1), (4, 4)], "node long, parent long"
    )
    got = rows(h.link_report(df, h.resolve(df)))
    assert got == [(2, 1, "tree"), (3, 2, "tree"), (3, 9, "other parent"), (5, 6, "on cycle"), (6, 5, "on cycle"), (7, 5, "below cycle")]


def test_descendants(spark):
    df = spark.createDataFrame([(2, 1), (3, 2), (4, 2), (8, 9), (9, 8)], "node long, parent long")
    assert rows(h.descendants(h.resolve(df, paths=True))) == [
        (1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 3, 1), (2, 4, 1), (8, 9, 1), (9, 8, 1)
    ]
    df = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 3), (5, 4)], "node long, parent long")
    assert rows(h.descendants(h.resolve(df, paths=True))) == pairs({1: 2, 2: 1, 3: 1, 4: 3, 5: 4})


def test_parent_links(spark):
    rel = spark.createDataFrame(
        [
            (2, 1, " IS_A ", None, "x"),
            (1, 2, "subsumes", "", "x"),
            (3, 1, "Is a", "D", "x"),
            (4, 4, "Is a", None, "x"),
            (5, 1, "Maps to", None, "x"),
            (6, 99, "Is a", None, "x"),
            (None, 1, "Is a", None, "x"),
            (7, 1, None, None, "x"),
            (8, 1, "Is a", "  ", "x"),
        ],
        "concept_id_1 long, concept_id_2 long, relationship_id string, invalid_reason string, parent string",
    )
    concepts = spark.createDataFrame([(i,) for i in (*range(1, 9), None)], "concept_id long")
    assert rows(h.parent_links(rel, concepts), "node", "parent") == [(2, 1), (8, 1)]
