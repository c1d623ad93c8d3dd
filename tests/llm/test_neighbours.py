"""Neighbours against brute force, with unusable vectors, copies, ties and hot groups."""

import numpy as np
import pytest

from wardloom.llm import neighbours as nb


def brute(ids, v, k):
    v = np.asarray(v, float)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = (v @ v.T).round(nb.ROUND)
    out = {}
    for i in range(len(ids)):
        order = sorted((-sim[i, j], ids[j]) for j in range(len(ids)) if j != i)
        out[ids[i]] = {x for _, x in order[:k]}
    return out


def found(df, dim, k):
    got = {}
    for r in nb.neighbours(df, "key", "vec", dim, k).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    return got


def frame(spark, pairs):
    return spark.createDataFrame(
        [(i, [float(x) for x in v] if v is not None else None, "x") for i, v in pairs],
        "key long, vec array<float>, unit string",
    )


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    sizes = rng.integers(3, 120, 60)
    v = np.vstack([c + 0.2 * rng.normal(size=(n, 16)) for c, n in zip(centres, sizes)]).astype(np.float32)
    v *= rng.uniform(0.1, 9, (len(v), 1)).astype(np.float32)
    ids = list(range(100, 100 + len(v)))
    want, got = brute(ids, v, 5), found(frame(spark, zip(ids, v)), 16, 5)
    assert sum(len(want[i] & got[i]) for i in ids) / (5 * len(ids)) >= 0.97
    assert all(len(got[i]) == 5 and i not in got[i] for i in ids)


def test_unusable_repeated_and_tied(spark):
    pairs = [(1, [1, 0]), (1, [1, 0]), (2, [2, 0]), (3, [0, 1]), (4, [1, 1]), (5, None), (6, [0, 0]), (7, [float("nan"), 1])]
    pairs += [(8, [1, 2, 3]), (None, [1, 0]), (9, [float("inf"), 0])]
    got = found(frame(spark, pairs), 2, 2)
    assert got == {1: {2, 4}, 2: {1, 4}, 3: {1, 4}, 4: {1, 2}}


def test_hot_group_of_equal_directions(spark):
    rng = np.random.default_rng(2)
    others = rng.normal(size=(60, 8)).astype(np.float32)
    same = rng.normal(size=8).astype(np.float32)
    pairs = [(i, same * np.float32(1 + i % 4)) for i in range(1, 31)] + [(100 + i, o) for i, o in enumerate(others)]
    got = found(frame(spark, pairs), 8, 3)
    ids, v = zip(*pairs)
    want = brute(list(ids), np.array(v), 3)
    assert {i: got[i] for i in range(1, 31)} == {i: want[i] for i in range(1, 31)}
    assert sum(len(want[i] & got[i]) for i in ids) / (3 * len(ids)) >= 0.97


@pytest.mark.parametrize("pairs", [[], [(1, None)], [(1, [1, 0])]])
def test_nothing_to_find(spark, pairs):
    assert found(frame(spark, pairs), 2, 5) == {}


@pytest.mark.parametrize("block, asks, large, leaf", [(50, 65_536, 4000, 1000), (50, 20, 30, 1000), (400, 60, 60, 25)])
def test_half_of_all_rows_close_together(spark, monkeypatch, block, asks, large, leaf):
    """Leaves cut into blocks, blocks copied for parts of their queries, and trees within leaves change nothing."""
    monkeypatch.setattr(nb, "BLOCK_ROWS", block)
    monkeypatch.setattr(nb, "BLOCK_ASKS", asks)
    monkeypatch.setattr(nb, "LARGE_LEAF", large)
    monkeypatch.setattr(nb, "LEAF_ROWS", leaf)
    rng = np.random.default_rng(4)
    v = np.vstack([np.ones(6) + 0.05 * rng.normal(size=(300, 6)), rng.normal(size=(300, 6))]).astype(np.float32)
    ids = list(range(600))
    want, got = brute(ids, v, 4), found(frame(spark, zip(ids, v)), 6, 4)
    assert sum(len(want[i] & got[i]) for i in ids) / (4 * len(ids)) >= 0.97


def test_queue_hands_out_the_nearest_first_and_all_within_the_margin(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    monkeypatch.setattr(nb, "FANOUT", 8)
    tree = nb.Tree(x, 40)
    assert tree.levels > 2 and sorted(set(tree.home(x).tolist())) == list(range(len(tree.node_of)))
    tree.inner[:], tree.slack = 0.8, np.float32(0.5)
    row, leaf = tree.visits(x[:200])
    node, way = tree.descend(x[:200])
    for i in range(200):
        got = leaf[row == i]
        assert tree.leaf_of[node[i]] in got
        want = set()
        for n in tree.node_of:
            up, inside = n, True
            while up > 0:
                d = np.linalg.norm(x[i] - tree.centres[up])
                end = tree.many[up] == 0
                inside &= d - way[i, -1 if end else tree.depth[up]] <= (0.5 if end else 0.8) + 1e-4
                up = tree.parent[up]
            if inside:
                want.add(int(tree.leaf_of[n]))
        assert set(got.tolist()) ^ want == set() and len(got) == len(set(got.tolist()))
