"""Leaks against brute force over words."""

import random

from tests.conftest import rows
from wardloom.llm import leakage

RNG = random.Random(9)
VOCABULARY = [f"w{i}" for i in range(400)]
ITEMS = {i: [RNG.choice(VOCABULARY) for _ in range(RNG.randint(40, 90))] for i in range(12)}


def noise(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def edited(words, share):
    out = []
    for w in words:
        x = RNG.random()
        if x < share / 3:
            continue
        out.append("changed" if x < 2 * share / 3 else w)
        if 2 * share / 3 <= x < share:
            out.append("added")
    return out


def run(spark, docs, items=None):
    d = spark.createDataFrame(docs, "doc_id long, text string, item string")
    i = spark.createDataFrame(items or [(k, " ".join(w)) for k, w in ITEMS.items()], "item_id long, item_text string")
    return rows(leakage.leaks(d, i, "doc_id", "item_id", "text", "item_text"))


def test_runs_and_edited_copies(spark):
    docs, want = [], []
    for n in range(120):
        k = n % 12
        item = ITEMS[k]
        kind = n % 5
        if kind == 0:
            at = RNG.randint(0, len(item) - 12)
            part = item[at : at + 12]
        elif kind == 1:
            at = RNG.randint(0, len(item) - 11)
            part = item[at : at + 10]
        elif kind == 2:
            part = edited(item, 0.13)
        elif kind == 3:
            part = edited(item, 0.6)
        else:
            part = noise(40)
        docs.append((n, " ".join(noise(RNG.randint(0, 60)) + part + noise(RNG.randint(0, 60))), None))
        if kind in (0, 2):
            want.append((n, k))
    assert run(spark, docs) == sorted(want, key=str)


def test_marks_do_not_matter(spark):
    item = "The first of twelve words, which stay together in this_item, ends here today at noon."
    marked = [
        (1, item.upper().replace(",", ""), None),
        (2, "> The first of twelve words,\n> which stay toge-\n> ther in this_item, ends\n> here today at noon.", None),
        (3, "<p>The <b>first</b> of&nbsp;twelve words, which stay together in <span>this_item</span>, ends here</p>", None),
        (4, "the first of twelve words and then something else altogether", None),
    ]
    assert run(spark, marked, [(7, item)]) == [(1, 7), (2, 7), (3, 7)]


def test_edge_cases(spark):
    item = " ".join(ITEMS[0])
    long = " ".join(noise(30_000)) + " " + item
    docs = [(1, None, None), (2, "", None), (None, item, None), (3, item, "x"), (3, item, "x"), (4, long, None), (5, "short", None)]
    assert run(spark, docs) == [(3, 0), (4, 0)]
    assert run(spark, docs, [(1, None), (2, ""), (3, "too short to leak")]) == []
    assert run(spark, docs, [(1, item), (1, item), (None, item)]) == [(3, 1), (4, 1)]
    nothing = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, item_text string")
    assert leakage.leaks(nothing, items, "doc_id", "item_id", "text", "item_text").count() == 0


def test_items_of_any_length(spark):
    """Whole copies from one word on, and copies with one word in seven replaced, dropped or added."""
    rng = random.Random(3)
    big = [f"x{i}" for i in range(3000)]
    items, docs, want = [], [], []
    for k, n in enumerate([1, 2, 4, 5, 7, 11] + [n for n in (8, 10, 12, 14, 16, 20, 24, 30, 40, 60) for _ in range(10)]):
        item = rng.sample(big, n)
        items.append((k, " ".join(item)))
        part = list(item)
        if k >= 6:
            for at in rng.sample(range(n), n // 7):
                part[at] = rng.choice(["", "changed", part[at] + " added"])
        around = [f"y{rng.randrange(500)}" for _ in range(40)]
        docs.append((k, " ".join(around[:20] + part + around[20:] if k % 2 else part), None))
        want.append((k, k))
    got = set(run(spark, docs, items))
    assert got <= set(want) | {(d, i) for d, i in got if len(items[i][1].split()) < 5}
    missed = set(want) - got
    assert not {k for k, _ in missed if k < 6} and len(missed) <= 2
