"""Pair counts of a corpus with more pairs than any table of fixed size tells apart."""

import numpy as np

from tests.conftest import rows
from tests.llm.test_stuffing import ARTICLE, SPAM
from wardloom.llm import stuffing


def corpus(spark):
    texts = [*ARTICLE[:60], *SPAM, SPAM[0], "", "word", None]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_counts_are_exact(spark):
    df = corpus(spark)
    b = stuffing.Batch([r["text"] for r in df.collect()])
    want = sorted((k, int(c), int(n)) for k, x in ((0, b.word), (1, b.pair)) for c, n in zip(*(y.view(np.int64) for y in np.unique(x, return_counts=True))))
    assert sorted(tuple(r) for r in stuffing.count_corpus(stuffing.tokens(df.where("text is not null").toDF("id", "text"))).collect()) == want


def test_rare_pairs_keep_their_counts_in_a_large_corpus():
    codes = np.arange(3_000_000, dtype=np.int64)
    n = np.full(len(codes), 40, np.int64)
    n[:1000] = 3
    counts = stuffing.Counts(np.ones(len(codes), np.int32), codes, n, (int(n.sum()), int(n.sum())))
    assert (counts.count(1, codes[:1000].view(np.uint64)) == 3).all() and counts.count(0, codes[:3].view(np.uint64)).tolist() == [1, 1, 1]


def test_joined_counts_give_the_same_pages(spark):
    df = corpus(spark)
    held = rows(stuffing.stuffed(df, "doc_id", "text"))
    assert held and rows(stuffing.stuffed(df, "doc_id", "text", held=0)) == held
    assert stuffing.stuffed(df.limit(0), "doc_id", "text").count() == 0
    assert stuffing.stuffed(df.where("doc_id < 0"), "doc_id", "text", held=-1).count() == 0
