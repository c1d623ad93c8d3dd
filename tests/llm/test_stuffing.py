"""Pages of known kinds in a corpus of ordinary ones."""

import random

from tests.conftest import rows
from wardloom.llm import stuffing

RNG = random.Random(3)
THINGS = [f"thing{i}" for i in range(300)]


def sentence():
    a, b = RNG.sample(THINGS, 2)
    return RNG.choice(
        [
            f"The nurse looked at {a} in the morning and wrote that {b} was better than before.",
            f"Nobody in the small group could explain why {a} had been sent to the wrong place.",
            f"When {a} returns, the doctor will ask for {b} and call the ward at once.",
        ]
    )


ARTICLE = [" ".join(sentence() for _ in range(8)) for _ in range(400)]
SPAM = [
    ". ".join(f"Buy cheap goldpill {w}, goldpill {w}" for w in ("now", "online", "today", "best") * 5),
    "\n".join(f"https://shop.best{i}.example/buy/{t}" for i, t in enumerate(THINGS[:25])),
    "\n".join(f"[cheap {t}](go.site{i}.example/{i})" for i, t in enumerate(THINGS[:20])),
    " ".join(f"#{t}cheap" for t in THINGS[:30]),
    "\n".join(f'<a href="//x{i}.example/?q={i}">order {t}</a>' for i, t in enumerate(THINGS[:20])),
    "Tags: " + ", ".join(x for t in THINGS[:12] for x in ("goldpill offer", t, "sale")),
]
REGIMENS = ["at night", "once daily", "twice daily", "when needed"]


def medicines():
    return "Current medicines\n" + "\n".join(f"- {t} {RNG.choice([5, 10, 20])} mg {RNG.choice(REGIMENS)}" for t in RNG.sample(THINGS, 15))


def results():
    return "test | value | unit | flag\n" + "\n".join(
        f"{t} | {RNG.randint(1, 99)}.{i % 10} | {RNG.choice(['mmol/L', 'kPa', 'units', 'mg/dL'])} | {RNG.choice('HL')}"
        for i, t in enumerate(RNG.sample(THINGS, 15))
    )


ORDINARY = [
    ARTICLE[0] + "\nRead more: https://a.site.example/12",
    ARTICLE[1] + "\n#one #two #three",
    ARTICLE[2] + "\nSources\n" + "\n".join(f"Smith et al., notes on the use of it, https://p.site{i}.example/{i}" for i in range(4)),
    *[medicines() for _ in range(12)],
    *[results() for _ in range(12)],
    "ok",
]


def verdicts(spark, texts):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, words long")
    got = stuffing.stuffed(df.repartition(3), "doc_id", "text").where("spam * 2 > words")
    return {r["id"] for r in got.collect()}


def test_kinds(spark):
    texts = SPAM + ORDINARY + ARTICLE
    assert verdicts(spark, texts) == set(range(len(SPAM)))


def test_half_spam(spark):
    mixed = [SPAM[0] + "\n" + ARTICLE[3][:80], ARTICLE[4] + " " + ARTICLE[5] + "\n" + SPAM[3][:60]]
    assert verdicts(spark, mixed + ARTICLE) == {0}


def test_edge_cases(spark):
    long = " ".join(ARTICLE * 20)
    df = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (3, " \n ", 1), (None, "words", 1), (4, long, 1), (5, "one two", 1), (5, "one two", 1), (6, "<&;>", 1)],
        "doc_id long, text string, words long",
    )
    got = rows(stuffing.stuffed(df, "doc_id", "text"), "id", "words")
    assert [g for g in got if g[0] != 4] == [(5, 2), (5, 2)]
    assert got[0][1] > 100_000 or got[-1][1] > 100_000 or any(g[1] > 100_000 for g in got)
    assert stuffing.stuffed(df.limit(0), "doc_id", "text").count() == 0
