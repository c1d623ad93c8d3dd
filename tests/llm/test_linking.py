"""Typed values against a small canonical list, and the segment join against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wardloom.llm import linking

CANONICAL = [
    (1, "Acute renal cyst with obstruction", "Condition"),
    (2, "Mild hepatic haemorrhage", "Condition"),
    (3, "Focal femoral perforation in remission", "Condition"),
    (4, "Renal calcification", "Condition"),
    # what shows that words in front and behind may be missing
    *((100 + i, name, "Condition") for i, name in enumerate((
        "Hepatic calcification", "Femoral calcification", "Acute hepatic tremor", "Acute femoral tremor", "Mild renal tremor",
        "Mild femoral embolus", "Focal renal embolus", "Focal hepatic embolus", "Femoral cyst", "Femoral atrophy",
        "Femoral fistula", "Renal atrophy with obstruction", "Renal fistula with obstruction", "Renal perforation",
        "Hepatic atrophy in remission", "Hepatic fistula in remission",
    ))),
    (11, "Talvorast 20 MG Oral Tablet", "Drug"),
    (12, "Talvorast 200 MG Oral Solution", "Drug"),
    (13, "Zorfaparin 5 UNT Topical Cream", "Drug"),
]
SYNONYMS = [(1, "kidney fluid sac, acute"), (1, "Cyst of kidney"), (3, "thigh hole, focal"), (2, "Haemorrhage of liver"), (11, "Brexol 20")]
TYPED = {
    "ACUTE RENAL CYST": 1,
    "renal cyst": 1,
    "cyst (renal), severe?": 1,
    "kidney fluid sac": 1,
    "hepa. haem.": 2,
    "hptc hemorrhage": 2,
    "hepatic haemmorhage": 2,
    "c0ded as femoral perf0ration": 3,
    "thigh hole": 3,
    "renal screening recall": 0,
    "hepatic cyst": 0,
    "entered in error": 0,
    "?": 0,
}
DRUGS = {
    "talvorast 20mg tab": 11,
    "200 milligram Tavlorast soln": 12,
    "Talvorast 400 mg": 0,
    "brexol 20": 11,
    "BREXOL 20 po bd x28": 11,
    "Z0rfaparin 5 units": 13,
    "zorfap 5 iu": 13,
    "pending": 0,
}


@pytest.fixture(scope="module")
def lists(spark):
    return (
        spark.createDataFrame(CANONICAL, "concept_id long, concept_name string, domain_id string"),
        spark.createDataFrame(SYNONYMS, "concept_id long, concept_synonym_name string"),
    )


def terms(lists, domain="Condition", shortest=4):
    return linking.reference_terms(lists[0].where(F.col("domain_id") == domain), lists[1], shortest)


def linked(spark, values, reference):
    df = spark.createDataFrame(list(enumerate(values)), "id long, typed string")
    return {r["typed"]: r["concept_id"] for r in linking.link(df, "typed", *reference).collect()}


def test_disorders(spark, lists):
    assert linked(spark, TYPED, terms(lists)) == TYPED


def test_products(spark, lists):
    assert linked(spark, DRUGS, terms(lists, "Drug", 5)) == DRUGS


def test_names_of_other_forms(spark):
    """Single words, keys of several words, equal keys, decimals, and synonyms of any length."""
    canonical = spark.createDataFrame(
        [
            (1, "Asthma", "Condition"),
            (2, "Left lower leg cyst", "Condition"),
            (3, "Upper leg cyst", "Condition"),
            (4, "Mild ear cyst with fever", "Condition"),
            (5, "Mild ear cyst with ache", "Condition"),
            (6, "Insulin zeta 2.5 MG Pen", "Condition"),
            (7, "Insulin zeta 25 MG Pen", "Condition"),
        ],
        "concept_id long, concept_name string, domain_id string",
    )
    seven = "whistling breath that comes and goes again"
    synonyms = spark.createDataFrame([(1, seven), (8, "no such entry")], "concept_id long, concept_synonym_name string")
    want = {
        "ASTHMA": 1, "asthmma, mild": 1, seven.upper(): 1, "Upper leg cyst": 3, "uper leg cyst": 3, "lower left leg cyst": 0,
        "left lower leg cyst": 2, "mild ear cyst with ache": 5, "mild ear cyst with fever": 4, "insulin zeta 2.5 mg": 6,
        "insulin zeta 25 mg pen": 7, "insulin zeta 2,5 mg": 6, "insulin zeta": 0, "7": 0,
    }
    assert linked(spark, want, linking.reference_terms(canonical, synonyms)) == want


def test_nulls_blanks_repeats_long_and_extra_columns(spark, lists):
    long = "renal cyst " + "x" * 30_000
    df = spark.createDataFrame(
        [(1, None, "a"), (2, "  ", "b"), (3, "renal cyst", "c"), (3, "renal cyst", "c"), (4, long, None)],
        "id long, typed string, gram string",
    ).withColumn("concept_id", F.lit("own"))
    got = linking.link(df, "typed", *terms(lists))
    assert rows(got, "id", "gram", "concept_id") == [(3, "c", 1), (3, "c", 1), (4, None, 1)]


def test_empty_tables(spark, lists):
    nothing = spark.createDataFrame([], "id long, typed string")
    assert linking.link(nothing, "typed", *terms(lists)).count() == 0
    empty = [df.limit(0) for df in lists]
    some = spark.createDataFrame([(1, "renal cyst")], "id long, typed string")
    assert rows(linking.link(some, "typed", *terms(empty)), "concept_id") == [(0,)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_segments_find_what_brute_force_finds(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = [(word(rng.randint(3, 9)), "first", str(i), 0.0, rng.randint(0, 2)) for i in range(40)]
    grams = sorted({word(rng.randint(2, 11)) for _ in range(300)})
    got = linking.match_strings(
        spark.createDataFrame([(g,) for g in grams], "gram string"), spark.createDataFrame(terms, linking._TERM)
    )
    want = set()
    for g in grams:
        near = [(distance(g, t), i) for t, _, i, _, k in terms if distance(g, t) <= k]
        if near:
            want |= {(g, i, float(d)) for d, i in near if d == min(near)[0]}
    assert {(r["gram"], r["ident"], r["cost"]) for r in got.collect()} == want
