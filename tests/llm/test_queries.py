"""Every query of the subpackage on the smallest tables: columns, distinct rows, agreement between queries."""

import os

import pytest

from wardloom.llm import queries

DIR = os.environ.get("WARDLOOM_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
COLUMNS = {
    "p2_found": ["table_name", "record_id", "concept_id"],
    "p3_found": ["concept_id_a", "concept_id_b"],
    "p7_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))


def test_every_typed_value_is_answered_once(spark):
    got = queries.p2_found(spark, DIR).groupBy("table_name").count().collect()
    for row in got:
        name, text, key = {
            "conditions": ("conditions", "dx_description", "condition_id"),
            "medications": ("medications", "med_description", "medication_id"),
        }[row["table_name"]]
        df = spark.read.parquet(f"{DIR}/{name}.parquet").where(f"trim({text}) <> ''")
        assert row["count"] == df.select(key).distinct().count()


def test_pairs_are_ordered(spark):
    assert queries.p3_found(spark, DIR).where("concept_id_a >= concept_id_b").count() == 0
