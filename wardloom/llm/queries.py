"""Queries of the text and vector problems (2, 3, 7, 8, 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.llm import leakage, linking, mixing, neighbours, stuffing
from wardloom.plans.tables import table


def _linked(spark: SparkSession, d: str) -> DataFrame:
    canonical, synonyms = table(spark, d, "canonical_concept"), table(spark, d, "concept_synonym")
    parts = []
    for name, record, text, domain, shortest in (
        ("conditions", "condition_id", "dx_description", "Condition", 4),
        ("medications", "medication_id", "med_description", "Drug", 5),
    ):
        terms = linking.reference_terms(canonical.where(F.col("domain_id") == domain), synonyms, shortest)
        values = table(spark, d, name).select(
            F.lit(name).alias("table_name"), F.col(record).alias("record_id"), F.col(text).alias("typed")
        )
        parts.append(linking.link(values.distinct(), "typed", *terms))
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).select("table_name", "record_id", "concept_id")


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Typed values that mean no entry, with how often they occur."""
    return (
        _linked(spark, d)
        .where("concept_id = 0")
        .groupBy("table_name", F.lower(F.trim("typed")).alias("typed"))
        .agg(F.count("*").alias("records"))
    )


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbours(table(spark, d, "pgvector_backend"), "concept_id", "embedding", dim=48, k=5)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return (
        _neighbours(spark, d)
        .select(
            F.least("id", "neighbour").alias("concept_id_a"), F.greatest("id", "neighbour").alias("concept_id_b")
        )
        .distinct()
    )


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar concepts of every concept, with their similarity."""
    return _neighbours(spark, d).select(
        F.col("id").alias("concept_id"), F.col("neighbour").alias("neighbour_id"), F.round("sim", 5).alias("cosine")
    )


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(
        table(spark, d, "documents"), table(spark, d, "heldout_item"), "doc_id", "item_id", "text", "item_text"
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents each leaked item occurs."""
    return _leaks(spark, d).groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("documents"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = mixing.sized(table(spark, d, "documents"), "doc_id", "source", "text")
    return mixing.mix(documents, table(spark, d, "source_weight"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used."""
    return _mixed(spark, d)[0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixed(spark, d)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    pages = stuffing.stuffed(table(spark, d, "documents"), "doc_id", "text")
    return pages.where(F.col("spam") * 2 > F.col("words")).select(F.col("id").alias("doc_id")).distinct()


def p9_pages(spark: SparkSession, d: str) -> DataFrame:
    """How many words of each page are keywords, links or tags."""
    pages = stuffing.stuffed(table(spark, d, "documents"), "doc_id", "text")
    return pages.withColumnRenamed("id", "doc_id").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_unmatched, p3_found, p3_neighbours, p7_found, p7_items, p8_mixture, p8_shares, p9_found, p9_pages)}
ORACLE: dict[str, str] = {}
