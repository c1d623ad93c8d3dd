"""Concept crosswalks over a vocabulary's relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT = ("mapsto", "mappedfrom", "isa", "subsumes")
# Code system addresses and terminology names of vocabularies.
SYSTEMS = {
    "SNOMED": "http://snomed.info/sct",
    "LOINC": "http://loinc.org",
    "RxNorm": "http://www.nlm.nih.gov/research/umls/rxnorm",
    "ICD10CM": "http://hl7.org/fhir/sid/icd-10-cm",
    "ICD10": "http://hl7.org/fhir/sid/icd-10",
    "ICD10PCS": "http://www.cms.gov/Medicare/Coding/ICD10",
    "ICD9CM": "http://hl7.org/fhir/sid/icd-9-cm",
    "CPT4": "http://www.ama-assn.org/go/cpt",
    "HCPCS": "https://www.cms.gov/Medicare/Coding/HCPCSReleaseCodeSets",
    "NDC": "http://hl7.org/fhir/sid/ndc",
    "ATC": "http://www.whocc.no/atc",
    "CVX": "http://hl7.org/fhir/sid/cvx",
    "Gender": "http://hl7.org/fhir/administrative-gender",
    "Race": "http://terminology.hl7.org/CodeSystem/v3-Race",
    "Ethnicity": "http://terminology.hl7.org/CodeSystem/v3-Ethnicity",
    "UCUM": "http://unitsofmeasure.org",
}
TERMINOLOGIES = {"SNOMED": "SNOMED-CT", "LOINC": "LOINC", "RxNorm": "RxNorm", "ICD10CM": "ICD10-CM", "ICD10": "ICD10", "ICD10PCS": "ICD10-PCS", "ICD9CM": "ICD9-CM", "CPT4": "CPT4", "HCPCS": "HCPCS", "NDC": "NDC", "ATC": "ATC", "UCUM": "UCUM"}


def relation(c: Column) -> Column:
    """Relationship names without case, blanks and punctuation."""
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def relations(edges: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """``(concept_id_1, concept_id_2, relation)`` of the kept kinds in force, without self edges or repeats.

    With ``concepts`` both ends must be loaded.
    """
    kept = (
        edges.select("concept_id_1", "concept_id_2", relation(F.col("relationship_id")).alias("relation"), "invalid_reason")
        .where(F.col("relation").isin(*KEPT) & (F.col("concept_id_1") != F.col("concept_id_2")))
        .where(F.trim(F.coalesce("invalid_reason", F.lit(""))) == "")
        .select("concept_id_1", "concept_id_2", "relation")
        .distinct()
    )
    if concepts is not None:
        for end in ("concept_id_1", "concept_id_2"):
            kept = kept.join(concepts.select(F.col("concept_id").alias(end)).distinct(), end, "left_semi")
    return kept.select("concept_id_1", "concept_id_2", "relation")


def maps(edges: DataFrame) -> DataFrame:
    """``(source_id, target_id)`` whichever way a mapping was written."""
    forward = edges.where("relation = 'mapsto'").select(F.col("concept_id_1").alias("source_id"), F.col("concept_id_2").alias("target_id"))
    back = edges.where("relation = 'mappedfrom'").select(F.col("concept_id_2").alias("source_id"), F.col("concept_id_1").alias("target_id"))
    return forward.unionByName(back).distinct()


def expand(ids: DataFrame, edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """``(concept_id, relation, related_id, related_name)`` of the mappings of ``ids(concept_id)``."""
    return (
        ids.select("concept_id").distinct()
        .join(edges.where(F.col("relation").isin("mapsto", "mappedfrom")), F.col("concept_id") == F.col("concept_id_1"))
        .join(concepts.select(F.col("concept_id").alias("related_id"), F.col("concept_name").alias("related_name")), F.col("concept_id_2") == F.col("related_id"))
        .select("concept_id", "relation", "related_id", "related_name")
        .distinct()
    )


def crosswalk(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """The full table from concepts of ``sources`` to concepts of ``targets``, nine columns."""
    side = lambda df, p: df.select(
        *(F.col(c).alias(f"{p}_{c}") for c in ("concept_id", "concept_code", "concept_name", "vocabulary_id"))
    ).distinct()
    return (
        maps(edges)
        .join(side(sources, "source"), F.col("source_id") == F.col("source_concept_id"))
        .join(side(targets, "target"), F.col("target_id") == F.col("target_concept_id"))
        .drop("source_id", "target_id")
        .withColumn("relationship_id", F.lit("Maps to"))
    )


def best_targets(walk: DataFrame) -> DataFrame:
    """One target per source concept: the smallest id."""
    order = Window.partitionBy("source_concept_id").orderBy("target_concept_id")
    return walk.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def graph_stats(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: concepts, edges by direction, vocabularies."""
    c = concepts.agg(
        F.count_distinct("concept_id").alias("concepts"),
        F.array_join(F.array_sort(F.collect_set("vocabulary_id")), ",").alias("vocabularies"),
    )
    e = edges.agg(
        F.count_if(F.col("relation").isin("mapsto", "isa")).alias("forward_edges"),
        F.count_if(F.col("relation").isin("mappedfrom", "subsumes")).alias("reverse_edges"),
    )
    return c.crossJoin(e)  # one row each


def _named(table: dict[str, str], vocabulary: Column, default: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[vocabulary], default)


def system_url(vocabulary: Column) -> Column:
    """The code system address of a vocabulary, null where unknown."""
    return _named(SYSTEMS, vocabulary, F.lit(None).cast("string"))


def codeable_concept(code: Column, display: Column, vocabulary: Column) -> Column:
    """A coding with its text; null without a code."""
    coding = F.struct(system_url(vocabulary).alias("system"), code.alias("code"), display.alias("display"))
    text = F.coalesce(F.nullif(display, F.lit("")), code)
    return F.when(code.isNotNull(), F.struct(F.array(coding).alias("coding"), text.alias("text")))


def coded_text(code: Column, display: Column, vocabulary: Column) -> Column:
    """A coded text with its terminology; null without a code."""
    terminology = _named(TERMINOLOGIES, vocabulary, F.coalesce(vocabulary, F.lit("local")))
    return F.when(
        code.isNotNull(),
        F.struct(
            F.lit("DV_CODED_TEXT").alias("_type"),
            F.coalesce(F.nullif(display, F.lit("")), code).alias("value"),
            F.struct(F.struct(terminology.alias("value")).alias("terminology_id"), code.alias("code_string")).alias("defining_code"),
        ),
    )
