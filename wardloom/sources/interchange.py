"""Mapping files, resource bundles and line-delimited resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAPPING = {
    "source_code": "string",
    "source_description": "string",
    "source_column": "string",
    "source_count": "long",
    "target_concept_id": "long",
    "target_concept_name": "string",
    "target_vocabulary_id": "string",
    "target_domain_id": "string",
    "confidence": "double",
    "method": "string",
}
ALIASES = {"target_vocabulary_id": ["vocabulary_id"], "target_domain_id": ["domain_id"], "target_concept_name": ["concept_name"], "target_concept_id": ["concept_id"]}


def import_mapping(df: DataFrame) -> DataFrame:
    """A mapping in the declared types whatever subset of columns it has; needs ``source_code``.

    Alternative column names count where the own one is absent or null; NaN,
    'nan' and blank text are null; text that isn't a number becomes null.
    """
    if "source_code" not in df.columns:
        raise ValueError("a mapping needs source_code")

    def read(name: str, kind: str) -> Column:
        found = [F.col(f"`{c}`").cast("string") for c in [name, *ALIASES.get(name, [])] if c in df.columns]
        value = F.coalesce(*(F.when(~F.lower(F.trim(c)).isin("", "nan", "none"), F.trim(c)) for c in found), F.lit(None))
        if kind == "long":
            value = value.try_cast("double").try_cast("long")
        return (value if kind in ("string", "long") else value.try_cast(kind)).cast(kind).alias(name)

    return df.select(*(read(n, k) for n, k in MAPPING.items()))


def source_to_concept_map(mapping: DataFrame, vocabulary: str, target_vocabulary: str = "SNOMED") -> DataFrame:
    """The 13-column interchange table of the mapped items."""
    return mapping.where("target_concept_id is not null and target_concept_id <> 0").select(
        "source_code",
        F.lit(0).cast("long").alias("source_concept_id"),
        F.lit(vocabulary).alias("source_vocabulary_id"),
        F.coalesce("source_description", "source_code").alias("source_code_description"),
        "target_concept_id",
        F.coalesce("target_concept_name", F.lit("")).alias("target_concept_name"),
        F.coalesce("target_vocabulary_id", F.lit(target_vocabulary)).alias("target_vocabulary_id"),
        F.coalesce("target_domain_id", F.lit("")).alias("target_domain_id"),
        "confidence",
        "method",
        F.lit("1970-01-01").cast("date").alias("valid_start_date"),
        F.lit("2099-12-31").cast("date").alias("valid_end_date"),
        F.lit(None).cast("string").alias("invalid_reason"),
    )


def usagi_rows(mapping: DataFrame) -> DataFrame:
    """What a term-matching desktop tool reads: code, name, frequency."""
    return mapping.select(
        F.col("source_code").alias("sourceCode"),
        F.coalesce("source_description", "source_code").alias("sourceName"),
        F.coalesce("source_count", F.lit(1)).alias("sourceFrequency"),
    )


def usagi_ranked(output: DataFrame) -> DataFrame:
    """Its output ``(sourceCode, conceptId, matchScore)`` ranked per source, best first, ties by id."""
    order = Window.partitionBy("sourceCode").orderBy(F.desc("matchScore"), "conceptId")
    return output.select("sourceCode", "conceptId", "matchScore").withColumn("rank", F.row_number().over(order) - 1)


def ndjson(resources: DataFrame) -> DataFrame:
    """One compact JSON line per resource; null members are left out. Needs a non-null ``resourceType``."""
    if "resourceType" not in resources.columns:
        raise ValueError("resources need resourceType")
    named = F.when(F.col("resourceType").isNull(), F.raise_error(F.lit("a resource without resourceType"))).otherwise(F.col("resourceType"))
    return resources.select(named.alias("resourceType"), F.to_json(F.struct(*resources.columns)).alias("value"))


def write_ndjson(resources: DataFrame, path: str) -> None:
    """A folder of lines per resource type."""
    ndjson(resources).write.mode("overwrite").partitionBy("resourceType").text(path)


def bundle_entries(resources: DataFrame, key: Column) -> DataFrame:
    """Entries of a transaction bundle: fullUrl from the resource's type and key, the resource, its request."""
    name = F.md5(F.concat_ws("/", F.col("resourceType"), key.cast("string")))
    at = lambda a, n: F.substring(name, a, n)
    urn = F.concat(F.lit("urn:uuid:"), F.concat_ws("-", at(1, 8), at(9, 4), at(13, 4), at(17, 4), at(21, 12)))
    return resources.select(
        F.col("resourceType").alias("resource_type"),
        urn.alias("full_url"),
        F.to_json(F.struct(*resources.columns)).alias("resource"),
        F.lit("POST").alias("method"),
    )


def bundles(entries: DataFrame, size: int = 500) -> DataFrame:
    """Transaction bundles of about ``size`` entries each: no bundle holds an unbounded group."""
    n = F.pmod(F.xxhash64("full_url"), F.greatest(F.lit(1), F.ceil(F.col("all_entries") / size)))
    entry = F.struct(
        F.col("full_url").alias("fullUrl"),
        F.col("resource"),
        F.struct(F.col("method"), F.col("resource_type").alias("url")).alias("request"),
    )
    total = entries.agg(F.count("*").alias("all_entries"))
    return (
        entries.crossJoin(total)  # one row
        .withColumn("bundle", n)
        .groupBy("bundle")
        .agg(F.sort_array(F.collect_list(entry)).alias("entry"))
        .select(
            "bundle",
            F.to_json(F.struct(F.lit("Bundle").alias("resourceType"), F.lit("transaction").alias("type"), "entry")).alias("value"),
        )
    )


def concept_scan(spark: SparkSession, path: str, vocabularies: tuple[str, ...] = (), standard_only: bool = True) -> DataFrame:
    """CONCEPT.csv of a tab-separated vocabulary: rows with an integer id and a name, with synonyms unlike it."""
    raw = spark.read.options(header="true", sep="\t", quote="").csv(f"{path}/CONCEPT.csv")
    c = raw.select(
        F.col("concept_id").try_cast("long").alias("concept_id"),
        F.trim("concept_name").alias("concept_name"),
        *(n for n in ("vocabulary_id", "domain_id", "concept_class_id", "standard_concept", "concept_code") if n in raw.columns),
    ).where("concept_id is not null and concept_name <> ''")
    if standard_only:
        c = c.where("standard_concept = 'S'")
    return c.where(F.col("vocabulary_id").isin(*vocabularies)) if vocabularies else c


def with_synonyms(concepts: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``concepts`` with ``synonyms``, the distinct further names that differ from the name but for case."""
    own = concepts.select("concept_id", F.lower("concept_name").alias("_name"))
    lists = (
        synonyms.select("concept_id", F.trim("concept_synonym_name").alias("name"))
        .where("name <> ''")
        .join(own, "concept_id")
        .where(F.lower("name") != F.col("_name"))
        .groupBy("concept_id")
        .agg(F.sort_array(F.collect_set("name")).alias("synonyms"))
    )
    return concepts.join(lists, "concept_id", "left")
