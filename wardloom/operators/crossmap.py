"""Records of one standard as records of another: one lazy projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.functions import transforms
from wardloom.operators.vocabulary import best_targets
from wardloom.standards import Standard
from wardloom.standards.crossmaps import Crossmap, Rule


def nest(paths: dict[str, Column]) -> list[Column]:
    """Columns by dotted path as nested structs; list indexes are dropped and the last writer of a path wins."""
    tree: dict = {}
    for path, col in paths.items():
        *above, leaf = [p.split("[")[0] for p in path.split(".")]
        node = tree
        for p in above:
            if not isinstance(node.get(p), dict):
                node[p] = {}
            node = node[p]
        node[leaf] = col

    def build(node) -> Column:
        return F.struct(*(build(v).alias(k) for k, v in node.items())) if isinstance(node, dict) else node

    return [build(v).alias(k) for k, v in tree.items()]


def reader(df: DataFrame, rules: list[Rule]) -> transforms.Record:
    """Columns of ``df`` by field name: the first that isn't null of a field's names; a field that is missing is null."""
    kinds = dict(df.dtypes)
    names = {r.field: (r.field, *r.others) for r in rules if r.others}

    def record(name: str) -> Column:
        found = [n for n in names.get(name, (name,)) if n in kinds]
        cols = [F.col(f"`{n}`") for n in found] or [F.lit(None).cast("string")]
        if len({kinds[n] for n in found}) > 1:
            cols = [c.cast("string") for c in cols]
        return F.coalesce(*cols) if len(cols) > 1 else cols[0]

    return record


def cross_map(df: DataFrame, crossmap: Crossmap, entity: str) -> DataFrame:
    """``df`` (rows of ``entity``) in the target standard; an unknown entity leaves it unchanged.

    A field that is missing counts as null.
    """
    if entity not in crossmap.entities:
        return df
    target, rules = crossmap.entities[entity]
    record = reader(df, rules)
    out = {r.target: transforms.apply(r.transform, record(r.field), r.config, record) for r in rules}
    if crossmap.target.split("_")[0] == "fhir":
        out = {"resourceType": F.lit(target)} | out
    return df.select(*nest(out))


def with_targets(df: DataFrame, field: str, walk: DataFrame, prefix: str) -> DataFrame:
    """Join for the vocabulary_lookup transform: the best target of the concept id in ``field`` as ``prefix_*`` columns."""
    side = best_targets(walk).select(
        F.col("source_concept_id").alias("_id"),
        *(F.col(f"target_{c}").alias(f"{prefix}_{c}") for c in ("concept_id", "concept_code", "concept_name", "vocabulary_id")),
    )
    return df.join(side, F.col(field).try_cast("long") == F.col("_id"), "left").drop("_id")


def coverage(crossmap: Crossmap, entity: str, source: Standard, target: Standard) -> dict[str, list[str]]:
    """Fields of the source entity that no rule reads, and of the target entity that none writes."""
    to, rules = crossmap.entities.get(entity, ("", []))
    read = {n for r in rules for n in r.reads}
    written = {r.target.split(".")[0].split("[")[0] for r in rules}
    return {
        "unmapped_source": sorted(f.name for f in source.entities.get(entity, []) if f.name not in read),
        "unmapped_target": sorted(f.name for f in target.entities.get(to, []) if f.name not in written),
    }


def unmapped_fields(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """``(entity, field)`` of metadata ``fields`` that ``rules(entity, field)`` don't mention."""
    return fields.select("entity", "field").distinct().join(rules.select("entity", "field").distinct(), ["entity", "field"], "left_anti")


def run_summary(runs: DataFrame) -> DataFrame:
    """One row for ``runs(source, target, entity, records)``: runs, records, distinct pairs of standards."""
    return runs.agg(
        F.count("*").alias("runs"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.count_distinct("source", "target").alias("pairs"),
    )
