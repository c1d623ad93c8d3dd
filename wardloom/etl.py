"""Source tables to standard tables: route, look up, cast, write."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.operators import relational as R
from wardloom.sources.tabular import write
from wardloom.standards import Standard


@dataclass
class Result:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    unmapped_columns: list[str] = field(default_factory=list)
    written: dict[str, str] = field(default_factory=dict)


def cast_to(df: DataFrame, standard: Standard, entity: str) -> DataFrame:
    """Columns in the types of the entity, in its order, unreadable values null; further columns follow."""
    kinds = {f.name: f.spark_type for f in standard.entity(entity)}
    known = [F.col(c).try_cast(kinds[c]).alias(c) for c in kinds if c in df.columns]
    return df.select(*known, *(c for c in df.columns if c not in kinds))


def cast_rejects(df: DataFrame, standard: Standard, entity: str) -> DataFrame:
    """Per column how many non-null values its target type can't hold."""
    kinds = {f.name: f.spark_type for f in standard.entity(entity) if f.name in df.columns}
    counts = df.agg(*(F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in kinds.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("rejected")) for c in kinds))))


def plan(
    source: DataFrame,
    items: Iterable[Mapping],
    lookups: DataFrame | None = None,
    codes: Mapping[str, str] | None = None,
    standard: Standard | None = None,
) -> Result:
    """The lazy tables of a run. ``codes`` names for source code columns the prefix of their concept column."""
    items = list(items)
    enriched = R.add_concepts(source, lookups, codes) if lookups is not None and codes else source
    extra = [
        {"source_column": f"{prefix}_concept_id", "target_table": R.effective(i)[0], "target_column": f"{prefix}_concept_id"}
        for column, prefix in (codes or {}).items()
        for i in items
        if i["source_column"] == column
    ]
    tables = R.route(enriched, [*items, *extra])
    if standard:
        tables = {t: cast_to(df, standard, t) if t in standard.entities else df for t, df in tables.items()}
    used = {i["source_column"] for i in items if all(R.effective(i))}
    return Result(tables, R.unused_columns(source, used))


def run(result: Result, path: str, format: str = "parquet", dry: bool = False) -> Result:
    """Write every table under ``path``; a dry run writes nothing."""
    for name, df in result.tables.items():
        if not dry:
            write(df, f"{path}/{name}", format)
            result.written[name] = f"{path}/{name}"
    return result
