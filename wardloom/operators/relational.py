"""Projection, lookup, routing, profiling and sampling of tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

LITERAL_LOOKUP = 200  # entries up to which a lookup is a literal in the plan
ACTIONABLE = ("auto_accepted", "approved", "overridden")


def transform(
    df: DataFrame,
    renames: Mapping[str, str] | None = None,
    casts: Mapping[str, str] | None = None,
    select: Iterable[str] | None = None,
    lenient: bool = False,
) -> DataFrame:
    """Rename (all at once), cast, then project; names that are absent are ignored.

    A bad value fails the cast, or becomes null where ``lenient``.
    """
    renames, casts = renames or {}, casts or {}
    out = {}
    for c in df.columns:
        name = renames.get(c, c)
        col = F.col(f"`{c}`")
        if name in casts:
            col = col.try_cast(casts[name]) if lenient else col.cast(casts[name])
        out[name] = col.alias(name)
    return df.select(*(out[c] for c in (select if select is not None else out) if c in out))


def lookup(mapping: Mapping, key: Column, default) -> Column:
    """The value mapped to ``key`` (compared as text); null and unknown keys give ``default``."""
    pairs = {str(k): v for k, v in mapping.items()}  # the last of equal keys wins
    if not pairs:
        return F.lit(default)
    literal = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return F.coalesce(literal[key.cast("string")], F.lit(default))


def map_column(df: DataFrame, source: str, mapping: Mapping | DataFrame, target: str, default=0) -> DataFrame:
    """Add ``target``: ``source`` looked up in ``mapping``.

    A dictionary of up to LITERAL_LOOKUP entries becomes a literal; a larger
    one, or a frame ``(key, value)``, a left join, broadcast by the planner
    where it measures the side as small. Keys of a dictionary that are equal
    as text: the last counts, at any size. Keys of a frame, which has no
    order, need not be unique: the largest value counts.
    """
    if isinstance(mapping, Mapping) and len(mapping) <= LITERAL_LOOKUP:
        return df.withColumn(target, lookup(mapping, F.col(source), default))
    if isinstance(mapping, Mapping):
        pairs = {str(k): v for k, v in mapping.items()}  # the last of equal keys wins, as in a literal
        mapping = df.sparkSession.createDataFrame(list(pairs.items()), ["key", "value"])
    side = (
        mapping.select(F.col("key").cast("string").alias("_key"), F.col("value").alias("_value"))
        .where("_key is not null")
        .groupBy("_key")
        .agg(F.max("_value").alias("_value"))
    )
    return (
        df.join(side, F.col(source).cast("string") == F.col("_key"), "left")
        .withColumn(target, F.coalesce("_value", F.lit(default)))
        .drop("_key", "_value")
    )


def lookup_table(items: DataFrame, order: str = "item") -> DataFrame:
    """``(source_column, key, value)`` of mapping items; the last of equal codes of a column counts."""
    return (
        items.where("target_concept_id is not null")
        .groupBy("source_column", F.col("source_code").cast("string").alias("key"))
        .agg(F.max_by("target_concept_id", order).alias("value"))
    )


def add_concepts(df: DataFrame, table: DataFrame, columns: Mapping[str, str], names: DataFrame | None = None) -> DataFrame:
    """For each code column its ``<name>_concept_id`` by the entries of ``table`` for it; unknown codes give 0.

    With ``names(concept_id, concept_name)`` also ``<name>_concept_name``, null where there is none.
    """
    for column, target in columns.items():
        own = table.where(F.col("source_column") == column).select("key", "value")
        df = map_column(df, column, own, f"{target}_concept_id")
        if names is not None:
            side = names.select(F.col("concept_id").alias("key"), F.col("concept_name").alias("value"))
            df = map_column(df, f"{target}_concept_id", side, f"{target}_concept_name", None)
    return df


def pick(df: DataFrame, mapping: Iterable[tuple[str, str]]) -> DataFrame:
    """ETL projection of (source, target) pairs: the first source of a target wins, a source may feed several."""
    chosen: dict[str, str] = {}
    for source, target in mapping:
        if source in df.columns:
            chosen.setdefault(target, source)
    return df.select(*(F.col(f"`{s}`").alias(t) for t, s in chosen.items()))


def route(df: DataFrame, items: Iterable[Mapping]) -> dict[str, DataFrame]:
    """One frame per target table from mapping items (source_column, target_table, target_column), all lazy."""
    by_table: dict[str, list[tuple[str, str]]] = {}
    for item in items:
        table, column = effective(item)
        if table and column and item.get("status", "approved") in ACTIONABLE:
            by_table.setdefault(table, []).append((item["source_column"], column))
    return {table: pick(df, pairs) for table, pairs in by_table.items()}


def effective(item: Mapping) -> tuple[str | None, str | None]:
    """The overridden target, else the suggested one."""
    return (
        item.get("override_target_table") or item.get("target_table"),
        item.get("override_target_column") or item.get("target_column"),
    )


def effective_targets(items: DataFrame) -> DataFrame:
    """Items in force with their effective target."""
    return items.where(F.col("status").isin(*ACTIONABLE)).select(
        "source_column",
        F.coalesce("override_target_table", "target_table").alias("target_table"),
        F.coalesce("override_target_column", "target_column").alias("target_column"),
        "status",
    )


def unused_columns(df: DataFrame, used: Iterable[str]) -> list[str]:
    used = set(used)
    return [c for c in df.columns if c not in used]


def profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per column: rows, nulls, percentage of nulls, distinct values, smallest and largest as text.

    One pass: all figures are aggregates of a single scan, unpivoted after.
    """
    columns = list(columns or df.columns)
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        aggs += [F.count(col).alias(f"n{i}"), F.count_distinct(col).alias(f"u{i}")]
        aggs += [F.min(col).cast("string").alias(f"lo{i}"), F.max(col).cast("string").alias(f"hi{i}")]
    stats = df.agg(*aggs)
    each = F.array(
        *(
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("rows").alias("row_count"),
                (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
                F.round(F.try_divide(F.lit(100.0) * (F.col("rows") - F.col(f"n{i}")), F.col("rows")), 4).alias("null_pct"),
                F.col(f"u{i}").alias("n_unique"),
                F.col(f"lo{i}").alias("min_value"),
                F.col(f"hi{i}").alias("max_value"),
            )
            for i, c in enumerate(columns)
        )
    )
    return stats.select(F.inline(each))


def distinct_values(df: DataFrame, column: str, limit: int | None = 1000) -> DataFrame:
    """``(value, n)``, most frequent first, ties by value; null is a value."""
    counts = df.groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counts if limit is None else counts.orderBy(F.desc("n"), "value").limit(limit)


def top_values(df: DataFrame, columns: Iterable[str], k: int = 10, most: int = 100) -> DataFrame:
    """``(column_name, value, n)`` of the ``k`` most frequent non-null values of columns with at most ``most``."""
    columns = list(columns)
    long = df.select(
        F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns)))
    ).where("value is not null")
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    few = counts.groupBy("column_name").agg(F.count("*").alias("values")).where(F.col("values") <= most)
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return (
        counts.withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= k)
        .join(few, "column_name", "left_semi")
        .select("column_name", "value", "n")
    )


def column_stats(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Per numeric column: nulls, their fraction, distinct values, min, max, mean and sample deviation."""
    kinds = {f.name: f.dataType for f in df.schema}
    columns = [c for c in (columns or df.columns) if isinstance(kinds[c], NumericType)]
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`").cast("double")
        aggs += [F.count(col).alias(f"n{i}"), F.count_distinct(col).alias(f"u{i}"), F.min(col).alias(f"lo{i}")]
        aggs += [F.max(col).alias(f"hi{i}"), F.avg(col).alias(f"m{i}"), F.stddev_samp(col).alias(f"s{i}")]
    each = F.array(
        *(
            F.struct(
                F.lit(c).alias("column_name"),
                (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
                F.round(F.try_divide(F.col("rows") - F.col(f"n{i}"), F.col("rows")), 6).alias("null_fraction"),
                F.col(f"u{i}").alias("unique_count"),
                F.col(f"lo{i}").alias("min_value"),
                F.col(f"hi{i}").alias("max_value"),
                F.round(f"m{i}", 4).alias("mean_value"),
                F.round(f"s{i}", 4).alias("std_value"),
            )
            for i, c in enumerate(columns)
        )
    )
    return df.agg(*aggs).select(F.inline(each))


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A seeded sample of ``n`` rows, the whole frame where it has no more; independent of partitioning."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """Proportional strata: max(1, n * share) rows each, at most all; in total at most ``n``, smallest keys first."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    total = sizes.agg(F.sum("_size").alias("_total"))
    quota = sizes.crossJoin(total).select(  # one row
        F.col(stratum).alias("_stratum"),
        F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_size") / F.col("_total"), 0).cast("int")).alias("_quota"),
    )
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key)
    picked = (
        df.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= n)
        .join(quota, F.col(stratum).eqNullSafe(F.col("_stratum")))
        .where(F.col("_r") <= F.col("_quota"))
        .drop("_r", "_stratum", "_quota")
    )
    return picked.orderBy(key).limit(n)


def companion_column(columns: Iterable[str], code: str) -> str | None:
    """The column that describes a code column: the same stem with another suffix."""
    present = {c.lower(): c for c in columns}
    for suffix in ("_code", "_cd"):
        if code.lower().endswith(suffix):
            stem = code.lower()[: -len(suffix)]
            for other in ("_description", "_name", "_desc", "_text"):
                if stem + other in present:
                    return present[stem + other]
    return None


def companion_descriptions(df: DataFrame, code: str, description: str) -> DataFrame:
    """``(code, description)``: the first description in order of each distinct code."""
    return df.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.min(description).alias("description"))
