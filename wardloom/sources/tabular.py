"""Tabular sources and sinks."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = {"csv": "csv", "tsv": "csv", "parquet": "parquet", "json": "json", "jsonl": "json", "ndjson": "json", "orc": "orc"}


def format_of(path: str) -> str:
    """The format a file suffix names."""
    return suffix if (suffix := os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()) in FORMATS else "csv"


def read_source(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    options: Mapping[str, str] | None = None,
    schema: StructType | str | None = None,
) -> DataFrame:
    """Read files (globs allowed). CSV has a header and keeps text columns unless ``schema`` or options say more."""
    kind = (format or format_of(path)).lower()
    if kind not in FORMATS:
        raise ValueError(f"unsupported format {kind!r}; known: {', '.join(sorted(FORMATS))}")
    defaults = {"header": "true"} if FORMATS[kind] == "csv" else {}
    if kind == "tsv":
        defaults["sep"] = "\t"
    reader = spark.read.format(FORMATS[kind]).options(**defaults | dict(options or {}))
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and inferred types."""
    return read_source(spark, path, "csv", {"inferSchema": "true"})


def read_database(
    spark: SparkSession,
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition: tuple[str, str, str, int] | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """JDBC scan of a table or a query (exactly one).

    ``partition`` (column, lower, upper, parts) reads in parallel; filters and
    columns are pushed to the database.
    """
    if (table is None) == (query is None):
        raise ValueError("give a table or a query, not both")
    if query is not None and partition:
        table, query = f"({query}) q", None
    reader = spark.read.format("jdbc").option("url", url).options(**dict(options or {}))
    reader = reader.option("dbtable", table) if table is not None else reader.option("query", query)
    if partition:
        column, lower, upper, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=str(parts))
    return reader.load()


def from_records(spark: SparkSession, records: Iterable[Mapping], schema: StructType | str | None = None) -> DataFrame:
    """A frame from dictionaries; without ``schema`` the union of keys, types inferred over all records."""
    records = list(records)
    if schema is not None:
        names = StructType.fromDDL(schema).fieldNames() if isinstance(schema, str) else schema.fieldNames()
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], schema)
    if not records:
        return spark.createDataFrame([], StructType())
    names = list(dict.fromkeys(k for r in records for k in r))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], names, samplingRatio=1.0)


def run_sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """The lazy result of a SQL query; ``frames`` stand in it as ``{name}``, without views in the session."""
    return spark.sql(query, **frames)


def write(df: DataFrame, path: str, format: str | None = None, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """Write as Parquet, CSV (with header), JSON or ORC."""
    kind = (format or format_of(path)).lower()
    if kind not in FORMATS:
        raise ValueError(f"unsupported format {kind!r}")
    writer = df.write.mode(mode).format(FORMATS[kind])
    if FORMATS[kind] == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_single_csv(df: DataFrame, path: str) -> None:
    """One CSV part file, for results small enough to hand over."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def to_records(df: DataFrame, limit: int = 1000) -> list[dict]:
    """The first ``limit`` rows as dictionaries, at the edge of the library."""
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


@dataclass
class Catalog:
    """Named sources, read lazily."""

    spark: SparkSession
    sources: dict[str, dict] = field(default_factory=dict)

    def add(self, name: str, path: str | None = None, url: str | None = None, **how) -> None:
        """Register a file path or a database, not both."""
        if (path is None) == (url is None):
            raise ValueError("a source has a path or a database, not both")
        self.sources[name] = {"path": path, "url": url, **how}

    def read(self, name: str) -> DataFrame:
        how = {k: v for k, v in self.sources[name].items() if v is not None}
        if "path" in how:
            return read_source(self.spark, how.pop("path"), **how)
        return read_database(self.spark, how.pop("url"), **how)
