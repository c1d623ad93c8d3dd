"""A project: a folder with sources, mappings, reports and runs."""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from wardloom.operators.crossmap import cross_map
from wardloom.sources.tabular import Catalog
from wardloom.standards import crossmaps

KINDS = ("sources", "mappings", "profiles", "reports", "runs")


class Project:
    """JSON documents and Parquet tables by kind and name under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.catalog = Catalog(spark)
        for kind in KINDS:
            os.makedirs(os.path.join(path, kind), exist_ok=True)
        for name in self.list("sources"):
            self.catalog.sources[name] = self.load("sources", name)

    def _file(self, kind: str, name: str) -> str:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        if os.path.basename(name) != name or name.startswith("."):
            raise ValueError(f"not a name: {name!r}")
        return os.path.join(self.path, kind, name + ".json")

    def save(self, kind: str, name: str, document) -> None:
        with open(self._file(kind, name), "w") as f:
            json.dump(document, f, indent=1, default=str)

    def load(self, kind: str, name: str):
        with open(self._file(kind, name)) as f:
            return json.load(f)

    def list(self, kind: str) -> list[str]:
        return sorted(f[:-5] for f in os.listdir(os.path.join(self.path, kind)) if f.endswith(".json"))

    def delete(self, kind: str, name: str) -> None:
        os.remove(self._file(kind, name))

    def add_source(self, name: str, **how) -> DataFrame:
        """Register, remember and read a source."""
        self.catalog.add(name, **how)
        self.save("sources", name, self.catalog.sources[name])
        return self.catalog.read(name)

    def save_table(self, kind: str, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._file(kind, name).removesuffix(".json") + ".parquet")

    def load_table(self, kind: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self._file(kind, name).removesuffix(".json") + ".parquet")

    def cross_map(self, source: str, target: str, entity: str, data: DataFrame, path: str | None = None) -> DataFrame:
        """``data`` (rows of ``entity``) in the target standard, lazily, with a record of the run under 'runs'.

        ``path`` names a crossmap file in place of the built-in one. The record
        tells the standards, both entities (the target null where the crossmap
        has no such entity, which leaves the rows as they are) and the time;
        counting the rows is left to the caller, as it would run the plan.
        """
        crossmap = crossmaps.load(source, target, path)
        record = {
            "source": source,
            "target": target,
            "entity": entity,
            "target_entity": crossmap.entities.get(entity, (None, []))[0],
            "at": datetime.now(timezone.utc).isoformat(),
        }
        self.save("runs", f"cross_map-{uuid.uuid4().hex}", record)
        return cross_map(data, crossmap, entity)
