"""Target standards: entities, fields and their Spark types."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wardloom.standards import definitions

_STRING, _CODED = T.StringType(), T.StructType(
    [
        T.StructField("coding", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("system", "code", "display")]))),
        T.StructField("text", T.StringType()),
    ]
)
_PERIOD = T.StructType([T.StructField("start", T.StringType()), T.StructField("end", T.StringType())])
_REFERENCE = T.StructType([T.StructField("reference", T.StringType())])
_QUANTITY = T.StructType([T.StructField("_type", T.StringType()), T.StructField("magnitude", T.DoubleType()), T.StructField("units", T.StringType())])
_CODED_TEXT = T.StructType(
    [
        T.StructField("_type", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField(
            "defining_code",
            T.StructType(
                [
                    T.StructField("terminology_id", T.StructType([T.StructField("value", T.StringType())])),
                    T.StructField("code_string", T.StringType()),
                ]
            ),
        ),
    ]
)
#: declared type -> (validation category, Spark type)
TYPES: dict[str, tuple[str, T.DataType]] = {
    "integer": ("numeric", T.IntegerType()),
    "float": ("numeric", T.DoubleType()),
    "NM": ("numeric", T.DoubleType()),
    "DV_COUNT": ("numeric", T.IntegerType()),
    "DV_QUANTITY": ("numeric", _QUANTITY),
    "date": ("temporal", T.DateType()),
    "DV_DATE": ("temporal", T.DateType()),
    "datetime": ("temporal", T.TimestampType()),
    "dateTime": ("temporal", T.TimestampType()),
    "instant": ("temporal", T.TimestampType()),
    "TS": ("temporal", T.TimestampType()),
    "DV_DATE_TIME": ("temporal", T.TimestampType()),
    "Period": ("temporal", _PERIOD),
    "code": ("code", _STRING),
    "IS": ("code", _STRING),
    "ID": ("code", _STRING),
    "CE": ("code", _STRING),
    "CWE": ("code", _STRING),
    "CodeableConcept": ("code", _CODED),
    "DV_CODED_TEXT": ("code", _CODED_TEXT),
    "Reference": ("reference", _REFERENCE),
    "CX": ("reference", _STRING),
    "PARTY_IDENTIFIED": ("reference", _STRING),
    "boolean": ("other", T.BooleanType()),
    "string": ("string", _STRING),
    "text": ("string", _STRING),
    "ST": ("string", _STRING),
    "DV_TEXT": ("string", _STRING),
}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = False
    coded: bool = False
    foreign_key: str | None = None

    @property
    def category(self) -> str:
        return "code" if self.coded else TYPES.get(self.type, ("other", _STRING))[0]

    @property
    def spark_type(self) -> T.DataType:
        return TYPES.get(self.type, ("other", _STRING))[1]


@dataclass(frozen=True)
class Standard:
    name: str
    kind: str
    default: tuple[str, str]
    entities: dict[str, list[Field]] = field(default_factory=dict)

    def entity(self, name: str) -> list[Field]:
        if name not in self.entities:
            raise KeyError(f"{self.name} has no entity {name}")
        return self.entities[name]

    def schema(self, entity: str) -> T.StructType:
        """The Spark schema of an entity."""
        return T.StructType([T.StructField(f.name, f.spark_type, not f.required) for f in self.entity(entity)])

    def ddl(self, entity: str) -> str:
        """A CREATE TABLE statement with primary and foreign keys for relational kinds, else Spark's own notation."""
        if self.kind != "relational":
            return f"{entity}: " + ", ".join(f"{f.name} {f.spark_type.simpleString()}" for f in self.entity(entity))
        kinds = {"integer": "INTEGER", "float": "DOUBLE", "date": "DATE", "datetime": "TIMESTAMP"}
        lines = [f"  {f.name} {kinds.get(f.type, 'VARCHAR')}{' NOT NULL' if f.required else ''}" for f in self.entity(entity)]
        keys = [f for f in self.entity(entity) if f.foreign_key]
        for f in keys:
            table, column = f.foreign_key.split(".")
            lines.append(f"  FOREIGN KEY ({f.name}) REFERENCES {table} ({column})")
        return f"CREATE TABLE {entity} (\n" + ",\n".join(lines) + "\n)"

    def fields(self, spark: SparkSession) -> DataFrame:
        """Metadata frame ``(standard, entity, field, type, category, required)``."""
        rows = [(self.name, e, f.name, f.type, f.category, f.required) for e, fs in self.entities.items() for f in fs]
        return spark.createDataFrame(rows, "standard string, entity string, field string, type string, category string, required boolean")


def parse(name: str, kind: str, default: str, text: str) -> Standard:
    """A definition, one entity a line: ``entity: field type[!][*][->table.column], ...`` (! required, * coded)."""
    entities: dict[str, list[Field]] = {}
    for line in filter(None, (x.strip() for x in text.splitlines())):
        entity, _, rest = line.partition(": ")
        for part in rest.split(", "):
            words, _, key = part.partition("->")
            column, _, kinds = words.partition(" ")
            entities.setdefault(entity, []).append(
                Field(column, kinds.rstrip("!*") or "string", "!" in kinds, "*" in kinds, key or None)
            )
    entity, _, column = default.rpartition(".")
    return Standard(name, kind, (entity, column), entities)


ALIASES = {"omop": "omop_cdm_v5.4", "fhir": "fhir_r4", "hl7v2": "hl7v2_2.5.1", "openehr": "openehr_1.0.4"}


def load(name: str) -> Standard:
    """A built-in standard by name or alias, or ``custom:path`` to a definition file in the same notation.

    The first line of a custom file reads ``name kind default_entity.default_field``.
    """
    if name.startswith("custom:"):
        with open(name.removeprefix("custom:")) as f:
            head, _, body = f.read().partition("\n")
        own, kind, default = head.split()
        return parse(own, kind, default, body)
    name = ALIASES.get(name, name)
    if name not in definitions.STANDARDS:
        raise KeyError(f"unknown standard {name}")
    return parse(name, *definitions.STANDARDS[name])
