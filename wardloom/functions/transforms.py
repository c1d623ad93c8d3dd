"""Transforms of a crossmap as Column expressions.

Each takes (value, config, record) where ``record`` gives a Column by field
name. Where a value can't be read the result is null, so every output has one
type; text-valued transforms keep the original text.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardloom.operators import vocabulary as V

Record = Callable[[str], Column]
Transform = Callable[[Column, Mapping, Record], Column]
REGISTRY: dict[str, Transform] = {}
# Input date formats in the order they are tried.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy")
TRUE = ("true", "yes", "1", "y", "t")
_STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%j": "DDD"}


def register(name: str, fn: Transform | None = None):
    """Add a transform under ``name`` (also as a decorator)."""
    if fn is None:
        return lambda f: register(name, f)
    REGISTRY[name] = fn
    return fn


def java_pattern(pattern: str) -> str:
    """A strftime pattern in Java's letters."""
    for old, new in _STRFTIME.items():
        pattern = pattern.replace(old, new)
    return pattern


def inner(v: Column, paths: Sequence[str], plain: bool = True) -> Column:
    """The first of ``paths`` found in a struct, an array's first element or JSON text; null where there is none.

    ``plain``: a value that is none of these is its own part.
    """
    text = F.get_json_object(F.to_json(F.struct(v.alias("v"))), "$.v")
    found = [F.get_json_object(text, head + p) for p in paths for head in ("$.", "$[0].")]
    nested = text.rlike(r"^\s*[\[{]") & F.get_json_object(text, "$").isNotNull()
    return F.coalesce(*found, F.when(~nested, text)) if plain else F.coalesce(*found)


def apply(name: str, value: Column, config: Mapping, record: Record) -> Column:
    """The named transform; an unknown name passes the value through.

    With ``path`` in the configuration it sees that part of the value (:func:`inner`).
    """
    if "path" in config:
        value = inner(value, config["path"], config.get("plain", True))
    return REGISTRY.get(name, REGISTRY["passthrough"])(value, config, record)


register("passthrough", lambda v, c, r: v)
register("str", lambda v, c, r: F.coalesce(v.cast("string"), F.lit("")))
register("hl7v2_field", REGISTRY["str"])
register("int", lambda v, c, r: v.cast("string").try_cast("double").try_cast("long"))
register("float", lambda v, c, r: v.cast("string").try_cast("double"))


@register("bool")
def boolean(v: Column, c: Mapping, r: Record) -> Column:
    text = F.lower(F.trim(v.cast("string")))
    return F.when(v.isNotNull(), text.isin(*TRUE) | (F.coalesce(text.try_cast("double"), F.lit(0.0)) != 0))


@register("value_map")
def value_map(v: Column, c: Mapping, r: Record) -> Column:
    table = {str(k): x for k, x in c.get("map", {}).items()}
    default = F.lit(c["default"]) if "default" in c else v.cast("string")
    if not table:
        return default
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[v.cast("string")], default)


@register("format")
def formatted(v: Column, c: Mapping, r: Record) -> Column:
    pattern = c.get("pattern", "{}")
    if "input_format" in c:
        moment = F.try_to_timestamp(v.cast("string"), F.lit(java_pattern(c["input_format"])))
        out = F.coalesce(F.date_format(moment, java_pattern(pattern)), v.cast("string"))
    elif "%" in pattern:
        out = F.date_format(v.try_cast("timestamp"), java_pattern(pattern))
    else:
        head, _, tail = pattern.partition("{}")
        out = F.concat(F.lit(head), v.cast("string"), F.lit(tail)) if "{}" in pattern else F.lit(pattern)
    return F.coalesce(out, F.lit(""))


@register("codeable_concept")
def codeable_concept(v: Column, c: Mapping, r: Record) -> Column:
    code = v.cast("string")
    display = r(c["display_field"]).cast("string") if "display_field" in c else F.lit(None).cast("string")
    coding = F.struct(F.lit(c.get("system")).cast("string").alias("system"), code.alias("code"), display.alias("display"))
    text = F.coalesce(F.nullif(display, F.lit("")), code)
    if "source" in c:  # the source's own code comes first, then the concept's
        own = r(c["source"]["field"]).cast("string")
        first_coding = F.struct(F.lit(c["source"].get("system")).cast("string").alias("system"), own.alias("code"), F.lit(None).cast("string").alias("display"))
        coding = F.struct(F.lit(c.get("system")).cast("string").alias("system"), F.nullif(code, F.lit("0")).alias("code"), display.alias("display"))
        codings = F.filter(F.array(first_coding, coding), lambda x: x["code"].isNotNull())
        return F.when(F.size(codings) > 0, F.struct(codings.alias("coding"), F.coalesce(F.nullif(display, F.lit("")), own, code).alias("text")))
    if c.get("text_alone"):  # a text without a code counts
        codings = F.filter(F.array(coding), lambda x: x["code"].isNotNull())
        return F.when(text.isNotNull(), F.struct(codings.alias("coding"), text.alias("text")))
    return F.when(code.isNotNull(), F.struct(F.array(coding).alias("coding"), text.alias("text")))


@register("fhir_reference")
def reference(v: Column, c: Mapping, r: Record) -> Column:
    kind = c.get("resource_type", "Patient")
    return F.when(v.isNotNull(), F.struct(F.concat(F.lit(kind + "/"), v.cast("string")).alias("reference")))


@register("fhir_date")
def iso_date(v: Column, c: Mapping, r: Record) -> Column:
    text = v.cast("string")
    return F.coalesce(*(F.date_format(F.try_to_timestamp(text, F.lit(f)), "yyyy-MM-dd") for f in DATE_FORMATS), text)


@register("fhir_period")
def period(v: Column, c: Mapping, r: Record) -> Column:
    ends = [
        F.nullif(r(c[f"{e}_field"]).cast("string"), F.lit("")).alias(e) if f"{e}_field" in c else F.lit(None).cast("string").alias(e)
        for e in ("start", "end")
    ]
    return F.struct(*ends)


@register("dv_quantity")
def quantity(v: Column, c: Mapping, r: Record) -> Column:
    unit = r(c["unit_field"]).cast("string") if "unit_field" in c else F.lit(None).cast("string")
    units = F.coalesce(unit, F.lit(c.get("unit", c.get("units", ""))))
    magnitude = F.coalesce(v.cast("string").try_cast("double"), F.lit(0.0))
    return F.when(v.isNotNull(), F.struct(F.lit("DV_QUANTITY").alias("_type"), magnitude.alias("magnitude"), units.alias("units")))


@register("dv_coded_text")
def coded_text(v: Column, c: Mapping, r: Record) -> Column:
    display = r(c["display_field"]).cast("string") if "display_field" in c else F.lit(None).cast("string")
    code = v.cast("string")
    if "else_field" in c:
        code = F.coalesce(code, r(c["else_field"]).cast("string"))
    if "map" in c:
        hit = value_map(v, {"map": c["map"], "default": None}, r)
        display = F.coalesce(hit, F.nullif(display, F.lit("")), F.lit(c.get("default")))
    return _dv_text(code, display, c)


@register("extract_coded_text")
def extract_coded_text(v: Column, c: Mapping, r: Record) -> Column:
    """The first code of a CodeableConcept with its text; a text alone is its own code."""
    display = inner(v, ["text", "coding[0].display"], plain=False)
    return _dv_text(inner(v, ["coding[0].code", "text"]), display, c)


@register("extract_quantity")
def extract_quantity(v: Column, c: Mapping, r: Record) -> Column:
    """Value and unit of a Quantity; null without a value."""
    units = F.coalesce(inner(v, ["unit", "code"], plain=False), F.lit(c.get("unit", "")))
    magnitude = inner(v, ["value"]).try_cast("double")
    return F.when(magnitude.isNotNull(), F.struct(F.lit("DV_QUANTITY").alias("_type"), magnitude.alias("magnitude"), units.alias("units")))


def _dv_text(code: Column, display: Column, c: Mapping) -> Column:
    terminology = F.struct(F.lit(c.get("terminology", "local")).alias("value"))
    return F.when(
        code.isNotNull() | F.lit("default" in c),
        F.struct(
            F.lit("DV_CODED_TEXT").alias("_type"),
            F.coalesce(F.nullif(display, F.lit("")), code).alias("value"),
            F.struct(terminology.alias("terminology_id"), code.alias("code_string")).alias("defining_code"),
        ),
    )


@register("vocabulary_lookup")
def vocabulary_lookup(v: Column, c: Mapping, r: Record) -> Column:
    """Reads the columns that :func:`wardloom.operators.crossmap.with_targets` joined for this field."""
    prefix = c["joined"]
    hit = lambda n: r(f"{prefix}_{n}")
    kind = c.get("output", "concept_id")
    if kind == "codeable_concept":
        return V.codeable_concept(hit("concept_code"), hit("concept_name"), hit("vocabulary_id"))
    if kind == "dv_coded_text":
        return V.coded_text(hit("concept_code"), hit("concept_name"), hit("vocabulary_id"))
    return F.coalesce(hit(kind).cast("string"), v.cast("string"))


@register("concat")
def concat(v: Column, c: Mapping, r: Record) -> Column:
    parts = [r(f).cast("string") for f in c.get("fields", [])] or [v.cast("string")]
    return F.concat_ws(c.get("separator", " "), *parts)


@register("split")
def split(v: Column, c: Mapping, r: Record) -> Column:
    at = c.get("index", 0)
    parts = F.split(v.cast("string"), "\\Q" + c.get("separator", " ") + "\\E")
    return F.try_element_at(parts, F.lit(at + 1 if at >= 0 else at))


@register("extract_id")
def extract_id(v: Column, c: Mapping, r: Record) -> Column:
    """The id behind the last slash of a reference (a struct, or text)."""
    return F.nullif(F.regexp_extract(inner(v, ["reference"]), r"([^/]+)$", 1), F.lit(""))


@register("extract_number")
def extract_number(v: Column, c: Mapping, r: Record) -> Column:
    """The id of a reference as a number, null where it is none."""
    return REGISTRY["int"](extract_id(v, c, r), c, r)


@register("extract_text")
def extract_text(v: Column, c: Mapping, r: Record) -> Column:
    """The first of ``parts``, else the whole value as JSON, so nothing of it is lost."""
    return F.coalesce(inner(v, c["parts"]), F.get_json_object(F.to_json(F.struct(v.alias("v"))), "$.v"))


@register("hl7v2_date")
def hl7v2_date(v: Column, c: Mapping, r: Record) -> Column:
    """The date of an HL7 time stamp, as precise as it is; other texts as in ``fhir_date``."""
    text = F.trim(v.cast("string"))
    day = F.regexp_extract(text, r"^(\d{8})(\d{2}){0,3}(\.\d+)?([+-]\d{4})?$", 1)
    month = F.when(text.rlike(r"^\d{6}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2)))
    return F.coalesce(F.date_format(F.try_to_timestamp(day, F.lit("yyyyMMdd")), "yyyy-MM-dd"), month, F.nullif(iso_date(v, c, r), F.lit("")))


def _each(c: Mapping, r: Record, build: Callable[[str, Column], Column]) -> Column:
    """One struct per field of ``fields`` (name: label) that isn't null or blank; null where there is none."""
    parts = [(label, r(f).cast("string")) for f, label in c["fields"].items()]
    found = F.filter(F.array(*(F.when(F.trim(p) != "", build(label, p)) for label, p in parts)), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found)


@register("identifiers")
def identifiers(v: Column, c: Mapping, r: Record) -> Column:
    """Identifiers of the ``fields`` (name: type code of HL7 table 0203)."""
    kind = lambda code: codeable_concept(F.lit(code), {"system": "http://terminology.hl7.org/CodeSystem/v2-0203"}, r)
    return _each(c, r, lambda code, p: F.struct(kind(code).alias("type"), p.alias("value")))


@register("extensions")
def extensions(v: Column, c: Mapping, r: Record) -> Column:
    """Extensions of the ``fields`` (name: address)."""
    return _each(c, r, lambda url, p: F.struct(F.lit(url).alias("url"), p.alias("valueString")))


@register("first")
def first(v: Column, c: Mapping, r: Record) -> Column:
    """The value, else the first part in ``else`` (field name: paths) that isn't null or blank."""
    parts = [v.cast("string"), *(inner(r(f), paths) if paths else r(f).cast("string") for f, paths in c.get("else", {}).items())]
    return F.coalesce(*(F.when(F.trim(p) != "", p) for p in parts))


@register("extract_name")
def extract_name(v: Column, c: Mapping, r: Record) -> Column:
    """A person's name as text: its own text, else given names and family."""
    given = F.regexp_replace(F.regexp_replace(inner(v, ["given"], plain=False), r'[\["\]]', ""), ",", " ")
    whole = F.concat_ws(" ", given, inner(v, ["family"], plain=False))
    return F.coalesce(inner(v, ["text"]), F.nullif(whole, F.lit("")))


@register("archetype_wrap")
def archetype_wrap(v: Column, c: Mapping, r: Record) -> Column:
    return F.struct(F.lit(c.get("archetype", "")).alias("archetype_node_id"), v.alias("value"))
