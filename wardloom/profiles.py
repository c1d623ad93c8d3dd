"""Resource profiles: required elements and invariants, from definitions the user supplies."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.standards import Standard


def compile_path(expression: str, columns: set[str]) -> Column | None:
    """A Boolean Column for a small subset of path expressions, null where it isn't supported.

    Supported: ``a.exists()``, ``a.empty()``, ``a.count() op n``, ``a = 'text'``, joined by and, or, implies.
    """
    text = expression.strip()
    for word, join in (
        ("implies", lambda a, b: ~a | b),
        ("or", lambda a, b: a | b),
        ("and", lambda a, b: a & b),
    ):
        parts = re.split(rf"\s+{word}\s+", text, maxsplit=1)
        if len(parts) == 2:
            sides = [compile_path(p, columns) for p in parts]
            return join(*sides) if all(s is not None for s in sides) else None
    name = lambda p: F.col(p) if p.split(".")[0] in columns else F.lit(None)
    if m := re.fullmatch(r"([\w.]+)\.exists\(\)", text):
        return name(m[1]).isNotNull()
    if m := re.fullmatch(r"([\w.]+)\.empty\(\)", text):
        return name(m[1]).isNull()
    if m := re.fullmatch(r"([\w.]+)\.count\(\)\s*(<=|>=|=|<|>)\s*(\d+)", text):
        n = F.coalesce(F.size(name(m[1])), F.lit(0))
        k = int(m[3])
        return {"<=": n <= k, ">=": n >= k, "=": n == k, "<": n < k, ">": n > k}[m[2]]
    if m := re.fullmatch(r"([\w.]+)\s*=\s*'([^']*)'", text):
        return F.coalesce(name(m[1]).cast("string") == m[2], F.lit(False))
    return None


def parse(lines: DataFrame, standard: Standard, entity: str, column: str = "value") -> DataFrame:
    """JSON ``lines`` as typed rows of ``entity``; ``malformed`` holds the text of lines that don't fit the types."""
    schema = standard.schema(entity).add("malformed", "string")
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"})
    return lines.select(parsed.alias("r")).select("r.*")


def validate(resources: DataFrame, key: str, profile: Mapping) -> DataFrame:
    """``(key, path, severity, issue)``, one row per failure, and one of severity 'information' per unread invariant.

    ``profile``: ``type``, optional ``url`` (resources must claim it in
    ``meta.profile``), ``required`` fields, ``invariants`` {id: expression}.
    An invariant beyond the subset is no failure; where there are resources
    it comes out once, with a null key.
    """
    columns = set(resources.columns)
    rows = resources
    if "resourceType" in columns:
        rows = rows.where(F.col("resourceType") == profile["type"])
    if profile.get("url"):
        rows = rows.where(F.exists("meta.profile", lambda p: F.contains(p, F.lit(profile["url"])))) if "meta" in columns else rows.where("false")
    issue = lambda path, text: F.struct(F.lit(path).alias("path"), F.lit("error").alias("severity"), F.lit(text).alias("issue"))
    found = [F.when(F.col(f).isNull(), issue(f, "required")) if f in columns else issue(f, "required") for f in profile.get("required", ())]
    unread: list[str] = []
    for name, expression in profile.get("invariants", {}).items():
        holds = compile_path(expression, columns)
        if holds is None:
            unread.append(name)
        else:
            found.append(F.when(~holds, issue(name, "invariant")))
    if not found:
        found = [F.when(F.lit(False), issue("", ""))]
    out = rows.select(F.col(key), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select(key, "i.*")
    if unread:
        told = [F.struct(F.lit(n).alias("path"), F.lit("information").alias("severity"), F.lit("invariant not read").alias("issue")) for n in unread]
        note = rows.limit(1).select(F.lit(None).cast(dict(rows.dtypes)[key]).alias(key), F.explode(F.array(*told)).alias("i")).select(key, "i.*")
        out = out.unionByName(note)
    return out


def report(issues: DataFrame, checked: DataFrame, key: str) -> DataFrame:
    """One row: resources checked, failures, whether no error was found."""
    n = checked.agg(F.count("*").alias("resources"))
    e = issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_distinct(F.when(F.col("severity") == "error", F.col(key))).alias("failing"))
    return n.crossJoin(e).withColumn("passed", F.col("errors") == 0)  # one row each
