"""Queries of the general training-data problems (1, 4, 5, 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions import units as U
from wardloom.operators import asof, hierarchy, orphans, units
from wardloom.plans.tables import table


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.parent_links(table(spark, d, "concept_relationship"), table(spark, d, "concept"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve(_links(spark, d)).select(
        F.col("node").alias("concept_id"), F.col("root").alias("root_concept_id"), "depth"
    )


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve(_links(spark, d), paths=True).select(
        F.col("node").alias("concept_id"),
        F.col("root").alias("root_concept_id"),
        "depth",
        "steps",
        "from_cycle",
        F.array_join(F.col("path").cast("array<string>"), ">").alias("path"),
    )


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.resolve(_links(spark, d), paths=True))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Every parent-child link with the part of the hierarchy it lies in; cycles and unused links show here."""
    links = _links(spark, d)
    report = hierarchy.link_report(links, hierarchy.resolve(links))
    return report.withColumnsRenamed({"node": "concept_id", "parent": "parent_concept_id"})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Recorded units only, as TESTDATA.md asks; the values whose unit the mixtures find are in :func:`p4_common`."""
    return (
        units.stated_values(table(spark, d, "observations"), table(spark, d, "unit_reference"))
        .where(~F.col("is_common"))
        .select(
            "observation_id", F.round(F.col("common_value") * 1000).cast("long").alias("common_value_milli")
        )
        .distinct()
    )


def p4_common(spark: SparkSession, d: str) -> DataFrame:
    """Every value in the common unit, with how its unit was found."""
    return (
        units.harmonise(table(spark, d, "observations"), table(spark, d, "unit_reference"))
        .select(
            "observation_id",
            "lab_code",
            "unit_symbol",
            "how",
            F.round("posterior", 3).alias("posterior"),
            F.round("common_value", 4).alias("common_value"),
        )
        .distinct()
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    revisions = table(spark, d, "concept_revision").withColumn("code", asof.code_key(F.col("concept_code")))
    known = asof.known_intervals(
        revisions, "code", "valid_start_date", "valid_end_date", "released_on", ["released_on", "revision_id"]
    )
    events = table(spark, d, "conditions").select(
        "condition_id", asof.code_key(F.col("dx_code")).alias("code"), "onset_date"
    )
    return (
        asof.asof_join(events, known.drop("released_on"), "code", "onset_date")
        .select("condition_id", "revision_id")
        .distinct()
    )


def _references(spark: SparkSession, d: str) -> list[tuple[DataFrame, DataFrame]]:
    patient = orphans.text_key(F.col("patient_id"))
    by_patient = None
    for name, record in (("conditions", "condition_id"), ("medications", "medication_id"), ("observations", "observation_id")):
        refs = orphans.references(table(spark, d, name), name, record, patient, "received_at")
        by_patient = refs if by_patient is None else by_patient.unionByName(refs)
    concepts = table(spark, d, "concept")
    concept_keys = orphans.parents(concepts, F.col("concept_id"), "received_at", "deleted_at")
    canonical = orphans.parents(table(spark, d, "canonical_concept"), F.col("concept_id"))
    edges = orphans.references(
        table(spark, d, "concept_relationship"), "concept_relationship", "edge_id", F.col("concept_id_2"), "received_at"
    )
    vectors = orphans.references(
        table(spark, d, "pgvector_backend"), "pgvector_backend", "concept_id", F.col("concept_id"), "indexed_at"
    )
    return [
        (by_patient, orphans.parents(table(spark, d, "patients"), patient, "received_at", "deleted_at")),
        (edges, orphans.merge_intervals(concept_keys, canonical)),
        (vectors, concept_keys),
    ]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [orphans.orphans(refs, keys) for refs, keys in _references(spark, d)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p6_found(spark, d))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_paths, p1_descendants, p1_links, p4_found, p4_common, p5_found, p6_found, p6_report)
}

_LINKS = """
WITH RECURSIVE known AS (SELECT DISTINCT concept_id FROM concept),
raw AS (
  SELECT regexp_replace(lower(relationship_id), '[^a-z]', '', 'g') AS r, concept_id_1 AS a, concept_id_2 AS b
  FROM concept_relationship WHERE trim(coalesce(invalid_reason, '')) = ''
), e AS (
  SELECT DISTINCT CASE WHEN r = 'isa' THEN a ELSE b END AS node, CASE WHEN r = 'isa' THEN b ELSE a END AS parent
  FROM raw WHERE r IN ('isa', 'subsumes') AND a <> b
    AND a IN (SELECT concept_id FROM known) AND b IN (SELECT concept_id FROM known)
), ends AS (SELECT node FROM e UNION SELECT parent FROM e),
"""
_TREE = """
walk AS (  -- upwards from each node, around a cycle once
  SELECT node AS start, node, CAST(0 AS BIGINT) AS steps, [node] AS seen FROM ends
  UNION ALL
  SELECT w.start, e.parent, w.steps + 1, list_append(w.seen, e.parent)
  FROM walk w JOIN e ON e.node = w.node WHERE NOT list_contains(w.seen, e.parent)
), ring AS (
  SELECT DISTINCT w.start AS node FROM walk w JOIN e ON e.node = w.node AND e.parent = w.start
), top AS (  -- where a way upwards must end: the root, or the smallest id of the cycle
  SELECT w.start AS node, coalesce(min(w.node) FILTER (w.node IN (SELECT node FROM ring)), max(w.node) FILTER (w.node NOT IN (SELECT node FROM e))) AS root,
    min(w.steps) FILTER (w.node IN (SELECT node FROM ring)) AS from_cycle
  FROM walk w GROUP BY w.start
), found AS (
  SELECT t.node, t.root, CASE WHEN from_cycle = 0 THEN -1 WHEN from_cycle > 0 THEN -2 ELSE w.steps END AS depth,
    w.steps, t.from_cycle, array_to_string(list_reverse(w.seen), '>') AS path
  FROM top t JOIN walk w ON w.start = t.node AND w.node = t.root
)
"""

def _units_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(sym)})" for sym, keys in U.SPELLINGS.items() for k in keys)
    keys = sorted({k for keys in U.SPELLINGS.values() for k in keys}, key=lambda k: (-len(k), k))
    import re

    alt = lambda ks: "|".join(r"\s?".join(map(re.escape, k)) for k in ks)
    cue = rf"\b(?:{'|'.join(U.CUES)})\s*:?\s*[(\[]?\s*|[(\[]\s*"
    number = r"(?:^|[\s:])\d+(?:[.,]\d+)?"
    wordy = alt([k for k in keys if not k[0].isdigit()])
    text = rf"(?:(?:{cue})({alt(keys)})|{number}\s*({wordy})|{number}\s+({alt(keys)}))(?:$|[^\w/^*%])"
    plain = "translate(lower({}), 'µμ⁹³', 'uu93')"
    key = lambda c: rf"regexp_replace({plain.format(c)}, '\s+|\.\s*$', '', 'g')"
    return rf"""
WITH spelled(k, sym) AS (VALUES {values}),
obs AS (SELECT DISTINCT observation_id, lab_code, lab_value, lab_unit, lab_text, lab_description FROM observations
  WHERE lab_value IS NOT NULL AND NOT isnan(lab_value)),
parts AS (
  SELECT *, regexp_extract({plain.format('lab_text')}, {quote(text)}, ['a', 'b', 'c']) AS m FROM obs
), cand AS (
  SELECT observation_id, lab_code, lab_value, 1 AS p, {key('lab_unit')} AS k FROM parts
  UNION ALL SELECT observation_id, lab_code, lab_value, 2, {key('concat(m.a, m.b, m.c)')} FROM parts
  UNION ALL SELECT observation_id, lab_code, lab_value, 3, {key(r"regexp_extract(lab_description, '\((.*)\)\s*$', 1)")} FROM parts
  UNION ALL SELECT observation_id, lab_code, lab_value, 4, {key(r"regexp_extract(lab_description, '\s\[(.*)\]\s*$', 1)")} FROM parts
  UNION ALL SELECT observation_id, lab_code, lab_value, 5, {key(r"regexp_extract(lab_description, ',\s*([^,]*)$', 1)")} FROM parts
), told AS (
  SELECT c.observation_id, c.lab_value, arg_min(u, c.p) AS u
  FROM cand c JOIN spelled s ON s.k = c.k
  JOIN unit_reference u ON u.lab_code = c.lab_code AND u.unit_symbol = s.sym
  GROUP BY ALL
)
SELECT DISTINCT observation_id,
  CAST(round((lab_value * u.to_common_factor + coalesce(u.to_common_offset, 0)) * 1000) AS BIGINT) AS common_value_milli
FROM told WHERE NOT u.is_common
"""


_ORPHANS = """
WITH never AS (SELECT TIMESTAMP '9999-12-31 00:00:00' AS t, TIMESTAMP '0001-01-01 00:00:00' AS z),
refs AS (
  SELECT 'conditions' AS table_name, condition_id AS record_id, nullif(upper(trim(patient_id)), '') AS k, received_at AS tm, 'p' AS side FROM conditions
  UNION ALL SELECT 'medications', medication_id, nullif(upper(trim(patient_id)), ''), received_at, 'p' FROM medications
  UNION ALL SELECT 'observations', observation_id, nullif(upper(trim(patient_id)), ''), received_at, 'p' FROM observations
  UNION ALL SELECT 'concept_relationship', edge_id, CAST(concept_id_2 AS VARCHAR), received_at, 'e' FROM concept_relationship
  UNION ALL SELECT 'pgvector_backend', concept_id, CAST(concept_id AS VARCHAR), indexed_at, 'v' FROM pgvector_backend
), raw AS (
  SELECT 'p' AS side, nullif(upper(trim(patient_id)), '') AS k, received_at AS born, deleted_at AS gone FROM patients
  UNION ALL SELECT 'e', CAST(concept_id AS VARCHAR), received_at, deleted_at FROM concept
  UNION ALL SELECT 'v', CAST(concept_id AS VARCHAR), received_at, deleted_at FROM concept
  UNION ALL SELECT 'e', CAST(concept_id AS VARCHAR), NULL, NULL FROM canonical_concept
), par AS (
  SELECT DISTINCT side, k, coalesce(born, z) AS born, coalesce(gone, t) AS gone FROM raw, never WHERE k IS NOT NULL
), met AS (
  SELECT refs.table_name, refs.record_id, refs.tm, count(born) AS n, bool_or(born <= tm) AS known, bool_or(born <= tm AND gone > tm) AS alive
  FROM refs LEFT JOIN par USING (side, k) WHERE refs.k IS NOT NULL AND record_id IS NOT NULL
  GROUP BY refs.side, refs.k, refs.table_name, refs.record_id, refs.tm
), found AS (
  SELECT DISTINCT table_name, record_id, strftime(tm, '%Y-%m') AS period,
    CASE WHEN n = 0 THEN 'missing' WHEN tm IS NULL OR alive THEN NULL WHEN known THEN 'deleted' ELSE 'late' END AS kind
  FROM met
)
"""

ORACLE = {
    "p1_found": "SELECT node AS concept_id, root AS root_concept_id, depth FROM found",
    "p1_paths": "SELECT node AS concept_id, root AS root_concept_id, depth, steps, from_cycle, path FROM found",
    "p1_descendants": "SELECT node AS ancestor, start AS descendant, steps AS distance FROM walk WHERE steps > 0",
    "p1_links": "SELECT e.node AS concept_id, e.parent AS parent_concept_id, CASE WHEN from_cycle = 0 THEN 'on cycle' "
    "WHEN from_cycle > 0 THEN 'below cycle' ELSE 'tree' END AS status FROM e JOIN found USING (node)",
    "p4_found": _units_sql(),
    "p5_found": """
WITH ev AS (SELECT DISTINCT condition_id, replace(upper(trim(dx_code)), '.', '') AS code, onset_date FROM conditions),
m AS (
  SELECT e.condition_id, r.revision_id,
    row_number() OVER (PARTITION BY e.condition_id, e.code, e.onset_date ORDER BY r.released_on DESC, r.revision_id DESC) AS n
  FROM ev e JOIN concept_revision r ON replace(upper(trim(r.concept_code)), '.', '') = e.code
    AND e.code <> '' AND e.onset_date >= r.valid_start_date AND e.onset_date <= coalesce(r.valid_end_date, DATE '9999-12-31')
    AND r.released_on <= e.onset_date
)
SELECT DISTINCT condition_id, revision_id FROM m WHERE n = 1
""",
    "p6_found": _ORPHANS + "SELECT table_name, record_id, period, kind FROM found WHERE kind IS NOT NULL",
    "p6_report": _ORPHANS
    + 'SELECT table_name, period, kind, count(*) AS "references" FROM found WHERE kind IS NOT NULL GROUP BY ALL',
}
for _name in ("p1_found", "p1_paths", "p1_descendants", "p1_links"):
    ORACLE[_name] = _LINKS + _TREE + ORACLE[_name]
