"""Rules, expectations, scores and gates of data quality."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

RESULT = "rule_id string, severity string, passed boolean, total_rows long, failed_count long"
KINDS = ("range", "regex", "enum", "temporal_order", "fk_exists")
# Code lists of the FHIR specification.
OBSERVATION_STATUS = ("registered", "preliminary", "final", "amended", "corrected", "cancelled", "entered-in-error", "unknown")
REQUEST_INTENT = ("proposal", "plan", "order", "original-order", "reflex-order", "filler-order", "instance-order", "option")


@dataclass(frozen=True)
class Rule:
    """A plausibility rule; what it needs besides ``column`` depends on ``kind``.

    ``latest`` is a fixed moment that takes the place of ``after``.
    """

    id: str
    kind: str
    column: str = ""
    severity: str = "error"
    low: float | None = None
    high: float | None = None
    pattern: str = ""
    values: tuple = ()
    before: str = ""
    after: str = ""
    latest: str = ""
    ref_table: str = ""
    ref_column: str = ""

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown rule type {self.kind!r}")
        if self.severity not in ("error", "warn"):
            raise ValueError(f"unknown severity {self.severity!r}")


def parse_rule(spec: Mapping) -> Rule:
    """A rule from configuration; keys that no rule has are refused."""
    names = {"type": "kind", "min": "low", "max": "high"}
    given = {names.get(k, k): tuple(v) if isinstance(v, list) else v for k, v in spec.items()}
    if extra := set(given) - set(Rule.__dataclass_fields__):
        raise ValueError(f"unknown keys: {', '.join(sorted(extra))}")
    return Rule(**given)


def moment(c: Column) -> Column:
    """A timestamp from a date, a timestamp or text; null where it can't be read."""
    return F.try_to_timestamp(c.cast("string"))


def _figures(rule: Rule) -> tuple[Column, Column]:
    """(rows looked at, rows that fail) as aggregates."""
    col = F.col(f"`{rule.column}`") if rule.column else None
    if rule.kind == "range":
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (col < rule.low)
        if rule.high is not None:
            bad = bad | (col > rule.high)
        return F.count(col), F.count_if(bad)
    if rule.kind == "regex":
        return F.count(col), F.count_if(~col.cast("string").rlike(f"^(?:{rule.pattern})"))
    if rule.kind == "enum":
        return F.count(col), F.count_if(~col.isin(*rule.values))
    before, after = moment(F.col(f"`{rule.before}`")), moment(F.lit(rule.latest) if rule.latest else F.col(f"`{rule.after}`"))
    return F.count_if(before.isNotNull() & after.isNotNull()), F.count_if(before > after)


def _needs(rule: Rule) -> set[str]:
    if rule.kind == "temporal_order":
        return {rule.before} if rule.latest else {rule.before, rule.after}
    return {rule.column}


def evaluate(df: DataFrame, rules: Iterable[Rule], refs: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """One row per rule. All rules on the table's own columns share one scan; references are anti-joins.

    A rule whose column or reference table is missing passes over 0 rows.
    Nulls are neither counted nor fail.
    """
    rules, refs, spark = list(rules), dict(refs or {}), df.sparkSession
    present = set(df.columns)
    own = [r for r in rules if r.kind != "fk_exists" and _needs(r) <= present]
    foreign = [
        r for r in rules
        if r.kind == "fk_exists" and r.column in present and r.ref_table in refs and r.ref_column in refs[r.ref_table].columns
    ]
    skipped = [r for r in rules if r not in own and r not in foreign]
    parts = []
    if own:
        aggs = [a for i, r in enumerate(own) for a, n in zip(_figures(r), "tf") for a in [a.alias(f"{n}{i}")]]
        each = [_result(r, F.col(f"t{i}"), F.col(f"f{i}")) for i, r in enumerate(own)]
        parts.append(df.agg(*aggs).select(F.inline(F.array(*each))))
    for r in foreign:
        keys = df.where(F.col(r.column).isNotNull()).groupBy(F.col(r.column).cast("string").alias("_k")).agg(F.count("*").alias("_n"))
        ref = refs[r.ref_table].select(F.col(r.ref_column).cast("string").alias("_k")).where("_k is not null").distinct()
        found = keys.join(ref.withColumn("_hit", F.lit(True)), "_k", "left")
        sums = found.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("_n"))), F.lit(0)).alias("f")
        )
        parts.append(sums.select(F.inline(F.array(_result(r, F.col("t"), F.col("f"))))))
    if skipped:
        parts.append(spark.createDataFrame([(r.id, r.severity, True, 0, 0) for r in skipped], RESULT))
    if not parts:
        return spark.createDataFrame([], RESULT)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _result(rule: Rule, total: Column, failed: Column) -> Column:
    return F.struct(
        F.lit(rule.id).alias("rule_id"),
        F.lit(rule.severity).alias("severity"),
        (failed == 0).alias("passed"),
        total.cast("long").alias("total_rows"),
        failed.cast("long").alias("failed_count"),
    )


def domain_match(df: DataFrame, column: str, concepts: DataFrame, domain: str, rule_id: str = "domain_match") -> DataFrame:
    """Non-null concept ids whose concept is missing or of another domain."""
    keys = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("_k")).agg(F.count("*").alias("_n"))
    ref = concepts.groupBy(F.col("concept_id").cast("long").alias("_k")).agg(F.max((F.col("domain_id") == domain).cast("int")).alias("_ok"))
    sums = keys.join(ref, "_k", "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("t"),
        F.coalesce(F.sum(F.when(F.coalesce("_ok", F.lit(0)) == 0, F.col("_n"))), F.lit(0)).alias("f"),
    )
    return sums.select(F.inline(F.array(_result(Rule(rule_id, "enum", column), F.col("t"), F.col("f")))))


def coded_rules(entity: str, year: int = 2026, today: str = "2026-01-01") -> list[Rule]:
    """Built-in rules of an entity; ``today`` is the last birth date that isn't in the future."""
    table = {
        "person": [
            Rule("age_in_range", "range", "year_of_birth", "warn", year - 125, year),
            Rule("birth_before_death", "temporal_order", before="birth_datetime", after="death_datetime"),
            Rule("gender_fk", "fk_exists", "gender_concept_id", ref_table="concept", ref_column="concept_id"),
        ],
        "condition_occurrence": [
            Rule("condition_dates", "temporal_order", before="condition_start_date", after="condition_end_date"),
            Rule("condition_fk", "fk_exists", "condition_concept_id", ref_table="concept", ref_column="concept_id"),
        ],
        "Patient": [Rule("birthdate_not_future", "temporal_order", before="birthDate", latest=today)],
        "Observation": [Rule("observation_status", "enum", "status", values=OBSERVATION_STATUS)],
        "MedicationRequest": [Rule("request_intent", "enum", "intent", values=REQUEST_INTENT)],
    }
    return table.get(entity, [])


def scores(results: DataFrame) -> DataFrame:
    """Share of passed rules per ``category``; 1 where there are none is the caller's default."""
    return results.groupBy("category").agg(
        F.count("*").alias("rules"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("score")
    )


@dataclass
class Gate:
    """Limits on the three scores and on failing error rules."""

    limits: Mapping[str, float] = field(default_factory=lambda: {"completeness": 0.95, "conformance": 0.98, "plausibility": 0.90})

    def passed(self, results: DataFrame) -> bool:
        got = {r["category"]: r["score"] for r in scores(results).collect()}  # at most a few categories
        broken = results.where("severity = 'error' and not passed and total_rows > 0 and category = 'plausibility'")
        return all(got.get(c, 1.0) >= x for c, x in self.limits.items()) and broken.isEmpty()


def expectations(df: DataFrame, required: Iterable[str], codes: Iterable[str] = (), dates: Iterable[str] = ()) -> DataFrame:
    """Rule rows with a category: columns that must exist, codes at least 0 (19 of 20), dates not null (9 of 10).

    Codes that are no numbers have no lower bound and give no row.
    """
    present = dict(df.dtypes)
    spark = df.sparkSession
    exist = [(f"column_exists:{c}", "error", c in present, 1, int(c not in present), "completeness") for c in required]
    out = spark.createDataFrame(exist, RESULT + ", category string")
    checks = [("code_not_negative", c, F.count(c), F.count_if(F.col(c) < 0), 0.95, "conformance") for c in codes if isinstance(df.schema[c].dataType if c in present else None, NumericType)]
    checks += [("date_not_null", c, F.count("*"), F.count_if(F.col(c).isNull()), 0.90, "completeness") for c in dates if c in present]
    if checks:
        aggs = [a.alias(f"{n}{i}") for i, (_, _, t, f, _, _) in enumerate(checks) for a, n in ((t, "t"), (f, "f"))]
        each = [
            F.struct(
                F.lit(f"{name}:{c}").alias("rule_id"),
                F.lit("error").alias("severity"),
                (F.col(f"f{i}") <= (1 - mostly) * F.col(f"t{i}")).alias("passed"),
                F.col(f"t{i}").alias("total_rows"),
                F.col(f"f{i}").alias("failed_count"),
                F.lit(category).alias("category"),
            )
            for i, (name, c, _, _, mostly, category) in enumerate(checks)
        ]
        out = out.unionByName(df.agg(*aggs).select(F.inline(F.array(*each))))
    return out


def zero_rate(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Per concept column the percentage of rows that are 0 or null; above 50 an error, above 0 a warning."""
    columns = list(columns)
    stats = df.agg(*(F.avg((F.coalesce(F.col(c), F.lit(0)) == 0).cast("double")).alias(f"z{i}") for i, c in enumerate(columns)))
    each = [F.struct(F.lit(c).alias("column_name"), F.round(100 * F.coalesce(f"z{i}", F.lit(0.0)), 4).alias("zero_pct")) for i, c in enumerate(columns)]
    level = F.when(F.col("zero_pct") > 50, "error").when(F.col("zero_pct") > 0, "warning").otherwise("ok")
    return stats.select(F.inline(F.array(*each))).withColumn("level", level)


def null_issues(df: DataFrame, columns: Iterable[str], most: float = 10.0) -> DataFrame:
    """Per required column the percentage of nulls, an error above ``most``."""
    columns = list(columns)
    stats = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(f"z{i}") for i, c in enumerate(columns)))
    each = [F.struct(F.lit(c).alias("column_name"), F.round(100 * F.coalesce(f"z{i}", F.lit(0.0)), 4).alias("null_pct")) for i, c in enumerate(columns)]
    return stats.select(F.inline(F.array(*each))).withColumn("level", F.when(F.col("null_pct") > most, "error").otherwise("ok"))


def date_bounds(df: DataFrame, columns: Iterable[str], first: int = 1900, last: int = 2100) -> DataFrame:
    """Per date column the rows whose year is out of bounds."""
    columns = list(columns)
    year = lambda c: F.year(moment(F.col(c)))
    stats = df.agg(*(F.count_if((year(c) < first) | (year(c) > last)).alias(f"n{i}") for i, c in enumerate(columns)))
    return stats.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("out_of_bounds")) for i, c in enumerate(columns)))))


def orphan_rows(df: DataFrame, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    """Rows whose key is null or has no row in ``ref``."""
    keys = ref.select(F.col(ref_column).alias(column)).where(F.col(column).isNotNull()).distinct()
    return df.join(keys, column, "left_anti")


def output_issues(tables: Mapping[str, DataFrame], required: Mapping[str, Iterable[str]]) -> list[tuple[str, str, str]]:
    """(table, level, text) for required tables and columns that are missing."""
    out = []
    for name, columns in required.items():
        if name not in tables:
            out.append((name, "error", "table is missing"))
            continue
        out += [(name, "error", f"column {c} is missing") for c in columns if c not in tables[name].columns]
    return out


def distribution_drift(df: DataFrame, column: str, quantiles: Mapping[float, float], tolerance: float) -> DataFrame:
    """Quantiles of a column against stored ones: drift is the difference over the stored spread."""
    ps = sorted(quantiles)
    spread = (max(quantiles.values()) - min(quantiles.values())) or 1.0
    got = df.agg(F.percentile_approx(F.col(column).cast("double"), ps, 10_000).alias("q"))
    each = [
        F.struct(F.lit(float(p)).alias("quantile"), F.round(F.abs(F.col("q")[i] - quantiles[p]) / spread, 6).alias("drift"))
        for i, p in enumerate(ps)
    ]
    return got.select(F.inline(F.array(*each))).withColumn("drifted", F.col("drift") > tolerance)


def text_report(results: DataFrame) -> str:
    """Rule results as text, failing ones first."""
    rows = results.orderBy("passed", "rule_id").collect()  # one row per rule
    lines = [f"{sum(r['passed'] for r in rows)} of {len(rows)} rules passed"]
    lines += [f"{'ok  ' if r['passed'] else 'FAIL'} {r['rule_id']} ({r['severity']}): {r['failed_count']} of {r['total_rows']}" for r in rows]
    return "\n".join(lines)
