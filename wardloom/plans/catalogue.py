"""One query per operator family over whole tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom import etl, profiles, standards
from wardloom.functions import text as TX
from wardloom.functions import transforms
from wardloom.operators import columns as C
from wardloom.operators import crossmap, lifecycle
from wardloom.operators import quality as Q
from wardloom.operators import relational as R
from wardloom.operators import retrieval as RT
from wardloom.operators import schema_map as SM
from wardloom.operators import vocabulary as V
from wardloom.plans.tables import table
from wardloom.sources import interchange
from wardloom.standards import crossmaps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SEGMENTS = {"AUTOMOBILE": 11, "BUILDING": 12, "FURNITURE": 13, "MACHINERY": 14}
STATUS = {"O": 1, "F": 2}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def values(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def sql_values(*rows: tuple) -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows) + ")"


# Projection, lookup, routing


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS status_concept_id FROM orders")
def q_map_column_literal(spark, d):
    return R.map_column(table(spark, d, "orders"), "o_orderstatus", STATUS, "status_concept_id").select("o_orderkey", "status_concept_id")


@query(
    "SELECT l_orderkey, l_linenumber, coalesce(p.p_size, 0) AS size_concept_id FROM lineitem l "
    "LEFT JOIN (SELECT p_partkey, max(p_size) AS p_size FROM part GROUP BY 1) p ON l.l_partkey = p.p_partkey"
)
def q_map_column_join(spark, d):
    side = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("value"))
    return R.map_column(table(spark, d, "lineitem"), "l_partkey", side, "size_concept_id").select(
        "l_orderkey", "l_linenumber", "size_concept_id"
    )


@query(
    "SELECT l_orderkey AS order_id, CAST(l_quantity AS BIGINT) AS quantity, l_linestatus AS l_returnflag, l_returnflag AS l_linestatus FROM lineitem"
)
def q_transform(spark, d):
    return R.transform(
        table(spark, d, "lineitem"),
        {"l_orderkey": "order_id", "l_quantity": "quantity", "l_returnflag": "l_linestatus", "l_linestatus": "l_returnflag", "absent": "x"},
        {"quantity": "bigint"},
        ["order_id", "quantity", "l_returnflag", "l_linestatus", "nowhere"],
    )


_ROUTES = [
    {"source_column": "patient_id", "target_table": "person", "target_column": "person_source_value", "status": "approved"},
    {"source_column": "dob", "target_table": "person", "target_column": "birth_datetime", "status": "auto_accepted"},
    {"source_column": "gender", "target_table": "person", "target_column": "gender_source_value", "status": "approved"},
    {"source_column": "gender", "target_table": "person", "target_column": "race_source_value", "status": "rejected"},
    {"source_column": "state", "target_table": "location", "target_column": "state", "status": "approved"},
    {"source_column": "pt_zip", "target_table": "note", "target_column": "note_title", "override_target_table": "location", "override_target_column": "zip", "status": "overridden"},
]


@query("SELECT patient_id AS person_source_value, CAST(dob AS VARCHAR) AS birth_datetime, gender AS gender_source_value FROM patients")
def q_route_person(spark, d):
    return R.route(table(spark, d, "patients"), _ROUTES)["person"].withColumn("birth_datetime", F.col("birth_datetime").cast("string"))


@query("SELECT state, pt_zip AS zip FROM patients")
def q_route_location(spark, d):
    return R.route(table(spark, d, "patients"), _ROUTES)["location"]


_LOOKUPS = (("gender", "M", 8507, 1), ("gender", "F", 8532, 2), ("gender", "M", 8508, 0), ("state", "x", 9, 3))


@query(
    "SELECT patient_id AS person_source_value, gender AS gender_source_value, "
    "CAST(CASE gender WHEN 'M' THEN 8507 WHEN 'F' THEN 8532 ELSE 0 END AS BIGINT) AS gender_concept_id FROM patients"
)
def q_etl_person(spark, d):
    items = values(spark, "source_column string, source_code string, target_concept_id long, item int", *_LOOKUPS)
    result = etl.plan(table(spark, d, "patients"), [i for i in _ROUTES if i["source_column"] in ("patient_id", "gender")], R.lookup_table(items), {"gender": "gender"})
    return result.tables["person"]


@query("SELECT CAST(NULLIF(regexp_replace(patient_id, '[^0-9]', '', 'g'), '') AS INTEGER) AS person_id, CAST(dob AS TIMESTAMP) AS birth_datetime, gender AS gender_source_value FROM patients")
def q_cast_to_target(spark, d):
    df = table(spark, d, "patients").select(
        F.nullif(F.regexp_replace("patient_id", "[^0-9]", ""), F.lit("")).alias("person_id"),
        F.col("dob").alias("birth_datetime"),
        F.col("gender").alias("gender_source_value"),
    )
    return etl.cast_to(df, standards.load("omop"), "person")


@query(
    "SELECT 'location_id' AS column_name, count(*) FILTER (WHERE pt_zip IS NOT NULL AND TRY_CAST(pt_zip AS INTEGER) IS NULL) AS rejected FROM patients "
    "UNION ALL SELECT 'birth_datetime', 0"
)
def q_cast_rejects(spark, d):
    df = table(spark, d, "patients").select(F.col("pt_zip").alias("location_id"), F.col("dob").alias("birth_datetime"))
    return etl.cast_rejects(df, standards.load("omop"), "person")


_ITEMS = (
    ("a", "person", "id", None, None, "approved"),
    ("b", "person", "sex", "person", "gender", "overridden"),
    ("c", "visit", "day", None, None, "rejected"),
    ("d", "visit", "end", None, None, "auto_accepted"),
    ("e", None, None, "visit", "start", "needs_review"),
)
_ITEM_SCHEMA = "source_column string, target_table string, target_column string, override_target_table string, override_target_column string, status string"


@query(
    "SELECT a AS source_column, coalesce(e, b) AS target_table, coalesce(f, c) AS target_column, s AS status FROM "
    + sql_values(*_ITEMS)
    + " t(a, b, c, e, f, s) WHERE s IN ('approved', 'auto_accepted', 'overridden')"
)
def q_effective_targets(spark, d):
    return R.effective_targets(values(spark, _ITEM_SCHEMA, *_ITEMS))


# Profiles


def _profile_sql(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, "
        f"round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_pct, count(DISTINCT {c}) AS n_unique, "
        f"CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM {name}"
        for c in columns
    )


_PATIENT_COLUMNS = ["patient_id", "given_name", "family_name", "gender", "pt_zip", "state", "phone"]


@query(_profile_sql("patients", _PATIENT_COLUMNS))
def q_profile(spark, d):
    return R.profile(table(spark, d, "patients"), _PATIENT_COLUMNS)


@query(
    " UNION ALL ".join(
        f"(SELECT '{c}' AS column_name, value, n FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM orders "
        f"WHERE {c} IS NOT NULL GROUP BY 1) WHERE (SELECT count(DISTINCT {c}) FROM orders) <= 100 ORDER BY n DESC, value LIMIT 10)"
        for c in ("o_orderstatus", "o_orderpriority", "o_custkey")
    )
)
def q_top_values(spark, d):
    return R.top_values(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 1.0 / count(*), 6) AS null_fraction, "
        f"count(DISTINCT {c}) AS unique_count, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, "
        f"round(avg({c}), 4) AS mean_value, round(stddev_samp({c}), 4) AS std_value FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
    )
)
def q_column_stats(spark, d):
    return R.column_stats(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag"])


@query("SELECT lab_unit AS value, count(*) AS n FROM observations GROUP BY 1 ORDER BY n DESC, value NULLS FIRST LIMIT 1000")
def q_distinct_values(spark, d):
    return R.distinct_values(table(spark, d, "observations"), "lab_unit")


@query(
    "WITH p AS (SELECT med_code AS c, med_description AS t FROM medications) "
    "SELECT c AS code, min(t) AS description FROM p WHERE c IS NOT NULL GROUP BY 1"
)
def q_companion_descriptions(spark, d):
    df = table(spark, d, "medications")
    return R.companion_descriptions(df, "med_code", R.companion_column(df.columns, "med_code"))


@query(
    "SELECT c AS column_name, regexp_matches(lower(c), 'name|dob|birth|ssn|social|address|street|city|zip|phone|email|mrn|patient_id|national_id|passport|license') AS is_phi, "
    "(regexp_matches(lower(c), 'code|icd|snomed|loinc|rxnorm|ndc|cpt|drg|atc|diagnosis|procedure|drug|medication|lab|test') OR (t = 'VARCHAR' AND u > 10 AND u < n / 2.0)) "
    "AND c <> 'patient_id' AND NOT (ends_with(lower(c), '_id') AND u > n * 0.3) AS is_code "
    "FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, any_value(typeof({c})) AS t, count(DISTINCT {c}) AS u, count(*) AS n FROM patients" for c in _PATIENT_COLUMNS) + ")"
)
def q_column_classes(spark, d):
    patients = table(spark, d, "patients")
    kinds = F.create_map(*(F.lit(x) for pair in patients.dtypes for x in pair))
    prof = R.profile(patients, _PATIENT_COLUMNS).withColumn("data_type", kinds[F.col("column_name")])
    return C.code_columns(C.phi_columns(prof)).select("column_name", "is_phi", "is_code")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{n}' AS pattern, s AS share, s >= 0.8 AS matches FROM (SELECT coalesce(round(avg(CASE WHEN regexp_full_match({c}, '{p}') THEN 1.0 ELSE 0.0 END) FILTER (WHERE {c} IS NOT NULL), 6), 0.0) AS s FROM conditions)"
        for c in ("dx_code", "patient_id")
        for n, p in C.VALUE_PATTERNS.items()
    )
)
def q_value_patterns(spark, d):
    return C.value_patterns(table(spark, d, "conditions"), ["dx_code", "patient_id"])


@query("SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey LIMIT 500")
def q_uniform_sample(spark, d):
    return R.uniform_sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500)


@query(
    "WITH s AS (SELECT c_mktsegment AS g, greatest(1, CAST(round_even(200.0 * count(*) / sum(count(*)) OVER (), 0) AS INTEGER)) AS q FROM customer GROUP BY 1), "
    "r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR) || '|42'), c_custkey) AS n FROM customer) "
    "SELECT c_custkey, c_mktsegment FROM r JOIN s ON g IS NOT DISTINCT FROM c_mktsegment WHERE n <= q ORDER BY c_custkey LIMIT 200"
)
def q_stratified_sample(spark, d):
    return R.stratified_sample(table(spark, d, "customer"), "c_custkey", "c_mktsegment", 200).select("c_custkey", "c_mktsegment")


# Retrieval: the canonical list is the corpus, concept names are the queries


def _concept_queries(spark, d) -> DataFrame:
    names = table(spark, d, "concept").where("concept_name is not null")
    return names.groupBy(F.col("concept_name").alias("query")).agg(F.min("concept_id").alias("query_id"))


_STOP = ", ".join(f"'{w}'" for w in TX.STOPWORDS)
_BM25 = f"""
WITH corpus AS (SELECT concept_id AS doc, list_filter(regexp_extract_all(lower(concept_name), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP})) AS ts FROM canonical_concept),
fig AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM corpus),
tok AS (SELECT doc, len(ts) AS dl, unnest(ts) AS t FROM corpus),
post AS (SELECT doc, dl, t, count(*) AS tf FROM tok GROUP BY ALL),
dfs AS (SELECT t, count(*) AS df FROM post GROUP BY 1),
part AS (SELECT doc, p.t, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / a)) AS w FROM post p JOIN dfs USING (t), fig),
q AS (SELECT concept_name AS query, min(concept_id) AS query_id FROM concept WHERE concept_name IS NOT NULL GROUP BY 1),
qt AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP}))) AS t FROM q),
scored AS (SELECT query_id, doc, round(sum(w), 6) AS score FROM qt JOIN part USING (t) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) - 1 AS rank FROM scored)
"""


def _scored(spark, d) -> DataFrame:
    return RT.bm25(table(spark, d, "canonical_concept"), _concept_queries(spark, d))


@query(_BM25 + "SELECT query_id, doc, score, rank FROM ranked WHERE rank < 10")
def q_bm25(spark, d):
    return RT.top_k(_scored(spark, d), 10)


@query(
    _BM25 + ", f AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) - 1 AS rank FROM scored s "
    "JOIN canonical_concept c ON c.concept_id = doc AND vocabulary_id IN ('CANON') AND domain_id = 'Condition' WHERE score > 0) "
    "SELECT query_id, doc, score, rank FROM f WHERE rank < 5"
)
def q_bm25_filtered(spark, d):
    return RT.search(_scored(spark, d), table(spark, d, "canonical_concept"), 5, ("CANON",), "Condition")


@query(
    _BM25 + ", e AS (SELECT query_id, doc, score * 3 AS score FROM scored UNION ALL SELECT query_id, concept_id, 5.0 FROM q JOIN canonical_concept c ON lower(c.concept_name) = lower(q.query)), "
    "g AS (SELECT query_id, doc, max(score) AS score FROM e GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) - 1 AS rank FROM g) "
    "SELECT query_id, doc, round(score, 6) AS score, rank FROM h WHERE rank < 3"
)
def q_full_text(spark, d):
    scored = RT.full_text(table(spark, d, "canonical_concept"), _concept_queries(spark, d))
    return RT.top_k(scored, 3).withColumn("score", F.round("score", 6))


_FUZZY = "SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(concept_synonym_name), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN (" + _STOP + "))) AS {} FROM concept_synonym"


@query(
    f"WITH q AS ({_FUZZY.format('query_token')}), t AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(concept_name), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP}))) AS term FROM canonical_concept) "
    "SELECT query_token, term, levenshtein(query_token, term) AS distance FROM q, t "
    "WHERE levenshtein(query_token, term) <= CASE WHEN len(query_token) <= 2 THEN 0 WHEN len(query_token) <= 5 THEN 1 ELSE 2 END"
)
def q_fuzzy_terms(spark, d):
    terms = table(spark, d, "canonical_concept").select(F.explode(TX.tokens(F.col("concept_name"))).alias("term"))
    return RT.fuzzy_terms(terms, table(spark, d, "concept_synonym").select(F.col("concept_synonym_name").alias("query")))


_NORM = "(SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL)"
_COSINE = f"""
WITH e AS {_NORM},
s AS (SELECT q.vec_id AS query_id, e.vec_id AS doc, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score
  FROM e q, e WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) - 1 AS rank FROM s)
"""


def _vector_queries(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _vector_ranked(spark, d, k: int) -> DataFrame:
    return RT.cosine(table(spark, d, "embeddings"), _vector_queries(spark, d), k, "vec_id", "embedding")


@query(_COSINE + "SELECT query_id, doc, score, rank FROM ranked WHERE rank < 10")
def q_vector(spark, d):
    return _vector_ranked(spark, d, 10)


@query(
    _COSINE + ", f AS (SELECT s.query_id, s.doc, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.doc) - 1 AS rank FROM s "
    "JOIN embeddings a ON a.vec_id = s.doc AND a.label < 5 WHERE s.score > 0) SELECT * FROM f WHERE rank < 5"
)
def q_vector_filtered(spark, d):
    index = table(spark, d, "embeddings").where("label < 5")
    return RT.cosine(index, _vector_queries(spark, d), 5, "vec_id", "embedding").where("score > 0")


@query(_COSINE + "SELECT query_id, doc, round(greatest(0, 1 - (1 - score)), 7) AS cosine_score, round(greatest(0, 1 - (1 - score) / 2), 7) AS halved_score FROM ranked WHERE rank < 20")
def q_distance_scores(spark, d):
    dist = 1 - F.col("score")
    return _vector_ranked(spark, d, 20).select(
        "query_id",
        "doc",
        F.round(RT.distance_score(dist, "cosine"), 7).alias("cosine_score"),
        F.round(RT.distance_score(dist, "halved"), 7).alias("halved_score"),
    )


def _two_lists(spark, d) -> DataFrame:
    ranked = _vector_ranked(spark, d, 30)
    odd = RT.top_k(ranked.where("doc % 2 = 1").drop("rank"), 10)
    return ranked.where("rank < 10").withColumn("list_id", F.lit("a")).unionByName(odd.withColumn("list_id", F.lit("b")))


_LISTS = (
    _COSINE + ", top AS (SELECT * FROM ranked WHERE rank < 30), lists AS (SELECT 'a' AS list_id, query_id, doc, score, rank FROM top WHERE rank < 10 "
    "UNION ALL SELECT * FROM (SELECT 'b', query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) - 1 AS rank FROM top WHERE doc % 2 = 1) WHERE rank < 10)"
)


@query(
    _LISTS + ", n AS (SELECT query_id, count(DISTINCT list_id) AS k FROM lists GROUP BY 1), f AS (SELECT query_id, doc, sum(1.0 / (61 + rank)) AS r, max(score) AS best_score FROM lists GROUP BY ALL) "
    "SELECT query_id, doc, CASE WHEN k = 1 THEN best_score ELSE round(CAST(r AS DOUBLE), 6) END AS rrf_score, best_score FROM f JOIN n USING (query_id)"
)
def q_rrf(spark, d):
    return RT.rrf(_two_lists(spark, d))


@query(
    _LISTS + ", m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM lists WINDOW w AS (PARTITION BY list_id, query_id)) "
    "SELECT query_id, doc, round(sum(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END * CASE list_id WHEN 'a' THEN 0.7 ELSE 0.3 END), 4) AS fused_score FROM m GROUP BY ALL"
)
def q_weighted_fusion(spark, d):
    return RT.weighted_fusion(_two_lists(spark, d), {"a": 0.7, "b": 0.3}, digits=4)


_OVERLAP = "list_distinct(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN (" + _STOP + ")))"


@query(
    _BM25 + ", c AS (SELECT r.query_id, doc, score / 20 AS score, query, concept_name FROM ranked r JOIN q USING (query_id) JOIN canonical_concept c ON c.concept_id = doc WHERE rank < 5), "
    f"b AS (SELECT query_id, doc, round(0.6 / (1 + exp(-coalesce(len(list_intersect({_OVERLAP.format('query')}, {_OVERLAP.format('concept_name')})) * 1.0 / nullif(len({_OVERLAP.format('query')}), 0), 0))) + 0.4 * score, 4) AS blended FROM c) "
    "SELECT query_id, doc, blended, row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, doc) - 1 AS rank FROM b"
)
def q_rerank(spark, d):
    top = RT.top_k(_scored(spark, d), 5).drop("rank").withColumn("score", F.col("score") / 20)
    names = table(spark, d, "canonical_concept").select(F.col("concept_id").alias("doc"), F.col("concept_name").alias("text"))
    return RT.rerank(top.join(_concept_queries(spark, d), "query_id").join(names, "doc")).select("query_id", "doc", "blended", "rank")


@query(_COSINE + ", g AS (SELECT query_id, rank, round(score - lead(score) OVER (PARTITION BY query_id ORDER BY rank), 6) AS gap, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) < 0.1 AS is_close FROM ranked WHERE rank < 5) SELECT query_id, gap, is_close FROM g WHERE rank = 0 AND gap IS NOT NULL")
def q_close_candidates(spark, d):
    return RT.close_candidates(_vector_ranked(spark, d, 5))


_BEST = _COSINE + ", best AS (SELECT query_id, doc, score FROM ranked WHERE rank = 1)"
_ROUTE = (
    ", routed AS (SELECT query_id, score AS confidence, CASE WHEN score >= 0.95 THEN 'auto' WHEN score >= 0.8 THEN 'verified' WHEN score >= 0.7 THEN 'review' ELSE 'manual' END AS method, "
    "CASE WHEN score >= 0.7 OR score > 0.3 THEN doc END AS target_concept_id FROM best)"
)


def _routed(spark, d):
    return RT.confidence_route(_vector_ranked(spark, d, 2).where("rank = 1"), verify=0.80)


@query(_BEST + _ROUTE + "SELECT query_id, target_concept_id, confidence, method FROM routed")
def q_confidence_route(spark, d):
    return _routed(spark, d)


@query(
    _BEST + _ROUTE + "SELECT count(*) AS total, count(*) FILTER (WHERE method = 'auto') AS auto_mapped, count(*) FILTER (WHERE method = 'review') AS needs_review, "
    "count(*) FILTER (WHERE method = 'manual') AS manual_required, round(count(*) FILTER (WHERE method = 'auto') * 1.0 / count(*), 6) AS auto_rate, round(count(target_concept_id) * 1.0 / count(*), 6) AS coverage FROM routed"
)
def q_mapping_stats(spark, d):
    return RT.mapping_stats(_routed(spark, d))


@query(
    _COSINE + ", r AS (SELECT query_id, doc, rank - 1 AS rank FROM ranked WHERE rank BETWEEN 1 AND 10), gold AS (SELECT q.vec_id AS query_id, e.vec_id AS doc FROM e q JOIN e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0), "
    "f AS (SELECT g.query_id, min(r.rank) AS first FROM gold g LEFT JOIN r ON r.query_id = g.query_id AND r.doc = g.doc GROUP BY 1) "
    "SELECT count(*) AS n, round(avg(CASE WHEN first < 1 THEN 1.0 ELSE 0 END), 6) AS top_1, round(avg(CASE WHEN first < 5 THEN 1.0 ELSE 0 END), 6) AS top_5, "
    "round(avg(CASE WHEN first < 10 THEN 1.0 ELSE 0 END), 6) AS top_10, round(avg(coalesce(1.0 / (first + 1), 0)), 6) AS mrr FROM f"
)
def q_retrieval_metrics(spark, d):
    ranked = _vector_ranked(spark, d, 11).where("rank > 0").withColumn("rank", F.col("rank") - 1)
    vec = table(spark, d, "embeddings").select("vec_id", "label")
    asked = vec.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    gold = asked.join(vec, "label").where("query_id <> vec_id").select("query_id", F.col("vec_id").alias("doc"))
    return RT.retrieval_metrics(ranked, gold)


@query(
    "WITH s AS (SELECT upper(concept_code) AS k, concept_id, concept_name FROM canonical_concept WHERE standard_concept = 'S'), c AS (SELECT DISTINCT code FROM (SELECT dx_code AS code FROM conditions UNION SELECT lower(concept_code) FROM canonical_concept UNION SELECT concept_code || '.1' FROM canonical_concept UNION SELECT substr(concept_code, 1, 3) || '.' || substr(concept_code, 4) FROM canonical_concept) WHERE code IS NOT NULL), "
    "a AS (SELECT k, min(concept_id) AS id, arg_min(concept_name, concept_id) AS nm FROM s GROUP BY 1), p AS (SELECT replace(k, '.', '') AS k, min(concept_id) AS id, arg_min(concept_name, concept_id) AS nm FROM s GROUP BY 1) "
    "SELECT code, CAST(coalesce(t1.id, t2.id, t3.id) AS VARCHAR) AS concept_id, coalesce(t1.nm, t2.nm, t3.nm) AS concept_name, CAST(CASE WHEN t1.id IS NOT NULL THEN 0.99 WHEN t2.id IS NOT NULL THEN 0.97 WHEN t3.id IS NOT NULL THEN 0.92 END AS DOUBLE) AS confidence "
    "FROM c LEFT JOIN a t1 ON t1.k = upper(code) LEFT JOIN p t2 ON t2.k = replace(upper(code), '.', '') "
    "LEFT JOIN a t3 ON t3.k = split_part(upper(code), '.', 1) AND len(split_part(code, '.', 1)) >= 3 AND contains(code, '.')"
)
def q_code_lookup(spark, d):
    canonical = table(spark, d, "canonical_concept")
    code = F.col("concept_code")
    codes = table(spark, d, "conditions").select(F.col("dx_code").alias("code"))
    for variant in (F.lower(code), F.concat(code, F.lit(".1")), F.concat(F.substring(code, 1, 3), F.lit("."), F.substring(code, 4, 99))):
        codes = codes.unionByName(canonical.select(variant.alias("code")))
    return RT.code_lookup(codes.where("code is not null"), canonical).withColumn("concept_id", F.col("concept_id").cast("string"))


@query(
    _BM25 + ", names AS (SELECT query, query_id, 'LC' || CAST(query_id AS VARCHAR) AS code FROM q), s AS (SELECT upper(concept_code) AS k, min(concept_id) AS id FROM canonical_concept WHERE standard_concept = 'S' GROUP BY 1), "
    "codes AS (SELECT code, query_id FROM names UNION ALL SELECT lower(concept_code), -concept_id FROM canonical_concept WHERE concept_code IS NOT NULL), x AS (SELECT code, query_id, id FROM codes JOIN s ON k = upper(code)), "
    "t AS (SELECT query_id, max(score) AS top FROM scored GROUP BY 1), f AS (SELECT code, id AS doc, CAST(0.99 AS DOUBLE) AS score, 'code' AS method FROM x UNION ALL "
    "SELECT c.code, r.doc, round(r.score / t.top, 6), 'search' FROM codes c JOIN ranked r USING (query_id) JOIN t USING (query_id) WHERE r.rank < 15 AND r.score > 0 AND c.code NOT IN (SELECT code FROM x)), "
    "g AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY score DESC, doc) - 1 AS rank FROM f) SELECT code, doc, score, method, rank FROM g WHERE rank < 3"
)
def q_map_codes(spark, d):
    canonical = table(spark, d, "canonical_concept")
    names = _concept_queries(spark, d).select(F.concat(F.lit("LC"), F.col("query_id").cast("string")).alias("code"), "query_id")
    known = canonical.where("concept_code is not null").select(F.lower("concept_code").alias("code"), (-F.col("concept_id")).alias("query_id"))
    return RT.map_codes(names.unionByName(known), canonical, _scored(spark, d), 3)


@query()
def q_hashed_vectors(spark, d):
    """Cosine top 3 of synonyms among hashed vectors of names."""
    index = RT.hashed_vectors(table(spark, d, "canonical_concept"), "concept_name")
    asked = table(spark, d, "concept_synonym").groupBy("concept_synonym_name").agg(F.min("concept_id").alias("query_id"))
    queries = RT.hashed_vectors(asked, "concept_synonym_name").groupBy("query_id").agg(F.max("vector").alias("vector"))
    return RT.cosine(index, queries, 3, "concept_id", "vector")


# Vocabulary graph

_REL = (
    "WITH rel AS (SELECT DISTINCT concept_id_1 AS a, concept_id_2 AS b, regexp_replace(lower(relationship_id), '[^a-z]', '', 'g') AS r FROM concept_relationship "
    "WHERE concept_id_1 <> concept_id_2 AND trim(coalesce(invalid_reason, '')) = ''), kept AS (SELECT * FROM rel WHERE r IN ('mapsto', 'mappedfrom', 'isa', 'subsumes')), "
    "m AS (SELECT a AS s, b AS t FROM kept WHERE r = 'mapsto' UNION SELECT b, a FROM kept WHERE r = 'mappedfrom'), "
    "src AS (SELECT DISTINCT concept_id, concept_code, concept_name, vocabulary_id FROM concept), tgt AS (SELECT DISTINCT concept_id, concept_code, concept_name, vocabulary_id FROM canonical_concept) "
)


def _walk(spark, d) -> DataFrame:
    edges = V.relations(table(spark, d, "concept_relationship"))
    return V.crosswalk(edges, table(spark, d, "concept"), table(spark, d, "canonical_concept"))


_WALK = (
    "SELECT s.concept_id AS source_concept_id, s.concept_code AS source_concept_code, s.concept_name AS source_concept_name, s.vocabulary_id AS source_vocabulary_id, "
    "t.concept_id AS target_concept_id, t.concept_code AS target_concept_code, t.concept_name AS target_concept_name, t.vocabulary_id AS target_vocabulary_id, 'Maps to' AS relationship_id "
    "FROM m JOIN src s ON s.concept_id = m.s JOIN tgt t ON t.concept_id = m.t"
)


@query(_REL + _WALK)
def q_crosswalk(spark, d):
    return _walk(spark, d)


@query(_REL + "SELECT DISTINCT k.a AS concept_id, k.r AS relation, t.concept_id AS related_id, t.concept_name AS related_name FROM kept k JOIN src s ON s.concept_id = k.a JOIN tgt t ON t.concept_id = k.b WHERE k.r IN ('mapsto', 'mappedfrom')")
def q_concept_expand(spark, d):
    return V.expand(table(spark, d, "concept"), V.relations(table(spark, d, "concept_relationship")), table(spark, d, "canonical_concept"))


@query(
    _REL + "SELECT (SELECT count(DISTINCT concept_id) FROM concept) AS concepts, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT vocabulary_id AS v FROM concept WHERE vocabulary_id IS NOT NULL)) AS vocabularies, "
    "count(*) FILTER (WHERE r IN ('mapsto', 'isa')) AS forward_edges, count(*) FILTER (WHERE r IN ('mappedfrom', 'subsumes')) AS reverse_edges FROM kept"
)
def q_vocabulary_stats(spark, d):
    return V.graph_stats(table(spark, d, "concept"), V.relations(table(spark, d, "concept_relationship")))


@query(_REL + ", w AS (" + _WALK + "), b AS (SELECT source_concept_id, min(target_concept_id) AS t FROM w GROUP BY 1) SELECT e.concept_id, CAST(coalesce(CAST(b.t AS VARCHAR), CAST(e.concept_id AS VARCHAR)) AS VARCHAR) AS mapped FROM (SELECT DISTINCT concept_id FROM pgvector_backend) e LEFT JOIN b ON b.source_concept_id = e.concept_id")
def q_vocabulary_lookup(spark, d):
    ids = table(spark, d, "pgvector_backend").select("concept_id").distinct()
    joined = crossmap.with_targets(ids, "concept_id", _walk(spark, d), "hit")
    value = transforms.apply("vocabulary_lookup", F.col("concept_id"), {"joined": "hit", "output": "concept_id"}, F.col)
    return joined.select("concept_id", value.alias("mapped"))


@query("SELECT c.concept_id, c.concept_name, s.names FROM canonical_concept c LEFT JOIN (SELECT c2.concept_id, string_agg(n, '|' ORDER BY n) AS names FROM (SELECT DISTINCT concept_id, trim(concept_synonym_name) AS n FROM concept_synonym) x JOIN canonical_concept c2 ON c2.concept_id = x.concept_id AND lower(n) <> lower(c2.concept_name) WHERE n <> '' GROUP BY 1) s USING (concept_id)")
def q_concept_synonyms(spark, d):
    both = interchange.with_synonyms(table(spark, d, "canonical_concept"), table(spark, d, "concept_synonym"))
    return both.select("concept_id", "concept_name", F.array_join("synonyms", "|").alias("names"))


# Schema mapping

_COLUMNS = ("patient_id", "pt_gender", "dob", "birth_date", "dx_code", "lab_value", "zzz", "gender")
_PATTERNS = (("patient_id", "person.person_id", 0), ("gender", "person.gender", 1), ("birth", "person.birth_datetime", 2), ("dob", "person.birth_datetime", 3), ("code", "concept.code", 4), ("dx", "condition.code", 5), ("value", "measurement.value", 6))
_MATCH = (
    "WITH c AS (SELECT * FROM " + sql_values(*((x,) for x in _COLUMNS)) + " t(column_name)), p AS (SELECT * FROM " + sql_values(*_PATTERNS) + " t(pattern, target, ordinal)), "
    "h AS (SELECT column_name, target, CASE WHEN column_name = pattern THEN 0 ELSE 1 END AS loose, ordinal FROM c JOIN p ON contains(column_name, pattern)), "
    "m AS (SELECT column_name, target, CAST(CASE loose WHEN 0 THEN 0.95 ELSE 0.85 END AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY loose, ordinal) AS n FROM h) WHERE n = 1)"
)


def _matched(spark) -> DataFrame:
    return SM.pattern_match(
        values(spark, "column_name string", *((c,) for c in _COLUMNS)), values(spark, "pattern string, target string, ordinal int", *_PATTERNS)
    )


@query(_MATCH + "SELECT column_name, target, confidence FROM m")
def q_pattern_match(spark, d):
    return _matched(spark)


@query(_MATCH + ", r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY confidence DESC, column_name) > 1 AS demoted FROM m) SELECT column_name, target, CASE WHEN demoted THEN least(confidence, 0.5) ELSE confidence END AS confidence, demoted FROM r")
def q_dedupe_targets(spark, d):
    return SM.dedupe_targets(_matched(spark).withColumn("ordinal", F.col("column_name"))).drop("ordinal")


@query(_COSINE + "SELECT query_id, CASE WHEN query_id % 100 = 0 THEN -1 ELSE doc END AS target, round(CASE WHEN query_id % 100 = 0 THEN 0.95 WHEN score >= 0.4 THEN least(score + 0.5, 0.95) ELSE score * 0.7 END, 4) AS confidence FROM ranked WHERE rank = 1")
def q_embedding_fusion(spark, d):
    best = _vector_ranked(spark, d, 2).where("rank = 1")
    pattern = F.when(F.col("query_id") % 100 == 0, F.lit(-1).cast("long"))
    target, confidence = SM.fuse(pattern, F.lit(0.95), F.col("score"), F.col("doc"), F.lit(0).cast("long"))
    return best.select("query_id", target.alias("target"), confidence.alias("confidence"))


# Cross-standard mapping, flattened for comparison


@query(
    "SELECT 'Patient' AS resource_type, CAST(c_custkey AS VARCHAR) AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'male' WHEN 'MACHINERY' THEN 'female' ELSE 'unknown' END AS gender, 'Location/' || CAST(c_nationkey AS VARCHAR) AS address FROM customer"
)
def q_cross_map_person(spark, d):
    person = table(spark, d, "customer").select(
        F.col("c_custkey").alias("person_id"),
        R.lookup({"BUILDING": 8507, "MACHINERY": 8532}, F.col("c_mktsegment"), 0).alias("gender_concept_id"),
        F.col("c_nationkey").alias("location_id"),
    )
    out = crossmap.cross_map(person, crossmaps.load("omop", "fhir"), "person")
    return out.select(F.col("resourceType").alias("resource_type"), "id", "gender", F.col("address.reference.reference").alias("address"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Patient/' || CAST(o_custkey AS VARCHAR) AS subject, CASE o_orderstatus WHEN 'O' THEN 'IMP' WHEN 'F' THEN 'AMB' ELSE 'AMB' END AS class_code, strftime(o_orderdate, '%Y-%m-%d') AS period_start FROM orders")
def q_cross_map_encounter(spark, d):
    visit = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("visit_occurrence_id"),
        F.col("o_custkey").alias("person_id"),
        R.lookup({"O": 9201, "F": 9202}, F.col("o_orderstatus"), 0).alias("visit_concept_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("visit_start_date"),
    )
    out = crossmap.cross_map(visit, crossmaps.load("omop", "fhir"), "visit_occurrence")
    return out.select("id", F.col("subject.reference").alias("subject"), F.col("class.code").alias("class_code"), F.col("period.start").alias("period_start"))


@query("SELECT observation_id, lab_code AS test, lab_value AS magnitude, lab_unit AS units FROM observations WHERE lab_code IS NOT NULL AND lab_value IS NOT NULL AND lab_unit IS NOT NULL")
def q_cross_map_laboratory(spark, d):
    obs = table(spark, d, "observations").where("lab_code is not null and lab_value is not null and lab_unit is not null")
    m = obs.select(
        "observation_id", F.col("lab_code").alias("measurement_source_value"), F.col("lab_value").alias("value_as_number"), F.col("lab_unit").alias("unit_source_value")
    )
    rule = crossmaps.load("omop", "openehr")
    mapped = m.withColumn("m", F.struct(*_mapped_columns(m, rule, "measurement")))
    return mapped.select(
        "observation_id", F.col("m.test_name.defining_code.code_string").alias("test"), F.col("m.result_value.magnitude").alias("magnitude"), F.col("m.result_value.units").alias("units")
    )


def _mapped_columns(df: DataFrame, rules: crossmaps.Crossmap, entity: str):
    record = crossmap.reader(df, rules.entities[entity][1])
    return crossmap.nest({r.target: transforms.apply(r.transform, record(r.field), r.config, record) for r in rules.entities[entity][1]})


@query("SELECT condition_id, dx_code AS code, coalesce(nullif(dx_description, ''), dx_code) AS text, 'http://hl7.org/fhir/sid/icd-10-cm' AS system FROM conditions WHERE dx_code IS NOT NULL")
def q_codeable_concept(spark, d):
    config = {"system": "http://hl7.org/fhir/sid/icd-10-cm", "display_field": "dx_description"}
    df = table(spark, d, "conditions").withColumn("cc", transforms.apply("codeable_concept", F.col("dx_code"), config, F.col))
    return df.where("cc is not null").select(
        "condition_id", F.col("cc.coding")[0]["code"].alias("code"), F.col("cc.text").alias("text"), F.col("cc.coding")[0]["system"].alias("system")
    )


@query("SELECT l_orderkey, l_linenumber, l_quantity AS magnitude, l_linestatus AS units FROM lineitem")
def q_dv_quantity(spark, d):
    v = transforms.apply("dv_quantity", F.col("l_quantity"), {"unit_field": "l_linestatus"}, F.col)
    return table(spark, d, "lineitem").withColumn("v", v).select("l_orderkey", "l_linenumber", F.col("v.magnitude").alias("magnitude"), F.col("v.units").alias("units"))


@query("SELECT p_partkey, p_brand AS code_string, p_name AS value, 'local' AS terminology FROM part")
def q_dv_coded_text(spark, d):
    v = transforms.apply("dv_coded_text", F.col("p_brand"), {"display_field": "p_name"}, F.col)
    return table(spark, d, "part").withColumn("v", v).select(
        "p_partkey", F.col("v.defining_code.code_string").alias("code_string"), F.col("v.value").alias("value"), F.col("v.defining_code.terminology_id.value").alias("terminology")
    )


@query(
    "SELECT event_id, TRY_CAST(trunc(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS BIGINT) AS as_int, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS as_float, TRY_CAST(event_type AS DOUBLE) AS none FROM events"
)
def q_safe_casts(spark, d):
    k = F.get_json_object("props", "$.k")
    go = lambda n, c: transforms.apply(n, c, {}, F.col)
    return table(spark, d, "events").select("event_id", go("int", k).alias("as_int"), go("float", k).alias("as_float"), go("float", F.col("event_type")).alias("none"))


_BOOLS = ("true", "Yes", "1", "y", "T", "false", "no", "0", "maybe", None)


@query("SELECT t, CAST(CASE WHEN t IS NULL THEN NULL ELSE lower(trim(t)) IN ('true', 'yes', '1', 'y', 't') OR coalesce(TRY_CAST(t AS DOUBLE), 0) <> 0 END AS VARCHAR) AS b FROM " + sql_values(*((b,) for b in _BOOLS)) + " v(t)")
def q_bool_parse(spark, d):
    return values(spark, "t string", *((b,) for b in _BOOLS)).withColumn("b", transforms.apply("bool", F.col("t"), {}, F.col).cast("string"))


_DATES = ("2024-03-05", "2024-03-05 10:11:12", "3/5/2024", "25/12/2023", "soon", None)


@query(
    "SELECT t, coalesce(strftime(try_strptime(t, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d'), strftime(try_strptime(t, '%Y-%m-%d'), '%Y-%m-%d'), strftime(try_strptime(t, '%m/%d/%Y'), '%Y-%m-%d'), strftime(try_strptime(t, '%d/%m/%Y'), '%Y-%m-%d'), t) AS d FROM "
    + sql_values(*((x,) for x in _DATES)) + " v(t)"
)
def q_date_parse(spark, d):
    return values(spark, "t string", *((x,) for x in _DATES)).withColumn("d", transforms.apply("fhir_date", F.col("t"), {}, F.col))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, 'order-' || o_orderstatus || '!' AS label FROM orders")
def q_format(spark, d):
    go = lambda c, **k: transforms.apply("format", c, k, F.col)
    return table(spark, d, "orders").select(
        "o_orderkey", go(F.col("o_orderdate"), pattern="%d/%m/%Y").alias("day"), go(F.col("o_orderstatus"), pattern="order-{}!").alias("label")
    )


@query("SELECT patient_id, concat_ws(' ', given_name, family_name) AS full_name, nullif(split_part(phone, '-', 1), '') AS first_part FROM patients")
def q_concat_split(spark, d):
    whole = transforms.apply("concat", F.col("given_name"), {"fields": ["given_name", "family_name"]}, F.col)
    part = transforms.apply("split", F.col("phone"), {"separator": "-"}, F.col)
    return table(spark, d, "patients").select("patient_id", whole.alias("full_name"), F.nullif(part, F.lit("")).alias("first_part"))


_FIELDS = (("person", "id"), ("person", "sex"), ("visit", "start"), ("visit", "end"))
_RULES = (("person", "id"), ("visit", "end"))


@query("SELECT * FROM " + sql_values(*_FIELDS) + " f(entity, field) EXCEPT SELECT * FROM " + sql_values(*_RULES) + " r(entity, field)")
def q_unmapped_fields(spark, d):
    return crossmap.unmapped_fields(values(spark, "entity string, field string", *_FIELDS), values(spark, "entity string, field string", *_RULES))


# Quality


def _rule_sql(name: str, severity: str, total: str, failed: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS rule_id, '{severity}' AS severity, coalesce({failed}, 0) = 0 AS passed, CAST({total} AS BIGINT) AS total_rows, CAST(coalesce({failed}, 0) AS BIGINT) AS failed_count FROM {source}"
    )


_ORDER_RULES = [
    Q.Rule("price_range", "range", "o_totalprice", "warn", 1000, 400000),
    Q.Rule("status_enum", "enum", "o_orderstatus", values=("O", "F")),
    Q.Rule("priority_regex", "regex", "o_orderpriority", pattern="[1-5]-[A-Z]"),
    Q.Rule("customer_fk", "fk_exists", "o_custkey", ref_table="customer", ref_column="c_custkey"),
    Q.Rule("no_such_column", "range", "absent", low=0),
]
_ORDER_SQL = " UNION ALL ".join(
    [
        _rule_sql("price_range", "warn", "count(o_totalprice)", "count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 400000)", "orders"),
        _rule_sql("status_enum", "error", "count(o_orderstatus)", "count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F'))", "orders"),
        _rule_sql("priority_regex", "error", "count(o_orderpriority)", "count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z]'))", "orders"),
        _rule_sql("customer_fk", "error", "count(o_custkey)", "count(*) FILTER (WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey))", "orders"),
        "SELECT 'no_such_column', 'error', true, 0, 0",
    ]
)


@query(_ORDER_SQL)
def q_rules_fused(spark, d):
    return Q.evaluate(table(spark, d, "orders"), _ORDER_RULES, {"customer": table(spark, d, "customer")})


@query(
    _rule_sql("onset_after_birth", "error", "count(*) FILTER (WHERE dob IS NOT NULL AND onset_date IS NOT NULL)", "count(*) FILTER (WHERE dob > onset_date)", "(SELECT c.onset_date, p.dob FROM conditions c JOIN (SELECT DISTINCT patient_id, dob FROM patients) p USING (patient_id))")
)
def q_temporal_rule(spark, d):
    people = table(spark, d, "patients").select("patient_id", "dob").distinct()
    return Q.evaluate(table(spark, d, "conditions").join(people, "patient_id"), [Q.Rule("onset_after_birth", "temporal_order", before="dob", after="onset_date")])


@query(
    _rule_sql("target_is_condition", "error", "count(concept_id_2)", "count(*) FILTER (WHERE concept_id_2 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM canonical_concept c WHERE c.concept_id = concept_id_2 AND c.domain_id = 'Condition'))", "concept_relationship")
)
def q_domain_match(spark, d):
    return Q.domain_match(table(spark, d, "concept_relationship"), "concept_id_2", table(spark, d, "canonical_concept"), "Condition", "target_is_condition")


@query(_rule_sql("age_in_range", "warn", "count(y)", "count(*) FILTER (WHERE y < 2026 - 125 OR y > 2026)", "(SELECT year(dob) AS y FROM patients)"))
def q_age_in_range(spark, d):
    people = table(spark, d, "patients").select(F.year("dob").alias("year_of_birth"))
    return Q.evaluate(people, [r for r in Q.coded_rules("person") if r.id == "age_in_range"])


@query(
    "WITH r AS (" + _ORDER_SQL + ") SELECT severity AS category, count(*) AS rules, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS score FROM r GROUP BY 1"
)
def q_validation_scores(spark, d):
    return Q.scores(q_rules_fused(spark, d).withColumnRenamed("severity", "category"))


@query(
    "SELECT 'column_exists:patient_id' AS rule_id, 'error' AS severity, true AS passed, 1 AS total_rows, 0 AS failed_count, 'completeness' AS category UNION ALL SELECT 'column_exists:nothing', 'error', false, 1, 1, 'completeness' "
    "UNION ALL SELECT 'code_not_negative:lab_value', 'error', count(*) FILTER (WHERE lab_value < 0) <= 0.05 * count(lab_value), count(lab_value), count(*) FILTER (WHERE lab_value < 0), 'conformance' FROM observations WHERE lab_value IS NOT NULL "
    "UNION ALL SELECT 'date_not_null:lab_dt', 'error', count(*) FILTER (WHERE lab_dt IS NULL) <= 0.1 * count(*), count(*), count(*) FILTER (WHERE lab_dt IS NULL), 'completeness' FROM observations"
)
def q_expectations(spark, d):
    return Q.expectations(table(spark, d, "observations"), ["patient_id", "nothing"], ["lab_value"], ["lab_dt"])


@query("SELECT c AS column_name, z AS zero_pct, CASE WHEN z > 50 THEN 'error' WHEN z > 0 THEN 'warning' ELSE 'ok' END AS level FROM (SELECT 'gender_concept_id' AS c, round(100 * avg(CASE WHEN gender IN ('M', 'F') THEN 0.0 ELSE 1.0 END), 4) AS z FROM patients)")
def q_zero_rate(spark, d):
    return Q.zero_rate(R.map_column(table(spark, d, "patients"), "gender", {"M": 8507, "F": 8532}, "gender_concept_id"), ["gender_concept_id"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, p AS null_pct, CASE WHEN p > 10 THEN 'error' ELSE 'ok' END AS level FROM (SELECT round(100 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 4) AS p FROM observations)" for c in ("patient_id", "lab_unit", "lab_text")))
def q_null_issues(spark, d):
    return Q.null_issues(table(spark, d, "observations"), ["patient_id", "lab_unit", "lab_text"])


@query("SELECT 'dob' AS column_name, count(*) FILTER (WHERE year(dob) < 1900 OR year(dob) > 2100) AS out_of_bounds FROM patients")
def q_date_bounds(spark, d):
    return Q.date_bounds(table(spark, d, "patients"), ["dob"])


@query("SELECT condition_id, patient_id FROM conditions c WHERE NOT EXISTS (SELECT 1 FROM patients p WHERE p.patient_id = c.patient_id)")
def q_orphan_rows(spark, d):
    return Q.orphan_rows(table(spark, d, "conditions"), "patient_id", table(spark, d, "patients"), "patient_id").select("condition_id", "patient_id")


@query()
def q_distribution_drift(spark, d):
    return Q.distribution_drift(table(spark, d, "lineitem"), "l_quantity", {0.1: 5.0, 0.5: 25.0, 0.9: 45.0}, 0.05)


# Lifecycle, export, profiles

_SUGGESTED = ((1, 10, "needs_review"), (2, 20, "auto_accepted"), (3, None, "needs_review"), (4, 40, "needs_review"), (5, 50, "needs_review"))
_DECIDED = ((1, "approve", None, 1), (1, "override", 11, 2), (2, "reject", None, 1), (4, "approve", None, 1))


@query(
    "WITH i AS (SELECT * FROM " + sql_values(*_SUGGESTED) + " t(item_id, target, status)), d AS (SELECT item_id, arg_max(action, moment) AS a, max(moment) AS m FROM " + sql_values(*_DECIDED) + " t(item_id, action, t2, moment) GROUP BY 1), "
    "o AS (SELECT * FROM " + sql_values(*_DECIDED) + " t(item_id, action, t2, moment)) "
    "SELECT i.item_id, CAST(CASE WHEN a = 'override' THEN o.t2 WHEN a IN ('reject', 'unmap') THEN NULL ELSE target END AS VARCHAR) AS target, "
    "CASE a WHEN 'approve' THEN 'approved' WHEN 'override' THEN 'overridden' WHEN 'reject' THEN 'rejected' WHEN 'unmap' THEN 'unmapped' ELSE status END AS status FROM i LEFT JOIN d USING (item_id) LEFT JOIN o ON o.item_id = i.item_id AND o.moment = d.m"
)
def q_review_decisions(spark, d):
    return lifecycle.decide(
        values(spark, "item_id int, target int, status string", *_SUGGESTED), values(spark, "item_id int, action string, target int, at int", *_DECIDED)
    ).withColumn("target", F.col("target").cast("string"))


@query(
    "SELECT trim(med_code) AS source_code, CAST(0 AS BIGINT) AS source_concept_id, 'LOCAL' AS source_vocabulary_id, coalesce(nullif(trim(t), ''), trim(med_code)) AS source_code_description, CAST(c AS BIGINT) AS target_concept_id, '' AS target_concept_name, 'SNOMED' AS target_vocabulary_id, '' AS target_domain_id, "
    "CAST(1 AS DOUBLE) AS confidence, 'auto' AS method, '1970-01-01' AS valid_start_date, '2099-12-31' AS valid_end_date, CAST(NULL AS VARCHAR) AS invalid_reason "
    "FROM (SELECT med_code, min(med_description) AS t, TRY_CAST(TRY_CAST(med_code AS DOUBLE) AS BIGINT) AS c FROM medications WHERE trim(med_code) <> '' GROUP BY 1) WHERE c IS NOT NULL AND c <> 0"
)
def q_source_to_concept_map(spark, d):
    codes = (
        table(spark, d, "medications").where("trim(med_code) <> ''").groupBy(F.col("med_code").alias("source_code"))
        .agg(F.min("med_description").alias("source_description"))
        .withColumns({"concept_id": F.col("source_code"), "confidence": F.lit("1.0"), "method": F.lit("auto")})
    )
    out = interchange.source_to_concept_map(interchange.import_mapping(codes), "LOCAL")
    return out.withColumns({c: F.col(c).cast("string") for c in ("valid_start_date", "valid_end_date")})


@query("SELECT resource_type, full_url, method FROM (SELECT 'Patient' AS resource_type, 'POST' AS method, md5('Patient/' || CAST(c_custkey AS VARCHAR)) AS h, 'urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS full_url FROM customer)")
def q_bundle_entries(spark, d):
    patients = table(spark, d, "customer").select(F.lit("Patient").alias("resourceType"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return interchange.bundle_entries(patients, F.col("id")).select("resource_type", "full_url", "method")


@query("SELECT 'Patient' AS \"resourceType\", '{\"resourceType\":\"Patient\",\"id\":' || CAST(c_custkey AS VARCHAR) || ',\"name\":\"' || c_name || '\"}' AS value FROM customer")
def q_ndjson(spark, d):
    patients = table(spark, d, "customer").select(F.lit("Patient").alias("resourceType"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return interchange.ndjson(patients)


@query()
def q_bundles(spark, d):
    patients = table(spark, d, "customer").select(F.lit("Patient").alias("resourceType"), F.col("c_custkey").alias("id"))
    return interchange.bundles(interchange.bundle_entries(patients, F.col("id"))).select("bundle", F.length("value").alias("bytes"))


_PROFILE = {"type": "Patient", "required": ["name", "gender"], "invariants": {"pat-1": "gender.exists() or phone.exists()", "pat-2": "gender = 'M' implies name.exists()"}}


@query(
    "WITH p AS (SELECT DISTINCT * FROM patients) SELECT patient_id, 'name' AS path, 'error' AS severity, 'required' AS issue FROM p WHERE family_name IS NULL UNION ALL SELECT patient_id, 'gender', 'error', 'required' FROM p WHERE gender IS NULL "
    "UNION ALL SELECT patient_id, 'pat-1', 'error', 'invariant' FROM p WHERE gender IS NULL AND phone IS NULL UNION ALL SELECT patient_id, 'pat-2', 'error', 'invariant' FROM p WHERE gender = 'M' AND family_name IS NULL"
)
def q_profile_issues(spark, d):
    people = table(spark, d, "patients").distinct().select(
        F.lit("Patient").alias("resourceType"), "patient_id", F.col("family_name").alias("name"), "gender", "phone"
    )
    return profiles.validate(people, "patient_id", _PROFILE)


_URLS = ("jdbc:postgresql://user:pa@ss@host/db", "mysql://host/db", None)


@query("SELECT u, regexp_replace(u, '(://)([^/]*)(@)', '\\1***\\3') AS safe, sha256(coalesce(u, '') || '|x') AS digest FROM " + sql_values(*((u,) for u in _URLS)) + " t(u)")
def q_redact_and_hash(spark, d):
    return values(spark, "u string", *((u,) for u in _URLS)).select("u", TX.redact(F.col("u")).alias("safe"), TX.fingerprint(F.col("u"), F.lit("x")).alias("digest"))


@query(
    f"WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP})) AS ts FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(ts) AS tokens, len(list_distinct(ts)) AS distinct_tokens FROM t"
)
def q_tokens(spark, d):
    docs = table(spark, d, "documents").where("text is not null").withColumn("ts", TX.tokens(F.col("text")))
    return docs.select("doc_id", F.size("ts").cast("long").alias("tokens"), F.size(F.array_distinct("ts")).cast("long").alias("distinct_tokens"))
