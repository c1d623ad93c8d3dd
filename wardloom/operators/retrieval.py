"""Concept search: exact codes, BM25, vectors, rank fusion, reranking, routing and its measures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardloom.functions.text import sigmoid, tokens

K1, B = 1.5, 0.75
QUERY_BLOCK = 2000  # query vectors held by a task at once


def postings(corpus: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``(doc, token, tf, dl)`` and one row of corpus figures ``(n_docs, avg_dl)``."""
    lists = corpus.select(F.col(key).alias("doc"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("ts"))
    lists = lists.withColumn("dl", F.size("ts"))
    figures = lists.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
    exploded = lists.select("doc", "dl", F.explode("ts").alias("token"))
    return exploded.groupBy("doc", "dl", "token").agg(F.count("*").alias("tf")), figures


def bm25(corpus: DataFrame, queries: DataFrame, key: str = "concept_id", text: str = "concept_name", digits: int = 6) -> DataFrame:
    """``(query_id, doc, score)`` of every document that shares a token with a query.

    Okapi weights with the usual smoothed idf; repeated words of a query count
    once. ``queries`` has ``query_id, query``.
    """
    index, figures = postings(corpus, key, text)
    df = index.groupBy("token").agg(F.count("*").alias("df"))
    n, avg = F.col("n_docs"), F.col("avg_dl")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avg))
    weighted = (
        index.join(df, "token")
        .crossJoin(figures)  # one row
        .select("token", "doc", part.alias("part"))
    )
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token"))
    hits = asked.join(weighted, "token")
    return hits.groupBy("query_id", "doc").agg(F.round(F.sum("part"), digits).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "score", tie: str = "doc") -> DataFrame:
    """The ``k`` best rows of each query with a 0-based ``rank``; ties go to the smaller ``tie``."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), tie)
    return scored.withColumn("rank", F.row_number().over(order).cast("long") - 1).where(F.col("rank") < k)


def search(
    scored: DataFrame, concepts: DataFrame, k: int, vocabularies: tuple[str, ...] = (), domain: str | None = None, post_filter: bool = False
) -> DataFrame:
    """Top ``k`` of positive scores, filtered by vocabulary and domain before ranking, or after a threefold fetch."""
    wanted = concepts.select(F.col("concept_id").alias("doc"), "vocabulary_id", "domain_id")
    if vocabularies:
        wanted = wanted.where(F.col("vocabulary_id").isin(*vocabularies))
    if domain is not None:
        wanted = wanted.where(F.col("domain_id") == domain)
    positive = scored.where("score > 0")
    if post_filter:
        return top_k(top_k(positive, 3 * k).drop("rank").join(wanted.select("doc"), "doc", "left_semi"), k)
    return top_k(positive.join(wanted.select("doc"), "doc", "left_semi"), k)


def full_text(corpus: DataFrame, queries: DataFrame, key: str = "concept_id", text: str = "concept_name") -> DataFrame:
    """Best of three times BM25 on the name and five for a name equal to the query but for case."""
    scored = bm25(corpus, queries, key, text).withColumn("score", F.col("score") * 3)
    exact = queries.join(
        corpus.select(F.col(key).alias("doc"), F.lower(text).alias("_name")), F.lower("query") == F.col("_name")
    ).select("query_id", "doc", F.lit(5.0).alias("score"))
    return scored.unionByName(exact).groupBy("query_id", "doc").agg(F.max("score").alias("score"))


def fuzzy_terms(terms: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_token, term, distance)`` within 0, 1 or 2 edits by the length of the query's token.

    Candidates share a third of the token, at a place shifted by at most the
    allowed edits, so nothing is compared with everything.
    """
    allowed = lambda c: F.when(F.length(c) <= 2, 0).when(F.length(c) <= 5, 1).otherwise(2)
    asked = queries.select(F.explode(tokens(F.col("query"))).alias("q")).distinct()
    cut = asked.withColumn("k", allowed(F.col("q"))).select(
        "q",
        "k",
        F.inline(
            F.expr(
                "transform(sequence(0, k), i -> struct(cast(floor(i * length(q) / (k + 1)) as int) AS at, "
                "substr(q, cast(floor(i * length(q) / (k + 1)) as int) + 1, "
                "cast(floor((i + 1) * length(q) / (k + 1)) - floor(i * length(q) / (k + 1)) as int)) AS seg))"
            )
        ),
    )
    spots = cut.select("q", "k", "seg", F.explode(F.expr("sequence(greatest(at - k, 0), at + k)")).alias("at")).where("seg <> ''")
    lengths = cut.select(F.length("seg").alias("n")).distinct().where("n > 0")
    grams = (
        terms.select("term").distinct()
        .crossJoin(lengths)  # segment lengths: a handful of numbers
        .select("term", F.explode(F.expr("sequence(0, greatest(length(term) - n, 0))")).alias("at"), "n")
        .withColumn("seg", F.expr("substr(term, at + 1, n)"))
        .where("length(seg) = n")
    )
    return (
        spots.join(grams.drop("n"), ["seg", "at"])
        .select("q", "term", "k", F.levenshtein("q", "term").alias("distance"))
        .where("distance <= k")
        .select(F.col("q").alias("query_token"), "term", F.col("distance").cast("long").alias("distance"))
        .distinct()
    )


def cosine(
    index: DataFrame, queries: DataFrame, k: int, key: str, vector: str, digits: int = 6, clamp: bool = False
) -> DataFrame:
    """``(query_id, doc, score)``: the ``k`` rows of ``index`` most similar to each query ``(query_id, vector)``.

    A stated query set against all rows: queries go round in blocks of
    QUERY_BLOCK, every task keeps the best ``k`` of its rows, and the parts are
    merged. Null vectors and vectors of another length than the query's take
    no part; a zero vector has score 0. ``clamp`` lifts negative scores to 0.
    """
    found = None
    for ids, q in _query_blocks(queries):
        bc = index.sparkSession.sparkContext.broadcast((ids, q))

        def best(batches: Iterator[pa.RecordBatch], bc=bc) -> Iterator[pa.RecordBatch]:
            ids, q = bc.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists = batch.column(1)
                v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, q.shape[1])
                docs = batch.column(0).to_numpy()
                n = np.linalg.norm(v, axis=1)
                v = v / np.where(n > 0, n, 1)[:, None]
                sim = np.round(q @ v.T, digits)
                if clamp:
                    sim = np.maximum(sim, 0)
                m = min(k, sim.shape[1])
                order = np.lexsort((np.broadcast_to(docs, sim.shape), -sim), axis=1)[:, :m]
                rows = np.repeat(np.arange(len(ids)), m)
                cols = order.ravel()
                yield pa.record_batch(
                    [pa.array(ids[rows]), pa.array(docs[cols]), pa.array(sim[rows, cols])], ["query_id", "doc", "score"]
                )

        size = q.shape[1]
        rows = index.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(
            F.col("id").isNotNull() & (F.size("v") == size) & ~F.exists("v", lambda x: x.isNull())
        )
        part = rows.mapInArrow(best, "query_id long, doc long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return index.sparkSession.createDataFrame([], "query_id long, doc long, score double, rank long")
    return top_k(found, k)


def _query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unit query vectors of one length in blocks of bounded size, read a partition at a time."""
    ids, vs = [], []

    def block():
        q = np.array(vs, float)
        n = np.linalg.norm(q, axis=1)
        return np.array(ids, np.int64), q / np.where(n > 0, n, 1)[:, None]

    for row in queries.where("vector is not null").toLocalIterator():
        if ids and (len(ids) >= QUERY_BLOCK or len(row["vector"]) != len(vs[0])):
            yield block()
            ids, vs = [], []
        ids.append(row["query_id"])
        vs.append(list(row["vector"]))
    if ids:
        yield block()


def distance_score(distance: Column, backend: str) -> Column:
    """Similarity from the distance a vector store reports, never below 0."""
    return F.greatest(F.lit(0.0), {"halved": 1 - distance / 2, "cosine": 1 - distance}.get(backend, distance))


def rrf(lists: DataFrame, k: int = 60, digits: int = 6, normalise: bool = False) -> DataFrame:
    """Reciprocal rank fusion of ``(list_id, query_id, doc, rank, score)`` with 0-based ranks.

    Keeps the highest original score. A query answered by a single list keeps
    that list's scores. ``normalise`` divides by the best attainable value so
    that thresholds between 0 and 1 apply.
    """
    sizes = lists.groupBy("query_id").agg(F.count_distinct("list_id").alias("n_lists"))
    value = F.sum(1.0 / (F.lit(k) + F.col("rank") + 1))
    fused = lists.groupBy("query_id", "doc").agg(value.alias("rrf"), F.max("score").alias("best_score"))
    top = F.col("n_lists") / F.lit(float(k + 1)) if normalise else F.lit(1.0)
    return fused.join(sizes, "query_id").select(
        "query_id",
        "doc",
        F.when(F.col("n_lists") == 1, F.col("best_score")).otherwise(F.round(F.col("rrf") / top, digits)).alias("rrf_score"),
        "best_score",
    )


def weighted_fusion(lists: DataFrame, weights: dict[str, float], digits: int = 6) -> DataFrame:
    """Sum of min-max scaled scores of each list times its weight (0 where absent)."""
    span = Window.partitionBy("list_id", "query_id")
    lo, hi = F.min("score").over(span), F.max("score").over(span)
    scaled = F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1.0)
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("list_id")], F.lit(0.0))
    return (
        lists.withColumn("part", scaled * weight)
        .groupBy("query_id", "doc")
        .agg(F.round(F.sum("part"), digits).alias("fused_score"))
    )


def code_lookup(codes: DataFrame, concepts: DataFrame) -> DataFrame:
    """``codes(code)`` found among standard concepts by tiers: as written in any case 0.99, without dots 0.97,
    the part before the dot (three or more characters) 0.92; the first tier that answers counts."""
    standard = concepts.where("standard_concept = 'S'").select(
        F.upper("concept_code").alias("_code"), "concept_id", "concept_name"
    )
    exact = standard.groupBy("_code").agg(F.min(F.struct("concept_id", "concept_name")).alias("hit"))
    plain = standard.groupBy(F.replace("_code", F.lit(".")).alias("_code")).agg(
        F.min(F.struct("concept_id", "concept_name")).alias("hit")
    )
    stem = F.substring_index(F.upper("code"), ".", 1)
    tiers = (
        codes.select("code").distinct()
        .join(exact.toDF("_k1", "t1"), F.upper("code") == F.col("_k1"), "left")
        .join(plain.toDF("_k2", "t2"), F.replace(F.upper("code"), F.lit(".")) == F.col("_k2"), "left")
        .join(exact.toDF("_k3", "t3"), (stem == F.col("_k3")) & (F.length(stem) >= 3) & F.contains("code", F.lit(".")), "left")
    )
    hit = F.coalesce("t1", "t2", "t3")
    return tiers.select(
        "code",
        hit["concept_id"].alias("concept_id"),
        hit["concept_name"].alias("concept_name"),
        F.when(F.col("t1").isNotNull(), 0.99).when(F.col("t2").isNotNull(), 0.97).when(F.col("t3").isNotNull(), 0.92).alias("confidence"),
    )


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's words in the text: the default stand-in for a pair scorer."""
    q, t = F.array_distinct(tokens(query)), F.array_distinct(tokens(text))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)), F.size(q)), F.lit(0.0))


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_score, weight: float = 0.6) -> DataFrame:
    """Candidates ``(query_id, doc, query, text, score)`` by ``weight`` of sigmoid(pair score) and the rest of score."""
    blended = F.round(weight * sigmoid(scorer(F.col("query"), F.col("text"))) + (1 - weight) * F.col("score"), 4)
    return top_k(candidates.withColumn("blended", blended), 1 << 30, "blended")


def close_candidates(ranked: DataFrame, margin: float = 0.10) -> DataFrame:
    """Queries whose best two scores differ by less than ``margin``: those worth reranking."""
    order = Window.partitionBy("query_id").orderBy("rank")
    gap = F.col("score") - F.lead("score").over(order)
    return ranked.withColumn("gap", F.round(gap, 6)).where((F.col("rank") == 0) & F.col("gap").isNotNull()).select(
        "query_id", "gap", (F.col("gap") < margin).alias("is_close")
    )


def confidence_route(best: DataFrame, auto: float = 0.95, review: float = 0.70, verify: float | None = None) -> DataFrame:
    """``method`` of each best candidate: auto, verified (only with ``verify``), review or manual.

    A manual item keeps its target only above 0.3; without candidates it is
    manual with confidence 0.
    """
    s = F.coalesce("score", F.lit(0.0))
    method = F.when(s >= auto, "auto")
    if verify is not None:
        method = method.when(s >= verify, "verified")
    method = method.when(s >= review, "review").otherwise("manual")
    target = F.when((method != "manual") | (s > 0.3), F.col("doc"))
    return best.select("query_id", target.alias("target_concept_id"), s.alias("confidence"), method.alias("method"))


def mapping_stats(routed: DataFrame) -> DataFrame:
    """Totals per method, and the shares decided automatically and covered."""
    n = F.count("*")
    return routed.agg(
        n.alias("total"),
        F.count_if(F.col("method") == "auto").alias("auto_mapped"),
        F.count_if(F.col("method") == "review").alias("needs_review"),
        F.count_if(F.col("method") == "manual").alias("manual_required"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("method") == "auto"), n), F.lit(0.0)), 6).alias("auto_rate"),
        F.round(F.coalesce(F.try_divide(F.count("target_concept_id"), n), F.lit(0.0)), 6).alias("coverage"),
    )


def retrieval_metrics(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """top-1, top-5, top-10 and mean reciprocal rank of ``ranked(query_id, doc, rank)`` against ``gold(query_id, doc)``.

    Any gold answer counts; queries without one are left out.
    """
    asked = gold.select("query_id").distinct()
    first = ranked.join(gold.select("query_id", "doc").distinct(), ["query_id", "doc"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    every = asked.join(first, "query_id", "left")
    hit = lambda k: F.round(F.avg(F.coalesce((F.col("first") < k).cast("double"), F.lit(0.0))), 6)
    return every.agg(
        F.count("*").alias("n"),
        hit(1).alias("top_1"),
        hit(5).alias("top_5"),
        hit(10).alias("top_10"),
        F.round(F.avg(F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0))), 6).alias("mrr"),
    )


def save_index(corpus: DataFrame, path: str, key: str = "concept_id", text: str = "concept_name") -> None:
    """Postings and corpus figures as Parquet under ``path``."""
    index, figures = postings(corpus, key, text)
    index.write.mode("overwrite").parquet(f"{path}/postings")
    figures.write.mode("overwrite").parquet(f"{path}/figures")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/figures")


def hashed_vectors(df: DataFrame, text: str, dim: int = 64, target: str = "vector") -> DataFrame:
    """``target``: word counts hashed to ``dim`` places, of length 1; zeros without words. Stays in the JVM."""
    places = F.transform(tokens(F.coalesce(F.col(text), F.lit(""))), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter("_places", lambda p: p == i)).cast("double")
    )
    length = F.sqrt(F.aggregate("_counts", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform("_counts", lambda x: F.coalesce(F.try_divide(x, F.col("_length")), F.lit(0.0)))
    return (
        df.withColumn("_places", places)
        .withColumn("_counts", counts)
        .withColumn("_length", length)
        .withColumn(target, unit)
        .drop("_places", "_counts", "_length")
    )


def map_codes(codes: DataFrame, concepts: DataFrame, scored: DataFrame, limit: int = 5) -> DataFrame:
    """Candidates ``(code, doc, score, method, rank)``: an exact code answers alone, else the search does.

    ``codes`` has ``code, query_id``; ``scored`` is ``(query_id, doc, score)`` of
    a search over descriptions, scaled by the best score of its query. At most
    five times ``limit``, and 50, candidates are looked at before the cut.
    """
    exact = code_lookup(codes, concepts).where("concept_id is not null")
    direct = codes.join(exact, "code").select("code", "query_id", F.col("concept_id").alias("doc"), F.col("confidence").alias("score"), F.lit("code").alias("method"))
    best = scored.groupBy("query_id").agg(F.max("score").alias("_top"))
    open_ = codes.join(exact.select("code"), "code", "left_anti")
    fetched = top_k(scored.where("score > 0"), min(50, 5 * limit)).drop("rank").join(best, "query_id")
    searched = open_.join(fetched, "query_id").select(
        "code", "query_id", "doc", F.round(F.col("score") / F.col("_top"), 6).alias("score"), F.lit("search").alias("method")
    )
    order = Window.partitionBy("code").orderBy(F.desc("score"), "doc")
    both = direct.unionByName(searched).withColumn("rank", F.row_number().over(order).cast("long") - 1)
    return both.where(F.col("rank") < limit).drop("query_id")


def verify(routed: DataFrame, judge: Callable, schema: str) -> DataFrame:
    """A pluggable check of routed items by a function over pandas batches (a model, a service); none is built in."""
    return routed.mapInPandas(judge, schema)


BACKENDS: dict[str, Callable] = {"bm25": bm25, "full_text": full_text, "cosine": cosine}


def backend(name: str) -> Callable:
    """A registered search function."""
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; known: {', '.join(BACKENDS)}")
    return BACKENDS[name]


def hybrid(scored: dict[str, DataFrame], k: int, fusion: str = "rrf", weights: dict[str, float] | None = None) -> DataFrame:
    """Ranked lists of several backends fused and cut to ``k``; each list is fetched threefold first."""
    lists = None
    for name, part in scored.items():
        own = top_k(part.where("score > 0"), 3 * k).select(F.lit(name).alias("list_id"), "query_id", "doc", "rank", "score")
        lists = own if lists is None else lists.unionByName(own)
    if fusion == "weighted":
        return top_k(weighted_fusion(lists, weights or {n: 1 / len(scored) for n in scored}), k, "fused_score")
    return top_k(rrf(lists), k, "rrf_score")
