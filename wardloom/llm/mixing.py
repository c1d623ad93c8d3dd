"""Sources mixed to target weights, measured in tokens.

Capped water-filling: every source gets its target share of the total; a
source that would have to repeat its documents more often than allowed is
clamped at its limit and what it lacks goes to the others in proportion, until
the plan is feasible. Each document is then used a whole number of times, and
once more where its seeded place lies within the fraction that is left.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of this byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLACES = 4096  # seeded places a source's documents fall into


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("wardloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(documents: DataFrame, key: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, source, tokens)`` of every document with a key; null texts have 0 tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            tokens = [len(x) for x in encoding.encode_ordinary_batch(texts, num_threads=1)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], ["id", "source", "tokens"])

    return (
        documents.where(F.col(key).isNotNull())
        .select(F.col(key).alias("id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text"))
        .mapInArrow(count, "id long, source string, tokens long")
    )


def source_name(c: Column) -> Column:
    """Source names compare without letter case, outer blanks and the kind of separator; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), F.lit(""))


def fill(weights: dict[str, float], limits: dict[str, float], total: float) -> dict[str, float]:
    """Tokens per source: ``weights`` of ``total``, none above its limit, the excess in proportion to the others.

    Where all limits together are below ``total`` every source is at its limit.
    """
    plan: dict[str, float] = {s: 0.0 for s in weights}
    free = {s for s, w in weights.items() if w > 0 and limits.get(s, 0) > 0}
    left = total
    while free and left > 0:
        norm = sum(weights[s] for s in free)
        share = {s: left * (weights[s] / norm) for s in free}
        over = {s for s in free if share[s] >= limits[s]}
        if not over:
            plan |= share
            break
        for s in over:
            plan[s] = float(limits[s])
            left -= limits[s]
        free -= over
    return plan


def mix(
    documents: DataFrame, weights: DataFrame, total: int | None = None, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report) of ``documents(id, source, tokens)`` and ``weights(source, target_share, max_repeats)``.

    The mixture has ``id, source, tokens, copies`` for every document used at
    least once; ``total`` tokens are wanted (default: all there are in listed
    sources, each once). The report has one row per listed source, and one
    without a source for the documents of no listed source, which are not
    used. Documents without tokens are not used, repeated rows and other columns count for nothing.
    Weights are normalised; a null or negative share or limit counts as 0. The
    weights table bounds what reaches the driver.
    """
    spark = documents.sparkSession
    listed = (
        weights.select(
            source_name(F.col("source")).alias("source"),
            F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).cast("double").alias("target_share"),
            F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("int").alias("max_repeats"),
        )
        .where("source is not null")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    listed = materialize(listed, "weights")
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(PLACES)).cast("int")
    docs = documents.select("id", "source", "tokens").where("tokens > 0").distinct().withColumn("place", place)
    docs = materialize(docs, "sized")
    known = docs.join(listed.select("source"), "source", "left_semi")
    spots = known.groupBy("source", "place").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    spots = materialize(spots, "places")
    available = spots.groupBy("source").agg(F.sum("tokens").alias("available"), F.sum("docs").alias("docs"))
    rows = listed.join(available, "source", "left").fillna(0).collect()  # one row per listed source
    shares = {r["source"]: r["target_share"] for r in rows}
    limits = {r["source"]: float(r["max_repeats"] * r["available"]) for r in rows}
    wanted = total if total is not None else sum(r["available"] for r in rows)
    plan = fill(shares, limits, wanted)
    norm = sum(shares.values()) or 1.0
    planned = spark.createDataFrame(
        [
            (
                r["source"],
                r["target_share"] / norm,
                r["max_repeats"],
                int(r["available"]),
                int(r["docs"]),
                plan[r["source"]],
                int(plan[r["source"]] // r["available"]) if r["available"] else 0,
            )
            for r in rows
        ],
        "source string, target_share double, max_repeats int, available long, docs long, planned double, whole int",
    )
    # whole places first, in seeded order; the place where the fraction ends is cut document by document
    by_place = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        spots.join(planned, "source")
        .withColumn("before", F.coalesce(F.sum("tokens").over(by_place), F.lit(0)))
        .withColumn("extra", F.col("planned") - F.col("whole") * F.col("available"))
        .select(
            "source",
            "place",
            "whole",
            F.when(F.col("before") + F.col("tokens") <= F.col("extra"), F.col("tokens").cast("double"))
            .otherwise(F.greatest(F.col("extra") - F.col("before"), F.lit(0.0)))
            .alias("room"),
            "tokens",
        )
        .withColumnRenamed("tokens", "in_place")
    )
    within = Window.partitionBy("source", "place").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id")
    upto = F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = known.join(edges, ["source", "place"])
    cut = (
        joined.where("room > 0 and room < in_place")
        .withColumn("upto", upto)
        # the document across the edge is used where more than half of it is wanted
        .withColumn("once", (F.col("upto") - F.col("tokens") / 2 <= F.col("room")).cast("int"))
        .drop("upto")
    )
    flat = joined.where("room <= 0 or room >= in_place").withColumn(
        "once", (F.col("room") >= F.col("in_place")).cast("int")
    )
    used = (
        flat.unionByName(cut)
        .withColumn("copies", F.col("whole") + F.col("once"))
        .where("copies > 0")
        .select("id", "source", "tokens", "copies")
    )
    used = materialize(used, "mixture")
    taken = used.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), F.max("copies").cast("int").alias("most_copies")
    )
    whole = taken.agg(F.sum("mixed").alias("all_mixed"))
    none = (
        docs.join(listed.select("source"), "source", "left_anti")
        .agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("available"), F.count("*").alias("docs"))
        .select(
            F.lit(None).cast("string").alias("source"),
            F.lit(0.0).alias("target_share"),
            F.lit(0).alias("max_repeats"),
            "available",
            "docs",
            F.lit(0.0).alias("planned"),
        )
    )
    report = (
        planned.drop("whole")
        .unionByName(none)
        .join(taken, "source", "left")
        .crossJoin(whole)  # one row
        .select(
            "source",
            "target_share",
            "max_repeats",
            "docs",
            F.col("available").alias("available_tokens"),
            F.round("planned").cast("long").alias("planned_tokens"),
            F.coalesce("mixed", F.lit(0)).cast("long").alias("mixed_tokens"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.coalesce(F.round(F.col("mixed") / F.col("all_mixed"), 6), F.lit(0.0)).alias("actual_share"),
        )
    )
    return used, report
