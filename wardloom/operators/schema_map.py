"""Source columns to fields of a standard: by name patterns and by similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_text(name: Column, kind: Column, samples: Column) -> Column:
    """What is embedded for a column: its name in words, a hint of its type, the first three samples."""
    hint = (
        F.when(kind.rlike("date|time"), "date")
        .when(kind.rlike("int|long|double|float|decimal"), "number")
        .otherwise("text")
    )
    return F.concat_ws(" ", F.regexp_replace(F.lower(name), "_", " "), hint, F.array_join(F.slice(samples, 1, 3), " "))


def pattern_match(columns: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(column_name, target, confidence)``: the first pattern, in order, found in each column's name.

    An equal name scores 0.95, a contained pattern 0.85. ``patterns`` has
    ``pattern, target, ordinal`` and is part of a standard's definition: its
    size is the definition's.
    """
    name = F.lower("column_name")
    hit = columns.select("column_name").distinct().join(patterns, F.contains(name, F.lower("pattern")))
    best = hit.groupBy("column_name").agg(
        F.min(F.struct(F.when(name == F.lower("pattern"), 0).otherwise(1).alias("loose"), "ordinal", "target")).alias("b")
    )
    return best.select(
        "column_name", F.col("b.target").alias("target"), F.when(F.col("b.loose") == 0, 0.95).otherwise(0.85).alias("confidence")
    )


def fuse(pattern: Column, pattern_score: Column, cosine: Column, candidate: Column, default: Column) -> tuple[Column, Column]:
    """(target, confidence): a pattern decides; else a similarity of 0.40 or more counts min(0.5 + c, 0.95),
    a lower one 0.7 c; without either the default target at 0.30."""
    strong = F.least(cosine + 0.5, F.lit(0.95))
    confidence = F.when(pattern.isNotNull(), pattern_score).when(cosine >= 0.40, strong).when(cosine.isNotNull(), cosine * 0.7).otherwise(0.30)
    target = F.when(pattern.isNotNull(), pattern).when(cosine.isNotNull(), candidate).otherwise(default)
    return target, F.round(F.greatest(confidence, F.lit(0.0)), 4)


def dedupe_targets(suggestions: DataFrame) -> DataFrame:
    """Of several columns with one target the most confident keeps it (the first on ties); others fall to 0.50 and are marked."""
    order = Window.partitionBy("target").orderBy(F.desc("confidence"), "ordinal")
    loser = (F.row_number().over(order) > 1) & F.col("target").isNotNull()
    return suggestions.withColumn("demoted", loser).withColumn(
        "confidence", F.when(F.col("demoted"), F.least("confidence", F.lit(0.50))).otherwise(F.col("confidence"))
    )


def status(confidence: Column, auto: float = 0.95, review: float = 0.70) -> Column:
    return F.when(confidence >= auto, "auto_accepted").when(confidence >= review, "needs_review").otherwise("unmapped")
