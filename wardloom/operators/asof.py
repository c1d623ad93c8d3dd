"""Attributes as known at event time: interval joins without range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def code_key(code: Column) -> Column:
    """Codes compare without letter case, outer blanks and dots; blank is null."""
    return F.nullif(F.replace(F.upper(F.trim(code)), F.lit(".")), F.lit(""))


def known_intervals(
    revisions: DataFrame, entity: str, start: str, end: str, published: str, order: list[str]
) -> DataFrame:
    """Disjoint half-open intervals ``[from_day, to_day)`` per entity with the revision known then.

    A revision holds from the later of its start and its publication until the
    day after its end (null: open). Successive change times of an entity cut
    time into segments; in each the revision last in ``order`` wins. Columns of
    the result: ``entity, from_day, to_day`` and the columns of ``order``.
    Rows without entity, start or publication, or that end before they begin,
    hold nowhere.
    """
    open_end = F.lit("9999-12-31").cast("date")
    spans = (
        revisions.select(
            F.col(entity).alias("entity"),
            F.greatest(start, published).alias("from_day"),
            F.when(F.col(end).isNull() | (F.col(end) >= open_end), open_end)
            .otherwise(F.date_add(F.col(end), 1))
            .alias("to_day"),
            F.struct(*order).alias("rank"),
            F.col(start).isNotNull().alias("has_start"),
            F.col(published).isNotNull().alias("has_pub"),
        )
        .where("entity is not null and has_start and has_pub and from_day < to_day")
        .drop("has_start", "has_pub")
        .distinct()
    )
    cuts = spans.select("entity", F.explode(F.array("from_day", "to_day")).alias("day")).distinct()
    segments = cuts.withColumn(
        "next", F.lead("day").over(Window.partitionBy("entity").orderBy("day"))
    ).where("next is not null")
    held = (
        segments.alias("s")
        .join(
            spans.alias("r"),
            F.expr("s.entity = r.entity and s.day >= r.from_day and s.day < r.to_day"),
        )
        .groupBy(F.col("s.entity").alias("entity"), F.col("s.day").alias("from_day"))
        .agg(F.first("s.next").alias("to_day"), F.max("rank").alias("rank"))
    )
    return held.select("entity", "from_day", "to_day", "rank.*")


def asof_join(
    events: DataFrame, intervals: DataFrame, entity: str, day: str, bucket_days: int = 366
) -> DataFrame:
    """Inner join of each event with the interval of its entity that contains its day.

    Intervals are exploded into time buckets, clipped to the buckets between
    the first and last event, and events meet them by equality of entity and
    bucket with half-open containment. Bucketing also spreads an entity that
    holds a large share of the events. Events without entity or day, or in no
    interval, are left out; intervals must not overlap within an entity. A
    column of the intervals that an event has too comes out as ``<name>_known``.
    """
    day_bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / bucket_days)
    placed = events.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).withColumn(
        "_bucket", day_bucket(F.col(day))
    )
    reach = placed.agg(F.min("_bucket").alias("_lo"), F.max("_bucket").alias("_hi"))
    own = {c: f"{c}_known" if c in events.columns else c for c in intervals.columns if c != "entity"}
    spread = (
        intervals.select(
            F.col("entity").alias("_entity"),
            F.col("from_day").alias("_from"),
            F.col("to_day").alias("_to"),
            *(F.col(c).alias(name) for c, name in own.items()),
        )
        .crossJoin(reach)  # one row
        .withColumns(
            {
                "_a": F.greatest(day_bucket(F.col("_from")), F.col("_lo")),
                "_b": F.least(day_bucket(F.date_sub("_to", 1)), F.col("_hi")),
            }
        )
        .where("_a <= _b")
        .withColumn("_at", F.explode(F.sequence("_a", "_b")))
        .drop("_a", "_b", "_lo", "_hi")
    )
    inside = (F.col(day) >= F.col("_from")) & (F.col(day) < F.col("_to"))
    return placed.join(
        spread, (F.col(entity) == F.col("_entity")) & (F.col("_bucket") == F.col("_at")) & inside
    ).drop("_bucket", "_at", "_entity", "_from", "_to")
