"""References to records that do not exist, are deleted or arrive later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_key(c: Column) -> Column:
    """Ids compare without letter case and outer blanks; blank is null."""
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def references(df: DataFrame, table: str, record: str, key: Column, at: str) -> DataFrame:
    """``(table_name, record_id, key, at)`` of every row that refers to something; repeated rows count once."""
    return (
        df.select(
            F.lit(table).alias("table_name"),
            F.col(record).cast("long").alias("record_id"),
            key.cast("string").alias("key"),
            F.col(at).cast("timestamp").alias("at"),
        )
        .where("key is not null and record_id is not null")
    )


def parents(df: DataFrame, key: Column, received: str | None = None, deleted: str | None = None) -> DataFrame:
    """``(key, born, gone)``: one row per validity interval of a parent key.

    Without ``received`` the key is always present, a null receipt counts as
    that too; a null deletion never comes. Null keys are left out, equal
    intervals count once.
    """
    never = F.lit("9999-12-31 00:00:00").cast("timestamp")
    always = F.lit("0001-01-01 00:00:00").cast("timestamp")
    born = F.coalesce(F.col(received).cast("timestamp"), always) if received else always
    gone = F.coalesce(F.col(deleted).cast("timestamp"), never) if deleted else never
    return (
        df.select(key.cast("string").alias("key"), born.alias("born"), gone.alias("gone"))
        .where("key is not null")
        .distinct()
    )


def merge_intervals(*sides: DataFrame) -> DataFrame:
    """The intervals of parents found in several tables."""
    both = sides[0]
    for side in sides[1:]:
        both = both.unionByName(side)
    return both


def stretches(intervals: DataFrame) -> DataFrame:
    """``(key, born, gone, since, until)``: time cut at every receipt of a key.

    One walk over a key's intervals in order of receipt: within ``[since,
    until)`` what was received so far lives until ``gone``, the latest deletion
    up to there. The first stretch of a key begins with time itself, the last
    never ends, so each moment of a key lies in exactly one; a key received
    once has one row.
    """
    order = Window.partitionBy("key").orderBy("born", "gone")
    return intervals.select(
        "key",
        "born",
        F.max("gone").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("gone"),
        F.when(F.row_number().over(order) > 1, F.col("born")).alias("since"),
        F.lead("born").over(order).alias("until"),
    )


def orphans(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """``(table_name, record_id, period, kind)`` of the references without a living parent.

    Both sides are partitioned and sorted by key and merged in one pass
    (sort-merge join; a reference meets the one stretch of its key that holds
    its time). A key that holds a large share of the references is split by
    the skew handling of adaptive execution, which copies only its parent's
    few stretches. ``kind`` is 'missing' (no such key), 'late' (first received
    after the reference) or 'deleted' (everything received by then is deleted
    at or before it); a reference without a time can only be 'missing', with a
    null period. Rows sent twice give one row.
    """
    inside = (F.col("_since").isNull() | (F.col("at") >= F.col("_since"))) & (F.col("_until").isNull() | (F.col("at") < F.col("_until")))
    inside |= F.col("at").isNull() & F.col("_since").isNull()
    cut = stretches(keys).withColumnsRenamed({"key": "_key", "since": "_since", "until": "_until"}).hint("merge")
    kind = (
        F.when(F.col("born").isNull(), "missing")
        .when(F.col("born") > F.col("at"), "late")
        .when(F.col("gone") <= F.col("at"), "deleted")
    )
    return (
        refs.join(cut, (F.col("key") == F.col("_key")) & inside, "left")
        .select("table_name", "record_id", F.date_format("at", "yyyy-MM").alias("period"), kind.alias("kind"))
        .where("kind is not null")
        .distinct()
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts per table, period and kind."""
    return found.groupBy("table_name", "period", "kind").agg(F.count("*").alias("references"))
