"""Review of suggested mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decide(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """``items(item_id, target, status)`` after ``decisions(item_id, action, target, at)``; the last decision counts.

    approve keeps the suggestion, override sets another target, reject and
    unmap clear it. Undecided items stay.
    """
    last = decisions.groupBy("item_id").agg(F.max(F.struct("at", "action", F.col("target").alias("to"))).alias("d"))
    action = F.col("d.action")
    return items.join(last, "item_id", "left").select(
        "item_id",
        F.when(action == "override", F.col("d.to")).when(action.isin("reject", "unmap"), F.lit(None)).otherwise(F.col("target")).alias("target"),
        F.when(action == "approve", "approved")
        .when(action == "override", "overridden")
        .when(action == "reject", "rejected")
        .when(action == "unmap", "unmapped")
        .otherwise(F.col("status"))
        .alias("status"),
    )


def approve_all(items: DataFrame) -> DataFrame:
    """Open suggestions with a target approved."""
    open_ = F.col("status").isin("needs_review", "auto_accepted") & F.col("target").isNotNull()
    return items.withColumn("status", F.when(open_, "approved").otherwise(F.col("status")))


def review_order(items: DataFrame) -> DataFrame:
    """Least certain first."""
    return items.orderBy("confidence", "item_id")


def finalised(items: DataFrame) -> bool:
    """Nothing is left to review."""
    return items.where("status = 'needs_review'").isEmpty()
