"""Extensions: the stateless operators on streams, and code discovery once per code."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardloom.operators import relational as R


def mapped_stream(stream: DataFrame, source: str, mapping: Mapping, target: str, default=0) -> DataFrame:
    """Dictionary lookup on a stream: the same projection as on a table."""
    return R.map_column(stream, source, mapping, target, default)


def new_codes(stream: DataFrame, code: str, at: str, delay: str = "1 day") -> DataFrame:
    """Each code once within ``delay`` of event time; state older than that is dropped."""
    return (
        stream.where(F.col(code).isNotNull())
        .withWatermark(at, delay)
        .dropDuplicatesWithinWatermark([code])
        .select(code, at)
    )


def rates(stream: DataFrame, at: str, code: str, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Rows per code and window, emitted when the watermark passes it."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, window), code).agg(F.count("*").alias("n"))


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write everything that is there as Parquet and stop; a restart goes on where it ended."""
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
