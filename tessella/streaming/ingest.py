"""Incremental ingest of record files with the batch operators.

Canonicalisation looks at one row at a time, so the same functions serve a stream. What a trigger finds
is written once: the file sink and its checkpoint make a restart exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessella.operators import canonical


def event_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet files that land in a folder, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def canonical_stream(raw: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that has landed so far, canonicalised with its reasons and written to ``path``."""
    judged = canonical.with_reasons(raw).select("record", "kind", "created_utc", "text", "reason")
    return judged.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per window and type, closed once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
