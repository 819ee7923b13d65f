"""Structured Streaming: log tails, event sinks, upserts and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .sessions import BUCKETS, KeyedTable

EVENT = "ts timestamp, session string, event_type string, value double"


def tail(spark: SparkSession, folder: str, schema: str = EVENT) -> DataFrame:
    """An append-only folder of JSON lines, each file read exactly once."""
    return spark.readStream.schema(schema).json(folder)


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Event log sink; stops when all that is there has been read."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by window and type; state older than the watermark is dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def latest_table(spark: SparkSession, path: str, schema: StructType, key: str, at: str, buckets: int = BUCKETS) -> KeyedTable:
    """The table that ``keep_latest`` writes: one row a key."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return KeyedTable(spark, path, ddl, [key], at, buckets=buckets)


def keep_latest(stream: DataFrame, path: str, checkpoint: str, key: str, at: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Upserts every micro-batch into a keyed table: last write wins. A batch rewrites the
    buckets that its keys lie in; a failed one changes nothing, one that comes again is known."""
    return latest_table(stream.sparkSession, path, stream.schema, key, at, buckets).follow(stream, checkpoint, "keep-latest")
