"""Incremental ingest: new records pass the rules as they arrive, and rolling counts tolerate late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import qc


def stream_records(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is declared."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_findings(records: DataFrame, rules: dict, owner: str, item: str, path: str) -> DataFrame:
    """The same rules on a stream: they are stateless."""
    return qc.run_rules(records, rules, owner=owner, item=item, path=path)


def first_seen(records: DataFrame, digest: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each digest; state older than the watermark is dropped."""
    return records.withWatermark(ts, delay).dropDuplicatesWithinWatermark([digest])


def rolling_counts(records: DataFrame, ts: str, key: str, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start, end, key, n) of event-time windows; rows later than the watermark are dropped."""
    g = records.withWatermark(ts, delay).groupBy(F.window(ts, window, slide) if slide else F.window(ts, window), key).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sessions(records: DataFrame, ts: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    g = records.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def write_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, then stop; exactly once by the checkpoint and the file sink's log."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def write_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a batch operator on every micro-batch; ``each`` must overwrite by batch id to be repeatable."""
    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
