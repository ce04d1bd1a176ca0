"""The scan log as streams: score and append, running totals, the latest records.

Retries are not deduplicated. A sink that fails is reported to ``on_error`` and does not stop scoring;
an error of scoring itself stops the stream, which takes the batch again when it is restarted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paigham.operators import scanlog

SCHEMA = "id bigint, row_id bigint, prediction string, confidence double, scanned_at string, logged_at timestamp"


def read_log(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def totals(stream: DataFrame) -> DataFrame:
    """Running counts of the whole history: one row of state."""
    return stream.groupBy().agg(F.count("*").alias("total"), F.count_if(F.col("prediction") == "Scam").alias("scam"))


def windowed(stream: DataFrame, late: str = "2 days", size: str = "1 day") -> DataFrame:
    """Counts per window of logging time; records later than the watermark are left out."""
    return stream.withWatermark("logged_at", late).groupBy(F.window("logged_at", size), "prediction").agg(F.count("*").alias("n"))


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Everything there is, into a table in memory; returns when done."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_scored(messages: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, on_error: Callable[[Exception], None] | None = None) -> StreamingQuery:
    """Scores each batch and appends the records with status 200."""

    def write(batch: DataFrame, _: int) -> None:
        scored = score(batch).where("status = 200").persist()
        try:
            scored.count()  # scored here, where an error stops the stream and the batch is not lost
            try:
                scored.write.mode("append").parquet(path)
            except Exception as e:
                if on_error is None:
                    raise
                on_error(e)
        finally:
            scored.unpersist()

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_recent(stream: DataFrame, path: str, target: str, checkpoint: str, n: int = scanlog.RECENT) -> StreamingQuery:
    """After each batch the latest records of the history at ``path``, rewritten to ``target``."""

    def write(batch: DataFrame, _: int) -> None:
        scanlog.recent(batch.sparkSession.read.schema(SCHEMA).parquet(path), n).write.mode("overwrite").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
