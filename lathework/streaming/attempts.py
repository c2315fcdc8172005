"""Run logs as a stream: attempts are deduplicated as they arrive and summarised. An extension; batch queries give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strictjson import checked_response

SCHEMA = "run_id string, attempt_index int, system_id string, recorded_at timestamp, raw_output string"


def read_attempts(spark: SparkSession, folder: str, lateness: str = "1 hour") -> DataFrame:
    """Attempts from JSON lines files as they appear; an attempt delivered again within the lateness counts once."""
    rows = spark.readStream.schema(SCHEMA).json(folder)
    return rows.withWatermark("recorded_at", lateness).dropDuplicatesWithinWatermark(["run_id", "attempt_index"])


def windowed_summary(attempts: DataFrame, width: str = "10 minutes") -> DataFrame:
    """``start, system_id, attempts, json_valid, schema_valid`` by event-time window."""
    checked = attempts.withColumn("c", checked_response("raw_output"))
    per = checked.groupBy(F.window("recorded_at", width).alias("w"), "system_id")
    return per.agg(F.count("*").alias("attempts"), F.count_if("c.json_valid").alias("json_valid"), F.count_if("c.schema_valid").alias("schema_valid")).select(F.col("w.start").alias("start"), "system_id", "attempts", "json_valid", "schema_valid")


def to_memory(summary: DataFrame, name: str):
    """A query that takes all that is there and stops."""
    return summary.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
