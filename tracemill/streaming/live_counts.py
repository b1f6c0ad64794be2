"""Counts over trace events while the logs grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_path


def live_counts(events: DataFrame) -> DataFrame:
    """trace_id, func, line with hits, calls and exceptions so far; works on streams and on tables."""
    return events.groupBy("trace_id", "func", "line").agg(
        F.count_if(F.col("event") == "line").alias("hits"), F.count_if(F.col("event") == "call").alias("calls"),
        F.count_if(F.col("event") == "exception").alias("exceptions"))


def run_available(spark: SparkSession, source: DataFrame, name: str) -> DataFrame:
    """Process what a stream has now and give its final counts, from a table in the shared folder.

    Each micro-batch replaces the changed counts under its own number; the last
    count of a key is the one of its latest batch.
    """
    out = shared_path(spark, name)
    keys = ["trace_id", "func", "line"]

    query = source.writeStream.outputMode("update").option("checkpointLocation", shared_path(spark, f"{name}-state")).trigger(availableNow=True).foreachBatch(
        lambda b, n: b.write.mode("overwrite").parquet(f"{out}/data/batch={n}")).start()
    query.awaitTermination()
    schema = T.StructType([*source.schema.fields, T.StructField("batch", T.LongType())])
    found = spark.read.schema(schema).parquet(f"{out}/data")
    rest = [c for c in source.columns if c not in keys]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
