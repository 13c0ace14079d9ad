"""Incremental processing with Structured Streaming.

The store has no endless streams, but three increments: captured turns, changed files, operations on memories. Each is a
file source drained with ``availableNow``; state and progress live in the folder the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators.oplog import mark_fold
from skerry.sources.durable import shared_dir


def _place(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/skerry-stream-{label}-{uuid.uuid4().hex}"


def _any(source: str) -> str:
    """The path as a pattern that only it matches: a file stream takes directories and patterns, not the name of a file."""
    return f"{source[:-1]}[{source[-1]}]"


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Processes what is there, appends it to out and stops."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def captured_sessions(spark: SparkSession, source: str, late: str = "3650 days") -> DataFrame:
    """Every (session, source type) once, however often and in however many files it is delivered; rows later than the
    watermark allows are dropped, which bounds the state."""
    schema = spark.read.parquet(source).schema
    turns = spark.readStream.schema(schema).parquet(_any(source)).where("session_id IS NOT NULL")
    turns = turns.withColumn("seen_at", F.col("created_at").cast("timestamp")).withWatermark("seen_at", late)
    keys = turns.dropDuplicatesWithinWatermark(["session_id", "source_type"]).select("session_id", "source_type")
    out = _place(spark, "captured")
    drain(keys, out, out + "-state")
    return spark.read.schema("session_id string, source_type string").parquet(out)


def follow_marks(spark: SparkSession, source: str, schema, to_ops) -> DataFrame:
    """Folds an operation log that arrives in files: every batch is appended to the log, the fold runs over the whole of it."""
    out = _place(spark, "ops")

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is repeated after a failure overwrites what it wrote before
        to_ops(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = spark.readStream.schema(schema).parquet(_any(source)).writeStream.foreachBatch(keep).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return mark_fold(spark.read.parquet(out).drop("batch"))
