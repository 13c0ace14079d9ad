"""Streaming queries, drained over the tables at hand."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.streaming import capture


def stream_captured_sessions(spark: SparkSession, d: str) -> DataFrame:
    return capture.captured_sessions(spark, f"{d}/mem_sources.parquet")


def stream_mark_fold(spark: SparkSession, d: str) -> DataFrame:
    """The mark fold of the batch query, fed by a stream of event files."""
    source = f"{d}/events.parquet"

    def to_ops(e: DataFrame) -> DataFrame:
        status = F.when(F.col("event_type") == "error", "retracted").when(F.col("event_type") == "view", "superseded").otherwise("active")
        return e.where("event_type IN ('error', 'view', 'purchase', 'signup')").select(F.col("user_id").alias("id"), "ts", F.col("event_id").alias("seq"), status.alias("status"))

    f = capture.follow_marks(spark, source, spark.read.parquet(source).schema, to_ops)
    return f.select("id", "status", "retired_at", F.size("intervals").alias("n_intervals"))


QUERIES = {"stream_captured_sessions": stream_captured_sessions, "stream_mark_fold": stream_mark_fold}

from skerry.plans.mutation import ORACLE as _MARKS  # noqa: E402

ORACLE = {
    "stream_captured_sessions": "SELECT DISTINCT session_id, source_type FROM mem_sources WHERE session_id IS NOT NULL",
    "stream_mark_fold": f"SELECT id, status, retired_at, n_intervals FROM ({_MARKS['mark_fold']})",
}
