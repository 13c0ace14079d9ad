"""Current state from append-only operation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mark_fold(ops: DataFrame) -> DataFrame:
    """ops (id, ts, seq, status) -> (id, status, retired_at, intervals).

    Leaving ``active`` stamps retired_at once; coming back clears it and keeps the interval, unless it would not end after
    it began. The state machine is a fold over each row's operations in order, inside the JVM; an id has as many operations
    as it was ever marked."""
    log = ops.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "status"))).alias("log"))
    none = F.lit(None).cast("timestamp_ntz")
    empty = F.array().cast("array<struct<retired_at:timestamp_ntz,reactivated_at:timestamp_ntz>>")
    start = F.struct(F.lit("active").alias("status"), none.alias("retired_at"), empty.alias("intervals"))

    def step(s, o):
        back = o["status"] == "active"
        closed = back & s["retired_at"].isNotNull() & (s["retired_at"] < o["ts"])
        span = F.array(F.struct(s["retired_at"].alias("retired_at"), o["ts"].alias("reactivated_at")))
        return F.struct(
            o["status"].alias("status"), F.when(~back, F.coalesce(s["retired_at"], o["ts"])).alias("retired_at"), F.when(closed, F.concat(s["intervals"], span)).otherwise(s["intervals"]).alias("intervals")
        )

    return log.select("id", F.aggregate("log", start, step).alias("s")).select("id", "s.status", "s.retired_at", "s.intervals")


def supersede_fold(m: DataFrame) -> DataFrame:
    """m with the state its own supersede links imply: (id, status, retired_at, valid_to).

    A link counts if both rows have one author and the new one is not older. The first replacement ends the belief; an event
    window ends only where the replacement states its own start, and never before the old row's own."""
    new = m.where("supersedes_id IS NOT NULL").select(F.col("supersedes_id").alias("id"), F.col("author").alias("by"), F.col("created_at").alias("at"), F.col("valid_from").alias("from"))
    ok = m.select("id", "author", F.col("created_at").alias("born"), F.col("valid_from").alias("start")).join(new, "id").where("author = by AND at >= born")
    first = ok.groupBy("id").agg(F.min("at").alias("at"), F.min(F.when(F.col("from") >= F.coalesce("start", "from"), F.col("from"))).alias("ends"))
    j = m.select("id", "status", "retired_at", "valid_to").join(first, "id", "left")
    return j.select("id", F.when(F.col("at").isNotNull() & (F.col("status") == "active"), "superseded").otherwise(F.col("status")).alias("status"), F.coalesce("retired_at", "at").alias("retired_at"), F.least("valid_to", "ends").alias("valid_to"))
