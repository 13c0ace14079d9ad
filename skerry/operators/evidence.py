"""Derivations between memories: ancestry walks, premises, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.operators.views import in_window, may_read
from skerry.sources.durable import durable


def walk(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Paths from each seed to its evidence: (node, root, target, relation, depth, path).

    edges (derived, evidence, relation), seeds (root). A contradicting edge is kept but ends its path; no path
    meets a node twice. One join a hop, at most ``hops`` of them."""
    e = edges.select("derived", "evidence", "relation")
    step = e.join(seeds.select("root"), F.col("derived") == F.col("root")).select(
        F.col("evidence").alias("node"), "root", F.col("derived").alias("target"), "relation", F.lit(1).alias("depth"), F.array("derived", "evidence").alias("path")
    )
    step = durable(step, "hop")  # a hop is computed once, however many follow it
    out = step
    for _ in range(hops - 1):
        on = step.where("relation <> 'contradicts'").select("node", "root", "depth", "path")
        step = on.join(e, on.node == e.derived).where(~F.array_contains("path", F.col("evidence"))).select(
            F.col("evidence").alias("node"), "root", F.col("derived").alias("target"), "relation", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("evidence")).alias("path")
        )
        step = durable(step, "hop")
        if step.isEmpty():
            break
        out = out.unionByName(step)
    return out


def ancestry(paths: DataFrame) -> DataFrame:
    """By evidence: its least depth, the roots and number of paths it supports, the targets it contradicts."""
    against = F.col("relation") == "contradicts"
    return paths.groupBy("node").agg(
        F.min("depth").alias("depth"),
        F.sort_array(F.collect_set(F.when(~against, F.col("root")))).alias("roots"),
        F.count_distinct(F.when(~against, F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))).alias("paths"),
        F.sort_array(F.collect_set(F.when(against, F.col("target")))).alias("contradicts"),
    )


def premises(edges: DataFrame, m: DataFrame) -> DataFrame:
    """(derived, premise): inferred_from and supports edges, and well-formed ids in metadata.premise_ids."""
    direct = edges.where(F.col("relation").isin("inferred_from", "supports")).select("derived", F.col("evidence").alias("premise"))
    listed = F.from_json(F.get_json_object("metadata", "$.premise_ids"), "array<string>")
    named = m.select(F.col("id").alias("derived"), F.explode(listed).alias("raw")).where(F.col("raw").rlike("^[0-9]{1,18}$"))
    return direct.unionByName(named.select("derived", F.col("raw").cast("long").alias("premise"))).distinct()


def premises_live(edges: DataFrame, m: DataFrame, reader: str, projects: list[str], now: str) -> DataFrame:
    """(derived, live) for every memory the reader sees: it has premises, and each exists, is active, in its window and readable."""
    p = premises(edges, m)
    ok = m.where((F.col("status") == "active") & in_window(now) & may_read(reader, projects)).select(F.col("id").alias("premise"), F.lit(1).alias("ok"))
    by = p.join(ok, "premise", "left").groupBy("derived").agg(F.count("*").alias("n"), F.count("ok").alias("k"))
    seen = m.where(may_read(reader, projects)).select(F.col("id").alias("derived"))
    return seen.join(by, "derived", "left").select("derived", F.coalesce(F.col("n") == F.col("k"), F.lit(False)).alias("live"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on or behind a cycle, by peeling: nodes nothing points to go, until none are left to go.

    edges (src, dst). The rest has a cycle; an empty rest proves there is none. Rounds: the longest path that leads to no cycle."""
    left = durable(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "peel")
    n = left.count()
    while n:
        left = durable(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "peel")
        rest = left.count()
        if rest == n:
            break
        n = rest
    return left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def would_cycle(edges: DataFrame, new: DataFrame) -> DataFrame:
    """new (evidence, derived) with closes: adding the edge would close a cycle, because evidence already follows from
    derived. The frontier of all proposals grows together, each pair (proposal, node) once, until it is empty."""
    e = edges.select(F.col("evidence").alias("from"), F.col("derived").alias("to"))
    seen = durable(new.select("evidence", "derived", F.col("derived").alias("at")).distinct(), "reach")
    front, rounds = seen, 0
    while True:
        step = front.join(e, front["at"] == e["from"]).select("evidence", "derived", F.col("to").alias("at")).distinct()
        front = durable(step.join(seen, ["evidence", "derived", "at"], "left_anti"), "reach")
        if front.isEmpty():
            break
        seen, rounds = seen.unionByName(front), rounds + 1
        if rounds % 16 == 0:  # keeps the plan shallow
            seen = durable(seen, "reach")
    hit = seen.where(F.col("at") == F.col("evidence")).select("evidence", "derived", F.lit(True).alias("hit")).distinct()
    return new.distinct().join(hit, ["evidence", "derived"], "left").select("evidence", "derived", F.coalesce("hit", F.lit(False)).alias("closes"))
