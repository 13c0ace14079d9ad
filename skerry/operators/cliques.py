"""Maximal cliques up to a size, by extending cliques one vertex at a time.

Edges point from the lesser to the greater vertex, so each clique is built once, in order; a clique is extended by joining
the edges of its last vertex and keeping the candidates that are joined to all others. No group is ever gathered in a task,
except to count the cliques beyond the size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.operators.components import connected_components
from skerry.sources.durable import durable


def _edges(edges: DataFrame) -> DataFrame:
    return durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")


def _grow(level: DataFrame, e: DataFrame, size: int) -> DataFrame:
    """Cliques (members) of one vertex more than the ``size`` of those given."""
    last = level.withColumn("last", F.element_at("members", -1))
    grown = last.join(e, last["last"] == e["a"]).select("members", F.col("b").alias("new"))
    pairs = grown.select("members", "new", F.explode("members").alias("m"))
    linked = pairs.join(e, (pairs["m"] == e["a"]) & (pairs["new"] == e["b"])).groupBy("members", "new").agg(F.count("*").alias("n")).where(F.col("n") == size)
    return durable(linked.select(F.concat("members", F.array("new")).alias("members")), "cliques")


def maximal_cliques(edges: DataFrame, most: int = 6) -> DataFrame:
    """edges (a, b) -> (members array<long>, size) of all maximal cliques of 2..most vertices.

    A clique inside one of more than ``most`` vertices is not maximal and does not come out, nor does the large one itself;
    larger_cliques counts those."""
    e = _edges(edges)
    level = e.select(F.array("a", "b").alias("members"))
    kept = []
    for size in range(2, most + 1):
        bigger = _grow(level, e, size)
        inside = bigger.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(size + 1)), lambda i: F.filter("members", lambda x, k: k != i - 1))).alias("members")).distinct()
        kept.append(level.join(inside, "members", "left_anti").withColumn("size", F.lit(size)))
        level = bigger
        if level.isEmpty():
            break
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


def larger_cliques(edges: DataFrame, most: int = 6) -> DataFrame:
    """edges (a, b) -> (skipped long), one row: how many maximal cliques have more than ``most`` vertices.

    All edges of such a clique lie in cliques of most + 1 vertices, so only those edges are kept; the cliques of each
    of their components are then counted in a task (Bron-Kerbosch with pivot)."""
    e = _edges(edges)
    level = e.select(F.array("a", "b").alias("members"))
    for size in range(2, most + 1):
        level = _grow(level, e, size)
    one = level.select("members", F.explode("members").alias("a"))
    large = durable(one.select("a", F.explode("members").alias("b")).where("a < b").distinct(), "large")
    parts = connected_components(large.select(F.col("a").alias("v")).union(large.select("b")).distinct(), large)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set] = {}
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        n, stack = 0, [(0, set(near), set())]
        while stack:
            size, open_, closed = stack.pop()
            if not open_:
                n += size > most and not closed
                continue
            pivot = max(open_ | closed, key=lambda v: len(near[v] & open_))
            for v in open_ - near[pivot]:
                stack.append((size + 1, open_ & near[v], closed & near[v]))
                open_, closed = open_ - {v}, closed | {v}
        return pd.DataFrame({"n": [n]})

    each = large.join(parts.withColumnRenamed("v", "a"), "a").groupBy("component").applyInPandas(count, "n long")
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("skipped"))
