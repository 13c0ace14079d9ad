"""Mixing sources to target weights by Poisson replication.

Every (mix, document) has a uniform number from its hash. Inverting the Poisson distribution with
mean r at that number says how often the document is used, at most ``max_repeats`` times; copies appear
one by one as r grows, so the tokens of a source grow with r. r is set for each source such that
its tokens meet its share: two passes sum the tokens by the grid cell of r at which each copy appears
(a fixed number of cells for each of the few targets), first over all of r, then within the cell found.
Some seeds are tried at once for each target and the one whose tokens come nearest to the goal is kept:
where a few long documents make up a source, one seed alone may have no rate near the goal.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.tokens import VOCABULARY, with_token_counts
from skerry.sources.durable import durable

CELLS = 512
MOST_TARGETS = 10_000
SEEDS = 8


def poisson_cdf(rate: np.ndarray, most: int) -> np.ndarray:
    """P(count <= k) for k below most, a row a k."""
    term = np.exp(-rate)
    out, acc = [], np.zeros_like(rate)
    for k in range(most):
        acc = acc + term
        out.append(acc)
        term = term * rate / (k + 1)
    return np.array(out)


def uniform(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Numbers strictly between 0 and 1 from 64-bit hashes, other ones for each seed."""
    x = hashes.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(12)).astype(np.float64) / (1 << 52) + 0.5 / (1 << 52)


def _cells(grids: dict, caps: dict, seeds: dict):
    """Tokens by target, seed and the cell at whose upper edge a copy appears."""

    def run(batches):
        cdf = {(t, s): poisson_cdf(grids[t, s], caps[t]) for t in caps for s in seeds[t]}
        for b in batches:
            target, n, v = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            out = []
            for t in np.unique(target).tolist():
                own = target == t
                for s in seeds[t]:
                    total, u = np.zeros(CELLS + 1), uniform(v[own], s)
                    for row in cdf[t, s]:  # falls with the rate: the copy is there once u exceeds it
                        total += np.bincount(np.minimum(np.searchsorted(-row, -u, "right"), CELLS), n[own], CELLS + 1)
                    hit = np.flatnonzero(total)
                    out.append((np.full(len(hit), t), np.full(len(hit), s), hit, total[hit]))
            if out:
                t, s, c, k = (np.concatenate(x).astype(np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t, s, c, k)], names=["target", "seed", "cell", "tokens"])

    return run


def _counts(rate: dict, caps: dict, seed: dict):
    """Adds how often each document is drawn."""

    def run(batches):
        cdf = {t: poisson_cdf(np.array([rate[t]]), caps[t])[:, 0] for t in caps}
        for b in batches:
            target, v = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("target", "v"))
            count = np.zeros(b.num_rows, np.int32)
            for t in np.unique(target).tolist():
                own = target == t
                count[own] = (uniform(v[own], seed[t])[:, None] > cdf[t][None, :]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(count)], names=["target", "mix_name", "source", "doc_id", "n_tokens", "count"])

    return run


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, source, path, text), targets (mix_name, source, target_share, max_repeats) ->
    (copies, shares).

    copies (mix_name, place, source, doc_id, copy, n_tokens) in the shuffled order of place; shares (mix_name,
    source, target_share, max_repeats, documents, source_tokens, rate, tokens, actual_share, reached).

    A file delivered again unchanged (same source, path and text) counts once, under its least doc_id.
    The total of a mix is the largest at which every source with documents keeps its share; a source
    without any tokens gives nothing and its share is reported as not reached. Targets with a null or
    not positive share or repeats give nothing."""
    spark = docs.sparkSession
    rows = targets.where("mix_name IS NOT NULL AND source IS NOT NULL").groupBy("mix_name", "source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
    rows = rows.select("mix_name", "source", "t.target_share", "t.max_repeats").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} mix targets; they must be a small dimension")
    rows = sorted(rows)
    copies_schema = "mix_name string, place long, source string, doc_id long, copy int, n_tokens int"
    shares_schema = "mix_name string, source string, target_share double, max_repeats int, documents long, source_tokens long, rate double, tokens long, actual_share double, reached boolean"
    if not rows:
        return spark.createDataFrame([], copies_schema), spark.createDataFrame([], shares_schema)
    named = docs.where(F.col("source").isin(sorted({r.source for r in rows})) & F.col("doc_id").isNotNull())
    named = named.select("doc_id", "source", F.coalesce("path", F.lit("")).alias("path"), "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    sized = with_token_counts(named, "text", vocabulary).groupBy("source", "path", "h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    sized = durable(sized.select("source", "doc_id", "n_tokens"), "sized")
    have = {r.source: (r.docs, r.tokens) for r in sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).collect()}

    usable = {i: r for i, r in enumerate(rows) if (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0 and have.get(r.source, (0, 0))[1] > 0}
    size: dict[str, float] = {}
    for r in usable.values():
        most = r.max_repeats * have[r.source][1] / r.target_share
        size[r.mix_name] = min(size.get(r.mix_name, math.inf), most)
    goal = {i: r.target_share * size[r.mix_name] for i, r in usable.items()}
    caps = {i: r.max_repeats for i, r in usable.items()}
    usable_rows = [(i, r.source, r.mix_name) for i, r in usable.items()]
    pick = F.broadcast(spark.createDataFrame(usable_rows, "target int, source string, mix_name string")) if usable else None  # at most MOST_TARGETS rows
    if pick is None:
        drawn = spark.createDataFrame([], "target int, mix_name string, source string, doc_id long, n_tokens int, count int")
        rate: dict[int, float] = {}
    else:
        rolled = sized.join(pick, "source").select("target", "mix_name", "source", "doc_id", "n_tokens", F.xxhash64(F.lit(seed), "mix_name", "doc_id").alias("v"))
        seeds: dict[int, list[int]] = {i: list(range(SEEDS)) for i in usable}
        grids = {(i, s): np.geomspace(1e-6, 8 * caps[i] + 40, CELLS) for i in usable for s in seeds[i]}
        best: dict[int, tuple] = {}
        for _ in range(2):
            cells = rolled.select("target", "n_tokens", "v").mapInArrow(_cells(grids, caps, seeds), "target long, seed long, cell long, tokens long")
            sums = {k: np.zeros(CELLS + 1) for k in grids}
            for r in cells.groupBy("target", "seed", "cell").agg(F.sum("tokens").alias("tokens")).collect():
                sums[r.target, r.seed][r.cell] = r.tokens
            for (i, s), own in sums.items():
                up = np.cumsum(own)[:CELLS]  # tokens at each grid rate
                j = int(np.argmin(np.abs(up - goal[i])))
                best[i] = min(best.get(i, (math.inf,)), (abs(up[j] - goal[i]), s, float(grids[i, s][j])))
                k = min(int(np.searchsorted(up, goal[i])), CELLS - 1)
                grids[i, s] = np.linspace(grids[i, s][k - 1] if k else 0.0, grids[i, s][k], CELLS)
        rate = {i: b[2] for i, b in best.items()}
        fields = "target int, mix_name string, source string, doc_id long, n_tokens int, count int"
        drawn = durable(rolled.mapInArrow(_counts(rate, caps, {i: b[1] for i, b in best.items()}), fields).where("count > 0"), "drawn")
    copies = drawn.select("mix_name", "source", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    copies = copies.withColumn("place", F.xxhash64(F.lit(seed + 1), "mix_name", "doc_id", "copy"))
    copies = copies.select("mix_name", "place", "source", "doc_id", "copy", "n_tokens").orderBy("place", "mix_name", "doc_id", "copy")
    got = {r.target: r.tokens for r in drawn.groupBy("target").agg(F.sum(F.col("n_tokens").cast("long") * F.col("count")).alias("tokens")).collect()}
    total: dict[str, int] = {}
    for i, n in got.items():
        total[rows[i].mix_name] = total.get(rows[i].mix_name, 0) + n
    out = []
    for i, r in enumerate(rows):
        docs_n, tokens_n = have.get(r.source, (0, 0))
        share = got.get(i, 0) / total[r.mix_name] if total.get(r.mix_name) else 0.0
        out.append((r.mix_name, r.source, r.target_share, r.max_repeats, docs_n, tokens_n, rate.get(i, 0.0), got.get(i, 0), share, bool(got.get(i)) and abs(share - (r.target_share or 0)) <= 0.01))
    return copies, spark.createDataFrame(out, shares_schema)
