"""Queries over perspectives, evidence and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.operators import evidence as E
from skerry.operators import views as V
from skerry.operators.cliques import larger_cliques, maximal_cliques
from skerry.operators.vectors import similar_vectors
from skerry.plans.memory import DIST, LIVE, M, MAY, NOW, PROJECTS, READER, TOLD, edges, told
from skerry.sources.tables import table

SIMILAR = 0.65


def _perspectives(spark, d):
    names = table(spark, d, "mem_entities").select("id", "canonical_name").dropDuplicates(["id"])
    m = V.visible(V.memories(spark, d), READER, PROJECTS)
    one = names.select(F.col("id").alias("observer_entity_id"), F.col("canonical_name").alias("observer"))
    two = names.select(F.col("id").alias("observed_entity_id"), F.col("canonical_name").alias("observed"))
    return m.join(one, "observer_entity_id").join(two, "observed_entity_id")


def perspectives(spark, d):
    """The 200 latest observer-to-observed edges of the reader."""
    return _perspectives(spark, d).select(F.col("id").alias("memory_id"), "author", "memory_type", "status", "project", "created_at", "observer", "observed").orderBy(F.col("created_at").desc(), F.col("memory_id").desc()).limit(200)


def perspective_filter(spark, d):
    """Memories seen from one peer, by name whatever its case: a semi join."""
    names = table(spark, d, "mem_entities").where("lower(canonical_name) = lower('E3')").select(F.col("id").alias("observer_entity_id"))
    return V.visible(V.memories(spark, d), READER, PROJECTS).join(names, "observer_entity_id", "left_semi").select("id")


def perspective_routes(spark, d):
    """Hits grouped by perspective: first rank; three routes, eight ids each."""
    hits = V.active(V.memories(spark, d), READER, PROJECTS, NOW).orderBy(F.col("importance").desc_nulls_last(), F.col("created_at").desc(), F.col("id").desc()).limit(40)
    w = Window.orderBy(F.col("importance").desc_nulls_last(), F.col("created_at").desc(), F.col("id").desc())
    ranked = hits.withColumn("rank", F.row_number().over(w))
    by = ranked.groupBy("observer_entity_id", "observed_entity_id").agg(F.min("rank").alias("first_rank"), F.count("*").alias("hits"), F.slice(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]), 1, 8).alias("ids"))
    return by.orderBy("first_rank").limit(3)  # a rank stands in one route only, so the order is total


def evidence_edges(spark, d):
    """Edges both of whose ends the reader may see, the first 200 in order."""
    v = V.visible(V.memories(spark, d), READER, PROJECTS).select("id")
    e = edges(spark, d)
    ok = e.join(v.select(F.col("id").alias("derived")), "derived", "left_semi").join(v.select(F.col("id").alias("evidence")), "evidence", "left_semi")
    return ok.orderBy("created_at", "id").limit(200).select("id", "derived", "evidence", "relation")


def evidence_walk(spark, d):
    """Ancestry of every derived memory, up to eight hops, rolled up by evidence."""
    e = edges(spark, d)
    a = E.ancestry(E.walk(e, e.select(F.col("derived").alias("root")).distinct(), 8))
    act = V.active(V.memories(spark, d), READER, PROJECTS, NOW).where(V.not_page()).select(F.col("id").alias("node"))
    return a.join(act, "node", "left_semi").select(F.col("node").alias("memory_id"), "depth", F.size("roots").alias("n_roots"), F.col("paths").alias("n_paths"), "contradicts")


def premises_live(spark, d):
    """With premises that are edges and such as the metadata names."""
    return E.premises_live(edges(spark, d), told(spark, d), READER, PROJECTS, NOW)


def stale_derived(spark, d):
    """Derived memories served no more, because a premise fell away."""
    live = premises_live(spark, d).where("live").select(F.col("derived").alias("id"))
    return V.visible(V.memories(spark, d), READER, PROJECTS).where("reasoning_level IN ('deductive', 'inductive')").join(live, "id", "left_anti").select("id")


def cycle_check(spark, d):
    """Components on or behind a cycle of the dependency graph (itself not taken along)."""
    r = table(spark, d, "relationships").select(F.col("src_component_id").alias("src"), F.col("dst_component_id").alias("dst"))
    return E.cyclic_nodes(r).select(F.col("node").alias("component_id"))


def cycle_guard(spark, d):
    """Every edge proposed again, as it is and turned round: would it close a cycle?"""
    e = edges(spark, d)
    mixed = e.select(F.col("derived").alias("evidence"), F.col("evidence").alias("derived")).unionByName(e.select("evidence", "derived"))
    return E.would_cycle(e, mixed)


def _classes(spark, d):
    """Memories of the reader that may be merged, by their vector."""
    ok = V.not_page() & (F.coalesce("reasoning_level", F.lit("explicit")) == "explicit") & F.col("vec_id").isNotNull() & (F.col("author") == READER)
    return V.active(V.memories(spark, d), READER, PROJECTS, NOW).where(ok).select("id", "vec_id")


def _pairs(spark, d):
    c = _classes(spark, d).groupBy("vec_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    v = table(spark, d, "embeddings").join(c.select("vec_id"), "vec_id", "left_semi")
    return similar_vectors(v, SIMILAR), c


def similar_pairs(spark, d):
    """Pairs of vector classes nearer than the threshold, with the number of memories in each."""
    p, c = _pairs(spark, d)
    a, b = (c.select(F.col("vec_id").alias(k), F.col("n").alias("n_" + k)) for k in "ab")
    return p.join(a, "a").join(b, "b").select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"), F.round("dist", 6).alias("dist"), "n_a", "n_b")


def similar_members(spark, d):
    """One row a memory: its vector class and how many other memories are alike (copies and near ones)."""
    p, c = _pairs(spark, d)
    both = p.select("a", "b").union(p.select("b", "a")).toDF("vec_id", "o")
    near = both.join(c.select(F.col("vec_id").alias("o"), "n"), "o").groupBy("vec_id").agg(F.sum("n").alias("near"))
    own = c.select("vec_id", F.col("n").alias("copies")).join(near, "vec_id", "left")
    return _classes(spark, d).join(own, "vec_id").select("id", "vec_id", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"))


def clique_groups(spark, d):
    """Maximal cliques of 2 to 6 similar vector classes with their mean distance, tightest first; clique_groups_skipped counts the larger ones."""
    p, _ = _pairs(spark, d)
    g = maximal_cliques(p.select("a", "b"), 6).withColumn("label", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))
    one = g.select("label", "size", F.explode("members").alias("a"))
    two = g.select("label", F.explode("members").alias("b"))
    dist = one.join(two, "label").join(p, ["a", "b"]).groupBy("label", "size").agg(F.round(F.avg(F.round("dist", 3)), 6).alias("mean_distance"))
    return dist.select(F.col("label").alias("members"), F.col("size").cast("int"), "mean_distance")


def clique_groups_skipped(spark, d):
    """How many maximal cliques clique_groups leaves out as larger than 6."""
    p, _ = _pairs(spark, d)
    return larger_cliques(p.select("a", "b"), 6)


QUERIES = {f.__name__: f for f in (perspectives, perspective_filter, perspective_routes, evidence_edges, evidence_walk, premises_live, stale_derived, cycle_check, cycle_guard, similar_pairs, similar_members, clique_groups, clique_groups_skipped)}

_C = f"""{M}, c AS (SELECT id, vec_id FROM act WHERE author = 'u1' AND kind IS DISTINCT FROM 'page' AND coalesce(reasoning_level, 'explicit') = 'explicit' AND vec_id IS NOT NULL),
n AS (SELECT vec_id, count(*) AS n FROM c GROUP BY 1),
v AS (SELECT vec_id, embedding::DOUBLE[] AS a, n FROM embeddings JOIN n USING (vec_id)),
p AS (SELECT x.vec_id AS a, y.vec_id AS b, {DIST.format(a="x.a", b="y.a")} AS dist, x.n AS n_a, y.n AS n_b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE {DIST.format(a="x.a", b="y.a")} < {SIMILAR})"""
_EXT = lambda k: f"SELECT list_append(c.m, p.b) AS m FROM k{k} c JOIN p ON p.a = c.m[{k}] WHERE " + (" AND ".join(f"EXISTS (SELECT 1 FROM p x WHERE x.a = c.m[{i}] AND x.b = p.b)" for i in range(1, k)) or "true")
_SUB = lambda k: "SELECT DISTINCT list_concat(m[1:i-1], m[i+1:]) AS m FROM k%d, range(1, %d) r(i)" % (k + 1, k + 2)

_LIVE = LIVE.replace("p AS (SELECT derived, evidence AS premise FROM e WHERE relation IN ('inferred_from', 'supports') GROUP BY ALL)", f"""{TOLD},
p AS (SELECT derived, evidence AS premise FROM e WHERE relation IN ('inferred_from', 'supports') UNION SELECT id, try_cast(x AS BIGINT) FROM (SELECT id, unnest(from_json(json_extract(meta, '$.premise_ids'), '["VARCHAR"]')) AS x FROM told) WHERE regexp_full_match(x, '[0-9]{{1,18}}'))""")

ORACLE = {
    "perspectives": f"""WITH {M} SELECT v.id AS memory_id, v.author, memory_type, status, project, v.created_at, a.canonical_name AS observer, b.canonical_name AS observed
FROM vis v JOIN mem_entities a ON a.id = observer_entity_id JOIN mem_entities b ON b.id = observed_entity_id ORDER BY v.created_at DESC, v.id DESC LIMIT 200""",
    "perspective_filter": f"WITH {M} SELECT id FROM vis WHERE observer_entity_id IN (SELECT id FROM mem_entities WHERE lower(canonical_name) = 'e3')",
    "perspective_routes": f"""WITH {M}, h AS (SELECT *, row_number() OVER (ORDER BY importance DESC NULLS LAST, created_at DESC, id DESC) AS rank FROM act),
g AS (SELECT observer_entity_id, observed_entity_id, min(rank) AS first_rank, count(*) AS hits, list(id ORDER BY rank)[1:8] AS ids FROM h WHERE rank <= 40 GROUP BY 1, 2)
SELECT * FROM g ORDER BY first_rank LIMIT 3""",
    "evidence_edges": f"WITH {M} SELECT id, derived, evidence, relation FROM e WHERE derived IN (SELECT id FROM vis) AND evidence IN (SELECT id FROM vis) ORDER BY created_at, id LIMIT 200",
    "evidence_walk": f"""WITH RECURSIVE {M}, w AS (SELECT evidence AS node, derived AS root, derived AS target, relation, 1 AS depth, [derived, evidence] AS path FROM e
 UNION ALL SELECT e.evidence, w.root, e.derived, e.relation, w.depth + 1, list_append(w.path, e.evidence) FROM w JOIN e ON e.derived = w.node WHERE w.depth < 8 AND w.relation <> 'contradicts' AND NOT list_contains(w.path, e.evidence)),
g AS (SELECT node, min(depth) AS depth, count(DISTINCT root) FILTER (WHERE relation <> 'contradicts') AS n_roots, count(DISTINCT path) FILTER (WHERE relation <> 'contradicts') AS n_paths,
 coalesce(list_sort(list(DISTINCT target) FILTER (WHERE relation = 'contradicts')), []) AS contradicts FROM w GROUP BY 1)
SELECT node AS memory_id, CAST(depth AS INTEGER) AS depth, CAST(n_roots AS INTEGER) AS n_roots, n_paths, contradicts FROM g WHERE node IN (SELECT id FROM act WHERE kind IS DISTINCT FROM 'page')""",
    "premises_live": f"WITH {M}, {_LIVE} SELECT derived, live FROM live",
    "stale_derived": f"WITH {M}, {_LIVE} SELECT id FROM vis JOIN live ON derived = id WHERE reasoning_level IN ('deductive', 'inductive') AND NOT live",
    "cycle_check": """WITH RECURSIVE r AS (SELECT DISTINCT src_component_id AS s, dst_component_id AS d FROM relationships), t AS (SELECT s, d FROM r UNION SELECT t.s, r.d FROM t JOIN r ON r.s = t.d),
c AS (SELECT DISTINCT s AS n FROM t WHERE s = d) SELECT DISTINCT d AS component_id FROM t WHERE s IN (SELECT n FROM c)""",
    "cycle_guard": """WITH RECURSIVE e AS (SELECT DISTINCT id, evidence_memory_id AS f, derived_memory_id AS t FROM mem_derivations),
n AS (SELECT DISTINCT t AS evidence, f AS derived FROM e UNION SELECT f, t FROM e),
r AS (SELECT evidence, derived, derived AS spot FROM n UNION SELECT r.evidence, r.derived, e.t FROM r JOIN e ON e.f = r.spot)
SELECT evidence, derived, bool_or(spot = evidence) AS closes FROM r GROUP BY 1, 2""",
    "similar_pairs": f"WITH {_C} SELECT a AS vec_a, b AS vec_b, round(dist, 6) AS dist, n_a, n_b FROM p",
    "similar_members": f"""WITH {_C}, o AS (SELECT a AS vec_id, n_b AS n FROM p UNION ALL SELECT b, n_a FROM p), s AS (SELECT vec_id, sum(n) AS near FROM o GROUP BY 1)
SELECT id, c.vec_id, CAST(coalesce(near, 0) + n - 1 AS BIGINT) AS links FROM c JOIN n USING (vec_id) LEFT JOIN s USING (vec_id)""",
    "clique_groups": f"""WITH {_C}, k2 AS (SELECT [a, b] AS m FROM p), k3 AS ({_EXT(2)}), k4 AS ({_EXT(3)}), k5 AS ({_EXT(4)}), k6 AS ({_EXT(5)}), k7 AS ({_EXT(6)}),
g AS (SELECT m FROM k2 WHERE m NOT IN ({_SUB(2)}) UNION ALL SELECT m FROM k3 WHERE m NOT IN ({_SUB(3)}) UNION ALL SELECT m FROM k4 WHERE m NOT IN ({_SUB(4)}) UNION ALL SELECT m FROM k5 WHERE m NOT IN ({_SUB(5)}) UNION ALL SELECT m FROM k6 WHERE m NOT IN ({_SUB(6)}))
SELECT array_to_string(m, ',') AS members, CAST(len(m) AS INTEGER) AS size, round(avg(round(dist, 3)), 6) AS mean_distance FROM g JOIN p ON list_contains(m, a) AND list_contains(m, b) GROUP BY m""",
}
