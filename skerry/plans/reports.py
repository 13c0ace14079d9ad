"""Reports, audits and context assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.operators import context as C
from skerry.operators import evidence as E
from skerry.operators import views as V
from skerry.plans.memory import LIVE, M, NOW, PROJECTS, READER, edges, mem_search, stale
from skerry.plans.memory import ORACLE as _MEMORY
from skerry.sources.durable import durable
from skerry.sources.tables import table


def _act(spark, d):
    return V.active(V.memories(spark, d), READER, PROJECTS, NOW)


def mem_stats(spark, d):
    """(section, key, n): totals, by type, by project (none stays none), pages, stale rows, components by scope."""
    act = _act(spark, d)
    row = lambda df, s, k: df.select(F.lit(s).alias("section"), (F.col(k).cast("string") if k else F.lit(None).cast("string")).alias("key"), "n")
    count = lambda df: df.agg(F.count("*").alias("n"))
    parts = [
        row(count(V.memories(spark, d)), "total", None), row(count(act), "active", None), row(act.groupBy("memory_type").agg(F.count("*").alias("n")), "type", "memory_type"),
        row(act.groupBy("project").agg(F.count("*").alias("n")), "project", "project"), row(count(act.where("kind = 'page'")), "pages", None), row(count(stale(act)), "stale", None),
        row(table(spark, d, "components").dropDuplicates(["id"]).groupBy("repo").agg(F.count("*").alias("n")), "components", "repo"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def health(spark, d):
    """Severity of a few figures of the store."""
    s = mem_stats(spark, d).groupBy("section").agg(F.sum("n").alias("n")).where("section IN ('active', 'stale', 'pages')")
    n = s.agg(F.max(F.when(F.col("section") == "active", F.col("n"))).alias("a"), F.max(F.when(F.col("section") == "stale", F.col("n"))).alias("s"), F.max(F.when(F.col("section") == "pages", F.col("n"))).alias("p"))
    level = lambda x, warn, bad: F.when(x >= bad, "error").when(x >= warn, "warn").otherwise("ok")
    return n.select(F.explode(F.array(F.struct(F.lit("stale share").alias("what"), level(F.col("s") / F.col("a"), 0.2, 0.5).alias("severity")), F.struct(F.lit("pages").alias("what"), level(F.col("p") / F.col("a"), 0.1, 0.3).alias("severity")))).alias("r")).select("r.what", "r.severity")


def scope_near_match(spark, d):
    """Document scopes and map scopes that differ only in case or dashes; those without any partner."""
    key = lambda c: F.regexp_replace(F.lower(c), "[-_ ]", "")
    a = table(spark, d, "documents").select(F.col("source").alias("doc_scope")).distinct()
    b = table(spark, d, "components").select(F.when(F.col("id") % 2 == 0, F.upper("repo")).otherwise(F.col("repo")).alias("map_scope")).distinct()
    j = a.join(b, key(a.doc_scope) == key(b.map_scope), "left")
    return j.select("doc_scope", "map_scope", F.when(F.col("map_scope").isNull(), "unmapped").when(F.col("map_scope") == F.col("doc_scope"), "same").otherwise("near").alias("state"))


def latency_stats(spark, d):
    """Median, nearest-rank p90 and maximum of each stage, the first run left out. Exact ranks, not sketches."""
    e = table(spark, d, "events").select("event_type", "value", "event_id")
    first = e.groupBy("event_type").agg(F.min("event_id").alias("first"))
    # ranks over the distinct values of a stage with their counts: repeats are counted before anything is sorted
    v = e.join(first, "event_type").where("event_id <> first AND value IS NOT NULL").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy("event_type")
    r = v.withColumn("upto", F.sum("c").over(w.orderBy("value"))).withColumn("n", F.sum("c").over(w))
    at = lambda i: F.min(F.when(F.col("upto") >= i, F.col("value")))
    lo, hi = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    return r.groupBy("event_type").agg(F.max("n").alias("n"), ((at(lo) + at(hi)) / 2).alias("median"), at(F.ceil(F.col("n") * 9 / 10)).alias("p90"), F.max("value").alias("max"))


def source_mix(spark, d):
    """Sources by type, with sessions, late ones (older than their memory) and channels in one case."""
    s = table(spark, d, "mem_sources").dropDuplicates(["id"])
    m = V.memories(spark, d).select(F.col("id").alias("memory_id"), F.col("created_at").alias("born"))
    return s.join(m, "memory_id", "left").groupBy("source_type").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"), F.count_if(F.col("created_at") < F.col("born")).alias("early"), F.count_distinct(F.lower("channel")).alias("channels"))


SESSION, DEPTH = "sess-nightly-import", "max"


def context_sections(spark, d):
    """The tagged frames a context is made of at its greatest depth: global, relevant, project, session, derived, and the
    evidence of what is derived; each in its own order, as long as the depth allows."""
    limit, derived, hops = C.DEPTHS[DEPTH]
    act = _act(spark, d).where(V.not_page())
    order = [F.col("importance").desc_nulls_last(), F.col("created_at").desc(), F.col("id").desc()]
    explicit = F.coalesce("reasoning_level", F.lit("explicit")) == "explicit"
    live = E.premises_live(edges(spark, d), V.memories(spark, d), READER, PROJECTS, NOW).where("live").select(F.col("derived").alias("id"))

    def part(no, name, rows, by, n=limit):
        rows = rows.orderBy(*by).limit(n)
        return rows.select(F.lit(READER).alias("reader"), F.lit(name).alias("section"), F.lit(no).alias("section_no"), F.row_number().over(Window.orderBy(*by)).alias("pos"), "id", "content")

    found = mem_search(spark, d)
    ranked = [F.col("score").desc(), F.col("lift").desc(), *order]
    recent = F.round(F.coalesce("importance", F.lit(0.0)) + (F.col("created_at") > V.at(NOW) - F.expr("INTERVAL 30 DAYS")).cast("int"), 9)
    relevant = act.join(found.select("id", "score"), "id").withColumn("lift", recent)
    said = table(spark, d, "mem_sources").where(F.col("session_id") == SESSION).select(F.col("memory_id").alias("id"))
    conclusions = act.where(~explicit).join(live, "id", "left_semi")
    out = part(0, "global", act.where(explicit & F.col("project").isNull()), order).unionByName(part(1, "relevant", relevant, ranked))
    out = out.unionByName(part(2, "project", act.where(explicit & (F.col("project") == "p1")), order)).unionByName(part(3, "session", act.where(explicit).join(said, "id", "left_semi"), order))
    if derived:
        top = durable(part(4, "derived", conclusions, order), "derived")
        out = out.unionByName(top)
        if hops:
            paths = E.walk(edges(spark, d), top.select(F.col("id").alias("root")), hops)
            near = paths.groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("depth"))
            out = out.unionByName(part(5, "evidence", act.join(near, "id"), [F.col("depth").asc(), F.col("id").asc()], 80))
    return out


def context_pack(spark, d):
    return C.pack(context_sections(spark, d), depth=DEPTH)


def depth_evaluation(spark, d):
    """Overlap of what one depth recalls with what the sources cite, by memory: yield and Jaccard index."""
    e = table(spark, d, "mem_derivations").dropDuplicates(["id"])
    cited = e.where("relation <> 'contradicts'").groupBy(F.col("derived_memory_id").alias("id")).agg(F.collect_set("evidence_memory_id").alias("cited"))
    got = e.where("relation IN ('inferred_from', 'supports', 'contradicts')").groupBy(F.col("derived_memory_id").alias("id")).agg(F.collect_set("evidence_memory_id").alias("got"))
    j = cited.join(got, "id")
    both, either = F.size(F.array_intersect("cited", "got")), F.size(F.array_union("cited", "got"))
    return j.select("id", F.round(both / F.size("cited"), 6).alias("citation_yield"), F.round(both / either, 6).alias("overlap"), F.size(F.array_except("got", "cited")).alias("extra"))


QUERIES = {f.__name__: f for f in (mem_stats, health, scope_near_match, latency_stats, source_mix, context_sections, context_pack, depth_evaluation)}

_OLD = f"TIMESTAMP '{NOW}' - INTERVAL 180 DAYS"
_STATS = f"""SELECT 'total' AS section, CAST(NULL AS VARCHAR) AS key, count(*) AS n FROM m UNION ALL SELECT 'active', NULL, count(*) FROM act UNION ALL SELECT 'type', memory_type, count(*) FROM act GROUP BY 2 UNION ALL SELECT 'project', project, count(*) FROM act GROUP BY 2
UNION ALL SELECT 'pages', NULL, count(*) FROM act WHERE kind = 'page' UNION ALL SELECT 'stale', NULL, count(*) FROM act WHERE created_at < {_OLD} AND memory_type IN ('semantic', 'episodic', 'prospective') AND kind IS DISTINCT FROM 'page' AND (last_accessed_at IS NULL OR last_accessed_at < {_OLD})
UNION ALL SELECT 'components', repo, count(DISTINCT id) FROM components GROUP BY 2"""
_EX = "coalesce(reasoning_level, 'explicit') = 'explicit'"
_ORD = "importance DESC NULLS LAST, created_at DESC, id DESC"

ORACLE = {
    "mem_stats": f"WITH {M} {_STATS}",
    "health": f"""WITH {M}, s AS ({_STATS}), n AS (SELECT sum(n) FILTER (WHERE section = 'active') AS a, sum(n) FILTER (WHERE section = 'stale') AS s, sum(n) FILTER (WHERE section = 'pages') AS p FROM s)
SELECT 'stale share' AS what, CASE WHEN s / a >= 0.5 THEN 'error' WHEN s / a >= 0.2 THEN 'warn' ELSE 'ok' END AS severity FROM n UNION ALL SELECT 'pages', CASE WHEN p / a >= 0.3 THEN 'error' WHEN p / a >= 0.1 THEN 'warn' ELSE 'ok' END FROM n""",
    "scope_near_match": """WITH a AS (SELECT DISTINCT source AS doc_scope FROM documents), b AS (SELECT DISTINCT CASE WHEN id % 2 = 0 THEN upper(repo) ELSE repo END AS map_scope FROM components)
SELECT doc_scope, map_scope, CASE WHEN map_scope IS NULL THEN 'unmapped' WHEN map_scope = doc_scope THEN 'same' ELSE 'near' END AS state FROM a LEFT JOIN b ON regexp_replace(lower(doc_scope), '[-_ ]', '', 'g') = regexp_replace(lower(map_scope), '[-_ ]', '', 'g')""",
    "latency_stats": """WITH f AS (SELECT event_type, min(event_id) AS first FROM events GROUP BY 1), e AS (SELECT event_type, value FROM events JOIN f USING (event_type) WHERE event_id <> first), l AS (SELECT event_type, list(value ORDER BY value) AS v FROM e GROUP BY 1)
SELECT event_type, CAST(len(v) AS BIGINT) AS n, (v[CAST(floor((len(v) + 1) / 2) AS BIGINT)] + v[CAST(floor(len(v) / 2) AS BIGINT) + 1]) / 2 AS median, v[CAST(ceil(len(v) * 9 / 10) AS BIGINT)] AS p90, v[len(v)] AS max FROM l""",
    "source_mix": f"""WITH {M}, s AS (SELECT DISTINCT * FROM mem_sources) SELECT source_type, count(*) AS n, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE s.created_at < m.created_at) AS early, count(DISTINCT lower(channel)) AS channels FROM s LEFT JOIN m ON m.id = s.memory_id GROUP BY 1""",
    "context_sections": f"""WITH RECURSIVE {M}, {LIVE}, a AS (SELECT * FROM act WHERE kind IS DISTINCT FROM 'page'),
found AS (SELECT id, score FROM ({_MEMORY['mem_search']})),
g AS (SELECT 'global' AS section, 0 AS section_no, row_number() OVER (ORDER BY {_ORD}) AS pos, id, content FROM a WHERE {_EX} AND project IS NULL),
r AS (SELECT 'relevant' AS section, 1 AS section_no, row_number() OVER (ORDER BY score DESC, round(coalesce(importance, 0) + CASE WHEN created_at > TIMESTAMP '{NOW}' - INTERVAL 30 DAYS THEN 1 ELSE 0 END, 9) DESC, {_ORD}) AS pos, id, content FROM a JOIN found USING (id)),
p1 AS (SELECT 'project' AS section, 2 AS section_no, row_number() OVER (ORDER BY {_ORD}) AS pos, id, content FROM a WHERE {_EX} AND project = 'p1'),
s AS (SELECT 'session' AS section, 3 AS section_no, row_number() OVER (ORDER BY {_ORD}) AS pos, id, content FROM a WHERE {_EX} AND id IN (SELECT memory_id FROM mem_sources WHERE session_id = '{SESSION}')),
v AS (SELECT 'derived' AS section, 4 AS section_no, row_number() OVER (ORDER BY {_ORD}) AS pos, id, content FROM a WHERE NOT {_EX} AND id IN (SELECT derived FROM live WHERE live)),
w AS (SELECT e.evidence AS node, e.relation, 1 AS depth FROM e JOIN v ON v.id = e.derived WHERE v.pos <= 40 UNION SELECT e.evidence, e.relation, w.depth + 1 FROM w JOIN e ON e.derived = w.node WHERE w.depth < 8 AND w.relation <> 'contradicts'),
n AS (SELECT node AS id, min(depth) AS depth FROM w GROUP BY 1),
ev AS (SELECT 'evidence' AS section, 5 AS section_no, row_number() OVER (ORDER BY depth, id) AS pos, id, content FROM a JOIN n USING (id))
SELECT '{READER}' AS reader, * FROM (SELECT * FROM g WHERE pos <= 40 UNION ALL SELECT * FROM r WHERE pos <= 40 UNION ALL SELECT * FROM p1 WHERE pos <= 40 UNION ALL SELECT * FROM s WHERE pos <= 40 UNION ALL SELECT * FROM v WHERE pos <= 40 UNION ALL SELECT * FROM ev WHERE pos <= 80)""",
    "depth_evaluation": """WITH e AS (SELECT DISTINCT derived_memory_id AS id, evidence_memory_id AS v, relation FROM mem_derivations), c AS (SELECT id, list(DISTINCT v) AS c FROM e WHERE relation <> 'contradicts' GROUP BY 1), g AS (SELECT id, list(DISTINCT v) AS g FROM e WHERE relation IN ('inferred_from', 'supports', 'contradicts') GROUP BY 1)
SELECT id, round(len(list_intersect(c, g)) / len(c), 6) AS citation_yield, round(len(list_intersect(c, g)) / len(list_distinct(list_concat(c, g))), 6) AS overlap, CAST(len(g) - len(list_intersect(c, g)) AS INTEGER) AS extra FROM c JOIN g USING (id)""",
}
