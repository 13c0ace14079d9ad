"""Queries over the memory store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.functions import text as X
from skerry.operators import evidence as E
from skerry.operators import search as S
from skerry.operators import views as V
from skerry.sources.tables import table

NOW, READER, PROJECTS, PROJECT = "2024-06-01 00:00:00", "u1", ["p1", "p2"], "p1"
TERMS = ["migration", "snapshot", "limit", "pillar"]
#: Farthest a semantic hit may be, and a hit by words alone.
MAXDIST, LEXDIST = 0.75, 0.85


def edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "mem_derivations").dropDuplicates(["id"])
    return e.select("id", "author", F.col("derived_memory_id").alias("derived"), F.col("evidence_memory_id").alias("evidence"), "relation", "created_at")


def _all(spark, d):
    return V.memories(spark, d)


def _act(spark, d):
    return V.active(_all(spark, d), READER, PROJECTS, NOW)


def mem_active(spark, d):
    return _act(spark, d).select("id", "memory_type", "project")


def mem_all_visible(spark, d):
    return V.visible(_all(spark, d), READER, PROJECTS).groupBy("status", "scope").agg(F.count("*").alias("n"))


def search_memories(pool: DataFrame, embeddings: DataFrame, query, live: DataFrame, terms, k: int, maxdist: float = MAXDIST, lexdist: float = LEXDIST) -> DataFrame:
    """Fused search with abstention: a semantic hit must be near enough, a lexical one at least plausible, a derived one
    must stand on live premises. Equal scores fall to importance and recency taken together (a row of the last thirty days
    counts as much as full importance), then importance, age and id."""
    dist = S.distances(embeddings, query)
    sem = S.semantic_leg(pool, dist, ["id"], S.MEMORY_LEG, maxdist, strict=True)
    lex = S.lexical_leg(pool, F.concat_ws(" ", "title", "content"), terms, ["id"], S.MEMORY_LEG)
    hits = S.fuse(sem, lex, ["id"]).join(pool.select("id", "vec_id", "importance", "created_at", "reasoning_level"), "id").join(dist, "vec_id", "left")
    hits = hits.where("srank IS NOT NULL OR vec_id IS NULL OR dist < %s" % lexdist)
    explicit = F.coalesce("reasoning_level", F.lit("explicit")) == "explicit"
    ok = hits.join(live.where("live").select(F.col("derived").alias("id"), F.lit(True).alias("live")), "id", "left").where(explicit | F.coalesce("live", F.lit(False)))
    recent = F.col("created_at") > V.at(NOW) - F.expr("INTERVAL 30 DAYS")
    lift = F.round(F.coalesce("importance", F.lit(0.0)) + recent.cast("int"), 9)
    order = [F.col("score").desc(), lift.desc(), F.col("importance").desc_nulls_last(), F.col("created_at").desc(), F.col("id").desc()]
    return ok.orderBy(*order).limit(k).select("id", "srank", "lrank", "score", F.coalesce("reasoning_level", F.lit("explicit")).alias("reasoning_level"))


def _vector(spark, d, vec_id: int):
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def mem_search(spark, d):
    pool = _act(spark, d).where(V.of_project(PROJECT))
    live = E.premises_live(edges(spark, d), _all(spark, d), READER, PROJECTS, NOW)
    return search_memories(pool, table(spark, d, "embeddings"), _vector(spark, d, 3), live, TERMS, 20)


def told(spark, d):
    """Memories, some of which say more of themselves in their metadata: closed retirements, premises, a successor, what they
    were merged from; each with something malformed beside it."""
    k = F.col("id")
    of = lambda *steps: F.concat(*(x for s in steps for x in (F.lit('"'), (k + s).cast("string"), F.lit('", '))), F.lit('"none"'))
    more = (
        F.when(k % 50 == 1, '{"retired_intervals": [{"retired_at": "2023-11-01T00:00:00", "reactivated_at": "2023-12-15T00:00:00"}, {"retired_at": "long ago"}]}')
        .when(k % 50 == 2, F.concat(F.lit('{"premise_ids": ['), of(-1, -7), F.lit("]}")))
        .when(k % 50 == 3, F.concat(F.lit('{"superseded_by": "'), F.when(k % 100 == 3, F.lit("none")).otherwise((k + 1).cast("string")), F.lit('"}')))
        .when(k % 50 == 4, F.concat(F.lit('{"merged_from": ['), of(-1, -2), F.lit("]}")))
    )
    return _all(spark, d).withColumn("metadata", F.coalesce(more, F.col("metadata")))


def mem_as_of(spark, d):
    """What was believed at an instant, whatever its status is today; instants inside a closed retirement do not count."""
    t = "2023-12-01 00:00:00"
    m = V.visible(told(spark, d), READER, PROJECTS)
    spans = F.from_json(F.get_json_object("metadata", "$.retired_intervals"), "array<struct<retired_at:string,reactivated_at:string>>")
    when = lambda c: c.try_cast("timestamp_ntz")
    gap = F.exists(spans, lambda s: F.coalesce((when(s["retired_at"]) <= V.at(t)) & (when(s["reactivated_at"]) > V.at(t)), F.lit(False)))
    held = (F.col("created_at") <= V.at(t)) & (F.col("retired_at").isNull() | (F.col("retired_at") > V.at(t))) & ~F.coalesce(gap, F.lit(False))
    return m.where(held).select("id", "status")


def mem_nearest(spark, d):
    """For every memory whose id is divisible by 100: the nearest active one of the reader by vector (itself, where it is active), and how many share that vector."""
    act = _act(spark, d).where(V.not_page() & F.col("vec_id").isNotNull())
    classes = act.groupBy("vec_id").agg(F.min_by("id", "id").alias("first_id"), F.count("*").alias("members"))
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = _all(spark, d).where("id % 100 = 0 AND vec_id IS NOT NULL").select(F.col("id").alias("query_id"), F.col("vec_id").alias("q"))
    from skerry.operators.vectors import nearest_classes

    near = nearest_classes(e, q.select("q").distinct(), classes.select("vec_id"), 1)
    return q.join(near, "q").join(classes, "vec_id").select("query_id", F.col("first_id").alias("nearest_id"), "dist", "members")


def mem_timeline(spark, d):
    """Three rows before and after each anchor (every id divisible by 100) in the reader's history."""
    m = V.visible(_all(spark, d), READER, PROJECTS)
    w = Window.partitionBy("author").orderBy("created_at", "id")
    r = m.select("id", "author", "created_at").withColumn("n", F.row_number().over(w))
    a = r.where("id % 100 = 0").select(F.col("id").alias("anchor"), F.col("author").alias("a"), F.col("n").alias("at"))
    near = a.select("anchor", "a", F.explode(F.sequence(F.col("at") - 3, F.col("at") + 3)).alias("k"), "at")
    return near.join(r, (near.a == r.author) & (near.k == r.n)).select("anchor", "id", (F.col("k") - F.col("at")).cast("int").alias("step"))


def mem_page(spark, d):
    """Keyset pagination: the 25 rows after a (created_at, id) cursor, newest first."""
    m = V.visible(_all(spark, d), READER, PROJECTS)
    cursor = F.struct(V.at("2023-10-01 00:00:00").alias("created_at"), F.lit(10**9).cast("long").alias("id"))
    return m.where(F.struct("created_at", "id") < cursor).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(25).select("id", "created_at")


def stale(act: DataFrame, days: int = 180) -> DataFrame:
    old = V.at(NOW) - F.expr(f"INTERVAL {days} DAYS")
    return act.where((F.col("created_at") < old) & F.col("memory_type").isin("semantic", "episodic", "prospective") & V.not_page() & (F.col("last_accessed_at").isNull() | (F.col("last_accessed_at") < old)))


def mem_stale(spark, d):
    age = F.floor((F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))) / 86400).cast("long")
    return stale(_act(spark, d)).select("id", age.alias("age_days"))


def mem_profile(spark, d):
    """The head of a session: preferences, facts and plans, each the first few of a total order."""
    act = _act(spark, d).where(V.not_page() & (F.coalesce("reasoning_level", F.lit("explicit")) == "explicit"))
    order = [F.col("importance").desc_nulls_last(), F.col("created_at").desc(), F.col("id").desc()]

    def head(tag, cond, n):
        return act.where(cond).orderBy(*order).limit(n).select(F.lit(tag).alias("section"), "id", X.one_line(F.col("content"), 220).alias("line"))

    facts = F.col("memory_type").isin("semantic", "procedural") & (F.col("importance") >= 0.6)
    return head("PREF", F.col("memory_type") == "preference", 10).unionByName(head("FACT", facts, 10)).unionByName(head("PLAN", F.col("memory_type") == "prospective", 5))


def mem_provenance(spark, d):
    """The first three sources of each visible memory."""
    src = table(spark, d, "mem_sources").dropDuplicates(["id"])
    w = Window.partitionBy("memory_id").orderBy("id")
    top = src.select("id", "memory_id", "source_type").withColumn("n", F.row_number().over(w)).where("n <= 3")
    return top.join(V.visible(_all(spark, d), READER, PROJECTS).select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select("memory_id", F.col("id").alias("source_id"), "source_type", "n")


def reflect_targets(spark, d):
    return _act(spark, d).where(V.not_page() & F.col("project").isNotNull()).groupBy("project").agg(F.count("*").alias("n")).where("n >= 5")


def reflect_group(spark, d):
    """Of each project the first 80 shared memories that a page may be written from."""
    w = Window.partitionBy("project").orderBy(F.col("importance").desc_nulls_last(), F.col("created_at").desc(), F.col("id").desc())
    rows = _act(spark, d).where(V.not_page() & (F.col("scope") == "project") & F.col("project").isNotNull())
    return rows.withColumn("n", F.row_number().over(w)).where("n <= 80").select("project", "n", "id", "memory_type", "importance")


def dream_inputs(spark, d):
    """The newest 24 explicit memories of each perspective that has at least three."""
    act = _act(spark, d).where(V.not_page() & (F.coalesce("reasoning_level", F.lit("explicit")) == "explicit"))
    w = Window.partitionBy("observer_entity_id", "observed_entity_id")
    order = w.orderBy(F.col("created_at").desc(), F.col("importance").desc_nulls_last(), F.col("id").desc())
    r = act.select("id", "observer_entity_id", "observed_entity_id", "created_at", "importance").withColumn("n", F.row_number().over(order)).where("n <= 24")
    return r.withColumn("size", F.count("*").over(w)).where("size >= 3").select("observer_entity_id", "observed_entity_id", "n", "id")


def project_key(c):
    return F.regexp_replace(F.lower(c), "[-_ ]", "")


def project_canon(spark, d):
    """Every spelling with the spelling in use: the map's scope of that key, else the most frequent one, ties by name."""
    m = _all(spark, d).where("project IS NOT NULL").select(F.when(F.col("id") % 3 == 0, F.upper("project")).when(F.col("id") % 3 == 1, F.concat(F.left("project", F.lit(1)), F.lit("-"), F.substring("project", 2, 20))).otherwise(F.col("project")).alias("project"))
    n = m.groupBy("project").agg(F.count("*").alias("n")).withColumn("key", project_key(F.col("project")))
    repos = table(spark, d, "components").select("repo").distinct().groupBy(project_key(F.col("repo")).alias("key")).agg(F.min("repo").alias("repo"))
    w = Window.partitionBy("key").orderBy(F.col("n").desc(), "project")
    return n.withColumn("first", F.first("project").over(w)).join(repos, "key", "left").select("project", F.coalesce("repo", "first").alias("canonical"), "n")


def peer_cards(spark, d):
    """Per author and peer: counts, types, projects, the twelve latest ids, first and last seen."""
    m = _all(spark, d).where("status = 'active'").select("id", "author", "memory_type", "project", "created_at", "observer_entity_id", "observed_entity_id")
    ends = m.withColumn("peer", F.explode(F.array_distinct(F.array("observer_entity_id", "observed_entity_id")))).where("peer IS NOT NULL")
    w = Window.partitionBy("author", "peer").orderBy(F.col("created_at").desc(), F.col("id").desc())
    types = ends.groupBy("author", "peer", "memory_type").agg(F.count("*").alias("n")).groupBy("author", "peer").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "memory_type", F.col("n").cast("string")))), ",").alias("memory_types"))
    # the twelve latest by a window that keeps no more, the counts without one
    latest = ends.select("author", "peer", "id", "created_at").withColumn("k", F.row_number().over(w)).where("k <= 12")
    latest = latest.groupBy("author", "peer").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "id"))), lambda s: s["id"]).alias("recent_memory_ids"))
    main = ends.groupBy("author", "peer").agg(
        F.count("*").alias("active_count"), F.count_if(F.col("observer_entity_id") == F.col("peer")).alias("observer_count"), F.count_if(F.col("observed_entity_id") == F.col("peer")).alias("observed_count"),
        F.sort_array(F.collect_set("project")).alias("projects"),
        F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"),
    )
    return main.join(types, ["author", "peer"]).join(latest, ["author", "peer"])


def alias_match(spark, d):
    """Entities named by one of some spellings, in their name or an alias, whatever the case."""
    wanted = [f"e{i}" for i in range(1, 12)] + ["u1"]
    e = table(spark, d, "mem_entities")
    hit = F.lower("canonical_name").isin(wanted) | F.exists(F.coalesce("aliases", F.array()), lambda a: F.coalesce(F.lower(a).isin(wanted), F.lit(False)))
    return e.where(hit).select("id", "canonical_name").distinct()


QUERIES = {f.__name__: f for f in (mem_active, mem_all_visible, mem_search, mem_as_of, mem_nearest, mem_timeline, mem_page, mem_stale, mem_profile, mem_provenance, reflect_targets, reflect_group, dream_inputs, project_canon, peer_cards, alias_match)}

MAY = "(author = 'u1' OR (scope = 'project' AND project IN ('p1', 'p2')))"
WIN = f"(valid_from IS NULL OR valid_from <= TIMESTAMP '{NOW}') AND (valid_to IS NULL OR valid_to > TIMESTAMP '{NOW}')"
M = f"""m AS (SELECT DISTINCT * FROM mem_memories),
vis AS (SELECT * FROM m WHERE {MAY}),
act AS (SELECT * FROM vis WHERE status = 'active' AND {WIN}),
e AS (SELECT DISTINCT id, author, derived_memory_id AS derived, evidence_memory_id AS evidence, relation, created_at FROM mem_derivations)"""
#: told: the metadata planted by the query of that name, as JSON; null where it is broken or no object.
TOLD = """told AS (SELECT id, author, created_at, status, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS meta FROM (SELECT *, CASE id % 50
 WHEN 1 THEN '{"retired_intervals": [{"retired_at": "2023-11-01T00:00:00", "reactivated_at": "2023-12-15T00:00:00"}, {"retired_at": "long ago"}]}'
 WHEN 2 THEN '{"premise_ids": ["' || (id - 1) || '", "' || (id - 7) || '", "none"]}' WHEN 3 THEN '{"superseded_by": "' || (CASE WHEN id % 100 = 3 THEN 'none' ELSE CAST(id + 1 AS VARCHAR) END) || '"}'
 WHEN 4 THEN '{"merged_from": ["' || (id - 1) || '", "' || (id - 2) || '", "none"]}' ELSE metadata END AS t FROM m))"""
LIVE = f"""p AS (SELECT derived, evidence AS premise FROM e WHERE relation IN ('inferred_from', 'supports') GROUP BY ALL),
live AS (SELECT v.id AS derived, coalesce(bool_and(a.id IS NOT NULL) FILTER (WHERE p.premise IS NOT NULL), false) AS live FROM vis v LEFT JOIN p ON p.derived = v.id LEFT JOIN act a ON a.id = p.premise GROUP BY v.id)"""
DIST = "round(1 - list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})), 9)"
_EXPL = "coalesce(reasoning_level, 'explicit') = 'explicit'"
_LINE = "CASE WHEN length(regexp_replace(content, '\\s+', ' ', 'g')) > 220 THEN left(regexp_replace(content, '\\s+', ' ', 'g'), 220) || ' ...[cut]' ELSE regexp_replace(content, '\\s+', ' ', 'g') END"
_OLD = f"TIMESTAMP '{NOW}' - INTERVAL 180 DAYS"

ORACLE = {
    "mem_active": f"WITH {M} SELECT id, memory_type, project FROM act",
    "mem_all_visible": f"WITH {M} SELECT status, scope, count(*) AS n FROM vis GROUP BY 1, 2",
    "mem_search": f"""WITH {M}, {LIVE},
pool AS (SELECT * FROM act WHERE project = 'p1' OR project IS NULL),
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3),
dist AS (SELECT vec_id, {DIST.format(a="x.a", b="x.v")} AS dist FROM (SELECT vec_id, embedding::DOUBLE[] AS a, v FROM embeddings, q) x),
sem AS (SELECT id, rank() OVER (ORDER BY dist) AS srank FROM (SELECT id, dist FROM pool JOIN dist USING (vec_id) WHERE dist < {MAXDIST} ORDER BY dist, id LIMIT 30)),
tok AS (SELECT id, regexp_extract_all(lower(concat_ws(' ', title, content)), '[\\p{{L}}\\p{{N}}_\\-]+') AS w FROM pool),
lsc AS (SELECT id, round(0.1::DOUBLE * len(list_filter(w, lambda x: x IN ('migration', 'snapshot', 'limit', 'pillar'))) / (1 + ln(len(w)::DOUBLE)), 9) AS lscore FROM tok WHERE len(list_filter(w, lambda x: x IN ('migration', 'snapshot', 'limit', 'pillar'))) > 0),
lex AS (SELECT id, rank() OVER (ORDER BY lscore DESC) AS lrank FROM (SELECT * FROM lsc ORDER BY lscore DESC, id LIMIT 30)),
f AS (SELECT id, srank, lrank, round(coalesce(1::DOUBLE / (60 + srank), 0) + coalesce(1::DOUBLE / (60 + lrank), 0), 9) AS score FROM sem FULL JOIN lex USING (id))
SELECT f.id, srank, lrank, score, coalesce(reasoning_level, 'explicit') AS reasoning_level FROM f JOIN pool USING (id) LEFT JOIN dist USING (vec_id) LEFT JOIN live ON live.derived = f.id
WHERE (srank IS NOT NULL OR pool.vec_id IS NULL OR dist < {LEXDIST}) AND ({_EXPL} OR live.live)
ORDER BY score DESC, round(coalesce(importance, 0) + CASE WHEN created_at > TIMESTAMP '{NOW}' - INTERVAL 30 DAYS THEN 1 ELSE 0 END, 9) DESC, importance DESC NULLS LAST, created_at DESC, f.id DESC LIMIT 20""",
    "mem_as_of": f"""WITH {M}, {TOLD}, iv AS (SELECT id, unnest(from_json(json_extract(meta, '$.retired_intervals'), '["JSON"]')) AS v FROM told),
gap AS (SELECT DISTINCT id FROM iv WHERE try_cast(json_extract_string(v, '$.retired_at') AS TIMESTAMP) <= TIMESTAMP '2023-12-01' AND try_cast(json_extract_string(v, '$.reactivated_at') AS TIMESTAMP) > TIMESTAMP '2023-12-01')
SELECT id, status FROM vis WHERE created_at <= TIMESTAMP '2023-12-01' AND (retired_at IS NULL OR retired_at > TIMESTAMP '2023-12-01') AND id NOT IN (SELECT id FROM gap)""",
    "mem_nearest": f"""WITH {M}, c AS (SELECT vec_id, min(id) AS first_id, count(*) AS members FROM act WHERE kind IS DISTINCT FROM 'page' AND vec_id IS NOT NULL GROUP BY 1),
q AS (SELECT id AS query_id, vec_id AS q FROM m WHERE id % 100 = 0 AND vec_id IS NOT NULL),
v AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings),
x AS (SELECT qq.q, c.vec_id, {DIST.format(a="va.a", b="vb.a")} AS dist FROM (SELECT DISTINCT q FROM q) qq JOIN v va ON va.vec_id = qq.q CROSS JOIN c JOIN v vb ON vb.vec_id = c.vec_id),
b AS (SELECT q, vec_id, abs(dist) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, vec_id) AS n FROM x) WHERE n = 1)
SELECT query_id, first_id AS nearest_id, dist, members FROM q JOIN b USING (q) JOIN c USING (vec_id)""",
    "mem_timeline": f"""WITH {M}, r AS (SELECT id, author, row_number() OVER (PARTITION BY author ORDER BY created_at, id) AS n FROM vis)
SELECT a.id AS anchor, b.id, CAST(b.n - a.n AS INTEGER) AS step FROM r a JOIN r b ON a.author = b.author AND b.n BETWEEN a.n - 3 AND a.n + 3 WHERE a.id % 100 = 0""",
    "mem_page": f"WITH {M} SELECT id, created_at FROM vis WHERE (created_at, id) < (TIMESTAMP '2023-10-01', 1000000000) ORDER BY created_at DESC, id DESC LIMIT 25",
    "mem_stale": f"WITH {M} SELECT id, CAST(floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(created_at))) / 86400) AS BIGINT) AS age_days FROM act WHERE created_at < {_OLD} AND memory_type IN ('semantic', 'episodic', 'prospective') AND kind IS DISTINCT FROM 'page' AND (last_accessed_at IS NULL OR last_accessed_at < {_OLD})",
    "mem_profile": f"""WITH {M}, a AS (SELECT * FROM act WHERE kind IS DISTINCT FROM 'page' AND {_EXPL}),
p AS (SELECT * FROM a WHERE memory_type = 'preference' ORDER BY importance DESC NULLS LAST, created_at DESC, id DESC LIMIT 10),
f AS (SELECT * FROM a WHERE memory_type IN ('semantic', 'procedural') AND importance >= 0.6 ORDER BY importance DESC NULLS LAST, created_at DESC, id DESC LIMIT 10),
l AS (SELECT * FROM a WHERE memory_type = 'prospective' ORDER BY importance DESC NULLS LAST, created_at DESC, id DESC LIMIT 5)
SELECT 'PREF' AS section, id, {_LINE} AS line FROM p UNION ALL SELECT 'FACT', id, {_LINE} FROM f UNION ALL SELECT 'PLAN', id, {_LINE} FROM l""",
    "mem_provenance": f"""WITH {M}, s AS (SELECT DISTINCT * FROM mem_sources), t AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY id) AS n FROM s)
SELECT memory_id, id AS source_id, source_type, n FROM t WHERE n <= 3 AND memory_id IN (SELECT id FROM vis)""",
    "reflect_targets": f"WITH {M} SELECT project, count(*) AS n FROM act WHERE kind IS DISTINCT FROM 'page' AND project IS NOT NULL GROUP BY 1 HAVING count(*) >= 5",
    "reflect_group": f"""WITH {M}, r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY importance DESC NULLS LAST, created_at DESC, id DESC) AS n FROM act WHERE kind IS DISTINCT FROM 'page' AND scope = 'project' AND project IS NOT NULL)
SELECT project, n, id, memory_type, importance FROM r WHERE n <= 80""",
    "dream_inputs": f"""WITH {M}, r AS (SELECT id, observer_entity_id, observed_entity_id, row_number() OVER (PARTITION BY observer_entity_id, observed_entity_id ORDER BY created_at DESC, importance DESC NULLS LAST, id DESC) AS n FROM act WHERE kind IS DISTINCT FROM 'page' AND {_EXPL}),
c AS (SELECT *, count(*) OVER (PARTITION BY observer_entity_id, observed_entity_id) AS size FROM r WHERE n <= 24)
SELECT observer_entity_id, observed_entity_id, n, id FROM c WHERE size >= 3""",
    "project_canon": f"""WITH {M}, x AS (SELECT CASE WHEN id % 3 = 0 THEN upper(project) WHEN id % 3 = 1 THEN left(project, 1) || '-' || substr(project, 2, 20) ELSE project END AS project FROM m WHERE project IS NOT NULL),
n AS (SELECT project, count(*) AS n, regexp_replace(lower(project), '[-_ ]', '', 'g') AS key FROM x GROUP BY 1),
r AS (SELECT regexp_replace(lower(repo), '[-_ ]', '', 'g') AS key, min(repo) AS repo FROM components GROUP BY 1)
SELECT project, coalesce(repo, first_value(project) OVER (PARTITION BY n.key ORDER BY n DESC, project)) AS canonical, n FROM n LEFT JOIN r ON r.key = n.key""",
    "peer_cards": f"""WITH {M}, x AS (SELECT DISTINCT m.id, m.author, memory_type, project, created_at, observer_entity_id, observed_entity_id, unnest([observer_entity_id, observed_entity_id]) AS peer FROM m WHERE status = 'active'),
y AS (SELECT *, row_number() OVER (PARTITION BY author, peer ORDER BY created_at DESC, id DESC) AS k FROM x WHERE peer IS NOT NULL),
t AS (SELECT author, peer, string_agg(memory_type || '=' || n, ',' ORDER BY memory_type || '=' || n) AS memory_types FROM (SELECT author, peer, memory_type, count(*) AS n FROM y GROUP BY ALL) GROUP BY 1, 2)
SELECT author, peer, count(*) AS active_count, count(*) FILTER (WHERE observer_entity_id = peer) AS observer_count, count(*) FILTER (WHERE observed_entity_id = peer) AS observed_count,
coalesce(list_sort(list(DISTINCT project) FILTER (WHERE project IS NOT NULL)), []) AS projects, list(id ORDER BY k) FILTER (WHERE k <= 12) AS recent_memory_ids, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at, any_value(memory_types) AS memory_types
FROM y JOIN t USING (author, peer) GROUP BY author, peer""",
    "alias_match": """SELECT DISTINCT id, canonical_name FROM mem_entities WHERE lower(canonical_name) IN ('e1','e2','e3','e4','e5','e6','e7','e8','e9','e10','e11','u1')
OR len(list_filter(coalesce(aliases, []), lambda a: lower(a) IN ('e1','e2','e3','e4','e5','e6','e7','e8','e9','e10','e11','u1'))) > 0""",
}
