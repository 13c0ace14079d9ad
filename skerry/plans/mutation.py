"""Queries that compute new states: folds, upserts, backfills, validators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.operators import oplog as O
from skerry.operators import views as V
from skerry.plans.memory import M, MAY, NOW, PROJECTS, READER, TOLD, edges, told
from skerry.sources.tables import table


def supersede_fold(spark, d):
    return O.supersede_fold(V.memories(spark, d))


def mark_fold(spark, d):
    """Marks taken from the event stream: errors and views retire, purchases and sign-ups bring back."""
    e = table(spark, d, "events").where("event_type IN ('error', 'view', 'purchase', 'signup')")
    status = F.when(F.col("event_type") == "error", "retracted").when(F.col("event_type") == "view", "superseded").otherwise("active")
    f = O.mark_fold(e.select(F.col("user_id").alias("id"), "ts", F.col("event_id").alias("seq"), status.alias("status")))
    return f.select("id", "status", "retired_at", F.size("intervals").alias("n_intervals"), F.try_element_at("intervals", F.lit(-1))["retired_at"].alias("last_gap"))


def review_dedupe(spark, d):
    """Of proposals that say the same, whatever case and edge blanks, the first by id."""
    m = V.memories(spark, d).where("reasoning_level IN ('deductive', 'inductive')")
    return m.groupBy(F.md5(F.lower(F.trim("content")).cast("binary")).alias("key")).agg(F.min("id").alias("id"), F.count("*").alias("n"))


def entity_upsert(spark, d):
    """One row an entity key, its aliases merged."""
    e = table(spark, d, "mem_entities").select("namespace", "entity_type", F.lower(F.trim("canonical_name")).alias("name"), "id", F.explode_outer("aliases").alias("alias"))
    clean = F.when(F.trim("alias") != "", F.trim("alias"))
    return e.groupBy("namespace", "entity_type", "name").agg(F.min("id").alias("id"), F.sort_array(F.collect_set(clean)).alias("aliases"))


def retired_backfill(spark, d):
    """When belief ended, for rows that are no longer active but do not say so: replacement, event end, named successor, last update."""
    m = told(spark, d)
    lost = m.withColumn("retired_at", F.when(F.col("id") % 2 == 0, F.col("retired_at"))).where("status <> 'active' AND retired_at IS NULL")
    s = m.select(F.col("supersedes_id").alias("id"), F.col("created_at").alias("at")).where("id IS NOT NULL")
    first = lost.select("id", "created_at").join(s, "id").where("at >= created_at").groupBy("id").agg(F.min("at").alias("replaced"))
    by = F.get_json_object("metadata", "$.superseded_by")
    named = lost.select("id", "created_at", F.when(by.rlike("^[0-9]{1,18}$"), by).cast("long").alias("by")).join(m.select(F.col("id").alias("by"), F.col("created_at").alias("named")), "by").where("named >= created_at").select("id", "named")
    ended = F.when((F.col("valid_to") >= F.col("created_at")) & (F.col("valid_to") <= V.at(NOW)), F.col("valid_to"))
    j = lost.join(first, "id", "left").join(named, "id", "left")
    return j.select("id", F.greatest("created_at", F.coalesce("replaced", ended, "named", F.greatest("updated_at", "created_at"))).alias("retired_at"))


def derivation_backfill(spark, d):
    """Edges that supersede links and merges imply, same author, not yet there."""
    m = told(spark, d)
    own = m.select("id", "author")
    sup = m.where("supersedes_id IS NOT NULL").select(F.col("id").alias("derived"), F.col("supersedes_id").alias("evidence"), "author", F.lit("supersedes").alias("relation"))
    ids = F.from_json(F.get_json_object("metadata", "$.merged_from"), "array<string>")
    merged = m.select(F.col("id").alias("derived"), F.explode(ids).alias("raw"), "author").where("raw RLIKE '^[0-9]{1,18}$'").select("derived", F.col("raw").cast("long").alias("evidence"), "author", F.lit("summarizes").alias("relation"))
    both = sup.unionByName(merged).distinct()
    ok = both.join(own.select(F.col("id").alias("evidence"), F.col("author").alias("a2")), "evidence").where("author = a2 AND evidence <> derived")
    return ok.join(edges(spark, d).select("derived", "evidence", "relation").distinct(), ["derived", "evidence", "relation"], "left_anti").select("derived", "evidence", "relation")


def write_rejects(spark, d):
    """Rows a write would refuse, with the first reason."""
    # some rows are spoilt first, so that every reason has cases
    m = V.memories(spark, d).withColumns({
        "valid_to": F.when(F.col("id") % 40 == 0, F.col("valid_from") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("valid_to")), "content": F.when(F.col("id") % 90 == 0, F.lit("  ")).otherwise(F.col("content")),
        "confidence": F.when(F.col("id") % 70 == 0, F.lit(1.5)).otherwise(F.col("confidence")), "project": F.when(F.col("id") % 60 != 0, F.col("project"))})
    why = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "empty content").when(F.col("valid_to") < F.col("valid_from"), "window ends before it starts").when((F.col("scope") == "project") & F.col("project").isNull(), "project scope without a project").when(
        (F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence out of range")
    return m.select("id", why.alias("reason")).where("reason IS NOT NULL")


def scope_default(spark, d):
    return V.memories(spark, d).withColumn("would_be", V.default_scope()).groupBy("scope", "would_be").agg(F.count("*").alias("n"))


def perspective_sync(spark, d):
    """Missing ends of a perspective: the observer is the author's own peer, the observed the subject, else the observer."""
    m = V.memories(spark, d)
    gone = m.select("id", F.when(F.col("id") % 4 != 0, F.col("observer_entity_id")).alias("obs"), F.when(F.col("id") % 6 != 0, F.col("observed_entity_id")).alias("obd"), "subject_entity_id", F.expr("try_cast(substring(author, 2, 9) AS BIGINT)").alias("self"))
    obs = F.coalesce("obs", "self")
    return gone.select("id", obs.alias("observer_entity_id"), F.coalesce("obd", "subject_entity_id", obs).alias("observed_entity_id"))


def entity_split(spark, d):
    """A copy of each entity for every other author who refers to it."""
    m = V.memories(spark, d)
    refs = m.select("author", F.explode(F.array("subject_entity_id", "observer_entity_id", "observed_entity_id")).alias("id")).where("id IS NOT NULL").distinct()
    e = table(spark, d, "mem_entities").select("id", F.col("author").alias("owner"), "namespace", "entity_type", "canonical_name").dropDuplicates(["id"])
    return refs.join(e, "id").where("author <> owner").select("author", F.col("id").alias("from_id"), "namespace", "entity_type", "canonical_name")


def page_upsert(spark, d):
    """Of each author's pages of a project the newest stands, the ones before are superseded by it."""
    p = V.memories(spark, d).where("kind = 'page' AND project IS NOT NULL AND status = 'active'")
    w = Window.partitionBy("author", "project").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return p.select("id", "author", F.concat("project", F.lit("~mem")).alias("repo"), F.first("id").over(w).alias("current_id"), (F.row_number().over(w) == 1).alias("is_current"))


def apply_merge(spark, d):
    """Merge proposals (the evidence of each summary): refused unless all members are active, explicit and of one author;
    private if one is, of a project only if all agree, importance at most 0.7."""
    m = V.memories(spark, d).select("id", "author", "status", "scope", "project", "reasoning_level", "importance")
    p = edges(spark, d).where("relation IN ('summarizes', 'supports')").select("derived", F.col("evidence").alias("id")).distinct().join(m, "id")
    ok = (F.col("status") == "active") & (F.coalesce("reasoning_level", F.lit("explicit")) == "explicit")
    g = p.groupBy("derived").agg(F.count("*").alias("members"), F.bool_and(ok).alias("sound"), F.count_distinct("author").alias("authors"), F.bool_or(F.col("scope") == "private").alias("private"), F.min("project").alias("lo"), F.max("project").alias("hi"), F.max("importance").alias("imp"))
    return g.select("derived", "members", (F.col("sound") & (F.col("authors") == 1) & (F.col("members") >= 2)).alias("accepted"), F.when(F.col("private"), "private").otherwise("project").alias("scope"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("project"), F.least("imp", F.lit(0.7)).alias("importance"))


def dream_once(spark, d):
    """Input groups that were not dreamt about before, by the fingerprint of their sorted ids."""
    from skerry.plans.memory import dream_inputs

    g = dream_inputs(spark, d).groupBy("observer_entity_id", "observed_entity_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ","), 256).alias("fingerprint"))
    done = g.where("observer_entity_id % 2 = 0").select("fingerprint")
    return g.join(done, "fingerprint", "left_anti").select("observer_entity_id", "observed_entity_id", "fingerprint")


def touch_access(spark, d):
    """Access counts after a log of reads (one a source row), without rewriting the memories on each read."""
    log = table(spark, d, "mem_sources").dropDuplicates(["id"]).groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("n"), F.max("created_at").alias("last"))
    m = V.active(V.memories(spark, d), READER, PROJECTS, NOW)
    return m.join(log, "id").select("id", (F.coalesce("access_count", F.lit(0)) + F.col("n")).alias("access_count"), F.greatest("last_accessed_at", "last").alias("last_accessed_at"))


def candidate_filter(spark, d):
    """Conclusions that may be proposed: known level, sane length, 1 (deductive) or 2 (inductive) to 8 premises all allowed,
    confidence within 0..1, none said twice; the first four of an author."""
    m = V.memories(spark, d).where("reasoning_level IN ('deductive', 'inductive')").select("id", "author", "reasoning_level", "content", "confidence")
    allowed = V.active(V.memories(spark, d), READER, PROJECTS, NOW).select(F.col("id").alias("evidence"), F.lit(1).alias("ok"))
    p = edges(spark, d).where("relation <> 'contradicts'").select("derived", "evidence").distinct().join(allowed, "evidence", "left").groupBy("derived").agg(F.count("*").alias("n"), F.count("ok").alias("k"))
    c = m.join(p, m.id == p.derived).where("n = k AND n <= 8 AND n >= CASE WHEN reasoning_level = 'deductive' THEN 1 ELSE 2 END AND char_length(content) BETWEEN 20 AND 1200 AND confidence BETWEEN 0 AND 1")
    w1 = Window.partitionBy("author", F.md5(F.lower("content").cast("binary"))).orderBy("id")
    w2 = Window.partitionBy("author").orderBy("id")
    return c.withColumn("a", F.row_number().over(w1)).where("a = 1").withColumn("pos", F.row_number().over(w2)).where("pos <= 4").select("author", "id", "pos")


def grounded_claims(spark, d):
    """Answers (an author's derived memories) hold only if every claim cites at least one and only active context ids."""
    allowed = V.active(V.memories(spark, d), READER, PROJECTS, NOW).select(F.col("id").alias("evidence"), F.lit(1).alias("ok"))
    e = edges(spark, d).select("author", "derived", "evidence").distinct().join(allowed, "evidence", "left")
    claims = e.groupBy("author", "derived").agg(F.count("*").alias("n"), F.count("ok").alias("k"))
    return claims.groupBy("author").agg(F.count("*").alias("claims"), F.bool_and((F.col("n") == F.col("k")) & (F.col("n") <= 8)).alias("grounded"))


QUERIES = {f.__name__: f for f in (supersede_fold, mark_fold, review_dedupe, entity_upsert, retired_backfill, derivation_backfill, write_rejects, scope_default, perspective_sync, entity_split, page_upsert, apply_merge, dream_once, touch_access, candidate_filter, grounded_claims)}

ORACLE = {
    "supersede_fold": f"""WITH {M}, o AS (SELECT a.id, min(b.created_at) AS at_, min(CASE WHEN b.valid_from >= coalesce(a.valid_from, b.valid_from) THEN b.valid_from END) AS ends FROM m a JOIN m b ON b.supersedes_id = a.id WHERE a.author = b.author AND b.created_at >= a.created_at GROUP BY 1)
SELECT m.id, CASE WHEN at_ IS NOT NULL AND status = 'active' THEN 'superseded' ELSE status END AS status, coalesce(retired_at, at_) AS retired_at, least(valid_to, ends) AS valid_to FROM m LEFT JOIN o USING (id)""",
    "mark_fold": """WITH e AS (SELECT user_id AS id, ts, event_id, CASE event_type WHEN 'error' THEN 'retracted' WHEN 'view' THEN 'superseded' ELSE 'active' END AS status FROM events WHERE event_type IN ('error', 'view', 'purchase', 'signup')),
f AS (SELECT *, status = 'active' AS on_, coalesce(lag(status = 'active') OVER w, true) AS was FROM e WINDOW w AS (PARTITION BY id ORDER BY ts, event_id)),
g AS (SELECT *, max(CASE WHEN was AND NOT on_ THEN ts END) OVER (PARTITION BY id ORDER BY ts, event_id) AS since FROM f)
SELECT id, max_by(status, (ts, event_id)) AS status, CASE WHEN NOT max_by(on_, (ts, event_id)) THEN max(since) END AS retired_at, CAST(count(*) FILTER (WHERE on_ AND NOT was AND since < ts) AS INTEGER) AS n_intervals, max(since) FILTER (WHERE on_ AND NOT was AND since < ts) AS last_gap FROM g GROUP BY id""",
    "review_dedupe": f"WITH {M} SELECT md5(lower(trim(content, ' '))) AS key, min(id) AS id, count(*) AS n FROM m WHERE reasoning_level IN ('deductive', 'inductive') GROUP BY 1",
    "entity_upsert": """SELECT namespace, entity_type, name, min(id) AS id, coalesce(list_sort(list(DISTINCT alias) FILTER (WHERE alias <> '')), []) AS aliases FROM (
SELECT namespace, entity_type, lower(trim(canonical_name, ' ')) AS name, id, trim(unnest(CASE WHEN aliases IS NULL OR len(aliases) = 0 THEN [NULL] ELSE aliases END), ' ') AS alias FROM mem_entities) GROUP BY 1, 2, 3""",
    "retired_backfill": f"""WITH {M}, {TOLD}, by_ AS (SELECT t.id, try_cast(json_extract_string(meta, '$.superseded_by') AS BIGINT) AS nid FROM told t), nm AS (SELECT b.id, n.created_at AS named FROM by_ b JOIN m n ON n.id = b.nid),
l AS (SELECT * FROM m WHERE status <> 'active' AND (retired_at IS NULL OR id % 2 <> 0))
SELECT id, greatest(created_at, coalesce((SELECT min(s.created_at) FROM m s WHERE s.supersedes_id = l.id AND s.created_at >= l.created_at), CASE WHEN valid_to >= created_at AND valid_to <= TIMESTAMP '{NOW}' THEN valid_to END, (SELECT nm.named FROM nm WHERE nm.id = l.id AND nm.named >= l.created_at), greatest(updated_at, created_at))) AS retired_at FROM l""",
    "derivation_backfill": f"""WITH {M}, {TOLD}, mg AS (SELECT id, author, unnest(from_json(json_extract(meta, '$.merged_from'), '["VARCHAR"]')) AS x FROM told)
SELECT DISTINCT mg.id AS derived, b.id AS evidence, 'summarizes' AS relation FROM mg JOIN m b ON b.id = try_cast(x AS BIGINT) AND b.author = mg.author AND b.id <> mg.id
WHERE regexp_full_match(x, '[0-9]{{1,18}}') AND NOT EXISTS (SELECT 1 FROM e WHERE e.derived = mg.id AND e.evidence = b.id AND e.relation = 'summarizes')
UNION ALL SELECT a.id AS derived, b.id AS evidence, 'supersedes' AS relation FROM m a JOIN m b ON b.id = a.supersedes_id AND b.author = a.author AND a.id <> b.id
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.derived = a.id AND e.evidence = b.id AND e.relation = 'supersedes')""",
    "write_rejects": f"""WITH {M}, b AS (SELECT id, scope, CASE WHEN id % 90 = 0 THEN '  ' ELSE content END AS content, CASE WHEN id % 40 = 0 THEN valid_from - INTERVAL 1 DAY ELSE valid_to END AS valid_to, valid_from, CASE WHEN id % 70 = 0 THEN 1.5 ELSE confidence END AS confidence, CASE WHEN id % 60 <> 0 THEN project END AS project FROM m),
r AS (SELECT id, CASE WHEN trim(coalesce(content, ''), ' ') = '' THEN 'empty content' WHEN valid_to < valid_from THEN 'window ends before it starts' WHEN scope = 'project' AND project IS NULL THEN 'project scope without a project' WHEN confidence < 0 OR confidence > 1 THEN 'confidence out of range' END AS reason FROM b) SELECT * FROM r WHERE reason IS NOT NULL""",
    "scope_default": f"WITH {M} SELECT scope, CASE WHEN project IS NULL OR memory_type = 'preference' THEN 'private' ELSE 'project' END AS would_be, count(*) AS n FROM m GROUP BY 1, 2",
    "perspective_sync": f"""WITH {M}, g AS (SELECT id, CASE WHEN id % 4 <> 0 THEN observer_entity_id END AS o, CASE WHEN id % 6 <> 0 THEN observed_entity_id END AS d, subject_entity_id AS s, try_cast(substr(author, 2, 9) AS BIGINT) AS me FROM m)
SELECT id, coalesce(o, me) AS observer_entity_id, coalesce(d, s, o, me) AS observed_entity_id FROM g""",
    "entity_split": f"""WITH {M}, r AS (SELECT DISTINCT author, unnest([subject_entity_id, observer_entity_id, observed_entity_id]) AS id FROM m), x AS (SELECT DISTINCT id, author AS owner, namespace, entity_type, canonical_name FROM mem_entities)
SELECT DISTINCT r.author, r.id AS from_id, namespace, entity_type, canonical_name FROM r JOIN x ON x.id = r.id WHERE r.author <> owner""",
    "page_upsert": f"""WITH {M} SELECT id, author, project || '~mem' AS repo, first_value(id) OVER w AS current_id, row_number() OVER w = 1 AS is_current FROM m WHERE kind = 'page' AND project IS NOT NULL AND status = 'active' WINDOW w AS (PARTITION BY author, project ORDER BY created_at DESC, id DESC)""",
    "apply_merge": f"""WITH {M}, p AS (SELECT DISTINCT derived, evidence FROM e WHERE relation IN ('summarizes', 'supports')), j AS (SELECT p.derived, m.* FROM p JOIN m ON m.id = p.evidence)
SELECT derived, count(*) AS members, bool_and(status = 'active' AND coalesce(reasoning_level, 'explicit') = 'explicit') AND count(DISTINCT author) = 1 AND count(*) >= 2 AS accepted, CASE WHEN bool_or(scope = 'private') THEN 'private' ELSE 'project' END AS scope,
CASE WHEN min(project) = max(project) THEN min(project) END AS project, least(max(importance), 0.7::DOUBLE) AS importance FROM j GROUP BY 1""",
    "touch_access": f"""WITH {M}, l AS (SELECT memory_id, count(*) AS n, max(created_at) AS last FROM (SELECT DISTINCT * FROM mem_sources) GROUP BY 1)
SELECT id, coalesce(access_count, 0) + n AS access_count, greatest(last_accessed_at, last) AS last_accessed_at FROM act JOIN l ON l.memory_id = act.id""",
    "candidate_filter": f"""WITH {M}, p AS (SELECT x.derived, count(*) AS n, count(a.id) AS k FROM (SELECT DISTINCT derived, evidence FROM e WHERE relation <> 'contradicts') x LEFT JOIN act a ON a.id = x.evidence GROUP BY 1),
c AS (SELECT m.author, m.id, row_number() OVER (PARTITION BY m.author, lower(content) ORDER BY m.id) AS a FROM m JOIN p ON p.derived = m.id WHERE n = k AND n <= 8 AND n >= CASE WHEN reasoning_level = 'deductive' THEN 1 ELSE 2 END AND reasoning_level IN ('deductive', 'inductive') AND length(content) BETWEEN 20 AND 1200 AND confidence BETWEEN 0 AND 1),
q AS (SELECT author, id, row_number() OVER (PARTITION BY author ORDER BY id) AS pos FROM c WHERE a = 1) SELECT author, id, pos FROM q WHERE pos <= 4""",
    "grounded_claims": f"""WITH {M}, c AS (SELECT x.author, x.derived, count(*) AS n, count(a.id) AS k FROM (SELECT DISTINCT author, derived, evidence FROM e) x LEFT JOIN act a ON a.id = x.evidence GROUP BY 1, 2)
SELECT author, count(*) AS claims, bool_and(n = k AND n <= 8) AS grounded FROM c GROUP BY 1""",
}
from skerry.plans.memory import ORACLE as _MEMORY  # noqa: E402

ORACLE["dream_once"] = f"""WITH g AS (SELECT observer_entity_id, observed_entity_id, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS fingerprint FROM ({_MEMORY['dream_inputs']}) GROUP BY 1, 2) SELECT * FROM g WHERE observer_entity_id % 2 <> 0"""
