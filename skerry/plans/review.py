"""Reviews of proposals, cards of peers, and the documents that rules come from."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.operators import mapping as P
from skerry.operators import views as V
from skerry.plans.mapping import C, comps, constraints, paths, rels
from skerry.plans.memory import M, MAY, PROJECTS, READER, peer_cards
from skerry.sources.tables import table


def reviews(spark, d):
    """A queue of proposals: every derived memory, waiting, approved or rejected by the last digit of its id."""
    m = V.memories(spark, d).where("reasoning_level IN ('deductive', 'inductive')")
    state = F.when(F.col("id") % 10 == 3, "approved").when(F.col("id") % 10 == 7, "rejected").otherwise("pending")
    return m.select("id", "author", F.when(F.col("id") % 4 == 0, "merge").when(F.col("id") % 4 == 1, "supersede").otherwise("derive").alias("action"), "content", "confidence", "created_at", state.alias("status"))


def review_list(spark, d):
    """What waits for the reader, oldest first, ties by id."""
    own = reviews(spark, d).where((F.col("status") == "pending") & (F.col("author") == READER))
    return own.orderBy("created_at", "id").select("id", "action", "confidence", F.to_date("created_at").alias("day"))


def review_resolve(spark, d):
    """The queue after a batch of decisions, two for some rows: the first decision claims a waiting row of its own author, others change nothing."""
    q = reviews(spark, d)
    asked = q.select("id", F.explode(F.when(F.col("id") % 6 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("seq"))
    asked = asked.select("id", "seq", F.when((F.col("id") + F.col("seq")) % 2 == 0, "approved").otherwise("rejected").alias("decision"), F.when(F.col("id") % 5 == 0, "u2").otherwise(READER).alias("by"))
    claim = q.where("status = 'pending'").select("id", "author").join(asked, "id").where("author = by").groupBy("id").agg(F.min_by("decision", "seq").alias("decision"))
    return q.select("id", F.col("status").alias("before")).join(claim, "id", "left").select("id", "before", F.coalesce("decision", "before").alias("after"))


def peer_recent(spark, d):
    """The ids on each card made rows again, in their order."""
    ids = peer_cards(spark, d).select("author", "peer", F.posexplode("recent_memory_ids").alias("pos", "id"))
    m = V.memories(spark, d).select("id", "memory_type", "project")
    return ids.join(m, "id").select("author", "peer", (F.col("pos") + 1).alias("pos"), "id", "memory_type", "project")


def peer_lookup(spark, d):
    """For every visible memory the card of the peer its text names, if that is a number and there is such a card."""
    m = V.visible(V.memories(spark, d), READER, PROJECTS).select("id", "author", F.when(F.col("id") % 3 == 0, F.lit("e?")).otherwise(F.col("observed_entity_id").cast("string")).alias("named"))
    peer = F.when(F.rlike("named", F.lit("^[0-9]{1,18}$")), F.try_to_number("named", F.lit("999999999999999999"))).cast("long")
    cards = peer_cards(spark, d).select(F.col("author").alias("by"), F.col("peer"), "active_count", "observed_count")
    j = m.withColumn("n", peer)
    return j.join(cards, (F.col("by") == F.col("author")) & (F.col("peer") == F.col("n")), "left").select("id", "named", "active_count", "observed_count")


def _files(spark, d):
    """The later delivery of each file."""
    t = table(spark, d, "documents").where("path IS NOT NULL").groupBy("source", "path").agg(F.max(F.struct("doc_id", "content_hash", "status")).alias("f"))
    return t.select("source", "path", "f.doc_id", "f.content_hash", "f.status")


def _sources(spark, d):
    """Rules and the file each names as its source: of some scopes one that exists, of others one that is gone; with the hash of when it was read."""
    files = _files(spark, d).groupBy("source").agg(F.min(F.struct("path", "content_hash")).alias("f"))
    r = constraints(spark, d).join(files, F.col("repo") == F.col("source"), "left")
    k = F.col("rule_id")
    path = F.when(k % 10 == 0, F.lit("gone/away.md")).otherwise(F.coalesce("f.path", F.lit("README.md")))
    return r.select("rule_id", "repo", path.alias("path"), F.when(k % 15 == 0, F.lit("read-before")).when(k % 4 != 0, F.col("f.content_hash")).alias("hash"))


def constraint_sources(spark, d):
    """Every rule with the document its source names now, found by scope and path; a missing hash is filled, one that is there stays."""
    f = _files(spark, d).select(F.col("source").alias("repo"), "path", "doc_id", "content_hash")
    return _sources(spark, d).join(f, ["repo", "path"], "left").select("rule_id", "doc_id", F.coalesce("hash", "content_hash").alias("hash"))


def source_freshness(spark, d):
    """Whether the file a rule came from has changed since it was read, is gone, or was never hashed."""
    f = _files(spark, d).select(F.col("source").alias("repo"), "path", "content_hash", F.lit(True).alias("there"))
    j = _sources(spark, d).join(f, ["repo", "path"], "left")
    state = F.when(F.col("there").isNull(), "gone").when(F.col("hash").isNull(), "unhashed").when(F.col("hash") != F.col("content_hash"), "changed").otherwise("fresh")
    return j.select("rule_id", state.alias("state"), F.when(state == "changed", F.col("content_hash")).otherwise(F.col("hash")).alias("accepted_hash"))


def mark_stale(spark, d):
    """The status of every document after a check marked those whose file is another one by now."""
    from skerry.plans.corpus import ingest_plan

    stale = ingest_plan(spark, d).where("action = 'replace'").select("source", "path", F.lit(True).alias("stale"))
    return table(spark, d, "documents").select("doc_id", "source", "path", "status").join(stale, ["source", "path"], "left").select("doc_id", F.when(F.col("stale"), "stale").otherwise(F.col("status")).alias("status"))


def selection_gaps(spark, d):
    """Rules of a scope with files that no selection there can ever deliver: bound to no component, to one of another scope, or of an odd kind."""
    c = comps(spark, d).select(F.col("id").alias("component_id"), F.col("repo").alias("home"))
    r = constraints(spark, d).where("scope <> 'global'").join(c, "component_id", "left")
    never = r.where((F.col("scope") != "component") | F.col("home").isNull() | (F.col("home") != F.col("repo")))
    touched = paths(spark, d).select("repo").distinct()
    return never.join(touched, "repo", "left_semi").join(_delivered(spark, d), "rule_id", "left_anti").select("repo", "rule_id")


def _delivered(spark, d):
    direct = P.resolve(paths(spark, d), comps(spark, d)).select("repo", "component_id")
    near = P.neighbours(direct, rels(spark, d), comps(spark, d))
    return constraints(spark, d).where("scope = 'component'").join(near, ["repo", "component_id"], "left_semi").select("rule_id")


QUERIES = {f.__name__: f for f in (review_list, review_resolve, peer_recent, peer_lookup, constraint_sources, source_freshness, mark_stale, selection_gaps)}

from skerry.plans.corpus import ORACLE as _CORPUS  # noqa: E402
from skerry.plans.memory import ORACLE as _MEMORY  # noqa: E402

_REV = f"""{M}, rev AS (SELECT id, author, CASE id % 4 WHEN 0 THEN 'merge' WHEN 1 THEN 'supersede' ELSE 'derive' END AS action, confidence, created_at, CASE id % 10 WHEN 3 THEN 'approved' WHEN 7 THEN 'rejected' ELSE 'pending' END AS status FROM m WHERE reasoning_level IN ('deductive', 'inductive'))"""
_FILES = "f AS (SELECT source, path, max(doc_id) AS doc_id, arg_max(content_hash, doc_id) AS content_hash FROM documents WHERE path IS NOT NULL GROUP BY 1, 2)"
_SRC = f"""{C}, {_FILES}, f1 AS (SELECT source, min(path) AS path, arg_min(content_hash, path) AS content_hash FROM f GROUP BY 1),
src AS (SELECT rule_id, repo, CASE WHEN rule_id % 10 = 0 THEN 'gone/away.md' ELSE coalesce(f1.path, 'README.md') END AS path, CASE WHEN rule_id % 15 = 0 THEN 'read-before' WHEN rule_id % 4 <> 0 THEN f1.content_hash END AS hash FROM rules LEFT JOIN f1 ON f1.source = rules.repo)"""

ORACLE = {
    "review_list": f"WITH {_REV} SELECT id, action, confidence, CAST(created_at AS DATE) AS day FROM rev WHERE status = 'pending' AND author = '{READER}'",
    "review_resolve": f"""WITH {_REV}, a AS (SELECT id, unnest(CASE WHEN id % 6 = 0 THEN [1, 2] ELSE [1] END) AS seq FROM rev), b AS (SELECT id, seq, CASE WHEN (id + seq) % 2 = 0 THEN 'approved' ELSE 'rejected' END AS decision, CASE WHEN id % 5 = 0 THEN 'u2' ELSE '{READER}' END AS who FROM a),
k AS (SELECT rev.id, arg_min(decision, seq) AS decision FROM rev JOIN b USING (id) WHERE status = 'pending' AND author = who GROUP BY 1) SELECT rev.id, status AS before, coalesce(decision, status) AS after FROM rev LEFT JOIN k USING (id)""",
    "peer_recent": f"""WITH {M}, p AS ({_MEMORY['peer_cards']}), u AS (SELECT author, peer, unnest(recent_memory_ids) AS id, generate_subscripts(recent_memory_ids, 1) AS pos FROM p)
SELECT u.author, peer, CAST(pos AS INTEGER) AS pos, u.id, memory_type, project FROM u JOIN m ON m.id = u.id""",
    "peer_lookup": f"""WITH {M}, p AS ({_MEMORY['peer_cards']}), n AS (SELECT id, author, CASE WHEN id % 3 = 0 THEN 'e?' ELSE CAST(observed_entity_id AS VARCHAR) END AS named FROM m WHERE {MAY})
SELECT n.id, named, active_count, observed_count FROM n LEFT JOIN p ON p.author = n.author AND p.peer = try_cast(named AS BIGINT)""",
    "constraint_sources": f"WITH {_SRC} SELECT rule_id, doc_id, coalesce(hash, content_hash) AS hash FROM src LEFT JOIN f ON f.source = src.repo AND f.path = src.path",
    "source_freshness": f"""WITH {_SRC}, s AS (SELECT rule_id, hash, content_hash, CASE WHEN f.path IS NULL THEN 'gone' WHEN hash IS NULL THEN 'unhashed' WHEN hash <> content_hash THEN 'changed' ELSE 'fresh' END AS state FROM src LEFT JOIN f ON f.source = src.repo AND f.path = src.path)
SELECT rule_id, state, CASE WHEN state = 'changed' THEN content_hash ELSE hash END AS accepted_hash FROM s""",
    "mark_stale": f"WITH p AS ({_CORPUS['ingest_plan']}) SELECT doc_id, CASE WHEN p.action = 'replace' THEN 'stale' ELSE status END AS status FROM documents d LEFT JOIN p ON p.source = d.source AND p.path = d.path",
    "selection_gaps": f"""WITH {C} SELECT u.repo, rule_id FROM rules u LEFT JOIN c ON c.id = u.component_id WHERE scope <> 'global' AND (scope <> 'component' OR c.id IS NULL OR c.repo <> u.repo) AND u.repo IN (SELECT repo FROM paths)
AND NOT EXISTS (SELECT 1 FROM near n WHERE u.scope = 'component' AND n.repo = u.repo AND n.component_id = u.component_id)""",
}
