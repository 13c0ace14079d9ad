"""Queries over the map of components, their edges, and rules derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import globs as G
from skerry.operators import mapping as P
from skerry.operators.hierarchy import hierarchy
from skerry.sources.tables import table


def comps(spark, d):
    return table(spark, d, "components").dropDuplicates(["id"])


def rels(spark, d):
    return table(spark, d, "relationships").select("src_component_id", "dst_component_id", F.lower(F.regexp_replace("kind", "[- ]", "_")).alias("kind")).distinct()


def paths(spark, d):
    """Files of each scope: one under each component's source folder, one document page each, and the corpus' own."""
    c = comps(spark, d)
    made = c.select("repo", F.concat(F.lit("src/"), "slug", F.lit("/main.py")).alias("path")).union(c.select("repo", F.concat(F.lit("docs/"), F.try_element_at(F.split("slug", "-"), F.lit(2)), (F.col("id") % 3).cast("string"), F.lit(".md"))))
    docs = table(spark, d, "documents").select(F.col("source").alias("repo"), "path")
    return made.union(docs).where("path IS NOT NULL").distinct()


def constraints(spark, d):
    """Rules: one for every third component, a global one for every fifth, some of them broken on purpose."""
    c = comps(spark, d).where("id % 3 = 0 OR id % 5 = 0")
    k = F.col("id")
    return c.select(
        k.alias("rule_id"), F.when(k % 7 == 0, F.lit("harbor-core")).otherwise(F.col("repo")).alias("repo"), F.when(k % 5 == 0, "global").otherwise(F.when(k % 33 == 0, "odd").otherwise("component")).alias("scope"),
        F.when(k % 21 != 0, k).alias("component_id"), F.concat(F.lit("rule "), "slug").alias("title"), F.when(k % 4 == 0, "must").when(k % 4 == 1, "should").otherwise("info").alias("severity"),
    )


def component_resolve(spark, d):
    return P.resolve(paths(spark, d), comps(spark, d)).select("repo", "path", "slug", "pos")


def hop_expand(spark, d):
    r = P.resolve(paths(spark, d), comps(spark, d))
    return P.neighbours(r.select("repo", "component_id"), rels(spark, d), comps(spark, d))


def constraint_select(spark, d):
    """Rules that govern a change to the files of a scope, the strictest first."""
    touched = paths(spark, d)
    direct = P.resolve(touched, comps(spark, d)).select("repo", "component_id")
    near = P.neighbours(direct, rels(spark, d), comps(spark, d))
    rules = constraints(spark, d)
    own = rules.where("scope = 'component'").join(near, ["repo", "component_id"])
    glob = rules.where("scope = 'global'").join(touched.select("repo").distinct(), "repo", "left_semi").withColumn("via", F.lit("global"))
    both = own.select("repo", "rule_id", "severity", "title", "via").unionByName(glob.select("repo", "rule_id", "severity", "title", "via"))
    from pyspark.sql import Window

    sev = F.when(F.col("severity") == "must", 0).when(F.col("severity") == "should", 1).otherwise(2)
    w = Window.partitionBy("repo").orderBy(sev, (F.col("via") != "global").cast("int"), (F.col("via") != "direct").cast("int"), "title", "rule_id")
    return both.withColumn("pos", F.row_number().over(w))


def must_rules(spark, d):
    """What is pushed before a change: only rules that must hold."""
    return constraint_select(spark, d).where("severity = 'must'").select("repo", "rule_id", "via")


def _mapped(spark, d):
    return comps(spark, d).where(F.exists(F.coalesce("key_paths", F.array()), lambda g: F.coalesce(F.trim(g) != "", F.lit(False)))).select("id", "repo")


def undeliverable(spark, d):
    """Rules no path can ever receive, with the reason."""
    r = constraints(spark, d).where("scope <> 'global'")
    c = comps(spark, d).select(F.col("id").alias("component_id"), F.col("repo").alias("home"), "slug")
    mapped = _mapped(spark, d)
    e = rels(spark, d).select(F.col("src_component_id").alias("a"), F.col("dst_component_id").alias("b"))
    both = e.union(e.select("b", "a")).toDF("a", "b")
    home = comps(spark, d).select(F.col("id").alias("a"), F.col("repo").alias("ra"))
    near = both.join(home, "a").join(mapped.select(F.col("id").alias("b"), F.col("repo").alias("rb")), "b").where("ra = rb").select(F.col("a").alias("id"))
    reach = mapped.select("id").union(near).distinct().select(F.col("id").alias("component_id"), F.lit(True).alias("reached"))
    j = r.join(c, "component_id", "left").join(reach, "component_id", "left")
    why = F.when(F.col("scope") != "component", F.concat(F.lit("scope is "), "scope")).when(F.col("home").isNull(), "no component").when(F.col("home") != F.col("repo"), F.concat(F.lit("component is in repo "), "home")).when(F.col("reached").isNull(), "not mapped")
    return j.withColumn("reason", why).where("reason IS NOT NULL").select("rule_id", "reason")


def ruleless(spark, d):
    r = constraints(spark, d).where("component_id IS NOT NULL").select(F.col("component_id").alias("id"))
    c = comps(spark, d).join(r, "id", "left_anti")
    return c.select("repo", "slug", (~F.exists(F.coalesce("key_paths", F.array()), lambda g: F.coalesce(F.trim(g) != "", F.lit(False)))).alias("grouping"))


def orphan_globs(spark, d):
    """Globs that match no file of their scope."""
    g = P.glob_rows(comps(spark, d))
    hit = P.matches(paths(spark, d), g).select("component_id", "glob").distinct()
    return g.join(hit, ["component_id", "glob"], "left_anti").select("repo", "slug", "glob").distinct()


def blank_globs(spark, d):
    c = comps(spark, d).select("id", "slug", F.explode("key_paths").alias("g"))
    return c.where("trim(coalesce(g, '')) = ''").groupBy("id", "slug").agg(F.count("*").alias("n"))


def cross_repo_edges(spark, d):
    c = comps(spark, d)
    s = c.select(F.col("id").alias("src_component_id"), F.col("repo").alias("src_repo"), F.col("slug").alias("src_slug"))
    t = c.select(F.col("id").alias("dst_component_id"), F.col("repo").alias("dst_repo"), F.col("slug").alias("dst_slug"))
    return rels(spark, d).join(s, "src_component_id").join(t, "dst_component_id").where("src_repo <> dst_repo").select("src_repo", "src_slug", "kind", "dst_repo", "dst_slug")


def mapped_dirs(spark, d):
    return P.glob_rows(comps(spark, d)).select("repo", G.mapped_dir(F.col("glob")).alias("dir")).where("dir IS NOT NULL").distinct()


def unmapped_paths(spark, d):
    """Files inside a mapped directory that no component matches."""
    p = paths(spark, d)
    segs = F.split("path", "/")
    up = p.select("repo", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(segs)), lambda i: F.array_join(F.slice(segs, 1, i), "/"))).alias("dir")).where("dir <> path")
    inside = up.join(mapped_dirs(spark, d), ["repo", "dir"], "left_semi").select("repo", "path").distinct()
    hit = P.matches(p, P.glob_rows(comps(spark, d))).select("repo", "path").distinct()
    return inside.join(hit, ["repo", "path"], "left_anti")


def locate(spark, d):
    text = F.lower(F.concat_ws(" ", "slug", "name", "responsibility", F.array_join("key_paths", " ")))
    return comps(spark, d).where(F.contains(text, F.lit("backfill")) | F.contains(text, F.lit("yard"))).select("id", "slug")


def map_tree(spark, d):
    """Each scope's tree: a component whose parent is elsewhere is a root there; children by falling priority, then slug."""
    c = comps(spark, d)
    own = c.select(F.col("id").alias("pid"), F.col("repo").alias("prepo"))
    inside = c.join(own, (c.parent_id == own.pid) & (c.repo == own.prepo), "left").withColumn("parent_id", F.col("pid"))
    key = F.concat(F.lpad((1000000 - F.coalesce("priority", F.lit(0))).cast("string"), 7, "0"), F.lit(":"), "slug")
    tree = hierarchy(inside.withColumn("key", key), "id", "parent_id", "key")
    return tree.where("depth >= 0").join(c.select("id", "repo", "slug"), "id").select("repo", "id", "slug", F.col("depth").cast("int"), F.col("path").alias("sort_path"))


def normal_paths(spark, d):
    t = table(spark, d, "documents").where("path IS NOT NULL")
    odd = F.concat(F.lit("./a//../"), "path", F.lit("/./x/.."))
    return t.select("doc_id", G.normal_path(odd).alias("path"))


QUERIES = {f.__name__: f for f in (component_resolve, hop_expand, constraint_select, must_rules, undeliverable, ruleless, orphan_globs, blank_globs, cross_repo_edges, mapped_dirs, unmapped_paths, locate, map_tree, normal_paths)}

C = """c AS (SELECT DISTINCT ON (id) * FROM components),
r AS (SELECT DISTINCT src_component_id AS s, dst_component_id AS t, lower(regexp_replace(kind, '[- ]', '_', 'g')) AS kind FROM relationships),
paths AS (SELECT DISTINCT repo, path FROM (SELECT repo, 'src/' || slug || '/main.py' AS path FROM c UNION ALL SELECT repo, 'docs/' || string_split(slug, '-')[2] || (id % 3) || '.md' FROM c UNION ALL SELECT source, path FROM documents) x WHERE path IS NOT NULL),
g AS (SELECT * FROM (SELECT id AS component_id, repo, slug, priority, unnest(key_paths) AS gl FROM c) x WHERE trim(gl, ' ') <> ''),
gx AS (SELECT *, '^' || replace(replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(gl, '([.+^$(){}|\\[\\]\\\\])', '\\\\\\1', 'g'), '**/', chr(1)), '**', chr(2)), '\\*', '[^/]*', 'g'), '\\?', '[^/]', 'g'), chr(1), '(?:.*/)?'), chr(2), '.*') || '$' AS rx FROM g),
hit AS (SELECT p.repo, p.path, component_id, slug, priority, gl FROM paths p JOIN gx ON gx.repo = p.repo AND regexp_matches(p.path, gx.rx)),
res AS (SELECT repo, path, component_id, slug, row_number() OVER (PARTITION BY repo, path ORDER BY max(sp) DESC, coalesce(priority, 0) DESC, slug, component_id) AS pos
 FROM (SELECT *, (CASE WHEN regexp_matches(gl, '[*?]') THEN 0 ELSE 1 END) * 100000 + length(regexp_replace(gl, '[*?]', '', 'g')) AS sp FROM hit) GROUP BY repo, path, component_id, slug, priority),
direct AS (SELECT DISTINCT repo, component_id FROM res),
both_ AS (SELECT s, t FROM r UNION SELECT t, s FROM r),
near AS (SELECT repo, component_id, 'direct' AS via FROM direct UNION ALL SELECT repo, component_id, 'graph' FROM (SELECT d.repo, b.t AS component_id FROM direct d JOIN both_ b ON b.s = d.component_id JOIN c x ON x.id = b.s JOIN c y ON y.id = b.t AND y.repo = x.repo EXCEPT SELECT * FROM direct)),
rules AS (SELECT id AS rule_id, CASE WHEN id % 7 = 0 THEN 'harbor-core' ELSE repo END AS repo, CASE WHEN id % 5 = 0 THEN 'global' WHEN id % 33 = 0 THEN 'odd' ELSE 'component' END AS scope, CASE WHEN id % 21 <> 0 THEN id END AS component_id, 'rule ' || slug AS title, CASE id % 4 WHEN 0 THEN 'must' WHEN 1 THEN 'should' ELSE 'info' END AS severity FROM c WHERE id % 3 = 0 OR id % 5 = 0),
sel AS (SELECT u.repo, rule_id, severity, title, via FROM rules u JOIN near n ON n.repo = u.repo AND n.component_id = u.component_id WHERE scope = 'component' UNION ALL SELECT repo, rule_id, severity, title, 'global' FROM rules WHERE scope = 'global' AND repo IN (SELECT repo FROM paths)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE severity WHEN 'must' THEN 0 WHEN 'should' THEN 1 ELSE 2 END, via <> 'global', via <> 'direct', title, rule_id) AS pos FROM sel),
mapped AS (SELECT DISTINCT component_id AS id, repo FROM g),
dirs AS (SELECT DISTINCT repo, dir FROM (SELECT repo, trim(CASE WHEN regexp_matches(gl, '[*?]') THEN regexp_replace(regexp_extract(regexp_extract(gl, '^[^*?]*'), '^(.*/)?'), '/$', '') ELSE regexp_replace(gl, '/?[^/]*$', '') END, '/') AS dir FROM g) WHERE dir <> '')"""

ORACLE = {
    "component_resolve": f"WITH {C} SELECT repo, path, slug, pos FROM res",
    "hop_expand": f"WITH {C} SELECT * FROM near",
    "constraint_select": f"WITH {C} SELECT * FROM ranked",
    "must_rules": f"WITH {C} SELECT repo, rule_id, via FROM ranked WHERE severity = 'must'",
    "undeliverable": f"""WITH {C}, reach AS (SELECT id FROM mapped UNION SELECT x.id FROM both_ b JOIN c x ON x.id = b.s JOIN mapped m ON m.id = b.t AND m.repo = x.repo)
SELECT rule_id, reason FROM (SELECT rule_id, CASE WHEN scope <> 'component' THEN 'scope is ' || scope WHEN c.id IS NULL THEN 'no component' WHEN c.repo <> u.repo THEN 'component is in repo ' || c.repo WHEN c.id NOT IN (SELECT id FROM reach) THEN 'not mapped' END AS reason
FROM rules u LEFT JOIN c ON c.id = u.component_id WHERE scope <> 'global') WHERE reason IS NOT NULL""",
    "ruleless": f"WITH {C} SELECT repo, slug, id NOT IN (SELECT id FROM mapped) AS grouping FROM c WHERE id NOT IN (SELECT component_id FROM rules WHERE component_id IS NOT NULL)",
    "orphan_globs": f"WITH {C} SELECT DISTINCT repo, slug, gl AS \"glob\" FROM g WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.component_id = g.component_id AND h.gl = g.gl)",
    "blank_globs": "WITH x AS (SELECT id, slug, unnest(key_paths) AS g FROM (SELECT DISTINCT * FROM components)) SELECT id, slug, count(*) AS n FROM x WHERE trim(coalesce(g, ''), ' ') = '' GROUP BY 1, 2",
    "cross_repo_edges": f"WITH {C} SELECT a.repo AS src_repo, a.slug AS src_slug, kind, b.repo AS dst_repo, b.slug AS dst_slug FROM r JOIN c a ON a.id = s JOIN c b ON b.id = t WHERE a.repo <> b.repo",
    "mapped_dirs": f"WITH {C} SELECT * FROM dirs",
    "unmapped_paths": f"WITH {C} SELECT repo, path FROM paths p WHERE EXISTS (SELECT 1 FROM dirs d WHERE d.repo = p.repo AND starts_with(p.path, d.dir || '/')) AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.repo = p.repo AND h.path = p.path)",
    "locate": f"WITH {C}, x AS (SELECT id, slug, lower(concat_ws(' ', slug, name, responsibility, array_to_string(key_paths, ' '))) AS t FROM c) SELECT id, slug FROM x WHERE contains(t, 'backfill') OR contains(t, 'yard')",
    "map_tree": f"""WITH RECURSIVE {C}, k AS (SELECT c.id, c.repo, c.slug, p.id AS up, lpad(CAST(1000000 - coalesce(c.priority, 0) AS VARCHAR), 7, '0') || ':' || c.slug AS key FROM c LEFT JOIN c p ON p.id = c.parent_id AND p.repo = c.repo),
t AS (SELECT id, repo, slug, 0 AS depth, key AS sort_path FROM k WHERE up IS NULL UNION ALL SELECT k.id, k.repo, k.slug, t.depth + 1, t.sort_path || '/' || k.key FROM t JOIN k ON k.up = t.id)
SELECT repo, id, slug, CAST(depth AS INTEGER) AS depth, sort_path FROM t""",
    "normal_paths": "SELECT doc_id, path FROM documents WHERE path IS NOT NULL",
}
