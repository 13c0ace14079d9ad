"""Parent-child rows to full hierarchies: path, depth, root, descendants and rings.

Level-wise frontier joins extend paths from the roots, one join a level. All levels go to one table, a
partition each, so that the plan of the result is one scan however deep the trees are. The rows still to be placed
are written again whenever half of them have been placed, so a level reads at most twice what is left.
What is left in the end hangs below a ring (every such row has exactly one parent, itself unreached); for those
the parent pointers are squared, which takes log2(rows) joins however long the ring or its tail is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.sources.durable import durable, shelf


def clean_nodes(df: DataFrame, id_col: str, parent_col: str, label_col: str) -> DataFrame:
    """(id, parent, label), one row an id. Copies count once; of rows that contradict each other the
    least (parent, label) holds. Rows without an id are no nodes; a null label is an empty one."""
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent"), F.coalesce(F.col(label_col), F.lit("")).alias("label")
    ).where("id IS NOT NULL")
    return rows.groupBy("id").agg(F.min(F.struct("parent", "label")).alias("r")).select("id", "r.parent", "r.label")


def levels(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rooted nodes as (id, root, depth, path, line), the nodes never reached as (id, parent)); line holds the ids from the root down.

    Each round joins the last level with the rows not placed yet. Levels are written to the
    shared folder, so a lost executor costs one level, not the whole climb."""
    spark = nodes.sparkSession
    parents = nodes.select(F.col("id").alias("pid"))
    marked = nodes.join(parents, nodes.parent == parents.pid, "left")
    is_root = F.col("pid").isNull()
    front = marked.where(is_root).select("id", F.col("id").alias("root"), F.col("label").alias("path"), F.array("id").alias("line"))
    below = durable(marked.where(~is_root).select(F.col("id").alias("cid"), "parent", "label"), "below")
    left, placed, depth, since = below.count(), 0, 0, 0
    base, kind = shelf(spark, "levels"), T.StructType([*front.schema.fields, T.StructField("depth", T.IntegerType())])
    read = lambda: spark.read.schema(kind).option("basePath", base)
    front.write.parquet(f"{base}/depth=0")
    while left:
        last = spark.read.schema(front.schema).parquet(f"{base}/depth={depth}")
        step = last.join(below, last.id == below.parent).select(
            F.col("cid").alias("id"), "root", F.concat("path", F.lit("/"), "label").alias("path"), F.concat("line", F.array("cid")).alias("line")
        )
        depth += 1
        step.write.parquet(f"{base}/depth={depth}")
        n = spark.read.schema(front.schema).parquet(f"{base}/depth={depth}").count()
        if not n:
            break
        placed += n
        if 2 * placed >= left:
            done = read().parquet(*(f"{base}/depth={k}" for k in range(since + 1, depth + 1))).select(F.col("id").alias("cid"))
            below, left, placed, since = durable(below.join(done, "cid", "left_anti"), "below"), left - placed, 0, depth
    reached = read().parquet(base).select("id", "root", "depth", "path", "line")
    if since < depth:
        below = below.join(reached.where(F.col("depth") > since).select(F.col("id").alias("cid")), "cid", "left_anti")
    return reached, durable(below.select(F.col("cid").alias("id"), "parent"), "lost")


def _union(done: list[DataFrame]) -> DataFrame:
    while len(done) > 1:  # a balanced union keeps the plan shallow
        done = [a.unionByName(b) for a, b in zip(done[::2], done[1::2])] + ([done[-1]] if len(done) % 2 else [])
    return done[0]


def rings(lost: DataFrame) -> DataFrame:
    """Of unreached nodes (id, parent): (id, ring, on_ring); ring is the least id of the ring reached.

    After k squarings a pointer leads 2^k steps up. Once 2^k is at least the number of rows every
    pointer has entered its ring, and the pointers' targets are exactly the ring members."""
    n = lost.count()
    if not n:
        return lost.select("id", F.col("id").alias("ring"), F.lit(False).alias("on_ring"))
    jump = durable(lost.select("id", F.col("parent").alias("up"), F.least("id", "parent").alias("low")), "jump")
    steps = 1
    while steps < n:
        far = jump.select(F.col("id").alias("mid"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        jump = durable(jump.join(far, jump.up == far.mid).select("id", F.col("up2").alias("up"), F.least("low", "low2").alias("low")), "jump")
        steps *= 2
    on = jump.select(F.col("up").alias("rid")).distinct()
    # a ring member has walked its whole ring, so its low is the ring's name; a tail takes it from its target
    named = jump.join(on, jump.id == on.rid, "left_semi").select(F.col("id").alias("rid"), F.col("low").alias("ring"))
    at = jump.join(named, jump.up == named.rid).select("id", "ring")
    return at.join(named.select(F.col("rid").alias("id"), F.lit(True).alias("hit")), "id", "left").select(
        "id", "ring", F.coalesce("hit", F.lit(False)).alias("on_ring")
    )


def hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", label_col: str = "slug") -> DataFrame:
    """One row a node: (id, root, depth, path, line).

    Nodes on a ring have depth -1, nodes leading into one -2; both have an empty path, an empty
    line and the least id of the ring as root. An empty table gives no rows; columns of df other
    than the three named are ignored, whatever they are called."""
    nodes = durable(clean_nodes(df, id_col, parent_col, label_col), "nodes")
    reached, lost = levels(nodes)
    caught = rings(lost).select(
        "id", F.col("ring").alias("root"), F.when(F.col("on_ring"), F.lit(-1)).otherwise(F.lit(-2)).alias("depth"), F.lit("").alias("path"),
        F.array().cast("array<bigint>").alias("line"),
    )
    return reached.unionByName(caught)


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every rooted node, itself left out; below_rings has those of the others."""
    return (
        tree.where("depth > 0")
        .select(F.col("id").alias("descendant"), "depth", F.posexplode("line").alias("at", "ancestor"))
        .where("at < depth")
        .select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
    )


def below_rings(lost: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of unreached nodes (id, parent), itself left out; distance counts the steps down.

    A ring member is above all the others of its ring and their tails, a tail node above what hangs below it. Every node has
    one parent, so a walk down that stops before its own start meets no node twice: each pair comes out once, and the
    rounds end with the longest ring and the tail below it."""
    below = lost.select(F.col("parent").alias("up"), F.col("id").alias("cid"))
    front = durable(below.where("up <> cid").select(F.col("up").alias("ancestor"), F.col("cid").alias("descendant"), F.lit(1).alias("distance")), "below_rings")
    done = [front]
    while not front.isEmpty():
        step = front.join(below, (front.descendant == below.up) & (front.ancestor != below.cid))
        front = durable(step.select("ancestor", F.col("cid").alias("descendant"), (F.col("distance") + 1).alias("distance")), "below_rings")
        done.append(front)
    return _union(done)


def all_descendants(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", label_col: str = "slug") -> DataFrame:
    """(ancestor, descendant, distance) of every node, rooted, on a ring or below one, itself left out."""
    tree = hierarchy(df, id_col, parent_col, label_col)
    caught = tree.where("depth < 0").select("id")
    lost = durable(clean_nodes(df, id_col, parent_col, label_col).join(caught, "id", "left_semi").select("id", "parent"), "caught")
    return descendants(tree).unionByName(below_rings(lost))
