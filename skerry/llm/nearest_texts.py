"""Near-duplicate texts by adaptive multi-match prefixes.

Every document is its set of words. Words are ordered by a fixed-size frequency sketch, rarest
first. If two sets of sizes a >= b have Jaccard likeness >= t, then for every level l their first l
common words lie within the first ``a - ceil(t a) + l`` words of the larger set (its probe prefix)
and within the first ``b - ceil(2t/(1+t) b) + l`` words of the smaller one (its index prefix).

Level 1 joins on single prefix words. Where the estimated number of index postings under a word is
above the cost bound the prefix is lengthened by one and two common words are required, then three:
the key is the pair or triple, in prefix order, so nothing is lost and nothing is enumerated under a
frequent word. Whether a key is extended depends on the key alone, so both documents decide alike. A triple that is still
frequent is split by subject: documents of one subject meet under a key of their own, and those without a subject
meet the others under two more.

All estimates come from sketches of 2^22 (words) and 2^20 counters (keys); their size does not depend on the data, and they
are the only thing that reaches the driver. A word whose counter says it stands in one document only is in no posting. A collision in a sketch only moves a word in the order or
extends a key early, never changes a result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.sources.durable import durable

BITS, DF_BITS = 20, 22
SIZE, DF_SIZE = 1 << BITS, 1 << DF_BITS
#: Marks of the keys that a frequent triple is split into: of one subject, probed by those without one, probed for those without one.
_SUBJECT, _LONE, _MATE = 1, 2, 3
MIN_COST = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_list(text: Column) -> Column:
    """Distinct longest runs of letters and digits of the lower-cased text; null text has none."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), ""))


def word_hashes(text: Column) -> Column:
    """The same words as 64-bit hashes."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def _join_key(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (key.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ (word.view(np.uint64) * _MIX)
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _bucket(key: np.ndarray) -> np.ndarray:
    return key & (SIZE - 1)


def _ordered(batch: pa.RecordBatch, df: np.ndarray):
    """Words of a batch in sketch order: (hash, row, position, words in the row, cost)."""
    arr = batch.column(batch.schema.get_field_index("h"))
    off = arr.offsets.to_numpy().astype(np.int64)
    h = arr.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(np.int64)
    off = off - off[0]
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    cost = df[h & (DF_SIZE - 1)]
    order = np.lexsort((h, cost, row))
    h, cost = h[order], cost[order]
    return h, row, np.arange(len(h)) - off[row], n, cost


def _bitmap(batch: pa.RecordBatch) -> np.ndarray:
    """64 bits for each row, one set by every word. Two sets differ in at least as many words as their bitmaps in bits."""
    arr = batch.column(batch.schema.get_field_index("h"))
    off = arr.offsets.to_numpy().astype(np.int64)
    h = arr.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(np.int64).view(np.uint64)
    return np.bitwise_or.reduceat(np.uint64(1) << ((h >> np.uint64(DF_BITS)) & np.uint64(63)), off[:-1] - off[0]).view(np.int64)


def _extend(at: np.ndarray, key: np.ndarray, first: np.ndarray, h, row, pos, limit):
    """Every key together with every later word of its row below the row's limit, which is at most its number of words."""
    room = np.maximum(limit[row[at]] - 1 - pos[at], 0)
    src = np.repeat(np.arange(len(at)), room)
    step = np.arange(len(src)) - np.repeat(np.cumsum(room) - room, room) + 1
    nxt = at[src] + step
    return nxt, _join_key(key[src], h[nxt]), first[src]


def _probe(n, t):
    return n - _ceil(t * n)


def _index(n, t):
    return n - _ceil(2 * t / (1 + t) * n)


def _index_sketch(df, bound, depth, t):
    """Partial sketches of index postings: level 1 only for words above the bound, deeper levels
    only for what level 1 may hand on."""

    def run(batches):
        total = np.zeros((depth, SIZE), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            h, row, pos, n, cost = _ordered(b, df)
            lim = _index(n, t)
            at = np.flatnonzero((pos < (lim + 1)[row]) & (cost > bound))
            key, first = _join_key(h[at] * 0, h[at]), pos[at]
            total[0] += np.bincount(_bucket(key), minlength=SIZE)
            for level in range(1, depth):
                at, key, first = _extend(at, key, first, h, row, pos, np.minimum(lim + level + 1, n))
                total[level] += np.bincount(_bucket(key), minlength=SIZE)
        for level in range(depth):
            at = np.flatnonzero(total[level])
            for i in range(0, len(at), 1 << 16):
                s = at[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(s + level * SIZE), pa.array(total[level][s])], names=["bucket", "n"])

    return run


def _postings(df_b, sketch_b, bound, depth, t):
    """Prefix postings (key, doc, subject, meta, bits): meta holds the size, the place of the first prefix word and whether
    the posting probes and is indexed; bits has a bit for each word, so that sets which differ too much are told apart unseen. Of copies with one subject in a batch
    only the least doc is kept, so that a group of copies that holds a third of all rows shrinks before the shuffle."""

    def run(batches):
        df, sketch = df_b.value, sketch_b.value
        for b in batches:
            if not b.num_rows:
                continue
            doc, subject = (b.column(b.schema.get_field_index(c)) for c in ("doc", "subject"))
            # the same 128 bits that name a class
            marks = [b.column(b.schema.get_field_index(c)).to_numpy() for c in ("s1", "s2")]
            marks += [subject.fill_null(0).to_numpy(), subject.is_null().to_numpy(zero_copy_only=False)]
            order = np.lexsort((doc.to_numpy(), *marks))
            same = np.zeros(len(order), bool)
            same[1:] = np.logical_and.reduce([m[order][1:] == m[order][:-1] for m in marks])
            keep = np.sort(order[~same])
            b = b.take(pa.array(keep))
            subject = b.column(b.schema.get_field_index("subject"))
            own, none = subject.fill_null(0).to_numpy().astype(np.int64), subject.is_null().to_numpy(zero_copy_only=False)
            bits = _bitmap(b)
            h, row, pos, n, cost = _ordered(b, df)
            probe, index = _probe(n, t), _index(n, t)
            at = np.flatnonzero((pos < (probe + 1)[row]) & (cost > 1))
            key, first = _join_key(h[at] * 0, h[at]), pos[at]
            out = []
            for level in range(depth):
                if level == 0:
                    seen = sketch[0][_bucket(key)]
                    cheap = (cost[at] <= bound) | ((seen > 0) & (seen <= bound))
                    dear = (cost[at] > bound) & (seen > bound)
                else:
                    seen = sketch[level][_bucket(key)]
                    cheap = (seen > 0) & (seen <= bound)
                    dear = seen > bound
                r = row[at]
                indexed = pos[at] < (index + level + 1)[r]
                out.append((key[cheap], r[cheap], first[cheap], 2 | indexed[cheap]))
                if level == depth - 1:  # still frequent: by subject
                    k, r, f, i = key[dear], r[dear], first[dear], indexed[dear].astype(np.int64)
                    lone = none[r]
                    split = np.where(lone, _join_key(k, np.full(len(k), _LONE)), _join_key(k, _join_key(own[r], np.full(len(k), _SUBJECT))))
                    out.append((split, r, f, 2 | i))  # of one subject; without one: probes all, and is met by its like
                    mate = ~lone
                    out.append((_join_key(k, np.full(len(k), _MATE))[mate], r[mate], f[mate], np.full(int(mate.sum()), 2)))  # probes those without
                    into = np.where(lone, _join_key(k, np.full(len(k), _MATE)), _join_key(k, np.full(len(k), _LONE)))
                    into, r, f = (x[i == 1] for x in (into, r, f))
                    out.append((into, r, f, np.full(len(r), 1)))  # is met across
                    break
                at, key, first = at[dear], key[dear], first[dear]
                if not len(at):
                    break
                at, key, first = _extend(at, key, first, h, row, pos, np.minimum(probe + level + 2, n))
            key, r, first, idx = (np.concatenate(x) for x in zip(*out))
            col = lambda c: b.column(b.schema.get_field_index(c)).take(pa.array(r))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), col("doc"), col("subject"), pa.array((n[r] << 32 | first << 2 | idx).astype(np.int64)), pa.array(bits[r])],
                names=["key", "doc", "subject", "meta", "bits"],
            )

    return run


def _collect_sketch(counts: DataFrame, cells: int) -> np.ndarray:
    """Counters by bucket; at most ``cells`` rows by construction."""
    most = F.lit((1 << 31) - 1)
    rows = counts.select(F.col("bucket").cast("int"), F.least("n", most).cast("int").alias("n")).toArrow()  # eight bytes a cell
    out = np.zeros(cells, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def _id_filter(ids: DataFrame):
    """A column condition on a doc column that holds for all the given ids: a bitmap of 2^20 hashed ids, whatever their number."""
    cells = ids.select(F.col("id").cast("long").alias("id")).select(F.xxhash64("id").bitwiseAND(SIZE - 1).alias("bucket")).distinct()
    bits = np.zeros(SIZE, bool)
    bits[cells.toArrow().column("bucket").to_numpy()] = True
    masks = np.packbits(bits, bitorder="little").view(np.int64).tolist()

    def holds(col: Column) -> Column:
        at = F.xxhash64(col).bitwiseAND(SIZE - 1)
        mask = F.element_at(F.lit(masks), (F.shiftright(at, 6) + 1).cast("int"))
        return F.getbit(mask, at.bitwiseAND(63).cast("int")) == 1

    return holds


def similar_classes(docs: DataFrame, threshold: float = 0.75):
    """docs (doc long, subject long or null, text string) -> (members, pairs).

    members (doc, class, subject, s1, s2): only documents that share their word set with another one; those of one
    subject share a class, named by its least doc. pairs (class_a, class_b), class_a < class_b: classes whose subjects
    agree or are null on a side and whose word sets reach the threshold. A document that is no
    member is a class of its own. Copies are never expanded."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    hashed = docs.select("doc", "subject", word_hashes(F.col("text")).alias("w")).where(F.size("w") > 0)
    ordered = F.sort_array("w")
    # words are cut into 32 bits here, for the prefixes only: equal words stay equal, so no pair is lost, and what is
    # written is a fraction of the texts. Likeness is computed on the texts' own words in the end.
    short = F.transform("w", lambda w: F.shiftright(w, 32).cast("int"))
    hashed = durable(hashed.select("doc", "subject", F.xxhash64(ordered).alias("s1"), F.xxhash64(F.lit(1), ordered).alias("s2"), short.alias("h")), "words")
    sets = hashed.select("doc", "subject", "s1", "s2")
    shared = sets.groupBy("s1", "s2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("s1", "s2")
    copies = durable(sets.join(shared, ["s1", "s2"], "left_semi").distinct(), "copies")
    classes = copies.groupBy("s1", "s2", "subject").agg(F.min("doc").alias("class"))
    c = classes.select("class", *(F.col(x).alias(x + "_") for x in ("subject", "s1", "s2")))
    same_class = (F.col("s1") == F.col("s1_")) & (F.col("s2") == F.col("s2_")) & F.col("subject").eqNullSafe(F.col("subject_"))
    members = durable(copies.join(c, same_class).select("doc", "class", "subject", "s1", "s2"), "members")

    bucket = F.col("w").bitwiseAND(DF_SIZE - 1)
    counts = hashed.select(F.explode("h").alias("w")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    df = _collect_sketch(counts, DF_SIZE)
    bound = max(MIN_COST, 4 * int(df.sum()) // DF_SIZE)
    depth = max(1, min(3, math.ceil(threshold / (1 - threshold) - 1e-9))) if threshold < 1 else 1
    df_b = sc.broadcast(df.astype(np.int32))

    def sketching(batches):
        yield from _index_sketch(df_b.value, bound, depth, threshold)(batches)

    partial = hashed.select("h").mapInArrow(sketching, "bucket long, n long")
    cells = _collect_sketch(partial.groupBy("bucket").agg(F.sum("n").alias("n")), depth * SIZE).reshape(depth, SIZE)
    sketch_b = sc.broadcast(cells.astype(np.int32))

    posts = hashed.select("doc", "subject", "s1", "s2", "h").mapInArrow(_postings(df_b, sketch_b, bound, depth, threshold), "key long, doc long, subject long, meta long, bits long")
    a = posts.where(F.col("meta").bitwiseAND(2) == 2).select("key", F.col("doc").alias("a"), F.col("subject").alias("sa"), F.col("meta").alias("ma"), F.col("bits").alias("va"))
    b = posts.where(F.col("meta").bitwiseAND(1) == 1).select(
        F.col("key").alias("kb"), F.col("doc").alias("b"), F.col("subject").alias("sb"), F.col("meta").alias("mb"), F.col("bits").alias("vb")
    )
    na, pa_ = F.shiftright("ma", 32), F.shiftright("ma", 2).bitwiseAND((1 << 30) - 1)
    nb, pb_ = F.shiftright("mb", 32), F.shiftright("mb", 2).bitwiseAND((1 << 30) - 1)
    meet = (
        (F.col("key") == F.col("kb"))
        & ((nb < na) | ((nb == na) & (F.col("b") < F.col("a"))))
        & (F.bit_count(F.col("va").bitwiseXOR(F.col("vb"))) <= (na + nb) * F.lit((1 - threshold) / (1 + threshold)) + 1e-9)
        & (F.col("sa").isNull() | F.col("sb").isNull() | (F.col("sa") == F.col("sb")))
        & (nb >= na * threshold - 1e-9)
        & (F.least(na - pa_, nb - pb_) >= (na + nb) * F.lit(threshold / (1 + threshold)) - 1e-9)
    )
    found = a.join(b, meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cand = durable(found, "candidates")
    wanted = _id_filter(cand.select(F.col("a").alias("id")).union(cand.select("b")))
    held = docs.where(wanted(F.col("doc"))).select("doc", word_hashes(F.col("text")).alias("w"))
    left, right = held.select(F.col("doc").alias("a"), F.col("w").alias("wa")), held.select(F.col("doc").alias("b"), F.col("w").alias("wb"))
    near = cand.join(left, "a").join(right, "b")
    near = near.withColumn("i", F.size(F.array_intersect("wa", "wb"))).withColumn("u", F.size("wa") + F.size("wb") - F.col("i"))
    close = near.where(F.col("i") >= F.col("u") * threshold - 1e-9).select("a", "b").distinct()
    # copies that met in different batches stand for their class
    name = members.select("doc", "class")
    close = close.join(name.select(F.col("doc").alias("a"), F.col("class").alias("ca")), "a", "left").join(name.select(F.col("doc").alias("b"), F.col("class").alias("cb")), "b", "left")
    ca, cb = F.coalesce("ca", "a"), F.coalesce("cb", "b")
    pairs = close.select(F.least(ca, cb).alias("class_a"), F.greatest(ca, cb).alias("class_b")).where("class_a <> class_b").distinct()
    return members, durable(pairs, "pairs")


def similar_pairs(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """All pairs (a, b), a < b, of different documents whose subjects agree or are null on a side
    and whose word sets are alike to the threshold or more. Rows with a null doc are no documents; repeated
    rows count once; texts without words are like no other. Words are compared as 64-bit hashes."""
    docs = docs.where("doc IS NOT NULL")
    members, pairs = similar_classes(docs, threshold)
    x = members.select(F.col("class").alias("class_a"), F.col("doc").alias("x"))
    y = members.select(F.col("class").alias("class_b"), F.col("doc").alias("y"))
    across = pairs.join(x, "class_a", "left").join(y, "class_b", "left").select(F.coalesce("x", "class_a").alias("x"), F.coalesce("y", "class_b").alias("y"))
    m1 = members.select(F.col("doc").alias("x"), F.col("subject").alias("sx"), "s1", "s2")
    m2 = members.select(F.col("doc").alias("y"), F.col("subject").alias("sy"), F.col("s1").alias("z1"), F.col("s2").alias("z2"))
    alike = (F.col("s1") == F.col("z1")) & (F.col("s2") == F.col("z2"))
    same = m1.join(m2, alike & (F.col("sx") == F.col("sy")) & (F.col("x") < F.col("y"))).select("x", "y")
    lone = m1.where("sx IS NULL").join(m2, alike & (F.col("sy").isNotNull() | (F.col("x") < F.col("y")))).select("x", "y")
    return across.unionByName(same).unionByName(lone).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def linked_classes(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(doc, class, links): every document with the least id of those that share its subject and its set of words, and the
    number of other classes whose set is alike and whose subject it may meet. No copies are expanded.

    Rows with a null doc are no documents; repeated rows count once; texts without words are classes of their own without links."""
    docs = docs.where("doc IS NOT NULL")
    members, pairs = similar_classes(docs, threshold)
    links = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    named = docs.select("doc").distinct().join(members.select("doc", "class"), "doc", "left").select("doc", F.coalesce("class", "doc").alias("class"))
    return named.join(links, "class", "left").select("doc", "class", F.coalesce("links", F.lit(0)).alias("links"))
