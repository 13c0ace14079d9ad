"""Filling fixed-capacity windows with whole documents by bin completion.

Documents are hashed into shards of some hundreds of windows each, packed independently: every
task gets a bounded number of items however many there are, and a shard wastes less than one window
against packing all at once. Within a shard the largest remaining document is taken and its
undominated fillings, of any number of documents, are tried, fullest first; a branch ends where its waste exceeds
what the best packing so far leaves room for. Reachable sums are kept as bit sets, one for every number of the
smallest documents, so enumerating fillings never runs into a dead end. Best-fit decreasing gives the first incumbent, and a
shard whose incumbent meets the lower bound is not searched at all. The search stops after ``steps`` fillings, or
``LOOKS_A_STEP`` times as many sizes looked at, and then keeps the incumbent: always a complete packing. ``fill_report`` says how often it won and what the bound leaves.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.tokens import VOCABULARY, with_token_counts
from skerry.sources.durable import durable

WINDOWS_A_SHARD = 256
ITEMS_A_SHARD = 4096
SEARCH_STEPS = 300
#: Sizes looked at for each of these steps, on average, before the search stops all the same.
LOOKS_A_STEP = 1000
MOST_WINDOW_KINDS = 100


def best_fit(sizes: list[int], cap: int) -> list[list[int]]:
    """sizes in falling order -> bins of indexes."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    for i, s in enumerate(sizes):
        at = bisect_left(room, (s, -1))
        if at == len(room):
            bins.append([i])
            insort(room, (cap - s, len(bins) - 1))
        else:
            free, b = room.pop(at)
            bins[b].append(i)
            insort(room, (free - s, b))
    return bins


def lower_bound(sizes: np.ndarray, cap: int) -> int:
    """Windows any packing needs: the best over a of the bound by items above cap - a, above half, and from a up."""
    s = np.sort(sizes)[::-1].astype(np.int64)
    total = np.concatenate([[0], np.cumsum(s)])
    half = int(np.searchsorted(-s, -cap / 2, "left"))  # items above half
    a = np.unique(np.concatenate([[0], s[half:]]))
    n1 = np.searchsorted(-s, -(cap - a), "left")
    n3 = np.searchsorted(-s, -a, "right")
    free = (half - n1) * cap - (total[half] - total[n1])
    more = np.maximum(0, -(-(total[np.maximum(n3, half)] - total[half] - free) // cap))
    return int((half + more).max()) if len(s) else 0


class Sums:
    """Which sums the k smallest of the ascending sizes reach, for every k, as bit sets up to cap."""

    def __init__(self, cap: int):
        self.cap, self.mask = cap, (1 << cap + 1) - 1
        self.reach = [1]

    def upto(self, left: list[int]) -> list[int]:
        for s in left[len(self.reach) - 1 :]:
            r = self.reach[-1]
            self.reach.append((r | r << s) & self.mask)
        return self.reach

    def changed(self, at: int) -> None:
        """The sizes from index at on are others now."""
        del self.reach[at + 1 :]


def fillings(left: list[int], room: int, least: int, sums: Sums | None = None, looks: list[int] | None = None):
    """Undominated fillings of room from the ascending sizes left that hold at least ``least``, fullest first, lazily.

    Of equal totals those with larger items come first. A filling is dominated, and left out, if another size fits that
    could be added, or put for a smaller one of its own: whatever packs the rest then packs it after the exchange too.
    A size that is left out rules out at once all that it could be put for, so many alike sizes are not tried in every
    combination. looks, if given, holds how many sizes may still be looked at; with none the fillings end early."""
    n = bisect_right(left, room)
    if not n:
        if least <= 0:
            yield ()
        return
    sums = sums or Sums(room)
    reach = sums.upto(left)
    have = reach[n] & ((1 << room + 1) - 1)
    while have:
        total = have.bit_length() - 1
        if total < least:
            return
        have ^= 1 << total
        free = room - total
        stack = [(n, total, (), room + 1)]
        while stack:
            if looks is not None:
                if not looks[0]:
                    return
                looks[0] -= 1
            k, t, taken, out = stack.pop()  # out: the least size left out so far
            if not t:
                if (left[0] if k else out) > free:
                    yield taken
                    reach = sums.upto(left)  # left has been used and put back meanwhile
                continue
            fit = min(bisect_right(left, t, 0, k), bisect_left(left, out - free, 0, k))
            while fit < k:  # all from there on are left out, and with them what they could be put for
                k, out = fit, left[fit]
                fit = bisect_left(left, out - free, 0, k)
            if not reach[k] >> t & 1:
                continue
            s = left[k - 1]
            lower = bisect_left(left, s, 0, k)  # the next smaller size: leaving one copy out leaves out all
            if s > free and reach[lower] >> t & 1:
                stack.append((lower, t, taken, s))
            if reach[k - 1] >> (t - s) & 1:
                stack.append((k - 1, t - s, (*taken, s), out))


def complete(sizes: list[int], cap: int, steps: int = SEARCH_STEPS) -> list[list[int]]:
    """Packs sizes (each 1..cap): bins of indexes into sizes."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    falling = [sizes[i] for i in order]
    best = best_fit(falling, cap)
    need = lower_bound(np.array(falling), cap) if sizes else 0
    if len(best) > need:
        found = _search(falling, cap, need, len(best), steps)
        if found is not None:
            by_size: dict[int, list[int]] = {}
            for i, s in enumerate(falling):
                by_size.setdefault(s, []).append(i)
            best = [[by_size[s].pop() for s in b] for b in found]
    return [[order[i] for i in b] for b in best]


def _search(falling: list[int], cap: int, need: int, most: int, steps: int):
    """Depth first over fillings, without recursion; the first packing in ``need`` windows, else the best found."""
    total, best, target = sum(falling), None, most - 1
    left, sums, looks = falling[::-1], Sums(cap), [steps * LOOKS_A_STEP]
    stack: list[tuple] = []  # the largest item, its untried fillings, the waste before it
    packed: list[tuple[int, ...]] = []

    def put_back(sizes):
        for s in sizes:
            at = bisect_left(left, s)
            left.insert(at, s)
            sums.changed(at)

    def take(sizes):
        for s in sizes:
            at = bisect_left(left, s)
            del left[at]
            sums.changed(at)

    down = True
    while steps and looks[0]:
        if down:
            if not left:
                best, target = [list(b) for b in packed], len(packed) - 1
                if len(packed) <= need:
                    return best
                down = False
                continue
            big = left.pop()
            sums.changed(len(left))
            before = stack[-1][3] if stack else 0
            stack.append([big, fillings(left, cap - big, cap - big - (target * cap - total - before), sums, looks), before, 0])
        elif len(packed) == len(stack):  # put the last choice back
            put_back(packed.pop()[1:])
        down = False
        big, options, before, _ = stack[-1]
        f = next(options, None) if target >= need else None
        if f is not None:
            steps -= 1
            lost = before + cap - big - sum(f)
            if lost <= target * cap - total:
                take(f)
                packed.append((big, *f))
                stack[-1][3] = lost
                down = True
                continue
        put_back([big])  # no filling left, or the rest is emptier still
        stack.pop()
        if not stack:
            break
    return best


def _items(docs: DataFrame, windows: DataFrame, vocabulary: str) -> DataFrame | None:
    """(doc_id, n, window_name, capacity_tokens, shard), every document once for each window kind; None if there are none."""
    kinds = windows.where("window_name IS NOT NULL AND capacity_tokens > 0").select("window_name", "capacity_tokens").distinct().limit(MOST_WINDOW_KINDS + 1).collect()
    if len(kinds) > MOST_WINDOW_KINDS:
        raise ValueError(f"more than {MOST_WINDOW_KINDS} window kinds; windows must be a small dimension")
    sized = with_token_counts(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), "text", vocabulary)
    sized = durable(sized.groupBy("doc_id").agg(F.max("n_tokens").alias("n")), "sizes")
    stats = sized.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).first()
    if not kinds or not stats["docs"]:
        return None
    shards = [max(1, round(stats["tokens"] / (r.capacity_tokens * WINDOWS_A_SHARD)), -(-stats["docs"] // ITEMS_A_SHARD)) for r in sorted(kinds)]
    each = F.array(*(F.struct(F.lit(r.window_name).alias("window_name"), F.lit(r.capacity_tokens).alias("capacity_tokens"), F.lit(n).alias("shards")) for r, n in zip(sorted(kinds), shards)))
    return sized.select("doc_id", "n", F.explode(each).alias("w")).select(
        "doc_id", "n", "w.window_name", "w.capacity_tokens", F.pmod(F.xxhash64("doc_id"), F.col("w.shards")).alias("shard")
    )


def _pieces(pdf: pd.DataFrame, cap: int):
    """(full windows as (doc, part), items as (doc, part, size) below or at the capacity, documents without tokens) of a shard."""
    full, items, empty = [], [], []
    for d, s in sorted(zip(pdf["doc_id"].tolist(), pdf["n"].tolist())):
        parts = s // cap if s > cap else 0
        full += [(d, part) for part in range(parts)]
        if s - cap * parts:
            items.append((d, parts, s - cap * parts))
        elif not s:
            empty.append(d)
    return full, items, empty


def pack(docs: DataFrame, windows: DataFrame, vocabulary: str = VOCABULARY, steps: int = SEARCH_STEPS) -> DataFrame:
    """docs (doc_id, text), windows (window_name, capacity_tokens) ->
    (window_name, capacity_tokens, bin, place, offset, doc_id, part, start_token, n_tokens).

    Every document comes out once for each window kind, whole; only one longer than the capacity
    is cut into full windows and a rest, which is packed like a document (part numbers its pieces).
    Documents without tokens get length 0 in some window. Repeated doc_ids count once, null ones are
    dropped; window kinds without a positive capacity are ignored."""
    schema = "window_name string, capacity_tokens int, bin long, place int, offset int, doc_id long, part int, start_token int, n_tokens int"
    items = _items(docs, windows, vocabulary)
    if items is None:
        return docs.sparkSession.createDataFrame([], schema)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, cap, base = key[0], int(key[1]), int(key[2]) << 24
        full, items, empty = _pieces(pdf, cap)
        rows = [(base + i, 0, 0, d, part, part * cap, cap) for i, (d, part) in enumerate(full)]
        for used, b in enumerate(complete([i[2] for i in items], cap, steps), len(full)):
            at = 0
            for place, i in enumerate(b):
                d, part, s = items[i]
                rows.append((base + used, place, at, d, part, part * cap, s))
                at += s
        rows.extend((base, 0, 0, d, 0, 0, 0) for d in empty)
        out = pd.DataFrame(rows, columns=["bin", "place", "offset", "doc_id", "part", "start_token", "n_tokens"])
        out.insert(0, "window_name", name)
        out.insert(1, "capacity_tokens", cap)
        return out

    return items.groupBy("window_name", "capacity_tokens", "shard").applyInPandas(run, schema)


def fill_report(docs: DataFrame, windows: DataFrame, vocabulary: str = VOCABULARY, steps: int = SEARCH_STEPS) -> DataFrame:
    """(window_name, capacity_tokens, windows, bound, tokens, filled, shards, searched, won) of what ``pack`` does.

    bound is the number of windows that no packing of the shards can do without; searched are the shards whose best fit
    missed it, won those where the search beat best fit."""
    schema = "window_name string, capacity_tokens int, windows long, bound long, tokens long, searched int, won int"
    items = _items(docs, windows, vocabulary)
    if items is None:
        return docs.sparkSession.createDataFrame([], schema.replace("searched", "filled double, shards long, searched").replace("int, won int", "long, won long"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cap = int(key[1])
        full, items, _ = _pieces(pdf, cap)
        sizes = sorted((i[2] for i in items), reverse=True)
        fit, need, got = len(best_fit(sizes, cap)), lower_bound(np.array(sizes, np.int64), cap), len(complete(sizes, cap, steps))
        row = (key[0], cap, len(full) + got, len(full) + need, int(pdf["n"].sum()), int(fit > need), int(got < fit))
        return pd.DataFrame([row], columns=["window_name", "capacity_tokens", "windows", "bound", "tokens", "searched", "won"])

    by = items.groupBy("window_name", "capacity_tokens", "shard").applyInPandas(run, schema)
    g = by.groupBy("window_name", "capacity_tokens").agg(
        F.sum("windows").alias("windows"), F.sum("bound").alias("bound"), F.sum("tokens").alias("tokens"), F.count("*").alias("shards"), F.sum("searched").alias("searched"), F.sum("won").alias("won")
    )
    return g.select("window_name", "capacity_tokens", "windows", "bound", "tokens", F.round(F.col("tokens") / (F.col("windows") * F.col("capacity_tokens")), 6).alias("filled"), "shards", "searched", "won")
