import itertools
import random

import numpy as np

from skerry.llm import packing
from skerry.llm.packing import best_fit, complete, fill_report, fillings, lower_bound, pack


def optimum(sizes, cap):
    best = len(sizes)
    for order in itertools.permutations(sizes):
        bins = []
        for s in order:
            for i, b in enumerate(bins):
                if b + s <= cap:
                    bins[i] += s
                    break
            else:
                bins.append(s)
        best = min(best, len(bins))
    return best


def test_optimal_on_small_sets():
    random.seed(5)
    for _ in range(60):
        cap = random.choice([10, 17, 30])
        sizes = [random.randint(1, cap) for _ in range(7)]
        got = complete(sizes, cap, 5000)
        assert sorted(i for b in got for i in b) == list(range(7)) and all(sum(sizes[i] for i in b) <= cap for b in got)
        assert lower_bound(np.array(sizes), cap) <= optimum(sizes, cap) == len(got)


def full_windows(rnd, windows, cap, parts):
    """Sizes that fill so many windows to the brim, each with so many items."""
    out = []
    for _ in range(windows):
        marks = sorted(rnd.sample(range(1, cap), parts - 1))
        out += [b - a for a, b in zip([0, *marks], [*marks, cap])]
    return sorted(out, reverse=True)


def test_search_beats_best_fit():
    rnd = random.Random(4)
    won = {}
    for parts in (3, 5):
        for _ in range(12):
            sizes = full_windows(rnd, 9, 97, parts)
            fit, got = len(best_fit(sizes, 97)), len(complete(sizes, 97, 5000))
            assert 9 <= got <= fit
            won[parts] = won.get(parts, 0) + (got < fit)
    assert won[3] >= 6 and won[5] >= 4


def undominated(left, room, least):
    """By trying every subset: nothing could be added, and no size put for a smaller one."""
    out = set()
    for r in range(len(left) + 1):
        for c in itertools.combinations(left, r):
            rest, free = list(left), room - sum(c)
            for x in c:
                rest.remove(x)
            if least <= sum(c) <= room and not any(x <= free for x in rest) and not any(y < x <= y + free for y in c for x in rest):
                out.add(tuple(sorted(c, reverse=True)))
    return out


def test_fillings_are_the_undominated_ones():
    rnd = random.Random(2)
    for _ in range(200):
        left = sorted(rnd.randint(1, 12) for _ in range(rnd.randint(0, 7)))
        room = rnd.randint(0, 30)
        got = list(fillings(left, room, room - 8))
        assert len(got) == len(set(got)) and set(got) == undominated(left, room, room - 8)
        assert [sum(f) for f in got] == sorted(map(sum, got), reverse=True)


def test_documents(spark):
    rnd = random.Random(1)
    docs = [(i, " ".join("word" for _ in range(rnd.choice([1, 3, 40, 90, 130, 700])))) for i in range(80)] + [(80, ""), (81, None), (None, "x"), (0, "word")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS shard", "3 AS bin", "4 AS n_tokens")
    windows = spark.createDataFrame([("a", 128), ("b", 1000), ("zero", 0), (None, 5)], "window_name string, capacity_tokens int")
    rows = pack(df, windows).collect()
    for name, cap in (("a", 128), ("b", 1000)):
        own = [r for r in rows if r.window_name == name]
        fill, parts = {}, {}
        for r in own:
            fill.setdefault(r.bin, []).append(r)
            parts.setdefault(r.doc_id, []).append(r)
        for b in fill.values():
            at = 0
            for r in sorted((x for x in b if x.n_tokens), key=lambda x: x.place):
                assert r.offset == at
                at += r.n_tokens
            assert at <= cap
        assert set(parts) == set(range(82))
        for p in parts.values():
            p.sort(key=lambda x: x.part)
            assert [x.start_token for x in p] == [cap * k for k in range(len(p))] and (len(p) == 1 or all(x.n_tokens == cap for x in p[:-1]))
    assert {r.window_name for r in rows} == {"a", "b"}
    for r in fill_report(df, windows).collect():
        own = [x for x in rows if x.window_name == r.window_name]
        assert r.windows == len({x.bin for x in own if x.n_tokens}) and r.tokens == sum(x.n_tokens for x in own)
        assert r.bound <= r.windows <= r.bound + 1 and r.won <= r.searched <= r.shards == 1
    assert fill_report(df.limit(0), windows).count() == 0
    assert pack(df.limit(0), windows).count() == 0


def test_alike_sizes_are_not_tried_in_every_combination():
    left = [290, 291, 292, 292, 296, *(297,) * 3, 298, 298, 301, 301, 302, *(304,) * 3, 305, 305, 306, *(307,) * 5, 308, 308, *(310,) * 3, 311, 312, *(313,) * 3, 315, 315, *(316,) * 3]
    looks = [2000]
    got = list(fillings(left, 3778, 3709, looks=looks))  # twelve of 39 sizes: all but one of billions of fillings are dominated
    assert got == [tuple(left[:-13:-1])] and looks[0] > 0


def test_search_without_looks_left_still_packs_everything(monkeypatch):
    monkeypatch.setattr(packing, "LOOKS_A_STEP", 1)
    rnd = random.Random(4)
    for looks in (1, 7, 60):
        sizes = full_windows(rnd, 9, 97, 5)
        got = complete(sizes, 97, looks)
        assert sorted(i for b in got for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 97 for b in got)
        assert len(got) <= len(best_fit(sizes, 97))
