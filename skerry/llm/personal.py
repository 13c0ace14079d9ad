"""Personal data in free text by bootstrapped contextual extraction.

1. A pass over the texts cuts out candidates of four loose forms (e-mail, street address, number, name), each with
   its left and right context and an instance: the domain of an e-mail, the street word of an address, the pattern
   of a number's digits and letters, the surname. Some are seeds, because nothing else looks like them: an address
   with ``@``, a bracketed one or several spelled-out dots, a street with a postcode, floor or flat, a number with a country code, a known given name beside a
   capitalised word. All others are open, among them every capitalised pair of words and every house number
   beside a word, whatever the words are.
2. The graph of contexts (patterns) and instances is aggregated and scored in a few rounds: a pattern is as good as
   the instances in it, an instance as the patterns around it. Unlabelled instances count against a pattern, but
   little, so knowledge spreads from the seeds; for the open candidates they count fully.
3. Candidates in good patterns, or of an instance known from them, come out; the rest were look-alikes. Where several
   readings share an anchor (a house number, a run of capitalised words) the best one comes out.

The graph is aggregated before it is joined, so rounds cost by distinct contexts, not by texts. No list of street
words, domains or surnames is used. A name whose given name is in lower case or all capitals is a candidate only if that
name is known.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from bisect import bisect_left

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.sources.durable import durable

ROUNDS, DOUBT, HELD, ACCEPT = 4, 0.1, 0.4, 0.45
#: So many unlabelled instances are added to every pattern before it may speak for an open candidate: rare ones prove nothing.
RARE = 3.0
MOST_GIVEN_NAMES = 20_000

_UP = "A-ZÀ-ÖØ-ÞĀ-ŽА-Я"
_AT = re.compile(r"@|\s?[\[(][aA][tT][\])]|(?<=\w)\s[aA][tT](?=\s)")
_DOMAIN = re.compile(r"(?:[\w-]+\.)+[A-Za-z][\w-]*(?![\w@]|:\w|/)")
_SPOKEN = re.compile(r"\s?[\w-]+(?:\s?(?:[\[(]dot[\])]|(?<=\s)dot)\s?[A-Za-z][\w-]*)+", re.I)
_DOTS = re.compile(r"\s?[\[(]?(?<![^\W_])dot(?![^\W_])[\])]?\s?", re.I)
#: A number of at most four digits that may be a house number.
_HOUSE = re.compile(r"(?<![\w.:/@#$+-])\d{1,4}[a-z]?(?![\w:/@%-])(?!\.\d)")
_WORD = r"[^\W\d_][^\W\d_]+"
_CAP = rf"[{_UP}][^\W\d_]+"
#: Towns: one word, or a usual first word with another. Those first words, and the words for parts of a house.
_PLACE = rf"(?:(?:Saint|Sankt|Port|Villa|San|St\.?|Bad|New|Old)[ -])?{_CAP}(?:-{_CAP})?"
_LOW_PLACE = _PLACE.replace(_CAP, _WORD)
_UNIT = r"(?: (?:apt|flat|unit)\.? \d+[a-z]?)"
_BRITISH = r"(?: [A-Z]{1,2}\d{1,2} \d[A-Z]{2}\b)"
_FLAT = re.compile(r"(?:flat|unit|suite) \d+[a-z]?, $", re.I)
#: What follows a house number: two or three capitalised words, a small word before capitalised ones, or small words and a town.
_AFTER = [
    re.compile(rf" ({_CAP}) ({_CAP}\.?)(?![\w-])(?i:{_UNIT})?(?:, {_PLACE}{_BRITISH}?)?"),
    re.compile(rf" ({_CAP} {_CAP}) ({_CAP}\.?)(?![\w-])(?i:{_UNIT})?(?:, {_PLACE}{_BRITISH}?)?"),
    re.compile(rf",? ()([a-zà-ÿ]{{3,}})(?: [a-zà-ÿ]{{2,3}}){{0,2}} {_CAP}(?![\w-])(?:, \d{{5}} {_PLACE})?"),
    re.compile(rf" ([a-zà-ÿ]+) ([a-zà-ÿ]{{2,}}\.?)(?i:{_UNIT})?, (?i:{_LOW_PLACE}{_BRITISH}?)"),
]
#: What stands before one: a compound of street name and street word, or a street word and a name.
_BEFORE = re.compile(rf"(?:({_WORD}) (?:de (?:la )?)?)?([{_UP}][^\W\d_]{{3,}}\.?) $")
_MORE = re.compile(rf"(?:, \d{{5}} {_PLACE})|, \d{{1,2}} ?[ºª] ?[A-Z]\b")
_SURE_STREET = re.compile(rf", \d{{5}} |\d ?[ºª] ?[A-Z]$|{_BRITISH}$|(?i:{_UNIT})")
_NUMBER = re.compile(
    r"(?<![\w/.@:#$-])(?:[A-Z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-D](?!\w)"
    r"|[A-Z]{1,2}\d{6,9}[A-Z]?(?!\w)|(?=[A-Z\d]{9}(?!\w))(?=\d*[A-Z])(?=(?:[A-Z]*\d){4})[A-Z\d]{9}"
    r"|[+(]?\d(?:[ ./()-]{0,2}\d){7,14}(?:-?[A-Z](?![A-Za-z]))?(?!\w))"
)
_DATE = re.compile(r"(?:19|20)\d\d-[01]\d-[0-3]\d(?!\d)|\d{1,3}(?:\.\d{1,3}){3}(?![.\d])")
_SURE_ID = re.compile(r"[A-Z]{2}(?:\s?\d\d){3}\s?[A-D]")
_TOKEN = re.compile(r"(?<!\w)[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*(?!\w)")
_CONTEXT = re.compile(r"\w+|[<(\[{\"':;,]")
#: A single capital, or the first of two capitalised words.
_START = re.compile(rf"(?<!\w)[{_UP}](?:(?!\w)|(?=[^\W\d_]{{2,}},? [{_UP}]))")
_RUN = re.compile(rf"{_CAP}(?:-{_CAP})?(?: (?:[{_UP}]\.? )?{_CAP}(?:-{_CAP})?(?![\w-]))+")
_SWAPPED = re.compile(rf"({_CAP}(?:-{_CAP})?), {_CAP}(?! ?[{_UP}]|[\w-])")
#: Words for parts of a house.
PARTS = {"flat", "unit", "suite", "apt"}
#: Titles and forms of address, never part of a name.
TITLES = {"dr", "prof", "mr", "mrs", "ms", "mx", "mme", "mlle", "herr", "frau", "señor", "señora", "sr", "sra", "signor", "signora", "senhor", "senhora", "de", "the"}


def fold(word: str) -> str:
    """Lower case without accents; written-out umlauts become plain vowels."""
    w = unicodedata.normalize("NFKD", word.lower().replace("ß", "ss"))
    w = "".join(c for c in w if not unicodedata.combining(c))
    return w.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def _context(text: str, start: int, end: int) -> tuple[str, str, str]:
    left = _CONTEXT.findall(text[max(0, start - 40) : start])[-2:]
    right = _CONTEXT.findall(text[end : end + 24])[:1]
    norm = lambda ws: " ".join("0" if w[0].isdigit() else w.lower() for w in ws)
    return norm(left), norm(left[-1:]), norm(right)


def _names(text: str, given: frozenset, since: int = 0, until: int | None = None):
    """(start, end, surname, seed) of candidates with a given name or an initial, left to right, none twice."""
    toks = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, since, len(text) if until is None else until)]
    out, i, n = [], 0, len(toks)

    def gap(k: int) -> str:  # between token k and the next
        return text[toks[k][1] : toks[k + 1][0]] if k + 1 < n else "\n"

    def initial(k: int) -> bool:
        return k < n and len(toks[k][2]) == 1 and toks[k][2].isupper()

    def blank(g: str) -> bool:
        return g.strip(" ") == "" and g != ""

    def cap(k: int) -> bool:
        return k < n and len(toks[k][2]) > 2 and toks[k][2][0].isupper()

    while i < n:
        s, e, w = toks[i]
        low = w.lower()
        if low in given:
            j = i + 1
            if initial(j) and blank(gap(i)) and gap(j) in (". ", " "):  # middle initial
                j += 1
                between = True
            else:
                between = blank(gap(i))
            if j < n and between and len(toks[j][2]) > 3 and toks[j][2].lower() not in given and (cap(j) or not w[0].isupper()):
                out.append((s, toks[j][1], fold(toks[j][2]), w[0].isupper() and cap(j)))
                i = j + 1
                continue
        elif initial(i) and gap(i) in (". ", ".") and i + 1 < n:
            j = i + 1
            if initial(j) and gap(j) in (". ", "."):
                j += 1
            titled = j < n and toks[j][2].lower() in given and blank(gap(j)) and cap(j + 1)  # M. for Monsieur
            if cap(j) and len(toks[j][2]) > 3 and not titled:
                out.append((s, toks[j][1], fold(toks[j][2]), False))
                i = j + 1
                continue
        elif len(w) > 3 and low not in TITLES and i + 1 < n:
            g = gap(i)
            if (g == ", " or (g == " " and w[0].isupper())) and toks[i + 1][2].lower() in given and toks[i + 1][2][0].isupper() == w[0].isupper():
                k = i + 1
                follows = k + 1 < n and blank(gap(k)) and cap(k + 1) and toks[k + 1][2].lower() not in given
                if initial(k + 1) and blank(gap(k)):
                    follows = gap(k + 1) in (". ", " ") and cap(k + 2)
                if not follows:
                    end = toks[k][1]
                    if initial(k + 1) and gap(k) == " ":
                        end = toks[k + 1][1] + (1 if text[toks[k + 1][1] : toks[k + 1][1] + 1] == "." and text[toks[k + 1][1] + 1 : toks[k + 1][1] + 2] not in ("", "\n") else 0)
                        k += 1
                    out.append((s, end, fold(w), False))
                    i = k + 1
                    continue
            elif w[0].isupper() and g in (", ", " ") and initial(i + 1) and (text[toks[i + 1][1] : toks[i + 1][1] + 1] == "." or g == " "):
                k = i + 1
                end = toks[k][1] + (text[toks[k][1] : toks[k][1] + 1] == ".")
                if initial(k + 1) and text[toks[k][1] : toks[k + 1][0]] in (". ", "."):
                    k += 1
                    end = toks[k][1] + (text[toks[k][1] : toks[k][1] + 1] == ".")
                if not (cap(k + 1) and text[end : toks[k + 1][0]] == " " and text[end - 1] == "." and g == " "):
                    out.append((s, end, fold(w), False))
                    i = k + 1
                    continue
        i += 1
    return out


def _mails(text: str):
    """(start, end, domain, seed) around every @ or spelled-out one."""
    for m in _AT.finditer(text):
        plain, s = m[0] == "@", m.start()
        if plain and s and text[s - 1] == " ":
            continue
        while s and (text[s - 1].isalnum() or text[s - 1] in "_.+-"):
            s -= 1
        while s < m.start() and text[s] in ".+-":
            s += 1
        after = (_DOMAIN if plain else _SPOKEN).match(text, m.end())
        if s == m.start() or not after or text[s : m.start()].lower() == "git":
            continue
        domain = _DOTS.sub(".", after[0]).strip().lower()
        yield s, after.end(), domain, plain or m[0][-1] in "])" or domain.count(".") > 1


def _streets(text: str):
    """(anchor, start, end, street word, seed) of every reading around a house number; what stands before the number and
    what follows it have anchors of their own."""
    for m in _HOUSE.finditer(text):
        at, end = m.start(), m.end()
        if text[end : end + 1] in " ,":
            for k, form in enumerate(_AFTER):
                a = form.match(text, end)
                if a:
                    flat = _FLAT.search(text, max(0, at - 16), at)
                    sure = bool(_SURE_STREET.search(a[0]))
                    yield 2 * at + 1, flat.start() if flat else at, a.end(), a[2].lower().rstrip("."), sure
                    if k > 1:
                        break
        if at and text[at - 1] == " ":
            b = _BEFORE.search(text, max(0, at - 60), at)
            if b and b[2].lower() not in PARTS:
                more = _MORE.match(text, end)
                stop = more.end() if more else end
                floor = more is not None and not more[0][2:7].isdigit()
                yield 2 * at, b.start(2), stop, "-" + b[2].lower()[-3:], more is not None and not floor
                if b[1] and b[1][0].isupper():
                    yield 2 * at, b.start(1), stop, b[1].lower(), floor


def candidates_of(text: str, given: frozenset, finder=None):
    """(group, anchor, start, end, instance, seed kind or None, open) of one text. Open are those that no seed, given
    name or initial speaks for; finder is the automaton of the given names."""
    out, taken = [], []
    for s, e, domain, sure in _mails(text):
        out.append(("email", s, s, e, domain, "email" if sure else None, not sure))
        taken.append((s, e))
    if taken:
        text = _blot(text, taken)
    houses = []
    for anchor, s, e, word, sure in _streets(text):
        out.append(("address", anchor, s, e, word, "address" if sure else None, not sure))
        if text[anchor // 2 :][:6].lstrip("0123456789abcdefghijklmnopqrstuvwxyz")[:1] != "," or not anchor % 2:
            houses.append((s, e, anchor, sure))
    for m in _NUMBER.finditer(text):
        v = m[0]
        if _DATE.match(v):
            continue
        digits = sum(c.isdigit() for c in v)
        seed = "phone" if v[0] == "+" and digits > 9 else "id_number" if _SURE_ID.fullmatch(v) else None
        out.append(("number", m.start(), m.start(), m.end(), re.sub("[A-Z]", "A", re.sub(r"\d", "0", v)), seed, False))
    starts = [m.start() for m in _START.finditer(text)]
    low = text.lower()
    spots = starts.copy()
    if finder is None or len(low) != len(text):
        spots = [0, len(text)] if text else []
    else:
        for at, size in finder.iter(low):
            if (at + 1 == len(low) or not low[at + 1].isalnum()) and (at < size or not low[at - size].isalnum()):
                spots.append(at + 1 - size)
    if not spots:
        return out
    found = []
    for lo, hi in _windows(text, sorted(spots), finder is None or len(low) != len(text)):
        found += _names(text, given, lo, hi)
    houses.sort()
    streets = _Spans([(a, b) for a, b, *_ in houses])
    for s, e, surname, sure in found:
        over = [(known, anchor) for _, _, anchor, known in (houses[i] for i in streets.over(s, e))]
        if not any(known for known, _ in over):  # beside an unsure house number the better reading comes out
            out.append(("name", over[0][1] if over else 2 * s, s, e, surname, "name" if sure else None, False))
    used = _Spans([(s, e) for s, e, *_ in found] + [(a, b) for a, b, *_ in houses])
    edge = -1
    for at in starts:  # capitalised words that no list knows
        if at < edge:
            continue
        run = _RUN.match(text, at)
        swapped = None if run else _SWAPPED.match(text, at)
        if run:
            edge = run.end()
            words = [(m.start() + at, m.end() + at) for m in re.finditer(r"[^\s.]{2,}|[^\s.](?=\.? )", run[0])]
            words = [w for w in words if w[1] - w[0] > 1]
            for (a, b), (c, d) in zip(words, words[1:]):
                if b - a > 2 and d - c > 2 and not used.meet(a, d) and text[a:b].lower() not in TITLES and not text[a:b].isupper():
                    out.append(("name", 2 * at, a, d, fold(text[c:d]), None, True))
        elif swapped and not used.meet(at, swapped.end()) and len(swapped[1]) > 2 and not text[swapped.end() - 2 : swapped.end()].isupper():
            out.append(("name", 2 * at, at, swapped.end(), fold(swapped[1]), None, True))
    return out


class _Spans:
    """Stretches of a text; whether one meets another is found in logarithmic time."""

    def __init__(self, spans):
        spans = sorted(spans)
        self.starts, self.own = [a for a, _ in spans], [b for _, b in spans]
        self.ends = list(itertools.accumulate((b for _, b in spans), max))  # the farthest end so far

    def over(self, s: int, e: int) -> list[int]:
        """Which ones meet it, in order; ends are farther the later a span begins, or nearly so."""
        k, out = bisect_left(self.starts, e), []
        while k and self.ends[k - 1] > s:
            k -= 1
            if self.own[k] > s:
                out.append(k)
        return out[::-1]

    def meet(self, s: int, e: int) -> bool:
        k = bisect_left(self.starts, e)
        return k > 0 and self.ends[k - 1] > s


def _blot(text: str, spans) -> str:
    parts, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            parts += [text[at:a], "\x00" * (b - a)]
            at = b
    return "".join([*parts, text[at:]])


def _windows(text: str, spots: list[int], whole: bool):
    """Stretches of text around the spots, cut at blanks (where there is one within 400 characters), joined where they meet."""
    if whole:
        return [(0, len(text))]
    out: list[list[int]] = []
    for at in spots:
        lo, hi = text.rfind(" ", max(0, at - 450), max(0, at - 50)) + 1, text.find(" ", at + 90, at + 490)
        lo, hi = lo or max(0, at - 450), min(len(text), at + 490) if hi < 0 else hi
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


SCHEMA = "table_name string, row_id long, group string, anchor int, start int, matched string, shape string, seed string, open boolean, left string, near string, right string"
_FINDERS: dict = {}


def _finder(given: frozenset):
    """One automaton of all given names a worker."""
    if given not in _FINDERS:
        a = ahocorasick.Automaton()
        for g in given:
            a.add_word(g, len(g))
        a.make_automaton()
        _FINDERS.clear()
        _FINDERS[given] = a
    return _FINDERS[given] if len(given) else None


def candidates(texts: DataFrame, given: frozenset) -> DataFrame:
    """texts (table_name, row_id, text) -> candidates with context and shape."""

    def run(batches):
        finder = _finder(given)
        for b in batches:
            tables, ids, body = (b.column(i).to_pylist() for i in range(3))
            cols: tuple[list, ...] = tuple([] for _ in range(12))
            for t, i, text in zip(tables, ids, body):
                for group, anchor, s, e, shape, seed, unsure in candidates_of(text, given, finder):
                    left, near, right = _context(text, s, e)
                    for c, v in zip(cols, (t, i, group, anchor, s, text[s:e], shape, seed, unsure, left, near, right)):
                        c.append(v)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), *(pa.string(),) * 3, pa.bool_(), *(pa.string(),) * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return texts.where("text IS NOT NULL AND row_id IS NOT NULL").select("table_name", "row_id", "text").mapInArrow(run, SCHEMA)


#: The kinds that candidates of a group may have; each group has two slots of scores.
KINDS = {"email": ("email",), "address": ("address",), "number": ("phone", "id_number"), "name": ("name",)}
SLOTS = ("a", "b")
#: Contexts: the two words before, the word before, the word after.
SIDES = ("left", "near", "right")


def kind_of(slot: str):
    """The kind that a slot stands for in the group of the row; null where a group has none."""
    at = SLOTS.index(slot)
    return F.element_at(F.create_map(*(F.lit(x) for g, ks in KINDS.items() if at < len(ks) for x in (g, ks[at]))), F.col("group"))


def context_score(k: str):
    """What the patterns around a candidate say for a kind: the two words before alone, or the words on both sides.
    For an open candidate only patterns that hold little else speak, and on both sides."""
    usual = F.greatest(F.col("l_" + k), (F.greatest("l_" + k, "n_" + k) + F.col("r_" + k)) / 2)
    strict = F.greatest(F.col("lx_" + k), F.sqrt(F.greatest("lx_" + k, "nx_" + k) * F.col("rx_" + k)))
    return F.when(F.col("open"), strict).otherwise(usual)


def score_graph(cand: DataFrame, rounds: int = ROUNDS) -> tuple[list[DataFrame], DataFrame]:
    """(patterns of each side, shapes), each with scores for each slot. Patterns have two: among the candidates that are
    not open, unlabelled ones count little; among all of them, fully."""
    edges = cand.groupBy("group", "open", "left", "near", "right", "shape").agg(F.count("*").alias("n"), *(F.count_if(F.col("seed") == kind_of(k)).alias("seed_" + k) for k in SLOTS))
    edges = durable(edges, "edges")
    shapes = edges.groupBy("group", "shape").agg(*((F.sum("seed_" + k) / F.sum("n")).alias("s_" + k) for k in SLOTS))
    base = shapes

    def patterns(side: str, scored: DataFrame) -> DataFrame:
        # only instances that are held for one kind by now speak for a pattern: faint scores would feed on themselves
        scored = scored.select("group", side, "n", F.when(F.col("open"), 0).otherwise(F.col("n")).alias("m"), *(F.when(F.col("s_" + k) >= HELD, F.col("s_" + k)).otherwise(0.0).alias("s_" + k) for k in SLOTS))
        known = F.sum(F.col("m") * F.least(sum((F.col("s_" + k) for k in SLOTS), F.lit(0.0)), F.lit(1.0)))
        usual = ((F.sum(F.col("m") * F.col("s_" + k)) / (known + F.lit(DOUBT) * (F.sum("m") - known) + F.lit(0.5))).alias(f"{side[0]}_{k}") for k in SLOTS)
        strict = ((F.sum(F.col("n") * F.col("s_" + k)) / (F.sum("n") + F.lit(RARE))).alias(f"{side[0]}x_{k}") for k in SLOTS)
        return scored.groupBy("group", side).agg(*usual, *strict)

    for _ in range(rounds):
        scored = edges.join(shapes, ["group", "shape"])
        around = edges
        for side in SIDES:
            around = around.join(patterns(side, scored), ["group", side])
        found = around.groupBy("group", "shape").agg(*((F.sum(F.col("n") * context_score(k)) / F.sum("n")).alias("f_" + k) for k in SLOTS))
        new = found.join(base, ["group", "shape"]).select("group", "shape", *(F.greatest("f_" + k, "s_" + k).alias("s_" + k) for k in SLOTS))
        shapes = durable(new, "shapes")
    scored = edges.join(shapes, ["group", "shape"])
    return [durable(patterns(side, scored), side) for side in SIDES], shapes


def find(texts: DataFrame, given_names: DataFrame) -> DataFrame:
    """texts (table_name, row_id, text), given_names (one column, a dimension of known given names) ->
    (table_name, row_id, kind, start, matched). Null and empty texts hold nothing; repeated rows count once."""
    given = [r[0] for r in given_names.distinct().limit(MOST_GIVEN_NAMES + 1).collect() if r[0]]
    if len(given) > MOST_GIVEN_NAMES:
        raise ValueError(f"more than {MOST_GIVEN_NAMES} given names; they must be a small dimension")
    cand = durable(candidates(texts, frozenset(g.lower() for g in given)), "candidates")
    patterns, shapes = score_graph(cand)
    both = cand.join(shapes, ["group", "shape"])
    for side, scored in zip(SIDES, patterns):
        both = both.join(scored, ["group", side])
    total = {k: F.when(F.col("seed") == kind_of(k), 2.0).otherwise(F.greatest(0.5 * F.col("s_" + k) + 0.5 * context_score(k), 0.6 * context_score(k))) for k in SLOTS}
    best = F.array_max(F.array(*(F.struct(F.when(kind_of(k).isNotNull(), total[k]).alias("score"), kind_of(k).alias("kind")) for k in SLOTS)))
    judged = both.withColumn("best", best).where(F.col("best.score") >= ACCEPT).select(
        "table_name", "row_id", F.col("best.kind").alias("kind"), "anchor", F.struct((F.col("best.kind") == "address").alias("street"), F.col("best.score").alias("score"), F.char_length("matched").alias("size"), "start", "matched", F.col("best.kind").alias("kind")).alias("found")
    )
    # readings of one house number or of one run of words exclude each other
    words = F.col("kind").isin("address", "name")
    read = judged.groupBy("table_name", "row_id", F.when(words, "words").otherwise(F.col("kind")).alias("of"), "anchor").agg(F.max("found").alias("f"))
    return read.select("table_name", "row_id", "f.kind", "f.start", "f.matched")


def redact(texts: DataFrame, found: DataFrame) -> DataFrame:
    """texts with every found piece replaced by a typed placeholder such as [EMAIL]; the rest unchanged."""
    spans = found.groupBy("table_name", "row_id").agg(F.array_sort(F.collect_set(F.struct("start", F.char_length("matched").alias("size"), "kind"))).alias("spans"))
    held = texts.join(spans, ["table_name", "row_id"], "left")
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
        F.struct(
            F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"),
            (s["start"] + s["size"]).alias("at"),
        )
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text")))
    return held.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.aggregate("spans", start, step, end))).drop("spans")
