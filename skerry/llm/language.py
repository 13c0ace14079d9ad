"""Languages of documents and of the segments of mixed ones.

Multinomial naive Bayes over hashed character n-grams. Prose sentences are cut out of the text (fenced code,
headings, tables, data lines and code spans are left out), folded to plain lower-case letters, and
all sentences of a batch are scored at once: one gather of rows of the log-probability matrix
for each n-gram length and one segmented sum. The matrix (a fixed 2^16 rows by the
languages) is the only thing broadcast, with a few figures. n-grams that overlap say the same thing several times, so a
confidence is the posterior with the log-likelihood divided by a temperature, which is fitted on documents held out from
the fit. A segment whose n-grams are far less likely than those of its language ever are is in none of the languages (``NONE``). It is fitted on a bounded sample of labelled documents
(``per_language`` a language): once with the documents' labels, then again with each sentence under the
language the first fit gives it, which repairs wrong labels and mixed documents.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.sources.durable import durable

BITS, ORDERS = 16, (2, 3, 4)
PER_LANGUAGE = 400
#: Codes and names by which a label may name a language.
LABELS = {
    "de": ["de", "ger", "deu", "german", "deutsch"],
    "en": ["en", "eng", "english"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "fr": ["fr", "fre", "fra", "french", "français", "francais"],
    "it": ["it", "ita", "italian", "italiano"],
    "nl": ["nl", "dut", "nld", "dutch", "nederlands"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "ru": ["ru", "rus", "russian", "русский"],
}
LANGUAGES = list(LABELS)
#: The language of segments that are in none of these, and how many deviations from its language's mean a segment may be.
NONE, FAR = "und", 6.0
#: Temperatures tried, and the part of the labelled documents held out for it.
HEATS, HELD_OUT = [1.0, 2.0, 4.0, 8.0, 15.0, 30.0, 60.0, 100.0], 5


def label_language(label: Column) -> Column:
    """The two-letter code a label names, else null; case, blanks and regions do not matter."""
    clean = F.regexp_replace(F.lower(F.trim(F.regexp_replace(label, r"\s+", " "))), r"^([a-z]{2,3})[-_].*$", "$1")
    known = F.create_map(*(F.lit(x) for code, names in LABELS.items() for n in names for x in (n, code)))
    return F.try_element_at(known, clean)


def _fold_table() -> np.ndarray:
    """Code point -> folded letter, 32 for everything that is no letter."""
    t = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            base = unicodedata.normalize("NFKD", ch.lower())
            t[c] = min(ord(base[0]), 0xFFFF) if base else 32
    return t


_FOLD: list = []
_FENCE = re.compile(r"^[ ]{0,3}(```|~~~).*?(?:^[ ]{0,3}\1[^\n]*$|\Z)", re.M | re.S)
_DROP = re.compile(r"^[ \t]*(?:#{1,6}[ \t].*|\|.*|.*\|[ \t]*|[{\[<].*|=+|-{3,}|\d{4}-\d\d-\d\dT.*)$", re.M)
_END = re.compile(r"(?<=[.!?…])[\"')»\]]*\s+|\n[ \t]*(?=(?:[-*+>•]|\d+[.)])[ \t])|\r?\n[ \t]*\r?\n")
_SPAN = re.compile(r"`[^`\n]*`|https?://\S+|\S*[0-9_/@]\S*")
_WORD = re.compile(r"[^\W\d_]{2,}")


def _blank(m: re.Match) -> str:
    return "\n\n" + " " * max(0, len(m[0]) - 4) + "\n\n" if len(m[0]) >= 4 else "\n" * len(m[0])


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, bare words) of the prose sentences of a text."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(_blank, text)
    text = _DROP.sub(_blank, text)
    out, at = [], 0
    for m in [*_END.finditer(text), None]:
        end = m.start() if m else len(text)
        if end - at > 12:
            bare = _SPAN.sub(" ", text[at:end])
            words = len(_WORD.findall(bare))
            if words >= 4 and 2 * words > bare.count(" ") - 2 * bare.count("  "):
                lead = len(text[at:end]) - len(text[at:end].lstrip(" \t\r\n>-*+•"))
                out.append((at + lead, end, bare))
        at = m.end() if m else at
    return out


def _grams(bare: list[str]):
    """n-gram buckets of all sentences, one array an order, and where each sentence begins."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    joined = "\n".join(bare) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    begin = np.concatenate([[0], np.flatnonzero(code == 10) + 1])[: len(bare)] if "\n" not in "".join(bare) else None
    if begin is None:
        begin = np.concatenate([[0], np.cumsum([len(b) + 1 for b in bare])[:-1]])
    c = _FOLD[0][np.minimum(code, 0xFFFF)]
    keep = np.ones(len(c), bool)  # runs of blanks as one
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    keep[begin] = True
    place = np.cumsum(keep) - 1
    c, begin = c[keep].astype(np.uint64), place[begin]
    out = []
    for n in ORDERS:
        h = np.zeros(len(c), np.uint64)
        for k in range(n):
            h[: len(c) - k] = (h[: len(c) - k] + c[k:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
        out.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    return out, begin


def score(bare: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods (sentence by language) and n-grams of each sentence."""
    total = np.zeros((len(bare), logp.shape[1]))
    sizes = np.zeros(len(bare))
    at = 0
    while at < len(bare):  # some hundred thousand characters at a time
        end, chars = at, 0
        while end < len(bare) and (end == at or chars + len(bare[end]) < 400_000):
            chars += len(bare[end])
            end += 1
        grams, begin = _grams(bare[at:end])
        for g in grams:
            total[at:end] += np.add.reduceat(logp[g], begin, axis=0)
        sizes[at:end] = np.diff(np.append(begin, len(grams[0]))) * len(ORDERS)
        at = end
    return total, sizes


def _counts(logp):
    """n-gram counts by language of labelled documents; with a model, each sentence under its own language."""
    code = {c: i for i, c in enumerate(LANGUAGES)}

    def run(batches):
        total = np.zeros((len(LANGUAGES), 1 << BITS), np.int64)
        for b in batches:
            labels, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            found = [(code[lab], s[2]) for lab, t in zip(labels, texts) for s in sentences(t)]
            if not found:
                continue
            own, bare = np.array([f[0] for f in found]), [f[1] for f in found]
            if logp is not None:
                own = score(bare, logp.value)[0].argmax(axis=1)
            for i in np.unique(own):
                grams, _ = _grams([bare[k] for k in np.flatnonzero(own == i)])
                for g in grams:
                    total[i] += np.bincount(g, minlength=1 << BITS)
        i, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(k), pa.array(total[i, k])], names=["lang", "gram", "n"])

    return run


def _softmax(total: np.ndarray) -> np.ndarray:
    e = np.exp(total - total.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _check(logp):
    """Of held-out documents, whose label most of their prose agrees with: for each language and temperature the summed log
    loss, and the sentences' mean log-likelihoods an n-gram with their squares (temperature -1)."""
    code = {c: i for i, c in enumerate(LANGUAGES)}

    def run(batches):
        loss = np.zeros((len(LANGUAGES), len(HEATS)))
        rate = np.zeros((len(LANGUAGES), 3))
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                bare = [s[2] for s in sentences(text)]
                if not bare:
                    continue
                total, size = score(bare, logp.value)
                i = code[label]
                if np.bincount(total.argmax(axis=1), minlength=len(LANGUAGES)).argmax() != i:
                    continue
                for k, heat in enumerate(HEATS):
                    loss[i, k] -= np.log(np.maximum(_softmax(total / heat)[:, i], 1e-12)).sum()
                own = (total[:, i] / size)[total.argmax(axis=1) == i]
                rate[i] += [len(own), own.sum(), (own * own).sum()]
        lang = np.repeat(np.arange(len(LANGUAGES)), len(HEATS) + 3)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(np.tile(np.arange(-3, len(HEATS)), len(LANGUAGES))), pa.array(np.hstack([rate, loss]).ravel())], names=["lang", "heat", "v"])

    return run


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, float, np.ndarray]:
    """(log-probability matrix, grams by languages; temperature; least mean log-likelihood an n-gram of each language)
    from docs (doc_id, text, lang).

    About ``per_language`` documents of each language are drawn by hash, a fifth of them held out for the last two; a language nobody labels
    never comes out."""
    sc = docs.sparkSession.sparkContext
    named = docs.select("doc_id", "text", label_language(F.col("lang")).alias("label")).where("label IS NOT NULL AND text IS NOT NULL")
    have = {r.label: r["count"] for r in named.groupBy("label").count().collect()}
    shares = F.create_map(*(F.lit(x) for code, n in have.items() for x in (code, min(1.0, per_language / n)))) if have else F.create_map()
    share = F.coalesce(F.try_element_at(shares, F.col("label")), F.lit(0.0)) if have else F.lit(0.0)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * F.lit(1 << 30)
    sample = durable(named.where(draw).select("label", "text", (F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(HELD_OUT)) == 0).alias("held")), "labelled")
    few = sample.count() < 50 * len(LANGUAGES)  # too few to hold any out: the check is then on the fitted ones
    model = None
    for _ in range(2):
        known = sample if few else sample.where("NOT held")
        rows = known.select("label", "text").mapInArrow(_counts(model), "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros((1 << BITS, len(LANGUAGES)))
        if rows.num_rows:
            total[rows.column("gram").to_numpy(), rows.column("lang").to_numpy()] = rows.column("n").to_numpy()
        seen = total.sum(axis=0)
        logp = np.log((total + 0.3) / (seen + 0.3 * (1 << BITS)))
        logp[:, seen == 0] = -40.0
        logp = logp.astype(np.float32)
        model = sc.broadcast(logp)
    held = sample if few else sample.where("held")
    sums = np.zeros((len(LANGUAGES), len(HEATS) + 3))
    for r in held.select("label", "text").mapInArrow(_check(model), "lang long, heat long, v double").groupBy("lang", "heat").agg(F.sum("v").alias("v")).collect():
        sums[r.lang, r.heat + 3] = r.v
    heat = HEATS[int(sums[:, 3:].sum(axis=0).argmin())]
    n = np.maximum(sums[:, 0], 1)
    mean = sums[:, 1] / n
    least = mean - FAR * np.sqrt(np.maximum(sums[:, 2] / n - mean * mean, 0))
    least[sums[:, 0] < 2] = -np.inf
    return logp, heat, least


def _segments(model):
    def run(batches):
        logp, heat, least = model.value
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            per = [sentences(t) for t in texts]
            bare = [s[2] for p in per for s in p]
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            if bare:
                total, size = score(bare, logp)
                lang = total.argmax(axis=1)
                order = np.sort(total, axis=1)
                margin = (order[:, -1] - order[:, -2]) / size
                at = 0
                for doc, p in zip(ids, per):
                    own = lang[at : at + len(p)].copy()
                    for i in range(1, len(p) - 1):  # an unsure sentence between two of one language is taken for theirs
                        if own[i] != own[i - 1] == own[i + 1] and margin[at + i] < 0.05:
                            own[i] = own[i - 1]
                    i = seg = 0
                    while i < len(p):
                        j = i
                        while j < len(p) and own[j] == own[i]:
                            j += 1
                        whole = total[at + i : at + j].sum(axis=0)
                        sure = float(_softmax(whole[None, :] / heat)[0, own[i]])
                        foreign = whole[own[i]] / size[at + i : at + j].sum() < least[own[i]]
                        for c, v in zip(cols, (doc, seg, NONE if foreign else LANGUAGES[own[i]], 0.0 if foreign else sure, j - i, p[i][0], p[j - 1][1])):
                            c.append(v)
                        i, seg = j, seg + 1
                    at += len(p)
            types = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "segment", "lang", "confidence", "sentences", "start_char", "end_char"])

    return run


def segments(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """docs (doc_id, text, lang) -> (doc_id, segment, lang, confidence, sentences, start_char, end_char): runs of
    consecutive prose sentences in one language, or in none of those known (``und``, confidence 0). Texts without prose (null, empty, only code) have none."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language))
    schema = "doc_id long, segment int, lang string, confidence double, sentences int, start_char int, end_char int"
    return docs.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(_segments(model), schema)


def document_languages(segs: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, share): the language of most prose; share is its part of it."""
    size = F.col("end_char") - F.col("start_char")
    by = segs.groupBy("doc_id", "lang").agg(F.sum(size).alias("chars"), (F.sum(size * F.col("confidence")) / F.sum(size)).alias("confidence"))
    best = by.groupBy("doc_id").agg(F.max(F.struct("chars", "lang", "confidence")).alias("b"), F.sum("chars").alias("all"))
    return best.select("doc_id", "b.lang", "b.confidence", (F.col("b.chars") / F.col("all")).alias("share"))
