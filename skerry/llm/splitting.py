"""Splitting oversized texts at natural boundaries by pointer doubling.

The boundaries of a text are numbered in order. Each boundary is joined to its farthest legal
successor: a piece that follows a cut at boundary j starts ``overlap`` before j and may be at most
``limit`` long; of the boundaries it can reach the farthest of the best class is taken, where a class
counts only in the last part of the piece. Squaring the successor table doubles the steps it
takes, so all cuts of a text come out after log2(pieces) table look-ups, for all texts of a batch at
once. Texts are rows, so nothing is shuffled.

Sizes are UTF-8 bytes; one token counts four bytes, rounded up.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTES_PER_TOKEN = 4
#: Document types with limits of their own; they become part of the plan.
MOST_TYPES = 200
#: Boundary classes from best to worst, and the least part of the limit a piece must fill to be cut there.
HEADING, PARAGRAPH, LINE, SENTENCE, SPACE, HARD = range(6)
KINDS = ["heading", "paragraph", "line", "sentence", "space", "hard"]
LEAST_FILL = np.array([0.5, 0.5, 0.6, 0.7, 0.0, 0.0])

_MARKS = re.compile(rb"(?P<fence>^[ ]{0,3}```[^\n]*\n?)|(?P<heading>^(?=#{1,6}[ \t]))|(?P<paragraph>\r?\n(?:[ \t]*\r?\n)+)|(?P<line>\r?\n)|(?P<sentence>[.!?:;\xbb][)\]\"'\xbb]*[ \t]+)", re.M)
_KIND = {"heading": HEADING, "paragraph": PARAGRAPH, "line": LINE, "sentence": SENTENCE}


def boundaries(data: bytes, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (0 and the end included) and classes. No gap is wider than step: wider ones get spaces,
    then cuts between characters. Inside fenced code only line ends count."""
    at, kind, fenced = [], [], False
    for m in _MARKS.finditer(data):
        name = m.lastgroup
        if name == "fence":
            fenced = not fenced
            at.append(m.start() if fenced else m.end())
            kind.append(PARAGRAPH)
        elif fenced:
            if name in ("line", "paragraph"):
                at.append(m.end())
                kind.append(LINE)
        else:
            at.append(m.end())
            kind.append(_KIND[name])
    n = len(data)
    pos, cls = np.array([0, *at, n]), np.array([HEADING, *kind, HEADING])
    wide = np.flatnonzero(np.diff(np.sort(pos)) > step)
    if len(wide):
        raw = np.frombuffer(data, np.uint8)
        spaces = np.flatnonzero((raw == 32) | (raw == 9)) + 1
        sp = np.sort(pos)
        inside = spaces[np.isin(np.searchsorted(sp, spaces, "right") - 1, wide)]
        pos, cls = np.concatenate([pos, inside]), np.concatenate([cls, np.full(len(inside), SPACE)])
        sp = np.sort(pos)
        gaps = np.flatnonzero(np.diff(sp) > step)
        half = max(1, step // 2)
        hard = np.concatenate([np.arange(sp[g] + half, sp[g + 1], half) for g in gaps]) if len(gaps) else np.array([], np.int64)
        while len(hard) and (mid := (raw[hard] & 0xC0) == 0x80).any():  # never inside a character
            hard[mid] -= 1
        pos, cls = np.concatenate([pos, hard]), np.concatenate([cls, np.full(len(hard), HARD)])
    order = np.lexsort((cls, pos))
    pos, cls = pos[order], cls[order]
    keep = np.concatenate([[True], np.diff(pos) > 0])  # the best class of a position
    return pos[keep], cls[keep]


def _char_start(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Moves positions forward to the start of a character."""
    at = at.copy()
    while (mid := (at < len(raw)) & ((raw[np.minimum(at, len(raw) - 1)] & 0xC0) == 0x80)).any():
        at[mid] += 1
    return at


def cuts(data: bytes, max_tokens: int, overlap_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, class of each end) of all pieces of one text."""
    limit, n = max_tokens * BYTES_PER_TOKEN, len(data)
    if n <= limit:
        return np.array([0]), np.array([n]), np.array([HEADING])
    if not 0 <= overlap_tokens <= max(max_tokens - 2, 0):
        raise ValueError(f"an overlap of {overlap_tokens} tokens leaves no room in pieces of {max_tokens}")
    overlap = overlap_tokens * BYTES_PER_TOKEN
    pos, cls = boundaries(data, max(4, (limit - overlap) // 2))
    raw = np.frombuffer(data, np.uint8)
    start = _char_start(raw, np.maximum(pos - overlap, 0))
    start[0] = 0
    reach = np.searchsorted(pos, start + limit, "right") - 1  # the farthest boundary that fits
    succ = np.full(len(pos), -1)
    for k in range(6):  # last boundary of class k that fits, if it is far enough
        own = np.flatnonzero(cls == k)
        if not len(own):
            continue
        cand = own[np.maximum(np.searchsorted(own, reach, "right") - 1, 0)]
        ok = (succ < 0) & (cand <= reach) & (cand > np.arange(len(pos))) & (pos[cand] - start >= LEAST_FILL[k] * limit)
        succ[ok] = cand[ok]
    left = succ < 0
    succ[left] = np.maximum(reach, np.minimum(np.arange(len(pos)) + 1, len(pos) - 1))[left]
    last = len(pos) - 1
    succ[reach == last] = last  # what fits whole is not cut again
    hit = np.array([0])
    table = succ
    while True:  # hit: cuts within the first 2^k pieces; table: 2^k steps at once
        more = np.union1d(hit, table[hit])
        if len(more) == len(hit):
            break
        hit, table = more, table[table]
    ends = hit[1:]
    return np.concatenate([[0], start[ends[:-1]]]), pos[ends], cls[ends]


def _run(keep_text: bool):
    def run(batches):
        for b in batches:
            docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            most, over = b.column(2).to_pylist(), b.column(3).to_pylist()
            out = ([], [], [], [], [], [])
            for doc, text, m, o in zip(docs, texts, most, over):
                if m is None or -(-len(text) // BYTES_PER_TOKEN) <= m and text.isascii():  # fits, seen without encoding it
                    for col, v in zip(out, (doc, 0, 0, len(text) if text.isascii() else len(text.encode("utf-8")), KINDS[HEADING], text if keep_text else None)):
                        col.append(v)
                    continue
                data = text.encode("utf-8")
                starts, ends, cls = cuts(data, m, o)
                for i, (s, e, c) in enumerate(zip(starts.tolist(), ends.tolist(), cls.tolist())):
                    for col, v in zip(out, (doc, i, s, e, KINDS[c], data[s:e].decode("utf-8") if keep_text else None)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.string()), pa.array(out[5], pa.string())],
                names=["doc_id", "piece", "start_byte", "end_byte", "cut_at", "text"],
            )

    return run


def split_documents(docs: DataFrame, limits: DataFrame, keep_text: bool = True) -> DataFrame:
    """docs (doc_id, text, doc_type), limits (doc_type, max_tokens, overlap_tokens; the row ``default``
    holds for the rest) -> (doc_id, piece, start_byte, end_byte, cut_at, text).

    A text that fits is one piece; null and empty texts are one empty piece. Pieces cover the whole
    text; each following piece starts exactly overlap_tokens (by size) before the end of the one
    before, at a character. Sizes are measured on the text; token_count is not read. Repeated documents
    count once. limits is a dimension of a few rows; an overlap that leaves less than two tokens of a piece is an error."""
    key = F.lower(F.trim(F.col("doc_type")))
    rows = limits.where("doc_type IS NOT NULL AND max_tokens IS NOT NULL").groupBy(key.alias("k")).agg(F.max(F.struct("max_tokens", "overlap_tokens")).alias("l"))
    rows = rows.select("k", "l.max_tokens", "l.overlap_tokens").limit(MOST_TYPES + 1).collect()
    if len(rows) > MOST_TYPES:
        raise ValueError(f"limits has more than {MOST_TYPES} document types; it must be a small dimension")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("k"))
    most, over = F.lit(None).cast("int"), F.lit(0)
    for r in sorted(rows, key=lambda r: r.k != "default"):
        hit = F.lit(True) if r.k == "default" else F.coalesce(F.col("k") == r.k, F.lit(False))
        most = F.when(hit, F.lit(r.max_tokens)).otherwise(most)
        over = F.when(hit, F.lit(r.overlap_tokens or 0)).otherwise(over)
    for r in rows:
        if not 0 <= (r.overlap_tokens or 0) <= max(r.max_tokens - 2, 0):
            raise ValueError(f"limits of {r.k!r}: an overlap of {r.overlap_tokens} tokens leaves no room in pieces of {r.max_tokens}")
    d = d.select("doc_id", "text", most.alias("most"), over.alias("over"))
    return d.mapInArrow(_run(keep_text), "doc_id long, piece int, start_byte long, end_byte long, cut_at string, text string")
