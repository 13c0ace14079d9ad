"""Markdown chunks: one walk over a document's lines, headings kept as a path, long sections cut to size."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import SECRETS, SENSITIVE

TARGET, HARD = 400, 500
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+)$")
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[^\W\d_\u0000-ɏ]")


def _counts(text: str) -> tuple[int, int, int]:
    """(characters, letters, letters of other scripts than Latin)."""
    return len(text), len(_LETTER.findall(text)), 0 if text.isascii() else len(_OTHER.findall(text))


def _estimate(n: int, letters: int, other: int) -> int:
    if not n:
        return 0
    ratio = other / letters if letters else 0.0
    return max(1, int(n / (2.0 * ratio + 4.0 * (1 - ratio))))


def token_estimate(text: str) -> int:
    return _estimate(*_counts(text))


def pieces(section: str, target: int = TARGET, hard: int = HARD) -> list[str]:
    """A section in pieces: whole if it fits; else blocks, then lines, then characters are gathered up to the target."""
    if token_estimate(section) <= hard:
        return [section]
    units: list[tuple[str, str]] = []  # (joint before the unit, unit)
    for block in section.split("\n\n"):
        if token_estimate(block) <= hard:
            units.append(("\n\n", block))
            continue
        joint = "\n\n"
        for line in block.split("\n"):
            while token_estimate(line) > hard:
                n = max(1, len(line) * target // token_estimate(line))
                units.append((joint, line[:n]))
                line, joint = line[n:], ""
            units.append((joint, line))
            joint = "\n"
    out: list[str] = []
    now, size = "", (0, 0, 0)
    for joint, unit in units:
        own = _counts(unit)
        both = (size[0] + len(joint) + own[0], size[1] + own[1], size[2] + own[2])
        if now and _estimate(*both) > target:
            out.append(now)
            now, size = unit, own
        else:
            now, size = (now + joint + unit, both) if now else (unit, own)
    out.append(now)
    return [p for p in (x.strip("\n") for x in out) if p.strip()] or [section]


def chunk_markdown(text: str) -> list[tuple[str, str]]:
    """(heading path, text) in order. Headings inside fenced code are code."""
    stack: list[tuple[int, str]] = []
    sections: list[tuple[str, list[str]]] = [("", [])]
    fence = None
    for line in text.replace("\r\n", "\n").split("\n"):
        mark = line.lstrip()[:3]
        if fence:
            fence = None if mark == fence else fence
        elif mark in ("```", "~~~"):
            fence = mark
        elif m := _HEADING.match(line):
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), m[2].strip()))
            sections.append((" > ".join(t for _, t in stack), []))
        sections[-1][1].append(line)
    return [(path, p) for path, lines in sections if (body := "\n".join(lines).strip()) for p in pieces(body)]


def chunks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, ordinal, heading_path, content). Null and blank texts have none."""

    def run(batches):
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, (path, body) in enumerate(chunk_markdown(text)):
                    for c, v in zip(out, (doc, i, path, body)):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "ordinal", "heading_path", "content"])

    return docs.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, ordinal int, heading_path string, content string")


def strip_spans(text: Column, tag: str = "private") -> Column:
    """Text without <tag> spans: they nest, a stray end tag is dropped, an unclosed span hides all that follows."""
    parts = F.split(text, rf"(?i)(?=</?{tag}>)")
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"))

    def step(acc, p):
        opens, closes = F.rlike(p, F.lit(rf"(?i)^<{tag}>")), F.rlike(p, F.lit(rf"(?i)^</{tag}>"))
        depth = F.when(opens, acc["depth"] + 1).when(closes, F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        body = F.regexp_replace(p, rf"(?i)^</?{tag}>", "")
        return F.struct(F.when(depth > 0, acc["out"]).otherwise(F.concat(acc["out"], body)).alias("out"), depth.alias("depth"))

    return F.aggregate(parts, first, step, lambda acc: acc["out"])


def strip_fenced_blocks(text: Column, name: str = "memory") -> Column:
    """Text without blocks fenced by <name-NONCE> and </name-NONCE> of the same nonce."""
    return F.regexp_replace(text, rf"(?s)<{name}-([0-9a-f]+)>.*?</{name}-\1>", "")


_RULES = [(re.compile(form), label) for form, label in SECRETS]
_NAMED = re.compile("(?:" + "|".join(w.replace(" ", "[_-]?") for w in SENSITIVE) + "|authorization|(?<![a-z])auth)$", re.I)


def scrub_value(value):
    """A JSON value without secrets, at any depth: strings by the rules, and whatever is held by a sensitive name."""
    if isinstance(value, dict):
        plain = lambda v: isinstance(v, (str, int, float)) and not isinstance(v, bool) and v != ""
        return {k: "[REDACTED:credential]" if plain(v) and _NAMED.search(k) else scrub_value(v) for k, v in value.items()}
    if isinstance(value, list):
        return [scrub_value(v) for v in value]
    if isinstance(value, str):
        for rule, label in _RULES:
            value = rule.sub(label, value)
    return value


def scrub_json(df: DataFrame, column: str) -> DataFrame:
    """df with the JSON texts of a column scrubbed at any depth; null stays null, broken JSON is scrubbed as plain text."""
    at = df.columns.index(column)

    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(scrub_value(json.loads(text)), ensure_ascii=False)
        except (ValueError, RecursionError):
            return scrub_value(text)

    def run(batches):
        for b in batches:
            yield b.set_column(at, column, pa.array([one(t) for t in b.column(at).to_pylist()], pa.string()))

    return df.mapInArrow(run, df.schema)


def page_pieces(text: str, most: int = 4000) -> list[tuple[str, str]]:
    """(heading, body) of a page: a part for each second-level heading, too long ones cut before the paragraph that would pass most."""
    out = []
    for part in re.split(r"(?m)^(?=## )", text.replace("\r\n", "\n")):
        body = part.strip()
        if not body:
            continue
        head = body.split("\n", 1)[0][3:].strip() if body.startswith("## ") else ""
        held: list[str] = []
        size = 0
        for para in body.split("\n\n") if len(body) > most else [body]:
            if held and size + len(para) > most:
                out.append((head, "\n\n".join(held)))
                held, size = [], 0
            held.append(para)
            size += len(para) + 2
        out.append((head, "\n\n".join(held)))
    return out or [("", text.strip())]


def page_chunks(pages: DataFrame, most: int = 4000) -> DataFrame:
    """pages (id, content) -> (id, ordinal, heading, content); an empty page is one empty piece, a null one none."""

    def run(batches):
        for b in batches:
            rows = [(i, n, h, c) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, (h, c) in enumerate(page_pieces(t, most))]
            cols = list(zip(*rows)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "ordinal", "heading", "content"])

    return pages.where("content IS NOT NULL").select("id", "content").mapInArrow(run, "id long, ordinal int, heading string, content string")
