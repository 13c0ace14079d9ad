"""Path globs as regular expressions, built inside the plan so that globs may be data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: Column) -> Column:
    """``**/`` is any number of whole segments, ``**`` anything, ``*`` and ``?`` stay inside a segment."""
    c = F.regexp_replace(glob, r"([.+^$(){}|\[\]\\])", r"\\$1")
    c = F.regexp_replace(c, r"\*\*/", "\x01")
    c = F.regexp_replace(c, r"\*\*", "\x02")
    c = F.regexp_replace(c, r"\*", "[^/]*")
    c = F.regexp_replace(c, r"\?", "[^/]")
    c = F.regexp_replace(c, "\x01", "(?:.*/)?")
    c = F.regexp_replace(c, "\x02", ".*")
    return F.concat(F.lit("^"), c, F.lit("$"))


def literal_head(glob: Column) -> Column:
    """The directories before the first wildcard: what every match must begin with."""
    head = F.regexp_extract(glob, r"^[^*?]*", 0)
    return F.regexp_extract(head, r"^(.*/)?", 0)


def exact(glob: Column) -> Column:
    return ~F.rlike(glob, F.lit(r"[*?]"))


def literal_chars(glob: Column) -> Column:
    return F.char_length(F.regexp_replace(glob, r"[*?]", ""))


def normal_path(path: Column) -> Column:
    """Without empty and ``.`` segments; ``..`` takes back the segment before it."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda s: (s != "") & (s != "."))
    step = lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def mapped_dir(glob: Column) -> Column:
    """The directory a glob claims: the literal directories before its first wildcard, or an exact path's parent; the root is none."""
    cut = F.when(exact(glob), F.regexp_replace(glob, r"/?[^/]*$", "")).otherwise(F.regexp_replace(literal_head(glob), "/$", ""))
    clean = F.regexp_replace(cut, "^/+|/+$", "")
    return F.when(clean != "", clean)


def ignore_regex(lines: str) -> str:
    """One Java pattern for the paths that a listing of ignore lines takes; a listing without patterns takes none.

    A hash begins a comment. A line that ends in a slash takes a directory of that name, or pattern, and all below it; any other is a pattern for
    the whole path. ``*`` and ``?`` cross slashes, ``[...]`` is a set, ``[!...]`` its complement."""
    out = []
    for line in lines.splitlines():
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        rx, i = "", 0
        while i < len(line):
            c = line[i]
            close = line.find("]", i + 2) if c == "[" else -1
            if close > 0:
                body = line[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
                rx += "[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]"
                i = close
            else:
                rx += {"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or c in "/_ " or ord(c) > 127 else "\\" + c)
            i += 1
        out.append(rx + (".*" if line.endswith("/") else ""))
    return "^(?s:" + "|".join(out) + ")$" if out else "(?!)"
