"""Context assembly: sections of memories packed into a byte budget, and the choice of depth."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, DEFAULT, MOST = 512, 4000, 8192
#: Characters an item keeps, and rows that may take part in one context: five sections of forty and eighty pieces of evidence.
CLIP, ROWS = 2000, 280
#: Depth: (rows a section, whether conclusions are recalled, hops of evidence).
DEPTHS = {"minimal": (8, False, 0), "low": (20, False, 0), "medium": (20, True, 0), "high": (24, True, 1), "max": (40, True, 8)}


def pack(items: DataFrame, budget: int = DEFAULT, depth: str = "low") -> DataFrame:
    """items (reader, section, section_no, pos, id, content) -> (reader, section, pos, id, used, truncated) of what fits.

    Sections take turns by position; an id counts where it comes first; what does not fit is skipped and packing goes on;
    truncated says whether anything was left out. Contents are cut at CLIP characters. Sizes are UTF-8 bytes of compact JSON,
    with room kept for the longest form of what is said about the whole. More than ROWS rows of a reader are an error: sections are to be cut to their limits."""
    budget = max(LEAST, min(MOST, budget))
    compact = lambda x: len(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > ROWS:
            raise ValueError(f"{len(pdf)} rows for one context; at most {ROWS}")
        used = compact({"version": 1, "depth": depth, "budget": budget, "bytes": budget, "truncated": False, "scope": {"reader": pdf["reader"].iloc[0]}, "sections": []})
        seen, out, missed = set(), [], False
        names: set[str] = set()
        for r in pdf.sort_values(["pos", "section_no"]).itertuples():
            if r.id in seen:
                continue
            size = compact({"id": int(r.id), "content": (r.content or "")[:CLIP]}) + 1
            head = 0 if r.section in names else compact({"name": r.section, "items": []}) + 1
            if used + size + head > budget:
                missed = True
                continue
            used += size + head
            names.add(r.section)
            seen.add(r.id)
            out.append((r.reader, r.section, int(r.pos), int(r.id), used))
        missed = missed or len(seen) < pdf["id"].nunique()
        return pd.DataFrame([(*o, missed) for o in out], columns=["reader", "section", "pos", "id", "used", "truncated"])

    return items.groupBy("reader").applyInPandas(run, "reader string, section string, pos int, id long, used int, truncated boolean")


def auto_depth(terms: Column, hits: Column, derived: Column, projects: Column, evidence_cue: Column, reasoning_cue: Column, has_query: Column, everywhere: Column) -> Column:
    """How much to recall, decided from what a search shows, first matching rule; everywhere: the search went over all workspaces."""
    # The nine outcomes.
    return (
        F.when(~has_query, "low:profile_without_query").when(hits == 0, "minimal:no_relevant_hits")
        .when((derived > 0) & evidence_cue, "max:derived_hits_with_evidence_request")
        .when((derived > 0) & (reasoning_cue | (terms >= 18) | (projects >= 2)), "high:derived_hits_need_direct_premises")
        .when(derived > 0, "medium:derived_hits_available").when(evidence_cue | reasoning_cue, "low:explicit_support_only")
        .when(everywhere & (projects >= 2), "low:cross_workspace_explicit_hits").when((hits <= 8) & (terms <= 10), "minimal:narrow_explicit_lookup").otherwise("low:general_explicit_hits")
    )
