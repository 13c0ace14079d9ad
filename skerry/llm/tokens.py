"""Exact token counts of a public byte-level BPE vocabulary.

The public split pattern never lets a pre-token run over white space, except that a word takes along one
space before it. So a text's count is the sum over its words, each with or without a leading
space, and its runs of white space; counts of short ones are remembered per worker (a bounded table).
"""

from __future__ import annotations

import base64
import os
import re

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's public split pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_GAPS = re.compile(r"([^\S ]\s*| \s+)")
#: Characters that Python takes for white space and the public pattern does not.
_ODD = re.compile("[\x1c-\x1f]")
_REMEMBER, _SHORT = 200_000, 32
_counters: dict = {}


class Words(dict):
    """word -> tokens of lead + word."""

    def __init__(self, encoding, lead: str):
        self.encoding, self.lead = encoding, lead

    def __missing__(self, word: str) -> int:
        n = len(self.encoding.encode_ordinary(self.lead + word))
        if len(word) <= _SHORT:
            if len(self) >= _REMEMBER:
                self.clear()
            self[word] = n
        return n


class Counter:
    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bare, self.spaced = Words(self.encoding, ""), Words(self.encoding, " ")

    def count(self, text: str) -> int:
        if _ODD.search(text):
            return len(self.encoding.encode_ordinary(text))
        parts = _GAPS.split(text)
        total, own, last = 0, self.bare, len(parts) - 1
        for i in range(0, last + 1, 2):
            if parts[i]:
                first, *rest = parts[i].split(" ")
                total += own[first] + sum(map(self.spaced.__getitem__, rest))
            if i < last:
                gap = parts[i + 1]
                own = self.bare
                if i + 2 == last and not parts[last]:
                    total += self.bare[gap]
                elif gap[-1] == " ":
                    own = self.spaced
                    total += self.bare[gap[:-1]]
                elif len(gap) > 1:
                    total += self.bare[gap[:-1]] + self.bare[gap[-1]]
                else:
                    total += self.bare[gap]
        return total


def counter(vocabulary: str) -> Counter:
    if vocabulary not in _counters:
        _counters[vocabulary] = Counter(vocabulary)
    return _counters[vocabulary]


def with_token_counts(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """df without its text column and with its exact count of tokens; a null text has none.

    Only the driver needs the vocabulary file: Spark hands it out to the executors."""
    rest = [c for c in df.columns if c != text]
    schema = df.select(*rest, F.lit(0).cast("int").alias(out)).schema

    df.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches):
        c = counter(SparkFiles.get(name))
        for b in batches:
            i = b.schema.get_field_index(text)
            n = [c.count(x) if x else 0 for x in b.column(i).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(b.num_columns) if j != i), pa.array(n, pa.int32())], names=[*rest, out])

    return df.select(*rest, text).mapInArrow(run, schema)
