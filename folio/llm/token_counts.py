"""Token counts of byte-level BPE vocabularies, without the identifiers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The public pattern that byte-level BPE vocabularies of this family split text by.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words longer than this are merged afresh each time, so the memory of words is bounded.
CACHED_CHARS, CACHED_WORDS = 40, 400_000


def _symbol_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in the vocabulary file -> byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_merges(path: str) -> tuple[list[tuple[int, int]], list[str]]:
    """Merge list of a tokenizers JSON file as pairs of symbol numbers, and its special strings.

    Symbols 0-255 are the bytes; symbol 256+r is the result of the merge of rank r. The size is
    bounded by the vocabulary.
    """
    spec = json.loads(open(path, encoding="utf-8").read())
    number, pairs = dict(_symbol_alphabet()), []
    for rank, merge in enumerate(spec["model"]["merges"]):
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        pairs.append((number[left], number[right]))
        number.setdefault(left + right, 256 + rank)
    return pairs, [t["content"] for t in spec["added_tokens"]]


class MergeCounter:
    """Counts the tokens of texts; remembers counts of short words."""

    def __init__(self, pairs: list[tuple[int, int]], specials: list[str]):
        first: dict[tuple[int, int], int] = {}
        made: dict[int, int] = {}
        names: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        spelled = [bytes([b]) for b in range(256)]
        for rank, (a, b) in enumerate(pairs):
            spelled.append(spelled[a] + spelled[b])
            first[a << 32 | b] = rank
            made[rank] = names.setdefault(spelled[-1], 256 + rank)
        self.rank, self.made = first, made
        self.words = regex.compile(WORD_PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.known: dict[str, int] = {}

    def merged(self, symbols: bytes) -> int:
        """Symbols left after merging: initial symbols minus merges.

        A heap of (rank, position) gives the lowest-rank, leftmost adjacent pair; a linked list
        holds the symbols. Entries whose pair has changed meanwhile are passed over.
        """
        n = len(symbols)
        if n < 2:
            return n
        rank, made = self.rank, self.made
        sym = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank.get(sym[i] << 32 | sym[i + 1])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            if sym[i] < 0 or (j := after[i]) >= n or rank.get(sym[i] << 32 | sym[j]) != top >> 32:
                continue
            sym[i], sym[j] = made[top >> 32], -1
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := rank.get(sym[i] << 32 | sym[k])) is not None:
                    heappush(heap, r << 32 | i)
            if (p := before[i]) >= 0 and (r := rank.get(sym[p] << 32 | sym[i])) is not None:
                heappush(heap, r << 32 | p)
        return n - merges

    def plain(self, text: str) -> int:
        known, total = self.known, 0
        if len(known) > CACHED_WORDS:
            known.clear()
        for m in self.words.findall(text):
            c = known.get(m)
            if c is None:
                c = self.merged(m.encode())
                if len(m) <= CACHED_CHARS:
                    known[m] = c
            total += c
        return total

    def count(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


_COUNTERS: dict[int, MergeCounter] = {}


def _counter(spec) -> MergeCounter:
    """One counter per Python worker and vocabulary."""
    pairs, specials = spec.value
    key = hash((len(pairs), *pairs[-3:], *specials))
    if key not in _COUNTERS:
        _COUNTERS[key] = MergeCounter(pairs, specials)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), one row per input row.

    Counts equal those of the tokenizers library for a byte-level BPE file without normaliser: its
    special strings inside a text are one token each, none are added, nothing is cut or padded. A
    null text counts as empty (zero tokens); repeated rows and null ids are kept; other columns are
    ignored; an empty table gives an empty table. Narrow: no shuffle, Arrow batches only.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_merges(tokenizer_path))  # bounded by the vocabulary file

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(spec)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
