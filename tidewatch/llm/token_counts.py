"""Token counts of a byte-level BPE by heap and linked list, without identifiers."""

from __future__ import annotations

import functools
import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .batches import add_columns, texts
from .sentencepiece_bpe import BoundedCache

# Fixed value: the pattern that splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED_WORDS = 400_000
LONGEST_CACHED = 48


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [chr(hidden.get(b, b)) for b in range(256)]


class Counter:
    """The merge ranks of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without prefix space and normaliser is counted here")
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(merges)}
        self.alphabet = byte_alphabet()
        self.split = regex.compile(SPLIT)
        special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings aren't handled")
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words = BoundedCache(self.word, CACHED_WORDS, LONGEST_CACHED)

    def word(self, text: str) -> int:
        """Symbols left of one pre-token: its bytes less the merges that happen."""
        ranks = self.ranks
        symbols = [self.alphabet[b] for b in text.encode()]
        n = count = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank, i, pair) for i in range(n - 1) if (rank := ranks.get(pair := (symbols[i], symbols[i + 1]))) is not None]
        heapify(heap)
        while heap:
            _, i, (left, right) = heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two was merged meanwhile
            count -= 1
            symbols[i], symbols[j] = left + right, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get(pair := (symbols[i], symbols[k]))) is not None:
                    heappush(heap, (rank, i, pair))
            if (h := before[i]) >= 0 and (rank := ranks.get(pair := (symbols[h], symbols[i]))) is not None:
                heappush(heap, (rank, h, pair))
        return count

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return sum(map(self.words.__getitem__, self.split.findall(text)))
        plain = self.special.split(text)
        return len(plain) - 1 + sum(sum(map(self.words.__getitem__, self.split.findall(t))) for t in plain)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter per worker and vocabulary."""
    return Counter(path)


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of every whole text.

    Special strings inside a text count as one token each, and nothing is
    added before or after. A missing or empty text has none. Other columns
    pass through, a column with the result's name is replaced, repeated rows
    count alike, an empty table stays empty.
    """

    def run(column: pa.Array) -> list[pa.Array]:
        return [pa.array([counter(vocabulary).count(t) for t in texts(column)], pa.int64())]

    return add_columns(df, [text], f"`{count}` bigint", run)
