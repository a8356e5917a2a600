"""Exact encoding with a merge-type SentencePiece model, by backtracking.

A sequence of pieces is what merging produces exactly when every two neighbours
are what merging their joined text produces. The encoder walks a text with the
longest piece that fits at each place (matches of an Aho-Corasick automaton),
keeps it if it is compatible with its left neighbour, tries shorter ones
otherwise and steps back when none is left. A prefix has one valid encoding
only, so a place at which the walk got stuck is stuck for good: one bit per
place keeps the work linear.
"""

from __future__ import annotations

import functools
import re
import sys

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .batches import add_columns, texts

SPACE = "▁"
CACHED_SEGMENTS = 300_000
CACHED_PAIRS = 150_000
CACHED_ORDERS = 40_000
LONGEST_CACHED = 48
_NEVER = float("-inf")


class BoundedCache(dict):
    """A memo of bounded size; it changes speed, never results.

    When half of ``limit`` is reached, the entries become the old generation
    and the former old one goes; what is still asked for comes back from there.
    """

    def __init__(self, compute, limit: int, longest: int = sys.maxsize):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if 2 * len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """The pieces of one model, ready to encode whole texts."""

    def __init__(self, model: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        sp = self.library
        self.ids, self.scores, bytes_ = {}, {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
        self.fallback = [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None
        self.unknown, self.begin, self.end = sp.unk_id(), sp.bos_id(), sp.eos_id()
        # The longest shorter piece that each piece starts with, as lengths; 0 if there is none.
        self.shorter = {p: max((n for n in range(1, len(p)) if p[:n] in self.ids), default=0) for p in self.ids}
        self.packed = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.compatible = BoundedCache(self._merge_keeps, CACHED_PAIRS)
        self.orders = BoundedCache(self._merges, CACHED_ORDERS)
        self.segments = BoundedCache(self._segment, CACHED_SEGMENTS, LONGEST_CACHED)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece spans words: texts of this model can't be cut at spaces")
        # No piece crosses from a letter to a space mark, and none holds a letter
        # that is no piece itself; both are safe places to cut.
        letters = {c for p in self.ids for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in letters)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.frame = [i.to_bytes(4, "little") if i >= 0 else b"" for i in (self.begin, self.end)]

    def merge(self, text: str) -> list[str]:
        """Pieces by the definition: merge the pair of highest score, leftmost first."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merges(self, piece: str) -> tuple[list[tuple[float, str, str]], bool]:
        """The merges inside a piece in their order: score, first and last part after it; and whether one part is left."""
        parts, scores, done = list(piece), self.scores, []
        while len(parts) > 1:
            best, at = _NEVER, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1], _NEVER)
                if score > best:
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            done.append((best, parts[0], parts[-1]))
        done.append((_NEVER, "", ""))
        return done, len(parts) == 1

    def _merge_keeps(self, pair: tuple[str, str]) -> bool:
        """Whether merging the joined text gives the two pieces: merges of both sides go on by score as if alone,

        unless the pair across the border scores more than what is next on the
        left, and as much as what is next on the right.
        """
        left, right = pair
        on_right, whole = self.orders[right]
        if not left or not whole:
            return whole
        on_left, whole = self.orders[left]
        if not whole:
            return False
        scores, a, b = self.scores, left[-1], right[0]
        across = scores.get(a + b, _NEVER)
        i = j = 0
        while True:
            first, _, last = on_left[i]
            second, start, _ = on_right[j]
            if across > first and across >= second and across > _NEVER:
                return False
            if first == second == _NEVER:
                return True
            if first >= second:
                i += 1
                if last is not a:
                    a = last
                    across = scores.get(a + b, _NEVER)
            else:
                j += 1
                if start is not b:
                    b = start
                    across = scores.get(a + b, _NEVER)

    def pieces(self, text: str) -> list[str]:
        """The backtracking walk over one segment."""
        n = len(text)
        longest = [1] * n
        for last, length in self.automaton.iter(text):
            longest[last - length + 1] = length  # longer ones end, and so come, later
        failed = 0  # one bit per place
        compatible, shorter = self.compatible, self.shorter
        found: list[str] = []
        at, left = 0, ""
        while at < n:
            length = longest[at]
            piece = text[at : at + length]
            while not (failed >> at + length & 1 == 0 and compatible[left, piece]):
                length = shorter.get(piece)
                if not length:
                    failed |= 1 << at
                    at -= len(found.pop())
                    left = found[-1] if found else ""
                    break
                piece = piece[:length]
            else:
                found.append(piece)
                at += length
                left = piece
        return found

    def _segment(self, segment: str) -> bytes:
        packed = self.packed
        return b"".join([packed.get(piece) or self._unlisted(piece) for piece in self.pieces(segment)])

    def _unlisted(self, letter: str) -> bytes:
        """A letter that is no piece: its bytes, or the unknown piece."""
        ids = [self.fallback[b] for b in letter.encode()] if self.fallback else [self.unknown]
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def encode(self, text: str) -> bytes:
        """Identifiers with begin and end marks, as little-endian unsigned 32-bit integers."""
        if not text:
            return self.frame[0] + self.frame[1]
        marked = SPACE + text.replace(" ", SPACE)
        return b"".join([self.frame[0], *map(self.segments.__getitem__, self.cut.findall(marked)), self.frame[1]])

    def decode(self, packed: bytes) -> str:
        return self.library.decode(np.frombuffer(packed, "<u4").astype("=u4", copy=False).data.tolist())


@functools.lru_cache(maxsize=2)
def encoder(model: str) -> Encoder:
    """One encoder per worker and model."""
    return Encoder(model)


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """Add the packed identifiers of every whole text and their number.

    ``ids`` is binary, 4 little-endian bytes an identifier, begin and end marks
    included. A missing text is encoded as an empty one: begin and end only.
    Repeated rows are encoded alike, all other columns pass through, columns
    with the names of the results are replaced, an empty table stays empty.
    The model must not normalise and must not hold pieces across words
    (identity models with space marks); others raise an error or differ.
    """

    def run(column: pa.Array) -> list[pa.Array]:
        packed = [encoder(model).encode(t) for t in texts(column)]
        return [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]

    return add_columns(df, [text], f"`{ids}` binary, `{count}` bigint", run)


def round_trip(df: DataFrame, model: str, text: str = "text", ids: str = "ids", count: str = "n_tokens", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the texts: adds the identifiers, their number and the text they give."""

    def run(column: pa.Array) -> list[pa.Array]:
        coder = encoder(model)
        packed = [coder.encode(t) for t in texts(column)]
        counts = [len(p) // 4 for p in packed]
        return [pa.array(packed, pa.binary()), pa.array(counts, pa.int64()), pa.array(map(coder.decode, packed), pa.string())]

    return add_columns(df, [text], f"`{ids}` binary, `{count}` bigint, `{decoded}` string", run)


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of packed identifiers; missing identifiers give an empty text."""

    def run(column: pa.Array) -> list[pa.Array]:
        return [pa.array([encoder(model).decode(p or b"") for p in column.to_pylist()], pa.string())]

    return add_columns(df, [ids], f"`{text}` string", run)
