"""Exact substring removal by a distributed merge sort of suffixes.

A string of ``length`` bytes has an anchor: the place of its smallest hashed
64-byte gram. Equal strings have equal anchors, so it is enough to sort the
suffixes that start at anchors, about one in seventy. An anchor serves an
interval of string starts; a string is given by its anchor and the distance
``d`` from its start to the anchor, and it repeats if another anchor has an
equal suffix of ``length - d`` bytes and equal ``d`` bytes before it.

Tasks sort the suffixes of their anchors into runs, front-coded: each suffix
says how many bytes it shares with the one before it and lists the rest. Runs
are cut at range bounds and exchanged; a loser tree merges them and carries the
known common prefixes along, so that no byte of a shared prefix is compared
again. The merged order comes with the common prefix of neighbours, which
gives, for each ``d``, the groups of suffixes that agree; hashes of the bytes
before the anchors split these further.

Two filters of fixed size keep the exchange small: anchors whose gram occurs
once can't repeat and are left out (while the filter has room, at larger sizes
more of them travel); grams that occur very often would make one task hold a
large group, so their strings are compared one by one through a hash join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialise

from .textscan import _BYTE, _PLACE, mix

GRAM = 64
BATCH = 1 << 20  # bytes at a time; longer texts are cut into overlapping pieces
_INDEX = np.uint64(22)
REPEATED_BITS = 1 << 26  # 8 MB
FREQUENT_BITS = 1 << 24  # 2 MB
FREQUENT = 20_000  # occurrences of a gram from which its strings are hashed instead
ITEMS_A_RANGE = 50_000
ITEMS_A_RUN = 40_000
SAMPLE = 20_000  # suffix starts from which the range bounds are taken
_U = np.uint64


class Pieces:
    """Anchors and string hashes of a batch of byte strings, none across two of them."""

    def __init__(self, texts: list[bytes], length: int):
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(sizes) - sizes
        n = len(self.bytes)
        self.hashes = {1: _BYTE[self.bytes]}
        span = 1
        while span < 2 * GRAM:
            h = self.hashes[span]
            self.hashes[2 * span] = h[:-span] * _PLACE[span] + h[span:] if len(h) > span else h[:0]
            span *= 2
        self.length = length
        none = np.zeros(0, np.int64)
        self.first = self.last = self.anchor = self.owner = none
        self.gram = np.zeros(0, _U)
        if n < length:
            return
        values = mix(self.hashes[GRAM])
        low = ((values >> _INDEX) << _INDEX) | np.arange(len(values), dtype=_U)
        width, span = length - GRAM + 1, 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(values) - width + 1], low[width - span :])
        anchor = (low & ((_U(1) << _INDEX) - _U(1))).astype(np.int64)
        inside = np.ones(len(anchor), bool)
        for end in (self.begin + sizes)[:-1]:
            inside[max(0, end - length + 1) : end] = False
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        # An interval of starts ends where the anchor changes or a text ends.
        edge = new | np.concatenate([[True], inside[1:] != inside[:-1]])
        at = np.flatnonzero(edge)
        stop = np.append(at[1:], len(anchor)) - 1
        good = inside[at]
        self.first, self.last = at[good], stop[good]
        self.anchor = anchor[self.first]
        self.gram = values[self.anchor]
        self.owner = np.searchsorted(self.begin, self.first, "right") - 1

    def strings(self, starts: np.ndarray) -> np.ndarray:
        """Hashes of the whole strings at some starts."""
        total = np.zeros(len(starts), _U)
        at, left = starts.copy(), self.length
        for span in sorted(self.hashes, reverse=True):
            while left >= span:
                total = mix(total + self.hashes[span][at])
                at, left = at + span, left - span
        return total


def _batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts of a task, each distinct one once: keys, offsets of the pieces, pieces."""
    seen: set[int] = set()
    keys: list[int] = []
    offsets: list[int] = []
    pieces: list[bytes] = []
    size = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text is None or key in seen:
                continue
            data = text.encode()
            if len(data) < length:
                continue
            seen.add(key)
            for at in range(0, len(data) - length + 1, BATCH):
                piece = data[at : at + BATCH + length - 1]
                if size and size + len(piece) > BATCH:
                    yield keys, offsets, pieces
                    keys, offsets, pieces, size = [], [], [], 0
                keys.append(key)
                offsets.append(at)
                pieces.append(piece)
                size += len(piece)
    if size:
        yield keys, offsets, pieces


def _grams(fed: DataFrame, length: int) -> DataFrame:
    """``(gram, n, head)``: the grams of anchors, how often, and the first bytes of one suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, pieces in _batches(batches, length):
            found = Pieces(pieces, length)
            grams, at, n = np.unique(found.gram, return_index=True, return_counts=True)
            # A sample of suffix starts, chosen by their hash: the same ones everywhere.
            drawn = (mix(grams) >> _U(55)) == 0
            data = found.bytes.tobytes()
            heads = [data[found.anchor[i] : found.anchor[i] + 16] if d else None for i, d in zip(at, drawn, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n), pa.array(heads, pa.binary())], names=["gram", "n", "head"])

    return fed.mapInArrow(run, "gram bigint, n bigint, head binary")


def _filter(grams: DataFrame, bits: int) -> np.ndarray:
    """One bit per gram, set on the executors in words of 64."""
    slot = F.col("gram").bitwiseAND(F.lit(bits - 1))
    words = grams.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(gram & 63 AS INT)))").alias("b"))
    found = words.toArrow()
    out = np.zeros(bits // 64, "<u8")
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(_U)
    return out


def _in(filter_: np.ndarray, grams: np.ndarray) -> np.ndarray:
    slot = grams & _U(len(filter_) * 64 - 1)
    return ((filter_[slot >> _U(6)] >> (slot & _U(63))) & _U(1)).astype(bool)


def _context(found: Pieces, some: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes from the anchor on and, backwards, before it, as rows padded with zeros."""
    p, first, last = found.anchor[some], found.first[some], found.last[some]
    right = np.arange(length)
    rows = found.bytes[np.minimum(p[:, None] + right, len(found.bytes) - 1)]
    rows[right >= (last + length - p)[:, None]] = 0
    left = np.arange(1, length - GRAM + 1)
    back = found.bytes[np.maximum(p[:, None] - left, 0)]
    back[left > (p - first)[:, None]] = 0
    return rows, back


def _counts(length: int) -> str:
    """The type of common prefixes and distances, which are ``length`` at most."""
    return "<u1" if length < 1 << 8 else "<u2" if length < 1 << 16 else "<u4"


def _pack_run(rows, back, keys, p, low, high) -> bytes:
    """Front-code sorted suffixes; the columns follow one another, then all is compressed."""
    n, length = rows.shape
    kind = _counts(length)
    lcp = np.zeros(n, kind)
    if n > 1:
        differ = rows[1:] != rows[:-1]
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), length)
    rest = rows[np.arange(length) >= lcp[:, None]]
    parts = [np.array([n], "<i8"), keys.astype("<i8"), p.astype("<i8"), low.astype(kind), high.astype(kind), lcp, back, rest]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in parts))


def _unpack_run(blob: bytes, length: int):
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    at = 8
    out = []
    counts = _counts(length)
    for kind, width in (("<i8", 1), ("<i8", 1), (counts, 1), (counts, 1), (counts, 1), (np.uint8, length - GRAM)):
        out.append(np.frombuffer(data, kind, n * width, at))
        at += out[-1].nbytes
    keys, p, low, high, lcp, back = out
    suffixes, last = [], b""
    for h in lcp.tolist():
        last = last[:h] + data[at : at + length - h]
        at += length - h
        suffixes.append(last)
    return keys, p, low, high, lcp.tolist(), back.reshape(n, length - GRAM), suffixes


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs given with the common prefix of each suffix and the one before it.

    Returns the order as (run, index) and the common prefix of each merged
    suffix with its predecessor. Every run knows how much its head shares with
    the last suffix put out. Of two heads the one that shares more is smaller;
    only on a tie are bytes compared, and only those after the shared prefix.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    shared, place = [0] * k, [0] * k
    loser = [0] * k
    order: list[tuple[int, int]] = []
    common: list[int] = []

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix is then the one shared with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        h = shared[a]
        if h != shared[b]:
            return (a, b) if h > shared[b] else (b, a)
        x, y = x[h:], y[h:]
        if x == y:
            same = h + len(x)
        else:
            n = min(len(x), len(y))
            same = h + n - ((int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")).bit_length() + 7) // 8
        if y < x:
            a, b = b, a
        shared[b] = same
        return a, b

    def build(node: int) -> int:
        if node >= k:
            return node - k
        won, lost = play(build(2 * node), build(2 * node + 1))
        loser[node] = lost
        return won

    winner = build(1)
    while heads[winner] is not None:
        order.append((winner, place[winner]))
        common.append(shared[winner])
        suffixes, lcps = runs[winner]
        i = place[winner] = place[winner] + 1
        if i < len(suffixes):
            heads[winner], shared[winner] = suffixes[i], lcps[i]
        else:
            heads[winner] = None
        node = (winner + k) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2
    return order, common


def repeated_starts(common: np.ndarray, back: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in order, which distances ``d`` give a string that another one equals.

    A distance counts for a suffix from ``low`` to ``high``. Neighbours that
    share ``length - d`` bytes are one group; inside, equal bytes before the
    anchor make equal strings.
    """
    n, span = len(common), length - GRAM + 1
    out = np.zeros((n, span), bool)
    before = np.zeros(n, _U)
    for d in range(span):
        if d:
            before = before * _U(0x9E3779B97F4A7C15) + _BYTE[back[:, d - 1]]
        near = common >= length - d
        live = (low <= d) & (d <= high) & (near | np.append(near[1:], False))
        at = np.flatnonzero(live)
        if len(at) < 2:
            continue
        name = mix(mix(before[at]) + np.cumsum(~near)[at].astype(_U))
        _, inverse, counts = np.unique(name, return_inverse=True, return_counts=True)
        out[at, d] = counts[inverse] > 1
    return out


def _spans(hits: np.ndarray, keys: np.ndarray, p: np.ndarray, length: int) -> pd.DataFrame:
    """Byte spans ``(key, begin, end)`` of runs of repeated distances."""
    edge = np.diff(np.pad(hits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, near = np.nonzero(edge == 1)
    _, far = np.nonzero(edge == -1)
    return pd.DataFrame({"key": keys[row], "begin": p[row] - (far - 1), "end": p[row] - near + length})


def _runs(fed: DataFrame, length: int, bounds: np.ndarray, sent) -> DataFrame:
    """``(part, run)``: sorted front-coded runs of the suffixes that may repeat, cut at the range bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, frequent = (np.frombuffer(x, "<u8") for x in sent.value)
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            rows, back, keys, p, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(np.ascontiguousarray(rows).view(f"S{length}").ravel(), kind="stable")
            rows, back, keys, p, low, high = (x[order] for x in (rows, back, keys, p, low, high))
            part = np.searchsorted(bounds, np.ascontiguousarray(rows[:, :16]).view("S16").ravel(), "right")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            parts = [int(part[a]) for a in cuts[:-1]]
            blobs = [_pack_run(rows[a:b], back[a:b], keys[a:b], p[a:b], low[a:b], high[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "run"])

        for keys, offsets, pieces in _batches(batches, length):
            found = Pieces(pieces, length)
            some = np.flatnonzero(_in(repeated, found.gram) & ~_in(frequent, found.gram))
            if not len(some):
                continue
            owner, anchor = found.owner[some], found.anchor[some]
            place = anchor - found.begin[owner] + np.array(offsets)[owner]
            rows, back = _context(found, some, length)
            held.append((rows, back, np.array(keys)[owner], place, anchor - found.last[some], anchor - found.first[some]))
            if sum(len(x[2]) for x in held) >= ITEMS_A_RUN:
                yield flush()
        if held:
            yield flush()

    return fed.mapInArrow(run, "part int, run binary")


def _strings(fed: DataFrame, length: int, sent) -> DataFrame:
    """``(string, key, begin)``: every string whose anchor's gram is very frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(sent.value[1], "<u8")
        for keys, offsets, pieces in _batches(batches, length):
            found = Pieces(pieces, length)
            some = np.flatnonzero(_in(frequent, found.gram))
            sizes = found.last[some] - found.first[some] + 1
            starts = np.repeat(found.first[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            owner = np.repeat(found.owner[some], sizes)
            place = starts - found.begin[owner] + np.array(offsets)[owner]
            columns = [found.strings(starts).view(np.int64), np.array(keys)[owner], place]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["string", "key", "begin"])

    return fed.mapInArrow(run, "string bigint, key bigint, begin bigint")


def repeated_spans(docs: DataFrame, text: str = "text", length: int = 200) -> DataFrame:
    """``(key, spans, copies)`` per distinct text: its byte spans that strings found elsewhere cover.

    ``key`` is ``xxhash64`` of the text. ``spans`` is null if there are none;
    ``copies`` counts the rows with the text (with two or more, all of it repeats).
    """
    spark = docs.sparkSession
    fed = docs.where(F.octet_length(text) >= length).select(F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    counts = fed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    grams = _grams(fed, length).groupBy("gram").agg(F.sum("n").alias("n"), F.max("head").alias("head")).where("n > 1")
    grams = materialise(grams)
    items = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    filters = [_filter(grams, REPEATED_BITS), _filter(grams.where(F.col("n") >= FREQUENT), FREQUENT_BITS)]
    sent = spark.sparkContext.broadcast([f.tobytes() for f in filters])
    # Bounded: a sample of suffix starts, by hash, for the range bounds.
    drawn = grams.where("head IS NOT NULL").orderBy(F.xxhash64("gram")).limit(SAMPLE).select("head").toArrow()
    heads = np.sort(np.array([h.as_py() for h in drawn.column("head")], "S16"))
    ranges = max(1, int(items) // ITEMS_A_RANGE)
    bounds = np.unique(heads[np.arange(1, ranges) * len(heads) // ranges]) if len(heads) else heads

    def merged(runs: pd.DataFrame) -> pd.DataFrame:
        held = [_unpack_run(bytes(blob), length) for blob in runs["run"]]
        order, common = merge_runs([(h[6], h[4]) for h in held])
        base = np.cumsum([0] + [len(h[0]) for h in held])
        at = np.array([base[r] + i for r, i in order])
        keys, p, low, high = (np.concatenate([h[j] for h in held])[at] for j in range(4))
        back = np.concatenate([h[5] for h in held])[at]
        near = np.array(common) >= GRAM
        group = near | np.append(near[1:], False)  # the others agree with no neighbour
        hits = repeated_starts(np.array(common)[group], back[group], low[group], high[group], length)
        return _spans(hits, keys[group], p[group], length)

    runs = _runs(fed, length, bounds, sent)
    found = runs.groupBy("part").applyInPandas(merged, "key bigint, begin bigint, end bigint")
    if filters[1].any():
        strings = _strings(fed, length, sent)
        twice = strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("string")
        hit = strings.join(twice, "string").select("key", "begin", (F.col("begin") + length).alias("end"))
        found = found.unionByName(hit)
    spans = found.groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    return materialise(counts.join(spans, "key", "left").where("copies > 1 OR spans IS NOT NULL"))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the remaining UTF-8 bytes.

    Every byte goes that lies in a string of ``length`` bytes which also starts
    anywhere else, in the same text or another; strings don't cross texts, may
    overlap, and are judged on the input. ``n_spans`` counts the maximal removed
    runs. ``kept`` is binary, as a cut may fall inside a letter. A missing or
    short text loses nothing (missing: empty). Repeated rows repeat each other
    and lose all if long enough. Other columns pass through, columns with the
    names of the results are replaced, an empty table stays empty. Texts are
    told apart, and bytes before anchors compared, by 64-bit hashes.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    names = [c for c in docs.columns if c not in added]
    found = repeated_spans(docs, text, length).withColumnsRenamed({"key": "_key", "spans": "_spans", "copies": "_copies"})
    # The row travels as one column, so that no name of it can clash.
    keyed = docs.select(F.struct(*names).alias("_row"), F.xxhash64(text).alias("_key"))
    joined = keyed.join(found, "_key", "left").select("_row.*", F.col("_spans").alias("_1"), F.col("_copies").alias("_2"))
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, spans, copies in zip(*(batch.column(i).to_pylist() for i in (at, len(names), len(names) + 1)), strict=True):
                data = (t or "").encode()
                n = len(data)
                removed = np.zeros(n, bool)
                if n >= length and copies and copies > 1:
                    removed[:] = True
                elif spans:
                    for s in spans:
                        removed[s["begin"] : s["end"]] = True
                kept = np.frombuffer(data, np.uint8)[~removed].tobytes()
                edges = int(np.count_nonzero(np.diff(removed.astype(np.int8), prepend=0) == 1))
                out.append((n, n - len(kept), edges, kept))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            arrays = [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *arrays], names=[*names, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return joined.mapInArrow(run, f"{kinds}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
