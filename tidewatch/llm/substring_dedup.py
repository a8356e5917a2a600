"""Near-duplicate passages by compact windows.

A passage is a run of five-word shingles. For one hash function, all runs in
which a given shingle has the smallest value form a compact window: the run
may start anywhere from the place after the last smaller value before it and
end anywhere before the next smaller one. These windows are the nodes of the
Cartesian tree of the values; only those wide enough for a passage are kept,
about two per passage length. The windows of several hash functions are joined
by their intervals: the runs in a common piece of them share all minima, which
is their signature. There are several independent signatures, and one in common
is enough. Every signature is compared with its first occurrence, in
the document of the smallest key; so is every exact run of a passage's length
that begins with a shared signature. Pairs of documents that meet are verified
on the whole texts. Where a document shares more with a first holder than the
passages found, it meets the later holders of the signature too: those whose
run around the signature has one of its rarest shingles. Those runs are compared
by themselves, and only the first holder of a similar one on the whole texts.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import materialise, release, written

from .jaccard_join import HEAVY, SLOTS, _slots
from .textscan import BATCH_BYTES, Scan, in_batches, mix, shingles

_U = np.uint64
_INT = pa.int32()
KEY_BITS = 4


def _lowest(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of ``width`` places with one smallest value begin, its place, and its order among the others.

    Of equal values the leftmost counts as the smallest.
    """
    n = len(values)
    bits = _U(max(20, int(n).bit_length()))
    low, span = ((values >> bits) << bits) | np.arange(n, dtype=_U), 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: n - width + 1], low[width - span : width - span + n - width + 1])
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    low = low[start]
    return start, (low & ((_U(1) << bits) - _U(1))).astype(np.int64), low


def compact_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, first and last places of the compact windows of at least ``width`` places.

    Of equal values the leftmost counts as the smallest. Centres are the minima
    of all runs of ``width`` places. The next smaller value beside a centre is
    a centre itself, so the tree is built over the centres alone.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, centre, low = _lowest(values, width)
    begin, end = np.zeros(len(low), np.int64), np.full(len(low), n - 1, np.int64)
    stack: list[int] = []
    ranks = low.tolist()
    for i, value in enumerate(ranks):
        while stack and ranks[stack[-1]] > value:
            end[stack.pop()] = centre[i] - 1
        if stack:
            begin[i] = centre[stack[-1]] + 1
        stack.append(i)
    return centre, begin, end


class Joined:
    """The shingles of several texts one after another, each text followed by a barrier.

    A barrier is smaller than any shingle, so it is the centre of every run that
    crosses from one text to the next; such runs are left out.
    """

    def __init__(self, scan: Scan, k: int, words: int):
        sizes = np.diff(scan.first)
        texts = np.flatnonzero(sizes >= max(words, k))
        counts = sizes[texts] - k + 1
        ends = np.cumsum(counts + 1) - 1
        self.owner = np.repeat(texts, counts + 1)
        self.left = np.repeat(ends, counts + 1) - np.arange(len(self.owner))  # shingles up to the barrier
        if len(texts):
            first = np.repeat(scan.first[texts] - (ends - counts), counts + 1)
            place = np.minimum(first + np.arange(len(self.owner)), len(scan.hash) - k)
            self.grams = shingles(scan.hash, k)[place]
        else:
            self.grams = np.zeros(0, _U)

    def values(self, seed: np.uint64) -> np.ndarray:
        """One hash function: the order of its values is that of the shingles' hashes."""
        values = mix(self.grams ^ seed) >> _U(1) | _U(1 << 63)
        values[self.left == 0] = 0
        return values

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> Joined:
        """The same from the shingles of each text."""
        joined = cls.__new__(cls)
        sizes = np.fromiter((len(grams) + 1 for grams in texts), np.int64, len(texts))
        joined.owner = np.repeat(np.arange(len(texts)), sizes)
        joined.left = np.repeat(np.cumsum(sizes) - 1, sizes) - np.arange(len(joined.owner))
        joined.grams = np.concatenate([part for grams in texts for part in (grams, np.zeros(1, _U))]) if texts else np.zeros(0, _U)
        return joined

    def signatures(
        self, width: int, seeds: np.ndarray, every: np.ndarray | None = None, some: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where runs of ``width`` shingles with one signature begin, how many of them follow one another, and the signatures.

        A window holds the runs of exactly ``width`` that begin in one interval;
        the intervals of a hash function follow one another, so those of several
        are joined at their bounds. With the masks ``every`` and ``some`` only
        those are returned whose minima are all in one and not all outside the other.
        """
        runs = len(self.grams) - width + 1
        if runs < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
        windows = []
        for seed in seeds:
            values = self.values(seed)
            start, centre, _ = _lowest(values, width)
            windows.append((start, values[centre], centre))
        at = np.unique(np.concatenate([start for start, _, _ in windows]))
        joined = np.full(len(at), len(seeds), _U)
        whole = self.left[at] >= width  # the others cross a barrier, and so do all runs of their interval
        partly = np.full(len(at), some is None)
        for place, (start, value, centre) in enumerate(windows):
            window = np.searchsorted(start, at, "right") - 1
            joined = mix(joined + value[window] * _U(2 * place + 1))
            if every is not None:
                whole &= every[centre[window]]
            if some is not None:
                partly |= some[centre[window]]
        whole &= partly
        return at[whole], np.diff(np.append(at, runs))[whole], joined[whole]


def grams_of(scan: Scan, k: int) -> list[np.ndarray]:
    """The shingles of each text."""
    every, first = shingles(scan.hash, k), scan.first.tolist()
    return [
        every[begin : end - k + 1] if end - begin >= k else shingles(scan.hash[begin:end], k) for begin, end in zip(first[:-1], first[1:], strict=True)
    ]


def signatures(grams: np.ndarray, width: int, seeds: np.ndarray) -> np.ndarray:
    """Signatures of the runs of at least ``width`` shingles of one text, each once."""
    return np.unique(Joined.of([grams]).signatures(width, seeds)[2])


def _seeds(hashes: int, key: int = 0) -> np.ndarray:
    return mix(np.arange(7 + key * hashes, 7 + (key + 1) * hashes, dtype=_U))


def _named(signature: np.ndarray, key: int) -> np.ndarray:
    """Tokens of the key's signatures: its number is in the uppermost bits."""
    return signature >> _U(KEY_BITS) | _U(key << (64 - KEY_BITS))


def _once(owners: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token of each text once."""
    order = np.lexsort((tokens, owners))
    owners, tokens = owners[order], tokens[order]
    new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])])[: len(tokens)]
    return owners[new], tokens[new]


def _tokens(fed: DataFrame, k: int, words: int, tokens: Callable[[Joined], tuple[np.ndarray, np.ndarray]], holders=None) -> DataFrame:
    """``(token, id)``: each token of the shingles of each document of ``words`` words or more.

    ``tokens`` gives the places where tokens begin and the tokens, for many texts at once.
    Documents outside ``holders``, a filter of :func:`_slots`, are left out.
    """
    schema = T.StructType([*T.StructType.fromDDL("token bigint"), fed.schema["id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(holders.value, np.uint8) if holders else None
        for batch in batches:
            if holders:
                slot = batch.column("key").to_numpy() & (SLOTS - 1)
                batch = batch.filter(pa.array((held[slot >> 3] >> (slot & 7) & 1).astype(bool)))
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for at, some in in_batches(texts):
                joined = Joined(Scan(some), k, words)
                places, found = tokens(joined)
                owners, found = _once(joined.owner[places], found)
                ids = batch.column("id").take(pa.array(owners + at))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), ids], names=schema.names)

    return fed.select("id", "text", *(["key"] if holders else [])).mapInArrow(run, schema)


def _signatures(fed: DataFrame, k: int, width: int, hashes: int, keys: int) -> DataFrame:
    """``(token, id)``: each signature of each document, of ``keys`` independent groups of ``hashes`` functions."""

    def signed(joined: Joined) -> tuple[np.ndarray, np.ndarray]:
        places, found = [], []
        for key in range(keys):
            at, _, signature = joined.signatures(width, _seeds(hashes, key))
            places.append(at)
            found.append(_named(signature, key))
        return np.concatenate(places), np.concatenate(found)

    return _tokens(fed, k, width + k - 1, signed)


def _firsts(found: DataFrame) -> DataFrame:
    """``(token, y, n)``: the first document of each token that two documents have, and how many have it."""
    # Sums up before the shuffle, so a signature of very many documents is no hot key.
    counted = found.groupBy("token").agg(F.min("id").alias("y"), F.max("id").alias("z"), F.count(F.lit(1)).alias("n"))
    return counted.where("y <> z").select("token", "y", "n")


def _met(found: DataFrame, firsts: DataFrame) -> DataFrame:
    """``(token, x, y, n)``: the other documents of each token that two have."""
    # Such tokens are few beside all of them, and each is there once: their partitions are hashed, the others not sorted.
    return found.join(firsts.hint("shuffle_hash"), "token").where("id <> y").select("token", F.col("id").alias("x"), "y", "n")


def _exact(fed: DataFrame, k: int, width: int, full: int, hashes: int, shared, holders) -> DataFrame:
    """``(token, id)``: the hash of every run of ``full`` shingles that begins with a signature of the first key in ``shared``.

    The first document of a signature may hold its minima without the passage,
    while later ones share the passage. An exact passage has one signature in
    all documents, so the first document of each of these hashes holds it too.
    A signature that two documents have needs none: they meet by it. Only
    documents in ``holders`` are read.
    """
    seeds = _seeds(hashes)

    def begun(joined: Joined) -> tuple[np.ndarray, np.ndarray]:
        bits = np.frombuffer(shared.value, np.uint8)
        at, sizes, found = joined.signatures(width, seeds)
        slot = _named(found, 0) & _U(SLOTS - 1)
        wanted = (bits[slot >> _U(3)] >> (slot & _U(7)).astype(np.uint8) & 1).astype(bool)
        at, sizes = at[wanted], sizes[wanted]
        places = np.repeat(at, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        places = places[joined.left[places] >= full]
        return places, run_hashes(joined.grams, full)[places]

    return _tokens(fed, k, full + k - 1, begun, holders)


def _candidates(fed: DataFrame, shared: DataFrame, firsts: DataFrame, k: int, width: int, full: int, hashes: int, agree: int) -> DataFrame:
    """Pairs ``(x, y)``: ``y`` is the first document of a signature, or of an exact passage, that ``x`` has too."""
    spark, key = fed.sparkSession, F.shiftrightunsigned("token", 64 - KEY_BITS)
    met = shared.select("x", "y")
    if agree > 1:
        met = met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= agree).select("x", "y")
    least = 3 if agree == 1 else 2
    first_key = firsts.where((key == 0) & (F.col("n") >= least)).select("token", "y")
    ids = shared.where((key == 0) & (F.col("n") >= least)).select(F.col("x").alias("id")).unionByName(first_key.select(F.col("y").alias("id")))
    holders = _slots(spark, ids.select(F.xxhash64("id").alias("key")))
    runs = materialise(_exact(fed, k, width, full, hashes, _slots(spark, first_key.select(F.col("token").alias("key"))), holders))
    return met.unionByName(_met(runs, _firsts(runs)).select("x", "y")).distinct()


def _inside(sizes: np.ndarray) -> np.ndarray:
    """``0 .. size - 1`` for each size."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _held(packed: DataFrame, k: int, width: int, full: int, hashes: int, keys: int, holders, shared, columns: str, rows) -> DataFrame:
    """``rows`` of where signatures in ``shared`` begin in documents in ``holders``; both are filters of :func:`_slots`.

    ``rows`` gets the joined texts, the places where the signatures begin, how
    many runs of ``full`` shingles begin with each (``width`` at most, since
    they all hold the minima), and the signatures. It gives the index of the
    signature for each row, and its other columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wanted = np.frombuffer(holders.value, np.uint8), np.frombuffer(shared.value, np.uint8)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            slot = batch.column("key").to_numpy() & (SLOTS - 1)
            batch = batch.filter(pa.array((held[slot >> 3] >> (slot & 7) & 1).astype(bool)))
            texts = [unpack.decompress(data) for data in batch.column("packed").to_pylist()]
            for first, some in in_batches(texts):
                joined = Joined(Scan(some), k, full + k - 1)
                for key in range(keys):
                    at, sizes, found = joined.signatures(width, _seeds(hashes, key))
                    found = _named(found, key)
                    slot = found & _U(SLOTS - 1)
                    sizes = np.minimum(sizes, joined.left[at] - full + 1)
                    kept = np.flatnonzero((wanted[slot >> _U(3)] >> (slot & _U(7)).astype(np.uint8) & 1).astype(bool) & (sizes > 0))
                    at, sizes, found = at[kept], sizes[kept], found[kept]
                    if len(at):
                        of, *others = rows(joined, at, sizes, found)
                        ids = batch.column("id").take(pa.array(joined.owner[at][of] + first))
                        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)[of]), ids, *others], names=schema.names)

    schema = T.StructType([*T.StructType.fromDDL("token bigint"), packed.schema["id"], *T.StructType.fromDDL(columns)])
    return packed.select("id", F.xxhash64("id").alias("key"), "packed").mapInArrow(run, schema)


def rarest(grams: np.ndarray, counts: np.ndarray, width: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``(run, place)``: the rarest shingles of every run of ``width``, as many as one of a similar run must be among.

    A run whose set has ``percent`` of the union in common with another's lacks
    at most the rest of its own shingles, so of one more it has one in common,
    whichever they are. A shingle that a run has twice counts once; a smaller set
    may lack fewer, and one is given beyond those.
    """
    most = width - -(-percent * width // 100) + 1
    order = np.minimum(counts, (1 << 16) - 1).astype(_U) << _U(48) | grams.view(_U) >> _U(16)
    runs = np.lib.stride_tricks.sliding_window_view(order, width)
    ranked = np.sort(runs, axis=1)
    last = ranked[:, most - 1].copy()
    twice = np.flatnonzero((ranked[:, 1:] == ranked[:, :-1]).any(axis=1))
    if len(twice):
        rows = ranked[twice]
        new = np.concatenate([np.ones((len(rows), 1), bool), rows[:, 1:] != rows[:, :-1]], axis=1)
        nth = np.cumsum(new, axis=1)
        size = nth[:, -1:]
        last[twice] = np.where(nth <= size - -(-percent * size // 100) + 2, rows, _U(0)).max(axis=1)
    run, place = np.nonzero(runs <= last[:, None])
    return run, run + place


def _asked(mine: DataFrame, full: int, percent: int) -> DataFrame:
    """``(token, x, place, gram)``: the rarest shingles of the open runs of each document, by the place of the signature."""
    heavy = mine.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    heavy = heavy.orderBy(F.desc("n")).limit(HEAVY).toArrow().sort_by("gram")
    sent = mine.sparkSession.sparkContext.broadcast((heavy.column("gram").to_numpy(), heavy.column("n").to_numpy()))
    schema = T.StructType([*T.StructType.fromDDL("token bigint"), T.StructField("x", mine.schema["id"].dataType), *T.StructType.fromDDL("place int, gram bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value
        for batch in batches:
            every, opened = batch.column("grams").flatten().to_numpy(), batch.column("open").flatten().to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(batch.column("grams").value_lengths().to_numpy()))
            runs_end = np.append(0, np.cumsum(batch.column("open").value_lengths().to_numpy()))
            at = np.searchsorted(known, every)
            n = np.ones(len(every), np.int64)
            held = np.flatnonzero(at < len(known))
            held = held[known[at[held]] == every[held]]
            n[held] = counts[at[held]]
            rows, grams = [], []
            for i in range(len(batch)):
                here = slice(ends[i], ends[i + 1])
                runs, places = rarest(every[here], n[here], full, percent)
                picked = np.unique(every[here][places[opened[runs_end[i] : runs_end[i + 1]][runs]]])
                rows.append(np.full(len(picked), i))
                grams.append(picked)
            if rows:
                taken = batch.select(["token", "id", "place"]).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(grams))], names=schema.names)

    return mine.select("token", "id", "place", "grams", "open").mapInArrow(run, schema)


def _spans(judged: DataFrame, k: int) -> DataFrame:
    """``(id, spans)``: the shingles that the passages of each document cover."""
    span = F.struct(F.col("first_word").alias("b"), (F.col("first_word") + F.col("n_words") - (k - 1)).alias("e"))
    return judged.where("token IS NULL").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(span).alias("spans"))


def open_runs(places: np.ndarray, sizes: np.ndarray, of: np.ndarray, begin: np.ndarray, end: np.ndarray, full: int, percent: int) -> np.ndarray:
    """Of each row's runs of ``full`` shingles, ``sizes`` that follow one another from ``places``, whether no span covers them to ``percent``.

    Spans are given by the row they are ``of``, their begin and their end.
    """
    need = -(-percent * full // 100)
    at = np.cumsum(sizes + 1) - sizes - 1
    # A span that is long enough covers the runs that begin between two places.
    low = np.clip(begin - full + need - places[of], 0, sizes[of])
    high = np.clip(end - need + 1 - places[of], 0, sizes[of])
    some = np.flatnonzero((end - begin >= need) & (low < high))
    total = int(sizes.sum()) + len(sizes)
    covered = np.bincount(at[of[some]] + low[some], minlength=total) - np.bincount(at[of[some]] + high[some], minlength=total)
    return np.delete(np.cumsum(covered) == 0, at + sizes)


def _open(mine: DataFrame, full: int, percent: int) -> DataFrame:
    """``(token, id, place, grams, open)``: rows with a run that none of their ``spans`` covers to ``percent``, and which runs these are."""
    names = ["token", "id", "place", "grams"]
    schema = T.StructType([*(mine.schema[name] for name in names), *T.StructType.fromDDL("open array<boolean>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            of = np.repeat(np.arange(len(batch)), spans.value_lengths().fill_null(0).to_numpy())
            begin, end = (np.asarray(spans.flatten().field(name), np.int64) for name in ("b", "e"))
            sizes = batch.column("grams").value_lengths().to_numpy().astype(np.int64) - full + 1
            opened = open_runs(batch.column("place").to_numpy().astype(np.int64), sizes, of, begin, end, full, percent)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), _INT), pa.array(opened))
            kept = np.flatnonzero(np.add.reduceat(opened.astype(np.int64), np.cumsum(sizes) - sizes)) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, lists], names=schema.names).take(pa.array(kept))

    return mine.select(*names, "spans").mapInArrow(run, schema)


def _before(values: np.ndarray) -> np.ndarray:
    """The place of the equal value before each, or -1."""
    order = np.argsort(values, kind="stable")
    same = np.flatnonzero(values[order[1:]] == values[order[:-1]])
    out = np.full(len(values), -1)
    out[order[same + 1]] = order[same]
    return out


@functools.lru_cache(128)
def _windows(n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of ``least`` places and more of ``n`` begin, and which places each has."""
    begin, end = np.triu_indices(n + 1, least)
    place = np.arange(n)[:, None]
    return begin, ((begin <= place) & (place < end)).astype(np.float32)


def similar_runs(
    grams: tuple[np.ndarray, np.ndarray], opened: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray], full: int, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, run, missing shingles and whether it is similar to a run of the other's, of a row's open runs of ``full`` shingles.

    Each is given as the values of all rows and where those of a row begin. Runs
    that lack too many of their own shingles for any counterpart are left out.
    """
    (one, at), (wanted, runs_at), (two, two_at) = grams, opened, others
    least, low = -(-percent * full // 100), _U((1 << 32) - 1)
    mine = np.repeat(np.arange(len(at) - 1, dtype=_U), np.diff(at)) << _U(32) | one & low
    theirs = np.repeat(np.arange(len(two_at) - 1, dtype=_U), np.diff(two_at)) << _U(32) | two & low
    before, lacking = _before(mine), ~np.isin(mine, theirs)
    # A shingle that is missing counts at its first place only, so no run lacks fewer than are counted.
    count = np.append(0, np.cumsum(lacking & (before < 0)))
    of = np.repeat(np.arange(len(runs_at) - 1), np.diff(runs_at))
    start = at[of] + np.arange(len(wanted)) - runs_at[of]
    near = np.flatnonzero(wanted & (count[start + full] - count[start] <= full - least))
    kept, missing = [near[:0]], [near[:0]]
    for some in np.split(near, range(1 << 14, len(near), 1 << 14)):
        places = start[some][:, None] + np.arange(full)
        new = before[places] < start[some][:, None]
        size, lack = new.sum(axis=1), (new & lacking[places]).sum(axis=1)
        enough = 100 * (size - lack) >= percent * size
        kept.append(some[enough])
        missing.append(lack[enough])
    near = np.concatenate(kept)
    hits = [np.zeros(0, bool)]
    for part in np.split(near, np.flatnonzero(np.diff(of[near])) + 1) if len(near) else []:
        i = int(of[part[0]])
        x, y, runs = mine[at[i] : at[i + 1]], theirs[two_at[i] : two_at[i + 1]], part - runs_at[i]
        common = np.zeros((len(y), len(x) + 1), np.int16)
        np.cumsum(y[:, None] == x, axis=1, out=common[:, 1:])
        held = (common[:, runs + full] > common[:, runs]).T.astype(np.float32)  # of each run, which of y's shingles it has
        before_x, before_y = _before(x), _before(y)
        size = (before_x[runs[:, None] + np.arange(full)] < runs[:, None]).sum(axis=1)[:, None]
        begin, counted = _windows(len(y), -(-percent * int(size.min()) // 100))
        if (before_y >= 0).any():
            counted = counted * (before_y[:, None] < begin)
        both = held @ counted
        hits.append((100 * both >= percent * (size + counted.sum(axis=0) - both)).any(axis=1))
    return of[near], near - runs_at[of[near]], np.concatenate(missing), np.concatenate(hits)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for the jobs that run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


# Tables dealt by their token are joined by the token and more where they are.
BY_TOKEN = ("spark.sql.requireAllClusterKeysForCoPartition", "false")
# A job's shuffled rows leave the disk with it instead of when the driver's heap is next cleared.
TIDY = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def _similar(both: DataFrame, full: int, percent: int) -> DataFrame:
    """``(x, y)``: for each open run of ``x`` the first ``y`` that has a similar one, and the one that has most of it.

    The latter may have a longer run in common that is similar.
    """
    schema = T.StructType([both.schema["x"], both.schema["y"], *T.StructType.fromDDL("run int, lack int, similar boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = []
            for name in ("grams", "open", "others"):
                values = batch.column(name).flatten().to_numpy(zero_copy_only=False)
                ends = np.append(0, np.cumsum(batch.column(name).value_lengths().to_numpy()))
                flat.append((values if name == "open" else values.view(_U), ends))
            rows, runs, lack, similar = similar_runs(*flat, full, percent)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [taken.column("x"), taken.column("y"), pa.array(taken.column("place").to_numpy() + runs, _INT), pa.array(lack, _INT), pa.array(similar)],
                names=schema.names,
            )

    found = both.select("x", "y", "place", "grams", "open", "others").mapInArrow(run, schema)
    best = found.groupBy("x", "run").agg(F.min(F.when(F.col("similar"), F.col("y"))).alias("first"), F.min(F.struct("lack", "y")).alias("most"))
    return best.select("x", F.explode(F.array("first", "most.y")).alias("y")).where("y IS NOT NULL").distinct()


def _later(
    packed: DataFrame, shared: DataFrame, firsts: DataFrame, pairs: DataFrame, judged: DataFrame, k: int, width: int, full: int, percent: int, hashes: int, keys: int
) -> DataFrame | None:
    """Pairs ``(x, y)``: ``y`` holds a signature of ``x`` that a first holder left unsettled, and a similar run there.

    A signature is unsettled if one of its minima lies in no passage of the
    document and its first holder. The document's runs that begin with it are
    open unless a passage of the document covers them to ``percent``. All
    holders' runs take part; where all that begin with the signature are equal,
    those of the first document stand for the others. An open run meets those that have one of its rarest shingles, which
    similar ones must have, so a common line makes no pairs by itself. Of those
    that are similar the first that the document has not met is enough, with the one
    that has most of the run: what many documents have makes a pair or two for
    each of them, not for each two.
    """
    spark = packed.sparkSession
    unsettled = judged.where("token IS NOT NULL").select("token", F.col("doc_id").alias("id"), F.col("other_id").alias("y"))
    asking = materialise(unsettled.join(firsts.where("n > 2"), ["token", "y"]).select("token", "id").distinct())
    if asking.isEmpty():
        return None

    def holders(tokens: DataFrame, ids: DataFrame) -> tuple:
        return _slots(spark, ids.select(F.xxhash64("id").alias("key"))), _slots(spark, tokens.select(F.col("token").alias("key")))

    def whole(joined: Joined, at: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> tuple:
        begin = np.searchsorted(joined.owner, joined.owner[at])  # the place of the text's first shingle
        spread = sizes + full - 1
        grams = joined.grams[np.repeat(at, spread) + _inside(spread)].view(np.int64)
        ends = pa.array(np.append(0, np.cumsum(spread)), pa.int32())
        return np.arange(len(at)), pa.array(at - begin, _INT), pa.ListArray.from_arrays(ends, pa.array(grams))

    mine = _held(packed, k, width, full, hashes, keys, *holders(asking, asking), "place int, grams array<bigint>", whole)
    mine = materialise(_open(mine.join(asking, ["token", "id"]).join(_spans(judged, k), "id", "left"), full, percent))
    asked = materialise(_asked(mine, full, percent))
    pointed = _slots(spark, asked.select(F.col("token").bitwiseXOR(F.col("gram")).alias("key")))

    def runs(joined: Joined, at: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> tuple:
        bits = np.frombuffer(pointed.value, np.uint8)
        spread = sizes + full - 1
        begin = np.cumsum(spread) - spread
        of = np.repeat(np.arange(len(at)), spread)
        place = at[of] + _inside(spread)
        slot = (tokens[of] ^ joined.grams[place]) & _U(SLOTS - 1)
        hit = (bits[slot >> _U(3)] >> (slot & _U(7)).astype(np.uint8) & 1).astype(bool)
        # The hash of all runs together names them; equal ones differ in no place.
        hashed = np.add.reduceat(mix(joined.grams[place] + _inside(spread).astype(_U)), begin)
        owners, wanted = _once(of[hit], joined.grams[place[hit]])
        hits = np.bincount(owners, minlength=len(at))
        kept = np.flatnonzero(hits)
        ends = pa.array(np.append(0, np.cumsum(spread[kept])), pa.int32())
        grams = pa.array(joined.grams[place[np.repeat(hits > 0, spread)]].view(np.int64))
        asked_ends = pa.array(np.append(0, np.cumsum(hits[kept])), pa.int32())
        return (
            kept,
            pa.array(hashed[kept].view(np.int64)),
            pa.ListArray.from_arrays(ends, grams),
            pa.ListArray.from_arrays(asked_ends, pa.array(wanted.view(np.int64))),
        )

    tokens = materialise(asked.select("token").distinct())
    known = shared.select("token", F.col("x").alias("id")).unionByName(firsts.select("token", F.col("y").alias("id")))
    theirs = _held(packed, k, width, full, hashes, keys, *holders(tokens, known.join(tokens, "token")), "part bigint, grams array<bigint>, hits array<bigint>", runs)
    first = theirs.groupBy("token", "part").agg(F.min(F.struct("id", "grams", "hits")).alias("c"))
    classes = materialise(first.select("token", "part", F.col("c.id").alias("y"), "c.grams", "c.hits"))
    # The runs of a token lie in one task already when they are put beside each other, so they are moved once only.
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = classes.select("token", "part", "y", F.explode("hits").alias("gram")).repartition(dealt, "token")
    others = classes.select("token", "part", F.col("grams").alias("others")).repartition(dealt, "token").hint("shuffle_hash")
    tried = pairs.groupBy("x").agg(F.collect_set("y").alias("tried"))
    runs_of = mine.withColumnRenamed("id", "x").join(tried, "x", "left").repartition(dealt, "token").hint("shuffle_hash")
    with _setting(spark, *BY_TOKEN):
        met = asked.repartition(dealt, "token").join(held, ["token", "gram"]).where("y < x").select("token", "x", "place", "part", "y").distinct()
        both = met.join(others, ["token", "part"]).join(runs_of, ["token", "x", "place"]).where("NOT coalesce(array_contains(tried, y), false)")
        return materialise(_similar(both, full, percent))


def run_hashes(grams: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` shingles."""
    n, out, span = len(grams), grams, 1
    if n < width:
        return grams[:0]
    while 2 * span <= width:
        out = mix(out[:-span] * _U(3) + out[span:])
        span *= 2
    if span < width:
        out = mix(out[: n - width + 1] * _U(3) + out[width - span : n - span + 1])
    return out


def exact_repeats(x: np.ndarray, y: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """Runs of ``x`` of ``width`` or more that ``y`` has as they are: ``(begin, end, begin in y)``; all such runs are covered."""
    one, two = run_hashes(x, width), run_hashes(y, width)
    if not len(one) or not len(two):
        return
    order = np.argsort(two, kind="stable")
    at = np.minimum(np.searchsorted(two, one, sorter=order), len(two) - 1)
    partner = order[at]
    held = np.flatnonzero(two[partner] == one)
    i = 0
    while i < len(held):
        begin, left = int(held[i]), int(partner[held[i]])
        end, step, most = begin + width, width, min(len(x), len(y) - left + begin)
        while end < most:
            size = min(step, most - end)
            differ = np.flatnonzero(x[end : end + size] != y[left + end - begin : left + end - begin + size])
            if len(differ):
                end += int(differ[0])
                break
            end += size
            step *= 2
        yield begin, end, left
        i = int(np.searchsorted(held, end - width, "right"))


class Ranked:
    """The shingles of a text in the order of their hashes, and of each the range of its equals."""

    def __init__(self, grams: np.ndarray):
        self.grams, places = grams, np.arange(len(grams))
        self.order = np.argsort(grams, kind="stable")
        self.ranked = grams[self.order]
        new = np.ones(len(grams) + 1, bool)
        np.not_equal(self.ranked[1:], self.ranked[:-1], out=new[1:-1])
        self.distinct = bool(new.all())
        if self.distinct:
            self.first = self.last = places
        else:
            start = np.flatnonzero(new)
            of = np.cumsum(new[:-1]) - 1
            self.first, self.last = start[of], start[of + 1] - 1
            self.occurrence = self.first * len(grams) + self.order

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first equal of each in the order, and whether there is one."""
        at = np.minimum(np.searchsorted(self.ranked, grams), len(self.ranked) - 1)
        return at, self.ranked[at] == grams


def _middle(values: np.ndarray) -> int:
    """The median without its fraction."""
    ranked, half = np.sort(values), len(values) // 2
    return int(ranked[half]) if len(values) % 2 else int((int(ranked[half - 1]) + int(ranked[half])) / 2)


def passages(x: np.ndarray, y: np.ndarray, width: int, percent: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of shingles of ``x`` that repeat in ``y``: ``(begin, end, begin, end, common, union)``, ends exclusive.

    Unbroken runs of common shingles are joined over gaps while the whole would
    still be similar enough. A run counts if it is ``width`` long and its set is
    similar to that of its counterpart; a shorter one is widened if it is similar
    enough with what stands beside it. If a joined run is not, its unbroken
    parts are tried by themselves.
    """
    other = Ranked(y)
    return _passages(Ranked(x), other, *other.find(x), width, percent)


def _passages(one: Ranked, two: Ranked, at: np.ndarray, common: np.ndarray, width: int, percent: int) -> list[tuple[int, int, int, int, int, int]]:
    """:func:`passages`, where :meth:`Ranked.find` has given ``at`` and ``common``."""
    x, y, order = one.grams, two.grams, two.order
    first = order[at]  # the first place in y of each common shingle
    edges = np.flatnonzero(np.diff(np.concatenate([[False], common, [False]]).astype(np.int8)))
    unbroken = list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))
    # Of shingles that are equal in y, the last; where there is one only, both ends are the same.
    ends = (first,) if two.distinct else (first, order[two.last[at]])

    def nearest(places: np.ndarray, shift: int) -> np.ndarray:
        if two.distinct:
            return first[places]
        low, high = at[places], two.last[at[places]]
        aim = np.clip(places + shift, 0, len(y) - 1)
        right = np.searchsorted(two.occurrence, low * len(y) + aim)
        left = order[np.clip(right - 1, low, high)]
        right = order[np.clip(right, low, high)]
        return np.where(np.abs(left - aim) <= np.abs(right - aim), left, right)

    def counterparts(begin: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """Runs of both sides to compare: along one shift, or anywhere if the text repeats itself."""
        places = np.flatnonzero(common[begin:end]) + begin
        for edge in ends:
            shift = _middle(edge[places] - places)
            there = nearest(places, shift)
            near = np.abs(there - places - shift) <= 8 + (end - begin) * (100 - percent) // 100
            if near.any():
                left, right = int(there[near].min()), int(there[near].max()) + 1
                yield begin, end, left, right
                yield begin, end, max(0, begin + shift), min(len(y), end + shift)
                yield int(places[near][0]), int(places[near][-1]) + 1, left, right
        there = first[places]
        yield begin, end, int(there.min()), int(there.max()) + 1

    def widened(begin: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """Runs of ``width`` around one that is shorter, as an edit near the end of a passage leaves it."""
        places = np.flatnonzero(common[begin:end]) + begin
        for edge in ends:
            shift = _middle(edge[places] - places)
            for start in range(max(0, end - width, -shift), min(begin, len(x) - width, len(y) - width - shift) + 1):
                yield start, start + width, start + shift, start + shift + width

    def sizes(start: int, stop: int, left: int, right: int) -> tuple[int, int]:
        """How many shingles both runs have, and either."""
        if one.distinct and two.distinct:
            there = first[start:stop][common[start:stop]]
            both = int(np.count_nonzero((there >= left) & (there < right)))
            return both, min(stop, len(x)) - start + min(right, len(y)) - left - both
        mine, theirs = np.unique(x[start:stop]), np.unique(y[left:right])
        both = len(np.intersect1d(mine, theirs, assume_unique=True))
        return both, len(mine) + len(theirs) - both

    def similar(begin: int, end: int) -> tuple[int, ...] | None:
        for start, stop, left, right in counterparts(begin, end) if end - begin >= width else widened(begin, end):
            if stop - start < width or right - left < 1:
                continue
            both, union = sizes(start, stop, left, right)
            if 100 * both >= percent * union:
                return (start, stop, left, right, both, union)
        return None

    joined: list[list[int]] = []  # begin, end, common places, first and last part
    for i, (begin, end) in enumerate(unbroken):
        if joined:
            size, both = end - joined[-1][0], joined[-1][2] + end - begin
            if 100 * both >= percent * (2 * size - both):
                joined[-1][1], joined[-1][2], joined[-1][4] = end, both, i
                continue
        joined.append([begin, end, end - begin, i, i])
    found = []
    for begin, end, size, head, tail in joined:
        if end - begin < width and 100 * size < percent * (2 * width - size):
            continue
        hit = similar(begin, end)
        if hit:
            found.append(hit)
        elif head < tail:
            found.extend(filter(None, (similar(*part) for part in unbroken[head : tail + 1] if part[1] - part[0] >= width)))
    wide = [part for part in unbroken if part[1] - part[0] >= width]
    if wide:
        covered = np.zeros(len(x), bool)
        for begin, end, *_ in found:
            covered[begin:end] = True
        # An exact repeat lies within an unbroken run, so there is nothing to add where all of them are covered.
        if not all(covered[begin:end].all() for begin, end in wide):
            for begin, end, left in exact_repeats(x, y, width):
                if not covered[begin:end].all():
                    size = len(np.unique(x[begin:end]))
                    found.append((begin, end, left, left + end - begin, size, size))
    return found


def _packed(fed: DataFrame, wanted) -> DataFrame:
    """``(key, text_key, packed)``: the compressed text of documents that may be in ``wanted``, one per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, pack = np.frombuffer(wanted.value, np.uint8), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            slot = batch.column("key").to_numpy() & (SLOTS - 1)
            batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7) & 1).astype(bool)))
            packed = [pack.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array(packed, pa.binary())], names=["id", "text_key", "packed"]
            )

    schema = T.StructType([fed.schema["id"], *T.StructType.fromDDL("text_key bigint, packed binary")])
    found = fed.mapInArrow(run, schema)
    return found.groupBy("id").agg(F.min(F.struct("text_key", "packed")).alias("t")).select("id", "t.*")


def _compared(packed: DataFrame, pairs: DataFrame, k: int, width: int, full: int, percent: int, hashes: int, keys: int) -> DataFrame:
    """Passages of the pairs' whole texts, and ``token`` alone for each signature of ``x`` that ``y`` may have outside of them."""
    spark: SparkSession = packed.sparkSession
    left = packed.select(F.col("id").alias("x"), F.col("text_key"), F.col("packed").alias("left"))
    right = packed.select(F.col("id").alias("y"), F.col("packed").alias("right"))
    both = pairs.join(left, "x").join(right, "y").select("x", "y", "text_key", "left", "right")
    if not keys:  # the later holders' texts are few, and so would be the tasks that compare them
        both = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "x")
    kind = packed.schema["id"].dataType
    places = "text_key bigint, first_word int, n_words int, other_first_word int, other_n_words int, similarity double, token bigint"
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("other_id", kind), *T.StructType.fromDDL(places)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, held = zstandard.ZstdDecompressor(), {}

        def ranked(some: list[bytes]) -> dict[bytes, Ranked]:
            """Each text once; those of the rows before are kept, as rows follow one another by one side."""
            new = [data for data in dict.fromkeys(some) if data not in held]
            found = {data: held[data] for data in some if data in held}
            texts = [unpack.decompress(data) for data in new]
            for at, part in in_batches(texts):
                found.update(zip(new[at : at + len(part)], map(Ranked, grams_of(Scan(part), k)), strict=True))
            held.clear()
            held.update(found)
            return found

        def outside(texts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            """Row and signature, where all minima are shared and not all of them covered."""
            joined = Joined.of([grams for _, grams, _, _ in texts])
            every, some = (np.concatenate([np.append(one[c], False) for one in texts]) for c in (2, 3))
            of, rows, tokens = np.array([i for i, *_ in texts]), [], []
            for key in range(keys):
                at, _, found = joined.signatures(width, _seeds(hashes, key), every, some)
                owners, found = _once(of[joined.owner[at]], _named(found, key))
                rows.append(owners)
                tokens.append(found.view(np.int64))
            return np.concatenate(rows), np.concatenate(tokens)

        def out(batch: pa.RecordBatch, rows: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
            taken = batch.select(["x", "y", "text_key"]).take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays([*taken.columns, *columns], names=schema.names)

        def compared(batch: pa.RecordBatch, lefts: list[bytes], rights: list[bytes]) -> Iterator[pa.RecordBatch]:
            texts, rows, spans, left, size = ranked([*lefts, *rights]), [], [], [], 0
            for i, (mine, theirs) in enumerate(zip(lefts, rights, strict=True)):
                one, two = texts[mine], texts[theirs]
                x = one.grams
                if len(x) >= full and len(two.grams) >= full:
                    at, shared = two.find(x)
                    covered = np.zeros(len(x), bool)
                    for begin, end, b2, e2, common, union in _passages(one, two, at, shared, full, percent):
                        rows.append(i)
                        spans.append((begin, end - begin + k - 1, b2, e2 - b2 + k - 1, common / union))
                        covered[begin:end] = True
                    bare = np.flatnonzero(shared & ~covered) if keys else []
                    # Only runs that hold one of these places count.
                    for part in np.split(bare, np.flatnonzero(np.diff(bare) >= 2 * width) + 1) if len(bare) else []:
                        here = slice(max(0, int(part[0]) - width + 1), int(part[-1]) + width)
                        left.append((i, x[here], shared[here], (shared & ~covered)[here]))
                        size += len(left[-1][1])
                if left and (size >= 1 << 19 or i == len(lefts) - 1):
                    of, tokens = outside(left)
                    yield out(batch, of, *(pa.nulls(len(of), t) for t in kinds), pa.array(tokens))
                    left, size = [], 0
            columns = list(zip(*spans, strict=True)) if spans else [[]] * 5
            yield out(batch, rows, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.nulls(len(rows), pa.int64()))

        kinds = [_INT] * 4 + [pa.float64()]
        for batch in batches:
            lefts, rights = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            # Rows of bounded size together; a packed text is about a third of its size.
            ends = np.cumsum([len(a) + len(b) for a, b in zip(lefts, rights, strict=True)]) // (BATCH_BYTES // 4)
            for part in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(ends)) + 1) if len(batch) else []:
                at, to = int(part[0]), int(part[-1]) + 1
                yield from compared(batch.slice(at, to - at), lefts[at:to], rights[at:to])

    return both.mapInArrow(run, schema)


def repeated_passages(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    k: int = 5,
    min_words: int = 50,
    percent: int = 80,
    hashes: int = 2,
    agree: int = 1,
    slack: int = 6,
    keys: int = 3,
) -> DataFrame:
    """Passages that repeat one of a document with a smaller key.

    One row per passage and partner: ``doc_id``, ``other_id`` (the key's type),
    ``first_word``, ``n_words`` of the passage in the document,
    ``other_first_word``, ``other_n_words``, ``similarity`` (Jaccard of the
    shingle sets of both runs, at least ``percent``), ``text_key`` (hash of the
    text that the places refer to). Passages have ``min_words`` words or more.

    Every whole text is used; words are split at ASCII blanks, case counts.
    Windows are made for runs ``slack`` shingles shorter than a passage. A
    missing or short text has no passage; a missing key can't be named, so its
    row takes no part; of rows with one key and different texts the one with
    the smallest text hash stands for all. Repeats within one document are not
    reported. An empty table gives an empty result. Exact repeats are found
    always, since runs of a whole passage with a shared signature are matched
    by themselves. Others are found with the probability of the hash
    functions: a passage of similarity s shares each signature with about
    ``s ** hashes``, of which there are ``keys`` independent ones (16 at most)
    for every run. Where the shingles of a signature are not all in passages of
    the document and the signature's first holder, each of the document's
    runs there is compared with those of every later holder (equal ones once, by
    the smallest key), however many there are, and the document with the first
    that has a similar one; runs that a passage covers to ``percent`` are left out. Pairs with a first holder need ``agree`` common signatures, or
    an exact repeat.
    """
    if not 1 <= keys <= 1 << KEY_BITS:
        raise ValueError(f"there are 1 to {1 << KEY_BITS} signatures")
    fed = docs.where(F.col(key).isNotNull()).select(
        F.col(key).alias("id"), F.xxhash64(F.col(key)).alias("key"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text")
    )
    full = min_words - k + 1
    width = max(2, full - slack)
    spark = fed.sparkSession
    with _setting(spark, *TIDY):
        others = written(spark)
        found = materialise(_signatures(fed, k, width, hashes, keys))
        signed = [path for path in written(spark) if path not in others]
        firsts = materialise(_firsts(found))
        shared = materialise(_met(found, firsts))
        release(spark, signed)  # most signatures are of one document and not read again
        pairs = materialise(_candidates(fed, shared, firsts, k, width, full, hashes, agree))
        held = pairs if agree == 1 else shared
        named = held.select(F.col("x").alias("id")).unionByName(held.select(F.col("y").alias("id")))
        packed = materialise(_packed(fed, _slots(spark, named.select(F.xxhash64("id").alias("key")))))
        judged = materialise(_compared(packed, pairs, k, width, full, percent, hashes, keys))
        later = _later(packed, shared, firsts, pairs, judged, k, width, full, percent, hashes, keys)
        if later is not None:
            judged = judged.unionByName(materialise(_compared(packed, later, k, width, full, percent, hashes, 0)))
    return judged.where("token IS NULL").drop("token")


def without_passages(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the words of the found passages cut out of the texts.

    Cuts go from the start of a passage's first word to the start of the word
    after its last; the rest of the text is untouched. Documents without a
    passage, and rows whose text is not the one the places refer to, stay as
    they are. All columns are returned.
    """
    spans = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text_key")).agg(
        F.collect_set(F.struct("first_word", "n_words")).alias("_spans")
    )
    # The row travels as one column, so that no name of it can clash.
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"))
    same = (F.col("_key") == F.col("_id")) & (F.col("_hash") == F.col("_text_key"))
    marked = rows.join(spans, same, "left").select("_row.*", F.col("_spans").alias("_1"))
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, spans in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if not spans:
                    out.append(t)
                    continue
                data = (t or "").encode()
                start = np.append(Scan([data]).start, len(data))
                keep = np.ones(len(data), bool)
                for s in spans:
                    keep[start[s["first_word"]] : start[min(s["first_word"] + s["n_words"], len(start) - 1)]] = False
                out.append(np.frombuffer(data, np.uint8)[keep].tobytes().decode())
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.mapInArrow(run, docs.schema)
