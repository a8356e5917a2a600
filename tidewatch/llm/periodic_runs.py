"""Periodic runs of words, found by scale-tiled distribution.

A run is a stretch of words with smallest period ``q`` that is at least four
periods and six words long and that no neighbouring word extends. Periods are
taken by octaves, ``B`` to ``2 B - 1`` for ``B`` = 1, 2, 4 and so on. For each
octave a text is cut into overlapping tiles whose size goes with ``B``; tiles
are rows that any task may solve, so a very long text is many tasks' work.

Every ``2 B`` words of a tile stands a boundary. Two Z-functions at a boundary
tell for all periods of the octave at once how far the period holds to the right
and to the left; as a run of the octave is at least ``4 B`` long, some boundary
lies a period or more before its end. What a tile finds ends at the tile's
edges; fragments are shuffled by document and period and stitched where they
overlap by a period.

Only stretches that may hold a run of the octave become tiles: inside a run,
after its first period, every four words (fewer for periods under four) came
before at a distance of the period at most. Texts without such a stretch are
finished where they are read; texts are read twice instead of being written.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import materialise

from .textscan import Scan, in_batches, mix

EXPONENT = 4
SHORTEST = 6
TILE_WORDS = 4096
TILE_BOUNDARIES = 8  # of a tile, at least
TILES_A_BATCH = 64
TILES_A_TASK = 4096

_U = np.uint64
_FAR = np.iinfo(np.int64).max
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _gaps(scan: Scan) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each octave the words of a gram and where its last occurrence in the text is near enough, word by word."""
    words = scan.hash
    n, sizes = len(words), np.diff(scan.first)
    if not n:
        return
    longest = int(sizes.max())
    place = np.arange(n) - np.repeat(scan.first[:-1], sizes)
    equal = {}
    for q in (1, 2, 3):
        equal[q] = np.zeros(n, bool)
        equal[q][q:] = (words[q:] == words[:-q]) & (place[q:] >= q)
    yield 0, 1, equal[1]
    yield 1, 1, equal[1] | equal[2] | equal[3]
    ends = np.flatnonzero(place >= 3)
    gram = mix(mix(mix(words[ends - 3] + _U(1)) + words[ends - 2]) + words[ends - 1]) + words[ends]
    order = np.argsort(gram, kind="stable")
    gram, ends = gram[order], ends[order]
    distance = ends[1:] - ends[:-1]
    # Places of one text are next to each other among equal grams.
    again = (gram[1:] == gram[:-1]) & (place[ends[1:]] - distance >= 3)
    gap = np.full(n, _FAR)
    gap[ends[1:][again]] = distance[again]
    octave = 2
    while EXPONENT << octave <= longest:
        yield octave, 4, gap < 2 << octave
        octave += 1


def regions(scan: Scan) -> Iterator[tuple[int, int, int, int]]:
    """Text, octave, first word and end of every stretch that may hold runs of the octave.

    A run lies in one stretch whole, and not at its first word unless that
    begins the text.
    """
    for octave, gram, near in _gaps(scan):
        step = 1 << octave
        least = max((EXPONENT - 1) * step - gram + 1, SHORTEST - 1 if octave == 0 else 0)
        edge = np.flatnonzero(np.diff(near.astype(np.int8), prepend=0, append=0))
        begin, end = edge[0::2], edge[1::2]
        enough = end - begin >= least
        begin, end = begin[enough], end[enough]
        text = np.searchsorted(scan.first, begin, "right") - 1
        first = scan.first[text]
        begin = np.maximum(first, begin - 2 * step - gram + 1)
        yield from zip(text.tolist(), [octave] * len(text), (begin - first).tolist(), (end - first).tolist())


def tiles(words: np.ndarray, octave: int, begin: int, end: int) -> Iterator[tuple[int, int, int, bool, bool, bytes]]:
    """A region's tiles: place, first boundary, boundaries, whether it goes on to the left and right, and its words as numbers."""
    step = 2 << octave
    boundaries = range(-(-begin // step) * step, end - (1 << octave) + 1, step)
    each = max(TILE_BOUNDARIES, TILE_WORDS // step)
    for i in range(0, len(boundaries), each):
        own = boundaries[i : i + each]
        at, to = max(begin, own[0] - step), min(end, own[-1] + 2 * step)
        numbers = np.unique(words[at:to], return_inverse=True)[1].astype(np.int32)
        yield at, own[0], len(own), at > begin, to < end, numbers.tobytes()


def z_function(s: list[int]) -> list[int]:
    """For every place how many of the numbers from there on equal those from the beginning on."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@functools.lru_cache(1 << 16)
def _largest_divisors(q: int) -> tuple[int, ...]:
    """``q`` divided by each of its primes: a word of length ``q`` is a power if one of these is its period."""
    found, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            found.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    if rest > 1:
        found.append(q // rest)
    return tuple(found)


def solve(words: list[int], octave: int, boundary: int, boundaries: int, goes_left: bool, goes_right: bool) -> list[tuple[int, int, int]]:
    """Period, begin and end of the tile's fragments; ``boundary`` and the results count from the tile's first word.

    Fragments that end inside the tile on both sides are whole and are left out
    if they are too short.
    """
    low, step, size = 1 << octave, 2 << octave, len(words)
    found: dict[int, list[list[int]]] = {}
    for at in range(boundary, boundary + boundaries * step, step):
        ahead = z_function(words[at : at + 2 * step])
        top = min(step - 1, size - at)
        behind = words[max(0, at - step) : at][::-1]
        back = z_function([*behind, -1, *words[max(0, at - step) : at + top][::-1]])[len(behind) + 1 :]
        for q in range(low, top + 1):
            end = at + q + (ahead[q] if q < len(ahead) else 0)
            begin = at - back[top - q]
            if end - begin < 2 * q or any(ahead[d] >= q - d for d in _largest_divisors(q)):
                continue
            stretches = found.setdefault(q, [])
            if stretches and begin + q <= stretches[-1][1]:
                stretches[-1][1] = max(end, stretches[-1][1])
            else:
                stretches.append([begin, end])
    return [
        (q, begin, end)
        for q, stretches in found.items()
        for begin, end in stretches
        if end - begin >= max(SHORTEST, EXPONENT * q) or (goes_left and begin == 0) or (goes_right and end == size)
    ]


_TILE = "_at long, _boundary long, _boundaries int, _left boolean, _right boolean, _words binary"
_TILE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]


def _scans(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, list[bytes], Scan]]:
    bodies = [(t or "").encode() for t in batch.column("_row").field(text).to_pylist()]
    for at, some in in_batches(bodies):
        yield at, some, Scan(some)


def _tiled(docs: DataFrame, text: str) -> DataFrame:
    """Written: the rows of texts that may hold runs (``_octave`` null), and their tiles (``_row`` null)."""
    fed = docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_number"))
    row = fed.schema["_row"].dataType
    names = ["_row", "_number", "_octave", *(part.split()[0] for part in _TILE.split(", "))]

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers = batch.column("_row"), batch.column("_number").to_pylist()

            def send(some: list[tuple]) -> pa.RecordBatch:
                number, octave, *rest = zip(*some)
                columns = [pa.nulls(len(some), rows.type), pa.array(number, pa.int64()), pa.array(octave, pa.int32())]
                return pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in zip(rest, _TILE_TYPES))], names=names)

            waiting, taken = [], set()
            for at, _, scan in _scans(batch, text):
                for i, octave, begin, end in regions(scan):
                    taken.add(at + i)
                    for found in tiles(scan.words_of(i), octave, begin, end):
                        waiting.append((numbers[at + i], octave, *found))
                        if len(waiting) == TILES_A_BATCH:
                            yield send(waiting)
                            waiting = []
            if waiting:
                yield send(waiting)
            if taken:
                kept = pa.array(sorted(taken))
                empty = [pa.nulls(len(kept), t) for t in (pa.int32(), *_TILE_TYPES)]
                yield pa.RecordBatch.from_arrays([rows.take(kept), batch.column("_number").take(kept), *empty], names=names)

    return materialise(fed.mapInArrow(tile, f"_row {row.simpleString()}, _number long, _octave int, {_TILE}"))


def _solved(tiled: DataFrame) -> DataFrame:
    """Fragments ``_number, period, begin, end`` of the tiles, which are dealt out evenly."""
    names, types = ["_number", "period", "begin", "end"], [pa.int64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, octave, at, boundary, boundaries, left, right, words in zip(*(c.to_pylist() for c in batch.columns)):
                numbers = np.frombuffer(words, np.int32).tolist()
                for q, begin, end in solve(numbers, octave, boundary - at, boundaries, left, right):
                    out.append((number, q, at + begin, at + end))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    own = tiled.where("_octave IS NOT NULL").select("_number", "_octave", *(part.split()[0] for part in _TILE.split(", ")))
    # Tiles are small and take time: tasks are counted out by tiles, not by bytes.
    dealt = own.repartition(own.count() // TILES_A_TASK + 1, "_number", "_octave", "_at")
    return dealt.mapInArrow(run, "_number long, period long, begin long, end long")


def _stitched(fragments: DataFrame) -> DataFrame:
    """Runs ``_number, start, length, period``: fragments of one period that overlap by a period are one."""
    order = Window.partitionBy("_number", "period").orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("begin") + F.col("period") <= reach, 0).otherwise(1)
    island = F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = fragments.withColumn("_opens", opens).withColumn("_island", island)
    whole = marked.groupBy("_number", "period", "_island").agg(F.min("begin").alias("start"), (F.max("end") - F.min("begin")).alias("length"))
    long_enough = F.col("length") >= F.greatest(F.lit(SHORTEST), EXPONENT * F.col("period"))
    return whole.where(long_enough).select("_number", "start", "length", "period")


def collapsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``_row``, with its ``runs`` (start, length, period) and the ``collapsed`` text.

    Words are runs of anything but the space and the ASCII control spaces,
    numbered from 0 and compared by 64-bit hashes inside a text. Runs are
    sorted by start, then period. The collapsed text has, one space apart, the
    words that lie in no run, or in the first period of every run they lie in. A
    missing, empty or blank text has no runs and collapses to the empty text.
    Rows are told apart by a number in the written copy, so repeated rows and
    keys stay separate. Row numbers, fragments and runs are all that is
    shuffled of a text, besides the tiles and texts of stretches that may hold
    runs.
    """
    tiled = _tiled(docs, text)
    found = F.struct("start", "length", "period")
    runs = _stitched(_solved(tiled)).groupBy("_number").agg(F.sort_array(F.collect_list(found)).alias("runs"))
    held = tiled.where("_octave IS NULL").select("_row", "_number").join(runs, "_number", "left")
    rows = held.select("_row", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))
    shape = f"_row {rows.schema['_row'].dataType.simpleString()}, runs {RUNS}, collapsed string"
    runs_type = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, found in zip(batch.column("_row").field(text).to_pylist(), batch.column("runs").to_pylist()):
                words = (body or "").encode().split()
                keep = np.ones(len(words), bool)
                for r in found:
                    keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
                out.append(b" ".join(words[i] for i in np.flatnonzero(keep).tolist()).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["_row", "runs", "collapsed"])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, out = [], []
            for at, bodies, scan in _scans(batch, text):
                taken = {i for i, *_ in regions(scan)}
                free = [i for i in range(len(bodies)) if i not in taken]
                kept += [at + i for i in free]
                out += [b" ".join(bodies[i].split()).decode() for i in free]
            none = pa.array([[]] * len(kept), runs_type)
            rows = batch.column("_row").take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, none, pa.array(out, pa.string())], names=["_row", "runs", "collapsed"])

    without = docs.select(F.struct(*docs.columns).alias("_row")).mapInArrow(plain, shape)
    return rows.mapInArrow(cut, shape).unionByName(without)


def strongest(runs: Column) -> Column:
    """The run with the greatest length divided by period, the first of equal ones; null without runs."""
    better = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    return F.aggregate(runs, F.get(runs, F.lit(0)), better)
