"""Phrase collocations from exact counts of all frequent n-grams.

Counting runs over *blocks*: written rows of a few megabytes of plain text in
one language. The 64-bit hashes of a block's n-grams are cut into hash
partitions by their highest bits, and each partition is sent the distinct
hashes with their counts. A first pass merges what a partition gets into one
Misra-Gries summary, whose capacity exceeds the partition's mass divided by the
threshold; so no n-gram that is frequent can have been dropped. A second pass
over the partition adds up the survivors exactly. Of the blocks that hold a
frequent n-gram one is asked for its words.

The number of partitions grows with the number of words. A block, a partition's
hashes and a summary have bounded sizes, whatever the corpus and however common
a phrase: a block sends each of its n-grams once, and each frequent one is
named once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import materialise

from .batches import short_batches
from .textscan import Scan, mix

LONGEST = 5
THRESHOLD = 100
BLOCK_BYTES = 2 << 20
PARTITION_MASS = 2 << 20
KEPT_BITS = 48  # of a hash, after those that name its partition
RANK_PARTS = 64
PARTS_A_TASK = 4
UNKNOWN = "und"

_U = np.uint64
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_ENDS = b".,;:!?\x0b\x0c\r"  # of a piece, besides the line feed
_PLAIN = bytes.maketrans(_UPPER + _ENDS + b"\t", _LOWER + b"\n" * len(_ENDS) + b" ")
_FACTOR = mix(np.arange(1, LONGEST + 2, dtype=_U)) | _U(1)


def plain(text: str) -> bytes:
    """Lower-cased pieces, one a line, words separated by one space; pieces without words are left out."""
    lines = text.encode().translate(_PLAIN).split(b"\n")
    return b"".join(b" ".join(words) + b"\n" for line in lines if (words := line.split()))


def blocks(docs: DataFrame, text: str, lang: str, size: int = BLOCK_BYTES) -> DataFrame:
    """Rows ``block, lang, words, plain``: plain texts of one language, put together up to ``size`` bytes and compressed; written."""
    schema = "lang string, words long, plain binary"

    def row(language: str, parts: list[bytes]) -> pa.RecordBatch:
        joined = b"".join(parts)
        words = joined.count(b" ") + joined.count(b"\n")
        return pa.RecordBatch.from_arrays(
            [pa.array([language]), pa.array([words], pa.int64()), pa.array([zstandard.compress(joined, 1)], pa.binary())], names=["lang", "words", "plain"]
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for language, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                added = plain(found.as_py() or "")
                if not added:
                    continue
                waiting.setdefault(language, []).append(added)
                sizes[language] = sizes.get(language, 0) + len(added)
                if sizes[language] >= size:
                    yield row(language, waiting.pop(language))
                    del sizes[language]
                elif sum(sizes.values()) >= 4 * size:  # many languages, each with little
                    yield from (row(*item) for item in waiting.items())
                    waiting.clear()
                    sizes.clear()
        yield from (row(*item) for item in waiting.items())

    fed = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)), F.col(text))
    packed = fed.mapInArrow(pack, schema)
    return materialise(packed.select(F.monotonically_increasing_id().alias("block"), "*"))


def grams(body: bytes, lang: str, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, Scan]]:
    """For each length the hashes of all n-grams of a block and the words they start at."""
    scan = Scan([body])
    ends = np.flatnonzero(scan.bytes == 0x0A)
    piece = np.searchsorted(ends, scan.start)
    words = mix(scan.hash ^ _seed(lang))
    total = np.zeros(len(words), _U)
    for n in range(1, longest + 1):
        if len(words) < n:
            return
        total = total[: len(words) - n + 1] * _FACTOR[n] + words[n - 1 :]
        at = np.flatnonzero(piece[: len(words) - n + 1] == piece[n - 1 :])
        yield n, mix(total[at] + _FACTOR[n]), at, scan


def _seed(lang: str) -> np.uint64:
    total = _U(0)
    with np.errstate(over="ignore"):
        for byte in lang.encode():
            total = mix(np.array([total + _U(byte + 1)]))[0]
    return total


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often each comes."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _block_keys(body: bytes, lang: str, longest: int) -> tuple[np.ndarray, np.ndarray]:
    found = [keys for _, keys, _, _ in grams(body, lang, longest)]
    return counted(np.concatenate(found) if found else np.zeros(0, _U))


def _cut(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Partition, begin and end of each stretch of sorted hashes with equal highest bits."""
    part = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(keys) else []
    for at, to in zip(begin, [*begin[1:], len(keys)]):
        yield int(part[at]), int(at), int(to)


def _packed(numbers: np.ndarray, kind: str) -> bytes:
    """Numbers of a kind, all first bytes before all second ones, compressed: small numbers take few bits."""
    wide = np.dtype(kind).itemsize
    return zstandard.compress(numbers.astype(kind).view(np.uint8).reshape(-1, wide).T.tobytes(), 1)


def _numbers(packed: bytes, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(wide, -1).T.copy().view(kind).ravel()


def _short(keys: np.ndarray, bits: int) -> np.ndarray:
    """The ``KEPT_BITS`` of sorted hashes that follow their partition's; in order, too."""
    return (keys << _U(bits)) >> _U(64 - min(KEPT_BITS, 64 - bits))


def misra_gries(counts: Iterable[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One summary of several tables of distinct keys with their counts: keys, counters and error.

    At most ``capacity`` counters. A key's true count lies between its counter
    (0 if it has none) and that plus the error, and the error is at most the
    mass divided by ``capacity + 1``. Summaries of parts merge the same way.
    """
    keys, counters, error = np.zeros(0, _U), np.zeros(0, np.int64), 0
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merge() -> None:
        nonlocal keys, counters, error, size
        every = np.concatenate([keys, *(k for k, _ in waiting)])
        sums = np.concatenate([counters, *(c for _, c in waiting)])
        waiting.clear()
        size = 0
        if not len(every):
            return
        order = np.argsort(every)
        every, sums = every[order], sums[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        keys, counters = every[first], np.add.reduceat(sums, first)
        if len(keys) > capacity:
            cut = int(np.partition(counters, len(keys) - capacity - 1)[len(keys) - capacity - 1])
            error += cut
            kept = counters > cut
            keys, counters = keys[kept], counters[kept] - cut

    for some, numbers in counts:
        waiting.append((some, numbers.astype(np.int64)))
        size += len(some)
        if size >= max(4 * capacity, 1 << 16):
            merge()
    merge()
    return keys, counters, error


def _send(blocked: DataFrame, bits: int, longest: int) -> DataFrame:
    """Rows ``part, block, keys, counts``: what each hash partition gets of each block."""
    names = ["part", "block", "keys", "counts"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, body in zip(*(batch.column(i) for i in range(3))):
                keys, counts = _block_keys(zstandard.decompress(body.as_py()), lang.as_py(), longest)
                rows = [
                    (part, block.as_py(), _packed(np.diff(_short(keys[at:to], bits), prepend=_U(0)), "<u8"), _packed(counts[at:to], "<u4"))
                    for part, at, to in _cut(keys, bits)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return blocked.select("block", "lang", "plain").mapInArrow(send, "part long, block long, keys binary, counts binary")


def _found(sent: DataFrame, bits: int, threshold: int) -> DataFrame:
    """Rows ``block, part, places, found``: frequent n-grams that a block is to name, by their place among the hashes sent, and their counts."""

    def find(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows = list(zip(table.column("block").to_pylist(), table.column("keys"), table.column("counts")))

        def sent_by_block() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for block, keys, counts in rows:
                yield block, np.cumsum(_numbers(keys.as_py(), "<u8"), dtype=_U), _numbers(counts.as_py(), "<u4")

        mass = sum(int(counts.sum()) for _, _, counts in sent_by_block())
        keys, counters, error = misra_gries(((k, c) for _, k, c in sent_by_block()), mass // threshold + 1)
        keys = keys[counters + error >= threshold]
        total = np.zeros(len(keys), np.int64)
        least = np.full(len(keys), np.iinfo(np.uint64).max)
        hits = []
        for block, found, counts in sent_by_block():
            where = np.flatnonzero(np.isin(found, keys))
            at = np.searchsorted(keys, found[where])
            np.add.at(total, at, counts[where])  # two hashes of a block may share what is kept of them
            # Any holder may name it; which one is left to a hash, so that all get a share.
            drawn = mix(found[where] ^ mix(np.array([block], np.int64).view(_U)))
            np.minimum.at(least, at, drawn)
            hits.append((block, where, at, drawn))
        out = []
        for block, where, at, drawn in hits:
            own = (drawn == least[at]) & (total[at] >= threshold)
            if own.any():
                out.append((block, part, where[own].astype("<u4").tobytes(), total[at[own]].astype("<i8").tobytes()))
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        columns = zip(*out) if out else ((),) * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["block", "part", "places", "found"])

    # As many tasks as the partitions ask for, whatever their bytes.
    dealt = sent.repartition((1 << bits) // PARTS_A_TASK + 1, "part")
    return dealt.groupBy("part").applyInArrow(find, "block long, part long, places binary, found binary")


def _named(blocked: DataFrame, found: DataFrame, bits: int, longest: int) -> DataFrame:
    """Rows ``lang, phrase, n, found``: the words of the n-grams that the blocks are to name."""
    names = ["lang", "phrase", "n", "found"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int64()]

    def name(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            lang, body = left.column("lang")[0].as_py(), zstandard.decompress(left.column("plain")[0].as_py())
            wanted, counts = _wanted(_block_keys(body, lang, longest)[0], right, bits)
            near = np.zeros(1 << 20, bool)  # most n-grams are told apart by their first 20 bits
            near[(wanted >> _U(44)).astype(np.int64)] = True
            for n, keys, at, scan in grams(body, lang, longest):
                maybe = np.flatnonzero(near[(keys >> _U(44)).astype(np.int64)])
                some, first = np.unique(keys[maybe], return_index=True)
                place = np.searchsorted(wanted, some)
                place[place == len(wanted)] = 0
                hit = wanted[place] == some
                start, place = at[maybe[first[hit]]], place[hit]
                begin, end = scan.start[start].tolist(), scan.stop[start + n - 1].tolist()
                rows[0] += [lang] * len(place)
                rows[1] += [body[a:b].decode() for a, b in zip(begin, end)]
                rows[2] += [n] * len(place)
                rows[3] += counts[place].tolist()
        return pa.table([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    pairs = blocked.select("block", "lang", "plain").groupBy("block").cogroup(found.groupBy("block"))
    return pairs.applyInArrow(name, "lang string, phrase string, n int, found long")


def _wanted(keys: np.ndarray, found: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a block that it is to name, in order, and their counts."""
    of = {part: (p, c) for part, p, c in zip(*(found.column(c).to_pylist() for c in ("part", "places", "found")))}
    chosen, counts = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for part, at, _ in _cut(keys, bits):
        if part in of:
            chosen.append(keys[at + np.frombuffer(of[part][0], "<u4").astype(np.int64)])
            counts.append(np.frombuffer(of[part][1], "<i8"))
    return np.concatenate(chosen), np.concatenate(counts)


def frequent_phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    threshold: int = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
    partition_mass: int = PARTITION_MASS,
) -> tuple[DataFrame, DataFrame]:
    """All n-grams of up to ``longest`` words that a language has ``threshold`` times, and the words of each language.

    The first table has ``lang, phrase, n, found``: words joined by a space, how
    many they are, and all contiguous occurrences inside pieces, overlaps
    included. The second has ``lang, words`` for every language with a word.
    Letters A-Z are lower-cased; pieces end at ``. , ; : ! ?`` and line breaks;
    words are runs of anything but space and tab. A missing language is
    ``UNKNOWN``; a missing, empty or blank text adds nothing. A very long text
    is a block of its own. N-grams are told apart by the first bits of 64-bit
    hashes: ``KEPT_BITS`` and those that number the partitions. One number is brought to the driver (all words).
    """
    if not 1 <= longest <= LONGEST:
        raise ValueError(f"phrases have 1 to {LONGEST} words")
    if threshold < 1:
        raise ValueError("the threshold is positive")
    blocked = blocks(docs, text, lang, block_bytes)
    words = blocked.groupBy("lang").agg(F.sum("words").alias("words"))
    mass = longest * (blocked.agg(F.sum("words")).first()[0] or 0)
    bits = min(32, max(0, (mass // partition_mass)).bit_length())
    with short_batches(docs.sparkSession, 4):
        found = materialise(_found(_send(blocked, bits, longest), bits, threshold))
        kept = materialise(_named(blocked, found, bits, longest))
    return kept, words


def _joined(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, top: int = 2_000, threshold: int = THRESHOLD, **options) -> DataFrame:
    """The ``top`` best scored phrases of two and more words of each language.

    Columns ``lang, rank, phrase, a, l, r, n, score``. A phrase that comes ``a``
    times is cut after each of its words; with ``l`` and ``r`` occurrences of
    the parts and ``n`` words in the language a cut scores
    ``floor(1000 * a * n / (l * r))``, and the lowest counts (of equal ones the
    first). A phrase is left out where a longer frequent one that contains it
    comes just as often; as counts only fall with length, one more word on
    either side tells that. Phrases are ranked by score, ``a``, then by their
    bytes. ``options`` are those of ``frequent_phrases``, which also says how
    texts are read; a language without such phrases has no rows.
    """
    kept, words = frequent_phrases(docs, threshold=threshold, **options)
    split = F.split("phrase", " ")
    longer = kept.where("n > 2").select("lang", "found", F.explode(F.array(_joined(split, 1, F.col("n") - 1), _joined(split, 2, F.col("n") - 1))).alias("phrase"))
    covered = longer.groupBy("lang", "phrase").agg(F.max("found").alias("_covered"))
    phrases = kept.where("n > 1").join(covered, ["lang", "phrase"], "left").where("_covered IS NULL OR _covered < found")
    cut = phrases.select("lang", "phrase", "n", F.col("found").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("_k"))
    cut = cut.withColumn("_left", _joined(split, 1, F.col("_k"))).withColumn("_right", _joined(split, F.col("_k") + 1, F.col("n") - F.col("_k")))
    left = kept.select("lang", F.col("phrase").alias("_left"), F.col("found").alias("l"))
    right = kept.select("lang", F.col("phrase").alias("_right"), F.col("found").alias("r"))
    both = cut.drop("n").join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).join(words, "lang")
    whole = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"(1000BD * {whole('a')} * {whole('words')}) div ({whole('l')} * {whole('r')})")
    scored = both.withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", F.col("words").alias("n"), "score"), F.struct("score", "_k")).alias("_s"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part of a language come first, so that one task ranks a bounded number.
    parts = Window.partitionBy("lang", "_part").orderBy(*best)
    ranked = lowest.select("lang", "phrase", "_s.*", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("_part"))
    ranked = ranked.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
