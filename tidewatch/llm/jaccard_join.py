"""N-gram Jaccard join with adaptive multi-match prefixes.

The distinct shingles of a document are put in one global order, frequent ones
last. Two sets that are similar enough share at least ``l`` of their first
``size - required overlap + l`` shingles, for every ``l``. Each document picks
the ``l`` that its estimated cost is lowest for: a longer prefix reads more
postings but asks for more shared ones, so fewer candidates are compared. Two
documents are compared if they share as many prefix shingles as the smaller of
their two ``l``.

Documents with equal sets are one class. As the result is the components of
the links, pairs inside a component need no comparison: rounds in which every
document is compared with the leader of a posting list come first, and a last
round compares whatever candidates still lie in different components. Groups
of near copies so take a number of comparisons near their size. Leaders are
the documents with the fewest rare shingles, such as the text that many others
are edits of.

Any order gives the same result, so the order uses an estimate of frequencies
(counts of the shingles that occur several times within one task's texts).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import materialise

from .components import components
from .textscan import Scan, in_batches, mix, shingles

_U = np.uint64
HEAVY = 400_000  # most shingles whose frequency is kept: 4.8 MB are sent to the executors
LEVELS = 24
COMPARE = 20.0  # cost of a comparison in postings read
RARE = 0.3  # partners expected of a shingle whose frequency isn't kept
SLOTS = 1 << 25  # bits of the filter of documents to compare: 4 MB at any size
PARITIES = 4  # numbers of 64 bits, at least; larger sets have more
TURNS = 8  # most rounds; the last one compares all that is left
_FLUSH = 4_000_000


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """The sorted distinct shingle hashes of each text of a batch."""
    texts = [(t or "").encode() for t in column.to_pylist()]
    for at, some in in_batches(texts):
        scan = Scan(some, lower=True)
        for i in range(len(some)):
            yield at + i, np.unique(shingles(scan.words_of(i), k))


def _key(s: np.ndarray) -> int:
    """Names a set; equal sets share it. 0 is the empty one."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) or 1 if len(s) else 0


def _classes(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """One pass: ``(id, text_key, n, key)`` per document, and ``(token, count)`` of what repeats within a task."""
    fed = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    schema = T.StructType([fed.schema["id"], *T.StructType.fromDDL("text_key bigint, n bigint, key bigint, token bigint, count bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        kind = None

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            often = counts >= 3
            n = int(often.sum())
            none = [pa.nulls(n, t) for t in (kind, *[pa.int64()] * 3)]
            return pa.RecordBatch.from_arrays([*none, pa.array(tokens[often].view(np.int64)), pa.array(counts[often])], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            sizes, keys = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, s in _sets(batch.column(2), k):
                sizes[i], keys[i] = len(s), _key(s)
                if keys[i] and keys[i] not in seen:
                    seen.add(keys[i])
                    held.append(s)
            none = pa.nulls(len(batch), pa.int64())
            columns = [batch.column(0), batch.column(1), pa.array(sizes), pa.array(keys), none, none]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            if sum(map(len, held)) > _FLUSH:
                yield flush()
        if held:
            yield flush()

    return fed.mapInArrow(run, schema)


def _prefixes(docs: DataFrame, text: str, k: int, percent: int, heavy) -> DataFrame:
    """The prefix of every class as ``(key, n, ell, rare, odd, tokens)``, at least once a class.

    ``rare`` counts the shingles that aren't known to be frequent: the least
    edited of many copies has the fewest. ``odd`` tells for parts of all
    shingles whether the set has an odd number of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = heavy.value
        seen: set[int] = set()
        for batch in batches:
            keys, sizes, ells, rares, odds, prefixes = [], [], [], [], [], []
            for _, s in _sets(batch.column(0), k):
                name = _key(s)
                if not name or name in seen:
                    continue
                seen.add(name)
                n = len(s)
                need = -(-percent * n // 100)
                base, most = n - need, min(LEVELS, need)
                ordered, weight = s, np.zeros(n)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    weight = np.where(known[at] == s, weights[at], 0)
                    if weight.any():
                        order = np.lexsort((s, weight))
                        ordered, weight = s[order], weight[order]
                levels = np.arange(1, most + 1)
                partners = np.cumsum(np.maximum(weight, RARE))[base + levels - 1]
                ell = int(np.argmin(base + levels + partners + COMPARE * partners / levels**2)) + 1
                keys.append(name)
                sizes.append(n)
                ells.append(ell)
                rares.append(n - int(np.count_nonzero(weight)))
                odds.append(_odd(s, percent))
                prefixes.append(ordered[: base + ell])
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            tokens = np.concatenate([np.zeros(0, np.uint64), *prefixes]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(x, pa.int64()) for x in (keys, sizes, ells, rares)),
                    pa.array(odds, pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(tokens)),
                ],
                names=["key", "n", "ell", "rare", "odd", "tokens"],
            )

    return docs.select(text).mapInArrow(run, "key bigint, n bigint, ell bigint, rare bigint, odd array<bigint>, tokens array<bigint>")


def _odd(s: np.ndarray, percent: int) -> list[int]:
    """The parities of a set's shingles per part, as numbers of 64 bits.

    There are at least three parts for every shingle that sets of this size may
    differ by and still link: unrelated sets differ in about half of the parts.
    """
    n = len(s)
    differ = 2 * (n + (-2 * percent * n) // (100 + percent))
    parts = max(64 * PARITIES, 1 << (3 * differ - 1).bit_length() if differ else 1)
    counts = np.bincount((mix(s) & _U(parts - 1)).astype(np.int64), minlength=parts)
    return np.packbits((counts & 1).astype(np.uint8)).view("<i8").tolist()


def _near(percent: int, x: str, y: str) -> Column:
    """The parities of both sets allow the similarity.

    Every part whose parity differs holds a shingle that only one set has, and
    sets that link differ by ``n + m - 2 * overlap`` shingles at most; so no
    link is lost. The larger set may have a power of two more parts: those that
    are one part of the smaller are put together, which adds up their parities.
    """
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    one, two = F.col(f"{x}.odd"), F.col(f"{y}.odd")
    size = F.least(F.size(one), F.size(two))

    def folded(odd: Column, i: Column) -> Column:
        others = F.sequence(i, F.size(odd) - 1, size)
        return F.when(F.size(odd) == size, odd[i]).otherwise(F.aggregate(others, F.lit(0).cast("bigint"), lambda a, j: a.bitwiseXOR(odd[j])))

    differ = F.aggregate(
        F.sequence(F.lit(0), size - 1), F.lit(0), lambda total, i: total + F.bit_count(folded(one, i).bitwiseXOR(folded(two, i)))
    )
    return differ <= n + m - 2 * _overlap(percent, n, m)


def _texts(docs: DataFrame, text: str, wanted) -> DataFrame:
    """``(text_key, packed)``: the compressed texts that may be in ``wanted``, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, pack = np.frombuffer(wanted.value, np.uint8), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            slot = batch.column("key").to_numpy() & (SLOTS - 1)
            batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7) & 1).astype(bool)))
            packed = [pack.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(packed, pa.binary())], names=["text_key", "packed"])

    fed = docs.select(F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    return fed.mapInArrow(run, "text_key bigint, packed binary").groupBy("text_key").agg(F.first("packed").alias("packed"))


def _slots(spark: SparkSession, keys: DataFrame):
    """A filter of fixed size: one bit per key, combined on the executors."""
    slot = F.col("key").bitwiseAND(F.lit(SLOTS - 1))
    words = keys.groupBy(F.shiftright(slot, 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(key & 31 AS INT)))").alias("bits"))
    found = words.toArrow()
    filled = np.zeros(SLOTS // 32, "<u4")
    filled[found.column("w").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return spark.sparkContext.broadcast(filled.tobytes())


def _verified(docs: DataFrame, text: str, k: int, percent: int, pairs: DataFrame, examples: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar enough, compared on the whole texts.

    ``examples`` has one text of every class: ``(key, text_key)``.
    """
    pairs = materialise(pairs.select("a", "b"))
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    named = materialise(examples.join(keys, "key"))
    wanted = _slots(docs.sparkSession, named.select(F.col("text_key").alias("key")))
    packed = materialise(named.join(_texts(docs, text, wanted), "text_key").select("key", "packed"))
    left = packed.select(F.col("key").alias("a"), F.col("packed").alias("left"))
    right = packed.select(F.col("key").alias("b"), F.col("packed").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last = zstandard.ZstdDecompressor(), {}

        def set_of(name: int, column: pa.Array, i: int) -> np.ndarray:
            if name not in last:
                if len(last) >= 16:
                    last.clear()
                last[name] = np.unique(shingles(Scan([unpack.decompress(column[i].as_py())], lower=True).hash, k))
            return last[name]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for i in range(len(a)):
                x, y = set_of(a[i], batch.column(2), i), set_of(b[i], batch.column(3), i)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return materialise(both.mapInArrow(run, "a bigint, b bigint"))


def _fits(percent: int, x: str, y: str) -> Column:
    """Sizes alone allow the similarity, and a shared shingle is in the shortest prefix that this pair needs.

    With the sizes of both known, the required overlap and with it the prefix
    is exact: the first ``size - overlap + 1`` places hold a common shingle.
    """
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    above = 1 - _overlap(percent, n, m)
    alike = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return alike & (F.col(f"{x}.at") < n + above) & (F.col(f"{y}.at") < m + above)


def _matched(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs that share as many shingles as their longer prefixes ask for.

    For the smaller ``ell`` of the two, the first ``size - overlap + ell``
    places of both must hold ``ell`` common shingles.
    """
    columns = ["n", "ell", "tokens"]
    x = prefixes.select(F.col("key").alias("a"), *[F.col(c).alias(f"x_{c}") for c in columns])
    y = prefixes.select(F.col("key").alias("b"), *[F.col(c).alias(f"y_{c}") for c in columns])
    both = pairs.join(x, "a").join(y, "b")
    ell = F.least("x_ell", "y_ell")
    below = ell - _overlap(percent, F.col("x_n"), F.col("y_n"))
    head = lambda s: F.slice(f"{s}_tokens", F.lit(1), (F.col(f"{s}_n") + below).cast("int"))
    return both.where(F.size(F.array_intersect(head("x"), head("y"))) >= ell).drop("x_n", "y_n", "x_ell", "y_ell", "x_tokens", "y_tokens")


def _overlap(percent: int, n: Column, m: Column) -> Column:
    """Common shingles that sets of these sizes need."""
    return F.ceil(percent * (n + m) / (100 + percent)).cast("int")


def linked_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document: key, ``n_shingles``, ``component_id``.

    A set holds the distinct ``k``-word shingles of the whole text, words split
    at ASCII blanks and A-Z lower-cased; fewer words make one shingle, no words
    (or a missing text) an empty set that links with nothing. Sets link when
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest
    key reachable by links. Shingles and sets are compared by 64-bit hashes.

    Repeated rows each get their row; a missing key is ignored in the minimum
    and gets the component of its text (its own missing key if alone). An empty
    table gives an empty result; other columns of ``docs`` are not returned.
    Nothing is capped: the bounds above change speed only.
    """
    return _linked(docs, key, text, k, percent).drop("text_key")


def _linked(docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    passed = materialise(_classes(docs, key, text, k))
    signed = passed.where("key IS NOT NULL").select("id", "text_key", "n", "key")
    examples = materialise(signed.where("key <> 0").groupBy("key").agg(F.min("text_key").alias("text_key")))
    rows = signed.count()
    often = passed.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count"))
    # Bounded: the most frequent ones, and each with a share of all documents.
    top = often.where(F.col("count") >= max(16, rows // 20_000)).orderBy(F.desc("count"), "token").limit(HEAVY).toArrow()
    tokens, counts = top.column("token").to_numpy().view(np.uint64), top.column("count").to_numpy().astype(np.int32)
    order = np.argsort(tokens)
    heavy = spark.sparkContext.broadcast((tokens[order], counts[order]))

    written = materialise(_prefixes(docs, text, k, percent, heavy))
    places = F.posexplode(F.slice("tokens", 1, F.expr(f"n - ({percent} * n + 99) DIV 100 + 1").cast("int"))).alias("at", "token")
    postings = written.select(F.col("n").cast("int"), F.col("rare").cast("int"), "key", places).select("token", "key", "n", "rare", "at")
    shared = postings.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("token")
    # A class may have been written by several tasks; each is the same.
    prefixes = written.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "ell", "tokens")])
    parities = written.groupBy("key").agg(F.first("odd").alias("odd"))
    # As the columns hold the token, repeated rows lie in one task.
    open_ = materialise(postings.join(shared, "token").select("token", "key", "n", "rare", "at").distinct())

    links: DataFrame | None = None
    found = rows
    for turn in range(TURNS):
        here = open_.withColumn("comp", F.col("key"))
        if links is not None:
            parts = components(links).select(F.col("node").alias("key"), F.col("component").alias("_c"))
            here = open_.join(parts, "key", "left").withColumn("comp", F.coalesce("_c", "key")).drop("_c")
            # Posting lists with several components; the others stay out for good.
            several = here.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
            here = materialise(here.join(several, "token"))
            open_ = here.drop("comp")
        last_turn = turn == TURNS - 1 or (turn > 1 and found <= rows // 100)
        if last_turn:
            # All pairs of what is left: here the parities go with the postings, too.
            here = materialise(here.join(parities, "key"))
            x, y = here.alias("x"), here.alias("y")
            alike = (F.col("x.comp") < F.col("y.comp")) & _near(percent, "x", "y")
            joined = x.join(y, (F.col("x.token") == F.col("y.token")) & alike)
        else:
            # By turns the least edited document of a list and any one.
            rank = F.struct(F.when(F.lit(turn % 2 == 0), F.col("rare")), F.xxhash64("key", F.lit(turn)))
            leader = F.min_by(F.struct("key", "n", "at", "comp"), rank)
            leaders = here.groupBy("token").agg(leader.alias("l")).select("token", "l.*")
            x, y = here.alias("x"), leaders.alias("y")
            joined = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")))
        pairs = (
            joined.where(_fits(percent, "x", "y"))
            .groupBy(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m"))
            .agg(F.count(F.lit(1)).alias("c"), F.max("x.at").alias("i"), F.max("y.at").alias("j"))
            # What is left after the last shared place suffices.
            .where(F.col("c") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - 1 >= _overlap(percent, F.col("n"), F.col("m")))
            .select("a", "b", "c")
        )
        if last_turn:
            pairs = _matched(pairs, prefixes, percent)
        if not last_turn:  # one leader each: the one that shares most
            pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
        new = _verified(docs, text, k, percent, pairs, examples)
        found = new.count()
        links = new if links is None else links.unionByName(new)
        if last_turn:
            break
    lowest = signed.where("key <> 0").groupBy("key").agg(F.min("id").alias("low"))
    if links is not None:
        parts = components(links).select(F.col("node").alias("key"), F.col("component").alias("comp"))
        named = lowest.join(parts, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        smallest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
        lowest = named.join(smallest, "comp").select("key", F.col("component_id").alias("low"))
    return signed.join(lowest, "key", "left").select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("key") == 0, F.col("id")).otherwise(F.col("low")).alias("component_id"),
        "text_key",
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest key; all columns stay.

    Texts without words have no copies. Of rows that repeat a key and its text
    one stays.
    """
    found = _linked(docs, key, text, k, percent)
    first = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_first"), F.col("text_key").alias("_text")).distinct()
    # The row travels as one column, so that no name of it can clash.
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"), F.xxhash64(text).alias("_text_key"))
    stay = keyed.join(first, F.col("_key").eqNullSafe(F.col("_first")) & (F.col("_text_key") == F.col("_text")), "left_semi")
    return stay.dropDuplicates(["_key", "_text_key"]).select("_row.*")
