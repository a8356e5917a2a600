"""Sharding by proportional stratified interleaving.

Every source is a stratum. Its rows are shuffled by a seeded hash and ranked;
row ``r`` of ``n`` stands at the fraction ``(2 r - 1) / (2 n)`` of its source.
Sorted by fraction over all sources, any stretch of the order holds the sources
in the proportions of the whole, to within a few rows. Cut into equal numbers
of rows, the order gives shards that all match the mixture.

Ranks and places come from range-sorted chunks whose sizes are added up, so
neither a large source nor the whole table is ever one group. Only keys, hashes
and sizes are sorted; texts are read once. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordering import running_total, with_position
from tidewatch.session import materialise

SHARDS = 24
OVERHEAD = 8  # bytes of a row besides its text


def interleave(
    docs: DataFrame,
    shards: int = SHARDS,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: str = "shard",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Key, source, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row; numbers of rows differ by one at most.

    Shards are numbered from 0, and slots from 0 without gaps in the order of
    the interleaving. A shard holds of every source its share of the rows to
    within ``1 + (S + 1) * p``, where ``S`` is the number of sources and ``p``
    the source's part of all rows. ``size`` is the text in UTF-8 plus ``OVERHEAD``; a missing text
    is empty, its checksum 0. A missing source is a stratum of its own. The
    shuffle hashes ``seed`` and key, so reruns agree; rows of one key are
    ordered by size and checksum, and what is equal in all of these is
    interchangeable (repeated rows and rows without a key stay separate rows).
    Equal texts are not kept together: a group of copies may be larger than a
    shard, and the shuffle spreads it. With fewer rows than shards some shards
    stay empty; an empty table gives no rows. Of the other columns of ``docs``
    those in ``carry`` are returned.
    """
    if shards < 1:
        raise ValueError("there is at least one shard")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    ranked = ["_hash", "_key", "_size", "_crc"]
    sized = docs.select(
        F.col(key).alias("_key"),
        F.col(source).alias("_source"),
        # Never null; a missing source comes after every other one.
        F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source))).alias("_queue"),
        (F.octet_length(body) + OVERHEAD).cast("bigint").alias("_size"),
        F.crc32(body).alias("_crc"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")).alias("_hash"),
        F.lit(1).cast("bigint").alias("_one"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
    )
    sized = materialise(sized)
    sources = materialise(sized.groupBy("_queue").agg(F.sum("_one").alias("_rows")))
    total = sources.agg(F.sum("_rows")).first()[0] or 0
    ranks = running_total(sized, ["_queue"], ranked, "_one", "_rank").join(sources, "_queue")
    fraction = (2 * F.col("_rank") - 1).cast("double") / (2 * F.col("_rows")).cast("double")
    placed = with_position(ranks.withColumn("_fraction", fraction), ["_fraction", "_queue", *ranked], "_place", 0)
    shard = F.expr(f"_place * {shards} div {max(total, 1)}")
    cut = placed.withColumn("_shard", shard)
    # The first place of a shard: the smallest one that the division sends there.
    first = F.expr(f"(_shard * {max(total, 1)} + {shards - 1}) div {shards}")
    return cut.select(
        F.col("_key").alias(key),
        F.col("_source").alias(source),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_place") - first).alias("slot"),
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
    )


def sharded_rows(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """The rows of ``docs`` with all their columns in ``_row``, their ``shard`` and ``slot``."""
    # The row travels as one column, so that no name of it can clash.
    numbered = materialise(docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_number")))
    known = [F.col(f"_row.`{c}`") for c in docs.columns if c != "_number"]
    placed = interleave(numbered.select(*known, "_number"), shards, carry=("_number",), **options)
    return numbered.join(placed.select("_number", "shard", "slot"), "_number").select("_row", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **options) -> None:
    """Write every shard to its folder ``shard=...`` below ``path``, in the order of its slots.

    A shard is written by as many tasks as its size asks for; its files in the
    order of their names, and the rows in them, follow the slots.
    """
    rows = sharded_rows(docs, shards, **options)
    dealt = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(path)
