"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents. A document's virtual finish
time is the number of words up to and with it in its queue, divided by the
source's target; all queues reach their targets at time 1. Sorted by finish
time over all sources and cut at the total budget, every prefix of the order
is mixed in the target proportions.

Nothing is sorted in one task: queues are cut into buckets of the shuffled
order, whose totals are added up first, and the cut is found from totals of
ranges of the finish time; only the range that holds the cut is looked at row
by row. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordering import running_total, with_position
from tidewatch.session import materialise

from .words import words

ROWS_A_BUCKET = 2_000
# Digits of the shuffle hash that choose a bucket: 60 bits.
_HEX = 15


def targets(sources: DataFrame, weights: tuple[int, ...], budget: float, repeats: int) -> DataFrame:
    """Add ``weight`` and ``target`` to one row per source (``_queue``, ``source_size``).

    Weights are dealt in the order of ``_queue``, over and over. The budget is
    shared by weight; a target stops at ``repeats`` times the source's size and
    the excess goes to the others by weight. With sources in the order of cap
    over weight, the capped ones come first, so one running sum finds the level
    per weight of the rest.
    """
    placed = with_position(sources, ["_queue"], "_position", 0)
    dealt = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_position") % len(weights) + 1).cast("int"))
    capped = placed.withColumn("weight", dealt).withColumn("_cap", F.col("source_size") * repeats)
    order = [F.col("_cap") / F.col("weight"), F.col("_position")]
    summed = running_total(running_total(capped, [], order, "_cap", "_caps"), [], order, "weight", "_weights")
    summed = materialise(summed)
    total = summed.agg(F.sum("weight")).first()[0] or 0
    level = (F.lit(float(budget)) - (F.col("_caps") - F.col("_cap"))) / (F.lit(total) - (F.col("_weights") - F.col("weight")))
    free = summed.withColumn("_level", level).where(F.col("_level") * F.col("weight") <= F.col("_cap"))
    found = free.agg(F.min_by("_level", F.struct(*order))).first()[0]
    share = F.col("_cap").cast("double")
    if found is not None:  # else the budget is beyond all caps
        share = F.least(share, F.lit(found) * F.col("weight"))
    return summed.select(*sources.columns, "weight", share.alias("target"))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    seed: str = "mix",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How much of every document the mix takes: key, source, ``size``, ``source_size``, ``target``, ``taken``.

    ``size`` is an expression (default: the words of ``text``; a missing text
    has none). The budget is ``share`` of all sizes. Sources are ordered by
    code point, a missing one last and a source of its own. A document is taken
    up to ``repeats`` times, whole each time; the last round of the budget is
    not filled by a part of a document, so a source ends within one document of
    its target. The shuffle hashes ``seed`` and key, so reruns agree; rows with
    one key and source are ordered by size, identical rows are interchangeable.
    Documents of size 0 take nothing; without any words all targets are 0. Two
    one-row results are brought to the driver (the totals and the cut); an
    empty table stays empty. Of the other columns of ``docs`` those in
    ``carry`` are returned.
    """
    if size is None:
        size = F.size(words(F.col("text")))
    sized = docs.select(
        F.col(key).alias("_key"),
        F.col(source).alias("_source"),
        # Never null; a missing source comes after every other one.
        F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source))).alias("_queue"),
        F.coalesce(size, F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")).alias("_hash"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
    )
    sized = materialise(sized)
    sources = sized.groupBy("_queue").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = materialise(sources)
    whole = sources.agg(F.sum("source_size"), F.sum("_rows")).first()
    total, rows = whole[0] or 0, whole[1] or 0
    budget = share * total
    dealt = materialise(targets(sources, weights, budget, repeats))

    # Buckets of the shuffled order: in order of the hash, of bounded size, many for a large source.
    drawn = F.conv(F.substring("_hash", 1, _HEX), 16, 10).cast("double") / F.lit(float(16**_HEX))
    buckets = F.ceil(F.col("_rows") / F.lit(ROWS_A_BUCKET))
    placed = sized.join(dealt, "_queue").withColumn("_bucket", F.floor(drawn * buckets))
    inside = Window.partitionBy("_queue", "_bucket").orderBy("_hash", "_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("_queue").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_queue", "_bucket")
        .agg(F.sum("size").alias("_sum"))
        .select("_queue", "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    )
    queued = placed.join(starts, ["_queue", "_bucket"]).withColumn("_end", F.col("_start") + F.sum("size").over(inside))
    queued = materialise(queued.drop("_bucket", "_start", "_rows"))

    # One place in the order of finish time per document and round.
    def place(r: int) -> Column:
        finish = F.try_divide((F.col("_end") + r * F.col("source_size")).cast("double"), F.col("target"))
        return F.struct(finish.alias("finish"), "_queue", "_hash", "_key", "size", F.lit(r).alias("round"))

    ranges = math.isqrt(rows) + 1
    live = (F.col("size") > 0) & (F.col("target") > 0)
    places = queued.where(live).select(F.explode(F.array(*[place(r) for r in range(repeats)])).alias("o"))
    places = places.withColumn("_range", F.floor(F.col("o.finish") * ranges))
    sums = places.groupBy("_range").agg(F.sum("o.size").alias("_sum"))
    # One row per range, about the square root of the documents.
    upto = sums.withColumn("_upto", F.sum("_sum").over(Window.orderBy("_range")))
    first = F.min_by(F.struct("_range", (F.col("_upto") - F.col("_sum")).alias("before")), "_range")
    at = upto.where(F.col("_upto") > budget).agg(first.alias("at")).first()["at"]
    if at is None:
        taken = [F.lit(True)] * repeats
    else:
        here = places.where(F.col("_range") == at["_range"])
        ahead = Window.orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
        fits = here.withColumn("_sum", F.sum("o.size").over(ahead)).where(F.col("_sum") + at["before"] <= budget)
        last = fits.agg(F.max("o").alias("o")).select("o.*")
        cut, kinds = last.first(), last.dtypes
        taken = []
        for r in range(repeats):
            there = F.floor(place(r)["finish"] * ranges)
            inside = F.lit(False)
            if cut["finish"] is not None:
                inside = (there == at["_range"]) & (place(r) <= F.struct(*[F.lit(cut[c]).cast(t).alias(c) for c, t in kinds]))
            taken.append((there < at["_range"]) | inside)
    times = sum((F.when(live & t, 1).otherwise(0) for t in taken), F.lit(0))
    return queued.select(
        F.col("_key").alias(key),
        F.col("_source").alias(source),
        "size",
        "source_size",
        "target",
        (F.col("size") * times).alias("taken"),
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with all their columns, a document as often as it is taken.

    Documents of size 0 carry no words and are left out. Rows are told apart by
    a number given in a written copy, so repeated keys stay separate.
    """
    # The row travels as one column, so that no name of it can clash.
    numbered = materialise(docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_number")))
    known = [F.col(f"_row.`{c}`") for c in docs.columns if c != "_number"]
    taken = mix(numbered.select(*known, "_number"), carry=("_number",), **options).where("taken > 0")
    times = taken.select("_number", F.try_divide("taken", "size").cast("int").alias("_times"))
    rows = numbered.join(times, "_number").withColumn("_time", F.explode(F.sequence(F.lit(1), "_times")))
    return rows.select("_row.*")
