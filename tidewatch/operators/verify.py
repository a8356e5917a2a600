"""Reconciliation of an expected and an actual table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.schema import safe_cast

DIGEST_BUCKETS = 4096
LEAVES = 4096  # of a bucket that differs


def row_hash(columns: list[str], salt: int = 0) -> Column:
    """A 64-bit hash of a row in which a NULL keeps its place."""
    parts = [F.lit(salt), *[F.col(f"`{c}`") for c in columns], *[F.col(f"`{c}`").isNull() for c in columns]]
    return F.xxhash64(*parts)


def _bucket(keys: list[str]) -> Column:
    return F.pmod(row_hash(keys, salt=7), F.lit(DIGEST_BUCKETS)).cast("int")


def _leaf(keys: list[str]) -> Column:
    """The place of a key inside its bucket, by a hash of its own."""
    return F.pmod(row_hash(keys, salt=11), F.lit(LEAVES)).cast("int")


def suspects(both: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both sides whose keys share a leaf with a difference, found level by level.

    Buckets are compared first, then the leaves of differing buckets only, each
    by one aggregate that combines before its shuffle. What is left are the rows
    of differing leaves: one in ``DIGEST_BUCKETS * LEAVES`` of all keys for each
    key that differs. ``both`` has ``_side`` (1 or -1) besides ``columns``.
    """
    placed = both.withColumns({"_bucket": _bucket([key]), "_leaf": _leaf([key])})
    buckets = placed.groupBy("_bucket").agg(*_surplus(columns)).where(DIFFERS).select("_bucket")
    # At most DIGEST_BUCKETS rows.
    near = placed.join(F.broadcast(buckets), "_bucket", "left_semi")
    leaves = near.groupBy("_bucket", "_leaf").agg(*_surplus(columns)).where(DIFFERS).select("_bucket", "_leaf")
    return near.join(leaves, ["_bucket", "_leaf"], "left_semi").select(both.columns)


def digests(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Count and two order-free hash totals per key bucket: at most ``DIGEST_BUCKETS`` rows."""
    return df.groupBy(_bucket(keys).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(row_hash(columns, 1).cast("decimal(20,0)")).alias("total"),
        F.bit_xor(row_hash(columns, 2)).alias("mixed"),
    )


def differing_buckets(expected: DataFrame, actual: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Buckets whose digests differ, with the row counts of both sides."""
    a, b = digests(expected, keys, columns).alias("e"), digests(actual, keys, columns).alias("a")
    same = (
        F.col("e.rows").eqNullSafe(F.col("a.rows"))
        & F.col("e.total").eqNullSafe(F.col("a.total"))
        & F.col("e.mixed").eqNullSafe(F.col("a.mixed"))
    )
    return a.join(b, F.col("e.bucket") == F.col("a.bucket"), "full").select(
        F.coalesce("e.bucket", "a.bucket").alias("bucket"),
        F.coalesce("e.rows", F.lit(0)).alias("expected_rows"),
        F.coalesce("a.rows", F.lit(0)).alias("actual_rows"),
        (~same).alias("differs"),
    )


def multiset_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows with the surplus of each side: ``surplus`` > 0 is missing from ``actual``.

    One shuffle for both tables together; equal rows are counted before it, so
    copies of one row never travel one by one.
    """
    columns = expected.columns
    both = expected.withColumn("_side", F.lit(1)).unionByName(actual.select(*columns).withColumn("_side", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_side").alias("surplus")).where("surplus <> 0")


def key_differences(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """One row per differing key: ``status`` is missing, extra or changed, with row counts."""
    surplus = multiset_difference(expected, actual)
    missing = F.sum(F.greatest("surplus", F.lit(0)))
    extra = F.sum(F.greatest(-F.col("surplus"), F.lit(0)))
    return (
        surplus.groupBy(*keys)
        .agg(missing.alias("missing_rows"), extra.alias("extra_rows"))
        .withColumn(
            "status",
            F.when(F.col("extra_rows") == 0, "missing").when(F.col("missing_rows") == 0, "extra").otherwise("changed"),
        )
    )


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows found on one side only, both directions; empty means equal as sets."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def validate(
    expected: DataFrame, actual: DataFrame, key: str, check_columns: bool = True, tolerance: float | None = None
) -> DataFrame:
    """One row ``ok, detail``: row count, coercibility, columns, then values.

    The first failing check names the detail. It is one lazy plan: nothing runs
    before the row is asked for. Digests of both tables are taken in one
    aggregate of at most ``DIGEST_BUCKETS`` rows; only keys of differing
    leaves of differing buckets are compared further (``suspects``), and one
    more pass counts the rows before the first difference and picks it on both
    sides. Rows without a key are compared like those of any other key and come
    first. With ``tolerance`` doubles may differ by that much: the rows of each
    key are compared in their order.
    """
    spark = expected.sparkSession
    common = [c for c in expected.columns if c in actual.columns]
    typed, lost = _coerced(actual, expected, common)
    if key not in common:
        return _verdict(spark, False, f"Column mismatch: key {key} is absent")
    wanted = expected.select(*common, F.lit(1).alias("_side"), F.lit(0).alias("_lost"))
    found = typed.select(*common, F.lit(-1).alias("_side"), "_lost" if lost else F.lit(0).alias("_lost"))
    both = wanted.unionByName(found)
    k = F.col(f"`{key}`")

    buckets = both.groupBy(_bucket([key]).alias("bucket")).agg(*_surplus(common), F.sum("_lost").alias("lost"), *_counts())
    if tolerance is None:
        keys = suspects(both, key, common).groupBy(k.alias("_key")).agg(*_surplus(common)).where(DIFFERS)
    else:
        keys = _beyond(both, key, common, tolerance)

    def rank(column: Column) -> Column:
        """Orders keys, missing ones first; never null itself."""
        return F.struct(column.isNotNull(), column)

    first = keys.agg(F.min(rank(F.col("_key")))).scalar()
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(common)]), {"ignoreNullFields": "false"})
    here = F.col("_at")

    def pick(side: int) -> Column:
        return F.min_by(F.when(here & (F.col("_side") == side), F.col("_row")), F.when(here & (F.col("_side") == side), F.struct(rank(k), "_row")))

    place = both.withColumns({"_at": rank(k) >= first, "_row": row}).agg(
        F.struct(
            F.max(first.isNotNull()).alias("found"),
            F.count_if((F.col("_side") == 1) & (rank(k) < first)).alias("position"),
            pick(1).alias("expected"),
            pick(-1).alias("actual"),
        )
    )
    e, a = F.coalesce(F.sum("e"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))
    totals = buckets.agg(e.alias("e"), a.alias("a"), F.sum("lost").alias("lost")).withColumn("at", place.scalar())
    columns = f"Column mismatch: expected {sorted(expected.columns)}, got {sorted(actual.columns)}"
    mismatch = check_columns and sorted(expected.columns) != sorted(actual.columns)
    detail = (
        F.when(F.col("e") != F.col("a"), F.format_string("Row count mismatch: expected %d, got %d", "e", "a"))
        .when(F.col("lost") > 0, F.format_string("Failed to coerce results: %d rows", "lost"))
        .when(F.lit(mismatch), F.lit(columns))
        .when(
            F.col("at.found"),
            F.concat(
                F.format_string("Row %d mismatch: expected ", "at.position"),
                F.coalesce("at.expected", F.lit("None")),
                F.lit(", got "),
                F.coalesce("at.actual", F.lit("None")),
            ),
        )
    )
    return totals.select(detail.isNull().alias("ok"), detail.alias("detail"))


DIFFERS = "surplus <> 0 OR total <> 0 OR mixed <> 0"


def _surplus(columns: list[str]) -> list[Column]:
    """Sums that are 0 when both sides hold the same rows."""
    return [
        F.sum("_side").alias("surplus"),
        F.sum(row_hash(columns, 1).cast("decimal(20,0)") * F.col("_side")).alias("total"),
        F.bit_xor(row_hash(columns, 2)).alias("mixed"),
    ]


def _counts() -> list[Column]:
    return [F.count_if(F.col("_side") == 1).alias("e"), F.count_if(F.col("_side") == -1).alias("a")]


def _beyond(both: DataFrame, key: str, columns: list[str], tolerance: float) -> DataFrame:
    """Keys with a row whose counterpart differs by more than ``tolerance`` in a double, or at all elsewhere."""
    doubles = {f.name for f in both.schema.fields if f.dataType.typeName() in ("double", "float")}
    exact = [c for c in columns if c not in doubles and c != key]
    order = Window.partitionBy(f"`{key}`", "_side").orderBy(*[F.col(f"`{c}`") for c in exact], *[F.col(f"`{c}`") for c in columns if c in doubles])
    ranked = both.withColumn("_n", F.row_number().over(order))
    e, a = ranked.where("_side = 1").alias("e"), ranked.where("_side = -1").alias("a")
    same = F.col("e._n").isNotNull() & F.col("a._n").isNotNull()
    for c in columns:
        x, y = F.col(f"e.`{c}`"), F.col(f"a.`{c}`")
        equal = x.eqNullSafe(y)
        same = same & ((equal | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))) if c in doubles else equal)
    pairs = e.join(a, F.col(f"e.`{key}`").eqNullSafe(F.col(f"a.`{key}`")) & (F.col("e._n") == F.col("a._n")), "full")
    return pairs.where(~same).select(F.coalesce(F.col(f"e.`{key}`"), F.col(f"a.`{key}`")).alias("_key"))


def _coerced(actual: DataFrame, expected: DataFrame, columns: list[str]):
    """Cast to the expected types; ``_lost`` marks rows in which a value was lost, if any cast may lose one."""
    selected, bad = [], None
    for name in columns:
        want, have = expected.schema[name].dataType, actual.schema[name].dataType
        source = F.col(f"`{name}`")
        if want == have:
            selected.append(source)
            continue
        cast = safe_cast(source, have, want.simpleString())
        lost = source.isNotNull() & cast.isNull()
        bad = lost if bad is None else bad | lost
        selected.append(cast.alias(name))
    if bad is None:
        return actual.select(*selected), False
    return actual.select(*selected, bad.cast("int").alias("_lost")), True


def _verdict(spark, ok: bool, detail: str | None) -> DataFrame:
    return spark.createDataFrame([(ok, detail)], "ok boolean, detail string")


def must_be_empty(df: DataFrame, name: str) -> DataFrame:
    """An assertion over a query that must return no rows: ``name, failures, passed``."""
    return df.agg(F.count(F.lit(1)).alias("failures")).select(
        F.lit(name).alias("name"), "failures", (F.col("failures") == 0).alias("passed")
    )
