"""Registrations expanded to their children, owned children and system rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The system topics of a connect registration.
SYSTEM_TOPICS = (
    ("connect-configs", 1, "compact", -1),
    ("connect-offsets", 25, "compact", -1),
    ("connect-status", 5, "compact,delete", 86_400_000),
)
LICENSED_TOPICS = (("confluent-license", 1, "compact", -1),)
LICENSED_VARIANT = "confluent"


def _literal_array(rows) -> Column:
    names = ("suffix", "partitions", "cleanup", "retention_ms")
    types = ("string", "int", "string", "bigint")
    return F.array(
        *[F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(row, names, types)]) for row in rows]
    )


def system_rows(registrations: DataFrame, name: str, variant: str) -> DataFrame:
    """Three system topics per registration, a fourth for the licensed variant."""
    licensed = F.coalesce(F.col(variant), F.lit("standard")) == LICENSED_VARIANT
    rows = F.when(licensed, _literal_array(SYSTEM_TOPICS + LICENSED_TOPICS)).otherwise(_literal_array(SYSTEM_TOPICS))
    return (
        registrations.select(F.col(name).alias("registration"), F.inline(rows))
        .withColumn("topic", F.concat_ws("-", F.col("registration").cast("string"), "suffix"))
    )


def active_children(
    parents: DataFrame,
    children: DataFrame,
    owned: DataFrame,
    key: str,
    has_own: str,
    retired: str,
    excluded: Column | None = None,
) -> DataFrame:
    """Children of the parents in use.

    A parent is in use when it is not retired and either has its own producer
    or is owned by a registration; excluded children are left out.
    """
    live = parents.where(~F.coalesce(F.col(retired), F.lit(False)))
    own = live.where(has_own).select(key)
    adopted = live.where(~F.col(has_own)).join(owned.select(key).distinct(), key, "left_semi").select(key)
    in_use = own.unionByName(adopted)
    kept = children if excluded is None else children.where(~F.coalesce(excluded, F.lit(False)))
    return kept.join(in_use, key, "left_semi")


def needing_own_role(parents: DataFrame, owned: DataFrame, key: str, has_own: str, retired: str) -> DataFrame:
    """Parents with their own producer that no registration owns."""
    live = parents.where(F.col(has_own) & ~F.coalesce(F.col(retired), F.lit(False)))
    return live.join(owned.select(key).distinct(), key, "left_anti")


def keyed_product(df: DataFrame, definitions: list[str], key: str, name: str = "definition") -> DataFrame:
    """Each row once per definition with the key ``definition-row``; nothing is joined."""
    members = F.array(*[F.lit(d) for d in definitions])
    return df.withColumn(name, F.explode(members)).withColumn(
        "entry_key", F.concat_ws("-", F.col(name), F.col(key).cast("string"))
    )


def lookup_with_default(df: DataFrame, lookup: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left join to a table of one row per key; absent keys get the default."""
    return df.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))
