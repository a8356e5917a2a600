"""Integrity rules. Every rule returns ``rule, key, detail``, one row per violation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.grouping import children_per_parent


def _violations(df: DataFrame, rule: str, key: Column, detail: Column, where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def required(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per record that lacks a required field, naming the fields."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    marked = df.select(F.col(key).alias("_k"), missing.alias("_m")).where(F.size("_m") > 0)
    return _violations(marked, "required", F.col("_k"), F.array_join("_m", ", "))


def one_of(df: DataFrame, key: str, column: str, allowed: list) -> DataFrame:
    bad = ~F.coalesce(F.col(column).isin(allowed), F.lit(False))
    return _violations(df, "one_of", F.col(key), F.coalesce(F.col(column).cast("string"), F.lit("NULL")), bad)


def matches(df: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    return _violations(df, "matches", F.col(key), F.col(column), ~F.col(column).rlike(pattern))


def max_length(df: DataFrame, key: str, derived: Column, limit: int) -> DataFrame:
    named = df.select(F.col(key).alias("_k"), derived.alias("_d")).where(F.length("_d") > limit)
    return _violations(named, "max_length", F.col("_k"), F.concat("_d", F.lit(" has "), F.length("_d")))


def in_range(df: DataFrame, key: Column, column: str, low: float, high: float) -> DataFrame:
    return _violations(df, "in_range", key, F.col(column), ~F.col(column).between(low, high))


def unique(df: DataFrame, keys: list[str], source: str, active: Column | None = None) -> DataFrame:
    """Keys held by more than one active row, a row for each place they were found in: ``k (in a)``."""
    rows = df if active is None else df.where(active)
    found = children_per_parent(rows, keys, source, having=2)
    label = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    place = F.coalesce(F.col(source).cast("string"), F.lit("NULL"))
    return _violations(found, "unique", label, F.concat(label, F.lit(" (in "), place, F.lit(")")))


def is_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Row count against distinct keys, as one row."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        (F.coalesce(F.max("_n"), F.lit(1)) == 1).alias("is_unique"),
    )


def references(df: DataFrame, key: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference has no parent; a NULL reference is an orphan as well."""
    # The column is renamed by key name only on the way into the anti-join.
    parents = parent.select(F.col(parent_key).alias(column)).distinct()
    orphans = df.join(parents, column, "left_anti")
    return _violations(orphans, "references", F.col(key), F.coalesce(F.col(column).cast("string"), F.lit("NULL")))


def equals_path_part(df: DataFrame, key: str, name: Column, part: Column) -> DataFrame:
    differs = ~name.eqNullSafe(part)
    detail = F.concat(F.coalesce(name, F.lit("NULL")), F.lit(" <> "), F.coalesce(part, F.lit("NULL")))
    return _violations(df, "equals_path_part", F.col(key), detail, differs)


def disjoint(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Members found in both of a row's lists."""
    both = df.select(F.col(key).alias("_k"), F.sort_array(F.array_intersect(left, right)).alias("_m"))
    return _violations(both.where(F.size("_m") > 0), "disjoint", F.col("_k"), F.array_join("_m", ", "))


def disjoint_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys found in both of two tables."""
    shared = left.select(key).intersect(right.select(key))
    return _violations(shared, "disjoint", F.col(key), F.lit("in both"))


def implies(df: DataFrame, key: str, condition: Column, consequence: Column, detail: Column) -> DataFrame:
    bad = F.coalesce(condition, F.lit(False)) & ~F.coalesce(consequence, F.lit(False))
    return _violations(df, "implies", F.col(key), detail, bad)


def known_kinds(df: DataFrame, kind: str, source: str, known: list[str]) -> DataFrame:
    """Unknown kinds, a row for each source that uses one."""
    unknown = df.where(~F.coalesce(F.col(kind).isin(known), F.lit(False)))
    found = children_per_parent(unknown, [kind], source)
    return _violations(found, "known_kinds", F.coalesce(kind, F.lit("NULL")), F.coalesce(F.col(source).cast("string"), F.lit("NULL")))


def retired_before_removal(previous: DataFrame, current: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows that are gone although the snapshot before had not flagged them."""
    gone = previous.join(current.select(key), key, "left_anti")
    return _violations(gone, "retired_before_removal", F.col(key), F.lit("removed without flag"), ~F.coalesce(flag, F.lit(False)))


def fan_out(df: DataFrame, parent: str, limit: int) -> DataFrame:
    """A warning for parents of more than ``limit`` children; it fails nothing."""
    counted = df.groupBy(parent).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    return _violations(counted, "fan_out", F.col(parent), F.concat(F.lit("warning: "), F.col("_n"), F.lit(" children")))


def report(*rules: DataFrame) -> DataFrame:
    """All violations of several rules in one table."""
    return reduce(DataFrame.unionByName, rules)
