"""Naming formulas and text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(*parts: Column) -> Column:
    """Parts joined with ``-``; two different part lists may give one slug."""
    return F.concat_ws("-", *parts)


def database_of(environment: str, namespace: Column, prefix: str = "platform") -> Column:
    return F.lower(F.concat(F.lit(f"{prefix}_{environment}_"), F.replace(namespace, F.lit("-"), F.lit("_"))))


def role_of(environment: str, kind: str, name: Column, prefix: str = "platform") -> Column:
    return F.concat(F.lit(f"{prefix}-{environment}-{kind}-"), name)


def workgroup_of(environment: str, namespace: Column, prefix: str = "platform") -> Column:
    return F.concat_ws("-", F.lit(prefix), F.lit(environment), namespace, F.lit("wg"))


def object_path(namespace: Column, table: Column, run_id: Column, extension: Column) -> Column:
    return F.concat(namespace, F.lit("/"), table, F.lit("/"), run_id, F.lit("/data."), extension)


def without_suffix(text: Column, suffix: str) -> Column:
    return F.regexp_replace(text, _literal(suffix) + "$", "")


def without_prefix(text: Column, prefix: str) -> Column:
    return F.regexp_replace(text, "^" + _literal(prefix), "")


def first_segment_after(path: Column, marker: str) -> Column:
    """The path segment that follows a marker; NULL where the marker is absent."""
    found = F.regexp_extract(path, _literal(marker) + "([^/?#]+)", 1)
    return F.nullif(found, F.lit(""))


def common_name(subject: Column) -> Column:
    """The value after ``CN=`` up to the next comma."""
    return F.nullif(F.regexp_extract(subject, "CN=([^,]+)", 1), F.lit(""))


def _literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "_ /" else c for c in text)


# Identifier formats, as regular expressions.
SLUG_PATTERN = "^[a-z][a-z0-9-]*$"
ROLE_ARN_PATTERN = "^arn:aws:iam::[0-9]{12}:role/.+$"
CIDR_PATTERN = r"^([0-9]{1,3}\.){3}[0-9]{1,3}/[0-9]{1,2}$"


def is_slug(text: Column) -> Column:
    return text.rlike(SLUG_PATTERN)


def is_role_arn(text: Column) -> Column:
    return text.rlike(ROLE_ARN_PATTERN)


def is_cidr(text: Column) -> Column:
    """Four octets and a prefix length, all in range."""
    octets = F.split(F.split_part(text, F.lit("/"), F.lit(1)), r"\.")
    in_range = F.forall(octets, lambda o: o.try_cast("int").between(0, 255))
    width = F.split_part(text, F.lit("/"), F.lit(2)).try_cast("int").between(0, 32)
    return F.when(text.rlike(CIDR_PATTERN), in_range & width).otherwise(F.lit(False))


def fingerprint(*columns: Column) -> Column:
    """An md5 over the columns, which changes when any of them does."""
    return F.md5(F.concat_ws("|", *columns))


def stable_part(value: Column, parts: Column) -> Column:
    """A part number below ``parts`` from the md5 of a value; the same in any engine."""
    head = F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, parts)
