"""Row predicates and small derived columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mark a refused request.
DENIAL_MARKERS = (
    "access denied",
    "accessdenied",
    "not authorized",
    "insufficient lake formation permission",
    "permission",
)

# The environments a definition without a list applies to.
ENVIRONMENTS = ("dev", "test", "uat", "prod")


def contains_term(text: Column, term: str) -> Column:
    """Case-sensitive term match; NULL text matches nothing."""
    return F.coalesce(F.contains(text, F.lit(term)), F.lit(False))


def contains_any(text: Column, markers: tuple[str, ...] = DENIAL_MARKERS) -> Column:
    """Case-insensitive any-of match; NULL and empty text match nothing."""
    lowered = F.lower(text)
    return F.coalesce(reduce(or_, [F.contains(lowered, F.lit(m)) for m in markers]), F.lit(False))


def has_exact_dims(dims: Column, names: list[str], **values: str) -> Column:
    """A series that carries exactly these dimension names, with these values where given."""
    same = F.array_sort(F.map_keys(dims)) == F.array(*[F.lit(n) for n in sorted(names)])
    tests = [F.try_element_at(dims, F.lit(k)) == F.lit(v) for k, v in values.items()]
    return F.coalesce(reduce(lambda a, b: a & b, tests, same), F.lit(False))


def any_dim_contains(dims: Column, term: str) -> Column:
    return F.coalesce(F.exists(F.map_values(dims), lambda v: F.contains(v, F.lit(term))), F.lit(False))


def in_environment(environments: Column, environment: str) -> Column:
    """Listed, or without a list at all (which means every environment)."""
    every = F.array(*[F.lit(e) for e in ENVIRONMENTS])
    return F.array_contains(F.coalesce(environments, every), environment)


def is_active(retired: Column) -> Column:
    return ~F.coalesce(retired, F.lit(False))


def not_listed(value: Column, excluded: Column) -> Column:
    return ~F.coalesce(F.array_contains(excluded, value), F.lit(False))


def exactly_one(a: Column, b: Column) -> Column:
    return a.isNotNull() != b.isNotNull()


def guarded_ratio(part: Column, rest: Column, minimum: float) -> Column:
    """``part / (part + rest)`` once there are enough of both, else 0."""
    total = part + rest
    return F.when((total >= minimum) & (total != 0), part / total).otherwise(F.lit(0.0))


def severity(value: Column, warning: float = 85, critical: float = 95) -> Column:
    return F.when(value >= critical, "critical").when(value >= warning, "warning").otherwise("ok")


def include_exclude(text: Column, include: str, exclude: str | None = None) -> Column:
    kept = text.rlike(include)
    return kept & ~text.rlike(exclude) if exclude else kept


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value.

    The parser stops after the first value, so the text is also tried as an
    array member and as an object member; nothing can trail it in both.
    """
    wrapped = (F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.coalesce(reduce(lambda a, b: a & b, [F.try_parse_json(w).isNotNull() for w in wrapped]), F.lit(False))
