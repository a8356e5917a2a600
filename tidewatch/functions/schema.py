"""Declared column types and their application to a table."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type names accepted for landed files, with their Spark names.
LANDING_TYPES = {
    "boolean": "boolean",
    "tinyint": "tinyint",
    "smallint": "smallint",
    "int": "int",
    "bigint": "bigint",
    "float": "float",
    "double": "double",
    "decimal": "decimal(10,0)",
    "string": "string",
    "varchar": "string",
    "char": "string",
    "binary": "binary",
    "date": "date",
    "timestamp": "timestamp",
}

# Type names accepted for ACID tables, with their Spark names.
ACID_TYPES = {
    "boolean": "boolean",
    "int": "int",
    "long": "bigint",
    "float": "float",
    "double": "double",
    "date": "date",
    "timestamp": "timestamp_ntz",
    "timestamptz": "timestamp",
    "string": "string",
    "uuid": "string",
    "binary": "binary",
}

_DECIMAL = re.compile(r"^decimal\( *(\d{1,2}) *, *(\d{1,2}) *\)$")
_SIZED = re.compile(r"^(varchar|char|fixed)\( *(\d+) *\)$")
_UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


class UnsupportedType(ValueError):
    """A declared type that Spark has no stable counterpart for."""


def spark_type(declared: str, family: str = "landing") -> str:
    """The Spark type that holds a declared type; sizes are checked separately."""
    name = declared.strip().lower()
    known = LANDING_TYPES if family == "landing" else ACID_TYPES
    if name in known:
        return known[name]
    decimal = _DECIMAL.match(name)
    if decimal:
        precision, scale = int(decimal[1]), int(decimal[2])
        if not 1 <= precision <= 38 or scale > precision:
            raise UnsupportedType(f"{declared}: precision is 1-38 and scale at most the precision")
        return f"decimal({precision},{scale})"
    sized = _SIZED.match(name)
    if sized and (sized[1] == "fixed") == (family == "acid"):
        return "binary" if sized[1] == "fixed" else "string"
    if family == "landing" and name.startswith(("array<", "map<", "struct<")):
        return _nested(name)
    raise UnsupportedType(f"{declared}: no such type for {family} tables")


def _nested(name: str) -> str:
    if "uniontype" in name:
        raise UnsupportedType(f"{name}: union types have no Spark counterpart")
    parsed = T.StructType.fromDDL(f"c {name}").fields[0].dataType
    if isinstance(parsed, T.MapType) and isinstance(parsed.keyType, (T.ArrayType, T.MapType, T.StructType)):
        raise UnsupportedType(f"{name}: a map key must be a primitive")
    return name


def struct_type(columns: list[dict], family: str = "landing") -> T.StructType:
    """The read schema of ``[{name, type, required?}]``."""
    ddl = ", ".join(f"`{c['name'].lower()}` {spark_type(c['type'], family)}" for c in columns)
    fields = T.StructType.fromDDL(ddl).fields
    return T.StructType(
        [T.StructField(f.name, f.dataType, not c.get("required", False)) for f, c in zip(fields, columns)]
    )


def _size_limit(declared: str) -> tuple[str, int] | None:
    sized = _SIZED.match(declared.strip().lower())
    return (sized[1], int(sized[2])) if sized else None


def truthy(text: Column) -> Column:
    """The truth set of text booleans: ``true`` or ``1``, in any case."""
    return F.lower(text).isin("true", "1")


_INTEGRAL_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def safe_cast(source: Column, have: T.DataType, target: str) -> Column:
    """Cast to a Spark type, NULL where the value does not fit or does not parse.

    A failing ``try_cast`` of a number raises and catches an exception for its
    row, so values that cannot fit are sorted out by a plain comparison first.
    """
    if target == have.simpleString():
        return source
    if isinstance(have, T.StringType):
        if target == "boolean":
            return truthy(source)
        if target in _INTEGRAL_BITS:
            return F.when(source.rlike(r"^\s*[+-]?[0-9]+\s*$"), source.try_cast(target))
        if target in ("string", "binary"):
            return source.try_cast(target)
        return F.nullif(source, F.lit("")).try_cast(target)
    if isinstance(have, _NUMERIC):
        if target in _INTEGRAL_BITS:
            limit = 2 ** (_INTEGRAL_BITS[target] - 1)
            # One more on either side: a fraction is cut off, as the cast does.
            fits = (source > F.lit(float(-limit - 1))) & (source < F.lit(float(limit)))
            if isinstance(have, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                fits = source.between(-limit, limit - 1)
            return F.when(fits, source.try_cast(target))
        decimal = _DECIMAL.match(target)
        if decimal:
            return F.when(F.abs(source) < F.lit(float(10 ** (int(decimal[1]) - int(decimal[2])))), source.try_cast(target))
    return source.try_cast(target)


def _converted(df: DataFrame, column: dict, family: str) -> Column:
    return safe_cast(F.col(f"`{column['name']}`"), df.schema[column["name"]].dataType, spark_type(column["type"], family))


def apply_schema(df: DataFrame, columns: list[dict], family: str = "landing") -> DataFrame:
    """Select the declared columns, each cast to its declared type; bad values become NULL.

    Files may hold a wider physical type than declared (64-bit integers below
    an ``int`` column), so the cast follows the read instead of forcing a
    read schema.
    """
    return df.select(*[_converted(df, c, family).alias(c["name"].lower()) for c in columns])


def _lost_inside(source: Column, converted: Column, have: T.DataType) -> Column:
    """Whether a nested value has parts that were lost by the cast."""
    if isinstance(have, T.StructType):
        lost = [_lost_inside(source[f.name], converted[f.name], f.dataType) for f in have.fields]
        return reduce(or_, lost, F.lit(False))
    if isinstance(have, T.MapType):
        source, converted, have = F.map_values(source), F.map_values(converted), T.ArrayType(have.valueType)
    if isinstance(have, T.ArrayType):
        both = F.arrays_zip(source.alias("s"), converted.alias("c"))
        return F.coalesce(F.exists(both, lambda e: _lost_inside(e["s"], e["c"], have.elementType)), F.lit(False))
    return source.isNotNull() & converted.isNull()


def schema_violations(df: DataFrame, columns: list[dict], family: str = "landing") -> DataFrame:
    """Counts per column and rule: ``column, rule, n`` in one pass over the table."""
    checks = []
    for column in columns:
        name, source = column["name"], F.col(f"`{column['name']}`")
        converted = _converted(df, column, family)
        checks.append((name, "type", source.isNotNull() & converted.isNull()))
        have = df.schema[name].dataType
        if isinstance(have, (T.ArrayType, T.MapType, T.StructType)):
            inner = _lost_inside(source, converted, have)
            checks.append((name, "inner type", source.isNotNull() & converted.isNotNull() & inner))
        if column.get("required"):
            checks.append((name, "required", source.isNull()))
        limit = _size_limit(column["type"])
        if limit:
            kind, size = limit
            width = F.length(source)
            checks.append((name, "size", (width != size) if kind == "fixed" else (width > size)))
        if column["type"].strip().lower() == "uuid":
            checks.append((name, "format", source.isNotNull() & ~source.rlike(_UUID)))
    totals = df.agg(*[F.count_if(test).alias(f"c{i}") for i, (_, _, test) in enumerate(checks)])
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("column"), F.lit(rule).alias("rule"), F.col(f"c{i}").alias("n"))
            for i, (name, rule, _) in enumerate(checks)
        ]
    )
    return totals.select(F.inline(entries)).where("n > 0")
