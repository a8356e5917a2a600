"""Log lines and run documents: term metrics, classification, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.predicates import contains_term

# Terms that log filters count.
ERROR_TERMS = ("ERROR", "AnalysisException", "AccessDenied", "OutOfMemoryError")


def term_counts(df: DataFrame, text: str, terms: tuple[str, ...] = ERROR_TERMS, by: list[str] | None = None) -> DataFrame:
    """Lines per term, all terms in one scan: ``[by,] term, n``."""
    by = by or []
    counted = df.groupBy(*by).agg(*[F.count_if(contains_term(F.col(text), t)).alias(f"_t{i}") for i, t in enumerate(terms)])
    pairs = F.array(
        *[F.struct(F.lit(t).alias("term"), F.col(f"_t{i}").alias("n")) for i, t in enumerate(terms)]
    )
    return counted.select(*by, F.inline(pairs))


def nested_fields(df: DataFrame, json: str, schema: str, fields: dict[str, str], present: str) -> DataFrame:
    """Project fields of a JSON column under new names, where ``present`` exists."""
    body = df.withColumn("_body", F.from_json(json, schema)).where(F.col(f"_body.{present}").isNotNull())
    kept = [c for c in df.columns if c != json]
    return body.select(*kept, *[F.col(f"_body.{path}").alias(name) for name, path in fields.items()])


def latest(df: DataFrame, order: list[Column], n: int = 20) -> DataFrame:
    """The newest ``n`` documents; each task keeps only its own top ``n``."""
    return df.orderBy(*order).limit(n)
