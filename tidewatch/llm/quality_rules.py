"""Quality rules whose cut-offs carry a guarantee on labelled holdouts.

For each stratum and rule, cut-offs are tested from mild to strict on the good
documents of the holdout. A cut-off is certified when so few of them break it
that a true rate of ``risk`` would show this only with a small probability: the
exact lower binomial tail. A sequence that stops at its first failure needs no
further correction; across strata and rules the error is divided (Bonferroni),
so with probability ``1 - error`` no rule of any stratum rejects more than
``risk`` of the good documents. Among certified cut-offs the one that rejects
the most bad documents is taken; a rule that can't be certified, or that
rejects no more bad than good ones, stays off in that stratum.

Everything is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import materialise

from .words import WORD, bind, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A ratio of two counts and its cut-offs, mild first; ``above`` tells which side is rejected."""

    name: str
    feature: tuple[str, str]
    above: bool
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", ("n_symbols", "n_words"), True, (2.0, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05)),
    Rule("dup_lines", ("n_dup_lines", "n_lines"), True, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    Rule("repeats", ("n_repeat_words", "n_words"), True, (0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    Rule("long_words", ("word_chars", "n_words"), True, (20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0)),
    Rule("short_words", ("word_chars", "n_words"), False, (1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.3)),
)


def _repeat_words(ws: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their three words. Only texts
    with a repeated window are sorted.
    """
    windows = F.transform(
        F.sequence(F.lit(1), F.size(ws) - 2),
        lambda i: F.xxhash64(F.element_at(ws, i), F.element_at(ws, i + 1), F.element_at(ws, i + 2)),
    )

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            near = lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
            return F.array_sort(F.filter(F.transform(s, lambda x, k: F.when(near(x, k), x["i"])), lambda i: i.isNotNull()))

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda sum_, step: sum_ + step)

        return bind(bind(placed, repeated), total)

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(covered(hashes))

    return F.when(F.size(ws) < 4, F.lit(0).cast("bigint")).otherwise(bind(windows, counted))


def text_counts(text: Column) -> Column:
    """The counts of one whole text, as a struct of longs; all 0 for a missing text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    of_lines = bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    of_words = bind(
        words(text),
        lambda ws: F.struct(
            F.size(ws).alias("n"), F.length(F.array_join(ws, "")).alias("chars"), _repeat_words(ws).alias("repeat")
        ),
    )
    return bind(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda x: F.struct(
            x["w"]["n"].cast("bigint").alias("n_words"),
            x["w"]["chars"].cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            x["l"]["n"].cast("bigint").alias("n_lines"),
            x["l"]["dup"].cast("bigint").alias("n_dup_lines"),
            x["w"]["repeat"].alias("n_repeat_words"),
        ),
    )


def base_failed(c) -> Column:
    """Too short, or more than half of the words repeat. ``c`` gives a count by its name."""
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def _breaks(rule: Rule, cutoff: Column, c) -> Column:
    value = F.try_divide(*[c(name).cast("double") for name in rule.feature])
    return F.coalesce(value > cutoff if rule.above else value < cutoff, F.lit(False))


def _broken(rules: tuple[Rule, ...], cutoffs: Column, c) -> Column:
    """Names of the rules of the stratum that a document breaks."""
    names = F.array(*[F.when(_breaks(r, cutoffs[r.name], c), F.lit(r.name)) for r in rules])
    return F.filter(names, lambda name: name.isNotNull())


def _stratum(column: str) -> Column:
    """Never null, so a join on it keeps documents without a stratum."""
    return F.when(F.col(column).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(column).cast("string")))


def lower_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial count, summed term by term in logarithms.

    Only asked for ``k`` of at most ``n * p``, as no larger one is certified.
    """
    odds = F.lit(p / (1 - p))
    start = F.struct((n * F.log1p(F.lit(-p))).alias("term"), F.exp(n * F.log1p(F.lit(-p))).alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j * odds)
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k <= n * p, F.aggregate(terms, start, step, lambda acc: acc["sum"])).otherwise(F.lit(1.0))


def certified_cutoffs(holdout: DataFrame, rules: tuple[Rule, ...], risk: float, error: float) -> DataFrame:
    """One row ``(_stratum, rule, cutoff)`` for each rule that holds in a stratum.

    ``holdout`` has ``_stratum``, ``_good`` and the counts, one row a labelled
    document. It is reduced to counts per stratum, rule and cut-off before
    anything is shuffled, so a stratum with most of the rows is not a hot key.
    """
    tested = F.array(
        *[
            F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("order"), F.lit(c).alias("cutoff"), _breaks(r, F.lit(c), F.col).alias("broken"))
            for r in rules
            for i, c in enumerate(r.cutoffs)
        ]
    )
    counts = (
        holdout.select("_stratum", "_good", F.explode(tested).alias("t"))
        .groupBy("_stratum", "t.rule", "t.order", "t.cutoff")
        .agg(
            F.count_if("_good").alias("n"),
            F.count_if(F.col("_good") & F.col("t.broken")).alias("k"),
            F.count_if(~F.col("_good") & F.col("t.broken")).alias("caught"),
        )
    )
    # One row per stratum, rule and cut-off is left.
    strata = counts.agg(F.count_distinct("_stratum").alias("n")).first()["n"]
    each = error / max(1, strata * len(rules))
    ahead = Window.partitionBy("_stratum", "rule").orderBy("order")
    passed = counts.withColumn("holds", lower_tail(F.col("k"), F.col("n"), risk) <= each)
    useful = passed.withColumn("holds", F.min("holds").over(ahead)).where("holds AND caught > k")
    rank = F.struct(F.col("caught"), -F.col("k"), -F.col("order"))
    return useful.groupBy("_stratum", "rule").agg(F.max_by("cutoff", rank).alias("cutoff"))


def _certified(
    counted: DataFrame, labels: DataFrame, key: str, label: str, rules: tuple[Rule, ...], risk: float, error: float
) -> DataFrame:
    """``(_stratum, _cutoffs)``: a map from rule to cut-off, for the strata that have any."""
    judged = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.min(label) > 0).alias("_good"))
    holdout = counted.where(~base_failed(F.col)).join(judged, "_key")
    # One row per stratum; as a file its size is known, and Spark decides on broadcasting by it.
    return materialise(
        certified_cutoffs(holdout, rules, risk, error)
        .groupBy("_stratum")
        .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    )


def _counted(docs: DataFrame, key: str, text: str, stratum: str) -> DataFrame:
    counts = docs.select(F.col(key).alias("_key"), _stratum(stratum).alias("_stratum"), text_counts(F.col(text)).alias("_c"))
    return materialise(counts.select("_key", "_stratum", *[F.col(f"_c.{c}").alias(c) for c in COUNTS]))


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    label: str = "quality",
    rules: tuple[Rule, ...] = RULES,
    risk: float = 0.005,
    error: float = 0.05,
) -> DataFrame:
    """Counts and verdict of every document: key, counts, ``base_failed``, ``broken``, ``kept``.

    A row is kept unless its text fails the base rules or breaks a certified
    cut-off of its stratum; ``broken`` lists the rules. Missing texts count as
    empty (base failed), a missing stratum is a stratum of its own, labels
    without a value are no labels, several labels of one key count as good
    only if all are. Repeated rows get the same verdict each; rows with a
    missing key are judged but never matched with a label. Without labels no
    cut-off holds and the base rules alone decide; an empty table stays empty.
    Other columns of ``docs`` are not returned.
    """
    counted = _counted(docs, key, text, stratum)
    cutoffs = _certified(counted, labels, key, label, rules, risk, error)
    return (
        counted.join(cutoffs, "_stratum", "left")
        .withColumn("broken", _broken(rules, F.col("_cutoffs"), F.col))
        .select(
            F.col("_key").alias(key),
            *COUNTS,
            base_failed(F.col).alias("base_failed"),
            "broken",
            (~base_failed(F.col) & (F.size("broken") == 0)).alias("kept"),
        )
    )


def keep(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    label: str = "quality",
    rules: tuple[Rule, ...] = RULES,
    risk: float = 0.005,
    error: float = 0.05,
) -> DataFrame:
    """The rows of ``docs`` that ``apply_rules`` keeps, with all their columns.

    The counts are taken twice, for the certificates and for the filter, so
    that no text is shuffled.
    """
    cutoffs = _certified(_counted(docs, key, text, stratum), labels, key, label, rules, risk, error)

    def kept(counts: Column) -> Column:
        c = lambda name: counts[name]
        return ~base_failed(c) & (F.size(_broken(rules, F.col("_cutoffs"), c)) == 0)

    # The row travels as one column, so that no name of it can clash.
    rows = docs.select(F.struct(*docs.columns).alias("_row"), _stratum(stratum).alias("_stratum"))
    judged = rows.join(cutoffs, "_stratum", "left")
    return judged.where(bind(text_counts(F.col(f"_row.`{text}`")), kept)).select("_row.*")
