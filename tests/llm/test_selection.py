"""Quality rules and mixing."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from small import odd_documents, prose

from tidewatch.llm import mixing, quality_rules
from tidewatch.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    from oracle import compare, connect

    assert compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR) == []


def test_lower_tail(spark):
    cases = [(0, 10), (1, 10), (3, 200), (0, 2000), (7, 2000), (20, 5000), (12, 2000)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality_rules.lower_tail(F.col("k"), F.col("n"), 0.005).alias("p"))
    for r in df.collect():
        exact = sum(math.comb(r.n, j) * 0.005**j * 0.995 ** (r.n - j) for j in range(r.k + 1))
        if r.k <= r.n * 0.005:
            assert math.isclose(r.p, exact, rel_tol=1e-9)
        else:
            assert r.p == 1.0


def test_cutoffs_need_evidence(spark):
    good = [(i, prose(60, i % 7), "en") for i in range(900)]
    bad = [(10_000 + i, " ".join(w + " ##" for w in prose(60, i).split()), "en") for i in range(40)]
    few = [(20_000 + i, prose(60, i), "de") for i in range(50)] + [(30_000, prose(60, 1).replace(" ", " ## "), "de")]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.when(F.col("doc_id").between(10_000, 19_999) | (F.col("doc_id") == 30_000), 0).otherwise(1).alias("quality"))
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs, labels, risk=0.01).collect()}
    assert all(got[i].kept for i in range(900)) and not any(got[10_000 + i].kept for i in range(40))
    assert "symbols" in got[10_000].broken
    # 50 good documents can't show a rate below one in a hundred.
    assert got[30_000].kept
    kept = quality_rules.keep(docs, labels, risk=0.01)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}


def test_quality_edges(spark):
    df = odd_documents(spark)
    labels = spark.createDataFrame([(5, 1, 0), (5, None, 0), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.apply_rules(df, labels)
    assert got.count() == 13
    by = defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r)
    assert by[1][0].n_words == 0 and by[1][0].base_failed and not by[1][0].kept
    assert by[4][0].n_words == 30000 and by[4][0].kept
    assert by[10][0].n_repeat_words == 1200 and by[10][0].base_failed
    assert quality_rules.apply_rules(df.limit(0), labels.limit(0)).count() == 0
    assert quality_rules.keep(df, labels.limit(0)).columns == df.columns


def test_mix_edges(spark):
    df = odd_documents(spark)
    got = mixing.mix(df).collect()
    assert len(got) == 13
    by = defaultdict(list)
    for r in got:
        assert r.taken in (0, r["size"], 2 * r["size"])
        by[r.source].append(r)
    total = sum(r["size"] for r in got)
    assert math.isclose(sum(v[0].target for v in by.values()), 1.5 * total)
    assert sum(r.taken for r in got) <= 1.5 * total
    assert {s: v[0].source_size for s, v in by.items()}[None] == 0
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.where("text IS NULL")).where("target <> 0 OR taken <> 0").count() == 0
    rows = mixing.mixed_rows(df)
    assert rows.columns == df.columns
    assert rows.where("text IS NULL").count() == 0 and rows.where("NOT _row <=> size").count() == 0


def test_mix_reaches_targets_in_small_buckets(spark, monkeypatch):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("s"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 9).cast("string")).alias("source"),
        (1 + F.col("id") * 7 % 50).alias("words"),
    )
    first = sorted(map(tuple, mixing.mix(docs, size=F.col("words")).collect()))
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", 7)
    assert sorted(map(tuple, mixing.mix(docs.repartition(5), size=F.col("words")).collect())) == first
    taken, target = defaultdict(int), {}
    for _, source, _, _, t, n in first:
        taken[source] += n
        target[source] = t
    assert all(abs(taken[s] - target[s]) <= 50 for s in target)
