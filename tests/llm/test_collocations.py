"""Frequent n-grams and phrase scores against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import compare, connect
from small import odd_documents

from tidewatch.llm import collocations
from tidewatch.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, longest=5):
    found, words = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for n in range(1, longest + 1):
                found.update((lang, tuple(ws[i : i + n])) for i in range(len(ws) - n + 1))
    return found, words


def brute(rows, top, threshold):
    found, words = brute_counts(rows)
    out = []
    for lang in words:
        frequent = {p: a for (g, p), a in found.items() if g == lang and a >= threshold}
        scored = []
        for p, a in frequent.items():
            if len(p) < 2 or any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, _, l, r = min((1000 * a * words[lang] // (frequent[p[:k]] * frequent[p[k:]]), k, frequent[p[:k]], frequent[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, words[lang], -score))
    return sorted(out)


def texts(n, seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "é", "The", "THE", "ß中", "a'b", "x-y", "🙂"]
    rows = []
    for _ in range(n):
        ws = draw.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=draw.randint(0, 60))
        text = "".join(w + draw.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " \x0b", "\x85", "\xa0", "?! "]) for w in ws)
        rows.append((draw.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows + [("en", "of the people , of the people"), ("en", None), (None, ""), ("fr", " ,. ")] * 5


@pytest.mark.parametrize("options", [{}, {"block_bytes": 700, "partition_mass": 300}, {"block_bytes": 1, "partition_mass": 5000}])
def test_frequent_phrases_equal_brute_force(spark, options):
    rows = texts(300, 1)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    kept, words = collocations.frequent_phrases(df, threshold=7, **options)
    found, totals = brute_counts(rows)
    want = {(g, " ".join(p), len(p), a) for (g, p), a in found.items() if a >= 7}
    assert {tuple(r) for r in kept.collect()} == want
    assert {tuple(r) for r in words.collect()} == {(g, n) for g, n in totals.items() if n}


@pytest.mark.parametrize("top", [5, 2000])
def test_collocations_equal_brute_force(spark, top):
    rows = texts(400, 2)
    df = spark.createDataFrame(rows, "lang string, text string")
    got = collocations.collocations(df, top=top, threshold=6, partition_mass=2000, block_bytes=3000)
    assert sorted(map(tuple, got.collect())) == brute(rows, top, 6)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    want = brute([(r.lang, r.text) for r in docs.collect()], 2000, 30)
    assert sorted(map(tuple, collocations.collocations(docs, threshold=30).collect())) == want and want
    assert collocations.collocations(docs.limit(0)).collect() == []
    for wrong in ({"threshold": 0}, {"longest": 6}):
        with pytest.raises(ValueError):
            collocations.collocations(docs, **wrong)


def test_scores_are_exact_beyond_64_bits(spark):
    # 1000 * a * n passes 2^63, the quotient does not.
    score = spark.sql(
        "SELECT (1000BD * CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0))) AS s"
        " FROM VALUES (9000000000000L, 99999999999989L, 30000000000003L, 90000000000007L) AS t(a, n, l, r)"
    ).first()[0]
    assert score == 1000 * 9000000000000 * 99999999999989 // (30000000000003 * 90000000000007)


@pytest.mark.parametrize("seed", range(5))
def test_summaries_keep_every_frequent_key(seed):
    draw = np.random.default_rng(seed)
    threshold, tables = 50, []
    for _ in range(40):
        keys = np.unique(draw.zipf(1.3, 3000) % 5000)
        tables.append((keys.astype(np.uint64), draw.integers(1, 6, len(keys))))
    truth = Counter()
    for keys, counts in tables:
        truth.update(dict(zip(keys.tolist(), counts.tolist())))
    mass = sum(truth.values())
    for capacity in (mass // threshold + 1, 3 * mass // threshold):
        keys, counters, error = collocations.misra_gries(tables, capacity)
        held = dict(zip(keys.tolist(), counters.tolist()))
        assert len(held) <= capacity and error * (capacity + 1) <= mass
        assert all(held.get(k, 0) <= a <= held.get(k, 0) + error for k, a in truth.items())
        assert {k for k, a in truth.items() if a >= threshold} <= {k for k, c in held.items() if c + error >= threshold}


def test_query_equals_its_sql(spark):
    name = "op12_collocations"
    sf_dir = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir) == []
