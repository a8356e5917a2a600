"""Runs against brute force over all periods and starts."""

import random
from collections import Counter

import pytest
from oracle import compare, connect
from small import odd_documents

from tidewatch.llm import periodic_runs
from tidewatch.llm.queries import ORACLES, QUERIES


def brute_runs(words):
    """Start, length and period, straight from the definition."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            begin = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            length = i - begin
            part = words[begin : begin + q]
            power = any(q % d == 0 and part == part[:d] * (q // d) for d in range(1, q))
            if length >= max(6, 4 * q) and not power:
                found.append((begin, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    dropped = {i for begin, length, q in runs for i in range(begin + q, begin + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def splice(draw, alphabet, pieces):
    """Random words with stretches of every sort of period in between."""
    words = []
    for _ in range(pieces):
        q = draw.choice([1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 16, 17, 31, 32, 33, 40])
        root = [draw.choice(alphabet) for _ in range(q)]
        words += (root * 12)[: draw.randint(q, 11 * q)]
        words += [draw.choice(alphabet) for _ in range(draw.randint(0, 12))]
        if draw.random() < 0.3:
            words += words[-draw.randint(1, len(words)) :]
    return words


def texts():
    draw = random.Random(3)
    rows = []
    for k in range(220):
        alphabet = [f"w{i}" for i in range(draw.choice([1, 2, 3, 5, 40, 1000]))]
        rows.append(splice(draw, alphabet, draw.randint(1, 6)) if k % 4 else [draw.choice(alphabet) for _ in range(draw.randint(0, 300))])
    # Fibonacci and square-free-like words, powers of powers.
    a, b = ["a"], ["a", "b"]
    for _ in range(11):
        a, b = b, b + a
    rows += [b, (["x"] * 5 + ["y"]) * 40, ["z"] * 5, ["z"] * 6, ["x", "y"] * 3, ["x", "y"] * 4, ["x", "y", "z"] * 4, (["a", "b"] * 5 + ["c"]) * 9]
    return rows


@pytest.fixture(params=[(4096, 8), (8, 2), (1, 1)])
def sizes(request, monkeypatch):
    monkeypatch.setattr(periodic_runs, "TILE_WORDS", request.param[0])
    monkeypatch.setattr(periodic_runs, "TILE_BOUNDARIES", request.param[1])


def test_runs_equal_brute_force(spark, sizes):
    rows = texts()
    df = spark.createDataFrame([(i, " \n".join(ws)) for i, ws in enumerate(rows)], "id long, text string").repartition(3)
    found = {r._row.id: r for r in periodic_runs.collapsed(df).collect()}
    assert len(found) == len(rows)
    several = 0
    for i, ws in enumerate(rows):
        want = brute_runs(ws)
        assert [tuple(r) for r in found[i].runs] == want, ws
        assert found[i].collapsed == brute_collapsed(ws, want)
        several += len(want) > 1
    assert several > 50


def test_strongest_run_is_exact(spark):
    rows = [([(0, 9, 2), (3, 18, 4), (9, 9, 2)],), ([],), ([(5, 2000000001, 400000000), (6, 2000000000, 400000000), (7, 1999999999, 399999999)],)]
    df = spark.createDataFrame(rows, f"runs {periodic_runs.RUNS}").withColumn("best", periodic_runs.strongest(periodic_runs.F.col("runs")))
    got = [r.best and tuple(r.best) for r in df.collect()]
    assert got == [(0, 9, 2), None, (7, 1999999999, 399999999)]


def test_long_text_and_odd_rows(spark):
    docs = odd_documents(spark)
    draw = random.Random(8)
    root = [f"v{i}" for i in range(3000)]
    long = [draw.choice(root) for _ in range(5000)] + root * 9 + ["q"] * 7000 + [draw.choice(root) for _ in range(5000)]
    more = docs.unionByName(docs.limit(1).withColumn("text", periodic_runs.F.lit(" ".join(long))).withColumn("doc_id", periodic_runs.F.lit(99)))
    found = periodic_runs.collapsed(more).collect()
    assert Counter((r._row.doc_id, r._row.text) for r in found) == Counter((r.doc_id, r.text) for r in more.collect())
    for r in found:
        words = (r._row.text or "").split()
        want = [(5000, 27000, 3000), (32000, 7000, 1)] if r._row.doc_id == 99 else brute_runs(words) if len(words) < 5000 else []
        assert [tuple(x) for x in r.runs] == want
        assert r.collapsed == brute_collapsed(words, want)
    assert periodic_runs.collapsed(docs.limit(0)).collect() == []


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, sf_dir):
    name = "op11_periodic_runs"
    assert compare(spark, connect(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir) == []
