"""Shards against the law they promise."""

import zlib
from collections import Counter, defaultdict

import pytest
from oracle import compare, connect
from small import odd_documents

from tidewatch.llm import sharding
from tidewatch.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, sf_dir):
    name = "op13_sharding"
    assert compare(spark, connect(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir) == []


def check(rows, shards):
    total = len(rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert sum(sizes) == total and max(sizes) - min(sizes) <= 1
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())
    of = Counter(r.source for r in rows)
    inside = Counter((r.source, r.shard) for r in rows)
    for source, n in of.items():
        for s in range(shards):
            assert abs(inside[source, s] - n / shards) <= 1 + (len(of) + 1) * n / total


@pytest.mark.parametrize("shards", [1, 7, 24])
def test_every_shard_matches_the_mixture(spark, shards):
    # One source holds a third of the rows, one text too.
    rows = [(i, "copy" if i % 3 == 1 else f"text {i}", "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = sharding.interleave(df, shards).collect()
    check(found, shards)
    again = sharding.interleave(df.repartition(3), shards).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    other = sharding.interleave(df, shards, seed="another").collect()
    assert shards == 1 or sorted(map(tuple, found)) != sorted(map(tuple, other))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = sharding.interleave(docs, 5).collect()
    check(found, 5)
    want = Counter((r.doc_id, r.source, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.source, r["size"], r.text_crc32) for r in found) == want
    assert sharding.interleave(docs.limit(0)).collect() == []
    few = sharding.interleave(docs, 40).collect()
    assert len({(r.shard, r.slot) for r in few}) == len(few) == docs.count() and {r.slot for r in few} == {0}
    with pytest.raises(ValueError):
        sharding.interleave(docs, 0)


def test_rows_without_a_key_are_split(spark):
    rows = [(None, "same", "a")] * 500 + [(None, None, None)] * 100
    found = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), 6).collect()
    check(found, 6)


def test_written_shards_keep_rows_and_order(spark, tmp_path):
    docs = odd_documents(spark)
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(str, back.select("_row.*").collect())) == Counter(map(str, docs.collect()))
    for s in range(4):
        slots = [r.slot for r in spark.read.parquet(str(tmp_path / "out" / f"shard={s}")).coalesce(1).collect()]
        assert sorted(slots) == list(range(len(slots)))
