"""The corpus pipeline, stage by stage."""

import re
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from test_duplicates import brute_components

from tidewatch.session import materialise

SF_DIR = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF_DIR)))
    return out


def test_columns_and_order(steps):
    assert [df.columns for df in steps[:-1]] == [COLUMNS] * 5
    counts = [df.count() for df in steps]
    assert counts[0] > counts[1] > counts[2] == counts[3] < counts[4] == counts[5]


def test_good_documents_stay(spark, steps):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    kept = {r.doc_id for r in steps[1].collect()}
    good = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1").join(steps[0], "doc_id").collect()
    long = [r.doc_id for r in good if len(words(r.text)) >= 60]
    assert sum(d in kept for d in long) >= 0.97 * len(long)


def test_one_of_each_group_stays(steps):
    before = {r.doc_id: r.text for r in steps[1].collect()}
    found = brute_components(before, 5, 80)
    assert {r.doc_id for r in steps[2].collect()} == {d for d, (_, c) in found.items() if d == c}


def test_no_long_passage_is_left_twice(steps):
    first, again = {}, defaultdict(int)
    for r in steps[3].collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        for i in range(len(words) - 50):
            if first.setdefault(tuple(words[i : i + 51]), r.doc_id) != r.doc_id:
                again[r.doc_id] += 1
    assert not again


def test_mix_and_tokens(steps):
    size = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect())
    assert abs(size(steps[4]) - 1.5 * size(steps[3])) < 0.02 * size(steps[3])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    for r in steps[5].collect():
        assert r.ids == b"".join(i.to_bytes(4, "little") for i in library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True))
        assert r.round_trip and r.n_tokens == len(r.ids) // 4


def test_run_is_the_stages(spark, steps):
    got = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF_DIR).select("doc_id", "n_tokens").collect())
    assert got == sorted((r.doc_id, r.n_tokens) for r in steps[5].select("doc_id", "n_tokens").collect())
