"""Near duplicates, passages and repeated strings against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from small import odd_documents, prose

from tidewatch.llm import components, jaccard_join, substring_dedup, suffix_dedup
from tidewatch.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(texts: dict, k: int, percent: int) -> dict:
    sets, holders = {}, defaultdict(list)
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
        for g in sets[d]:
            holders[g].append(d)
    parent = {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    common = defaultdict(int)
    for ds in holders.values():
        for pair in itertools.combinations(sorted(ds), 2):
            common[pair] += 1
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in texts}


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}


def test_components_of_the_query(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_jaccard_join"](spark, SF_DIR).collect()}
    assert got == brute_components(documents, 4, 85)


def near_copies(seed: int) -> dict:
    """A chain and a cloud of edited copies, which no single leader links all of, and short texts."""
    draw = random.Random(seed)
    out, base = {}, prose(160, seed).split()
    for i in range(60):
        words = list(base)
        for _ in range(draw.randint(0, 5)):
            words[draw.randrange(len(words))] = f"edit{draw.randint(0, 99)}"
        out[i] = " ".join(words)
    words = prose(120, seed + 1).split()
    for i in range(100, 130):
        words[draw.randrange(len(words))] = f"step{i}"
        out[i] = " ".join(words)
    for i in range(200, 260):
        out[i] = " ".join(draw.choices("a b c d".split(), k=draw.randint(1, 9)))
    return out


@pytest.mark.parametrize("turns", [1, 8])
def test_clouds_and_chains(spark, monkeypatch, turns):
    monkeypatch.setattr(jaccard_join, "TURNS", turns)
    texts = near_copies(3)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_components(df, k=5, percent=80).collect()}
    assert got == brute_components(texts, 5, 80)


def test_join_edges(spark):
    df = odd_documents(spark)
    got = jaccard_join.linked_components(df).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_shingles, r.component_id))
    assert len(got) == 13
    assert by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)]
    assert [c for _, c in by[4] + by[5]] == [4, 4, 4]
    assert sorted(c or 0 for _, c in by[None]) == [0, 4]
    assert by[8] == [(1, 8)] and by[9] == [(1, 8)]
    stay = jaccard_join.without_copies(df)
    assert stay.columns == df.columns
    assert sorted(r.doc_id or 0 for r in stay.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 10]
    assert jaccard_join.linked_components(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(300, 299), (299, 298), (7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 160)}, **{i: 298 for i in (298, 299, 300)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_windows_are_those_of_the_cartesian_tree():
    draw = np.random.default_rng(1)
    for n in (5, 12, 13, 60, 200):
        values = mixed = draw.integers(0, 2**62, n).astype(np.uint64)
        centre, begin, end = substring_dedup.compact_windows(values, 12)
        want = []
        for c in range(n):
            left, right = c, c
            while left > 0 and mixed[left - 1] > mixed[c]:
                left -= 1
            while right < n - 1 and mixed[right + 1] > mixed[c]:
                right += 1
            if right - left + 1 >= 12:
                want.append((c, left, right))
        assert list(zip(centre.tolist(), begin.tolist(), end.tolist(), strict=True)) == want


def test_equal_runs_share_signatures():
    draw = np.random.default_rng(2)
    seeds = np.arange(3, dtype=np.uint64)
    run = draw.integers(0, 2**62, 50).astype(np.uint64)
    a = np.concatenate([draw.integers(0, 2**62, 30).astype(np.uint64), run, draw.integers(0, 2**62, 40).astype(np.uint64)])
    b = np.concatenate([draw.integers(0, 2**62, 90).astype(np.uint64), run])
    one, two = substring_dedup.signatures(a, 40, seeds), substring_dedup.signatures(b, 40, seeds)
    assert len(np.intersect1d(one, two)) and not len(np.intersect1d(one, substring_dedup.signatures(b[:80], 40, seeds)))


def test_passages_of_the_query(spark, documents):
    """Every exact repeat of 51 words is found, and every row is similar enough."""
    got = QUERIES["op5_substring_dedup"](spark, SF_DIR).collect()
    words = {d: WORD.findall(t or "") for d, t in documents.items()}
    first, want, covered = {}, defaultdict(set), defaultdict(set)
    for d in sorted(words):
        for i in range(len(words[d]) - 50):
            o = first.setdefault(tuple(words[d][i : i + 51]), d)
            if o != d:
                want[d].update(range(i, i + 51))
    for r in got:
        assert r.other_id < r.doc_id and r.n_words >= 50
        covered[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
        one, two = (
            {tuple(words[d][i : i + 5]) for i in range(at, at + n - 4)}
            for d, at, n in ((r.doc_id, r.first_word, r.n_words), (r.other_id, r.other_first_word, r.other_n_words))
        )
        assert abs(len(one & two) / len(one | two) - r.similarity) < 1e-9 and r.similarity >= 0.8
    assert set(want) <= set(covered)
    assert sum(len(want[d] & covered[d]) for d in want) >= 0.999 * sum(map(len, want.values()))


def test_passage_edges(spark):
    df = odd_documents(spark)
    found = substring_dedup.repeated_passages(df)
    got = {(r.doc_id, r.other_id): r for r in found.collect()}
    assert set(got) == {(5, 4), (7, 6)}
    r = got[7, 6]
    assert (r.first_word, r.n_words, r.other_first_word) == (50, 70, 90)
    cut = substring_dedup.without_passages(df, found)
    assert cut.columns == df.columns and cut.count() == 13
    texts = defaultdict(list)
    for row in cut.collect():
        texts[row.doc_id].append(row.text)
    assert texts[7] == [prose(50, 5) + "\n"] and texts[5] == ["", ""] and texts[1] == [None]
    assert len(texts[4][0]) > 100_000 and texts[6][0].endswith(prose(20, 4))
    assert substring_dedup.repeated_passages(df.limit(0)).count() == 0


def test_passages_with_a_line_that_comes_earlier_too():
    """An exact run counts wherever its shingles also come, at its ends or beside it."""
    fresh = lambda n, draw=np.random.default_rng(5): draw.integers(0, 2**62, n).astype(np.uint64)
    run = fresh(46)
    for line in (run[:12], run[-12:], run[:30], run[-30:]):
        x, y = np.concatenate([fresh(9), run, fresh(20)]), np.concatenate([line, fresh(88), run, fresh(5), line])
        assert [r[:2] for r in substring_dedup.passages(x, y, 46, 80)] == [(9, 55)]
    beside = fresh(30)
    x, y = np.concatenate([fresh(9), run, beside, fresh(9)]), np.concatenate([beside, fresh(88), run, fresh(5)])
    assert substring_dedup.passages(x, y, 46, 80) == [(9, 55, 118, 164, 46, 46)]
    draw = np.random.default_rng(6)
    for _ in range(200):  # few different shingles, so that most come often
        pool = [fresh(int(n)) for n in draw.integers(3, 30, 6)]
        x, y = (np.concatenate([pool[i] for i in draw.integers(0, 6, 14)]) for _ in "xy")
        want = {tuple(y[i : i + 46]) for i in range(len(y) - 45)}
        covered = {i for b, e, *_ in substring_dedup.passages(x, y, 46, 80) for i in range(b, e)}
        assert all(set(range(i, i + 46)) <= covered for i in range(len(x) - 45) if tuple(x[i : i + 46]) in want)


def test_exact_passages_whose_lines_earlier_documents_hold_alone(spark):
    """The first document of every signature has one line only; the passage is in later ones."""
    rows = []
    for n in range(30):
        lines = [prose(26, 7000 + 10 * n + i) for i in range(2)]
        for i in range(12):
            rows.append((100 * n + i, prose(40, 9000 + 100 * n + i) + " " + lines[i % 2] + " " + prose(40, 9050 + 100 * n + i)))
        for i in (50, 51):
            rows.append((100 * n + i, prose(30, 8000 + 100 * n + i) + " " + " ".join(lines) + " " + prose(30, 8060 + 100 * n + i)))
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id, r.first_word, r.n_words, r.other_first_word) for r in found} == {(100 * n + 51, 100 * n + 50, 30, 52, 30) for n in range(30)}


def test_edited_passages_whose_lines_earlier_documents_hold_alone(spark):
    """As above with one word changed: the later holder of a line that has the passage is compared too."""
    rows = []
    for n in range(150):
        lines = [prose(26, 170_000 + 10 * n + i) for i in range(2)]
        for i in range(12):
            rows.append((100 * n + i, prose(40, 190_000 + 100 * n + i) + " " + lines[i % 2] + " " + prose(40, 190_050 + 100 * n + i)))
        edited = " ".join(lines).split()
        edited[5 + n % 42] = f"edit{n}"
        for i, words in enumerate((" ".join(lines), " ".join(edited))):
            rows.append((100 * n + 50 + i, " ".join([prose(30, 180_000 + 100 * n + i), words, prose(30, 180_060 + 100 * n + i)])))
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.other_id) for r in found}
    assert got <= {(100 * n + 51, 100 * n + 50) for n in range(150)} and len(got) >= 148


def test_rarest_shingles_of_similar_runs_meet():
    draw = np.random.default_rng(5)
    for _ in range(300):
        x = draw.integers(1, 1 << 62, 60)
        x[draw.integers(0, 60, 2)] = x[draw.integers(0, 60, 2)]  # some have a shingle twice
        y = x.copy()
        y[draw.choice(60, draw.integers(0, 9), replace=False)] = draw.integers(1, 1 << 62)
        counts = {g: int(draw.integers(1, 9)) for g in np.append(x, y).tolist()}
        runs, places = substring_dedup.rarest(x, np.array([counts[g] for g in x.tolist()]), 46, 80)
        for i in range(15):
            picked = set(x[places[runs == i]].tolist())
            assert len(picked) >= 10
            for j in range(15):
                one, two = set(x[i : i + 46].tolist()), set(y[j : j + 46].tolist())
                if 100 * len(one & two) >= 80 * len(one | two):
                    assert picked & two


def test_runs_of_few_shingles_are_asked_by_few():
    """A run whose shingles come again and again may lack a fifth of its set, not of its length."""
    draw = np.random.default_rng(6)
    for size in (5, 14, 30):
        pool = draw.integers(1, 1 << 62, size)
        x = np.append(pool, draw.choice(pool, 70))
        runs, places = substring_dedup.rarest(x, x % 9, 46, 80)
        for i in range(len(x) - 45):
            one, picked = set(x[i : i + 46].tolist()), set(x[places[runs == i]].tolist())
            lacking = len(one) - -(-80 * len(one) // 100)
            assert lacking < len(picked) <= lacking + 2


def test_open_runs_by_brute_force():
    draw = np.random.default_rng(7)
    for _ in range(50):
        places, sizes = draw.integers(0, 60, 6), draw.integers(1, 20, 6)
        of, begin = np.sort(draw.integers(0, 6, 9)), draw.integers(0, 60, 9)
        end = begin + draw.integers(1, 40, 9)
        got = substring_dedup.open_runs(places, sizes, of, begin, end, 12, 80)
        want = [
            all(100 * (min(e, p + i + 12) - max(b, p + i)) < 80 * 12 for o, b, e in zip(of, begin, end, strict=True) if o == row)
            for row, (p, n) in enumerate(zip(places, sizes, strict=True))
            for i in range(n)
        ]
        assert got.tolist() == want


def test_repeated_lines_make_no_pairs_of_their_documents(spark, monkeypatch):
    """Thirty documents share a line and repeat lines of their own: their runs have few shingles, most of them their own."""
    tried, similar = [], substring_dedup._similar
    monkeypatch.setattr(substring_dedup, "_similar", lambda both, *rest: tried.append(both.count()) or similar(both, *rest))
    line = prose(13, 400_000)
    rows = [(i, " ".join([prose(30, 400_100 + i), *[f"{line} {prose(12, 400_500 + i)}"] * 6])) for i in range(30)]
    assert not substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(tried) <= 30


def test_similar_runs_by_brute_force():
    draw = np.random.default_rng(3)
    many = lambda parts: (np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts])))
    for _ in range(30):
        xs, ys, opened, want = [], [], [], set()
        for i in range(5):
            pool = draw.integers(1, 1 << 62, draw.integers(12, 90)).astype(np.uint64)
            x = np.sort(draw.choice(pool, 20)) if i % 2 else draw.integers(1, 1 << 62, 20).astype(np.uint64)  # some have shingles twice
            y = x.copy()
            y[draw.choice(20, draw.integers(0, 6), replace=False)] = 0
            y = np.insert(y, draw.integers(0, 20), draw.integers(1, 1 << 62, draw.integers(0, 4)).astype(np.uint64))
            xs, ys, opened = [*xs, x], [*ys, y], [*opened, draw.integers(0, 4, 9) > 0]
            others = [set(y[b:e].tolist()) for b in range(len(y)) for e in range(b + 1, len(y) + 1)]
            for run in np.flatnonzero(opened[-1]).tolist():
                one = set(x[run : run + 12].tolist())
                if any(100 * len(one & two) >= 80 * len(one | two) for two in others):
                    want.add((i, run))
        rows, runs, _, similar = substring_dedup.similar_runs(many(xs), many(opened), many(ys), 12, 80)
        assert set(zip(rows[similar].tolist(), runs[similar].tolist(), strict=True)) == want


def test_common_lines_make_no_pairs_of_later_holders(spark, monkeypatch):
    """Forty documents share a line shorter than a passage and nothing else: each meets few others on whole texts."""
    met, compared = [], substring_dedup._compared
    monkeypatch.setattr(substring_dedup, "_compared", lambda fed, pairs, *rest: met.append(pairs.count()) or compared(fed, pairs, *rest))
    rows = [(i, " ".join([prose(40, 310_000 + i), prose(42, 300_000), prose(40, 310_050 + i)])) for i in range(40)]
    assert not substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(met) <= 4 * 40


def brute_similar(one: list, two: list) -> float:
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (one, two))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("edits", [1, 2])
def test_recall_of_edited_passages_of_fifty_words(spark, edits):
    """Of passages of 50 words that brute force finds similar enough, 97 % and more are found."""
    draw = random.Random(20 + edits)
    rows, want = [], {}
    while len(want) < 300:
        n = len(want)
        passage = prose(50, 20_000 + n).split()
        edited = list(passage)
        for at in draw.sample(range(1, 49), edits):
            edited[at] = f"edit{n}"
        if brute_similar(passage, edited) >= 0.8:
            want[2 * n + 1] = 2 * n
            for i, words in enumerate((passage, edited)):
                rows.append((2 * n + i, " ".join([prose(30 + 20 * i, 40_000 + 2 * n + i), *words, prose(40, 60_000 + 2 * n + i)])))
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = {d: t.split() for d, t in rows}
    for r in got:
        one, two = texts[r.doc_id][r.first_word :][: r.n_words], texts[r.other_id][r.other_first_word :][: r.other_n_words]
        assert abs(brute_similar(one, two) - r.similarity) < 1e-9 and r.similarity >= 0.8
    found = len({r.doc_id for r in got if want.get(r.doc_id) == r.other_id})
    print(f"recall with {edits} edits: {found}/{len(want)}")
    assert found >= 0.97 * len(want)


def test_loser_tree():
    draw = random.Random(4)
    for trial in range(60):
        runs = []
        for _ in range(draw.randint(1, 9)):
            some = sorted(bytes(draw.choices(b"ab", k=12)) for _ in range(draw.randint(0, 20)))
            lcps = [0] + [len([0 for j in range(1, 13) if x[:j] == y[:j]]) for x, y in itertools.pairwise(some)]
            runs.append((some, lcps[: len(some)]))
        order, common = suffix_dedup.merge_runs(runs)
        merged = [runs[r][0][i] for r, i in order]
        assert merged == sorted(x for s, _ in runs for x in s)
        assert common[1:] == [len([0 for j in range(1, 13) if x[:j] == y[:j]]) for x, y in itertools.pairwise(merged)]


def brute_repeats(rows: list, length: int = 200) -> list:
    datas = [(t or "").encode() for t in rows]
    seen, twice = set(), set()
    for b in datas:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            (twice if s in seen else seen).add(s)
    out = []
    for b in datas:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in twice:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("frequent", "a_range", "batch"), [(20_000, 50_000, 1 << 20), (3, 20, 1 << 20), (20_000, 30, 700)])
def test_repeated_strings(spark, monkeypatch, frequent, a_range, batch):
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "ITEMS_A_RANGE", a_range)
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    draw = random.Random(6)
    passages = [prose(n, 50 + n) for n in (20, 30, 31, 32, 33, 34, 60, 150)]
    rows = [None, "", "x" * 199, "x" * 200, "y" * 450, "é" * 99, "é" * 150, "ab" * 400, "\0" * 300, passages[7], passages[7]]
    for i in range(60):
        rows.append(" ".join(x for j in range(3) for x in (prose(draw.randint(0, 40), 1000 + 3 * i + j), draw.choice(passages))))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df.repartition(5)).collect()
    mine = [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in sorted(got, key=lambda r: r.doc_id)]
    assert mine == brute_repeats(rows)


@pytest.mark.parametrize("length", [255, 256, 300, 520])
def test_repeated_strings_of_other_lengths(spark, length):
    draw = random.Random(length)
    passages = [prose(n, 70 + n) for n in (60, 80, 81, 150, 250)]
    rows = ["x" * length, "y" * (2 * length), passages[-1], passages[-1]]
    for i in range(30):
        rows.append(" ".join(x for j in range(2) for x in (prose(draw.randint(0, 60), 3000 + 2 * i + j), draw.choice(passages))))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df.repartition(3), length=length).collect()
    mine = [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in sorted(got, key=lambda r: r.doc_id)]
    assert mine == brute_repeats(rows, length)


def test_repeats_of_the_query(spark, documents):
    keys = sorted(documents)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op8_suffix_dedup"](spark, SF_DIR).collect()}
    assert [got[d] for d in keys] == brute_repeats([documents[d] for d in keys])


def test_repeat_edges(spark):
    df = odd_documents(spark)
    got = suffix_dedup.remove_repeats(df)
    assert got.columns == [c for c in df.columns if c != "kept"] + ["n_bytes", "n_removed", "n_spans", "kept"]
    assert got.count() == 13 and suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def _parity_pairs(spark, percent, pairs):
    rows = [(i, len(x), jaccard_join._odd(x, percent), len(y), jaccard_join._odd(y, percent)) for i, (x, y) in enumerate(pairs)]
    both = spark.createDataFrame(rows, "i int, n int, odd array<bigint>, m int, other array<bigint>")
    sides = both.select("i", F.struct("n", "odd").alias("x"), F.struct(F.col("m").alias("n"), F.col("other").alias("odd")).alias("y"))
    return {r["i"] for r in sides.where(jaccard_join._near(percent, "x", "y")).collect()}


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_parities_of_long_sets(spark, percent):
    random = np.random.default_rng(5)
    number = lambda n: np.unique(random.integers(1, 1 << 63, n).astype(np.uint64))
    linked, unlike = [], []
    for n in (1, 7, 60, 500, 1500, 1580, 5000, 20_000):
        one = number(n)
        linked += [(one, one), (one, one[: -(-percent * n // 100)]), (one[n - -(-percent * n // 100) :], one)]
        if n >= 500:
            unlike.append((one, np.union1d(one[: n // 10], number(n - n // 10))))
    assert len(_parity_pairs(spark, percent, linked)) == len(linked)
    assert not _parity_pairs(spark, percent, unlike)


def test_postings_are_not_repeated(spark, monkeypatch):
    texts = [f"{prose(300, 3)} {prose(12, 90 + i)}" for i in range(4)]
    df = spark.createDataFrame([(i, texts[i % 4]) for i in range(64)], "doc_id long, text string").repartition(16)
    seen, kept = [], jaccard_join.materialise
    monkeypatch.setattr(jaccard_join, "materialise", lambda made: seen.append(kept(made)) or seen[-1])
    found = jaccard_join.linked_components(df)
    assert {r["component_id"] for r in found.collect()} == {0}
    postings = next(made for made in seen if {"token", "at"} <= set(made.columns))
    assert postings.count() == postings.distinct().count() > 0
