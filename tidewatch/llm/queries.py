"""The registered queries of this subpackage, one per operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, html_extract, jaccard_join, mixing, mtree, periodic_runs, quality_rules, sentencepiece_bpe, sharding, substring_dedup, suffix_dedup, token_counts, warc
from .registry import ORACLES, QUERIES, query, table
from .words import bind, words

__all__ = ["QUERIES", "ORACLES"]


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_bpe.round_trip(documents, model)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op2_warc")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark), min_bytes=0)
    records = warc.read_archives(spark, manifest)
    return records.select(
        warc.key_of("record_id").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.key_of("refers_to").cast("bigint").alias("refers_to"),
    )


@query("op3_mtree_search")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


# Per document, words that lie in a repeated three-word window, then the exact binomial
# tail per language, rule and cut-off.
OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce('+' || lang, '-') AS stratum FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
p AS (SELECT rid, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS s(o) GROUP BY rid),
c AS (SELECT d.rid, doc_id, stratum, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN p USING (rid)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
rules(rule, ord, above, cutoff) AS (VALUES __RULES__),
v AS (SELECT rid, doc_id, stratum, base_failed, rule, ord, above, cutoff,
             CASE rule WHEN 'symbols' THEN n_symbols / nullif(n_words, 0) WHEN 'dup_lines' THEN n_dup_lines / nullif(n_lines, 0)
                       WHEN 'repeats' THEN n_repeat_words / nullif(n_words, 0) ELSE word_chars / nullif(n_words, 0) END AS x FROM j, rules),
b AS (SELECT *, coalesce(CASE WHEN above THEN x > cutoff ELSE x < cutoff END, false) AS broken FROM v),
l AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT stratum, rule, ord, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND broken) AS k, count(*) FILTER (NOT good AND broken) AS caught
      FROM b JOIN l USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
t AS (SELECT *, CASE WHEN k > n * 0.005 THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda i: exp(
             lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(0.005) + (n - i) * ln(0.995)))) END AS tail FROM k),
h AS (SELECT *, bool_and(tail <= 0.05 / (5 * (SELECT count(DISTINCT stratum) FROM k))) OVER (PARTITION BY stratum, rule ORDER BY ord) AS holds FROM t),
u AS (SELECT stratum, rule, cutoff FROM h WHERE holds AND caught > k QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY caught DESC, k, ord) = 1),
x AS (SELECT DISTINCT rid FROM b JOIN u USING (stratum, rule, cutoff) WHERE broken)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND x.rid IS NULL AS kept
FROM j LEFT JOIN x USING (rid)
""".replace(
    "__RULES__",
    ", ".join(f"('{r.name}', {i}, {str(r.above).lower()}, {c}::DOUBLE)" for r in quality_rules.RULES for i, c in enumerate(r.cutoffs)),
)


@query("op4_quality_rules", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS hash, coalesce('0' || source, '1') AS queue FROM documents),
s AS (SELECT queue, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY queue) - 1) % 3 + 1] AS weight FROM d GROUP BY queue),
a AS (SELECT *, 2 * source_size AS cap, 2 * source_size / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(weight) OVER () AS weights,
             sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, queue) - 2 * source_size AS caps_before,
             sum(weight) OVER (ORDER BY 2 * source_size / weight, queue) - weight AS weights_before FROM s),
v AS (SELECT *, (budget - caps_before::DOUBLE) / (weights - weights_before)::DOUBLE AS level FROM a),
f AS (SELECT min_by(level, struct_pack(r := ratio, q := queue)) AS level FROM v WHERE level * weight <= cap),
t AS (SELECT queue, source_size, budget, least(cap::DOUBLE, f.level * weight) AS target FROM v, f),
q AS (SELECT d.*, source_size, target, budget, sum(size) OVER (PARTITION BY queue ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t USING (queue)),
e AS (SELECT q.*, r, (upto + r * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) AS x(r) WHERE size > 0 AND target > 0),
m AS (SELECT *, sum(size) OVER (ORDER BY finish, queue, hash, doc_id, size, r ROWS UNBOUNDED PRECEDING) <= budget AS taken FROM e),
n AS (SELECT doc_id, queue, size, hash, upto, count(*) AS n FROM m WHERE taken GROUP BY ALL)
SELECT doc_id, q.size, source_size, target, (q.size * coalesce(n.n, 0))::BIGINT AS taken
FROM q LEFT JOIN n USING (doc_id, queue, size, hash, upto)
"""


@query("op6_source_mix", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op7_html_extract")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # The labelled pages are those whose article is marked up; a bounded sample of them fits the weights.
    weights = html_extract.fit_weights(pages)
    found = html_extract.main_text(pages.select("page_id", "url", "html"), weights)
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleared = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleared.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(documents, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 1024).alias("over_limit"),
    )


@query("op10_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, sf_dir, "documents"), k=4, percent=85)


# The checksum table by recursion; then all pairs of equal words of a text give, distance by
# distance, the stretches that repeat, less those that a smaller distance has too.
OP11_SQL = """
WITH RECURSIVE bits(i, step, c) AS (SELECT i::UBIGINT, 0, i::UBIGINT FROM range(256) t(i) UNION ALL
  SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE step < 8),
crcs AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE step = 8),
b AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, tab,
             list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)) AS bytes FROM documents, crcs),
h AS (SELECT rid, doc_id, ws, len(ws)::BIGINT AS n,
             xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS h FROM b),
g AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM h),
d AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE ws END AS ws FROM g),
w AS (SELECT rid, unnest(ws) AS w, unnest(range(0, n)) AS i FROM d),
e AS (SELECT x.rid, x.i, x.i - y.i AS q FROM w x JOIN w y ON x.rid = y.rid AND x.w = y.w AND y.i < x.i),
k AS (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM e),
s AS (SELECT rid, q, min(i) - q AS start, count(*) + q AS length FROM k GROUP BY rid, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.rid = s.rid AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
x AS (SELECT DISTINCT rid, i FROM (SELECT rid, unnest(range(start + q, start + length)) AS i FROM r)),
c AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS kept FROM w ANTI JOIN x USING (rid, i) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS list FROM r GROUP BY rid),
m AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length / q DESC, start, q) = 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, q::BIGINT AS period, (1000 * length // q)::BIGINT AS exponent_milli,
       sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN l USING (rid) LEFT JOIN m USING (rid) LEFT JOIN c USING (rid)
"""


def _planted(doc_id: str, text: str):
    """The text, in which one document in ten goes on with a period after some word, as the query's contract says."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewritten(ws):
        n = F.size(ws).cast("long")
        a = F.when(n > 0, g % n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(ws, place(i).cast("int"))), " ")

    chosen = (h % 10 == 0) & F.col(text).rlike(r"[^\x20\x09-\x0D]")
    return F.when(chosen, bind(words(F.col(text)), rewritten)).otherwise(F.col(text))


@query("op11_periodic_runs", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", _planted("doc_id", "text").alias("text"))
    found = periodic_runs.collapsed(documents)
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    best = found.withColumn("best", periodic_runs.strongest(F.col("runs")))
    return best.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


OP12_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                          '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) AS t(m))),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
s AS (SELECT lang, m, a, string_split(phrase, ' ') AS ws, phrase FROM f),
c AS (SELECT s.lang, s.phrase, s.a, k, x.a AS l, y.a AS r, n, 1000 * s.a * n // (x.a * y.a) AS score
      FROM (SELECT *, unnest(range(1, m)) AS k FROM s) s JOIN n USING (lang)
      JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(s.ws[:k], ' ') JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(s.ws[k + 1:], ' ')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT s.lang, array_to_string(s.ws[i : i + j - 1], ' ') AS phrase, s.a FROM s, range(2, 5) AS t(j), range(1, 5) AS u(i) WHERE j < m AND i + j - 1 <= m),
kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 100 * b.a))
SELECT lang, rank::INTEGER AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""


@query("op12_collocations", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


# The checksum goes byte by byte through its table, which the recursion makes.
OP13_SQL = """
WITH RECURSIVE bits(i, step, c) AS (SELECT i::UBIGINT, 0, i::UBIGINT FROM range(256) t(i) UNION ALL
  SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE step < 8),
crcs AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE step = 8),
d AS (SELECT doc_id, coalesce('0' || source, '1') AS queue, md5('shard:' || coalesce(doc_id::VARCHAR, '')) AS hash, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, queue, hash, strlen(h) // 2 + 8 AS size, tab, list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(h, '..'),
             lambda x: (instr('123456789ABCDEF', x[1]) * 16 + instr('123456789ABCDEF', x[2]))::UBIGINT)) AS bytes FROM d, crcs),
s AS (SELECT doc_id, queue, hash, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS crc FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY hash, doc_id, size, crc) AS r, count(*) OVER (PARTITION BY queue) AS n FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, queue, hash, doc_id, size, crc) - 1 AS place, count(*) OVER () AS total FROM r),
c AS (SELECT *, place * 24 // total AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY place) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM c
"""


@query("op13_sharding", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
