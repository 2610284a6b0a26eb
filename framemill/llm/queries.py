"""The registered queries of this subpackage and the SQL that expects the same rows."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, language_id, mixing, quality_rules, substring_dedup, suffix_dedup, token_files, topk, warc
from .shared import ship

#: Words of the contract in DuckDB's regular expressions.
SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).drop("source")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.cascade(_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(_docs(spark, sf_dir).select("doc_id", "text"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).filter("main IS NOT NULL").select("main.*")
    return main.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.checksums(token_files.round_trip(_docs(spark, sf_dir), tokenizer("byte_bpe_50k.json")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_docs(spark, sf_dir).select("doc_id", "text"), tokenizer("word_bpe_49k.json"), digests=True)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = language_id.learn(docs.select("doc_id", "text", "lang"))
    return language_id.predict(docs.select("doc_id", "text", language_id.held_out(F.col("doc_id")).alias("held_out")), *model)


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({SQL_WORDS}) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM d GROUP BY source),
s1 AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][src % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS lim FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY lim / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, (SELECT level FROM s2 x WHERE x.level * x.weight <= x.lim ORDER BY x.lim / x.weight, x.src LIMIT 1) AS lam FROM s2),
s4 AS (SELECT source, source_size, src, least(lim, coalesce(lam * weight, lim)) AS target FROM s3),
s5 AS (SELECT *, floor(target)::BIGINT AS goal, ceil(source_size / 256)::BIGINT AS blocks, floor(floor(target) / source_size)::BIGINT AS rounds FROM s4 WHERE target >= 1),
s6 AS (SELECT *, rounds * blocks + ceil((goal - rounds * source_size) / 256)::BIGINT AS need FROM s5),
s7 AS (SELECT *, sum(need) OVER (ORDER BY src)::BIGINT AS high, sum(need) OVER ()::BIGINT AS everything FROM s6),
s8 AS (SELECT *, floor(high / everything * 4294967296)::BIGINT AS hi, floor((high - need) / everything * 4294967296)::BIGINT AS lo FROM s7),
slots AS (SELECT range AS slot, ((range % 2147483648) * 2654435769) % 4294967296 AS point FROM range((SELECT coalesce(max(everything), 0) FROM s8))),
dealt AS (SELECT slot, src FROM slots JOIN s8 ON point >= lo AND point < hi),
ranked AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS k FROM dealt),
have AS (SELECT src, count(*) AS n FROM ranked GROUP BY src),
allk AS (SELECT src, k FROM ranked UNION ALL SELECT src, unnest(range(coalesce(n, 0), need)) AS k FROM s8 LEFT JOIN have USING (src)),
placed AS (SELECT d.*, s.src, s.source_size, s.target, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM d JOIN s4 s ON d.source IS NOT DISTINCT FROM s.source),
pl AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, row_number() OVER () AS rid FROM placed),
cut AS (SELECT src, k % blocks AS block, least(256, source_size - (k % blocks) * 256, goal - ((k // blocks) * source_size + (k % blocks) * 256)) AS take FROM allk JOIN s8 USING (src)),
touched AS (SELECT rid, src, start, size, unnest(range(start // 256, (start + size - 1) // 256 + 1)) AS block FROM pl WHERE size > 0),
took AS (SELECT rid, sum(greatest(0, least(start + size, block * 256 + take) - greatest(start, block * 256))) AS taken FROM touched JOIN cut USING (src, block) WHERE take > 0 GROUP BY rid)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM pl LEFT JOIN took USING (rid)
"""

OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP5_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_transform({SQL_WORDS}, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (SELECT doc_id, rid, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM d),
n AS (SELECT doc_id, rid, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
t AS (SELECT rid, unnest(s) AS g FROM s),
o AS (SELECT x.rid AS a, y.rid AS b, count(*) AS shared FROM t x JOIN t y ON x.g = y.g AND x.rid < y.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * shared >= 85 * (x.n_shingles + y.n_shingles - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT rid, rid FROM n),
p AS MATERIALIZED (WITH RECURSIVE r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT * FROM r)
SELECT x.doc_id, x.n_shingles, min(y.doc_id) AS component_id FROM p JOIN n x ON x.rid = p.a JOIN n y ON y.rid = p.b GROUP BY x.rid, x.doc_id, x.n_shingles
"""

OP7_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM g),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN c USING (rid)),
v AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
    OR n_symbols * 4 > n_words OR n_dup_lines * 3 > n_lines OR word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 15
    OR (len(regexp_extract_all(text, '!+[\x20\x09-\x0D]')) + 1) * 4 > n_words
    OR length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) * 2 > word_chars) AS kept
FROM v
"""

def _shipped(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (op1_mixing, op2_topk, op3_substring_dedup, op4_suffix_dedup, op5_jaccard, op6_warc, op7_quality_rules, op8_token_files, op9_bpe, op10_language_id)}
ORACLES = {"op1_mixing": OP1_SQL, "op2_topk": OP2_SQL, "op5_jaccard": OP5_SQL, "op7_quality_rules": OP7_SQL}
