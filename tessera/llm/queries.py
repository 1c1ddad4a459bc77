"""The registered queries of the corpus operators, and their SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import counts, exact, jaccard, langid, mixing, pii, quality, spm, substring, warc
from tessera.llm.common import table

_WORD = r"[^\x20\x09-\x0D]+"


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target, and the words that the mix takes of it."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equals."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base measures and the rules' verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_measures(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op1_mix": op1_mix, "op8_exact_dedup": op8_exact_dedup, "op10_quality": op10_quality}

_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

SQL = {
    "op1_mix": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, 1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k FROM r),
p AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(weight) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS free, sum(source_size) OVER () AS total FROM o),
l AS (SELECT min_by((CAST(total AS DOUBLE) - CAST(held AS DOUBLE)) / CAST(free AS DOUBLE), k) AS level FROM p
      WHERE 3 * source_size >= weight * ((CAST(total AS DOUBLE) - CAST(held AS DOUBLE)) / CAST(free AS DOUBLE))),
t AS (SELECT source, source_size, least(weight * level, CAST(3 * source_size AS DOUBLE)) AS target FROM r, l),
x AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
             CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
""",
    "op8_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
             row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) AS rn FROM d)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM g
""",
    "op10_quality": rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '[^!?]+', '', 'g')) AS marks,
             length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS uppers,
             len(list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}]+'), lambda x: x IN ({_STOP}))) AS stops
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND word_chars / greatest(n_words, 1) BETWEEN 1.5 AND 15 AND n_symbols / greatest(n_words, 1) <= 0.1 AND marks / greatest(n_words, 1) <= 0.5
       AND uppers / greatest(word_chars, 1) <= 0.4 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND stops / greatest(n_words, 1) >= 0.01 AS kept
FROM m
""",
}


def op3_spm_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, their number, and whether they decode to the text again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spm.encode(docs, check=True).select("doc_id", "n_tokens", "token_ids", "round_trip")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, without the tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counts.token_counts(docs).select("doc_id", "n_tokens")


QUERIES |= {"op3_spm_encode": op3_spm_encode, "op6_warc": op6_warc, "op7_token_counts": op7_token_counts}

SQL["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the other three quarters of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = langid.learn(docs.filter(~held))
    return langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES |= {"op9_langid": op9_langid}


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, removed words, and a hash of those that stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = substring.remove_repeats(docs)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES |= {"op5_substring_dedup": op5_substring_dedup}

SQL["op5_substring_dedup"] = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 19), ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM g) WHERE rn > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM r),
x AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.pos) AS kept, count(*) AS n FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.pos = c.pos GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and the smallest document that links reach."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_groups(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


QUERIES |= {"op4_ngram_join": op4_ngram_join}

SQL["op4_ngram_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(list_slice(words, i, i + 4), ' ')))) AS shingles FROM w WHERE len(words) > 0),
c AS (SELECT min(doc_id) AS c, shingles, len(shingles) AS n FROM s GROUP BY shingles),
x AS (SELECT c, n, unnest(shingles) AS shingle FROM c),
l AS (SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT c AS node, c AS seen FROM c UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.component, w.doc_id) AS component_id
FROM w LEFT JOIN s ON w.doc_id = s.doc_id LEFT JOIN c ON s.shingles = c.shingles LEFT JOIN m ON c.c = m.node
"""


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base spans by number and hash, and all spans."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), redact=False)
    number = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("pii_spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",").alias("spans")
    return found.select("doc_id", *[number(k) for k in pii.BASE], "base_sha256", spans, F.size("pii_spans").cast("long").alias("n_spans"))


QUERIES |= {"op2_pii": op2_pii}
