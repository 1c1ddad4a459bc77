"""Queries over texts: functions, BM25, TF-IDF, phrases, vectors, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vectors as vc
from tessera.operators import blocks, cosines, lexical, phrases, respond, retrieve
from tessera.plans import fixtures as fx
from tessera.plans.fixtures import q, sql
from tessera.registry import query
from tessera.sources.tables import scan

_STOP = ", ".join(f"'{w}'" for w in lexical.STOP_WORDS)
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def _words(c):
    return _WORDS.format(c)


def _user_queries(spark, d):
    """Each user message of a conversation with the dialogue up to it, as a search."""
    m = scan(spark, d, "conversations")
    asked = m.filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")
    return asked


def _terms_sql(table, key, text):
    return f"SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({_words(text)}) AS term FROM {table}) WHERE term NOT IN ({_STOP}) GROUP BY ALL"


_BM25 = f"""WITH qs AS (SELECT conv_id * 100 + turn AS query_id, text FROM conversations WHERE role = 'user'), qt AS ({_terms_sql('qs', 'query_id', 'text')}), dt AS ({_terms_sql('documents', 'doc_id', 'text')}),
    dl AS (SELECT doc_id, sum(tf) AS dl FROM dt GROUP BY ALL), st AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(dl) FROM dl)::DOUBLE AS total), df AS (SELECT term, count(*) AS df FROM dt GROUP BY ALL),
    w AS (SELECT term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (total / n)))) AS weight FROM dt JOIN dl USING (doc_id) JOIN df USING (term), st),
    s AS (SELECT query_id, doc_id, {q('sum(tf * weight)', '1e7')} AS score FROM qt JOIN w USING (term) GROUP BY ALL)"""
_BEST = f"row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {{0}}) AS rank"


def _rounded(df):
    """Scores as both engines show them; ranks are over whole scores."""
    return df.withColumn("score", tx.quantised(blocks.steady(F.col("score"))))


@query(_BM25 + f" SELECT query_id, doc_id, {q('score')} AS score, {_BEST.format('doc_id')} FROM s QUALIFY rank <= 20")
def bm25_topk(spark, d):
    docs = scan(spark, d, "documents", ["doc_id", "text"])
    best = lexical.bm25_best(_user_queries(spark, d), lexical.bm25_index(docs, "doc_id", "text"), 20, "query_id", "text")
    return _rounded(best.withColumnRenamed("doc", "doc_id"))


@query(f"SELECT doc_id, term, tf FROM ({_terms_sql('documents', 'doc_id', 'text')})")
def bm25_postings(spark, d):
    return lexical.terms(scan(spark, d, "documents", ["doc_id", "text"]), "doc_id", "text")


_TERMS = tx.INTENT_TERMS


def _requests(spark, d):
    """Requests in words of the catalog: each order's comment-like line from priority, status and segment."""
    mood = F.element_at(F.array(*[F.lit(x) for x in ("Sad R&B from the 1990s", "hip-hop, upbeat 80s", "Drum and bass for a workout", "2010s k-pop & jazz", "no wishes", "")]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return scan(spark, d, "customer", ["c_custkey", "c_mktsegment"]).select(F.col("c_custkey").alias("query_id"), F.concat_ws(" ", mood, F.col("c_mktsegment")).alias("request"))


_REQUESTS = "requests AS (SELECT c_custkey AS query_id, (['Sad R&B from the 1990s', 'hip-hop, upbeat 80s', 'Drum and bass for a workout', '2010s k-pop & jazz', 'no wishes', ''])[c_custkey % 6 + 1] || ' ' || c_mktsegment AS request FROM customer)"
_NORMAL = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
_INTENT = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '\\b{t}\\b') THEN '{t}' END" for t in _TERMS) + "], lambda x: x IS NOT NULL)"
_ALL_TERMS = f"list_concat(list_concat({_INTENT}, regexp_extract_all(t, '{tx.DECADES}')), CASE WHEN regexp_matches(t, '\\br b\\b') THEN ['r&b'] ELSE [] END)"


@query(f"WITH {_REQUESTS} SELECT query_id, list_transform(list_filter(list_transform(range(1, len(a) + 1), lambda i: {{'i': i, 'x': a[i]}}), lambda e: list_position(a, e.x) = e.i), lambda e: e.x) AS terms FROM (SELECT query_id, {_ALL_TERMS} AS a FROM (SELECT query_id, {_NORMAL.format('request')} AS t FROM requests))")
def intent_terms(spark, d):
    return _requests(spark, d).select("query_id", tx.intent_terms(F.col("request")).alias("terms"))


_TAG_DOCS = "tagdocs AS (SELECT p_partkey AS track_id, (['rock', 'jazz', 'hip hop', 'sad', 'drum and bass', 'r&b', '1990s', 'workout', 'upbeat', 'k pop'])[p_size % 10 + 1] || ', ' || (['2010s', 'soul', 'latin', 'chill', 'pop', 'metal', 'happy'])[p_size % 7 + 1] AS tags FROM part)"


@query(f"""WITH {_REQUESTS}, {_TAG_DOCS}, i AS (SELECT query_id, {_ALL_TERMS} AS a FROM (SELECT query_id, {_NORMAL.format('request')} AS t FROM requests)), ph AS (SELECT DISTINCT query_id, unnest(a) AS phrase FROM i),
    qt AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({_words('phrase')}) AS term FROM ph) GROUP BY ALL), dt AS ({_terms_sql('tagdocs', 'track_id', 'tags')}),
    dl AS (SELECT track_id, sum(tf) AS dl FROM dt GROUP BY ALL), st AS (SELECT (SELECT count(*) FROM tagdocs)::DOUBLE AS n, (SELECT sum(dl) FROM dl)::DOUBLE AS total), df AS (SELECT term, count(*) AS df FROM dt GROUP BY ALL),
    w AS (SELECT term, track_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (total / n)))) AS weight FROM dt JOIN dl USING (track_id) JOIN df USING (term), st),
    s AS (SELECT query_id, track_id, {q('sum(tf * weight)', '1e7')} AS score FROM qt JOIN w USING (term) GROUP BY ALL) SELECT query_id, track_id, {q('score')} AS score, {_BEST.format('track_id')} FROM s QUALIFY rank <= 20""")
def tag_intent_bm25(spark, d):
    first, second = ["rock", "jazz", "hip hop", "sad", "drum and bass", "r&b", "1990s", "workout", "upbeat", "k pop"], ["2010s", "soul", "latin", "chill", "pop", "metal", "happy"]
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("p_size") % n + 1).cast("int"))
    docs = scan(spark, d, "part", ["p_partkey", "p_size"]).select(F.col("p_partkey").alias("track_id"), F.concat_ws(", ", pick(first, 10), pick(second, 7)).alias("tags"))
    asked = intent_terms(spark, d)
    best = lexical.tagged_best(asked, lexical.bm25_index(docs, "track_id", "tags"), 20, "query_id", "terms")
    return _rounded(best.withColumnRenamed("doc", "track_id"))


_PLAIN = f"translate(lower({{0}}), '{tx.ACCENTED}', '{tx.PLAIN}')"


def _grams_sql(table, key):
    return f"""SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM (SELECT {key}, regexp_extract_all({_PLAIN.format('text')}, '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM {table})) GROUP BY ALL"""


_TFIDF = f"""WITH qs AS (SELECT conv_id * 100 + turn AS query_id, text FROM conversations WHERE role = 'user'), dg AS ({_grams_sql('documents', 'doc_id')}), qg AS ({_grams_sql('qs', 'query_id')}),
    v AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)::DOUBLE) / (1 + count(*))) + 1 AS idf FROM dg GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 200000),
    dw AS (SELECT doc_id, term, tf * idf AS w FROM dg JOIN v USING (term)), qw AS (SELECT query_id, term, tf * idf AS w FROM qg JOIN v USING (term)),
    dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY ALL),
    s AS (SELECT query_id, doc_id, {q('sum((qw.w / qn.n) * (dw.w / dn.n))', '1e7')} AS score FROM qw JOIN qn USING (query_id) JOIN dw USING (term) JOIN dn USING (doc_id) GROUP BY ALL)"""


@query(_TFIDF + f" SELECT query_id, doc_id, {q('score')} AS score, {_BEST.format('doc_id')} FROM s WHERE score > 0 QUALIFY rank <= 20")
def tfidf_topk(spark, d):
    docs = scan(spark, d, "documents", ["doc_id", "text"])
    return _rounded(cosines.nearest(_user_queries(spark, d), docs, 20, "query_id", "doc_id", "text", "text"))


# -- phrases ------------------------------------------------------------------------------------------


def _names(spark, d):
    """Names from the passages: the first four words as a title, the next two as an artist."""
    words = F.split(tx.norm_name(F.col("text")), " ")
    return scan(spark, d, "benchmark").select(F.col("item_id").alias("track_id"), F.array_join(F.slice(words, 1, 4), " ").alias("title"), F.array_join(F.slice(words, 5, 2), " ").alias("artist"))


_NAMES = f"names AS (SELECT item_id AS track_id, array_to_string(w[1:4], ' ') AS title, array_to_string(w[5:6], ' ') AS artist FROM (SELECT item_id, string_split({_NORMAL.format('text')}, ' ') AS w FROM benchmark))"
_DOCS = f"docs AS (SELECT doc_id, ' ' || {_NORMAL.format('text')} || ' ' AS t FROM documents)"


def _matches(spark, d, name, min_chars, min_tokens):
    docs = scan(spark, d, "documents", ["doc_id", "text"])
    return phrases.phrase_matches(docs, "doc_id", "text", _names(spark, d).select(F.col(name).alias("name")), min_chars, min_tokens)


@query(f"WITH {_NAMES}, n AS (SELECT DISTINCT title AS name FROM names), t AS (SELECT DISTINCT name, unnest(string_split(name, ' ')) AS token FROM n), df AS (SELECT token, count(*) AS df FROM t WHERE token <> '' GROUP BY ALL) SELECT name, min({{'df': df, 'token': token}}).token AS token FROM t JOIN df USING (token) GROUP BY ALL")
def rare_token_bucket(spark, d):
    return phrases.rare_token_bucket(_names(spark, d).select(F.col("title").alias("name")))


@query(f"WITH {_NAMES}, {_DOCS} SELECT DISTINCT doc_id, title AS name FROM docs JOIN names ON contains(t, ' ' || title || ' ') WHERE length(title) >= 5")
def phrase_match_title(spark, d):
    return _matches(spark, d, "title", 5, 1)


@query(f"WITH {_NAMES}, {_DOCS} SELECT doc_id, track_id, count(*) * 5 AS score FROM (SELECT DISTINCT doc_id, title, artist, track_id FROM docs JOIN names ON contains(t, ' ' || title || ' ') AND contains(t, ' ' || artist || ' ') WHERE length(title) >= 10 AND len(string_split(title, ' ')) >= 2 AND length(artist) >= 3) GROUP BY ALL")
def phrase_match_pair(spark, d):
    albums = _matches(spark, d, "title", 10, 2).withColumnRenamed("name", "a")
    artists = _matches(spark, d, "artist", 3, 1).withColumnRenamed("name", "b")
    index = _names(spark, d).select(F.col("title").alias("a"), F.col("artist").alias("b"), "track_id")
    return retrieve.paired_names(albums, artists, index, "doc_id", 5)


@query(f"WITH {_NAMES}, {_DOCS} SELECT doc_id, track_id, count(*) * 10 AS score FROM (SELECT DISTINCT doc_id, title, artist, track_id FROM docs JOIN names ON contains(t, ' ' || title || ' ') AND contains(t, ' ' || artist || ' ') WHERE length(title) >= 5 AND length(artist) >= 3) GROUP BY ALL")
def phrase_match_title_artist(spark, d):
    titles = _matches(spark, d, "title", 5, 1).withColumnRenamed("name", "a")
    artists = _matches(spark, d, "artist", 3, 1).withColumnRenamed("name", "b")
    index = _names(spark, d).select(F.col("title").alias("a"), F.col("artist").alias("b"), "track_id")
    return retrieve.paired_names(titles, artists, index, "doc_id", 10)


# -- scalar functions ---------------------------------------------------------------------------------


@query(sql("catalog", r"""SELECT track_id, trim(regexp_replace(lower(title || ' (' || artist || ')'), '[^\p{L}\p{N}_]+', ' ', 'g')) AS normal, upper(substr(isrc, 1, 2)) AS isrc_country, CASE WHEN substr(isrc, 6, 2)::INT < 30 THEN 2000 ELSE 1900 END + substr(isrc, 6, 2)::INT AS isrc_year,
    year::INT AS year, CASE WHEN duration <= 0 THEN 0 WHEN duration < 60000 THEN 1 WHEN duration < 180000 THEN 2 WHEN duration < 300000 THEN 3 WHEN duration < 600000 THEN 4 ELSE 5 END AS duration_bucket,
    (list_sum(list_transform(range(1, length(artist) + 1), lambda i: i * unicode(artist[i])))::BIGINT % 64 + 1)::INT AS char_bucket FROM catalog"""))
def scalar_functions(spark, d):
    c = fx.catalog(spark, d)
    title, artist, isrc = F.get("titles", F.lit(0)), tx.first_text(F.col("artists")), F.col("isrc")
    return c.select("track_id", tx.norm_name(F.concat(title, F.lit(" ("), artist, F.lit(")"))).alias("normal"), tx.isrc_country(isrc).alias("isrc_country"), tx.isrc_year(isrc).alias("isrc_year"), tx.parse_year(F.col("release_date")).alias("year"), tx.duration_bucket(F.col("duration")).alias("duration_bucket"), tx.char_bucket(artist).alias("char_bucket"))


@query(sql("catalog", "SELECT track_id, lower('title: ' || title || chr(10) || 'artist: ' || artist || chr(10) || 'tags: ' || array_to_string(tags, ', ')) AS field_text, 'track_id: ' || track_id || ', title: ' || title || ', popularity: ' || CASE WHEN popularity = floor(popularity) THEN (popularity::BIGINT)::VARCHAR ELSE '' END AS metadata, title || ' by ' || artist || ' from ' || album AS sentence FROM catalog"))
def metadata_text(spark, d):
    c = fx.catalog(spark, d)
    whole = F.when(F.col("popularity") == F.floor("popularity"), F.col("popularity").cast("long").cast("string")).otherwise("")
    fields = {"title": (F.col("titles"), True), "artist": (F.col("artists"), True), "tags": (F.col("tags"), True)}
    one = lambda n: F.get(n, F.lit(0))
    return c.select("track_id", tx.field_text(fields).alias("field_text"), tx.metadata_text(F.col("track_id"), {"title": (F.col("titles"), True), "popularity": (whole, False)}).alias("metadata"), tx.track_sentence(one("titles"), one("artists"), one("albums")).alias("sentence"))


@query(sql("dialogue", "SELECT session_id, string_agg(CASE WHEN role = 'music' THEN 'assistant' ELSE role END || ': ' || content, chr(10) ORDER BY pos) AS dialogue FROM dialogue GROUP BY ALL"))
def dialogue_text(spark, d):
    by = fx.dialogue(spark, d).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "content"))).alias("m"))
    return by.select("session_id", tx.dialogue(F.col("m")).alias("dialogue"))


@query("SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS tokens FROM documents")
def token_sets(spark, d):
    return scan(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.sort_array(tx.token_set(F.col("text"))).alias("tokens"))


@query(sql("dialogue catalog", """WITH h AS (SELECT session_id, string_agg(CASE WHEN role = 'music' THEN 'assistant' ELSE role END || ': ' || content, chr(10) ORDER BY pos) AS history FROM dialogue GROUP BY ALL),
    x AS (SELECT session_id, title || ' by ' || artist || ' from ' || album AS line FROM h JOIN catalog ON track_id = session_id)
    SELECT session_id, '[profile]' || chr(10) || 'listener ' || session_id || chr(10) || chr(10) || '[dialogue]' || chr(10) || history || chr(10) || chr(10) || '[tracks]' || chr(10) || line AS prompt FROM h JOIN x USING (session_id)"""))
def prompt_render(spark, d):
    c = fx.catalog(spark, d)
    one = lambda n: F.get(n, F.lit(0))
    lines = c.select(F.col("track_id").alias("session_id"), tx.track_sentence(one("titles"), one("artists"), one("albums")).alias("line"))
    h = dialogue_text(spark, d).join(lines, "session_id")
    return h.select("session_id", tx.prompt(F.col("dialogue"), F.col("line"), F.concat(F.lit("listener "), F.col("session_id").cast("string")), F.lit(None).cast("string")).alias("prompt"))


@query()
def diverse_select(spark, d):
    """One reply per conversation turn, among its conversation's replies, for lexical diversity."""
    m = scan(spark, d, "conversations").filter("role = 'assistant'")
    other = m.select("conv_id", F.col("turn").alias("run"), F.col("text").alias("option"))
    options = m.select("conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("key")).join(other, "conv_id")
    return respond.diverse_select(options, "key", "run", "option")


# -- vectors ------------------------------------------------------------------------------------------


@query(f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS row_id, {q('list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])', '1e7')} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) SELECT query_id, row_id, {q('score')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s QUALIFY rank <= 20")
def dense_topk(spark, d):
    """The stated query set, every id divisible by 50, against all rows."""
    e = scan(spark, d, "embeddings")
    best = blocks.by_vectors(e.filter("vec_id % 50 = 0"), e, 20, "vec_id", "vec_id", "embedding", vc.modal_size(e, "embedding"))
    return _rounded(best.withColumnsRenamed({"q__vec_id": "query_id", "r__vec_id": "row_id"}))


@query(f"SELECT label, list({q('m', '1e6')} ORDER BY i) AS centroid FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL) GROUP BY ALL")
def centroids(spark, d):
    e = vc.centroid(scan(spark, d, "embeddings"), ["label"], "embedding")
    return e.select("label", F.transform("centroid", lambda x: tx.quantised(x, 1e6)).alias("centroid"))


@query(f"SELECT vec_id, list_transform(embedding, lambda x: {q('x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))')}) AS unit FROM embeddings")
def unit_vectors(spark, d):
    return scan(spark, d, "embeddings").select("vec_id", F.transform(vc.l2(F.col("embedding")), lambda x: tx.quantised(x)).alias("unit"))
