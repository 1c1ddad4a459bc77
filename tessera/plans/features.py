"""Queries of the feature groups over rows and their co-occurrence candidates, and of the rerankers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.functions.text import quantised
from tessera.operators import features, rerank, retrieve, union
from tessera.operators.lexical import STOP_WORDS
from tessera.operators.turns import ROW
from tessera.plans import fixtures as fx
from tessera.plans.candidates import _transition, cooc_lists, entity_lists, long, successor_lists
from tessera.plans.fixtures import q, sql
from tessera.registry import query
from tessera.sources.tables import scan
from tessera.store import dealt, written

_ROW = "session_id, turn, track_id"


def _successors(spark, d):
    """The candidates that the feature queries take: what followed the latest track."""
    return _transition(spark, d).select(*ROW, "track_id", "rank")


@query(sql("trans_top hist lastp catalog", """WITH h AS (SELECT h.session_id, h.turn, h.track_id, artist, album, tags[1] AS tag FROM hist h JOIN catalog USING (track_id)),
    ar AS (SELECT session_id, turn, artist, count(*) AS n FROM h GROUP BY ALL), al AS (SELECT session_id, turn, album, count(*) AS n FROM h GROUP BY ALL), tg AS (SELECT session_id, turn, tag, count(*) AS n FROM h GROUP BY ALL),
    c AS (SELECT t.session_id, t.turn, t.track_id, artist, album, tags[1] AS tag FROM trans_top t JOIN catalog USING (track_id)), l AS (SELECT p.session_id, p.turn, artist AS la, album AS lb FROM lastp p JOIN catalog USING (track_id))
    SELECT c.session_id, c.turn, c.track_id, coalesce(ar.n, 0) AS same_artist, coalesce(al.n, 0) AS same_album, coalesce(tg.n, 0) AS same_tag, 0 AS same_track, coalesce((c.artist = l.la)::INT, 0) AS is_last_artist, coalesce((c.album = l.lb)::INT, 0) AS is_last_album
    FROM c LEFT JOIN ar USING (session_id, turn, artist) LEFT JOIN al USING (session_id, turn, album) LEFT JOIN tg USING (session_id, turn, tag) LEFT JOIN l USING (session_id, turn)"""))
def same_entity_history_counts(spark, d):
    about = features.entity_about(fx.catalog(spark, d))
    lists = successor_lists(spark, d, "about", about=about, more=lambda t: t.join(about, "track_id", "left"), then=lambda r: r.withColumn("plays", F.col("past")))
    return features.listed_same_entity(lists.withColumnRenamed("plays", "past"))


@query(sql("trans_top hist catalog", f"WITH n AS (SELECT session_id, turn, count(*) AS n_history FROM hist GROUP BY ALL) SELECT {_ROW}, popularity, {q('ln(1 + duration)')} AS log_duration, year, n_history FROM trans_top JOIN catalog USING (track_id) JOIN n USING (session_id, turn)"))
def basic_features(spark, d):
    return features.basics(_successors(spark, d), fx.catalog(spark, d), fx.hist(spark, d))


@query(sql("trans_top", f"SELECT {_ROW}, rank::DOUBLE AS candidate_rank, {q('ln(1 + rank)')} AS candidate_log_rank, {q('1.0 / rank')} AS candidate_inv_rank, 0.0::DOUBLE AS candidate_score FROM trans_top"))
def rank_family(spark, d):
    return features.rank_family(_successors(spark, d), neutral=False)


@query(sql("trans_top hist catalog", f"WITH m AS (SELECT session_id, turn, avg(year) AS y FROM hist JOIN catalog USING (track_id) GROUP BY ALL) SELECT {_ROW}, {q('CASE WHEN y > 0 AND year > 0 THEN abs(year - y) ELSE 0.0 END')} AS year_gap FROM trans_top JOIN catalog USING (track_id) LEFT JOIN m USING (session_id, turn)"))
def year_diff(spark, d):
    years = fx.catalog(spark, d).select("track_id", "year")
    mean = features.mean_of(F.filter(F.col("past.year"), lambda y: y.isNotNull()))
    about = years.select("track_id", F.struct("year").alias("about"))
    return features.listed_year_gap(successor_lists(spark, d, "year", about=about, more=lambda t: t.join(years, "track_id", "left"), then=lambda r: r.withColumn("mean_year", mean)))


_ALBUM = "am AS (SELECT album, avg(duration) FILTER (duration > 0) AS m FROM catalog GROUP BY ALL)"
_BUCKET = "CASE WHEN duration <= 0 THEN 0 WHEN duration < 60000 THEN 1 WHEN duration < 180000 THEN 2 WHEN duration < 300000 THEN 3 WHEN duration < 600000 THEN 4 ELSE 5 END"
_ISRC_YEAR = "(CASE WHEN substr(isrc, 6, 2)::INT < 30 THEN 2000 ELSE 1900 END + substr(isrc, 6, 2)::INT)"


@query(sql("catalog", f"WITH {_ALBUM} SELECT track_id, {q('m')} AS album_mean FROM catalog JOIN am USING (album)"))
def album_mean_duration(spark, d):
    return features.album_durations(fx.catalog(spark, d)).select("track_id", quantised(F.col("album_mean")).alias("album_mean"))


@query(sql("trans_top hist catalog", f"""WITH {_ALBUM}, pm AS (SELECT session_id, turn, avg(duration) AS p FROM hist JOIN catalog USING (track_id) WHERE duration > 0 GROUP BY ALL)
    SELECT {_ROW}, {_ISRC_YEAR} AS isrc_year, 0 AS isrc_missing, ((unicode(substr(isrc, 1, 1)) + 2 * unicode(substr(isrc, 2, 1))) % 64 + 1)::INT AS isrc_bucket, (substr(isrc, 1, 2) = 'FR')::INT AS isrc_same_country, abs(year - {_ISRC_YEAR}) AS isrc_gap, {_BUCKET} AS duration_bucket,
    {q('CASE WHEN p > 0 THEN (duration - p) / 60000.0::DOUBLE ELSE 0 END')} AS vs_history, {q('CASE WHEN m > 0 THEN (duration - m) / 60000.0::DOUBLE ELSE 0 END')} AS vs_album, (30 + session_id % 40) - (2026 - year) AS age_gap
    FROM trans_top JOIN catalog USING (track_id) JOIN am USING (album) LEFT JOIN pm USING (session_id, turn)"""))
def metadata_features(spark, d):
    c = fx.catalog(spark, d)
    mean = features.mean_of(F.filter(F.col("past.duration"), lambda x: x > 0))
    more = lambda t: t.join(c.select("track_id", "duration"), "track_id", "left")
    lists = successor_lists(spark, d, "duration", about=features.recording_about(c), more=more, then=lambda r: r.withColumn("played_ms", mean))
    return features.listed_metadata(lists, 30 + F.col("session_id") % 40, F.lit("fr"))


@query(sql("catalog", f"""WITH a AS (SELECT artist, avg(popularity) AS m, max(popularity) AS x, count(*) AS n FROM catalog GROUP BY ALL), b AS (SELECT album, avg(popularity) AS m, count(*) AS n FROM catalog GROUP BY ALL)
    SELECT track_id, {q('ln(1 + popularity)')} AS log_popularity, {q('a.m')} AS artist_mean, a.x AS artist_max, {q('ln(1 + a.n)')} AS artist_log_n, {q('b.m')} AS album_mean, {q('ln(1 + b.n)')} AS album_log_n, {q('popularity / a.m')} AS over_artist, {q('popularity / b.m')} AS over_album
    FROM catalog JOIN a USING (artist) JOIN b USING (album)"""))
def hier_popularity(spark, d):
    return features.hierarchy(fx.catalog(spark, d))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = r"""tk AS (SELECT DISTINCT track_id, unnest(regexp_split_to_array(lower(array_to_string(tags, ' ')), '[^\p{L}\p{N}]+')) AS token FROM catalog), tk2 AS (SELECT * FROM tk WHERE length(token) >= 2 AND token NOT IN (""" + _STOP + """)), vo AS (SELECT token, count(*) AS df FROM tk2 GROUP BY ALL)"""
_PPMI = f"""pp AS (SELECT a.token, b.token AS other, count(*) AS n FROM tk2 a JOIN tk2 b ON a.track_id = b.track_id AND a.token <> b.token GROUP BY ALL),
    pv AS (SELECT pp.token, pp.other, o.df AS odf, ln(n * (SELECT count(*) FROM part)::DOUBLE / (v.df * o.df)) AS value FROM pp JOIN vo v ON v.token = pp.token JOIN vo o ON o.token = pp.other),
    pn AS (SELECT token, other, value, row_number() OVER (PARTITION BY token ORDER BY {q('value', '1e7')} DESC, odf DESC, other) AS place FROM pv WHERE {q('value', '1e7')} > 0 QUALIFY place <= 20)"""


def _tag_tokens(c):
    return features.tag_tokens(c, stop=STOP_WORDS)


@query(sql("catalog", f"WITH {_TOKENS}, {_PPMI} SELECT token, other, {q('value')} AS value, place FROM pn"))
def tag_ppmi_neighbors(spark, d):
    c = fx.catalog(spark, d)
    tokens, vocabulary = _tag_tokens(c)
    near = features.ppmi(tokens, vocabulary, c.count())
    return near.withColumn("value", quantised(F.col("value")))


@query(sql("catalog", f"WITH {_TOKENS} SELECT token, df FROM vo"))
def tag_vocabulary(spark, d):
    return _tag_tokens(fx.catalog(spark, d))[1]


@query(sql("trans_top hist catalog", f"""WITH {_TOKENS}, {_PPMI}, idf AS (SELECT token, ln((1.0 + (SELECT count(*) FROM part)::DOUBLE) / (1.0 + df)) + 1.0 AS idf FROM vo), nm AS (SELECT track_id, sqrt(sum(idf * idf)) AS norm, count(*) AS k FROM tk2 JOIN idf USING (token) GROUP BY ALL),
    un AS (SELECT tk2.track_id, token, idf / norm AS w, k FROM tk2 JOIN idf USING (token) JOIN nm USING (track_id)), se AS (SELECT session_id, turn, token, sum(w) AS h FROM hist JOIN un USING (track_id) GROUP BY ALL),
    br AS (SELECT session_id, turn, count(*) AS n_seen, sqrt(sum(h * h)) AS hn FROM se GROUP BY ALL), ne AS (SELECT session_id, turn, other AS token, sum(value) AS v FROM se JOIN pn USING (token) GROUP BY ALL),
    s AS (SELECT c.session_id, c.turn, c.track_id, count(h) AS overlap, max(k) AS k, sum(w * h) AS cos, count(v) AS neighbours, coalesce(sum(v), 0.0) AS ps, coalesce(max(v), 0.0) AS pm FROM trans_top c JOIN un USING (track_id) LEFT JOIN se USING (session_id, turn, token) LEFT JOIN ne USING (session_id, turn, token) GROUP BY ALL)
    SELECT {_ROW}, overlap, {q('overlap / (k + coalesce(n_seen, 0) - overlap)')} AS jaccard, {q('coalesce(cos / hn, 0.0)')} AS cosine, neighbours, {q('ps')} AS ppmi_sum, {q('pm')} AS ppmi_max FROM s LEFT JOIN br USING (session_id, turn)"""))
def tag_chain_features(spark, d):
    c = fx.catalog(spark, d)
    tokens, vocabulary = _tag_tokens(c)
    codes, n = features.token_codes(vocabulary), c.count()
    about = features.coded(tokens, codes).hint("merge")  # as many as the tracks, so not to be sent
    seen = F.filter(F.col("past.about"), lambda x: x.isNotNull())
    lists = successor_lists(spark, d, "about", about=about, more=lambda t: t.join(about, "track_id", "left"), then=lambda r: r.withColumn("seen", seen))
    return features.listed_tag_chain(lists, codes, vocabulary, features.ppmi(tokens, vocabulary, n), n)


@query(sql("trans_top hist catalog", f"WITH {_TOKENS}, se AS (SELECT session_id, turn, token, count(*) AS n FROM hist JOIN tk2 USING (track_id) GROUP BY ALL) SELECT c.session_id, c.turn, c.track_id, coalesce(sum(n), 0)::BIGINT AS tag_overlap FROM trans_top c JOIN tk2 USING (track_id) LEFT JOIN se USING (session_id, turn, token) GROUP BY ALL"))
def tag_overlap_history(spark, d):
    tokens, vocabulary = _tag_tokens(fx.catalog(spark, d))
    about = features.coded(tokens, features.token_codes(vocabulary))
    seen = F.flatten(F.filter(F.col("past.about"), lambda x: x.isNotNull()))
    lists = successor_lists(spark, d, "about", about=about, more=lambda t: t.join(about, "track_id", "left"), then=lambda r: r.withColumn("seen", seen))
    return features.listed_overlap_history(lists)


@query(sql("turns catalog", f"WITH {_TOKENS}, tx AS (SELECT session_id, lower(o_orderpriority || ' small red ' || o_orderstatus) AS t FROM orders JOIN (SELECT DISTINCT session_id FROM turns) ON session_id = o_orderkey), w AS (SELECT DISTINCT session_id, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS token FROM tx), c AS (SELECT DISTINCT session_id, track_id FROM turns) SELECT c.session_id, c.track_id, count(w.token) AS text_overlap FROM c JOIN tk2 USING (track_id) LEFT JOIN w USING (session_id, token) GROUP BY ALL"))
def tag_overlap_text(spark, d):
    texts = scan(spark, d, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus"]).select(F.col("o_orderkey").alias("session_id"), F.concat_ws(" ", "o_orderpriority", F.lit("small red"), "o_orderstatus").alias("t"))
    candidates = fx.turns(spark, d).select("session_id", "track_id").distinct()
    return features.tag_overlap_text(candidates, texts, _tag_tokens(fx.catalog(spark, d))[0], ["session_id"], "t")


@query(f"""WITH h AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS turn FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(e[i]) AS m FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS i FROM h WHERE turn <= 5) GROUP BY ALL) GROUP BY ALL)
    SELECT h.label, h.vec_id, {q('list_dot_product(e, c) / sqrt(list_dot_product(c, c))')} AS cosine FROM h JOIN c USING (label)""")
def history_centroid_cosine(spark, d):
    """Each vector against the unit centroid of the first five of its label."""
    from pyspark.sql import Window

    e = scan(spark, d, "embeddings")
    first = e.withColumn("turn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).filter("turn <= 5").select("label", "vec_id")
    return features.centroid_cosine(e.select("label", "vec_id"), first, e.select("vec_id", "embedding"), ["label"], "vec_id", "embedding")


@query(sql("trans_top golds", f"SELECT c.session_id, c.turn, c.track_id, c.rank, (c.track_id = g.gold)::INT AS label, count(*) OVER (PARTITION BY c.session_id, c.turn) AS group_size FROM trans_top c JOIN golds g USING (session_id, turn)"))
def labels(spark, d):
    sessions = scan(spark, d, "orders", ["o_orderkey"]).select(F.col("o_orderkey").alias("session_id"))
    lists = successor_lists(spark, d, more=lambda t: t.join(sessions, "session_id", "left_semi"))  # a row's own track is its gold
    return features.listed_labels(lists.withColumnRenamed("track_id", "gold"), "gold")


@query(sql("trans_top turns", "WITH hit AS (SELECT DISTINCT p.session_id, p.turn FROM trans_top p JOIN turns t ON t.session_id = p.session_id AND t.turn = p.turn AND t.track_id = p.track_id) SELECT c.session_id, c.turn, c.track_id, c.rank FROM trans_top c JOIN hit USING (session_id, turn)"))
def positive_rows(spark, d):
    hit = F.exists("top", lambda x: x["track_id"] == F.col("track_id"))
    return retrieve.listed(successor_lists(spark, d).filter(hit), "track_id", "rank")


# -- reranking ----------------------------------------------------------------------------------------

_PROV = "SELECT session_id, turn, track_id, " + ", ".join(f"max((source = '{n}')::INT) AS {n}_present, max(rank) FILTER (source = '{n}') AS {n}_rank" for n in ("cooc", "transition", "album")) + " FROM long GROUP BY ALL"


@query(sql("long", f"WITH p AS ({_PROV}) SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY score DESC, track_id) AS rank FROM (SELECT session_id, turn, track_id, {q('0.0 + 1.0 * coalesce(1.0::DOUBLE / cooc_rank, 0) + 0.5 * coalesce(1.0::DOUBLE / transition_rank, 0) + 0.25 * coalesce(1.0::DOUBLE / album_rank, 0)', '1e6')} AS score FROM p) QUALIFY rank <= 20"))
def weighted_rerank(spark, d):
    p = union.provenance(long(spark, d), ["cooc", "transition", "album"])
    inverse = p.withColumns({f"{n}_inv": 1.0 / F.col(f"{n}_rank") for n in ("cooc", "transition", "album")})
    scored = rerank.weighted(inverse, {"cooc_inv": 1.0, "transition_inv": 0.5, "album_inv": 0.25})
    return rerank.ranked(scored.select(*ROW, "track_id", "score"), 20)


_SOURCES = ["cooc", "transition", "album"]


def _fused(spark, d):
    """(row, gold, asked): the candidates of long() of each row that has a gold, with one over their rank in each source, written once.

    Ranks are places in a list, as caps and the least score of long() leave its first entries. No candidate is dealt out alone.
    """
    none = F.array().cast("array<bigint>")
    first = lambda least: F.filter("top", lambda x: (x["rank"] <= 10) & (x["score"] >= least))["track_id"]
    own = {"cooc": cooc_lists(spark, d).select(*ROW, first(2).alias("cooc")), "transition": successor_lists(spark, d).select(*ROW, F.col("top.track_id").alias("transition"))}
    own["album"] = entity_lists(spark, d, "albums").select(*ROW, first(0).alias("album"))
    met = reduce(lambda a, b: dealt(a, *ROW).join(dealt(b, *ROW), ROW, "full_outer"), own.values())
    lists = met.join(dealt(fx.golds(spark, d).select(*ROW, "gold"), *ROW), ROW).withColumns({n: F.coalesce(n, none) for n in _SOURCES})
    place = lambda n, t: F.coalesce(1.0 / F.nullif(F.array_position(n, t), F.lit(0)), F.lit(0.0)).alias(n)
    asked = F.transform(F.array_distinct(F.concat(*_SOURCES)), lambda t: F.struct(t.alias("track_id"), *[place(n, t) for n in _SOURCES]))
    return written(lists.select(*ROW, "gold", asked.alias("asked")), "fused")


def _training(fused):
    each = fused.select(*ROW, "gold", F.size("asked").cast("long").alias("group_size"), F.explode("asked").alias("x"))
    return each.select(*ROW, "x.*", (F.col("x.track_id") == F.col("gold")).cast("int").alias("label"), "group_size")


@query()
def pointwise_rerank(spark, d):
    """Boosted trees fitted on folds 1 to 4, applied to all rows."""
    rows = _training(_fused(spark, d))
    scored = rerank.pointwise(rows.filter(F.col("session_id") % 5 != 0), rows, ["cooc", "transition", "album"], trees=3, depth=3)
    return rerank.ranked(scored.select(*ROW, "track_id", "score"), 20)


@query()
def lambdarank_rerank(spark, d):
    """LambdaRank fitted on a bounded sample of rows of folds 1 to 4, applied to all rows."""
    fused = _fused(spark, d)
    rows = _training(fused)
    model = rerank.fitted(rows.filter(F.col("session_id") % 5 != 0), _SOURCES, sample_rows=200, trees=10, leaves=15)
    return rerank.best_listed(fused, model, _SOURCES, 20)
