"""Queries over rows: turn expansion, histories, keys, folds, and count tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import norm_name
from tessera.operators import counts, idmap, turns
from tessera.plans import fixtures as fx
from tessera.plans.fixtures import q, sql
from tessera.registry import query
from tessera.sources.tables import scan


@query(sql("dialogue", """SELECT session_id, turn, query, gold FROM (SELECT session_id, turn, min_by(content, pos) FILTER (role = 'user') AS query, min_by(content, pos) FILTER (role = 'music') AS gold
    FROM dialogue WHERE turn BETWEEN 1 AND 8 GROUP BY ALL) WHERE query IS NOT NULL AND gold IS NOT NULL"""))
def turn_expansion(spark, d):
    return turns.labeled_turns(fx.dialogue(spark, d))


@query(sql("dialogue", """SELECT session_id, turn, concat_ws(' and ', CASE WHEN u = 0 THEN 'query' END, CASE WHEN g = 0 THEN 'gold' END) AS lacks FROM (SELECT session_id, turn, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'music') AS g
    FROM dialogue WHERE turn BETWEEN 1 AND 8 GROUP BY ALL) WHERE u = 0 OR g = 0"""))
def turn_expansion_strict(spark, d):
    """The turns at which the strict expansion fails, over all sessions; that it does fail there is tested."""
    return turns.missing_parts(fx.dialogue(spark, d))


@query(sql("dialogue", """SELECT l.session_id, l.turn, l.content AS query, (SELECT count(*) FROM dialogue h WHERE h.session_id = l.session_id AND h.turn < l.turn)::INT AS n_history
    FROM (SELECT * FROM dialogue QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) = 1) l"""))
def inference_turns(spark, d):
    return turns.inference_turns(fx.dialogue(spark, d))


@query(sql("dialogue", """SELECT l.session_id, l.turn, l.content AS query, (SELECT count(*) FROM dialogue h WHERE h.session_id = l.session_id AND h.pos < l.pos)::INT AS n_history
    FROM (SELECT * FROM dialogue QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) = 1) l"""))
def inference_turns_all_before(spark, d):
    """The other reading: everything before the last message is its history."""
    return turns.inference_turns(fx.dialogue(spark, d), whole_turns=False)


@query(sql("dialogue", """SELECT session_id, turn, content AS query, NULL::VARCHAR AS gold FROM dialogue QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) = 1"""))
def blind_examples(spark, d):
    return turns.examples(fx.dialogue(spark, d), "blind")


@query(sql("turns", "SELECT session_id, list(track_id ORDER BY turn) AS tracks FROM turns GROUP BY ALL"))
def session_sequence(spark, d):
    return turns.session_sequence(fx.turns(spark, d))


@query(sql("dialogue", "SELECT session_id, turn, max_by(content, pos) AS gold FROM dialogue WHERE role = 'music' GROUP BY ALL"))
def gold_by_turn(spark, d):
    return turns.gold_by_turn(fx.dialogue(spark, d))


@query(sql("turns", "SELECT key, regexp_extract(key, '^(.*):([^:]*)$', 1) AS session, regexp_extract(key, '^(.*):([^:]*)$', 2)::INT AS turn FROM (SELECT 'order:' || session_id || ':' || turn AS key FROM turns)"))
def row_keys(spark, d):
    keys = fx.turns(spark, d).select(turns.row_key(F.lit("order"), F.col("session_id"), F.col("turn")).alias("key"))
    session, turn = turns.split_key(F.col("key"))
    return keys.select("key", session.alias("session"), turn.alias("turn"))


@query(sql("turns hist", "SELECT coalesce(l.key, r.key) AS key, CASE WHEN l.key IS NULL THEN 'right' ELSE 'left' END AS only FROM (SELECT session_id || ':' || turn AS key FROM turns) l FULL JOIN (SELECT DISTINCT session_id || ':' || turn AS key FROM hist) r ON l.key = r.key WHERE l.key IS NULL OR r.key IS NULL"))
def alignment_check(spark, d):
    key = turns.row_key(F.col("session_id"), F.col("turn")).alias("key")
    return turns.unaligned(fx.turns(spark, d).select(key), fx.hist(spark, d).select(key).distinct())


@query(sql("played", "SELECT * FROM played"))
def played_set(spark, d):
    return turns.played(fx.hist(spark, d))


@query(sql("hist catalog", "SELECT session_id, turn, list_sort(list(DISTINCT artist)) AS artists, list_sort(list(DISTINCT album)) AS albums, list(track_id ORDER BY h_turn) AS tracks, count(*) AS n_history FROM hist JOIN catalog USING (track_id) GROUP BY ALL"))
def history_state(spark, d):
    rows = turns.told(fx.turns(spark, d), fx.catalog(spark, d), "artists", "albums")
    every = lambda n: F.sort_array(F.array_distinct(F.flatten(f"past.{n}"))).alias(n)
    return rows.select(*turns.ROW, every("artists"), every("albums"), F.col("past.track_id").alias("tracks"), F.size("past").cast("long").alias("n_history"))


@query(sql("hist catalog", r"SELECT session_id, turn, trim(regexp_replace(lower(artist), '[^\p{L}\p{N}_]+', ' ', 'g')) AS name, count(*) AS plays FROM hist JOIN catalog USING (track_id) GROUP BY ALL"))
def history_name_counts(spark, d):
    c = fx.catalog(spark, d).withColumn("names", F.transform("artists", norm_name))
    each = turns.told(fx.turns(spark, d), c, "names").select(*turns.ROW, F.explode(F.flatten("past.names")).alias("name"))
    return each.groupBy(*turns.ROW, "name").agg(F.count(F.lit(1)).alias("plays"))


@query(sql("", """SELECT o_orderstatus AS source_split, session_id, turn, track_id, fold FROM (SELECT l_orderkey AS session_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice)::INT AS turn, l_partkey AS track_id, l_orderkey % 5 AS fold FROM lineitem)
    JOIN orders ON o_orderkey = session_id WHERE o_orderstatus = 'F'"""))
def slice_by_split(spark, d):
    splits = scan(spark, d, "orders", ["o_orderkey", "o_orderstatus"]).select(F.col("o_orderkey").alias("session_id"), F.col("o_orderstatus").alias("source_split"))
    rows = fx.turns(spark, d).drop("fold").join(splits, "session_id")
    folds = splits.withColumn("fold", F.col("session_id") % fx.FOLDS)
    return turns.slice_split(rows, "F", folds).select("source_split", "session_id", "turn", "track_id", "fold")


@query(sql("", """WITH s AS (SELECT o_orderkey AS session_id, [o_orderstatus || '|' || o_orderpriority || '|' || c_mktsegment || '|' || c_nationkey, o_orderstatus || '|' || o_orderpriority || '|' || c_mktsegment, o_orderstatus || '|' || o_orderpriority, o_orderstatus] AS paths FROM orders JOIN customer ON o_custkey = c_custkey),
    a AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY paths[1]) < 20 THEN 1 ELSE 0 END AS level FROM s),
    b AS (SELECT session_id, paths, CASE WHEN count(*) OVER (PARTITION BY paths[level + 1]) < 20 AND level < 3 THEN level + 1 ELSE level END AS level FROM a),
    c AS (SELECT session_id, paths, CASE WHEN count(*) OVER (PARTITION BY paths[level + 1]) < 20 AND level < 3 THEN level + 1 ELSE level END AS level FROM b)
    SELECT session_id, paths[level + 1] AS stratum FROM c"""))
def strata_collapse(spark, d):
    return turns.collapse_strata(_strata_input(spark, d), ["source_split", "category", "specificity", "user_split"], 20).select("session_id", "stratum")


def _strata_input(spark, d):
    orders = scan(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    joined = orders.join(scan(spark, d, "customer", ["c_custkey", "c_mktsegment", "c_nationkey"]), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("session_id"), F.col("o_orderstatus").alias("source_split"), F.col("o_orderpriority").alias("category"), F.col("c_mktsegment").alias("specificity"), F.col("c_nationkey").alias("user_split"))


@query(sql("", "SELECT o_orderstatus AS source_split, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('fold:' || o_orderkey), o_orderkey) - 1) % 5)::INT AS fold, o_orderkey AS session_id FROM orders"))
def fold_assignment(spark, d):
    sessions = scan(spark, d, "orders", ["o_orderkey", "o_orderstatus"]).select(F.col("o_orderkey").alias("session_id"), F.col("o_orderstatus").alias("stratum"))
    return turns.assign_folds(sessions, fx.FOLDS).select(F.col("stratum").alias("source_split"), "fold", "session_id")


@query(sql("", "SELECT source_split, fold, count(*) AS sessions FROM (SELECT o_orderstatus AS source_split, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('fold:' || o_orderkey), o_orderkey) - 1) % 5)::INT AS fold FROM orders) GROUP BY ALL"))
def fold_balance(spark, d):
    return fold_assignment(spark, d).groupBy("source_split", "fold").agg(F.count(F.lit(1)).alias("sessions"))


# -- count tables -------------------------------------------------------------------------------------


@query(sql("cooc", "SELECT a, b, n FROM cooc"))
def cooc_counts(spark, d):
    return counts.pairs(fx.turns(spark, d), "track_id")


@query(sql("trans", "SELECT a, b, n FROM trans"))
def transition_counts(spark, d):
    return counts.transitions(fx.turns(spark, d), catalog=fx.catalog(spark, d))


def _entities(spark, d, entity):
    return fx.turns(spark, d).join(fx.catalog(spark, d).select("track_id", F.explode(entity).alias("entity")), "track_id")


@query(sql("turns catalog", "SELECT a.album AS a, b.album AS b, count(*) AS n FROM (SELECT DISTINCT session_id, album FROM turns JOIN catalog USING (track_id)) a JOIN (SELECT DISTINCT session_id, album FROM turns JOIN catalog USING (track_id)) b ON a.session_id = b.session_id AND a.album <> b.album GROUP BY ALL"))
def album_cooc_counts(spark, d):
    return counts.pairs(_entities(spark, d, "albums"), "entity")


@query(sql("turns catalog", "SELECT a.artist AS a, b.artist AS b, count(*) AS n FROM (SELECT DISTINCT session_id, trim(regexp_replace(lower(artist), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS artist FROM turns JOIN catalog USING (track_id)) a JOIN (SELECT DISTINCT session_id, trim(regexp_replace(lower(artist), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS artist FROM turns JOIN catalog USING (track_id)) b ON a.session_id = b.session_id AND a.artist <> b.artist GROUP BY ALL"))
def artist_cooc_counts(spark, d):
    named = _entities(spark, d, "artists").withColumn("entity", norm_name(F.col("entity")))
    return counts.pairs(named, "entity")


@query(sql("cooc", "SELECT a, b, n FROM cooc WHERE n >= 2"))
def cooc_min_count(spark, d):
    return counts.at_least(counts.pairs(fx.turns(spark, d), "track_id"), 2)


@query(sql("cooc_fold", "SELECT t.a, t.b, f.fold, t.n - coalesce(o.n, 0) AS n FROM (SELECT a, b, sum(n)::BIGINT AS n FROM cooc_fold GROUP BY ALL) t CROSS JOIN (SELECT unnest(range(5)) AS fold) f LEFT JOIN cooc_fold o ON o.a = t.a AND o.b = t.b AND o.fold = f.fold WHERE t.n > coalesce(o.n, 0)"))
def oof_cooc_counts(spark, d):
    return counts.out_of_fold(counts.pairs(fx.turns(spark, d), "track_id", by_fold=True), fx.FOLDS)


@query(sql("next", "WITH f AS (SELECT a, b, fold, count(*) AS n FROM next WHERE b IS NOT NULL GROUP BY ALL) SELECT t.a, t.b, k.fold, t.n - coalesce(o.n, 0) AS n FROM (SELECT a, b, sum(n)::BIGINT AS n FROM f GROUP BY ALL) t CROSS JOIN (SELECT unnest(range(5)) AS fold) k LEFT JOIN f o ON o.a = t.a AND o.b = t.b AND o.fold = k.fold WHERE t.n > coalesce(o.n, 0)"))
def oof_transition_counts(spark, d):
    return counts.out_of_fold(counts.transitions(fx.turns(spark, d), by_fold=True), fx.FOLDS)


@query(sql("", """WITH e AS (SELECT user_id, event_type || floor(value / 10)::INT AS item, ts, event_id FROM events), x AS (SELECT DISTINCT user_id, item FROM e),
    c AS (SELECT a.item AS a, b.item AS b, count(*) AS n FROM x a JOIN x b ON a.user_id = b.user_id AND a.item <> b.item GROUP BY ALL HAVING count(*) >= 5),
    t AS (SELECT item AS a, lead(item) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM e), u AS (SELECT a, b, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 5)
    SELECT 'cooccurrence' AS kind, a, b, n FROM c UNION ALL SELECT 'transition', a, b, n FROM u"""))
def external_counts(spark, d):
    e = scan(spark, d, "events", ["user_id", "event_type", "value", "ts", "event_id"])
    items = e.select(F.col("user_id").alias("session_id"), F.concat("event_type", F.floor(F.col("value") / 10).cast("int").cast("string")).alias("track_id"), F.struct("ts", "event_id").alias("turn"))
    parts = {"cooccurrence": counts.pairs(items, "track_id"), "transition": counts.transitions(items)}
    named = [counts.at_least(p, 5).select(F.lit(k).alias("kind"), "a", "b", "n") for k, p in parts.items()]
    return named[0].unionByName(named[1])


# -- id maps ------------------------------------------------------------------------------------------


def _paired(spark, d):
    t = fx.turns(spark, d)
    by = t.groupBy("session_id").agg(F.count(F.lit(1)).alias("length"))
    own = t.join(by, "session_id").select(F.col("session_id").alias("pair"), F.sha2(F.col("length").cast("string").cast("binary"), 256).alias("signature"), F.col("turn").alias("place"), "track_id")
    return idmap.paired(own.select("pair", "signature", "place", F.concat(F.lit("x"), (F.col("track_id") * 7).cast("string")).alias("item")), own.withColumnRenamed("track_id", "item"))


@query(sql("turns", "SELECT 'x' || (track_id * 7) AS external, track_id AS track, count(*) AS n FROM turns GROUP BY ALL"))
def id_map_pairs(spark, d):
    return _paired(spark, d)


@query(sql("turns", "SELECT count(*) AS pairs, count(DISTINCT external) AS externals, count(DISTINCT track) AS tracks, sum(n)::BIGINT AS occurrences, count(*) = count(DISTINCT external) AND count(*) = count(DISTINCT track) AS bijective FROM (SELECT 'x' || (track_id * 7) AS external, track_id AS track, count(*) AS n FROM turns GROUP BY ALL)"))
def id_map_bijection(spark, d):
    return idmap.bijection(_paired(spark, d))


@query(sql("turns", f"""WITH k AS (SELECT session_id, count(*) AS items, count(p_partkey) AS mapped FROM turns LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 20) ON p_partkey = track_id GROUP BY ALL)
    SELECT sum(items)::BIGINT AS items, sum(mapped)::BIGINT AS mapped, count(*) AS sessions, count(*) FILTER (mapped > 0) AS mapped_sessions, {q('sum(mapped) / sum(items)', '1e6')} AS item_rate, {q('count(*) FILTER (mapped > 0) / count(*)', '1e6')} AS session_rate FROM k"""))
def coverage_stats(spark, d):
    known = scan(spark, d, "part", ["p_partkey", "p_size"]).filter("p_size > 20").select(F.col("p_partkey").alias("external"))
    return idmap.coverage(fx.turns(spark, d), known, "session_id", "track_id")


@query(sql("dialogue", r"""SELECT session_id, sha256(string_agg(concat_ws('|', role, turn::VARCHAR, CASE WHEN role = 'music' THEN '<music>' ELSE trim(regexp_replace(content, '\s+', ' ', 'g')) END), chr(10) ORDER BY pos)) AS signature FROM dialogue GROUP BY ALL"""))
def signature_pairing(spark, d):
    from tessera.functions.text import signature

    by = fx.dialogue(spark, d).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "turn", "content"))).alias("m"))
    return by.select("session_id", signature(F.col("m")).alias("signature"))
