"""Queries of the evaluation: recall, precision, nDCG, complementarity, errors, ablations, and the checks of predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import quantised

from tessera.operators import evaluate as ev
from tessera.operators import retrieve, union
from tessera.operators.turns import ROW
from tessera.plans import fixtures as fx
from tessera.plans.candidates import NAMES, _cooc, cooc_lists, entity_lists, long, successor_lists
from tessera.plans.fixtures import q, sql
from tessera.registry import query
from tessera.sources import tables


def _ranks(spark, d):
    """Golds with n and rank: a row's own track is its gold, and its place in the row's list the rank."""
    place = F.nullif(F.array_position("top.track_id", F.col("track_id")), F.lit(0))
    splits = tables.scan(spark, d, "orders", ["o_orderkey", "o_orderstatus"]).select(F.col("o_orderkey").alias("session_id"), F.col("o_orderstatus").alias("split"))
    own = cooc_lists(spark, d).select(*ROW, F.col("track_id").alias("gold"), F.size("top").cast("long").alias("n"), place.alias("rank"))
    return own.join(splits, "session_id")


_places = _ranks


def _hit(k):
    return "(rank IS NOT NULL)::INT" if k is None else f"coalesce((rank <= {k})::INT, 0)"


_RECALL = ", ".join(f"{q(f'avg({_hit(k)})', '1e6')} AS recall_{k or 'all'}" for k in (1, 5, 10, 20, None))


@query(sql("ranks", f"SELECT 'overall' AS \"group\", {_RECALL} FROM ranks UNION ALL SELECT split, {_RECALL} FROM ranks GROUP BY split"))
def recall_at_k(spark, d):
    return ev.recall(_places(spark, d), (1, 5, 10, 20, None), "split")


@query(sql("ranks", ", ".join(["SELECT " + f"{q(f'sum({_hit(k)}) / sum({e})', '1e6')} AS micro_{k or 'all'}, {q(f'avg(coalesce({_hit(k)}::DOUBLE / nullif({e}, 0), 0))', '1e6')} AS macro_{k or 'all'}, sum({e})::BIGINT AS emitted_{k or 'all'}" for k, e in ((5, 'least(n, 5)'), (None, 'n'))]).replace(", SELECT", ",") + " FROM ranks"))
def precision_micro(spark, d):
    return ev.precision(_ranks(spark, d), (5, None))


@query(sql("ranks", f"SELECT {q('avg(n)', '1e6')} AS mean_n, quantile_cont(n, 0.5) AS median_n, {q('quantile_cont(n, 0.9)', '1e6')} AS p90_n, {q('avg((n > 0)::INT)', '1e6')} AS non_empty FROM ranks"))
def candidate_size_stats(spark, d):
    return ev.sizes(_ranks(spark, d))


_DISC = "CASE WHEN rank <= {k} THEN d ELSE 0 END"


@query(sql("disc", "SELECT " + ", ".join(f"{q('avg(' + _DISC.format(k=k) + ')', '1e6')} AS ndcg_{k}" for k in (1, 10, 20)) + " FROM disc"))
def ndcg_row_mean(spark, d):
    return ev.ndcg(_places(spark, d))


@query(sql("disc", "SELECT " + ", ".join(f"{q(f'avg(n{k})', '1e6')} AS ndcg_{k}" for k in (1, 10, 20)) + " FROM (SELECT turn, " + ", ".join(f"avg({_DISC.format(k=k)}) AS n{k}" for k in (1, 10, 20)) + " FROM disc GROUP BY turn)"))
def ndcg_turn_balanced(spark, d):
    return ev.ndcg_balanced(_places(spark, d))


_TIES = """WITH p AS (SELECT *, rank() OVER (PARTITION BY source, session_id, turn ORDER BY score DESC) AS start, count(*) OVER (PARTITION BY source, session_id, turn, score) AS ties FROM long),
    h AS (SELECT p.source, p.start, p.ties, CASE WHEN start > 20 THEN 0 ELSE list_sum(list_transform(range(start, least(start + ties - 1, 20) + 1), lambda r: 1.0::DOUBLE / log2(r + 1))) / ties END AS gain FROM p JOIN golds g ON g.session_id = p.session_id AND g.turn = p.turn AND g.gold = p.track_id)"""


@query(sql("long golds", f"{_TIES} SELECT s.source, {q('coalesce(sum(gain), 0) / (SELECT count(*) FROM golds)', '1e6')} AS ndcg FROM (SELECT DISTINCT source FROM long) s LEFT JOIN h ON h.source = s.source GROUP BY s.source"))
def tie_aware_ndcg(spark, d):
    return ev.tie_aware_ndcg(long(spark, d), fx.golds(spark, d))


_MASKS = "m AS (SELECT g.session_id, g.turn, " + ", ".join(f"coalesce(max((l.source = '{n}')::INT), 0) AS \"{n}\"" for n in NAMES) + " FROM golds g LEFT JOIN long l ON l.session_id = g.session_id AND l.turn = g.turn AND l.track_id = g.gold GROUP BY ALL)"


def _loo(groups):
    every = sorted({n for g in groups.values() for n in g})
    quoted = lambda names: "greatest(0, 0" + "".join(f', "{n}"' for n in names) + ")"
    out = []
    for name, own in groups.items():
        rest = [n for n in every if n not in own]
        out.append(f"SELECT '{name}' AS name, {q(f'avg({quoted(own)})', '1e6')} AS recall, sum({quoted(own)} * (1 - {quoted(rest)}))::BIGINT AS unique_hits, {q(f'avg({quoted(every)}) - avg({quoted(rest)})', '1e6')} AS delta FROM m")
    return sql("long golds", f"WITH {_MASKS} " + " UNION ALL ".join(out))


_SINGLE = {n: [n] for n in NAMES}
_FAMILY = {"behavioural": ["cooc", "transition"], "entity": ["album"]}


def _masks(spark, d):
    """ev.hit_masks of the union's sources: a row's own track is its gold, so that each source's lists show their hits by themselves."""
    own = {"cooc": cooc_lists(spark, d), "transition": successor_lists(spark, d)}
    ranks = {"cooc": lambda x: (x["rank"] <= 10) & (x["score"] >= 2), "transition": lambda x: F.lit(True), "album": lambda x: x["rank"] <= 10}  # as in long()
    own["album"] = entity_lists(spark, d, "albums", own=True)
    found = lambda n: F.exists("top", lambda x: (x["track_id"] == F.col("track_id")) & ranks[n](x))
    hits = [lists.filter(found(n)).select(*ROW, F.lit(n).alias("source")) for n, lists in own.items()]
    by = reduce(DataFrame.unionByName, hits).groupBy(*ROW).agg(*[F.max((F.col("source") == n).cast("int")).alias(n) for n in NAMES])
    return fx.golds(spark, d).join(by, ROW, "left").fillna(0, subset=NAMES)


@query(_loo(_SINGLE))
def leave_one_out(spark, d):
    return ev.leave_one_out(_masks(spark, d), _SINGLE)


@query(_loo(_FAMILY))
def family_complementarity(spark, d):
    return ev.leave_one_out(_masks(spark, d), _FAMILY)


_UNION = "u AS (SELECT session_id, turn, track_id, row_number() OVER (PARTITION BY session_id, turn ORDER BY a.position, a.rank, track_id) AS place FROM (SELECT session_id, turn, track_id, min({'position': position, 'rank': rank}) AS a FROM long GROUP BY ALL)), ur AS (SELECT g.session_id, g.turn, min(CASE WHEN u.track_id = g.gold THEN place END) AS pool FROM golds g LEFT JOIN u ON u.session_id = g.session_id AND u.turn = g.turn GROUP BY ALL)"


@query(sql("long ranks", f"""WITH {_UNION}, j AS (SELECT r.rank, ur.pool, coalesce(r.rank <= 5, FALSE) AS placed, CASE WHEN r.rank <= 5 THEN 1.0 / log2(r.rank + 1) ELSE 0 END AS g FROM ranks r JOIN ur USING (session_id, turn))
    SELECT {q('avg((pool IS NULL)::INT)', '1e6')} AS retrieval_miss, {q('avg((pool IS NOT NULL AND NOT placed)::INT)', '1e6')} AS rerank_miss, {q('avg(CASE WHEN placed THEN 1.0 - g ELSE 0 END)', '1e6')} AS ordering_loss, {q('avg(g)', '1e6')} AS ndcg FROM j"""))
def error_decomposition(spark, d):
    pool = _masks(spark, d).select(*ROW, F.when(F.greatest(*NAMES) > 0, 1).alias("rank"))  # the loss asks whether the pool has the gold, not where
    return ev.error_parts(pool, _places(spark, d), 5)


_ROOT = "WITH a AS (SELECT g.session_id, g.turn, max((l.track_id = g.gold)::INT) AS w, max((l.track_id = g.gold AND l.source <> 'transition')::INT) AS o FROM golds g LEFT JOIN long l ON l.session_id = g.session_id AND l.turn = g.turn GROUP BY ALL)"


@query(sql("long golds", f"{_ROOT} SELECT {q(q('avg(coalesce(w, 0))', '1e6') + ' - ' + q('avg(coalesce(o, 0))', '1e6'), '1e6')} AS delta_recall_all FROM a"))
def ablation_delta(spark, d):
    masks = _masks(spark, d)
    share = lambda names: ev.mean(F.greatest(F.lit(0), *names)).alias("recall_all")
    both = masks.agg(F.struct(share(NAMES)).alias("a"), F.struct(share([n for n in NAMES if n != "transition"])).alias("b"))  # one pass over the masks
    return both.select(quantised(F.col("a.recall_all") - F.col("b.recall_all"), 1e6).alias("delta_recall_all"))


# -- responses and predictions ------------------------------------------------------------------------

_SPLIT = r"string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')"
_GRAMS = f"WITH t AS (SELECT list_filter({_SPLIT}, lambda x: x <> '') AS t FROM conversations WHERE role = 'assistant'), g AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM t)"


@query(f"{_GRAMS} SELECT {q('count(DISTINCT g) / count(*)', '1e6')} AS distinct_2 FROM g")
def distinct2(spark, d):
    return ev.distinct_n(tables.scan(spark, d, "conversations").filter("role = 'assistant'"), "text", 2)


@query(sql("cooc_top", f"SELECT {q('count(DISTINCT track_id) / (SELECT count(*) FROM part)', '1e6')} AS diversity FROM cooc_top"))
def catalog_diversity(spark, d):
    return ev.catalog_diversity(_cooc(spark, d), fx.catalog(spark, d))


@query(sql("disc cooc_top", f"""{_GRAMS}, x AS (SELECT (SELECT {q('avg(' + _DISC.format(k=20) + ')', '1e6')} FROM disc) AS n, (SELECT {q('count(DISTINCT track_id) / (SELECT count(*) FROM part)', '1e6')} FROM cooc_top) AS c, (SELECT {q('count(DISTINCT g) / count(*)', '1e6')} FROM g) AS s)
    SELECT {q('0.0 + 0.5::DOUBLE * n + 0.1::DOUBLE * c + 0.1::DOUBLE * s + 0.3::DOUBLE * ((4.0::DOUBLE - 1) / 4)', '1e6')} AS composite FROM x"""))
def composite_score(spark, d):
    both = ndcg_row_mean(spark, d).join(F.broadcast(catalog_diversity(spark, d))).join(F.broadcast(distinct2(spark, d)))
    return both.select(ev.composite(F.col("ndcg_20"), F.col("diversity"), F.col("distinct_2"), F.lit(4.0)).alias("composite"))


def _top_lists(spark, d):
    """tables.top_lists of the transitions, whose rows have their candidates as arrays in order."""
    return successor_lists(spark, d).select(*ROW, F.col("top.track_id").alias("tracks"))


def _predictions(spark, d):
    lists = _top_lists(spark, d)
    users = tables.scan(spark, d, "orders", ["o_orderkey", "o_custkey"]).select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"))
    own = lists.join(users, "session_id").select("session_id", "user_id", F.col("turn").alias("turn_number"), F.col("tracks").alias("predicted_track_ids"), F.lit("ok").alias("predicted_response"))
    target = fx.golds(spark, d).join(users, "session_id").select("session_id", F.col("turn").alias("turn_number"), "user_id")
    return own, target


@query(sql("trans_top golds", """SELECT session_id, turn AS turn_number, 'wrong number of tracks' AS fault FROM trans_top GROUP BY ALL HAVING count(*) <> 20
    UNION ALL SELECT session_id, turn, 'missing' FROM golds g WHERE NOT EXISTS (SELECT 1 FROM trans_top t WHERE t.session_id = g.session_id AND t.turn = g.turn)"""))
def validate_top20(spark, d):
    own, target = _predictions(spark, d)
    return tables.prediction_faults(own, target, fx.catalog(spark, d))


@query(sql("trans_top", "SELECT session_id, turn, list(track_id ORDER BY rank) AS tracks FROM trans_top GROUP BY ALL"))
def top20_lists(spark, d):
    return _top_lists(spark, d)


@query(sql("album_top trans_top", """SELECT session_id, turn, track_id, row_number() OVER (PARTITION BY session_id, turn ORDER BY position, rank) AS place FROM (SELECT session_id, turn, track_id, 0 AS position, rank FROM album_top UNION ALL SELECT session_id, turn, track_id, 1, rank FROM trans_top)
    QUALIFY row_number() OVER (PARTITION BY session_id, turn, track_id ORDER BY position, rank) = 1""").replace("SELECT session_id, turn, track_id, row_number() OVER (PARTITION BY session_id, turn ORDER BY position, rank) AS place FROM (", "SELECT session_id, turn, track_id, row_number() OVER (PARTITION BY session_id, turn ORDER BY position, rank) AS place FROM (SELECT * FROM (", 1) + ")")
def source_override(spark, d):
    """The union of two sources, the first replaced by the albums of the history."""
    sources = union.override({"first": None, "second": successor_lists(spark, d)}, "first", entity_lists(spark, d, "albums"))  # what is replaced is not made
    return union.listed_union(sources)


@query(sql("trans_top", "SELECT session_id, turn, track_id, rank FROM trans_top WHERE rank <= 5"))
def emit_top(spark, d):
    """The first five of each row: a limit per row, by the score and then the track."""
    first = successor_lists(spark, d).withColumn("top", F.slice("top", 1, 5))  # in order already: the counts are exact
    return retrieve.listed(first, "track_id", "rank")
