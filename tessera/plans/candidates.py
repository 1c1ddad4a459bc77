"""Queries of the candidate sources over session histories, and of their union."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import norm_name
from tessera.operators import counts, retrieve, turns, union
from tessera.operators.turns import ROW
from tessera.plans import fixtures as fx
from tessera.plans.fixtures import q, sql
from tessera.registry import query
from tessera.store import dealt

_TOP = "row_number() OVER (PARTITION BY session_id, turn ORDER BY score DESC, track_id) AS rank"
_UNPLAYED = "NOT EXISTS (SELECT 1 FROM played p WHERE p.session_id = s.session_id AND p.turn = s.turn AND p.track_id = s.track_id)"


def cooc_lists(spark, d):
    t = fx.turns(spark, d)
    return retrieve.cooc_lists(t, counts.pairs(t, "track_id", by_fold=True, by=("a",)), F.col("session_id") % fx.FOLDS)


def _cooc(spark, d):
    return retrieve.listed(cooc_lists(spark, d), "track_id", "score", "rank")


@query(sql("cooc_top", "SELECT session_id, turn, track_id, score::BIGINT AS score, rank FROM cooc_top"))
def cooc_track_topk(spark, d):
    """Out-of-fold co-occurrence with the history: the flagship."""
    return _cooc(spark, d)


@query(sql("hist cooc next played", f"""WITH tr AS (SELECT a, b, count(*) AS n FROM next WHERE b IS NOT NULL GROUP BY ALL), both_ AS (SELECT a, b, n AS first, 0 AS second FROM cooc UNION ALL SELECT a, b, 0, n FROM tr)
    SELECT session_id, turn, track_id, first::BIGINT AS first, second::BIGINT AS second, score::BIGINT AS score, {_TOP} FROM (SELECT h.session_id, h.turn, t.b AS track_id, sum(first) AS first, sum(second) AS second, sum(first + second) AS score FROM hist h JOIN both_ t ON h.track_id = t.a GROUP BY ALL) s WHERE {_UNPLAYED} QUALIFY rank <= 20"""))
def cooc_parts_topk(spark, d):
    t = fx.turns(spark, d)
    return retrieve.cooc_parts(t, counts.pairs(t, "track_id"), counts.transitions(t))


def successor_lists(spark, d, *carry, about=None, more=None, then=None):
    """The rows of the transition source, each with its candidates as one array.

    more(turns) may add columns, of which plays carry those named; then(rows) may reckon with the plays before they go.
    """
    t = fx.turns(spark, d)
    own = turns.known(t if more is None else more(t), fx.catalog(spark, d))
    rows = turns.pasts(dealt(own, "session_id"), "known", *carry)
    rows = rows if then is None else then(rows)
    return retrieve.successor_lists(retrieve.latest_known(rows), counts.transitions(t), about=about)


def _transition(spark, d):
    return retrieve.listed(successor_lists(spark, d), "track_id", "score", "share", "rank")


@query(sql("trans_top", "SELECT session_id, turn, track_id, score, rank FROM trans_top"))
def transition_topk(spark, d):
    return _transition(spark, d).drop("share")


@query(sql("trans_top", f"SELECT session_id, turn, track_id, {q('share', '1e6')} AS share FROM trans_top"))
def transition_probability(spark, d):
    from tessera.functions.text import quantised

    return _transition(spark, d).select(*ROW, "track_id", quantised(F.col("share"), 1e6).alias("share"))


def _entity_sql(entity, source):
    rows = "hist" if source == "history" else "lastp"
    need = "hist lastp catalog played"
    return sql(need, f"""SELECT session_id, turn, track_id, score, {_TOP} FROM (SELECT h.session_id, h.turn, m.track_id, count(*) AS score FROM (SELECT DISTINCT session_id, turn, {entity} FROM {rows} JOIN catalog USING (track_id)) h
        JOIN catalog m ON m.{entity} = h.{entity} GROUP BY ALL) s WHERE {_UNPLAYED} QUALIFY rank <= 20""")


def entity_lists(spark, d, entity, last=False, own=False):
    """The rows' first tracks by the entities of their history: by lists that are sent, or by joins where those are too long."""
    lists = retrieve.entity_lists(fx.turns(spark, d), fx.catalog(spark, d), entity, last=last)
    if lists is not None:
        return lists
    by = (retrieve.last_entity if last else retrieve.history_entity)(fx.hist(spark, d), fx.catalog(spark, d), entity, single=True)
    joined = by.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("rank", "track_id", "score"))).alias("top"))
    return joined.join(fx.turns(spark, d).select(*ROW, "track_id"), ROW) if own else joined


def _entity(spark, d, entity, last=False):
    return retrieve.listed(entity_lists(spark, d, entity, last), "track_id", "score", "rank")


@query(_entity_sql("artist", "history"))
def history_artist(spark, d):
    return _entity(spark, d, "artists")


@query(_entity_sql("album", "history"))
def history_album(spark, d):
    return _entity(spark, d, "albums")


@query(_entity_sql("artist", "last"))
def last_artist(spark, d):
    return _entity(spark, d, "artists", last=True)


@query(_entity_sql("album", "last"))
def last_album(spark, d):
    return _entity(spark, d, "albums", last=True)


def _cooc_entity_sql(entity, weighted):
    weight = "plays * n" if weighted else "n"
    return sql("hist turns catalog played", f"""WITH x AS (SELECT DISTINCT session_id, {entity} AS e FROM turns JOIN catalog USING (track_id)), c AS (SELECT a.e AS a, b.e AS b, count(*) AS n FROM x a JOIN x b ON a.session_id = b.session_id AND a.e <> b.e GROUP BY ALL),
        o AS (SELECT session_id, turn, {entity} AS a, count(*) AS plays FROM hist JOIN catalog USING (track_id) GROUP BY ALL), es AS (SELECT session_id, turn, b AS e, sum({weight})::BIGINT AS score FROM o JOIN c USING (a) GROUP BY ALL),
        w AS (SELECT es.*, (SELECT count(*) FROM catalog k WHERE k.{entity} = es.e) AS size, coalesce(g.gone, 0) + 20 AS need FROM es LEFT JOIN (SELECT session_id, turn, count(*) AS gone FROM played GROUP BY ALL) g USING (session_id, turn)),
        v AS (SELECT *, sum(size) OVER (PARTITION BY session_id, turn ORDER BY score DESC RANGE UNBOUNDED PRECEDING) - sum(size) OVER (PARTITION BY session_id, turn, score) AS before FROM w)
        SELECT session_id, turn, track_id, score, {_TOP} FROM (SELECT v.session_id, v.turn, m.track_id, v.score FROM v JOIN catalog m ON m.{entity} = v.e WHERE v.before < v.need) s WHERE {_UNPLAYED} QUALIFY rank <= 20""")


def _entity_counts(spark, d, entity):
    named = fx.turns(spark, d).join(_named(spark, d, entity).select("track_id", F.explode(entity).alias("entity")), "track_id")
    return counts.pairs(named, "entity")


def _named(spark, d, entity):
    """The catalog, with artists by their normalised names."""
    c = fx.catalog(spark, d)
    return c.withColumn(entity, F.array_distinct(F.transform(entity, norm_name))) if entity == "artists" else c


def _cooc_entity(spark, d, entity, weighted):
    """By lists that are sent, or by joins where those are too long."""
    own, pairs = _named(spark, d, entity), _entity_counts(spark, d, entity)
    lists = retrieve.cooc_entity_lists(fx.turns(spark, d), own, entity, pairs, weighted=weighted)
    if lists is not None:
        return retrieve.listed(lists, "track_id", "score", "rank")
    return retrieve.cooc_entities(fx.hist(spark, d), own, entity, pairs, weighted=weighted, single=True)


@query(_cooc_entity_sql("album", False))
def cooc_album(spark, d):
    return _cooc_entity(spark, d, "albums", False)


@query(_cooc_entity_sql("artist", True))
def cooc_artist(spark, d):
    return _cooc_entity(spark, d, "artists", True)


# -- union --------------------------------------------------------------------------------------------

NAMES = ["cooc", "transition", "album"]


def long(spark, d):
    sources = {"cooc": _cooc(spark, d), "transition": _transition(spark, d), "album": history_album(spark, d)}
    return union.gather(sources, caps={"cooc": 10, "album": 10}, least={"cooc": 2})


@query(sql("long", "SELECT session_id, turn, track_id, row_number() OVER (PARTITION BY session_id, turn ORDER BY a.position, a.rank, track_id) AS place FROM (SELECT session_id, turn, track_id, min({'position': position, 'rank': rank}) AS a FROM long GROUP BY ALL)"))
def ordered_union(spark, d):
    return union.ordered_union(long(spark, d))


@query(sql("long", "SELECT session_id, turn, track_id, " + ", ".join(f"max((source = '{n}')::INT) AS {n}_present, max(rank) FILTER (source = '{n}') AS {n}_rank, max(score) FILTER (source = '{n}') AS {n}_score" for n in NAMES) + " FROM long GROUP BY ALL"))
def union_provenance(spark, d):
    return union.provenance(long(spark, d), NAMES)


@query(sql("long", f"SELECT session_id, turn, track_id, count(*) AS source_count, min(rank) AS best_rank, {q('avg(rank)')} AS mean_rank, max(score) AS max_score FROM long GROUP BY ALL"))
def union_meta(spark, d):
    return union.meta(long(spark, d))


@query(sql("long", f"SELECT session_id, turn, track_id, source, rank, coalesce({q('(score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-6)')}, 0) AS score_z FROM long WINDOW w AS (PARTITION BY session_id, turn)"))
def score_row_z(spark, d):
    return union.row_z(long(spark, d), "score").select(*ROW, "track_id", "source", "rank", "score_z")


@query(sql("long", f"SELECT session_id, turn, track_id, source, rank AS rank_miss0, {q('ln(1 + rank)')} AS rank_log1p, {q('1.0 / rank')} AS rank_inv FROM long"))
def rank_transforms(spark, d):
    return union.rank_forms(long(spark, d), "rank").select(*ROW, "track_id", "source", "rank_miss0", "rank_log1p", "rank_inv")


def _expand_sql():
    prov = "SELECT session_id, turn, track_id, " + ", ".join(f"max((source = '{n}')::INT) AS {n}_present, max(rank) FILTER (source = '{n}') AS {n}_rank, max(score) FILTER (source = '{n}') AS {n}_score" for n in NAMES) + " FROM long GROUP BY ALL"
    parts = []
    for n in NAMES:
        r, s = f"{n}_rank", f"{n}_score"
        parts += [f"{n}_present", f"coalesce({r}, 0) AS {r}_miss0", f"coalesce({q(f'ln(1 + {r})')}, 0) AS {r}_log1p", f"coalesce({q(f'1.0 / {r}')}, 0) AS {r}_inv",
                  f"coalesce({s}, 0) AS {s}_raw0", f"coalesce({q(f'({s} - avg({s}) OVER w) / (stddev_pop({s}) OVER w + 1e-6)')}, 0) AS {s}_z"]
    return sql("long", f"WITH p AS ({prov}) SELECT session_id, turn, track_id, {', '.join(parts)} FROM p WINDOW w AS (PARTITION BY session_id, turn)")


@query(_expand_sql())
def provenance_features(spark, d):
    return union.expand_provenance(union.provenance(long(spark, d), NAMES))


def _rrf_sql(rank):
    return f"""SELECT session_id, turn, track_id, rrf, row_number() OVER (PARTITION BY session_id, turn ORDER BY rrf DESC, best, track_id) AS place FROM (SELECT session_id, turn, track_id, {q(f'sum(1.0::DOUBLE / (60.0::DOUBLE + {rank}))', '1e8')} AS rrf, min({rank}) AS best FROM tied GROUP BY ALL)"""


_TIED = "WITH tied AS (SELECT *, rank() OVER (PARTITION BY session_id, turn, source ORDER BY score DESC) + (count(*) OVER (PARTITION BY session_id, turn, source, score) - 1) / 2.0::DOUBLE AS tied_rank FROM long) "


@query(sql("long", _TIED + _rrf_sql("rank::DOUBLE")))
def rrf_plain(spark, d):
    return union.rrf(long(spark, d))


@query(sql("long", _TIED + _rrf_sql("tied_rank")))
def rrf_tie_aware(spark, d):
    return union.rrf(union.tied_ranks(long(spark, d)), rank="tied_rank")


@query(sql("long", _TIED + "SELECT session_id, turn, track_id, source, tied_rank FROM tied"))
def tie_average_rank(spark, d):
    return union.tied_ranks(long(spark, d)).select(*ROW, "track_id", "source", "tied_rank")


@query(sql("catalog", r"SELECT track_id, trim(regexp_replace(lower(artist), '[^\p{L}\p{N}_]+', ' ', 'g')) AS name FROM catalog"))
def entity_index(spark, d):
    """Catalog entities by normalised name: an inverted index as a keyed table."""
    return fx.catalog(spark, d).select("track_id", F.explode("artists").alias("name")).select("track_id", norm_name(F.col("name")).alias("name"))
