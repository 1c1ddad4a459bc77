"""Candidates stay where their lists are: what is dealt between tasks are plays, rows and lists, never single candidates."""

import pytest
from pyspark.sql import functions as F

from tessera import queries as registry
from tessera import store

LISTED = [
    "transition_topk", "transition_probability", "labels", "year_diff", "metadata_features", "positive_rows", "same_entity_history_counts", "rank_family", "emit_top", "tag_overlap_history",
    "tag_overlap_profile",
]


@pytest.mark.parametrize("name", LISTED)
def test_no_exchange_follows_the_candidates(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString().split("\n")
    spread = next(i for i, line in enumerate(plan) if "Generate explode(top" in line)
    assert not any("Exchange" in line or "Join" in line or "Window" in line or "Aggregate" in line for line in plan[:spread])


def test_width_follows_the_input(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).write.parquet(path)
    df = spark.read.parquet(path)
    assert store.width(df, 1 << 30) == 4 and store.width(df.groupBy("id").agg(F.count(F.lit(1))), 500) > 4
    assert store.width(spark.createDataFrame([(1,)], "id long")) == 4


def test_unknown_tracks_of_predictions_are_found(spark):
    from tessera.sources import tables

    catalog = spark.createDataFrame([(i,) for i in range(30)], "track_id long")
    target = spark.createDataFrame([(1, 2, 7), (2, 2, 7)], "session_id long, turn_number int, user_id long")
    lists = [(1, 2, 7, list(range(20)), "ok"), (2, 2, 7, [*range(18), 99, None], "ok")]
    own = spark.createDataFrame(lists, "session_id long, turn_number int, user_id long, predicted_track_ids array<long>, predicted_response string")
    assert [tuple(r) for r in tables.prediction_faults(own, target, catalog).collect()] == [(2, 2, "unknown track")]


@pytest.mark.parametrize("last", [False, True])
def test_entity_lists_are_the_joins(spark, monkeypatch, last):
    from tessera.operators import retrieve, turns

    catalog = spark.createDataFrame([(i, [f"a{i % 7}"]) for i in range(200)], "track_id long, artists array<string>")
    t = spark.createDataFrame([(s, i, (s * 13 + i * 29) % 210) for s in range(20) for i in range(1, 6)], "session_id long, turn int, track_id long")
    want = (retrieve.last_entity if last else retrieve.history_entity)(turns.history(t), catalog, "artists", 5, single=True)
    lists = retrieve.entity_lists(t, catalog, "artists", 5, last)
    key = lambda df: sorted(tuple(r) for r in df.select("session_id", "turn", "track_id", "score", "rank").collect())
    assert key(retrieve.listed(lists, "track_id", "score", "rank")) == key(want)
    plan = lists._jdf.queryExecution().sparkPlan().toString()
    assert "array_except" in plan and plan.split("array_except")[0].count("SortMergeJoin") == 0
    monkeypatch.setattr(retrieve, "SENT", 10)
    assert retrieve.entity_lists(t, catalog, "artists", 5, last) is None


def test_override_makes_no_replaced_source(spark, sf):
    plan = registry.QUERIES["source_override"](spark, sf)._jdf.queryExecution().sparkPlan().toString().split("Join", 1)[0]
    assert "Window" not in plan and "Aggregate" not in plan


def test_packed_neighbours_come_back():
    import numpy as np

    from tessera.operators import neighbours

    rnd = np.random.default_rng(3)
    for size, most, kinds in ((1, 5, 1), (300, 40_000, 5), (300, 1 << 40, 3), (1000, 1000, 2)):
        own = np.unique(np.stack([rnd.integers(-5, most, size), rnd.integers(-1, kinds, size)]), axis=1)
        n = rnd.integers(1, 70_000 if size > 1 else 2, own.shape[1])
        got = neighbours.unpack(neighbours.pack(own[0], own[1], n))
        assert sorted(zip(*[x.tolist() for x in got])) == sorted(zip(own[0].tolist(), own[1].tolist(), n.tolist()))


def test_neighbours_of_long_sessions_and_small_batches(spark, monkeypatch):
    """Sums turn by turn, for sessions too long to spread, are those of the spread; a task's batches change nothing."""
    import random

    import numpy as np

    from tessera.operators import neighbours

    rnd = random.Random(9)
    near = {a: neighbours.pack(*(np.array(x) for x in zip(*[(b, b % 3, 1 + (a * b) % 4) for b in range(40) if (a + b) % 3]))) for a in range(40)}
    sizes = [1, 2, 9, 30, 1, 4]
    ends = np.cumsum([0, *sizes])
    track = np.array([rnd.randrange(40) for _ in range(ends[-1])])
    turn, kinds = np.concatenate([np.arange(n) for n in sizes]), np.repeat([0, 1, 2, 0, 1, 2], sizes)
    lists = [None if rnd.random() < 0.1 else near[a] for a in track.tolist()]
    show = lambda r: sorted(zip(*[x.tolist() for x in r]))
    whole = show(neighbours._sessions(turn, track, kinds, lists, ends, 5))
    assert len(whole) > 100
    for most in (1, 300):
        monkeypatch.setattr(neighbours, "ENTRIES", most)
        assert show(neighbours._sessions(turn, track, kinds, lists, ends, 5)) == whole


@pytest.mark.parametrize("name", ["cooc_track_topk", "cooc_parts_topk", "ndcg_row_mean", "catalog_diversity"])
def test_neighbours_are_dealt_as_lists(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 2 and "cooc_fold" not in plan


def test_equal_queries_are_searched_once(spark, monkeypatch):
    from tessera.operators import blocks

    asked = []
    plain = blocks.met
    monkeypatch.setattr(blocks, "met", lambda q, *rest: asked.append(q.count()) or plain(q, *rest))
    queries = spark.createDataFrame([(i, t, 1.0) for i in range(50) for t in (["x", "y"] if i % 2 else ["y"])], "id long, term string, w double")
    rows = spark.createDataFrame([(i, t, 1.0 + i) for i in range(9) for t in ("x", "y")], "id long, term string, w double")
    got = blocks.by_terms(queries, rows, 3, "id", "id").collect()
    assert asked == [2] and len(got) == 150
    assert {(r["r__id"], r["rank"]) for r in got} == {(8, 1), (7, 2), (6, 3)} and {r["score"] for r in got if r["q__id"] % 2} == {18.0, 16.0, 14.0}


@pytest.mark.parametrize("name", ["leave_one_out", "family_complementarity", "error_decomposition", "ablation_delta"])
def test_hits_are_found_in_lists(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "explode(top" not in plan and "position" not in plan.replace("array_position", "")


@pytest.mark.parametrize("name", ["history_state", "history_name_counts", "history_pair_counts"])
def test_histories_are_made_where_sessions_lie(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("\n")
    spread = next(i for i, line in enumerate(plan) if "Generate explode(plays" in line)
    assert not any("Exchange" in line for line in plan[:spread])


def test_equal_rows_are_searched_once_where_some_are_skipped(spark, monkeypatch):
    """Kinds of queries meet kinds of rows, whose ids come back in order; whole matrices score as posting lists do."""
    import numpy as np
    import pandas as pd

    from tessera.operators import blocks

    met = []
    plain = blocks.met
    monkeypatch.setattr(blocks, "met", lambda q, r, *rest, **more: met.append((q.count(), r.count())) or plain(q, r, *rest, **more))
    queries = spark.createDataFrame([(i, t, 1.0) for i in range(40) for t in (["x", "y", f"n{i}"] if i % 2 else ["y"])], "id long, term string, w double")
    rows = spark.createDataFrame([(i, t, 1.0 + i % 3) for i in range(30) for t in ("x", "y")], "id long, term string, w double")
    skip = spark.createDataFrame([(i, 2 + 3 * j) for i in range(40) for j in range(i % 3)], "id long, doc long")
    got = blocks.by_terms(queries, rows.withColumnRenamed("id", "doc"), 4, "id", "doc", skip)
    assert {(r["q__id"], r["r__doc"], r["rank"]) for r in got.collect()} == {(i, 2 + 3 * (i % 3 + j), j + 1) for i in range(40) for j in range(4)}
    assert met == [(2, 3)]
    rnd = np.random.default_rng(1)
    own, other = (pd.DataFrame({"t": [rnd.choice(30, 12, replace=False) for _ in range(n)], "w": [rnd.random(12) for _ in range(n)]}) for n in (300, 70))
    whole = np.stack(list(blocks._totals(own, other)))
    monkeypatch.setattr(blocks, "DENSE", 0)
    assert np.allclose(whole, np.stack(list(blocks._totals(own, other))), rtol=0, atol=1e-12)


@pytest.mark.parametrize("weighted", [False, True])
def test_cooc_entity_lists_are_the_joins(spark, monkeypatch, weighted):
    """Few entities, ties, unknown tracks, repeats and entities of one track; one batch or many."""
    from tessera.operators import counts, entities, retrieve, turns

    catalog = spark.createDataFrame([(i, [f"a{i % 7}" if i < 150 else f"b{i}"]) for i in range(200)], "track_id long, artists array<string>")
    t = spark.createDataFrame([(s, i, (s * 13 + i * i * 29) % 210) for s in range(40) for i in range(1, 7)], "session_id long, turn int, track_id long")
    pairs = counts.pairs(t.join(retrieve.members(catalog, "artists"), "track_id"), "entity")
    key = lambda df: sorted(tuple(r) for r in df.select("session_id", "turn", "track_id", "score", "rank").collect())
    want = key(retrieve.cooc_entities(turns.history(t), catalog, "artists", pairs, 9, weighted, single=True))
    lists = retrieve.cooc_entity_lists(t, catalog, "artists", pairs, 9, weighted)
    assert key(retrieve.listed(lists, "track_id", "score", "rank")) == want and len(want) > 500
    plan = lists._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.split("MapInArrow")[0].count("Join") == 0
    monkeypatch.setattr(entities, "CELLS", 1)
    assert key(retrieve.listed(retrieve.cooc_entity_lists(t, catalog, "artists", pairs, 9, weighted), "track_id", "score", "rank")) == want
    monkeypatch.setattr(retrieve, "PAIRS", 10)
    assert retrieve.cooc_entity_lists(t, catalog, "artists", pairs, 9, weighted) is None


def test_tags_meet_histories_in_lists(spark, sf):
    """No candidate is dealt out, and nothing as long as the catalog is sent to all tasks."""
    plan = registry.QUERIES["tag_chain_features"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    before = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and not any(x in before for x in ("Join", "Exchange", "Aggregate")) and plan.count("SortMergeJoin") >= 2


def test_candidates_of_rerankers_are_listed(spark, sf):
    """The rows to fit and score are those of the union, made once; what scores them deals out nothing."""
    from tessera.operators import features, rerank, union
    from tessera.plans import candidates, fixtures
    from tessera.plans import features as plans

    fused = plans._fused(spark, sf)
    p = union.provenance(candidates.long(spark, sf), plans._SOURCES)
    filled = p.select("session_id", "turn", "track_id", *[F.coalesce(1.0 / F.col(f"{n}_rank"), F.lit(0.0)).alias(n) for n in plans._SOURCES])
    want = features.labels(filled, fixtures.golds(spark, sf))
    rows = plans._training(fused)
    columns = ["session_id", "turn", "track_id", *plans._SOURCES, "label", "group_size"]
    assert sorted(map(tuple, rows.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    model = rerank.fitted(rows, plans._SOURCES, sample_rows=20, trees=2, leaves=4)
    best = rerank.best_listed(fused, model, plans._SOURCES, 5)
    names = ["session_id", "turn", "track_id", "score", "rank"]
    plain = rerank.ranked(rerank.scored(rows, model, plans._SOURCES).select(*names[:4]), 5)
    assert sorted(map(tuple, best.select(names).collect())) == sorted(map(tuple, plain.select(names).collect()))
    assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_copied_for_their_tokens(spark, monkeypatch):
    from tessera.operators import phrases

    names = spark.createDataFrame([("red sun",), ("sun",), ("red",), ("old red sun",), ("",)], "name string")
    texts = spark.createDataFrame([(1, "The old Red, SUN"), (2, "reds suns"), (3, None), (4, ""), (5, "red red sun sun")], "id long, text string")
    found = phrases.phrase_matches(texts, "id", "text", names)
    want = sorted([(1, "red sun"), (1, "sun"), (1, "red"), (1, "old red sun"), (5, "red"), (5, "sun"), (5, "red sun")])
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Join", "Generate"))
    monkeypatch.setattr(phrases, "SENT", 5)
    assert sorted(map(tuple, phrases.phrase_matches(texts, "id", "text", names).collect())) == want
