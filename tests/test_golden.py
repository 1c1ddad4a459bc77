"""Small hand-made cases with known results, and invariants."""

import hashlib
import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import counts, evaluate, rerank, respond, retrieve, turns, union
from tessera.plans import policy, texts
from tessera.sources import tables


def ranks_of(spark, golds, lists):
    g = spark.createDataFrame([(i, 1, x) for i, x in enumerate(golds)], "session_id long, turn int, gold long")
    c = spark.createDataFrame([(i, 1, t, r) for i, own in enumerate(lists) for r, t in enumerate(own, 1)], "session_id long, turn int, track_id long, rank int")
    return g, c, evaluate.gold_ranks(g, c)


def test_recall_and_micro_precision(spark):
    _, _, r = ranks_of(spark, [1, 2, 3, 4], [[1, 9], [8, 2], [8, 9], [4, 7]])
    assert evaluate.recall(r, (None,)).first()[0] == 0.75
    assert evaluate.precision(r, (None,)).first()["micro_all"] == 0.375


def test_unknown_gold_is_a_miss(spark):
    _, _, r = ranks_of(spark, [-1], [[3]])
    assert evaluate.recall(r, (20,)).first()[0] == 0


def test_ndcg_and_losses_sum_to_one(spark):
    g, c, r = ranks_of(spark, [1, 2, 3, 4], [[1, 9], [8, 2], [8, 9], [7, 6]])
    want = (1 + 1 / math.log2(3)) / 4
    assert evaluate.ndcg(r).first()["ndcg_20"] == pytest.approx(want, abs=1e-6)
    pool = evaluate.gold_ranks(g, spark.createDataFrame([(0, 1, 1, 1), (1, 1, 2, 1), (3, 1, 4, 1)], "session_id long, turn int, track_id long, rank int"))
    parts = evaluate.error_parts(pool, r).first()
    assert parts["retrieval_miss"] == 0.25 and parts["rerank_miss"] == 0.25
    assert sum(parts) == pytest.approx(1, abs=1e-5)


def long_of(spark, **sources):
    frames = {n: spark.createDataFrame([(0, 1, t, i, float(s)) for i, (t, s) in enumerate(own, 1)], "session_id long, turn int, track_id long, rank int, score double") for n, own in sources.items()}
    return union.gather(frames)


def test_rrf(spark):
    for second in ([(2, 1), (3, 1)], [(3, 1), (2, 1)]):
        both = long_of(spark, a=[(1, 2), (2, 1)], b=[(2, 2), (3, 1)])
        assert [r["track_id"] for r in union.rrf(both).orderBy("place").collect()] == [2, 1, 3]
        tied = union.tied_ranks(long_of(spark, a=[(1, 1), (2, 1)], b=second))
        assert [r["track_id"] for r in union.rrf(tied, rank="tied_rank").orderBy("place").collect()] == [2, 1, 3]


def test_tied_source_ndcg(spark):
    golds = spark.createDataFrame([(0, 1, 1)], "session_id long, turn int, gold long")
    got = evaluate.tie_aware_ndcg(long_of(spark, a=[(9, 1), (1, 1)]), golds).first()["ndcg"]
    assert got == pytest.approx((1 + 1 / math.log2(3)) / 2, abs=1e-6)


def test_ordered_union_and_cap_before_threshold(spark):
    out = union.ordered_union(long_of(spark, a=[(9, 3), (2, 2), (7, 1)], b=[(7, 2), (3, 1)])).orderBy("place")
    assert [r["track_id"] for r in out.collect()] == [9, 2, 7, 3]
    frame = spark.createDataFrame([(0, 1, t, i, s) for i, (t, s) in enumerate([(1, 1.0), (2, 9.0), (3, 8.0)], 1)], "session_id long, turn int, track_id long, rank int, score double")
    kept = union.gather({"a": frame}, caps={"a": 2}, least={"a": 5}).collect()
    assert [(r["track_id"], r["rank"]) for r in kept] == [(2, 2)]


def test_feature_sets(spark):
    df = spark.createDataFrame([(0, 1, 5, 1, 1.0, 2.0, 3.0)], "session_id long, turn int, track_id long, label int, a double, src_x double, src_y double")
    assert union.feature_set(df, "provenance_only").columns[-2:] == ["src_x", "src_y"]
    assert "src_x" not in union.feature_set(df, "no_provenance").columns


def test_diversity_selection():
    texts, share = respond.choose([["a b", "a a"], ["a b", "c d"]], [0, 1])
    assert texts == ["a b", "c d"] and share == 1.0


def test_vector_cache(spark):
    cache = spark.createDataFrame([("a", [1.0, 2.0])], "key string, vector array<double>")
    rows = spark.createDataFrame([("a",), ("b",)], "key string")
    out = tables.cached_vectors(rows, cache, "key", lambda df: df.withColumn("vector", F.array(F.lit(9.0), F.lit(9.0))))
    assert {r["key"]: r["vector"] for r in out.collect()} == {"a": [1.0, 2.0], "b": [9.0, 9.0]}


def prediction(spark, n=20, user="u", ids=None):
    return spark.createDataFrame([("s", user, 1, ids or [f"t{i}" for i in range(n)], "hi")], "session_id string, user_id string, turn_number int, predicted_track_ids array<string>, predicted_response string")


def test_prediction_rules(spark, tmp_path):
    target = spark.createDataFrame([("s", 1, "u")], "session_id string, turn_number int, user_id string")
    catalog = spark.createDataFrame([(f"t{i}",) for i in range(30)], "track_id string")
    faults = lambda p: {r["fault"] for r in tables.prediction_faults(p, target, catalog).collect()}
    assert faults(prediction(spark)) == set()
    assert faults(prediction(spark, 19)) == {"wrong number of tracks"}
    assert faults(prediction(spark, user="v")) == {"another user"}
    assert faults(prediction(spark, ids=["t1"] * 20)) == {"repeated track"}
    assert faults(prediction(spark, ids=["zz"] + [f"t{i}" for i in range(19)])) == {"unknown track"}
    assert faults(prediction(spark).limit(0)) == {"missing"}
    with pytest.raises(tables.BadPredictions):
        tables.prediction_faults(prediction(spark).withColumn("more", F.lit(1)), target, catalog)
    path = str(tmp_path / "out.zip")
    tables.write_predictions(prediction(spark), target, catalog, path)
    with zipfile.ZipFile(path) as z:
        assert z.namelist() == ["prediction.json"] and len(json.loads(z.read("prediction.json"))) == 1
    with pytest.raises(tables.BadPredictions):
        tables.write_predictions(prediction(spark, 19), target, catalog, path)


def test_artifacts_and_completion(spark, tmp_path):
    path, calls = tables.artifact_path(str(tmp_path), "retriever", "a", "c", "oof", "devset"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert not tables.is_complete(path)
    assert tables.resume(spark, path, build, {"sources": ["a"]}).count() == 3
    assert tables.resume(spark, path, build, {}).count() == 3 and len(calls) == 1
    assert tables.file_hash(f"{path}/manifest.json")["bytes"] > 0


def test_csv_and_jsonl(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "b int, a string"), spark.createDataFrame([(2.5,)], "c double")
    tables.write_csv([a, b], str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["a", "b", "c"]
    tables.write_jsonl(a, str(tmp_path / "j"))
    assert tables.read_jsonl(spark, str(tmp_path / "j"), "b int, a string").collect() == a.collect()


def test_protocol():
    with pytest.raises(policy.BrokenProtocol):
        policy.check_scope(policy.FitScope(("train", "devset"), True, "full", devset=True), "devset")
    policy.check_scope(policy.FitScope(("train", "devset"), True, "out_of_fold", devset=True), "devset")
    with pytest.raises(policy.BrokenProtocol):
        policy.check_union({"sources": ["b", "a"]}, ["a", "b"])
    with pytest.raises(policy.BrokenProtocol):
        policy.check_parity([{"sources": [{"name": "a", "max_candidates": 1}]}, {"sources": [{"name": "a"}]}])
    joined = policy.compose([policy.FitScope(("train",), True, "out_of_fold"), policy.FitScope(("dev",))])
    assert joined.splits == ("dev", "train") and joined.labels and joined.fold_policy == "mixed"
    assert policy.resolve("x", {"max_candidates": 5}, {"max_candidates": 7, "other": 1}).max_candidates == 7
    assert policy.width("all") == 0 and policy.width(None) == 500 and policy.width(7) == 7


def test_strict_turns_and_alignment(spark):
    msgs = spark.createDataFrame([(1, 0, "user", "q", 1), (1, 1, "music", "t", 1), (1, 2, "user", "q2", 2)], "session_id long, pos int, role string, content string, turn int")
    assert turns.labeled_turns(msgs).count() == 1
    with pytest.raises(Exception, match="lacks its query or its gold"):
        turns.labeled_turns(msgs, strict=True).collect()
    a, b = spark.createDataFrame([("x",), ("y",)], "key string"), spark.createDataFrame([("x",)], "key string")
    turns.assert_aligned(a.filter("key = 'x'"), b)
    with pytest.raises(turns.MisalignedRows):
        turns.assert_aligned(a, b)


def test_out_of_fold_is_total_less_own(spark):
    t = spark.createDataFrame([(s, i, x, s % 2) for s in range(6) for i, x in enumerate([1, 2, 3 + s % 2], 1)], "session_id long, turn int, track_id long, fold long")
    by_fold = counts.pairs(t, "track_id", by_fold=True)
    got = {(r["a"], r["b"], r["fold"]): r["n"] for r in counts.out_of_fold(by_fold, 2).collect()}
    for fold in (0, 1):
        want = {(r["a"], r["b"], fold): r["n"] for r in counts.pairs(t.filter(F.col("fold") != fold), "track_id").collect()}
        assert {k: v for k, v in got.items() if k[2] == fold} == want


def test_transitions_bridge_unknown_tracks(spark):
    t = spark.createDataFrame([(1, 1, 5), (1, 2, 99), (1, 3, 5), (1, 4, 6)], "session_id long, turn int, track_id long")
    known = spark.createDataFrame([(5,), (6,)], "track_id long")
    assert {(r["a"], r["b"], r["n"]) for r in counts.transitions(t, catalog=known).collect()} == {(5, 5, 1), (5, 6, 1)}


def test_unknown_last_track(spark):
    """The last track's artists are none if the catalog lacks it; successors fall back to the last known track."""
    hist = spark.createDataFrame([(1, 3, 1, 5), (1, 3, 2, 99)], "session_id long, turn int, h_turn int, track_id long")
    catalog = spark.createDataFrame([(5, ["a"]), (6, ["a"])], "track_id long, artists array<string>")
    trans = spark.createDataFrame([(5, 6, 2)], "a long, b long, n long")
    assert retrieve.last_entity(hist, catalog, "artists").count() == 0
    assert [r["track_id"] for r in retrieve.successors(hist, trans, catalog).collect()] == [6]


def test_single_entity_pruning_is_exact(spark):
    catalog = spark.createDataFrame([(i, [f"a{i % 7}"]) for i in range(200)], "track_id long, artists array<string>")
    t = spark.createDataFrame([(s, i, (s * 13 + i * 29) % 200) for s in range(20) for i in range(1, 6)], "session_id long, turn int, track_id long")
    hist, index = turns.history(t), retrieve.members(catalog, "artists")
    scores = hist.join(index, "track_id").groupBy("session_id", "turn", "entity").agg(F.count(F.lit(1)).alias("score"))
    a, b = (retrieve.expand(scores, index, hist, 5, single=s).select("session_id", "turn", "track_id", "rank").collect() for s in (True, False))
    assert sorted(a) == sorted(b) and len(a) == 20 * 4 * 5


def test_played_never_returns_and_ranks_are_dense(spark, sf):
    from tessera.plans import candidates, fixtures

    out = candidates.history_album(spark, sf)
    assert out.join(turns.played(fixtures.hist(spark, sf)), ["session_id", "turn", "track_id"], "left_semi").count() == 0
    assert out.groupBy("session_id", "turn").agg((F.max("rank") == F.count(F.lit(1))).alias("ok")).filter("NOT ok").count() == 0


def test_names_and_bytes(spark):
    row = spark.createDataFrame([("Ｆｏｏ-Straße!",)], "s string").select(tx.norm_name_exact("s").alias("x")).first()
    assert row["x"] == "foo strasse"
    letters = {v: k for k, v in tx._byte_letters().items()}
    assert tx.repair("".join(letters[b] for b in "né à".encode())) == "né à" and tx.repair("caf" + letters[0xC3] + letters[0xA9] + " 中→") == "café 中→" and tx.repair("plain é→") == "plain \ufffd→"
    df = spark.createDataFrame([("think</think> hi ", "R&B of the 90s")], "a string, b string")
    assert df.select(tx.after_think(F.col("a"))).first()[0] == "hi"
    assert df.select(tx.intent_terms(F.col("b"))).first()[0] == ["r b", "90s", "r&b"]


def test_lambdarank_orders_by_the_signal(spark):
    rows = [(s, 1, t, int(t == s % 5), float(t == s % 5) + (s * 7 + t) % 3 / 10, (s + t) % 4 / 4.0) for s in range(80) for t in range(5)]
    df = spark.createDataFrame(rows, "session_id long, turn int, track_id long, label int, x double, y double")
    scored = rerank.lambdarank(df.filter("session_id < 50"), df.filter("session_id >= 50"), ["x", "y"], trees=5, leaves=4, least=2)
    top = rerank.ranked(scored, 1)
    assert top.filter("label = 1").count() == 30


def test_generate_hook(spark):
    df = spark.createDataFrame([("a",), ("b",)], "p string")
    assert {r["response"] for r in respond.generate(df, "p", lambda xs: [x + "!" for x in xs]).collect()} == {"a!", "b!"}
    assert respond.encode(df, "p", lambda xs: [[float(len(x))] for x in xs]).first()["vector"] == [1.0]


def test_strata_collapse(spark):
    rows = [(i, "train", "A" if i < 9 else "B", "x" if i % 2 else "y") for i in range(10)]
    df = spark.createDataFrame(rows, "session_id long, split string, category string, kind string")
    got = {r["session_id"]: r["stratum"] for r in turns.collapse_strata(df, ["split", "category", "kind"], 4).collect()}
    assert got[9] == "train" and got[0] == "train|A|y"
    folds = turns.assign_folds(spark.createDataFrame([(i, "a") for i in range(10)], "session_id long, stratum string"), 5)
    assert {r["count"] for r in folds.groupBy("fold").count().collect()} == {2}


def test_diverse_select_takes_the_best_of_thirty_orders(spark, tmp_path):
    rnd = random.Random(3)
    said = [(c, t, " ".join(f"w{rnd.randint(0, 60)}" for _ in range(rnd.randint(2, 6)))) for c in range(40) for t in (2, 4, 6)]
    spark.createDataFrame([(c, t, "assistant", x) for c, t, x in said], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    keys, options = [c * 100 + t for c, t, _ in said], [[x for other, _, x in said if other == c] for c, _, _ in said]
    orders = [sorted(range(len(keys)), key=lambda i: hashlib.md5(f"{trial}:{keys[i]}".encode()).hexdigest()) for trial in range(30)]
    chosen = [respond.choose(options, order) for order in orders]
    best, share = max(chosen, key=lambda x: x[1])
    assert share > max(x[1] for x in chosen[:4])
    assert {r["key"]: r["option"] for r in texts.diverse_select(spark, str(tmp_path)).collect()} == dict(zip(keys, best))


# -- searches in blocks -----------------------------------------------------------------------------------


def test_block_search_is_exact_at_any_block_size(spark, monkeypatch):
    from tessera.operators import blocks

    rnd = random.Random(2)
    rows = [(i, f"t{rnd.randint(0, 15)}", rnd.random()) for i in range(80) for _ in range(4)] + [(90 + i, "t1", 0.5) for i in range(5)]
    rows = [(i, t, w) for (i, t), w in {(i, t): w for i, t, w in rows}.items()]
    asked = [(q, f"t{rnd.randint(0, 17)}", 1.0 + rnd.randint(0, 2)) for q in range(15) for _ in range(3)]
    skip = [(q, rnd.randrange(95)) for q in range(15) for _ in range(10) if q % 2]
    want = set()
    for q in {q for q, _, _ in asked}:
        scores = {}
        for r in {r for r, _, _ in rows} - {r for x, r in skip if x == q}:
            total = sum(w * v for x, t, w in asked if x == q for y, u, v in rows if y == r and u == t)
            if total:
                scores[r] = total
        want |= {(q, r, i) for i, (r, _) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 7), x[0]))[:6], 1)}
    frames = spark.createDataFrame(asked, "q long, term string, w double"), spark.createDataFrame(rows, "r long, term string, w double"), spark.createDataFrame(skip, "q long, r long")
    for queries, lines in ((4096, 16_384), (4, 10)):
        monkeypatch.setattr(blocks, "QUERIES", queries)
        monkeypatch.setattr(blocks, "ROWS", lines)
        got = blocks.by_terms(frames[0], frames[1], 6, "q", "r", frames[2])
        assert {(r["q__q"], r["r__r"], r["rank"]) for r in got.collect()} == want
    assert blocks.by_terms(frames[0].limit(0), frames[1], 6, "q", "r").count() == 0 == blocks.by_terms(frames[0], frames[1].limit(0), 6, "q", "r").count()


def test_vector_search_leaves_out_null_and_ragged_vectors(spark):
    from tessera.functions import vectors
    from tessera.operators import blocks

    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 0.5]), ("c", None), ("d", [1.0]), ("e", [-1.0, 0.0])], "id string, v array<double>")
    assert vectors.modal_size(df, "v") == 2
    got = blocks.by_vectors(df, df, 2, "id", "id", "v", 2)
    assert {(r["q__id"], r["r__id"], r["rank"]) for r in got.collect()} == {("a", "a", 1), ("a", "b", 2), ("b", "a", 1), ("b", "b", 2), ("e", "e", 1), ("e", "b", 2)}


# -- co-occurrence -----------------------------------------------------------------------------------------


def test_cooccurrence_and_gold_ranks_match_brute_force(spark):
    rnd = random.Random(5)
    plays = [(s, t, rnd.randint(0, 12)) for s in range(30) for t in range(1, rnd.randint(2, 8))]
    t = spark.createDataFrame([(s, i, x, s % 3) for s, i, x in plays], "session_id long, turn int, track_id long, fold long")
    folded = counts.folded(counts.pairs(t, "track_id", by_fold=True))
    held = {}
    for s, _, x in plays:
        held.setdefault(s, set()).add(x)
    n = lambda a, b, fold: sum(s % 3 != fold and a in own and b in own for s, own in held.items())
    want, golds = {}, []
    for s, i, x in plays:
        before = [y for r, j, y in plays if r == s and j < i]
        if before:
            scores = {b: sum(n(a, b, s % 3) for a in before if a != b) for b in set(range(13)) - set(before)}
            want[s, i] = [b for b, v in sorted(scores.items(), key=lambda y: (-y[1], y[0])) if v > 0][:4]
            golds.append((s, i, x))
    got = {}
    for r in retrieve.cooc_tracks(t, folded, F.col("fold"), 4).orderBy("rank").collect():
        got.setdefault((r["session_id"], r["turn"]), []).append(r["track_id"])
    assert got == {k: v for k, v in want.items() if v}
    ranks = retrieve.cooc_gold_ranks(t, spark.createDataFrame(golds, "session_id long, turn int, gold long"), folded, F.col("fold"), 4).collect()
    assert len(ranks) == len(golds) and any(r["rank"] for r in ranks)
    assert all(r["rank"] == (own.index(r["gold"]) + 1 if r["gold"] in (own := want[r["session_id"], r["turn"]]) else None) for r in ranks)


def test_two_artists_on_a_track_sum_their_scores(spark):
    catalog = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["a", "b"]), (4, ["c"])], "track_id long, artists array<string>")
    hist = spark.createDataFrame([(1, 2, 1, 1)], "session_id long, turn int, h_turn int, track_id long")
    assert [(r["track_id"], r["score"]) for r in retrieve.history_entity(hist, catalog, "artists").orderBy("rank").collect()] == [(3, 2), (2, 1)]


def test_folds_of_ranges_are_the_plain_order(spark):
    df = spark.createDataFrame([(i, "a" if i % 5 else None) for i in range(3000)], "session_id long, stratum string")
    got = {r["session_id"]: r["fold"] for r in turns.assign_folds(df, 5).collect()}
    for own in ([i for i in range(3000) if i % 5], list(range(0, 3000, 5))):
        order = sorted(own, key=lambda i: (hashlib.md5(f"fold:{i}".encode()).hexdigest(), i))
        assert [got[i] for i in order] == [k % 5 for k in range(len(order))]


# -- rows, texts, scores -----------------------------------------------------------------------------------


def test_targets_and_histories(spark):
    msgs = spark.createDataFrame([(1, 0, "user", "q", 1), (1, 1, "music", "5", 1), (1, 2, "user", "q2", 2), (1, 3, "user", "q3", 2), (2, 0, "music", "5", 1)], "session_id long, pos int, role string, content string, turn int")
    assert [(r["turn"], r["query"], r["gold"]) for r in turns.examples(msgs, "devset").collect()] == [(1, "q", "5")]
    assert {(r["session_id"], r["query"]) for r in turns.examples(msgs, "blind").collect()} == {(1, "q3"), (2, "5")}
    with pytest.raises(ValueError):
        turns.examples(msgs, "other")
    assert {r["session_id"]: r["n_history"] for r in turns.inference_turns(msgs).collect()} == {1: 2, 2: 0}
    assert {r["session_id"]: r["n_history"] for r in turns.inference_turns(msgs, whole_turns=False).collect()} == {1: 3, 2: 0}
    assert {(r["session_id"], r["turn"], r["lacks"]) for r in turns.missing_parts(msgs).collect()} == {(1, 2, "gold"), (2, 1, "query")}
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "place int, key string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "y")], "place int, key string")
    assert [tuple(r) for r in turns.first_mismatch(a, b).collect()] == [(2, "y", "z")] and turns.first_mismatch(a, a).count() == 0


def test_conversation_texts(spark):
    from tessera.operators import dialogue

    msgs = spark.createDataFrame([(1, 0, "user", "Hello", 1), (1, 1, "music", "5", 1), (1, 2, "music", "99", 1), (1, 3, "assistant", "", 1), (1, 4, "user", " ", 2)], "session_id long, pos int, role string, content string, turn int")
    texts_ = spark.createDataFrame([(5, "track_id: 5, name: X", "X by Y")], "track_id long, metadata string, sentence string")
    h, asked = F.col("history"), F.col("query")
    row = dialogue.conversations(msgs, texts_).select(dialogue.chat_text(h, asked), dialogue.chat_text(h, asked, "last_user"), dialogue.bm25_query(h, asked), dialogue.tfidf_query(h, asked), dialogue.request(asked)).first()
    assert row[0] == "user: Hello\nassistant: track_id: 5, name: X\nassistant: 99\nassistant: \nuser:  " and row[1] == " "
    assert row[2] == "user: hello\nassistant: track_id: 5, name: x\nassistant: \nuser:  " and row[3] == "Hello X by Y" and row[4] == "music"
    with pytest.raises(ValueError):
        dialogue.chat_text(h, asked, "other")


def test_score_selection(spark):
    df = spark.createDataFrame([(0, 1, 7, 1, 2.0, 0.1), (0, 1, 8, 2, float("nan"), 0.3), (0, 1, 9, 3, 2.0, 0.2), (0, 1, 6, 4, 9.0, 0.9)], "session_id long, turn int, track_id long, rank int, primary double, tfidf double")
    order = lambda *a, **k: [r["track_id"] for r in union.select_score(*a, **k).orderBy("rank").collect()]
    assert order(df) == [6, 7, 9] and order(df, "tfidf", cap=3) == [8, 9, 7] and order(df, "none", least=3) == [6]
    assert order(df.drop("primary")) == [6, 8, 9, 7] and order(df.drop("primary", "tfidf"), cap=2) == [7, 8]


def test_lambdarank_is_saved_and_loaded(spark, tmp_path):
    import numpy as np

    rnd = np.random.default_rng(1)
    x, groups = rnd.random((200, 3)), np.full(40, 5)
    label = (x[:, 0] > 0.7).astype(int)
    model = rerank.LambdaRank(trees=5, leaves=6, least=2).fit(x, label, groups)
    model.save(str(tmp_path / "model.json"))
    again = rerank.LambdaRank.load(str(tmp_path / "model.json"))
    assert again.trees == 5 and np.allclose(again.predict(x), model.predict(x))


def test_diversity_counts_all_tokens_but_one():
    """Pairs are shared out over all tokens but one, not over the pairs inside texts."""
    assert respond.choose([["a b"], ["c", "c d"]], [0, 1])[0] == ["a b", "c d"]
    assert respond.choose([[""], ["", "x"]], [0, 1]) == (["", "x"], 1.0)


def test_reserved_columns_and_vectors(spark):
    from tessera.functions import vectors
    from tessera.operators import features

    df = spark.createDataFrame([(1, [3.0, 4.0], 2.0), (2, None, 0.0)], "id long, v array<double>, p double")
    row = features.reserved(df, ["z"], {"kind": "x"}).filter("id = 1").first()
    assert row["z"] == 0.0 and row["kind"] == "x"
    got = {r["id"]: r["j"] for r in df.select("id", features.joint_vector([vectors.of_size(F.col("v"), 2)], F.col("p")).alias("j")).collect()}
    assert got[1] == pytest.approx([0.6, 0.8, math.log(3)]) and got[2] == [0.0, 0.0, 0.0]
    lists = spark.createDataFrame([(None, "s"), (["a"], None)], "a array<string>, s string").select(tx.as_list(F.col("a"), True).alias("a"), tx.as_list(F.col("s"), False).alias("s")).collect()
    assert [tuple(map(list, r)) for r in lists] == [([], ["s"]), (["a"], [])]


# -- sources -----------------------------------------------------------------------------------------------


def test_external_sequences_id_map_and_config(spark, tmp_path):
    said = "session_id long, conversations array<struct<role:string,content:string,turn_number:int>>"
    spark.createDataFrame([(1, [("user", "x", 1), ("music", "e1", 1), ("music", "e9", 2)]), (2, [("music", "e9", 1)])], said).write.parquet(f"{tmp_path}/s")
    spark.createDataFrame([("e1", 11, 3)], "external_track_id string, track_id long, other int").write.parquet(f"{tmp_path}/m")
    held = tables.id_map(spark, f"{tmp_path}/m")
    assert held.columns == ["external", "track"]
    mapped, report = tables.sequences(spark, f"{tmp_path}/s", held)
    assert [tuple(r) for r in mapped.collect()] == [(1, 1, 11)]
    row = report.first()
    assert (row["items"], row["mapped"], row["sessions"], row["mapped_sessions"]) == (3, 1, 2, 1)
    (tmp_path / "c.yaml").write_text("a: 1\nb: [x]\n")
    assert tables.read_config(str(tmp_path / "c.yaml")) == {"a": 1, "b": ["x"]}


def test_a_table_is_not_written_to_one_machine_of_several(spark):
    from tessera import store

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"applicationId": "elsewhere", "master": "spark://host:7077", "getConf": staticmethod(lambda: type("D", (), {"get": staticmethod(lambda *a: None)}))})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(Elsewhere)
    assert store.written(spark.range(3), "test").count() == 3


def test_paired_sides_and_map_artifact(spark, tmp_path):
    from tessera.operators import idmap

    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "pair long, item string")
    idmap.check_sides(a, a)
    with pytest.raises(idmap.UnequalSides, match="pair 2"):
        idmap.check_sides(a, a.filter("pair = 1"))
    pairs = spark.createDataFrame([("x", 1, 3), ("y", 2, 1)], "external string, track long, n long")
    idmap.map_artifact(pairs, str(tmp_path / "map"), {"source": "s"})
    assert tables.is_complete(str(tmp_path / "map")) and tables.id_map(spark, str(tmp_path / "map/table")).count() == 2
    with pytest.raises(idmap.UnequalSides):
        idmap.map_artifact(pairs.union(spark.createDataFrame([("x", 2, 1)], pairs.schema)), str(tmp_path / "no"), {})


def test_artifact_slices(spark):
    rows = spark.createDataFrame([("a:s:1:1", 0), ("a:s:1:2", 1), ("b:s:1:1", 2)], "key string, place int")
    folds = spark.createDataFrame([("a", "s:1", 3)], "source_split string, session_id string, fold int")
    assert sorted((r["key"], r["place"], r["fold"]) for r in turns.slice_artifact(rows, "a", folds).collect()) == [("s:1:1", 0, 3), ("s:1:2", 1, 3)]
    with pytest.raises(Exception, match="has no fold"):
        turns.slice_artifact(rows, "b", folds).collect()
    own = spark.createDataFrame([("s:1:1", 0), ("s:1:3", 1), ("s:1:2", 2)], "key string, place int")
    assert [r["place"] for r in turns.out_of_order(own).collect()] == [2] and turns.out_of_order(own.filter("place < 2")).count() == 0


def test_paths_names_and_keys():
    assert policy.split_name({"split": "dev"}, "/a/b") == "dev" and policy.split_name({}, "/a/b/") == "b"
    policy.check_keys(["a", "b"], ["a", "b"])
    for found in (["a", "c"], ["a"], ["a", "b", "c"]):
        with pytest.raises(policy.BrokenProtocol):
            policy.check_keys(["a", "b"], found)
    source = {"name": "x", "config": "c", "paths": {"blind": "/own"}}
    assert policy.source_path("/r", source, "blind") == "/own" and policy.source_path("/r", source, "devset") == "/r/retriever/x/c/oof/devset"
    assert policy.source_path("/r", {"name": "x", "out_of_fold": False}, "devset") == "/r/retriever/x/default/full/devset"
    own = policy.decorated({"name": "x", "max_candidates": 9}, {"sources": [{"name": "x", "max_candidates": 5, "min_score": 2.0, "score_field": "tfidf"}]})
    assert (own.max_candidates, own.min_score, own.score_field) == (5, 2.0, "tfidf")


def test_cache_is_rewritten_in_order(spark, tmp_path):
    cache = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("c", [float("nan"), 1.0]), ("d", None), ("a", [1.0, 2.0])], "key string, vector array<double>")
    rows = spark.createDataFrame([("d", 0), ("a", 1), ("c", 2)], "key string, place int")
    out = tables.refreshed_cache(rows, cache, "key", "place", 2, lambda df: df.withColumn("vector", F.array(F.lit(9.0), F.lit(9.0))), str(tmp_path / "cache"))
    assert {r["key"]: r["vector"] for r in out.collect()} == {"a": [1.0, 2.0], "c": [9.0, 9.0], "d": [9.0, 9.0]}


def test_records_prompts_and_fallbacks(spark):
    ranked = spark.createDataFrame([(1, 1, 5, 2), (1, 1, 6, 1), (1, 1, 7, 3)], "session_id long, turn int, track_id long, rank int")
    known = spark.createDataFrame([(5, "five"), (6, "six")], "track_id long, title string")
    assert [(t["track_id"], t["title"]) for t in respond.ranked_records(ranked, known, 2).first()["tracks"]] == [(6, "six"), (5, "five")]
    df = spark.createDataFrame([(" ", "query"), ("text", "query")], "p string, q string")
    assert [r["vector"] for r in respond.encode(df, "p", lambda xs: [[float(len(x))] for x in xs], fallback="q").collect()] == [[5.0], [4.0]]
    who = spark.createDataFrame([(None,), ((None, 3),)], "u struct<name:string,age:int>")
    assert [tuple(r) for r in who.select(*tx.present(F.col("u"), "name", "age").values()).collect()] == [("", ""), ("", "3")]
    text = F.lit("x")
    row = df.limit(1).select(tx.prompt(text, F.lit(""), F.lit(None).cast("string"), text, tx.progress_text(F.lit(2), F.lit(8))).alias("a")).first()
    assert row["a"] == "[goal]\nx\n\n[progress]\nturn 2 of 8\n\n[dialogue]\nx"


def test_metadata_extension_has_eighteen_columns(spark, sf):
    from tessera.operators import features
    from tessera.plans import candidates, fixtures

    out = features.metadata_extension(candidates._transition(spark, sf), fixtures.hist(spark, sf), fixtures.catalog(spark, sf), F.lit(30), F.lit("fr"))
    assert len(out.columns) == 3 + 18 and out.filter(" OR ".join(f"{c} <> 0" for c in features.NEUTRAL)).count() == 0


def test_command_line(spark, sf, tmp_path, capsys):
    from tessera import __main__ as command

    path = str(tmp_path / "out")
    command.main(["tag_vocabulary", "--tables", sf, "--out", path])
    assert tables.is_complete(path) and spark.read.parquet(f"{path}/table").count() > 0
    command.main(["tag_vocabulary", "--tables", sf, "--out", path])
    assert "is complete" in capsys.readouterr().out
    df = spark.createDataFrame([("a", None, 1), (None, "external", 2)], "gold string, kind string, external int")
    assert command.select(df, "public", False).count() == command.select(df, "inference", False).count() == 1
    assert command.select(df.drop("kind"), "both", True).agg(F.sum("external")).first()[0] == 0 and command.select(df.fillna("x", ["kind"]), "both", True).count() == 1


def test_files_through_sparks_stores(spark, tmp_path, monkeypatch):
    """The path of other stores than the local one, on the local one."""
    from tessera import store

    monkeypatch.setattr(store, "is_remote", lambda path: True)
    path = f"file://{tmp_path}/deep/m.json"
    assert not store.exists(path)
    tables.write_json({"a": 1}, path)
    tables.write_json({"a": "é"}, path)
    assert store.exists(path) and json.loads((tmp_path / "deep/m.json").read_text()) == {"a": "é"}
    assert tables.file_hash(path)["sha256"] == hashlib.sha256((tmp_path / "deep/m.json").read_bytes()).hexdigest()
