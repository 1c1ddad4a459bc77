"""The pipeline's stages against brute force, each on what the one before kept."""

from collections import Counter

import corpus_pipeline as pipeline
from test_llm import make, near_brute, quality_brute, words

STAGES = dict(pipeline.STAGES)


def test_stages_follow_each_other(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns[: len(columns)] == columns and (docs.columns == columns or i == len(pipeline.STAGES) - 1)
        kept.append([r.asDict() for r in docs.collect()])
    for r in kept[0]:
        n, *_, repeated = quality_brute(r["text"])
        assert n >= 20 and 100 * repeated <= 30 * n
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    largest = {}
    for r in kept[0]:
        largest[fold(r["text"])] = max(r["doc_id"], largest.get(fold(r["text"]), -1))
    assert {r["doc_id"] for r in kept[1]} == set(largest.values())
    groups = near_brute([(r["doc_id"], r["text"]) for r in kept[1]])
    assert {r["doc_id"] for r in kept[2]} == {root for _, root in groups.values()}
    times = Counter(r["doc_id"] for r in kept[3])
    assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in kept[2]}
    taken, size = sum(len(words(r["text"])) for r in kept[3]), sum(len(words(r["text"])) for r in kept[2])
    assert 0.5 * size < taken < 1.5 * size
    assert all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in kept[4]) and Counter(r["doc_id"] for r in kept[4]) == times
    assert Counter(r["doc_id"] for r in pipeline.run(spark, sf).collect()) == times


def test_empty_documents(spark, sf, tmp_path):
    rows = spark.createDataFrame(make(2, 1)[:0], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
