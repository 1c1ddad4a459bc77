"""Tables in and out: Parquet, JSON lines, CSV, single JSON documents, zip archives, manifests and hashes.

Data goes through Spark's readers and writers; what belongs to a run (a manifest, a report, a submission) is one small
file, written under another name and then renamed.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import store
from tessera.operators.turns import ROW


def scan(spark: SparkSession, root: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table of a folder; with columns, no other column is read."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df if columns is None else df.select(*columns)


def sequences(spark: SparkSession, path: str, id_map: DataFrame, role: str = "music") -> tuple[DataFrame, DataFrame]:
    """Foreign sessions (conversations array<struct<role, content, turn_number>>): mapped turns, and a one-row coverage report."""
    from tessera.operators.idmap import coverage
    from tessera.operators.turns import messages

    played = messages(spark.read.parquet(path)).filter(F.col("role") == role).withColumnRenamed("content", "external")
    mapped = played.join(id_map, "external").select("session_id", "turn", F.col("track").alias("track_id"))
    return mapped, coverage(played, id_map, "session_id", "external")


def id_map(spark: SparkSession, path: str) -> DataFrame:
    """The two id columns of a stored map."""
    return spark.read.parquet(path).select(F.col("external_track_id").alias("external"), F.col("track_id").alias("track"))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(parts: list[DataFrame], path: str) -> None:
    """Tables of different columns as one CSV with a header: the union of their columns, sorted, empty where one lacks them."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.select(sorted(out.columns)).write.mode("overwrite").option("header", True).csv(path)


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def _replace(path: Path, write) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    os.close(handle)
    try:
        write(name)
        os.replace(name, path)
    finally:
        Path(name).unlink(missing_ok=True)


def write_json(document, path: str) -> None:
    """One JSON document, on any store that Spark knows."""
    text = json.dumps(document, ensure_ascii=False, indent=1, sort_keys=True)
    if store.is_remote(path):
        store.write_text(path, text)
    else:
        _replace(Path(store.local(path)), lambda name: Path(name).write_text(text, encoding="utf-8"))


def zip_records(records: Iterable[dict], path: str, member: str = "prediction.json") -> None:
    """A zip archive of one JSON list, streamed record by record."""

    def write(name: str) -> None:
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z, z.open(member, "w") as f:
            for i, r in enumerate(records):
                f.write((", " if i else "[").encode() + json.dumps(r, ensure_ascii=False).encode())
            f.write(b"]" if "i" in locals() else b"[]")

    _replace(Path(path), write)


def records(df: DataFrame) -> Iterator[dict]:
    """Rows as dictionaries, one partition at a time on the driver."""
    for row in df.toLocalIterator():
        yield row.asDict(recursive=True)


# -- artifacts ----------------------------------------------------------------------------------------


def artifact_path(root: str, stage: str, name: str, config: str, mode: str, target: str) -> str:
    for part in (stage, name, config, mode, target):
        if not part or "/" in part:
            raise ValueError(f"bad path part {part!r}")
    return f"{root}/{stage}/{name}/{config}/{mode}/{target}"


def file_hash(path: str) -> dict:
    """Name, SHA-256 and size of one file, on any store that Spark knows."""
    digest, size = hashlib.sha256(), 0
    for block in store.blocks(path):
        digest.update(block)
        size += len(block)
    return {"path": os.path.basename(path), "sha256": digest.hexdigest(), "bytes": size}


def write_artifact(df: DataFrame, path: str, manifest: dict, partition_by: tuple[str, ...] = ()) -> None:
    """A table and beside it its manifest, which is written last and so marks it complete."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/table")
    write_json({**manifest, "columns": dict(df.dtypes), "written": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}, f"{path}/manifest.json")


def is_complete(path: str, files: tuple[str, ...] = ("table",)) -> bool:
    """Whether the manifest and all files named are there."""
    return all(store.exists(f"{path}/{f}") for f in ("manifest.json", *files))


def resume(spark: SparkSession, path: str, build, manifest: dict) -> DataFrame:
    """The table at path, built first unless it is complete."""
    if not is_complete(path):
        write_artifact(build(), path, manifest)
    return spark.read.parquet(f"{path}/table")


def cached_vectors(examples: DataFrame, cache: DataFrame | None, key: str, encode) -> DataFrame:
    """A vector for each example: from the cache where it has one, encoded where it lacks it."""
    if cache is None:
        return encode(examples)
    held = examples.join(cache.select(key, "vector"), key)
    missing = examples.join(cache.select(key), key, "left_anti")
    return held.unionByName(encode(missing))


def valid_vectors(cache: DataFrame, key: str, size: int) -> DataFrame:
    """Rows of a cache that may be used: a vector of the size, without nulls, NaN or infinite values; of a key that is there twice, one."""
    whole = (F.size("vector") == size) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return cache.filter(F.col("vector").isNotNull() & whole).dropDuplicates([key])


def refreshed_cache(examples: DataFrame, cache: DataFrame, key: str, place: str, size: int, encode, path: str) -> DataFrame:
    """The cache written anew for the examples, in their order: valid vectors kept, the others encoded."""
    out = cached_vectors(examples, valid_vectors(cache, key, size), key, encode)
    out.select(key, place, "vector").orderBy(place).write.mode("overwrite").parquet(path)
    return examples.sparkSession.read.parquet(path)


# -- predictions --------------------------------------------------------------------------------------

#: The fields of a prediction.
FIELDS = ["session_id", "user_id", "turn_number", "predicted_track_ids", "predicted_response"]


class BadPredictions(ValueError):
    """Predictions break the schema or do not cover the target."""


def prediction_faults(predictions: DataFrame, target: DataFrame, catalog: DataFrame, k: int = 20, complete: bool = True) -> DataFrame:
    """(session_id, turn_number, fault): every breach of the rules, none if the predictions are valid."""
    if sorted(predictions.columns) != sorted(FIELDS):
        raise BadPredictions(f"fields must be {FIELDS}, not {predictions.columns}")
    key = ["session_id", "turn_number"]
    ids = F.col("predicted_track_ids")
    predictions = store.written(predictions, "predictions")  # four checks read them
    own = predictions.join(target.select(*key, F.col("user_id").alias("expected")), key, "left")
    twice = predictions.groupBy(*key).count().filter("count > 1").select(*key, F.lit("predicted twice").alias("fault"))
    rules = {
        "not in the target": F.col("expected").isNull(), "another user": F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.col("user_id")),
        "wrong number of tracks": F.coalesce(F.size(ids), F.lit(-1)) != k, "repeated track": F.size(F.array_distinct(ids)) < F.size(ids), "no response": F.col("predicted_response").isNull(),
    }
    found = own.select(*key, F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))).alias("fault"))
    named = predictions.select(*key, F.explode(ids).alias("track_id"))
    odd = store.written(named.select("track_id").distinct().join(catalog.select("track_id"), "track_id", "left_anti"), "unknown-tracks")  # each track is looked up once
    out = found.unionByName(twice)
    if not odd.isEmpty():
        wrong = named.join(odd, named["track_id"].eqNullSafe(odd["track_id"]), "left_semi")  # a null is no track either
        out = out.unionByName(wrong.select(*key, F.lit("unknown track").alias("fault")).distinct())
    if complete:
        out = out.unionByName(target.join(predictions, key, "left_anti").select(*key, F.lit("missing").alias("fault")))
    return out


def write_predictions(predictions: DataFrame, target: DataFrame, catalog: DataFrame, path: str, k: int = 20) -> None:
    """Check, then write the archive; BadPredictions names a first fault."""
    fault = prediction_faults(predictions, target, catalog, k).first()
    if fault:
        raise BadPredictions(f"{fault['fault']}: session {fault['session_id']}, turn {fault['turn_number']}")
    zip_records(records(predictions.orderBy("session_id", "turn_number")), path)


def top_lists(ranked: DataFrame, k: int = 20) -> DataFrame:
    """(row, tracks): the first k tracks of each row in order."""
    own = ranked.filter(F.col("rank") <= k).groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("rank", "track_id"))).alias("t"))
    return own.select(*ROW, F.transform("t", lambda x: x["track_id"]).alias("tracks"))
