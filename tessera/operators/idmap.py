"""Maps between id spaces from paired sessions, with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import quantised


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, right(pair, signature, place, item) -> (external, track, n) over pairs whose signatures agree, items joined by place."""
    sides = left.select("pair", "signature", "place", F.col("item").alias("external")).join(right.select("pair", "signature", "place", F.col("item").alias("track")), ["pair", "signature", "place"])
    return sides.groupBy("external", "track").agg(F.count(F.lit(1)).alias("n"))


class UnequalSides(ValueError):
    """Two sides that are joined by place do not have the same number of rows."""


def check_sides(left: DataFrame, right: DataFrame, pair: str = "pair") -> None:
    """Fail unless every pair has as many items on one side as on the other."""
    counts = left.groupBy(pair).agg(F.count(F.lit(1)).alias("l")).join(right.groupBy(pair).agg(F.count(F.lit(1)).alias("r")), pair, "full_outer")
    odd = counts.filter(~F.col("l").eqNullSafe(F.col("r"))).first()
    if odd:
        raise UnequalSides(f"pair {odd[pair]!r} has {odd['l'] or 0} items on the left and {odd['r'] or 0} on the right")


def map_artifact(pairs: DataFrame, path: str, sources: dict) -> None:
    """Write the map (external_track_id, track_id, n) with a manifest of its counts; an ambiguous map is refused."""
    from tessera.sources.tables import write_artifact

    report = bijection(pairs).first().asDict()
    if not report["bijective"]:
        raise UnequalSides(f"{report['pairs']} pairs of {report['externals']} and {report['tracks']} ids are no one-to-one map")
    write_artifact(pairs.select(F.col("external").alias("external_track_id"), F.col("track").alias("track_id"), "n"), path, {**sources, **report})


def bijection(pairs: DataFrame) -> DataFrame:
    """One row: pairs, ids on both sides, and whether each has exactly one partner."""
    own = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("external").alias("externals"), F.countDistinct("track").alias("tracks"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"))
    return own.withColumn("bijective", (F.col("pairs") == F.col("externals")) & (F.col("pairs") == F.col("tracks")))


def coverage(sequences: DataFrame, id_map: DataFrame, session: str, item: str) -> DataFrame:
    """One row: items and sessions of foreign sequences, and the shares that the map knows."""
    known = sequences.join(id_map.select(F.col("external").alias(item), F.lit(1).alias("hit")).distinct(), item, "left")
    by = known.groupBy(session).agg(F.count(F.lit(1)).alias("items"), F.count("hit").alias("mapped"))
    return by.agg(
        F.sum("items").alias("items"), F.sum("mapped").alias("mapped"), F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("mapped") > 0).alias("mapped_sessions"),
        quantised(F.sum("mapped") / F.sum("items"), 1e6).alias("item_rate"), quantised(F.count_if(F.col("mapped") > 0) / F.count(F.lit(1)), 1e6).alias("session_rate"),
    )
