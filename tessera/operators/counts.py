"""Count tables over sessions, in full and without a row's own fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.store import dealt


def pairs(items: DataFrame, item: str, by_fold: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(session_id, item[, fold]) -> symmetric counts (a, b[, fold], n) of sessions that hold both items; no self pairs.

    A large input is dealt by pairs, or by the columns named, where the next step wants them together.
    """
    keep = ["session_id", *(["fold"] if by_fold else [])]
    own = items.select(*keep, F.col(item).alias("a")).distinct()
    other = own.select("session_id", F.col("a").alias("b"))
    met = own.join(other, "session_id").filter("a <> b")
    return dealt(met, *(by or ("a", "b"))).groupBy("a", "b", *keep[1:]).agg(F.count(F.lit(1)).alias("n"))


def transitions(turns: DataFrame, by_fold: bool = False, catalog: DataFrame | None = None) -> DataFrame:
    """(a, b[, fold], n): how often b follows a. Unknown tracks are taken out first, so that pairs bridge the gap."""
    keep = ["session_id", *(["fold"] if by_fold else [])]
    own = turns if catalog is None else turns.join(catalog.select("track_id"), "track_id", "left_semi")
    follows = F.lead("track_id").over(Window.partitionBy("session_id").orderBy("turn"))
    return own.select(*keep, F.col("track_id").alias("a"), follows.alias("b")).filter("b IS NOT NULL").groupBy("a", "b", *keep[1:]).agg(F.count(F.lit(1)).alias("n"))


def at_least(counts: DataFrame, least: int) -> DataFrame:
    return counts.filter(F.col("n") >= least)


def out_of_fold(by_fold: DataFrame, n_folds: int = 5) -> DataFrame:
    """(a, b, fold, n) -> (a, b, fold, n): for each fold the counts of all other folds, as total less own, in one shuffle.

    The folds of a pair come as one map, so that folds where the pair never occurs get the whole total.
    """
    total = by_fold.groupBy("a", "b").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("own"))
    every = total.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"), "total", "own")
    rest = F.col("total") - F.coalesce(F.try_element_at("own", F.col("fold").cast("long")), F.lit(0))
    return every.select("a", "b", F.col("fold").cast("long").alias("fold"), rest.alias("n")).filter("n > 0")


def folded(by_fold: DataFrame) -> DataFrame:
    """(a, b, total, own): the total of each pair and its count per fold, for joins that subtract the row's own fold."""
    return by_fold.groupBy("a", "b").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("own"))
