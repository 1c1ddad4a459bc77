"""Ordered-unique union of sources with provenance, and fusion of ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import quantised
from tessera.operators.turns import ROW
from tessera.store import dealt


def gather(sources: dict[str, DataFrame], caps: dict[str, int] | None = None, least: dict[str, float] | None = None) -> DataFrame:
    """All sources as one long table (row, track, source, position, rank, score). A cap on ranks applies before a least score; ranks keep their gaps."""
    parts = []
    for i, (name, df) in enumerate(sources.items()):
        own = df.select(*ROW, "track_id", F.col("rank"), F.col("score").cast("double").alias("score"))
        if caps and name in caps:
            own = own.filter(F.col("rank") <= caps[name])
        if least and name in least:
            own = own.filter(F.col("score") >= least[name])
        parts.append(own.withColumns({"source": F.lit(name), "position": F.lit(i)}))
    return reduce(DataFrame.unionByName, parts)


def ordered_union(long: DataFrame, most: int | None = None) -> DataFrame:
    """Each track of a row once, where the first source in order has it: (row, track_id, place)."""
    first = long.groupBy(*ROW, "track_id").agg(F.min(F.struct("position", "rank")).alias("at"))
    place = F.row_number().over(Window.partitionBy(*ROW).orderBy("at.position", "at.rank", "track_id"))
    out = first.select(*ROW, "track_id", place.alias("place"))
    return out if most is None else out.filter(F.col("place") <= most)


def listed_union(sources: dict[str, DataFrame], most: int | None = None) -> DataFrame:
    """ordered_union of sources that are lists (row, top): the lists of a row meet as arrays, so that no candidate is dealt out alone."""
    own = [df.select(*ROW, F.col("top.track_id").alias(f"list{i}")) for i, df in enumerate(sources.values())]
    met = reduce(lambda a, b: dealt(a, *ROW).join(dealt(b, *ROW), ROW, "full_outer"), own)
    whole = F.concat(*[F.coalesce(F.col(f"list{i}"), F.array().cast("array<bigint>")) for i in range(len(own))])
    once = F.array_distinct(whole)
    each = met.select(*ROW, F.posexplode(once if most is None else F.slice(once, 1, most)).alias("pos", "track_id"))
    return each.select(*ROW, "track_id", (F.col("pos") + 1).alias("place"))


def provenance(long: DataFrame, names: list[str]) -> DataFrame:
    """Per row and track: whether each source has it, at which rank and score."""
    pick = lambda n, c: F.max(F.when(F.col("source") == n, F.col(c)))
    columns = []
    for n in names:
        columns += [F.coalesce(F.max((F.col("source") == n).cast("int")), F.lit(0)).alias(f"{n}_present"), pick(n, "rank").alias(f"{n}_rank"), pick(n, "score").alias(f"{n}_score")]
    return long.groupBy(*ROW, "track_id").agg(*columns)


def meta(long: DataFrame, primary: list[str] | None = None) -> DataFrame:
    """Number of sources, best and mean rank, largest score of the sources named (all by default)."""
    score = F.col("score") if primary is None else F.when(F.col("source").isin(primary), F.col("score"))
    finite = F.when(~F.isnan(score), score)
    return long.groupBy(*ROW, "track_id").agg(F.count(F.lit(1)).alias("source_count"), F.min("rank").alias("best_rank"), quantised(F.avg("rank")).alias("mean_rank"), F.max(finite).alias("max_score"))


def override(sources: dict[str, DataFrame], name: str, df: DataFrame) -> dict[str, DataFrame]:
    """The sources with one replaced, its place in the order kept."""
    if name not in sources:
        raise KeyError(name)
    return {k: df if k == name else v for k, v in sources.items()}


def tied_ranks(long: DataFrame) -> DataFrame:
    """With tied_rank: the mean of the places that rows of equal score share within a source."""
    w = Window.partitionBy(*ROW, "source")
    rank = F.rank().over(w.orderBy(F.col("score").desc()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*ROW, "source", "score"))
    return long.withColumn("tied_rank", rank + (ties - 1) / 2.0)


def rrf(long: DataFrame, c: float = 60.0, rank: str = "rank") -> DataFrame:
    """Reciprocal-rank fusion, ranked by score, then best rank, then track."""
    fused = long.groupBy(*ROW, "track_id").agg(F.sum(1.0 / (c + F.col(rank))).alias("rrf"), F.min(rank).alias("best"))
    fused = fused.withColumn("rrf", quantised(F.col("rrf"), 1e8))
    order = Window.partitionBy(*ROW).orderBy(F.col("rrf").desc(), "best", "track_id")
    return fused.withColumn("place", F.row_number().over(order)).drop("best")


def rrf_sweep(long: DataFrame, golds: DataFrame, constants: tuple[float, ...] = (10, 30, 60, 100), k: int = 20) -> DataFrame:
    """(c, ndcg_k, recall_k) of tie-aware fusion for each constant, in one pass: candidates are fused and placed for all constants at once."""
    from tessera.functions.text import discount

    spread = tied_ranks(long).withColumn("c", F.explode(F.array(*[F.lit(c) for c in constants])))
    fused = spread.groupBy("c", *ROW, "track_id").agg(quantised(F.sum(1.0 / (F.col("c") + F.col("tied_rank"))), 1e8).alias("rrf"), F.min("tied_rank").alias("best"))
    place = F.row_number().over(Window.partitionBy("c", *ROW).orderBy(F.col("rrf").desc(), "best", "track_id"))
    hits = fused.withColumn("place", place).join(golds.select(*ROW, F.col("gold").alias("track_id")), [*ROW, "track_id"])
    total = golds.agg(F.count(F.lit(1)).alias("rows"))
    sums = hits.groupBy("c").agg(F.sum(discount(F.col("place"), k)).alias("gain"), F.sum((F.col("place") <= k).cast("int")).alias("hits"))
    return sums.join(F.broadcast(total)).select("c", quantised(F.col("gain") / F.col("rows"), 1e6).alias(f"ndcg_{k}"), quantised(F.col("hits") / F.col("rows"), 1e6).alias(f"recall_{k}"))


def select_score(df: DataFrame, wanted: str | None = None, cap: int | None = None, least: float | None = None) -> DataFrame:
    """A source's candidates with one score: the column wanted, else `primary`, else `tfidf`, else 1 for all; and rank anew.

    The cap holds for the stored rank; then scores that are null or not finite, and those under the least, go. Equal scores keep
    their stored order.
    """
    name = next((c for c in (wanted, "primary", "tfidf") if c and c in df.columns), None)
    own = df if cap is None else df.filter(F.col("rank") <= cap)
    own = own.withColumn("score", F.col(name).cast("double") if name else F.lit(1.0))
    own = own.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")))
    own = own if least is None else own.filter(F.col("score") >= least)
    place = F.row_number().over(Window.partitionBy(*ROW).orderBy(F.col("score").desc(), "rank"))
    return own.select(*ROW, "track_id", "score", place.alias("rank"))


def row_z(df: DataFrame, column: str) -> DataFrame:
    """With <column>_z: the score's distance from its row's mean in deviations, over the candidates that have one; else 0."""
    w = Window.partitionBy(*ROW)
    value = F.when(~F.isnan(column), F.col(column))
    z = (value - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + 1e-6)
    return df.withColumn(f"{column}_z", F.coalesce(quantised(z), F.lit(0.0)))


def rank_forms(df: DataFrame, column: str) -> DataFrame:
    """A rank as itself, its logarithm and its inverse; 0 where it is missing."""
    r = F.col(column)
    return df.withColumns({f"{column}_miss0": F.coalesce(r, F.lit(0)), f"{column}_log1p": F.coalesce(quantised(F.log1p(r)), F.lit(0.0)), f"{column}_inv": F.coalesce(quantised(1.0 / r), F.lit(0.0))})


def expand_provenance(df: DataFrame) -> DataFrame:
    """Features from provenance, by the columns' names: ranks in three forms, scores raw with 0 for missing and as row z-scores, the rest as they are."""
    out, features = df, []
    for c in df.columns:
        if c.endswith("_rank"):
            out = rank_forms(out, c)
            features += [f"{c}_miss0", f"{c}_log1p", f"{c}_inv"]
        elif c.endswith("_score") and c != "max_score":
            out = row_z(out, c).withColumn(f"{c}_raw0", F.coalesce(c, F.lit(0.0)))
            features += [f"{c}_raw0", f"{c}_z"]
        elif c not in (*ROW, "track_id", "max_score"):
            features.append(c)
    return out.select(*ROW, "track_id", *features)


def feature_set(df: DataFrame, which: str, mark: str = "src_") -> DataFrame:
    """Columns of a feature set: full, no_provenance, or provenance_only."""
    keys = [c for c in (*ROW, "track_id", "label") if c in df.columns]
    own = [c for c in df.columns if c not in keys]
    keep = {"full": own, "no_provenance": [c for c in own if not c.startswith(mark)], "provenance_only": [c for c in own if c.startswith(mark)]}[which]
    return df.select(*keys, *keep)
