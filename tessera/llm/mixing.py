"""Mixing sources to target weights: word totals per source give repetition rates; each document is taken
floor(rate) times, and once more by a hash-seeded Bernoulli draw with the fraction's probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh, words_of

MOST = 3
WEIGHTS = (1, 2, 3)
#: A table of sources of at most so many rows is broadcast; a larger one is joined over salted keys.
BROADCAST_ROWS = 100_000
SALTS = 32


def _ranked(sizes: DataFrame) -> DataFrame:
    """Sources with their rank by code point, null last, from 0: ranked within range partitions, then offset by the rows before."""
    dealt = cut(sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "mix-sources")
    parts = dealt.groupBy("part").count()
    before = parts.withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), F.col("source"))) - 1
    return dealt.join(F.broadcast(before), "part").select("source", "source_size", (own + F.col("before")).alias("rank"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) with one row per source -> (source, source_size, target, rate).

    Weights repeat along the sources by code point, null last. Targets share the total of all sizes by weight and
    stop at `most` times a source's size; the excess is shared again until no target is above. A source of size
    0 has target 0 and rate 0.
    """
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int"))
    by = cut(_ranked(sizes).withColumn("weight", weight), "mix-ranked")
    total = by.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    cap, level, seen = most * F.col("source_size"), 0.0, -1
    while True:  # each round caps more sources or ends
        full = cap < F.col("weight") * F.lit(level) if seen >= 0 else F.lit(False)
        n, held, free = by.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if n == seen or not free:
            break
        seen, level = n, (total - held) / free
    target = F.least(F.col("weight") * F.lit(float(level)), cap.cast("double")) if total else F.lit(0.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return by.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def _draw(key: Column) -> Column:
    """A number in [0, 1) from a hash of the key, the same in every run and on every engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(rate: Column, key: Column) -> Column:
    whole = F.floor(rate)
    return whole + F.when(_draw(key) < rate - whole, F.lit(1)).otherwise(F.lit(0))


def _with_targets(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with their source's columns: broadcast if the sources are few, else a join over salted keys, so that a hot source is spread."""
    same = F.col("s.source").eqNullSafe(F.col("d.source"))
    if sources.count() <= BROADCAST_ROWS:
        return rows.alias("d").join(F.broadcast(sources.alias("s")), same, "left").select("d.*", "s.source_size", "s.target", "s.rate")
    salted = rows.withColumn("salt__", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    many = sources.withColumn("salt__", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return salted.alias("d").join(many.alias("s"), same & (F.col("d.salt__") == F.col("s.salt__")), "left").select("d.*", "s.source_size", "s.target", "s.rate").drop("salt__")


def mix_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per row of df: (key, source, size, source_size, target, rate, copies).

    A null text has size 0; a null source is a source of its own, the last. Rows that share an id share their draw.
    """
    sizes = cut(df.select(F.col(id_col).alias("key"), F.col(source_col).alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size")), "mix-sizes")
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    return _with_targets(sizes, cut(targets, "mix-targets")).withColumn("copies", copies(F.col("rate"), F.col("key")).cast("int"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of df as the mix takes them: repeated, once, or not at all, with df's columns. An empty table stays empty."""
    (n,) = fresh(df, "copies__")
    sizes = df.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.size(words_of(F.col(text_col))).cast("long")).alias("source_size"))
    sources = cut(source_targets(sizes, weights, most), "mix-targets")
    key, source = fresh(df, "key", "source__")
    if sources.count() <= BROADCAST_ROWS:
        few = sources.select(F.col("source").alias(source), F.col("rate").alias(n))
        rated = df.join(F.broadcast(few), F.col(source).eqNullSafe(df[source_col]), "left")
    else:
        (salt,) = fresh(df, "salt__")
        many = sources.select(F.col("source").alias(source), F.col("rate").alias(n), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias(key))
        salted = df.withColumn(salt, F.pmod(F.xxhash64(df[id_col]), F.lit(SALTS)).cast("int"))
        rated = salted.join(many, F.col(source).eqNullSafe(salted[source_col]) & (F.col(salt) == F.col(key)), "left")
    counted = rated.withColumn(n, copies(F.coalesce(F.col(n), F.lit(0.0)), F.col(id_col)).cast("int")).filter(F.col(n) > 0)
    return counted.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n)))).select(df.columns)
