"""Vectors as arrays: norm, dot product, centroid, ragged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2(a: Column) -> Column:
    """Unit vector; a zero vector stays."""
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm(a)), F.lit(0.0)))


def of_size(a: Column, n: int) -> Column:
    """The vector if it has n elements, else zeros."""
    return F.when(F.size(a) == n, F.transform(a, lambda x: x.cast("double"))).otherwise(F.array_repeat(F.lit(0.0), n))


def modal_size(df: DataFrame, column: str) -> int:
    """The most frequent length of a vector column, the smaller of equals; 0 if there is none."""
    row = df.filter(F.col(column).isNotNull()).groupBy(F.size(column).alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return row["n"] if row else 0


def centroid(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean vector per key, element by element."""
    own = df.select(*keys, F.posexplode(vector).alias("at", "x")).groupBy(*keys, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return own.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("centroid"))
