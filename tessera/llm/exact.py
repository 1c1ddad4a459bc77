"""Exact duplicates by a content sort: sampled splitters range-partition the normalised texts, an external
sort puts equal ones side by side, and each row is compared in full with its neighbour.

The splitters are samples of (first characters, SHA-256, salt), so that they stay short whatever the
texts' length. A text that makes up more than a 4,096th of all rows is spread over several tasks by a
salt; there are at most 4,096 such texts, so that their table is safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, lower_ascii

#: At most so many texts are treated as hot, which bounds the broadcast.
HOT_TEXTS = 4096
#: No text with fewer copies is hot.
HOT_LEAST = 16
SPLITTER_CHARS = 32


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of df, with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z. The row with the largest id of a group stays;
    of rows that share that id too, exactly one. A null text counts as empty, a null id comes before all
    others; in a group of null ids one row stays and keep_id is null. Columns of df that have the name of
    a new column are replaced. An empty table gives an empty table.
    """
    spark = df.sparkSession
    digest, salt, prefix, norm, rank, most, size, hot_keep, hot_size = fresh(df, "digest__", "salt__", "prefix__", "norm__", "rank__", "most__", "size__", "hot_keep__", "hot_size__")
    normal = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    hot_min = max(HOT_LEAST, df.count() // HOT_TEXTS + 1)
    salts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn(digest, F.sha2(normal.cast("binary"), 256))
    # Two texts of one digest are never hot: the second hash and the length would differ, and only full comparisons decide.
    hot = (
        df.select(F.col(id_col).alias(hot_keep), normal.alias(norm))
        .select(hot_keep, F.sha2(F.col(norm).cast("binary"), 256).alias(digest), F.xxhash64(norm).alias(rank), F.octet_length(norm).alias(size))
        .groupBy(digest)
        .agg(F.count(F.lit(1)).alias(hot_size), F.max(hot_keep).alias(hot_keep), F.min(rank).alias("a"), F.max(rank).alias("b"), F.min(size).alias("c"), F.max(size).alias("d"))
        .filter((F.col(hot_size) >= hot_min) & (F.col("a") == F.col("b")) & (F.col("c") == F.col("d")))
        .select(digest, hot_size, hot_keep)
    )
    dealt = (
        keyed.join(F.broadcast(hot), digest, "left")
        .withColumn(salt, F.when(F.col(hot_size).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int")))
        .withColumn(prefix, F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, SPLITTER_CHARS))
        .withColumn(prefix, lower_ascii(F.col(prefix)))
        .repartitionByRange(prefix, digest, salt)
        .withColumn(norm, normal)
    )
    same = Window.partitionBy(prefix, digest, salt, norm)
    sort = dealt.withColumns({rank: F.row_number().over(same.orderBy(F.col(id_col).desc_nulls_last())), most: F.max(id_col).over(same), size: F.count(F.lit(1)).over(same)})
    keep, own = F.when(F.col(hot_size).isNull(), F.col(most)).otherwise(F.col(hot_keep)), F.col(id_col)
    new = {"keep_id": keep, "group_size": F.coalesce(F.col(hot_size), F.col(size)), "kept": own.eqNullSafe(keep) & (F.col(rank) == 1), "text_sha256": F.col(digest)}
    return sort.select(*[F.col(c) for c in df.columns if c.lower() not in new], *[v.alias(k) for k, v in new.items()])


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with df's columns; see exact_groups."""
    kept, *rest = fresh(df, "kept_row__", *["keep_id", "group_size", "kept", "text_sha256"])
    clash = [c for c in df.columns if c.lower() in {"keep_id", "group_size", "kept", "text_sha256"}]
    safe = df.withColumnsRenamed({c: f"{kept}{c}" for c in clash})
    out = exact_groups(safe, id_col, text_col).filter("kept").drop("keep_id", "group_size", "kept", "text_sha256")
    return out.withColumnsRenamed({f"{kept}{c}": c for c in clash}).select(df.columns)
