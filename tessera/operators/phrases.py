"""Names inside texts: each name is filed under its rarest token, and only texts with that token are searched."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import norm_name


def rare_token_bucket(names: DataFrame, name: str = "name") -> DataFrame:
    """(name, token): of the tokens of each distinct name the one in the fewest names, ties by token."""
    own = names.select(F.col(name).alias("name")).distinct()
    tokens = own.select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("token")).filter("token <> ''")
    rarity = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return tokens.join(rarity, "token").groupBy("name").agg(F.min(F.struct("df", "token"))["token"].alias("token"))


#: Characters of all names that are sent to each task; where they are more, texts meet them by a join.
SENT = 20_000_000


def phrase_matches(texts: DataFrame, key: str, text: str, names: DataFrame, min_chars: int = 1, min_tokens: int = 1) -> DataFrame:
    """(key, name): normalised names that stand as whole words in the normalised text.

    The names go to the tasks, so that a text is read where it lies and never copied for its tokens.
    """
    wanted = names.filter((F.length("name") >= min_chars) & (F.size(F.split("name", " ")) >= min_tokens))
    filed = rare_token_bucket(names).join(wanted.select("name").distinct(), "name", "left_semi")
    normal = texts.select(F.col(key), norm_name(F.col(text)).alias("t"))
    size = filed.agg(F.sum(F.length("name"))).first()[0] or 0
    if size > SENT:
        by_token = normal.select(key, F.concat(F.lit(" "), "t", F.lit(" ")).alias("t"), F.explode(F.array_distinct(F.split("t", " "))).alias("token"))
        hit = F.contains(F.col("t"), F.concat(F.lit(" "), F.col("name"), F.lit(" ")))
        return by_token.join(filed, "token").filter(hit).select(key, "name")
    under: dict[str, list[str]] = {}
    for r in filed.collect():
        under.setdefault(r["token"], []).append(r["name"])
    sent = texts.sparkSession.sparkContext.broadcast(under)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        under = sent.value
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                whole = f" {t} "
                own = [n for token in under.keys() & t.split(" ") for n in under[token] if f" {n} " in whole] if t else []
                at += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=[key, "name"])

    return normal.mapInArrow(search, f"`{key}` {dict(texts.dtypes)[key]}, name string")
