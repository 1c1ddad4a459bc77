"""Top-k of products between queries and rows: blocks of queries meet blocks of rows, each pair of blocks once.

A block of queries is copied to each block of rows, so that neither side passes through the driver, a task holds one block of
each, and a frequent term is a long posting list of a block instead of a hot key. A task keeps k rows per query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.ship import ship
from tessera.store import written

#: Queries and rows of a block.
QUERIES, ROWS = 4096, 16_384
#: Cells of a block of rows as a whole matrix.
DENSE = 16_000_000
#: Scores closer than one over this count as equal: less than 32-bit floats tell apart, and more than the order of additions changes.
STEADY = 1e7


def steady(c: Column) -> Column:
    """A score as ranks see it: rounded where only the order of additions shows."""
    return F.floor(c * STEADY + 0.5) / STEADY


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores over 0, the first of equals first."""
    scores = np.floor(scores * STEADY + 0.5) / STEADY
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero((scores >= least) & (scores > 0)) if least > 0 else np.flatnonzero(scores > 0)
    else:
        at = np.flatnonzero(scores > 0)
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def met(queries: DataFrame, rows: DataFrame, k: int, query_id: str, row_id: str, solve: Callable, block: int = QUERIES) -> DataFrame:
    """(q__<query_id>, r__<row_id>, score, rank) of the k best rows per query; solve(queries, rows) gives (query place, row id, score) of two blocks, the rows by id."""
    ship(queries.sparkSession)
    n_queries, n_rows = queries.count(), rows.count()
    per = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = max(1, -(-n_queries // block))
    lines = max(1, -(-n_rows // ROWS), min(-(-per // columns), -(-n_rows // 512)))
    left, right = f"q__{query_id}", f"r__{row_id}"  # also apart where both sides are one table
    queries, rows = queries.withColumnRenamed(query_id, left), rows.withColumnRenamed(row_id, right)
    q = queries.withColumn("column__", F.pmod(F.xxhash64(left), F.lit(columns))).withColumn("line__", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lines - 1).cast("long"))))
    r = rows.withColumn("line__", F.pmod(F.xxhash64(right), F.lit(lines))).withColumn("column__", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))))

    def run(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(other):
            return pd.DataFrame({left: own[left].iloc[:0], right: other[right].iloc[:0], "score": np.empty(0)})
        other = other.sort_values(right, kind="stable", ignore_index=True)
        a, b, score = solve(own, other)
        return pd.DataFrame({left: own[left].to_numpy()[a], right: b, "score": score})

    schema = f"`{left}` {dict(q.dtypes)[left]}, `{right}` {dict(r.dtypes)[right]}, score double"
    found = q.groupBy("column__", "line__").cogroup(r.groupBy("column__", "line__")).applyInPandas(run, schema)
    rank = F.row_number().over(Window.partitionBy(left).orderBy(steady(F.col("score")).desc(), right))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _postings(other: pd.DataFrame):
    """(terms, begins, ends, owners, weights): who has each term of a block of rows, and how much of it."""
    term, weight = np.concatenate(other["t"].to_list()), np.concatenate(other["w"].to_list())
    owner = np.repeat(np.arange(len(other)), other["t"].map(len).to_numpy())
    order = np.argsort(term, kind="stable")
    term, weight, owner = term[order], weight[order], owner[order]
    known, begins = np.unique(term, return_index=True)
    return known, begins, np.append(begins[1:], len(term)), owner, weight


def _totals(own: pd.DataFrame, other: pd.DataFrame):
    """The scores of all rows for each query in turn: by posting lists, or where terms are few and frequent as products of whole matrices."""
    known, begins, ends, owner, weight = _postings(other)
    size = own["t"].map(len).to_numpy()
    term, asked = np.concatenate(own["t"].to_list()), np.concatenate(own["w"].to_list())
    at = np.minimum(np.searchsorted(known, term), len(known) - 1)
    hit = known[at] == term
    stop = np.append(0, np.cumsum(size))
    used = np.unique(at[hit])
    # an addition to a posting's row takes as long as some 25 of a product's
    if len(used) * len(other) <= DENSE and len(used) * len(other) * len(own) < 25 * int((ends - begins)[at[hit]].sum()):
        table = np.zeros((len(used), len(other)))
        for i, j in enumerate(used.tolist()):
            post = slice(begins[j], ends[j])
            table[i, owner[post]] = weight[post]
        step = 256
        for start in range(0, len(own), step):
            end = min(start + step, len(own))
            part = slice(stop[start], stop[end])
            row = np.repeat(np.arange(end - start), size[start:end])[hit[part]]
            cell = row * len(used) + np.searchsorted(used, at[part][hit[part]])
            yield from np.bincount(cell, asked[part][hit[part]], (end - start) * len(used)).reshape(end - start, -1) @ table
        return
    for i in range(len(own)):
        total = np.zeros(len(other))
        for j in (stop[i] + np.flatnonzero(hit[stop[i] : stop[i + 1]])).tolist():
            post = slice(begins[at[j]], ends[at[j]])
            total[owner[post]] += asked[j] * weight[post]
        yield total


def by_terms(queries: DataFrame, rows: DataFrame, k: int, query_id: str, row_id: str, skip: DataFrame | None = None) -> DataFrame:
    """The k best rows per query by the sum over shared terms of weight times weight; both are (id, term, w), a term once per id.

    skip(query_id, row_id) are rows that a query must not get; then equal rows are searched as one, too.
    """
    if skip is not None:
        return _by_kinds(queries, rows, k, query_id, row_id, skip)

    def gathered(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).agg(F.collect_list(F.xxhash64("term")).alias("t"), F.collect_list(F.col("w").cast("double")).alias("w"))

    def solve(own: pd.DataFrame, other: pd.DataFrame):
        ids = other[f"r__{row_id}"].to_numpy()
        lefts, rights, scores = [], [], []
        for i, total in enumerate(_totals(own, other)):
            top = best_of(total, k)
            lefts.append(np.full(len(top), i)), rights.append(ids[top]), scores.append(total[top])
        return np.concatenate(lefts), np.concatenate(rights), np.concatenate(scores)

    entry = F.sort_array(F.collect_list(F.struct(F.col("term"), F.col("w").cast("double").alias("w"))))
    asked = written(queries.groupBy(query_id).agg(entry.alias("asked__")), "queries")
    kinds = written(asked.groupBy("asked__").agg(F.min(query_id).alias("kind__")), "kinds")  # equal queries are searched once
    own = kinds.select(F.col("kind__").alias(query_id), F.transform("asked__.term", lambda x: F.xxhash64(x)).alias("t"), F.col("asked__.w").alias("w"))
    found = met(own, gathered(rows, row_id), k, query_id, row_id, solve)
    names = asked.join(kinds, "asked__").select(F.col(query_id).alias("id__"), "kind__")
    left = f"q__{query_id}"
    lists = found.groupBy(left).agg(F.collect_list(F.struct(*found.columns[1:])).alias("best__"))  # k entries
    each = names.join(lists, F.col("kind__") == F.col(left)).select(F.col("id__").alias(left), F.explode("best__").alias("x__"))
    return each.select(left, "x__.*")


def _expanded(total: np.ndarray, most: int, ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, score) of the best ids of kinds of rows, a kind's ids being a run; kinds are in the order of their first ids.

    Of equal kinds the most first ones hold the most first ids, so that no more than most kinds are looked at.
    """
    top = best_of(total, most)
    score = np.floor(total[top] * STEADY + 0.5) / STEADY
    covered = np.searchsorted(np.cumsum(sizes[top]), most)
    if covered < len(top):
        top = top[score >= score[covered]]
    size = sizes[top]
    at = np.repeat(begins[top] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    own, total = ids[at], np.repeat(total[top], size)
    order = np.lexsort((own, -np.repeat(score[: len(top)], size)))[:most]
    return own[order], total[order]


def _by_kinds(queries: DataFrame, rows: DataFrame, k: int, query_id: str, row_id: str, skip: DataFrame) -> DataFrame:
    """by_terms with rows to skip: equal queries, and equal rows, are searched as one; each query takes its own out of what its kind finds.

    A kind of queries finds k ids and as many as one of its queries skips, a kind of rows shows no more of its first ids than any kind asks for.
    """
    left, right = f"q__{query_id}", f"r__{row_id}"
    entry = F.sort_array(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("w").cast("double").alias("w"))))
    known = queries.join(rows.select("term").distinct(), "term", "left_semi")  # other terms find nothing
    gone = skip.groupBy(query_id).agg(F.collect_set(row_id).alias("skip__"))
    asked = known.groupBy(query_id).agg(entry.alias("asked__")).join(gone, query_id, "left")
    asked = written(asked.withColumn("need__", k + F.when(F.col("skip__").isNull(), 0).otherwise(F.size("skip__"))), "queries")
    kinds = written(asked.groupBy("asked__").agg(F.min(query_id).alias("kind__"), F.max("need__").alias("need__")), "kinds")
    most = kinds.agg(F.max("need__")).first()[0] or k
    like = rows.groupBy(row_id).agg(entry.alias("like__"))
    place = F.row_number().over(Window.partitionBy("like__").orderBy(row_id))
    first = like.withColumn("place__", place).filter(F.col("place__") <= most)
    alike = written(first.groupBy("like__").agg(F.sort_array(F.collect_list(row_id)).alias("ids__")), "alike")

    def solve(own: pd.DataFrame, other: pd.DataFrame):
        ids, sizes = np.concatenate(other["ids__"].to_list()), other["ids__"].map(len).to_numpy()
        begins, need = np.cumsum(sizes) - sizes, own["need__"].to_numpy()
        lefts, rights, scores = [], [], []
        for i, total in enumerate(_totals(own, other)):
            best, score = _expanded(total, int(need[i]), ids, begins, sizes)
            lefts.append(np.full(len(best), i)), rights.append(best), scores.append(score)
        return np.concatenate(lefts), np.concatenate(rights), np.concatenate(scores)

    own = kinds.select(F.col("kind__").alias(query_id), F.col("asked__.t").alias("t"), F.col("asked__.w").alias("w"), "need__")
    other = alike.select(F.get("ids__", F.lit(0)).alias(row_id), F.col("like__.t").alias("t"), F.col("like__.w").alias("w"), "ids__")
    found = met(own, other, most, query_id, row_id, solve, block=4 * QUERIES)
    lists = found.groupBy(left).agg(F.sort_array(F.collect_list(F.struct("rank", right, "score"))).alias("best__"))
    names = asked.join(kinds.select("asked__", "kind__"), "asked__").select(F.col(query_id).alias("id__"), "kind__", F.coalesce("skip__", F.array().cast(f"array<{dict(rows.dtypes)[row_id]}>")).alias("skip__"))
    met_lists = names.join(lists, F.col("kind__") == F.col(left))
    kept = F.slice(F.filter("best__", lambda x: ~F.array_contains("skip__", x[right])), 1, k)
    each = met_lists.select(F.col("id__").alias(left), F.posexplode(kept).alias("at__", "x__"))
    return each.select(left, F.col(f"x__.{right}").alias(right), F.col("x__.score").alias("score"), (F.col("at__") + 1).alias("rank"))


def by_vectors(queries: DataFrame, rows: DataFrame, k: int, query_id: str, row_id: str, vector: str, size: int) -> DataFrame:
    """The k rows of the largest dot product per query; vectors that are null or of another size take no part."""
    whole = F.col(vector).isNotNull() & (F.size(vector) == size)

    def solve(own: pd.DataFrame, other: pd.DataFrame):
        ids = other[f"r__{row_id}"].to_numpy()
        q, r = (np.stack(f["v__"].to_list()).astype(np.float64) for f in (own, other))
        lefts, rights, scores = [], [], []
        for start in range(0, len(q), 256):
            product = np.floor((q[start : start + 256] @ r.T) * STEADY + 0.5) / STEADY
            top = np.argsort(-product, axis=1, kind="stable")[:, :k]
            lefts.append(np.repeat(np.arange(start, start + len(product)), top.shape[1])), rights.append(ids[top.ravel()]), scores.append(np.take_along_axis(product, top, axis=1).ravel())
        return np.concatenate(lefts), np.concatenate(rights), np.concatenate(scores)

    own = queries.filter(whole).select(query_id, F.col(vector).alias("v__"))
    return met(own, rows.filter(whole).select(row_id, F.col(vector).alias("v__")), k, query_id, row_id, solve)
