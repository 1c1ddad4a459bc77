"""BM25 and TF-IDF as joins of query terms with postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import bigrams, plain, words
from tessera.operators import blocks
from tessera.store import written

#: Words that carry no topic.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
K1, B = 1.5, 0.75


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of words of two characters or more without stop words."""
    kept = F.filter(words(F.col(text)), lambda w: ~w.isin(STOP_WORDS))
    return df.select(F.col(key), F.explode(kept).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Postings (term, doc, weight): the weight of a term in a document, idf included.

    idf is ln(1 + (N - df + 0.5) / (df + 0.5)); documents without a term count for N and the mean length.
    """
    own = written(terms(docs, key, text).withColumnRenamed(key, "doc"), "terms")  # three parts of the index read it
    lengths = own.groupBy("doc").agg(F.sum("tf").alias("dl"))
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    total = lengths.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))
    frequency = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = n_docs.crossJoin(total)  # one row with one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (F.col("total") / F.col("n_docs"))))
    joined = own.join(lengths, "doc").join(frequency, "term").join(F.broadcast(stats))
    return joined.select("term", "doc", (idf * saturated).alias("weight"))


def bm25_scores(queries: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    """(key, doc, score) over shared terms; a term that a query repeats counts as often."""
    asked = terms(queries, key, text)
    return asked.join(index, "term").groupBy(key, "doc").agg(F.sum(F.col("tf") * F.col("weight")).alias("score"))


def bm25_best(queries: DataFrame, index: DataFrame, k: int, key: str, text: str, skip: DataFrame | None = None) -> DataFrame:
    """(key, doc, score, rank): the k best documents per query, by blocks, without those of skip(key, doc)."""
    asked = terms(queries, key, text).withColumnRenamed("tf", "w")
    return blocks.by_terms(asked, index.withColumnRenamed("weight", "w"), k, key, "doc", skip).withColumnsRenamed({f"q__{key}": key, "r__doc": "doc"})


def tagged_best(queries: DataFrame, index: DataFrame, k: int, key: str, wanted: str) -> DataFrame:
    """BM25 of given terms (an array column): (key, doc, score, rank); an empty list finds nothing."""
    asked = queries.select(F.col(key), F.explode(wanted).alias("phrase")).select(key, F.explode(words(F.col("phrase"))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("w"))
    return blocks.by_terms(asked, index.withColumnRenamed("weight", "w"), k, key, "doc").withColumnsRenamed({f"q__{key}": key, "r__doc": "doc"})


# -- TF-IDF -------------------------------------------------------------------------------------------


def grams(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of words and adjacent pairs, accents stripped."""
    tokens = words(plain(F.col(text)))
    return df.select(F.col(key), tokens.alias("t")).select(key, F.explode(F.concat("t", bigrams(F.col("t")))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_vocabulary(corpus: DataFrame, n_docs: int, min_df: int = 2, most: int = 200_000) -> DataFrame:
    """(key, term, tf) -> (term, idf): terms of min_df texts or more, the most frequent ones first, ties by term."""
    by = corpus.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    top = by.orderBy(F.col("total").desc(), "term").limit(most)
    return top.select("term", (F.log((1 + F.lit(float(n_docs))) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_vectors(counts: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, term, w): weights of unit length."""
    own = counts.join(vocabulary, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = own.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return own.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def cosine(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key, score) of vectors that share a term."""
    r = right.select("term", F.col(right_key), F.col("w").alias("v"))
    return left.join(r, "term").groupBy(left_key, right_key).agg(F.sum(F.col("w") * F.col("v")).alias("score"))


def top_k(scores: DataFrame, keys: list[str], item: str, k: int, score: str = "score") -> DataFrame:
    """The k best items per key with their rank; ties by ascending item."""
    order = F.col(score) if dict(scores.dtypes)[score] in ("int", "bigint") else blocks.steady(F.col(score))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc(), item))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)
