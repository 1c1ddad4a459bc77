"""Responses: choosing among seeded generations for lexical diversity, and a hook for generation by a model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.ship import ship


def _tokens(text: str) -> list[str]:
    return text.lower().split()


class _Pool:
    """Distinct unigrams and bigrams of the texts chosen so far."""

    def __init__(self):
        self.one, self.two, self.n = set(), set(), 0

    def gain(self, option: tuple, weight: float) -> float:
        """Distinct unigrams over all tokens, and weighed distinct bigrams over all tokens but one, with an option added; none is worst."""
        _, n, one, two = option
        total = self.n + n
        if not total:
            return -1e9
        return (len(self.one) + len(one - self.one)) / total + weight * (len(self.two) + len(two - self.two)) / max(total - 1, 1)

    def add(self, option: tuple) -> None:
        _, n, one, two = option
        self.one |= one
        self.two |= two
        self.n += n


def _option(text: str) -> tuple[str, int, set, set]:
    t = _tokens(text)
    return text, len(t), set(t), set(zip(t, t[1:]))


def choose(options: list[list[str]], order: list[int], weight: float = 0.5) -> tuple[list[str], float]:
    """Row by row in the order, take the option of the largest gain, the first of equals; and the share of distinct unigrams in the end."""
    known: dict[str, tuple] = {}
    parsed = [[known.get(t) or known.setdefault(t, _option(t)) for t in own] for own in options]
    pool, out = _Pool(), [""] * len(options)
    for i in order:
        best = max(parsed[i], key=lambda x: pool.gain(x, weight))
        out[i] = best[0]
        pool.add(best)
    return out, len(pool.one) / max(pool.n, 1)


def diverse_select(options: DataFrame, key: str, run: str, text: str, trials: int = 30) -> DataFrame:
    """(key, text): one option per key, from the trial whose order gives the largest share of distinct unigrams.

    Each trial is a fold over all keys in a seeded order, so a trial is one group; trials run beside each other. The
    number of keys is a submission's rows.
    """
    ship(options.sparkSession)
    own = options.select(F.col(key).alias("key"), F.col(run).alias("run"), F.col(text).alias("text"))
    spread = own.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        trial = int(frame["trial"].iat[0])
        rows = frame.sort_values(["key", "run"]).groupby("key")["text"].apply(list)
        order = sorted(range(len(rows)), key=lambda i: hashlib.md5(f"{trial}:{rows.index[i]}".encode()).hexdigest())
        texts, share = choose(rows.tolist(), order)
        return pd.DataFrame({"trial": trial, "share": share, "key": rows.index, "text": texts})

    types = dict(own.dtypes)
    folded = spread.groupBy("trial").applyInPandas(fold, f"trial int, share double, key {types['key']}, text string")
    best = folded.select("trial", "share").distinct().orderBy(F.col("share").desc(), "trial").limit(1)
    return folded.join(F.broadcast(best.select("trial")), "trial").select(F.col("key").alias(key), F.col("text").alias(text))


def ranked_records(ranked: DataFrame, tracks: DataFrame, k: int = 20) -> DataFrame:
    """(session_id, turn, tracks): the first k tracks of each row with what tracks(track_id, ...) says of them, in order; unknown ones by id alone."""
    from tessera.operators.turns import ROW

    shown = [c for c in tracks.columns if c != "track_id"]
    own = ranked.filter(F.col("rank") <= k).join(tracks, "track_id", "left")
    return own.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("rank", "track_id", *shown))).alias("tracks"))


def generate(prompts: DataFrame, prompt: str, model: Callable[[list[str]], list[str]], batch: int = 32) -> DataFrame:
    """prompts with response, by a model that maps a list of prompts to texts; it is loaded on the executors."""
    ship(prompts.sparkSession)
    types = ", ".join(f"`{c}` {t}" for c, t in prompts.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[str] = []
            for k in range(0, len(f), batch):
                out += model(f[prompt].iloc[k : k + batch].tolist())
            yield f.assign(response=out)

    return prompts.mapInPandas(run, f"{types}, response string")


def encode(texts: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], batch: int = 64, fallback: str | None = None) -> DataFrame:
    """texts with vector, by an encoder that maps texts to vectors; where a text is blank, the column fallback is read instead."""
    ship(texts.sparkSession)
    if fallback is not None:
        texts = texts.withColumn(text, F.coalesce(F.when(F.trim(text) != "", F.col(text)), F.col(fallback)))
    types = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[list[float]] = []
            for k in range(0, len(f), batch):
                out += model(f[text].iloc[k : k + batch].tolist())
            yield f.assign(vector=out)

    return texts.mapInPandas(run, f"{types}, vector array<double>")
