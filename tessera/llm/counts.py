"""Token counts without tokens: an Aho-Corasick automaton lists the vocabulary's matches in a chunk, and
dynamic programming over their ends carries the best score (or the last piece) and the number of pieces.

The tie rules are the tokenizer's; see tessera.llm.spm for the two kinds of score.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import fresh, trimmed
from tessera.llm.spm import BPE, DEFAULT_MODEL, Model, model_bytes, small_batches

_BITS = 22


class Counter(dict):
    """Number of tokens of a chunk, remembered for a number of chunks and of characters."""

    LIMIT, CHARACTERS = 300_000, 16 << 20

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.characters = model, 0
        self.automaton = ahocorasick.Automaton()
        for piece, i in model.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.LIMIT or self.characters >= self.CHARACTERS:
            self.clear()
            self.characters = 0
        self.characters += len(chunk)
        n = self[chunk] = self._merged(chunk) if self.model.kind == BPE else self._summed(chunk)
        return n

    def _cost(self, char: str) -> int:
        """Tokens of a character that is no piece."""
        return len(char.encode("utf-8", "replace")) if self.model.byte_fallback and self.model.bytes else 1

    def _matches(self, chunk: str) -> list[list[tuple[int, int]]]:
        ends: list[list[tuple[int, int]]] = [[] for _ in chunk]
        for at, match in self.automaton.iter(chunk):
            ends[at].append(match)
        return ends

    def _merged(self, chunk: str) -> int:
        model = self.model
        last, count, pairs = [model.start] + [-1] * len(chunk), [0] * (len(chunk) + 1), model.pairs
        for end, matches in enumerate(self._matches(chunk), 1):
            if not any(n == 1 for _, n in matches):
                matches = [*matches, (model.n + 1 + ord(chunk[end - 1]), 1)]
            for piece, n in matches:
                if last[end - n] >= 0:
                    pair = last[end - n] << _BITS | piece
                    ok = pairs.get(pair)
                    if model.joins(pair) if ok is None else ok:
                        last[end] = piece
                        count[end] = count[end - n] + (1 if piece < model.n else self._cost(chunk[end - 1]))
                        break
            if last[end] < 0:  # never seen: merging decides
                return sum(1 if s in model.ids else self._cost(s) for s in model.merge(chunk))
        return count[-1]

    def _summed(self, chunk: str) -> int:
        model, low = self.model, np.float32(-np.inf)
        score, count, unknown = [np.float32(0)] + [low] * len(chunk), [0] * (len(chunk) + 1), [False] * (len(chunk) + 1)
        for end, matches in enumerate(self._matches(chunk), 1):
            for piece, n in sorted(matches, key=lambda m: -m[1]):  # the longest first: it wins ties
                value = score[end - n] + model.score_of[piece]
                if value > score[end]:
                    score[end], count[end], unknown[end] = value, count[end - n] + 1, False
            if not any(n == 1 for _, n in matches) and (value := score[end - 1] + model.unknown_score) > score[end]:
                run = unknown[end - 1] and not (model.byte_fallback and model.bytes)  # a run of unknown characters is one token
                score[end], count[end], unknown[end] = value, count[end - 1] + (0 if run else self._cost(chunk[end - 1])), True
        return count[-1]

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.model.chunks(text or "")))


_COUNTERS: dict[bytes, Counter] = {}


def counter(data: bytes) -> Counter:
    if data not in _COUNTERS:
        _COUNTERS[data] = Counter(Model.read(data))
    return _COUNTERS[data]


def token_counts(df: DataFrame, path: str = DEFAULT_MODEL, text_col: str = "text") -> DataFrame:
    """All rows and columns of df with n_tokens; a null or empty text has none, and rows that repeat have the same.

    A text of any length is counted whole, chunk by chunk. An empty table stays empty. A column n_tokens of df is replaced.
    """
    small_batches(df.sparkSession)
    data = model_bytes(df.sparkSession, path)
    (text,) = fresh(df, "text__")
    old = [c for c in df.columns if c.lower() != "n_tokens"]
    given = df.select(*old, df[text_col].cast("string").alias(text))

    @trimmed
    def run(batches):
        own = counter(data.value)
        for batch in batches:
            counts = [own.count(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in old], pa.array(counts, pa.int64())], names=[*old, "n_tokens"])

    return given.mapInArrow(run, T.StructType([given.schema[c] for c in old] + [T.StructField("n_tokens", T.LongType())]))
