"""Language spans of mixed texts: script ranges narrow a word's candidate languages, and a Viterbi search over
per-word scores with a penalty for each switch labels the words.

The model is learned here: frequencies of character n-grams per language, from a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh, trimmed
from tessera.llm.spm import small_batches

#: Rows of each language to learn from, as expected from a hash of the row; and n-grams kept per language, the most frequent: the size of the model.
SAMPLE_ROWS, GRAMS = 4000, 20_000
#: Cost of changing the language from one word to the next, in nats, and of a language whose script is another.
SWITCH, WRONG_SCRIPT = 12.0, 60.0
#: A script is a language's own if at least this share of the language's letters is of it.
OWN_SCRIPT = 0.01
#: First code points of ranges, and the script of each.
RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "other"), (0x0750, "Arabic"), (0x0780, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other"), (0x0B80, "Tamil"),
    (0x0C00, "other"), (0x0E00, "Thai"), (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x1380, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"),
    (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "other"), (0x20000, "Han"), (0x323B0, "other"),
]
_FIRST = np.array([a for a, _ in RANGES])
SCRIPTS = sorted({s for _, s in RANGES})
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in RANGES])
LONGEST = 40
#: Texts are split into words in slices of about so many characters.
SLICE = 1 << 20
#: Ranges of marks that go with letters of any script.
_MARKS = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"


@lru_cache(maxsize=1)
def _word() -> re.Pattern:
    """Words as the labels see them: runs of letters, marks and numerals other than digits, apostrophes inside."""
    points = [i for i in range(sys.maxunicode + 1) if (c := unicodedata.category(chr(i)))[0] in "LM" or c in ("Nl", "No")]
    cuts = [0, *(i for i in range(1, len(points)) if points[i] != points[i - 1] + 1), len(points)]
    own = "".join(f"\\U{points[a]:08x}-\\U{points[b - 1]:08x}" for a, b in zip(cuts, cuts[1:]))
    return re.compile(f"[{own}]+(?:['’][{own}]+)*")


_ASCII_WORD = re.compile("[a-z]+(?:'[a-z]+)*")


def _of_script(script: str) -> str:
    ends = [a - 1 for a, _ in RANGES[1:]] + [0x10FFFF]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for (a, s), b in zip(RANGES, ends) if s == script)


#: Consecutive pieces of one script and of at most LONGEST characters, which together are the whole run; apostrophes and some marks are of any script.
_PIECE = re.compile("|".join(f"[{_of_script(s)}][{_of_script(s)}'’{_MARKS}]{{0,{LONGEST - 1}}}" for s in SCRIPTS))


def scripts_of(points: np.ndarray) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_FIRST, points, side="right") - 1]


def words_of(text: str) -> list[str]:
    """The words of a text in lower case. A run that is long, as in a script without spaces, or that changes script is several words."""
    words = (_ASCII_WORD if text.isascii() else _word()).findall(text.lower())
    if text.isascii() and max(map(len, words), default=0) <= LONGEST:
        return words
    return [p for w in words for p in ((w,) if w.isascii() and len(w) <= LONGEST else _PIECE.findall(w))]


def slices_of(text: str) -> Iterator[str]:
    """A text in slices of about a million characters, cut between words, or where a run goes on for ever, inside it."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < min(len(text), at + 2 * SLICE) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 1- to 3-grams of all words between word marks, and the word each belongs to."""
    joined = " " + " ".join(words) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    word = np.cumsum(points == 32) - 1
    letter = points != 32
    codes, owner = [points[letter]], [word[letter]]
    for n in (2, 3):
        code = points[: -n + 1]
        for k in range(1, n):
            code = code << 21 | points[k : len(points) - n + 1 + k]
        inside = np.ones(len(code), dtype=bool)
        for k in range(1, n - 1):
            inside &= letter[k : len(letter) - n + 1 + k]
        inside &= letter[: len(code)] | letter[n - 1 :]  # never only the gap
        codes.append(code[inside])
        owner.append(word[: len(code)][inside])
    return np.concatenate(codes), np.concatenate(owner)


@dataclass
class Languages:
    names: list[str]
    codes: np.ndarray  #: sorted
    scores: np.ndarray  #: one row per code and one last for all others, a column per language
    own: np.ndarray  #: script x language

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words or not self.names:
            return np.zeros((len(words), len(self.names)), dtype=np.float32)
        codes, owner = grams_of(words)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        rows = np.where(self.codes[at] == codes, at, len(self.codes))
        out = np.zeros((len(words), len(self.names)), dtype=np.float64)
        for k in range(len(self.names)):
            out[:, k] = np.bincount(owner, weights=self.scores[rows, k], minlength=len(words))[: len(words)]
        first = np.array([ord(w[0]) for w in words])
        allowed = self.own[scripts_of(first)]
        allowed |= ~allowed.any(axis=1, keepdims=True)  # a script that no language has says nothing
        return (out - WRONG_SCRIPT * ~allowed).astype(np.float32)


def learn(df: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> Languages:
    """Learn from about `rows` rows of df of each label, chosen by a hash of the id and the text (all, if there are fewer).

    A label's rows of the smallest hash are always taken, so that every label is learned. Counts are summed on the
    executors; per language the most frequent n-grams come to the driver.
    """
    small_batches(df.sparkSession)
    labelled = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    # by the whole hash, as shares of a label with many rows are small; a double holds it closely enough
    place = (F.col("h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    shares = labelled.groupBy("lang").agg((F.lit(rows) / F.count(F.lit(1))).alias("share"), F.min("h").alias("least"))
    some = labelled.join(F.broadcast(shares), "lang").filter((place < F.col("share")) | (F.col("share") >= 1) | (F.col("h") == F.col("least"))).select("lang", "text")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                words = [w for t in texts for w in words_of(t)]
                if words:
                    codes, times = np.unique(grams_of(words)[0], return_counts=True)
                    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
                    scripts, letter_times = np.unique(scripts_of(letters), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "code": np.concatenate([codes, -1 - scripts]), "n": np.concatenate([times, letter_times])})

    summed = some.mapInPandas(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = F.row_number().over(Window.partitionBy("lang", F.col("code") < 0).orderBy(F.col("n").desc(), "code"))
    both = summed.withColumn("top", top).filter(F.col("top") <= GRAMS).toPandas()  # once, as the sample is read for it
    scripts, counts = both[both["code"] < 0], both[both["code"] >= 0]
    names = sorted(counts["lang"].unique())
    codes = np.array(sorted(counts["code"].unique()), dtype=np.int64)
    table = np.zeros((len(codes) + 1, len(names)))
    if names:
        table[np.searchsorted(codes, counts["code"]), [names.index(x) for x in counts["lang"]]] = counts["n"]
        table = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(table)))
        table -= table.mean(axis=1, keepdims=True)  # what tells languages apart
        table[-1] = 0
    own = np.zeros((len(SCRIPTS), len(names)), dtype=bool)
    for lang, group in scripts.groupby("lang"):
        if lang in names:
            own[(-1 - group["code"]).to_numpy(), names.index(lang)] = (group["n"] / group["n"].sum()).to_numpy() >= OWN_SCRIPT
    return Languages(names, codes, table.astype(np.float32), own)


def best_paths(emissions: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best language of each word of each text, from scores of each of its words; see paths."""
    sizes = [len(e) for e in emissions]
    table = np.concatenate([e for e in emissions if e.size] or [np.zeros((0, 1), dtype=np.float32)])
    ends = np.cumsum(sizes)
    return paths(table, [np.arange(b - n, b) if emissions[i].size else np.empty(0, np.int64) for i, (n, b) in enumerate(zip(sizes, ends))], switch)


def paths(table: np.ndarray, rows: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best language of each word of each text, whose scores are rows of the table; ties go to the first language and to staying.

    Texts of similar length advance together, without padding: a step handles the texts that have a word there. Kept per
    word are the best language so far, and a bit for each language that is better entered from there.
    """
    out: list[np.ndarray] = [np.empty(0, np.int16)] * len(rows)
    order = sorted((i for i in range(len(rows)) if len(rows[i]) and table.shape[1]), key=lambda i: len(rows[i]))
    while order:
        own, total = [], 0
        while order and len(own) < 256 and (not own or total + len(rows[order[-1]]) <= 1_000_000):
            total += len(rows[order[-1]])
            own.append(order.pop())
        _advance(table, rows, own, switch, out)
    return out


def _advance(table, rows, own, switch, out) -> None:
    """Texts `own`, the longest first, one word of each at a time."""
    lengths, k = np.array([len(rows[i]) for i in own]), table.shape[1]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left").astype(np.int32)  # texts longer than t
    offset = np.concatenate([[0], np.cumsum(active, dtype=np.int64)])
    at = np.empty(offset[-1], dtype=np.int32)
    for j, i in enumerate(own):
        at[offset[: lengths[j]] + j] = rows[i]
    best, moves = np.empty(len(at), dtype=np.int16), np.empty((len(at), -(-k // 8)), dtype=np.uint8)
    score, index = np.zeros((len(own), k), dtype=np.float32), np.arange(len(own))
    final = np.empty(len(own), dtype=np.int16)
    for t, m in enumerate(active.tolist()):
        if m < len(score):
            final[m : len(score)] = score[m:].argmax(axis=1)
            score = score[:m]
        a = offset[t]
        top = score.argmax(axis=1)
        entered = score[index[:m], top][:, None] - np.float32(switch)
        move = entered > score
        best[a : a + m], moves[a : a + m] = top, np.packbits(move, axis=1)
        score = np.where(move, entered, score) + table[at[a : a + m]]
        score -= score.max(axis=1, keepdims=True)  # keeps the precision of long texts
    final[: len(score)] = score.argmax(axis=1)
    label, now = np.empty(len(at), dtype=np.int16), final.astype(np.int64)
    for t in range(len(active) - 1, -1, -1):
        a, m = offset[t], active[t]
        here = now[:m]
        label[a : a + m] = here
        entered = moves[a + index[:m], here >> 3] >> (7 - (here & 7)) & 1
        now[:m] = np.where(entered, best[a : a + m], here)
    for j, i in enumerate(own):
        out[i] = label[offset[: lengths[j]] + j]


class Labeller:
    """Labels texts; remembers the scores of words, of at most LONGEST characters each, up to a number of them."""

    LIMIT = 250_000

    def __init__(self, model: Languages):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known, self.over = {}, False
        self.table, self.letters = np.zeros((0, len(self.model.names)), dtype=np.float32), np.zeros(0, dtype=np.int16)

    def _score(self, words: list[str]) -> dict[str, int]:
        """Rows for words that the table lacks. A word weighs its characters; numerals alone are no word."""
        numbers = dict(zip(words, range(len(self.table), len(self.table) + len(words))))
        self.table = np.concatenate([self.table, self.model.word_scores(words)])
        self.letters = np.concatenate([self.letters, np.array([len(w) if any(map(str.isalpha, w)) else 0 for w in words], dtype=np.int16)])
        return numbers

    def _rows(self, words: list[str], known: dict[str, int]) -> np.ndarray:
        rows = np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words))
        return rows[self.letters[rows] > 0]

    def _long(self, text: str) -> np.ndarray:
        """Rows for a long text, slice by slice; past the limit a slice's new words are remembered for that slice only."""
        parts = []
        for piece in slices_of(text):
            words = words_of(piece)
            own = set(words)
            new = list(own.difference(self.known))
            if len(self.known) + len(new) <= self.LIMIT:
                self.known |= self._score(new)
                parts.append(self._rows(words, self.known))
            else:
                self.over = True
                parts.append(self._rows(words, {w: self.known[w] for w in own.intersection(self.known)} | self._score(new)))
        return np.concatenate(parts)

    def label(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Characters of each word of each text, and the word's language by number."""
        if self.over or len(self.known) > self.LIMIT:
            self._forget()
        long = [len(t or "") >= SLICE for t in texts]
        words = [[] if is_long else words_of(t or "") for t, is_long in zip(texts, long)]
        self.known |= self._score(list({w for own in words for w in own}.difference(self.known)))
        rows = [self._long(t) if is_long else self._rows(own, self.known) for t, own, is_long in zip(texts, words, long)]
        return [(self.letters[r], p) for r, p in zip(rows, paths(self.table, rows))]


def identify(df: DataFrame, model: Languages, text_col: str = "text") -> DataFrame:
    """All rows and columns of df with lang_pred, score and lang_spans.

    lang_spans lists runs of words of one language, as array<struct<lang, first_word, n_words>>; lang_pred is the language
    of the most characters of words and score its share, of equal ones the first by name. Words are those of words_of. A null
    or empty text, one without a letter, and any text under a model without languages get `und`, 0 and no spans. Rows that repeat
    get the same. A text of any length is read whole, some ten bytes a word at a time. An empty table stays empty. Columns of df
    that have the name of a new column are replaced.
    """
    small_batches(df.sparkSession)
    given_model = df.sparkSession.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())])
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_spans", T.ArrayType(span))]
    (text,) = fresh(df, "text__")
    old = [c for c in df.columns if c.lower() not in {f.name for f in new}]
    given = df.select(*old, df[text_col].cast("string").alias(text))
    spans_type = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))

    @trimmed
    def run(batches):
        names, labeller = given_model.value.names, Labeller(given_model.value)
        for batch in batches:
            pred, score, spans = [], [], []
            for letters, path in labeller.label(batch.column(text).to_pylist()):
                if not len(path) or not names:
                    pred.append("und"), score.append(0.0), spans.append([])
                    continue
                by = np.bincount(path, weights=letters, minlength=len(names))
                starts = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1])
                sizes = np.diff(np.concatenate([starts, [len(path)]]))
                pred.append(names[by.argmax()]), score.append(float(by.max() / by.sum()))
                spans.append([{"lang": names[path[a]], "first_word": int(a), "n_words": int(n)} for a, n in zip(starts, sizes)])
            columns = [batch.column(c) for c in old] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, spans_type)]
            yield pa.RecordBatch.from_arrays(columns, names=[*old, *[f.name for f in new]])

    return given.mapInArrow(run, T.StructType([given.schema[c] for c in old] + new))
