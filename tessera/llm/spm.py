"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Texts split into chunks at white space, where no piece crosses. Chunks of equal length form a matrix and
advance together: hashes of all their substrings probe the sorted hashes of the pieces, and at each end
position one vectorised maximum over the pieces that end there sets the backpointer.

The score depends on the model's kind:

* unigram: the sum of the pieces' scores in 32-bit floats; of equal sums the longest last piece wins, as in
  the library.
* bpe: a path is allowed if each two adjacent pieces are what merging makes of their joint text, else its
  score is minus infinity. A merge sequence never joins symbols across the ends of its own result, so every
  prefix of an encoding is the encoding of that prefix's text and exactly one path is allowed: the one that
  merging finds. Pairs are tested once by merging and remembered.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm.common import fresh, trimmed
from tessera.ship import ship

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the model format: kinds of model, kinds of piece, the mark for a space, the penalty of unknown characters.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Identifiers of unknown characters start here; the start of a chunk has an identifier of its own.
_BITS, _SLOT_BITS = 22, 20
_PRIME = np.uint64(0x100000001B3)


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        else:
            raise ValueError("not a model file")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    kind: int = UNIGRAM
    dummy_prefix: bool = True
    byte_fallback: bool = False
    ids: dict[str, int] = field(init=False)
    pairs: dict[int, bool] = field(init=False, default_factory=dict)
    known: tuple[np.ndarray, np.ndarray] = field(init=False, default=(np.empty(0, np.int64), np.empty(0, bool)))  #: tested pairs, sorted

    def __post_init__(self):
        if set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        if any(SPACE in p.lstrip(SPACE) for p, k in zip(self.pieces, self.kinds) if k == NORMAL):
            raise ValueError("pieces that hold a space after other characters are not supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.n = len(self.pieces)
        self.start = self.n
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.bytes = [i for i, k in enumerate(self.kinds) if k == BYTE]
        self.longest = max((len(p) for p in self.ids), default=1)
        self.unknown_score = np.float32(min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY)
        self.by_length = {}
        for length in range(1, self.longest + 1):
            own = [p for p in self.ids if len(p) == length]
            if own:
                points = np.array([[ord(c) for c in p] for p in own], dtype=np.uint64)
                keys = _hashes(points)[:, -1]
                order = np.argsort(keys)
                may = np.zeros(1 << 16, dtype=bool)
                may[_slots(keys, 16)] = True
                self.by_length[length] = (keys[order], np.array([self.ids[p] for p in own], dtype=np.int64)[order], may)
        self.slot_pairs, self.slot_joins = np.full(1 << _SLOT_BITS, -1, dtype=np.int64), np.zeros(1 << _SLOT_BITS, dtype=bool)
        self.score_of = np.array(self.scores, dtype=np.float32)
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.encode() for p, k in zip(self.pieces, self.kinds)]
        if self.kinds[self.unknown] == UNKNOWN:
            raw[self.unknown] = " ⁇ ".encode()
        self.raw = raw

    @classmethod
    def read(cls, data: bytes) -> Model:
        pieces, scores, kinds, out = [], [], [], {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(own.get(2, 0.0))
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                out |= {"kind": own.get(3, UNIGRAM), "byte_fallback": bool(own.get(35, 0))}
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2) or own.get(4, 1):
                    raise ValueError("only the identity normaliser that keeps white space is supported")
                out["dummy_prefix"] = bool(own.get(3, 1))
        return cls(pieces, scores, kinds, **out)

    # -- merging ---------------------------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging itself: join the adjacent pair of the best score, leftmost of equals, until none is a piece."""
        symbols, ids, scores = list(text), self.ids, self.scores
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                piece = ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and (best is None or scores[piece] > best):
                    best, at = scores[piece], i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def text_of(self, symbol: int) -> str:
        return "" if symbol == self.start else self.pieces[symbol] if symbol < self.n else chr(symbol - self.n - 1)

    def joins(self, pair: int) -> bool:
        """Whether two symbols, packed into one number, stay as they are when their joint text is merged."""
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= 1_000_000:
                self.pairs.clear()
            known = self.pairs[pair] = self.tested(pair)
        return known

    def tested(self, pair: int) -> bool:
        a, b = self.text_of(pair >> _BITS), self.text_of(pair & ((1 << _BITS) - 1))
        return self.merge(a + b) == ([a, b] if a else [b])

    # -- chunks ----------------------------------------------------------------------------------------

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return _CHUNK.findall((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE))

    def output(self, symbols: list[int]) -> list[int]:
        """Identifiers of symbols: unknown characters become their bytes, or one unknown piece for each run."""
        out: list[int] = []
        unknown = False
        for s in symbols:
            if s < self.n:
                out.append(s)
            elif self.byte_fallback and self.bytes:
                out += [self.bytes[b] for b in chr(s - self.n - 1).encode("utf-8", "replace")]
            elif not unknown:
                out.append(self.unknown)
            unknown = s >= self.n
        return out

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of identifiers of each chunk, and all identifiers in order; chunks of one length are searched together."""
        by: dict[int, list[int]] = {}
        for i, c in enumerate(chunks):
            by.setdefault(len(c), []).append(i)
        counts, parts = np.zeros(len(chunks), dtype=np.int64), []
        for length, own in by.items():
            step = max(1, 2_000_000 // (length * self.longest))
            for k in range(0, len(own), step):
                part = np.array(own[k : k + step])
                counts[part], flat = self._search([chunks[i] for i in part], length)
                parts.append((part, flat))
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.int32)
        for part, flat in parts:
            n = counts[part]
            out[np.arange(len(flat)) + np.repeat(starts[part] - (np.cumsum(n) - n), n)] = flat
        return counts, out

    def _search(self, chunks: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(chunks), length)
        found = self._probe(points.astype(np.uint64))
        single = points.astype(np.int64) + (self.n + 1)
        found[1] = np.where(found[1] >= 0, found[1], single) if 1 in found else single
        rows = np.arange(len(chunks))
        last = np.full((len(chunks), length + 1), -1, dtype=np.int64)
        back = np.zeros((len(chunks), length + 1), dtype=np.int32)
        last[:, 0] = self.start
        score = np.full((len(chunks), length + 1), -np.inf, dtype=np.float32)
        score[:, 0] = 0
        for end in range(1, length + 1):
            spans = [n for n in sorted(found, reverse=True) if n <= end]  # the longest first: it wins ties
            pieces = np.stack([found[n][:, end - n] for n in spans], axis=1)
            before = np.array([end - n for n in spans])
            if self.kind == BPE:
                value = np.where(self._allowed(last[:, before], pieces), np.float32(0), np.float32(-np.inf))
            else:
                own = np.where(pieces >= self.n, self.unknown_score, self.score_of[np.clip(pieces, 0, self.n - 1)])
                value = np.where(pieces >= 0, score[:, before] + own, np.float32(-np.inf)).astype(np.float32)
            best = value.argmax(axis=1)
            score[:, end] = value[rows, best]
            last[:, end] = np.where(np.isneginf(score[:, end]), -1, pieces[rows, best])
            back[:, end] = before[best]
        # all chunks walk back together, a piece at a time
        columns, at = [], np.full(len(chunks), length)
        while at.any():
            columns.append(np.where(at > 0, last[rows, at], -2))  # -2: this chunk is done
            at = np.where(at > 0, back[rows, at], 0)
        symbols = np.stack(columns[::-1], axis=1)
        odd = np.flatnonzero((symbols >= self.n).any(axis=1) | (symbols == -1).any(axis=1))
        counts = (symbols >= 0).sum(axis=1)
        if not len(odd):
            return counts, symbols[symbols >= 0]
        own = {}
        for r in odd.tolist():
            path = [s for s in symbols[r].tolist() if s != -2]
            if -1 in path:  # never seen: merging decides
                path = [self.ids.get(s, self.n + 1 + ord(s[0])) for s in self.merge(chunks[r])]
            own[r] = self.output(path)
            counts[r] = len(own[r])
        return counts, np.concatenate([np.array(own[r], dtype=np.int64) if r in own else symbols[r][symbols[r] >= 0] for r in range(len(chunks))])

    def _probe(self, points: np.ndarray) -> dict[int, np.ndarray]:
        """By length, the pieces that start at each position of each row, or -1."""
        hashes, found = _hashes(points), {}
        length = points.shape[1]
        for n, (keys, ids, may) in self.by_length.items():
            if n <= length:
                own = hashes[:, n:] - hashes[:, : length - n + 1] * _POWERS[n]
                found[n] = np.full(own.shape, -1, dtype=np.int64)
                some = may[_slots(own, 16)]  # most substrings are no pieces, and few of those are looked up
                asked = own[some]
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                found[n][some] = np.where(keys[at] == asked, ids[at], -1)
        return found

    def _allowed(self, before: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        ok = (pieces >= 0) & (before >= 0)
        pairs = (before[ok] << _BITS) | pieces[ok]
        slots, joins = _slots(pairs, _SLOT_BITS), np.empty(len(pairs), dtype=bool)
        hit = self.slot_pairs[slots] == pairs
        joins[hit] = self.slot_joins[slots[hit]]
        if not hit.all():
            rest = pairs[~hit]
            joins[~hit] = found = self._looked_up(rest)
            into, first = np.unique(slots[~hit], return_index=True)
            self.slot_pairs[into], self.slot_joins[into] = rest[first], found[first]
        ok[ok] = joins
        return ok

    def _looked_up(self, pairs: np.ndarray) -> np.ndarray:
        """Whether pairs join, from the sorted table of those tested; new ones are tested and inserted."""
        keys, joins = self.known
        at = np.searchsorted(keys, pairs)
        hit = at < len(keys)
        hit[hit] = keys[at[hit]] == pairs[hit]
        if not hit.all():
            if len(keys) >= 2_000_000:
                keys, joins, hit = keys[:0], joins[:0], np.zeros(len(pairs), dtype=bool)
            new = np.unique(pairs[~hit])
            where = np.searchsorted(keys, new)
            tested = np.fromiter(map(self.tested, new.tolist()), dtype=bool, count=len(new))
            keys, joins = self.known = np.insert(keys, where, new), np.insert(joins, where, tested)
            at = np.searchsorted(keys, pairs)
        return joins[at]

    # -- whole texts -----------------------------------------------------------------------------------

    def decode(self, ids) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4096, _PRIME, dtype=np.uint64)]).astype(np.uint64), dtype=np.uint64)


def _slots(x: np.ndarray, bits: int) -> np.ndarray:
    """Slots of 64-bit values in a table of a power of two."""
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _hashes(points: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the prefixes of each row, the empty one first."""
    out = np.zeros((points.shape[0], points.shape[1] + 1), dtype=np.uint64)
    for i in range(points.shape[1]):
        out[:, i + 1] = out[:, i] * _PRIME + points[:, i] + np.uint64(1)
    return out


class Encoder:
    """Encodes many texts; remembers chunks up to a number of them and of characters."""

    LIMIT, CHARACTERS = 250_000, 16 << 20

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.characters = 0
        self.counts, self.flat, self.used, self.filled = np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0, 0

    def _add(self, chunks: list[str]) -> None:
        counts, flat = self.model.encode_chunks(chunks)
        if self.used + len(counts) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(len(self.counts) + len(counts), np.int64)])
        if self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(flat), np.int32)])
        self.counts[self.used : self.used + len(counts)] = counts
        self.flat[self.filled : self.filled + len(flat)] = flat
        self.used, self.filled = self.used + len(counts), self.filled + len(flat)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and identifiers of the texts; a null text has none."""
        if len(self.codes) > self.LIMIT or self.characters > self.CHARACTERS:
            self._forget()
        codes, order, new = self.codes, [], []
        for text in texts:
            own = self.model.chunks(text or "")
            for c in set(own).difference(codes):
                codes[c] = len(codes)
                new.append(c)
            order.append(np.fromiter(map(codes.__getitem__, own), dtype=np.int64, count=len(own)))
        if new:
            self._add(new)
            self.characters += sum(map(len, new))
        lengths = self.counts[: self.used]
        starts = np.cumsum(lengths) - lengths
        every = np.concatenate(order) if order else np.empty(0, np.int64)
        n = lengths[every]
        ends = np.cumsum(n)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[every] - (ends - n), n)
        per_text = [int(lengths[o].sum()) for o in order]
        return np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64), self.flat[index]


_MODELS: dict[bytes, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    if data not in _MODELS:
        _MODELS[data] = Encoder(Model.read(data))
    return _MODELS[data]


def model_bytes(spark: SparkSession, path: str = DEFAULT_MODEL):
    """The model file as a broadcast; half a megabyte, whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


#: Texts, and bytes of texts, that go to a Python worker at once.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1000, 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Long texts: let few rows and bytes at a time go to Python, which is given this package.

    Plans read these settings when they run, so they stay lowered for the session.
    """
    ship(spark)
    for name, most in (("maxRecordsPerBatch", ROWS_AT_ONCE), ("maxBytesPerBatch", BYTES_AT_ONCE)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def encode(df: DataFrame, path: str = DEFAULT_MODEL, text_col: str = "text", check: bool = False) -> DataFrame:
    """All rows and columns of df with token_ids (array of int) and n_tokens; with check also round_trip,
    whether decoding gives the text back.

    A null or empty text has no tokens and decodes to the empty text. White space other than spaces is
    encoded as bytes or pieces like any character. A literal U+2581 decodes to a space, as in the library.
    Rows that repeat get the same. A text of any length is encoded whole, in chunks between spaces; it and its tokens are held
    at once. An empty table stays empty. Columns of df that have the name of a new column are replaced.
    """
    small_batches(df.sparkSession)
    data = model_bytes(df.sparkSession, path)
    new = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    new += [T.StructField("round_trip", T.BooleanType())] * check
    (text,) = fresh(df, "text__")
    old = [c for c in df.columns if c.lower() not in {f.name for f in new}]
    given = df.select(*old, df[text_col].cast("string").alias(text))

    @trimmed
    def run(batches):
        own = encoder(data.value)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            offsets, ids = own.encode(texts)
            columns = [batch.column(c) for c in old]
            columns += [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(np.diff(offsets))]
            if check:
                columns.append(pa.array([own.model.decode(ids[a:b].tolist()) == (t or "") for t, a, b in zip(texts, offsets, offsets[1:])], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=[*old, *[f.name for f in new]])

    return given.mapInArrow(run, T.StructType([given.schema[c] for c in old] + new))


def decode(df: DataFrame, path: str = DEFAULT_MODEL, ids_col: str = "token_ids") -> DataFrame:
    """All rows and columns of df with decoded, the text of the identifiers; null where they are null."""
    small_batches(df.sparkSession)
    data = model_bytes(df.sparkSession, path)
    (ids,) = fresh(df, "ids__")
    old = [c for c in df.columns if c.lower() != "decoded"]
    given = df.select(*old, df[ids_col].alias(ids))

    @trimmed
    def run(batches):
        model = encoder(data.value).model
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in old], pa.array(texts, pa.string())], names=[*old, "decoded"])

    return given.mapInArrow(run, T.StructType([given.schema[c] for c in old] + [T.StructField("decoded", T.StringType())]))
