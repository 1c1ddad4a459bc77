"""Removal of passages that occur before, by suffix trees over parts of the corpus that a prefix selects.

A window is the first 20 words of a suffix; windows are equal where suffixes meet in a tree at a depth of 20 words or
more. Only suffixes that can meet another are placed in trees, and the trees are small:

* The prefix that selects a suffix's tree ends with the window's anchor, its 6-gram of the smallest hash, so it has 6 to 20
  words, the same ones for equal windows. A first shuffle counts anchors; suffixes whose anchor occurs once meet nothing.
* Suffixes of one anchor lie side by side, so a text sends each anchor once, with the 20 to 34 words that its suffixes
  span: fewer bytes than 20 words for each suffix. The group of an anchor is the forest of the subtrees of all prefixes that
  end with it.
* An anchor whose group would be larger than a tree may be is hot. Its suffixes select their tree by all 20 words.

Groups are dealt by a hash of their key and sorted externally. A task numbers the words of some whole groups by the
words themselves, sorts their suffixes word by word, takes the longest common prefix of each two neighbours, and from
those the internal nodes that are at least 20 words deep. All suffixes below such a node begin with one window; each but the
first is marked, and a text loses the words of its marked windows. Hashes choose what meets, words decide what is equal.

Tasks settle what they can before each shuffle: of equal windows that a batch holds, compared in full, only the first is
sent on, so that a passage found in a third of all texts makes one row per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, fresh, mixed, sequence_hashes, trimmed, word_numbers, word_table
from tessera.llm.spm import small_batches

DEPTH, GRAM = 20, 6
#: A table of ids that repeat of at most so many rows is broadcast.
BROADCAST_ROWS = 200_000
#: An anchor with more occurrences than this, and than a millionth of all recurring ones, is hot; so a million of them at most are broadcast, 8 MB.
HOT_ROWS, HOT_SHARE = 2_000, 1_000_000
#: Trees are built over so many suffixes at once, and over one group's by parts if it has more.
SUFFIXES_AT_ONCE = 200_000
_ANCHORS = "anchor long, id__ long, tie__ long, pos int, weight int"
_SUFFIXES = "group int, key array<long>, words array<binary>, mask array<int>, id__ array<long>, tie__ array<long>, start array<int>, run array<int>"
_MARKS = "id__ long, tie__ long, mark long"


# -- the trees ----------------------------------------------------------------------------------------


def sorted_suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by their words, given as rows of numbers, and the words that each shares with the one before.

    Rows are padded with numbers that occur nowhere else in their column, or are all of one length.
    """
    n, width = words.shape
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide = words.astype(np.uint64)
    packed = [wide[:, k] << np.uint64(32) | wide[:, k + 1] if k + 1 < width else wide[:, k] for k in range(0, width, 2)]
    order = np.lexsort(packed[::-1])
    own = words[order]
    shared = np.zeros(n, dtype=np.int64)
    shared[1:] = np.cumprod(own[1:] == own[:-1], axis=1).sum(axis=1)
    return order, shared


def deep_nodes(shared: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Internal nodes of the tree of sorted suffixes, at least so many words deep: (depth, first, last suffix), the outermost first.

    An internal node is a longest run of suffixes whose neighbours share its depth or more, and one pair shares no more.
    """
    out = []
    for depth in np.unique(shared[shared >= least]).tolist():
        edges = np.flatnonzero(np.diff(np.concatenate([[False], shared >= depth, [False]]).astype(np.int8)))
        for first, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if shared[first:end].min() == depth:
                out.append((depth, first - 1, end - 1))
    return out


def _outermost(shared: np.ndarray, least: int) -> np.ndarray:
    """The outermost deep node of each sorted suffix, by number, where suffixes of no such node are alone: all nodes at once."""
    return np.cumsum(shared < least) - 1


# -- the suffixes -------------------------------------------------------------------------------------


class _Batch:
    """The words of a batch of texts in one run of bytes, single-spaced, with hashes of all windows that lie inside a text."""

    def __init__(self, batch: pa.RecordBatch, text: str):
        texts = [b" ".join((t or b"").split()) for t in batch.column(text).cast(pa.binary()).to_pylist()]
        self.data, lengths, self.begin, self.end, self.hashes = word_table(texts)
        self.ids = batch.column("id__").to_numpy(zero_copy_only=False)
        self.ties = batch.column("tie__").to_numpy(zero_copy_only=False)
        self.first = np.cumsum(lengths) - lengths
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        self.grams = sequence_hashes(self.hashes, GRAM)
        n = max(0, len(self.hashes) - DEPTH + 1)
        if n:
            starts = np.flatnonzero(self.text[:n] == self.text[DEPTH - 1 :])
            smallest = np.lib.stride_tricks.sliding_window_view(self.grams, DEPTH - GRAM + 1)
            self.starts, self.anchors = starts, starts + np.concatenate([smallest[k : k + 100_000].argmin(axis=1) for k in range(0, n, 100_000)])[starts]
        else:
            self.starts = self.anchors = np.empty(0, np.int64)

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id, tie and position in the text of positions in the batch."""
        text = self.text[at]
        return self.ids[text], self.ties[text], (at - self.first[text]).astype(np.int32)

    def same_window(self, a: int, b: int) -> bool:
        return self.data[self.begin[a] : self.end[a + DEPTH - 1]] == self.data[self.begin[b] : self.end[b + DEPTH - 1]]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _own_key(ids, ties, at) -> np.ndarray:
    """Keys that meet no others, for rows that are settled already."""
    return mixed(mixed(ids.view(np.uint64) ^ mixed(ties.view(np.uint64))) + at.astype(np.uint64))


def _anchors(text: str):
    """Anchors of the texts; of those that a batch holds several times, one with their number as weight and the others under keys of their own."""

    @trimmed
    def run(batches):
        for batch in batches:
            b = _Batch(batch, text)
            at = np.unique(b.anchors)
            keys = b.grams[at]
            order = np.argsort(keys, kind="stable")
            at, keys = at[order], keys[order]
            head = np.ones(len(keys), dtype=bool)
            head[1:] = keys[1:] != keys[:-1]
            places = np.flatnonzero(head)
            weight = np.full(len(keys), 2, dtype=np.int32)  # settled ones: they recur
            weight[places] = np.diff(np.append(places, len(keys)))
            ids, ties, pos = b.place(at)
            keys = np.where(head, keys, _own_key(ids, ties, pos))
            back = np.argsort(at)  # in the texts' order, which compresses better
            keys, ids, ties, pos, weight = (x[back] for x in (keys, ids, ties, pos, weight))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (_signed(keys), ids, ties, pos, weight)], names=["anchor", "id__", "tie__", "pos", "weight"])

    return run


def _settled(b: _Batch, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of window starts in a batch, two masks: those whose words an earlier text or place of the batch holds too, and those of a row that is there twice."""
    path = sequence_hashes(b.hashes, DEPTH)[at]
    ids, ties, pos = b.place(at)
    order = np.lexsort((pos, ties, ids, path))
    path = path[order]
    head = np.ones(len(at), dtype=bool)
    head[1:] = path[1:] != path[:-1]
    of = order[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
    earlier, twice = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
    again, first = order[~head], of[~head]
    twice[again] = (ids[again] == ids[first]) & (ties[again] == ties[first]) & (pos[again] == pos[first])
    earlier[again] = [b.same_window(x, y) for x, y in zip(at[again].tolist(), at[first].tolist())]
    return earlier & ~twice, twice


def _runs(at: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of runs of consecutive numbers that are alike in `same`, and the runs' lengths."""
    begins = np.ones(len(at), dtype=bool)
    begins[1:] = (np.diff(at) != 1) | (same[1:] != same[:-1])
    places = np.flatnonzero(begins)
    return places, np.diff(np.append(places, len(at)))


def _suffixes(text: str, groups: int, hot):
    """Suffixes at windows of recurring anchors, those of one anchor in one row; windows that the batch holds before, as runs of marks.

    A batch makes one row for each group that it has suffixes of, with the suffixes in arrays, which take fewer bytes than
    rows. A mask has a bit for each word of the row at which a suffix starts.
    """

    @trimmed
    def run(batches):
        known = hot.value
        for batch in batches:
            b = _Batch(batch, text)
            recurs = np.zeros(len(b.text), dtype=bool)
            for i, own in enumerate(batch.column("recurring").to_pylist()):
                recurs[np.array(own, dtype=np.int64) + b.first[i]] = True
            chosen = recurs[b.anchors]
            at, anchor = b.starts[chosen], b.anchors[chosen]
            settled, twice = _settled(b, at) if len(at) else (np.empty(0, bool), np.empty(0, bool))
            places, runs = _runs(at[settled], b.text[at[settled]])
            marked = at[settled][places]
            at, anchor = at[~settled & ~twice], anchor[~settled & ~twice]
            keys = b.grams[anchor] if len(at) else np.empty(0, np.uint64)
            spread = np.isin(keys, known)
            keys = np.where(spread, sequence_hashes(b.hashes, DEPTH)[at], keys) if len(at) else keys
            begins = np.ones(len(at), dtype=bool)
            begins[1:] = (anchor[1:] != anchor[:-1]) | spread[1:]
            first = np.flatnonzero(begins)
            last = np.append(first[1:], len(at)) - 1 if len(at) else first
            mask = np.bitwise_or.reduceat(np.int64(1) << (at - at[first][np.cumsum(begins) - 1]), first) if len(at) else np.empty(0, np.int64)
            spans = zip(b.begin[at[first]].tolist(), b.end[at[last] + DEPTH - 1].tolist()) if len(at) else ()
            words = [b.data[x:y] for x, y in spans] + [b""] * len(marked)
            place, more = b.place(at[first]), b.place(marked)
            columns = {
                "key": pa.array(_signed(np.concatenate([keys[first], _own_key(*more)]))), "words": pa.array(words, pa.binary()), "mask": pa.array(np.concatenate([mask, np.zeros(len(marked), np.int64)]).astype(np.int32)),
                "id__": pa.array(np.concatenate([place[0], more[0]])), "tie__": pa.array(np.concatenate([place[1], more[1]])), "start": pa.array(np.concatenate([place[2], more[2]])),
                "run": pa.array(np.concatenate([np.zeros(len(first), np.int32), runs.astype(np.int32)])),
            }
            group = (np.concatenate([keys[first], _own_key(*more)]) >> np.uint64(20)).astype(np.int64) % groups
            order = np.argsort(group, kind="stable")
            found, begin = np.unique(group[order], return_index=True)
            offsets = pa.array(np.concatenate([begin, [len(order)]]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, v.take(pa.array(order))) for v in columns.values()]
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *lists], names=["group", *columns])

    return run


# -- the walk -----------------------------------------------------------------------------------------


def _solved(rows: pa.Table) -> pa.RecordBatch:
    """Marks (id, tie, start << 32 | run) of whole groups of suffixes."""
    ids, ties, start = (rows.column(c).to_numpy() for c in ("id__", "tie__", "start"))
    run, mask = rows.column("run").to_numpy().astype(np.int64), rows.column("mask").to_numpy().astype(np.int64)
    lists = [w.split(b" ") for w in rows.column("words").to_pylist()]
    first = np.cumsum([0, *map(len, lists)])[:-1]
    numbers = word_numbers([w for own in lists for w in own]).astype(np.uint32)
    bits = (mask[:, None] >> np.arange(DEPTH - GRAM + 1)) & 1
    row, offset = np.nonzero(bits)
    at, marked = first[row] + offset, np.zeros(len(row), dtype=bool)
    where = (ids[row], ties[row], start[row] + offset)
    order = np.lexsort(where[::-1])
    place = np.zeros(len(row), dtype=np.int64)  # equal where a row is there twice
    place[order[1:]] = np.cumsum(np.any([x[order[1:]] != x[order[:-1]] for x in where], axis=0))
    # equal windows have their first words in common, so parts by those hold whole nodes
    parts = -(-len(row) // SUFFIXES_AT_ONCE)
    part_of = mixed(numbers[at].astype(np.uint64) << np.uint64(32) | numbers[at + 1]) % np.uint64(max(1, parts))
    for part in range(parts):
        some = np.flatnonzero(part_of == part)
        order, shared = sorted_suffixes(numbers[at[some][:, None] + np.arange(DEPTH)])
        own = some[order]
        node = _outermost(shared, DEPTH)
        if len(own):
            earliest = np.minimum.reduceat(place[own], np.flatnonzero(shared < DEPTH))
            marked[own] = place[own] != earliest[node]
    row, offset = row[marked], offset[marked]
    places, runs = _runs(offset, row)
    old = np.flatnonzero(run)
    who = np.concatenate([row[places], old])
    where = np.concatenate([start[row[places]] + offset[places], start[old]]).astype(np.int64)
    marks = where << 32 | np.concatenate([runs, run[old]])
    return pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(ties[who]), pa.array(marks)], names=["id__", "tie__", "mark"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solve rows that come sorted by key, some whole groups at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        held.append(batch)
        size += batch.num_rows
        if size * (DEPTH - GRAM + 1) < SUFFIXES_AT_ONCE:
            continue
        open_from = int(np.flatnonzero(key == key[-1])[0])  # the last group may go on in the next batch
        if open_from == 0 and len(held) > 1 and held[-2].column("key")[-1].as_py() == key[0]:
            continue
        done = pa.Table.from_batches([*held[:-1], batch.slice(0, open_from)])
        if done.num_rows:
            yield _solved(done)
        held, size = [batch.slice(open_from)], batch.num_rows - open_from
    if held:
        yield _solved(pa.Table.from_batches(held))


def _remover(text: str, old: list[str], with_spans: bool):
    @trimmed
    def run(batches):
        for batch in batches:
            kept, n_words, n_removed, spans = [], [], [], []
            for t, marks in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column("marks").to_pylist()):
                words = (t or b"").split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                if marks:
                    own = np.array(marks, dtype=np.int64)
                    starts, runs = own >> 32, own & 0xFFFFFFFF
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, np.minimum(starts + runs + DEPTH - 1, len(words)), -1)
                gone = np.cumsum(gone) > 0
                gone[-1] = False
                if with_spans:
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)))
                    spans.append([{"first_word": a, "n_words": b - a} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())])
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if n_removed[-1] else words).decode())
            columns = [*[batch.column(c) for c in old], pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())] + [pa.array(spans, _SPANS)] * with_spans
            yield pa.RecordBatch.from_arrays(columns, names=[*old, *list(_NEW)[: 3 + with_spans]])

    return run


_SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32())]))
_SPANS_TYPE = T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))
_NEW = {"kept_text": T.StringType(), "n_words": T.LongType(), "n_removed": T.LongType(), "removed_spans": _SPANS_TYPE}


# -- the tables ---------------------------------------------------------------------------------------


def _keyed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """df with id__ and tie__, and which of them make the key; tie__ is 0 but for rows whose id repeats, where it is a hash of the text."""
    own = df.withColumns({"id__": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))})
    repeated = cut(own.groupBy("id__").count().filter("count > 1").select(F.col("id__").alias("again__")), "substring-ids")
    n = repeated.count()
    if not n:
        return own.withColumn("tie__", F.lit(0).cast("long")), ["id__"]
    joined = own.join(F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated, F.col("id__") == F.col("again__"), "left")
    tie = F.when(F.col("again__").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text_col))
    return joined.withColumn("tie__", tie).drop("again__"), ["id__", "tie__"]


def _hot(recurring: DataFrame) -> np.ndarray:
    """Anchors of many occurrences, at most a million; the rows of one anchor that tasks settled count in its weight."""
    total = recurring.count()
    most = max(HOT_ROWS, total // HOT_SHARE)
    own = recurring.filter(F.col("seen") > most).select("anchor").distinct().toPandas()["anchor"]
    return np.sort(own.to_numpy(np.int64).view(np.uint64))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """All rows and columns of df with kept_text, n_words, n_removed and, with spans, removed_spans.

    A word goes if a window of 20 consecutive words of its text covers it whose words also start earlier: in a text of a
    smaller id, or earlier in the same text. kept_text has the other words, joined by single spaces; removed_spans, an
    array<struct<first_word, n_words>>, has the longest runs of removed words, by place. Ids are integers; a null id comes
    before all others. Texts that share an id come in the order of a hash of their text; rows that share both are one text,
    lose the same, and nothing to each other. A null or empty text, or one of white space, has no words. A very long text is one row of a batch and
    takes memory in proportion to itself. An empty table stays empty. Columns of df that have the name of a new column are
    replaced.
    """
    spark = df.sparkSession
    small_batches(spark)
    clash = dict(zip(df.columns, fresh(df.limit(0).select(*[F.lit(0).alias(n) for n in ("id__", "tie__", "again__", "marks", "recurring")]), *df.columns)))
    safe = df.withColumnsRenamed(clash)
    docs, key = _keyed(safe, clash[id_col], clash[text_col])
    text = clash[text_col]
    asked = docs.select("id__", "tie__", text).mapInArrow(_anchors(text), _ANCHORS).withColumn("seen", F.sum("weight").over(Window.partitionBy("anchor")))
    found = cut(asked.filter("seen > 1").select("anchor", *key, "pos", "seen"), "substring-anchors")
    hot = spark.sparkContext.broadcast(_hot(found))
    recurring = found.groupBy(*key).agg(F.collect_list("pos").alias("recurring"))
    # both joins take all columns of docs, so that they share one exchange of the texts
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    suffixes = docs.join(recurring, key).mapInArrow(_suffixes(text, 4 * parts, hot), _SUFFIXES)
    dealt = suffixes.repartition(parts, "group").select(F.inline(F.arrays_zip("key", "words", "mask", "id__", "tie__", "start", "run")))
    marks = dealt.sortWithinPartitions("key").mapInArrow(_walk, _MARKS).groupBy(*key).agg(F.collect_list("mark").alias("marks"))
    new = [T.StructField(n, t) for n, t in list(_NEW.items())[: 3 + spans]]
    old = [c for c in safe.columns if c.lower() not in {f.name for f in new}]
    out = docs.join(marks, key, "left").mapInArrow(_remover(text, old, spans), T.StructType([safe.schema[c] for c in old] + new))
    back = {v: k for k, v in clash.items() if v in old}
    return out.withColumnsRenamed(back)
