"""Exact n-gram Jaccard self-join and its components, with R-trees over count vectors.

A text is a set of hashed shingles. Texts of the same words form a class, the node of the graph, found by a 128-bit
cryptographic hash of the words; a class goes by 63 of its bits, or by a number of its own where those meet another's. Hashing
a set's shingles to groups and counting gives a point; the overlap of two sets is at most the sum of their points' smaller
coordinates, and over a box of points at most the sum with the box's upper corner. A point has a power of two of
coordinates, one or two shingles in each, and folds onto half as many by adding halves.

One tree over all points would meet every query with most of its leaves, as points of unrelated texts of one length lie
close together in every group. So the points are dealt to many small trees: sets that are similar enough share a
shingle among their first n - ceil(0.8 n) + 1, in an order where shingles known to be frequent come last; each such
shingle is a shard with a tree of its own. Shards are resolved in rounds that lose no link:

* A few members of each shard, drawn by hash, meet its members in other components; links found join components, and
  shards that lie in one component are done. This is repeated while it finds links and the rest is large.
* In the shards left over, the R-tree finds all pairs across components that the bound allows. Shards of more than 1,024
  members are split into tiles by size and by hash, and pairs of tiles whose sizes can match are separate groups: a shard of
  M members of one size, all in different components, makes M * M / 1,024 rows.

Surviving pairs are verified on the words of whole texts, so that hashes choose what is compared and decide nothing. Pairs
inside a component need no test, so a group of many near copies costs links in proportion to its members. A shingle known to be
frequent deals its members to several tasks by a salt, and so does a text that many pairs have in common.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import FOLD, cut, discard, fresh, mixed, release, sequence_hashes, trimmed, word_hashes, word_numbers
from tessera.llm.spm import small_batches

SHINGLE, PERCENT = 5, 80
LEAF, FAN, TILE = 16, 16, 1024
#: Coordinates of a point lie between these bounds; a tree's boxes use fewer.
LEAST_GROUPS, MOST_GROUPS, TREE_GROUPS, COARSE_GROUPS = 16, 1 << 16, 128, 64
#: Members of a shard that meet the others in a round; at most so many rounds; a rest of so many pairs per row ends them.
STARS, ROUNDS, FEW = 3, 8, 4
#: Shards that a member keeps, the smallest, to report a pair in one shard only.
KEYS = 64
#: So few links are joined into components in one task.
FEW_LINKS = 100_000
#: A shingle is counted as frequent once a batch of texts holds it so often; at most so many are kept, the most frequent.
OFTEN, FREQUENT = 4, 1_000_000
#: Tables of a few numbers a row, up to so many rows, are broadcast: some 10 MB.
BROADCAST_ROWS = 200_000
#: Rows of one shingle, or pairs of one text, beyond which they are dealt by a salt.
SALT_ROWS = 1000
#: Bits of a class's hash that number it.
CLASS_BITS = 63


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles, A-Z in lower case; with fewer words the whole sequence is one."""
    lengths, hashes = word_hashes(texts, folded=True)
    full = mixed(sequence_hashes(hashes, size) + np.uint64(size))
    out, at = [], 0
    for n in lengths.tolist():
        if n >= size:
            out.append(np.unique(full[at : at + n - size + 1]))
        else:
            out.append(mixed(sequence_hashes(hashes[at : at + n], n) + np.uint64(n)) if n else np.empty(0, np.uint64))
        at += n
    return out


def digests(texts: list[bytes | None]) -> list[bytes | None]:
    """A 128-bit hash of each text's words, A-Z in lower case; none for a text without words."""
    folded = [b" ".join((t or b"").translate(FOLD).split()) for t in texts]
    return [hashlib.blake2b(t, digest_size=16).digest() if t else None for t in folded]


def class_numbers(found: list[bytes | None], own: dict[bytes, int] | None = None) -> list[int]:
    """Numbers of classes by their digests: positive ones by hash, or those given; 0 for texts without words."""
    bits = 64 - CLASS_BITS
    return [0 if d is None else (own or {}).get(d) or (int.from_bytes(d[:8], "little") >> bits) | 1 for d in found]


def exact_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct numbers of each text's shingles, A-Z in lower case; equal in all these texts where the words are, by the words themselves."""
    lists = [(t or b"").translate(FOLD).split() for t in texts]
    numbers = word_numbers([w for words in lists for w in words])
    have, power, every, at = 0, 1, None, numbers
    while len(numbers) >= size:
        if size & power:
            every = at if every is None else _joined(every, at, have)
            have += power
        if have == size:
            break
        at = _joined(at, at, power)
        power *= 2
    short: dict[tuple, int] = {}
    out, start = [], 0
    for words in lists:
        n = len(words)
        if n >= size:
            out.append(np.unique(every[start : start + n - size + 1]))
        else:  # the whole sequence; its number meets no full shingle's
            out.append(np.array([-1 - short.setdefault(tuple(words), len(short))] if n else [], dtype=np.int64))
        start += n
    return out


def _joined(left: np.ndarray, right: np.ndarray, gap: int) -> np.ndarray:
    """Numbers of left[i] followed by right[i + gap]: equal where both are."""
    n = min(len(left), len(right) - gap)
    if n <= 0:
        return np.empty(0, np.int64)
    return np.unique(left[:n] * (int(right.max()) + 1) + right[gap : gap + n], return_inverse=True)[1].astype(np.int64)


def groups_of(n: int) -> int:
    return min(MOST_GROUPS, max(LEAST_GROUPS, (1 << (max(n, 1) - 1).bit_length()) // 2))


def point(shingle_set: np.ndarray) -> bytes:
    """Counts per group, as bytes, or as pairs of bytes where one is over 255; the first byte tells which."""
    groups = groups_of(len(shingle_set))
    counts = np.bincount((shingle_set >> np.uint64(40)).astype(np.int64) & (groups - 1), minlength=groups)
    return packed(counts)


def packed(counts: np.ndarray) -> bytes:
    wide = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([wide]) + counts.astype(f"<u{wide}").tobytes()


def point_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Points in a matrix, or one point, on fewer coordinates."""
    while points.shape[-1] > groups:
        half = points.shape[-1] // 2
        points = points[..., :half].astype(np.uint32) + points[..., half:].astype(np.uint32)
    return points


def least_overlap(a, b, percent: int = PERCENT):
    """The smallest overlap of sets of a and b members that reaches the threshold."""
    return -(-percent * (a + b) // (100 + percent))


# -- the tree -----------------------------------------------------------------------------------------


class RTree:
    """Points with sizes and components, packed by size and then by their largest spread; answers which points a query may match."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, parts: np.ndarray):
        order = self._pack(points, sizes)
        self.order, self.points, self.sizes, self.parts = order, points[order], sizes[order], parts[order]
        level = [self._box(np.arange(k, min(k + LEAF, len(order)))) for k in range(0, len(order), LEAF)]
        self.leaves = level
        while len(level) > 1:
            level = [self._join(level[k : k + FAN]) for k in range(0, len(level), FAN)]
        self.root = level[0] if level else None

    @staticmethod
    def _pack(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sort-tile-recursive packing over the size and the two coordinates of the largest variance."""
        wide = np.argsort(points.var(axis=0))[::-1][:2] if len(points) else [0, 0]
        tile = LEAF * FAN
        rank = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // tile
        return np.lexsort((points[:, wide[1]], points[:, wide[0]], rank))

    def _box(self, at: np.ndarray) -> tuple:
        own = self.parts[at]
        return (self.points[at].max(axis=0), self.sizes[at].min(), self.sizes[at].max(), own[0] if (own == own[0]).all() else None, at, None)

    @staticmethod
    def _join(boxes: list[tuple]) -> tuple:
        part = boxes[0][3] if all(b[3] is not None and b[3] == boxes[0][3] for b in boxes) else None
        return (np.max([b[0] for b in boxes], axis=0), min(b[1] for b in boxes), max(b[2] for b in boxes), part, None, boxes)

    def matches(self, point: np.ndarray, size: int, part: int, percent: int = PERCENT) -> np.ndarray:
        """Indexes of points in other components that the bound on the overlap does not rule out."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            upper, low, high, own, at, below = todo.pop()
            if own == part or 100 * low > high_size(size, percent) or 100 * high < percent * size:
                continue
            if int(np.minimum(upper, point).sum(dtype=np.int64)) < least_overlap(size, max(low, -(-percent * size // 100)), percent):
                continue
            if below is not None:
                todo += below
                continue
            bound = np.minimum(self.points[at], point).sum(axis=1, dtype=np.int64)
            ok = (bound >= least_overlap(size, self.sizes[at], percent)) & (self.parts[at] != part)
            found.append(at[ok])
        return self.order[np.concatenate(found)] if found else np.empty(0, np.int64)


def high_size(size: int, percent: int) -> int:
    """100 times the largest size that a set of this size can match."""
    return 100 * (100 * size // percent)


def tree_pairs(left: dict[str, np.ndarray], right: dict[str, np.ndarray] | None = None, percent: int = PERCENT, fine=None) -> np.ndarray:
    """Pairs (smaller class, larger class) that may link: within one group, or with right across two.

    fine(c, others) tells which of the others may still match by their whole points; it is asked query by query, so that no
    more pairs are held than pass.
    """
    index = RTree(left["point"], left["n"], left["part"])
    probe, pairs = left if right is None else right, []
    for p, n, part, c in zip(probe["point"], probe["n"].tolist(), probe["part"].tolist(), probe["c"].tolist()):
        other = left["c"][index.matches(p, n, part, percent)]
        if right is None:
            other = other[other > c]
        if fine is not None and len(other):
            other = other[fine(c, other)]
        if len(other):
            pairs.append(np.stack([np.minimum(other, c), np.maximum(other, c)], axis=1))
    return np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)


# -- stages -------------------------------------------------------------------------------------------


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text__").cast(pa.binary()).to_pylist()


def _members(size: int):
    """(kind 0, id, class, n, point, digest) of each text; (kind 1, shingle, texts) of shingles that recur in the batch."""

    @trimmed
    def run(batches):
        for batch in batches:
            texts = _texts(batch)
            sets, marks = shingle_sets(texts, size), digests(texts)
            classes = np.array(class_numbers(marks), dtype=np.int64)
            counts = np.array([len(s) for s in sets], dtype=np.int64)
            firsts = np.unique(classes, return_index=True)[1]
            values, often = np.unique(np.concatenate([sets[i] for i in firsts]) if len(firsts) else np.empty(0, np.uint64), return_counts=True)
            values, often = values[often >= OFTEN], often[often >= OFTEN]
            points: list[bytes | None] = [None] * len(sets)
            coarse: list[bytes | None] = [None] * len(sets)
            for i in firsts.tolist():
                points[i] = point(sets[i])
                coarse[i] = packed(folded(point_of(points[i]), COARSE_GROUPS))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(len(sets), np.int32), np.ones(len(values), np.int32)])),
                    pa.concat_arrays([batch.column("id__"), pa.nulls(len(values), pa.int64())]),
                    pa.array(np.concatenate([classes, values.view(np.int64)])),
                    pa.array(np.concatenate([counts, often])),
                    pa.concat_arrays([pa.array(points, pa.binary()), pa.nulls(len(values), pa.binary())]),
                    pa.concat_arrays([pa.array(coarse, pa.binary()), pa.nulls(len(values), pa.binary())]),
                    pa.concat_arrays([pa.array(marks, pa.binary()), pa.nulls(len(values), pa.binary())]),
                ],
                names=["kind", "id", "c", "n", "point", "coarse", "digest"],
            )

    return run


def _prefixes(size: int, percent: int, frequent, numbers):
    """(shingle, class, n, salts) for the shingles that a text shares at least one of with any similar text; a class once in a batch."""

    @trimmed
    def run(batches):
        known, often = frequent.value
        rank, salts = 1 + np.log2(np.maximum(often, 1)).astype(np.int32), salts_of(often)
        for batch in batches:
            texts = _texts(batch)
            own = dict(zip(class_numbers(digests(texts), numbers.value), shingle_sets(texts, size)))
            own.pop(0, None)
            if not own:
                continue
            classes, lengths = np.array(list(own), dtype=np.int64), np.array([len(s) for s in own.values()], dtype=np.int64)
            every, owner = np.concatenate(list(own.values())), np.repeat(np.arange(len(lengths)), lengths)
            late, dealt = np.zeros(len(every), dtype=np.int32), np.ones(len(every), dtype=np.int32)
            if len(known):
                at = np.minimum(np.searchsorted(known, every), len(known) - 1)
                late, dealt = (np.where(known[at] == every, x[at], y) for x, y in ((rank, late), (salts, dealt)))
            order = np.lexsort((every, late, owner))
            first = np.cumsum(lengths) - lengths
            keep = np.arange(len(every)) - np.repeat(first, lengths) < np.repeat(lengths - -(-percent * lengths // 100) + 1, lengths)
            chosen = order[keep]
            columns = [every[chosen].view(np.int64), classes[owner[chosen]], lengths[owner[chosen]], dealt[chosen].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shingle", "c", "n", "salts"])

    return run


def salts_of(rows: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-rows // SALT_ROWS)).astype(np.int32)


def _holders(wanted_col: str, numbers):
    """(class, text) of texts whose class is the one wanted of their id."""

    @trimmed
    def run(batches):
        for batch in batches:
            texts, wanted = _texts(batch), batch.column(wanted_col).to_pylist()
            rows = {c: t for c, t, w in zip(class_numbers(digests(texts), numbers.value), texts, wanted) if c in w}
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], names=["c", "text"])

    return run


def _points_of(column) -> list[np.ndarray]:
    return [point_of(x) for x in column]


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    groups = min(len(a), len(b))
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum(dtype=np.int64))


def _bounded(percent: int, column: str):
    @trimmed
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                bound = np.array([overlap_bound(a, b) for a, b in zip(_points_of(f[f"{column}_a"]), _points_of(f[f"{column}_b"]))])
                yield f.loc[bound >= least_overlap(f["n_a"].to_numpy(), f["n_b"].to_numpy(), percent), ["a", "b"]]

    return run


def _verified(size: int, percent: int):
    @trimmed
    def run(batches):
        for batch in batches:
            known: dict = {}
            sides = []
            for side in ("a", "b"):
                ids, texts = batch.column(side).to_pylist(), batch.column(f"text_{side}").to_pylist()
                new = {i: t for i, t in zip(ids, texts) if i not in known}
                known.update(new)
                sides.append(ids)
            known = dict(zip(known, exact_sets(list(known.values()), size)))
            ok = []
            for a, b in zip(*sides):
                x, y = known[a], known[b]
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


_NOWHERE = object()


def _home(a: np.ndarray, b: np.ndarray) -> int | None:
    """The shard that a pair is reported in: the smallest that both keep among their first ones, or any if there is none.

    Of the shards that two members share, one that is smaller than a shared kept one is kept by both, so all their shards agree.
    """
    common = np.intersect1d(a, b, assume_unique=True)
    return int(common[0]) if len(common) else None


def _small_pairs(f: pd.DataFrame, begins: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of groups of up to a leaf's members, where the tree is that leaf: all groups of one size are enumerated at once."""
    n, part, c, points = f["n"].to_numpy(), f["part"].to_numpy(), f["c"].to_numpy(), f["point"].to_numpy()
    shingle, keys = f["shingle"].to_numpy(), f["keys"].to_numpy()
    lefts, rights = [], []
    for k in np.unique(sizes).tolist():
        if k > 1:
            i, j = np.triu_indices(k, 1)
            at = begins[sizes == k][:, None]
            lefts.append((at + i).ravel())
            rights.append((at + j).ravel())
    if not lefts:
        return np.empty((0, 2), np.int64)
    x, y = np.concatenate(lefts), np.concatenate(rights)
    fit = (part[x] != part[y]) & (c[x] != c[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
    x, y = x[fit], y[fit]
    pairs, first, of = np.unique(np.stack([np.minimum(c[x], c[y]), np.maximum(c[x], c[y])], axis=1), axis=0, return_index=True, return_inverse=True)
    home = np.full(len(pairs), _NOWHERE, dtype=object)
    for k, (a, b) in enumerate(zip(x[first].tolist(), y[first].tolist())):
        if overlap_bound(point_of(points[a]), point_of(points[b])) >= least_overlap(n[a], n[b], percent):
            home[k] = _home(keys[a], keys[b])
    here = {k for k, s in zip(of.ravel().tolist(), shingle[x].tolist()) if home[k] is None or home[k] == s}
    return pairs[sorted(here)]


def _large_pairs(group: pd.DataFrame, percent: int) -> np.ndarray:
    """Pairs of one group by R-trees over points folded to a tree's width, then by the bound on the whole points.

    There is a tree for each number of coordinates, over the points that have it or its double: sets that may match differ
    in size by less than a factor of two, so both of a pair are in the tree of the smaller number.
    """
    points, out = _points_of(group["point"]), []
    own = np.array([len(p) for p in points])
    low, high = group["low"].iat[0], group["high"].iat[0]
    first = (group["tile"] == low).to_numpy()
    c = group["c"].to_numpy()
    n, place = dict(zip(c.tolist(), group["n"].tolist())), {k: i for i, k in enumerate(c.tolist())}

    keys, shard = group["keys"].to_numpy(), int(group["shingle"].iat[0])

    def fine(one: int, others: np.ndarray) -> np.ndarray:
        i, out = place[one], []
        for x in others.tolist():
            j = place[x]
            out.append(overlap_bound(points[i], points[j]) >= least_overlap(n[one], n[x], percent) and _home(keys[i], keys[j]) in (None, shard))
        return np.array(out, dtype=bool)

    for groups in np.unique(own).tolist():
        near = (own == groups) | (own == 2 * groups)

        def side(mask, groups=groups):
            at = np.flatnonzero(mask)
            width = min(groups, TREE_GROUPS)
            matrix = np.stack([folded(points[i], width).astype(np.uint32) for i in at]) if len(at) else np.empty((0, width), np.uint32)
            return {"point": matrix, "n": group["n"].to_numpy()[at], "part": group["part"].to_numpy()[at], "c": c[at]}

        out.append(tree_pairs(side(near & first), None if low == high else side(near & ~first), percent, fine))
    return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)


def _searched(percent: int):
    """Pairs that each group's tree lets through; rows come sorted by group, and one batch and an unfinished group are held at a time."""

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        keys = f[["shingle", "low", "high"]].to_numpy()
        begins = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
        sizes = np.diff(np.concatenate([begins, [len(f)]]))
        small = (sizes <= LEAF) & (keys[begins, 1] == keys[begins, 2])
        out = [_small_pairs(f, begins[small], sizes[small], percent)]
        out += [_large_pairs(f.iloc[b : b + k], percent) for b, k in zip(begins[~small], sizes[~small])]
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])

    @trimmed
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            if not len(f):
                continue
            last = (f[["shingle", "low", "high"]] == f[["shingle", "low", "high"]].iloc[-1]).all(axis=1).to_numpy()
            open_from = len(f) - int(np.argmin(last[::-1])) if not last.all() else 0
            if open_from == 0 and held and (held[-1][["shingle", "low", "high"]].iloc[-1] == f[["shingle", "low", "high"]].iloc[0]).all():
                held.append(f)  # the group goes on through the whole batch
                continue
            done = pd.concat([*held, f.iloc[:open_from]])
            if len(done):
                yield solve(done)
            held = [f.iloc[open_from:]]
        if held:
            yield solve(pd.concat(held))

    return run


# -- components ---------------------------------------------------------------------------------------


def _united(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of a few links in one task: each node with the smallest that it reaches."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for f in frames:
        for a, b in zip(f["a"].tolist(), f["b"].tolist()):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pd.DataFrame({"c": np.array(nodes, dtype=np.int64), "part": np.array([root(x) for x in nodes], dtype=np.int64)})


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (c, part): part is the smallest node that c reaches. Up to 100,000 links are joined in one task, more by stars."""
    if edges.count() <= FEW_LINKS:
        return cut(edges.select("a", "b").coalesce(1).mapInPandas(_united, "c long, part long"), "jaccard-parts")
    return components_by_stars(edges)


def components_by_stars(edges: DataFrame) -> DataFrame:
    """Components by large-star and small-star steps until nothing changes."""
    own = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    seen = None
    while True:
        both = own.union(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        own = cut(small, "links")
        state = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == seen:
            return own.select(F.col("u").alias("c"), F.col("v").alias("part")).union(own.select(F.col("v").alias("c"), F.col("v").alias("part")).distinct())
        seen = tuple(state)


# -- the join -----------------------------------------------------------------------------------------


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _both(pairs: DataFrame, nodes: DataFrame, columns: list[str], ends: DataFrame, most: int) -> DataFrame:
    """pairs with columns of both nodes; a node of many pairs is dealt to several tasks, each of which gets a copy of it.

    ends(c, pairs) counts each node's pairs, and most is the largest count.
    """
    salts = F.ceil(F.col("pairs") / SALT_ROWS).cast("int")
    hot = _small(ends.filter(F.col("pairs") > SALT_ROWS).select("c", salts.alias("salts"))) if most > SALT_ROWS else None
    for side, other in (("a", "b"), ("b", "a")):
        own = nodes.select(F.col("c").alias(side), *[F.col(m).alias(f"{m}_{side}") for m in columns])
        if hot is None:
            pairs = pairs.join(own, side)
            continue
        of_side = hot.withColumnRenamed("c", side)
        own = own.join(of_side, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        dealt = pairs.join(of_side, side, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        pairs = dealt.join(own, [side, "salt"]).drop("salt")
    return pairs


def _ends(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(c, pairs) of the nodes in pairs, and the largest number of pairs."""
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("pairs")), "jaccard-ends")
    return ends, ends.agg(F.coalesce(F.max("pairs"), F.lit(0))).first()[0]


def _fits(n: Column, m: Column, percent: int) -> Column:
    return (100 * F.least(n, m)) >= (percent * F.greatest(n, m))


def _no_links(spark) -> DataFrame:
    return spark.createDataFrame([], "a long, b long")


class _Join:
    """The stages of one join, over tables cut in the shared folder."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, size: int, percent: int):
        self.spark, self.size, self.percent = df.sparkSession, size, percent
        small_batches(self.spark)
        self.docs = df.select(F.col(id_col).cast("long").alias("id__"), F.col(text_col).alias("text__"))
        found = cut(self.docs.mapInArrow(_members(size), "kind int, id long, c long, n long, point binary, coarse binary, digest binary"), "jaccard-members")
        own = self._numbered(found)
        self.numbers = self.spark.sparkContext.broadcast(own)
        texts = found.filter("kind = 0")
        if own:
            table = self.spark.createDataFrame(list(own.items()), "digest binary, number long")
            texts = texts.join(F.broadcast(table), "digest", "left").withColumn("c", F.coalesce("number", "c"))
        self.members = texts.select("id", "c", "n")
        self.points = texts.filter("point IS NOT NULL AND c <> 0").select("c", "n", "point", "coarse")
        often = found.filter("kind = 1").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "c").limit(FREQUENT).toPandas()
        keys, times = often["c"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
        order = np.argsort(keys)
        self.frequent = self.spark.sparkContext.broadcast((keys[order], times[order]))
        self.salted = bool((salts_of(times) > 1).any())

    @staticmethod
    def _numbered(found: DataFrame) -> dict[bytes, int]:
        """Numbers of their own, below zero, for classes whose hash is another's too: some thousand among 10^11 texts."""
        clash = found.filter("kind = 0 AND c <> 0").groupBy("c").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y").select("c")
        alike = found.filter("kind = 0").join(clash, "c", "left_semi").select("digest").distinct().collect()
        return {d: -1 - i for i, d in enumerate(sorted(bytes(r[0]) for r in alike))}

    def nodes(self, classes: DataFrame, column: str) -> DataFrame:
        """(c, n, point or coarse) of some classes, one row each."""
        own = self.points.join(_small(classes), "c", "left_semi")
        return own.groupBy("c").agg(F.first("n").alias("n"), F.first(column).alias(column))

    def bounded(self, pairs: DataFrame, column: str) -> DataFrame:
        """The pairs that the bound by points, or by coarse ones, lets through."""
        ends, most = _ends(pairs)
        nodes = cut(self.nodes(ends.select("c"), column), f"jaccard-{column}")
        both = _both(pairs, nodes, [column, "n"], ends, most).select("a", "b", f"{column}_a", f"{column}_b", "n_a", "n_b")
        out = cut(both.mapInPandas(_bounded(self.percent, column), "a long, b long"), f"jaccard-{column}-pairs")
        discard(ends, nodes, pairs)
        return out

    def kinds(self, shards: DataFrame) -> list[tuple[DataFrame, bool]]:
        """The rows of shingles that stay in one task, and those of shingles that a salt deals to several."""
        return [(shards.filter("salts = 1"), False), (shards.filter("salts > 1"), True)] if self.salted else [(shards, False)]

    @staticmethod
    def over_shards(shards: DataFrame, columns: dict[str, Column], salted: bool) -> DataFrame:
        """shards with aggregates over each shingle, by a window; or where they are salted by an aggregate that tasks begin, and a join."""
        if not salted:
            shard = Window.partitionBy("shingle")
            return shards.withColumns({k: v.over(shard) for k, v in columns.items()})
        totals = shards.groupBy("shingle").agg(F.first("salts").alias("copies"), *[v.alias(k) for k, v in columns.items()])
        dealt = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        return shards.withColumn("salt", F.pmod(F.xxhash64("c"), "salts").cast("int")).join(dealt, ["shingle", "salt"]).drop("salt")

    def shards(self) -> DataFrame:
        """(shingle, salts, c, n) of the shingles that two classes or more have in their prefixes."""
        entries = self.docs.mapInArrow(_prefixes(self.size, self.percent, self.frequent, self.numbers), "shingle long, c long, n long, salts int")
        # one pass over the texts: salted shingles are frequent, so they recur whatever else is in their row's part
        salt = F.when(F.col("salts") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("c"), F.col("salts")).cast("int"))
        part = Window.partitionBy("shingle", "salt")
        dealt = entries.withColumn("salt", salt).withColumns({"least": F.min("c").over(part), "most": F.max("c").over(part)}).filter("least < most OR salts > 1")
        return cut(dealt.dropDuplicates(["shingle", "salt", "c"]).select("shingle", "salts", "c", "n").withColumn("part", F.col("c")), "jaccard-shards")

    def verified(self, pairs: DataFrame, what: str) -> DataFrame:
        """The pairs that link, by the words of their whole texts. Only texts of these pairs are moved."""
        ends, most = _ends(pairs)
        held = self.members.join(_small(ends.select("c")), "c", "left_semi").groupBy("c").agg(F.min("id").alias("id"))
        wanted = cut(held.groupBy("id").agg(F.collect_list("c").alias("wanted__")), f"{what}-holders")
        texts = self.docs.join(_small(wanted), F.col("id__").eqNullSafe(F.col("id"))).select("text__", "wanted__").mapInArrow(_holders("wanted__", self.numbers), "c long, text binary")
        nodes = cut(texts.dropDuplicates(["c"]), f"{what}-texts")
        both = _both(pairs, nodes, ["text"], ends, most).select("a", "b", "text_a", "text_b")
        out = cut(both.mapInArrow(_verified(self.size, self.percent), "a long, b long"), what)
        discard(ends, wanted, nodes, pairs)
        return out

    def over_hubs(self, shards: DataFrame, turn: int, salted: bool) -> DataFrame:
        """shards with hub, a few members of the shard, drawn by hash."""
        firsts = {f"hub{i}": F.min(F.struct(F.xxhash64("c", F.lit(turn * STARS + i)).alias("h"), "c", "n", "part")) for i in range(STARS)}
        return self.over_shards(shards, firsts, salted).withColumn("hub", F.array(*firsts)).drop(*firsts)

    def stars(self, shards: DataFrame, turn: int) -> DataFrame:
        """Links between a few members of each shard and its members in other components."""
        met = reduce(DataFrame.unionByName, [self.over_hubs(own, turn, salted) for own, salted in self.kinds(shards)])
        met = met.withColumn("hub", F.explode("hub")).filter("hub.part <> part")
        own = met.filter(_fits(F.col("n"), F.col("hub.n"), self.percent)).select(F.least("c", "hub.c").alias("a"), F.greatest("c", "hub.c").alias("b"))
        pairs = self.bounded(self.bounded(cut(own.distinct(), "jaccard-stars"), "coarse"), "point")
        return self.verified(pairs, "jaccard-first")

    def open(self, shards: DataFrame, parts: DataFrame | None, turn: int) -> tuple[DataFrame, int, int]:
        """The shards that lie in several components, without the members that have met all others; their rows, and the pairs across components."""
        held = None if parts is None else _small(parts.withColumnRenamed("part", "new"))
        lefts = []
        for own, salted in self.kinds(shards):
            met = self.over_hubs(own, turn, salted).filter(~F.exists("hub", lambda h: h["c"] == F.col("c"))).drop("hub")
            if held is not None:
                met = met.join(held, "c", "left").withColumn("part", F.coalesce("new", "part"))
            spread = self.over_shards(met.select("shingle", "salts", "c", "n", "part"), {"p": F.min("part"), "q": F.max("part")}, salted)
            lefts.append(spread.filter("p < q").select("shingle", "salts", "c", "n", "part"))
        left = cut(reduce(DataFrame.unionByName, lefts), "jaccard-open")
        discard(shards)
        sizes = left.groupBy("shingle", "part").agg(F.count(F.lit(1)).alias("k")).groupBy("shingle").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("own"))
        rows, pairs = sizes.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum((F.col("k") * F.col("k") - F.col("own")) / 2), F.lit(0))).first()
        return left, int(rows), int(pairs)

    def tiles(self, shards: DataFrame) -> DataFrame:
        """shards with tile, low and high: a row for each group that a member is in.

        A large shard is split by classes of size, so that sets that may match are in one class or in neighbours, and a class by
        hash into slots; each two slots that may hold a match are a group.
        """
        width = math.log(100 / self.percent) * (1 + 1e-9) if self.percent < 100 else 0.0
        level = (F.floor(F.log(F.col("n").cast("double")) / F.lit(width)) if width else F.col("n")).cast("long")
        sized = shards.withColumn("level", level)
        slots = F.map_from_entries(F.collect_list(F.struct("level", F.ceil(F.col("k") / TILE).cast("int").alias("slots"))))
        counts = sized.groupBy("shingle", "level").agg(F.count(F.lit(1)).alias("k")).groupBy("shingle").agg(F.sum("k").alias("k"), slots.alias("slots"))
        large = cut(counts.filter(F.col("k") > TILE).select("shingle", "slots"), "jaccard-large")
        n = large.count()
        if not n:
            return shards.withColumns({c: F.lit(0).cast("long") for c in ("tile", "low", "high")})
        marked = sized.join(F.broadcast(large) if n <= BROADCAST_ROWS // 100 else large, "shingle", "left")
        number = lambda own, slot: own * F.lit(1 << 32) + slot
        at = number(F.col("level"), F.pmod(F.xxhash64("c", F.lit(7)), F.element_at("slots", F.col("level"))))
        others = F.flatten(F.transform(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1), lambda own: F.when(F.map_contains_key("slots", own), F.transform(F.sequence(F.lit(0), F.try_element_at("slots", own) - 1), lambda i: number(own, i))).otherwise(F.array().cast("array<long>"))))
        placed = marked.withColumn("tile", F.when(F.col("slots").isNull(), F.lit(0).cast("long")).otherwise(at))
        grouped = placed.withColumn("other", F.explode(F.when(F.col("slots").isNull(), F.array(F.lit(0).cast("long"))).otherwise(others)))
        return grouped.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})

    def rest(self, shards: DataFrame) -> DataFrame:
        """All links between components, from the shards that lie in several."""
        grouped = self.tiles(shards).select("shingle", "c", "n", "part", "tile", "low", "high")
        groups = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        nodes = cut(self.nodes(cut(shards.select("c").distinct(), "jaccard-ends"), "point"), "jaccard-points")
        first = F.slice(F.sort_array(F.collect_set("shingle")), 1, KEYS)
        keys = cut(shards.groupBy("c").agg(first.alias("keys")), "jaccard-keys")
        placed = grouped.join(nodes.select("c", "point").join(keys, "c"), "c").repartition(groups, "shingle", "low", "high").sortWithinPartitions("shingle", "low", "high")
        pairs = placed.select("shingle", "low", "high", "tile", "c", "n", "part", "point", "keys").mapInPandas(_searched(self.percent), "a long, b long")
        return self.verified(cut(pairs.distinct(), "jaccard-rest"), "jaccard-second")


def links(df: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[_Join, DataFrame, DataFrame]:
    """The join with its members (id, class, n), links (a, b) between classes that connect all that are connected, and components (c, part)."""
    join = _Join(df, id_col, text_col, size, percent)
    shards, found, parts, before = join.shards(), _no_links(join.spark), None, None
    for turn in range(ROUNDS):
        new = join.stars(shards, turn)
        if new.first() is not None:
            found = found.union(new)
            discard(*([parts] if parts is not None else []))
            parts = components(found)
        shards, rows, pairs = join.open(shards, parts, turn)
        release(join.spark)
        if pairs <= FEW * rows or (before is not None and pairs > 0.7 * before):
            break
        before = pairs
    if pairs:
        new = join.rest(shards)
        if new.first() is not None:
            found = found.union(new)
            parts = components(found)
    discard(shards)
    release(join.spark)
    if parts is None:
        parts = components(found)
    return join, found, parts


def _grouped(df: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, _Join]:
    """(id, c, n, component, lead), one row per row of df, and the join. lead is the class that stays of a group whose ids are all null."""
    join, _, parts = links(df, id_col, text_col, size, percent)
    members = join.members
    classes = members.filter("c <> 0").groupBy("c").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    joined = classes.join(parts, "c", "left")
    by_part = joined.filter("part IS NOT NULL").groupBy("part").agg(F.min("id").alias("smallest"), F.min("c").alias("least"))
    final = joined.join(by_part, "part", "left").filter("part IS NOT NULL OR rows > 1").select(F.col("c").alias("c_"), F.coalesce("smallest", "id").alias("component"), F.coalesce("least", "c").alias("lead"))
    final = cut(final, "jaccard-components")
    out = members.join(_small(final), F.col("c") == F.col("c_"), "left")
    return out.select("id", "c", "n", F.coalesce("component", "id").alias("component"), F.coalesce("lead", "c").alias("lead")), join


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id), one row per row of df.

    Texts are linked when 100 * overlap >= percent * union of their shingle sets; component_id is the smallest id reachable.
    A null or empty text, or one without words, has n_shingles 0, is linked with nothing and has its own id. Ids are
    integers; a null id is never a component's unless all its members' are null. Rows that share an id stay rows of their
    own. An empty table gives an empty table.
    """
    groups, _ = _grouped(df, id_col, text_col, size, percent)
    return groups.select("id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _classed(text: str, new: str, numbers):
    """The rows, with the class of each text instead of the text."""

    @trimmed
    def run(batches):
        for batch in batches:
            own = class_numbers(digests(batch.column(text).cast(pa.binary()).to_pylist()), numbers.value)
            rest = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(own, pa.int64())], names=[*rest, new])

    return run


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of df whose id is their own component's, with df's columns: one document of each group.

    Rows that share an id and the component it names all stay, and so does every text without words; a row of that id in
    another component goes. A null id is no id: of a group whose ids are all null one row stays, the smallest text of its
    smallest class.
    """
    id__, text__, c__, gone, gone_c = fresh(df, "id__", "text__", "c__", "gone__", "gone_c__")
    null = F.col("id").isNull() & F.col("component").isNull() & (F.col("c") != F.col("lead"))
    groups, join = _grouped(df, id_col, text_col, size, percent)
    groups = groups.select("id", "c", (~F.col("id").eqNullSafe(F.col("component")) | null).alias("goes"))
    decided = cut(groups.distinct(), "jaccard-decided")
    by_id = decided.filter("id IS NOT NULL").groupBy("id").agg(F.max("goes").alias("any"), F.min("goes").alias("all")).filter("any")
    dropped = cut(by_id.select(F.col("id").alias(gone), "all"), "jaccard-dropped")
    named, given = df[id_col].cast("long") == F.col(gone), [df[c] for c in df.columns]
    out = df.filter(df[id_col].cast("long").isNotNull()).join(_small(dropped.select(gone)), named, "left_anti").select(given)
    # an id of which only some rows go, and null ids: each row's own class decides
    mixed_ids, nulls = dropped.filter("NOT all").select(gone), decided.filter("id IS NULL")
    parts = [] if mixed_ids.isEmpty() else [df.join(_small(mixed_ids), named, "left_semi").select(given)]
    parts += [] if nulls.isEmpty() else [df.filter(df[id_col].cast("long").isNull())]
    for rows in parts:
        asked = rows.withColumns({id__: F.col(id_col).cast("long"), text__: F.col(text_col)})
        types = T.StructType([f for f in asked.schema if f.name != text__] + [T.StructField(c__, T.LongType())])
        going = decided.filter("goes").select(F.col("id").alias(gone), F.col("c").alias(gone_c))
        same = F.col(id__).eqNullSafe(F.col(gone)) & (F.col(c__) == F.col(gone_c))
        stay = cut(asked.mapInArrow(_classed(text__, c__, join.numbers), types).join(_small(going), same, "left_anti"), "jaccard-stay")
        one = F.col(id__).isNull() & (F.col(c__) != 0)
        firsts = stay.filter(one).groupBy(c__).agg(F.min_by(F.struct(*df.columns), F.col(text_col)).alias(gone)).select(f"{gone}.*")
        out = out.unionAll(stay.filter(~one).select(df.columns)).unionAll(firsts)
    return out
