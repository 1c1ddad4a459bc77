"""Tracks of the entities that occur with those of a history, session by session, from counts that all tasks have."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Scores of rows and entities that are held at once.
CELLS = 4_000_000


def _scores(plays: np.ndarray, begins: np.ndarray, table: np.ndarray, weighted: bool) -> np.ndarray:
    """For each play the sum of the table's lines over the plays before it in its session, or over their distinct entities."""
    own = np.where((plays >= 0)[:, None], table[plays], 0)
    if not weighted:
        key = np.repeat(np.arange(len(begins) - 1), np.diff(begins)) * (len(table) + 1) + plays + 1
        _, at = np.unique(key, return_index=True)
        again = np.ones(len(plays), bool)
        again[at] = False
        own[again] = 0
    total = np.cumsum(own, axis=0) - own
    return total - np.repeat(total[begins[:-1]], np.diff(begins), axis=0)


def _row(score: np.ndarray, gone: set, tracks: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best tracks that are not gone, by score and then by id; entities are taken by score while tracks are lacking."""
    ids, scores, have = [], [], 0
    left = score
    while have < k:
        best = left.max(initial=0)
        if best <= 0:
            break
        equal = np.flatnonzero(left == best)
        most = k - have + len(gone)
        own = tracks[equal[0]][:most] if len(equal) == 1 else np.sort(np.concatenate([tracks[e][:most] for e in equal.tolist()]))[:most]
        new = [t for t in own.tolist() if t not in gone][: k - have]
        ids += new
        scores += [int(best)] * len(new)
        have += len(new)
        if have < k:
            left = np.where(left == best, 0, left)
    return ids, scores


def solved(batch: pa.RecordBatch, table: np.ndarray, tracks: list[np.ndarray], k: int, weighted: bool) -> Iterator[pa.RecordBatch]:
    """(session_id, turn, top) of sessions with their plays (turn, track_id, code), code being a line of table or -1."""
    held = batch.column(1)
    ends, flat = held.offsets.to_numpy().astype(np.int64), held.values
    turn, codes = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 2))
    played = flat.field(1).to_pylist()
    session = batch.column(0).to_pylist()
    most = max(1, CELLS // max(1, len(tracks)))
    at = 0
    while at < len(session):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)  # whole sessions, at least one
        base, begins = ends[at], ends[at : stop + 1] - ends[at]
        scores = _scores(codes[base : ends[stop]], begins, table, weighted) if len(tracks) else np.zeros((ends[stop] - base, 0), np.int64)
        out, ids, values, sizes = [], [], [], []
        for s in range(at, stop):
            gone: set = set()
            for p in range(int(ends[s]), int(ends[s + 1])):
                if gone:
                    own, score = _row(scores[p - base], gone, tracks, k)
                    if own:
                        out.append((session[s], int(turn[p])))
                        ids += own
                        values += score
                        sizes.append(len(own))
                gone.add(played[p])
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
        rank = np.arange(len(ids)) - np.repeat(offsets[:-1], sizes) + 1
        top = pa.StructArray.from_arrays([pa.array(rank.astype(np.int32)), pa.array(ids, pa.int64()), pa.array(values, pa.int64())], names=["rank", "track_id", "score"])
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([t for _, t in out], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), top)], names=["session_id", "turn", "top"])
        at = stop
