"""Helpers that several corpus operators share: words, hashes, shared storage, column names."""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule, space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset and all run in one process, a folder of our own.

    Elsewhere an unset folder is an error: each executor would write to its own disk and rows would be lost in silence.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or _own_dir(sc)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_OWN: dict[str, str] = {}


def _own_dir(sc) -> str:
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        delete_at_exit(SparkSession.active(), _OWN[sc.applicationId])
    return _OWN[sc.applicationId]


def _hadoop_path(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder when the application ends."""
    store, target = _hadoop_path(spark, path)
    store.deleteOnExit(target)


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there and any executor can reread it.

    The table goes when discard() is called on it, else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


_PATHS: dict[int, tuple] = {}


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that nothing reads any more; others are left alone."""
    for t in tables:
        ref, path = _PATHS.pop(id(t), (None, None))
        if ref is not None and ref() is t:
            store, target = _hadoop_path(t.sparkSession, path)
            store.delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, which it does when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def trimmed(run):
    """A function over batches that gives freed memory back to the system: Arrow's at once, the rest at its end; workers wait for the next task with what they hold."""

    @functools.wraps(run)
    def own(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return own


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those asked for that no column of df has, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; lower() is the same and faster where a text is ASCII throughout."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Array of the words of a text, runs of anything but white space; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes as numbers from 1, and the same with A-Z as a-z.
_AS_IS = np.arange(1, 257, dtype=np.uint64)
_FOLDED = _AS_IS.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _AS_IS[ord("a") : ord("z") + 1]
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Words are hashed by two polynomials modulo a prime, so that structure in a word cannot cancel; longer words than LONG by BLAKE2.
_PRIME, _BASES, _CHUNK, LONG = (1 << 31) - 1, (1_299_709_177, 1_918_273_645), 1 << 20, 1 << 16
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses modulo the prime."""
    if not _POWERS:
        for base in _BASES:
            both = []
            for x in (base, pow(base, -1, _PRIME)):
                own = np.ones(_CHUNK, dtype=np.uint64)
                n = 1
                while n < _CHUNK:  # by doubling
                    own[n : 2 * n] = own[:n] * np.uint64(pow(x, n, _PRIME)) % np.uint64(_PRIME)
                    n *= 2
                both.append(own)
            _POWERS.append((both[0], both[1]))
    return _POWERS


def _long_hash(word: bytes, folded: bool) -> int:
    return int.from_bytes(hashlib.blake2b(word.translate(FOLD) if folded else word, digest_size=8).digest(), "little")


def _hash_words(data: np.ndarray, folded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in up to a megabyte, all at once: differences of running polynomials."""
    inside = np.concatenate([[False], ~_SPACES[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    values, halves = (_FOLDED if folded else _AS_IS)[data], []
    for up, down in _powers():
        # a value is under 2^9 and a power under 2^31, so a megabyte's sum stays under 2^60
        total = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: len(data)], dtype=np.uint64)])
        halves.append((total[ends] - total[starts]) % np.uint64(_PRIME) * down[starts] % np.uint64(_PRIME))
    hashes = mixed(mixed(halves[0] << np.uint64(31) | halves[1]) + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        hashes[i] = _long_hash(data[starts[i] : ends[i]].tobytes(), folded)
    return starts, ends, hashes


def word_table(texts: list[bytes | None], folded: bool = False) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one run of bytes, the number of words of each, and where each word begins and ends and its hash.

    folded: A-Z count as a-z in the hashes. Bytes are hashed about a megabyte at a time, cut at white space, so that memory
    for the hashing does not grow with a text.
    """
    texts = [t or b"" for t in texts]
    run = b" ".join(texts) + b" "
    data = np.frombuffer(run, dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(data):
        end = min(at + _CHUNK, len(data))
        gaps = np.flatnonzero(_SPACES[data[at:end]])
        if len(gaps):
            end = at + int(gaps[-1]) + 1
            s, e, h = _hash_words(data[at:end], folded)
            parts.append((s + at, e + at, h))
        else:  # one word fills the chunk: on to its end
            while not _SPACES[data[end]]:
                more = np.flatnonzero(_SPACES[data[end : end + _CHUNK]])
                end = end + int(more[0]) if len(more) else end + _CHUNK
            parts.append((np.array([at]), np.array([end]), np.array([_long_hash(run[at:end], folded)], dtype=np.uint64)))
        at = end
    starts, ends, hashes = (np.concatenate(x) for x in zip(*parts))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    return run, np.diff(bounds), starts, ends, hashes


def word_hashes(texts: list[bytes | None], folded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and the hashes of all words in order."""
    _, lengths, _, _, hashes = word_table(texts, folded)
    return lengths, hashes


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, by the words themselves."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def sequence_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes, by doubling; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, have, at, power = None, 0, h, 1
    while True:
        if n & power:
            out = at.copy() if out is None else mixed(out[: len(h) - have - power + 1] * np.uint64(0x9E3779B97F4A7C15) + at[have : len(h) - power + 1])
            have += power
        if have == n:
            return out[: len(h) - n + 1]
        at = mixed(at[:-power] * np.uint64(0x9E3779B97F4A7C15) + at[power:])
        power *= 2
