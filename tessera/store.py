"""Files on any store that Spark knows, and tables that a plan uses several times, written once in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and all run in one process, a folder of our own.

    Elsewhere an unset folder is an error: each executor would write to its own disk and rows would be lost in silence.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or _OWN.get(sc.applicationId)
    if root is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        delete_at_exit(spark, root)
    return root.rstrip("/")


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a path when the application ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table read back: what follows reads it instead of computing it anew. It goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of stored input that a task takes where a plan deals rows by a key: some 650,000 rows of a narrow table.
TASK_BYTES = 8 << 20


def width(df: DataFrame, size: int = TASK_BYTES) -> int:
    """Partitions for the rows of df, by the largest stored table under it: as many as Spark's setting, more if a task would get over size bytes."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    stored = [s for s in sizes if s < 1 << 60]  # what has no size counts as Long.MAX_VALUE
    return max(least, -(-max(stored, default=0) // size))


def dealt(df: DataFrame, *keys: str, size: int = TASK_BYTES) -> DataFrame:
    """df dealt by keys to as many tasks as its input asks for, so that the memory of a task does not grow with it.

    Where Spark's own number is enough, df as it is: the exchange that the next step makes is then Spark's to size.
    """
    n = width(df, size)
    return df if n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(n, *keys)


# -- single files -----------------------------------------------------------------------------------------


def local(path: str) -> str:
    return path.removeprefix("file://")


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def _opened(path: str) -> tuple:
    spark = SparkSession.active()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(path: str) -> bool:
    if not is_remote(path):
        return os.path.exists(local(path))
    files, target = _opened(path)
    return files.exists(target)


def write_text(path: str, text: str) -> None:
    """A small file under another name, then renamed."""
    files, target = _opened(path)
    part = target.suffix(f".{uuid.uuid4().hex}")
    out = files.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(target, False)
    files.rename(part, target)


def blocks(path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file."""
    if not is_remote(path):
        with open(local(path), "rb") as f:
            while block := f.read(size):
                yield block
        return
    rows = SparkSession.active().read.format("binaryFile").load(path).select("content")  # one file of a run: a manifest or a report
    for row in rows.toLocalIterator():
        yield bytes(row["content"])
