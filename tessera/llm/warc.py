"""WARC archives in Zstandard frames: write, and read back with every header and length checked.

An archive starts with a skippable frame that holds its dictionary; then comes one frame per record. The
reader takes the dictionary from that frame, finds each frame's end from its block headers, and decodes one
record at a time. Archives lie under a URI that all executors share and that pyarrow.fs can open.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, delete_at_exit, shared_dir
from tessera.llm.spm import small_batches

#: Fixed values of the formats.
FRAME, DICTIONARY_FRAME, DICTIONARY = 0xFD2FB528, 0x184D2A5D, 0xEC30A437
VERSION, LINE = b"WARC/1.1", b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

#: A page is written once and referred to afterwards only if it has so many bytes.
LEAST_REVISIT = 100
#: An archive's dictionary is trained on its first records, up to so many bytes, to so many bytes.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 1 << 14
#: An archive is closed once it holds so many bytes.
ARCHIVE_BYTES = 32 << 20
#: A table of repeated payloads of at most so many rows, of a hundred bytes each, is broadcast.
BROADCAST_ROWS = 200_000
#: Else only those of more copies than this, and than a hundred-thousandth of all repeated pages: a hundred thousand at most.
HOT_COPIES, HOT_SHARE = 1000, 100_000
#: Archives that a task reads, at most, where there are more than tasks.
ARCHIVES_A_TASK = 16


class BadArchive(ValueError):
    """An archive breaks the format."""


# -- records ------------------------------------------------------------------------------------------


def record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    own = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "2024-01-01T00:00:00Z", **headers, "Content-Length": str(len(block))}
    lines = [VERSION] + [f"{k}: {' '.join(str(v).split())}".encode() for k, v in own.items() if v is not None]
    return LINE.join(lines) + LINE + LINE + block + LINE + LINE


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A response record, or with `first` a revisit record that refers to that page and holds no payload."""
    headers = {
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Page-ID": None if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
    }
    if first is None:
        return record("response", headers, HTTP + payload)
    return record("revisit", {**headers, "WARC-Profile": REVISIT_PROFILE, "X-Refers-To-Page-ID": str(first)}, HTTP)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; BadArchive if a header is missing or a length is wrong."""
    head, gap, rest = data.partition(LINE + LINE)
    version, *lines = head.split(LINE)
    if not gap or version != VERSION:
        raise BadArchive("not a WARC/1.1 record")
    headers = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name.strip() != name:
            raise BadArchive(f"bad header line {line[:80]!r}")
        headers[name] = value.strip()
    missing = [h for h in REQUIRED if h not in headers]
    if missing or not headers["Content-Length"].isdigit():
        raise BadArchive(f"missing or bad headers: {missing or 'Content-Length'}")
    length = int(headers["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != LINE + LINE:
        raise BadArchive(f"block of {len(rest) - 4} bytes where {length} were declared")
    return headers, rest[:length]


def page_of(headers: dict[str, str], block: bytes) -> dict:
    """What a page's record says, with its payload checked against the declared length and digest."""
    kind, scheme_digest = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "")
    scheme, _, digest = scheme_digest.partition(":")
    if kind not in ("response", "revisit") or scheme != "sha256":
        raise BadArchive(f"unexpected record type {kind!r} or digest {scheme_digest!r}")
    payload = block.partition(LINE + LINE)[2]
    size = int(headers["X-Payload-Length"])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise BadArchive("payload differs from its length or digest")
    number = lambda name: int(headers[name]) if name in headers else None
    return {"page_id": number("X-Page-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-ID")}


# -- archives -----------------------------------------------------------------------------------------


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from the first kilobytes of some records, which changes sizes and no content; where they are too few to train on, what all records begin with."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r[:8192] for r in records])
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(page_record(0, "https://", b"<!DOCTYPE html>", "0" * 64, None), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(records: Iterator[bytes], out, most: int = ARCHIVE_BYTES) -> int:
    """Write records until the archive is full or they end; the number written."""
    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    if not first:
        return 0
    dictionary = train(first)
    data = dictionary.as_bytes()
    done = out.write(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data) or 0
    pack, n, done = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True), 0, len(data) + 8

    def put(r: bytes) -> None:
        nonlocal n, done
        frame = pack.compress(r)
        out.write(frame)
        n, done = n + 1, done + len(frame)

    for r in first:
        put(r)
    while done < most and (r := next(records, None)) is not None:
        put(r)
    return n


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that starts at `at` ends, from its header and its blocks' headers."""
    try:
        if struct.unpack_from("<I", data, at)[0] != FRAME:
            raise BadArchive(f"no frame at {at}")
        flags = data[at + 4]
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        content = (1 if single else 0, 2, 4, 8)[flags >> 6]
        at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + content
        last = False
        while not last:
            head = int.from_bytes(data[at : at + 3], "little")
            if at + 3 > len(data):
                raise BadArchive("the archive ends inside a frame")
            last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
            at += 3 + (1 if kind == 1 else size)
    except (struct.error, IndexError) as e:
        raise BadArchive("the archive ends inside a frame") from e
    if at + 4 * checksum > len(data):
        raise BadArchive("the archive ends inside a frame")
    return at + 4 * checksum


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, one frame at a time. An empty archive has none."""
    if not data:
        return
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_FRAME:
        raise BadArchive("no dictionary frame at the start")
    at = 8 + struct.unpack_from("<I", data, 4)[0]
    raw = data[8:at]
    if len(raw) < at - 8:
        raise BadArchive("the archive ends inside its dictionary")
    if raw[:4] == struct.pack("<I", FRAME):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == struct.pack("<I", DICTIONARY) else zstandard.DICT_TYPE_RAWCONTENT
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    while at < len(data):
        end = frame_end(data, at)
        try:
            own = unpack.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise BadArchive(f"frame at {at}: {e}") from e
        yield parse(own)
        at = end


# -- tables -------------------------------------------------------------------------------------------


def with_first(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, first): first is the smallest page_id of equal payloads, where that is another page.

    Null html counts as empty. Rows that share the smallest page_id are responses all. A null page_id is never the
    first; where all of a group are null, all are responses.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", "url", body.alias("html"), F.sha2(body.cast("binary"), 256).alias("digest"))
    large = own.filter(F.octet_length("html") >= LEAST_REVISIT)
    firsts = cut(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "warc-firsts")
    rows, copies = firsts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if rows <= BROADCAST_ROWS:
        joined = own.join(F.broadcast(firsts.drop("n")), "digest", "left")
    else:  # pages of a hot payload are spread by what else they hold, so that no task gets all of them
        hot = max(HOT_COPIES, copies // HOT_SHARE)
        marked = own.join(F.broadcast(firsts.filter(F.col("n") > hot).select("digest", F.col("first").alias("hot"))), "digest", "left")
        key = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("hot:"), F.xxhash64("page_id", "url").cast("string")))
        rest = firsts.filter(F.col("n") <= hot).select(F.col("digest").alias("key"), F.col("first").alias("cold"))
        joined = marked.withColumn("key", key).join(rest, "key", "left").withColumn("first", F.coalesce("hot", "cold"))
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("first", F.when(other, F.col("first"))).select("page_id", "url", "html", "digest", "first")


def write_archives(pages: DataFrame, uri: str) -> DataFrame:
    """Write one record per row of pages(page_id, url, html) to archives under uri; a table (path, n_records) of them.

    Only archives that the table names count: a task that is run again writes archives of its own.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)

        def records() -> Iterator[bytes]:
            for batch in batches:
                for page_id, url, html, digest, first in batch.itertuples(index=False):
                    yield page_record(None if pd.isna(page_id) else int(page_id), url, html.encode(), digest, None if pd.isna(first) else int(first))

        rows = records()
        while (head := next(rows, None)) is not None:

            def rest(head=head):
                yield head
                yield from rows

            path = f"{root}/{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(path, compression=None) as out:
                n = write_archive(rest(), out)
            yield pd.DataFrame({"path": [path], "n_records": [n]})

    nullable = with_first(pages).select(F.col("page_id").cast("string"), "url", "html", "digest", F.col("first").cast("string"))
    return cut(nullable.mapInPandas(run, "path string, n_records long"), "warc-archives")


def read_archives(archives: DataFrame, uri: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record of the archives.

    A record or archive that breaks the format, or one that holds fewer records than were written, raises BadArchive.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, n in batch.itertuples(index=False):
                with store.open_input_stream(path, compression=None) as f:
                    rows = [page_of(*r) for r in read_archive(f.read())]
                if len(rows) != n:
                    raise BadArchive(f"{path} holds {len(rows)} records; {n} were written")
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    n, tasks = archives.count(), int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = archives.select("path", "n_records").repartition(max(1, min(n, max(tasks, -(-n // ARCHIVES_A_TASK)))))
    return spread.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages(page_id, url, html) to archives in the shared folder and read them back: see write_archives and read_archives.

    Null html is an empty payload, a null page_id or url leaves its header out. Rows that repeat are records of their own; of
    equal payloads all rows with the smallest page_id are responses. Other columns are left out. A page of any size is one
    record, held whole. An empty table gives an empty one. The archives go when the application ends.
    """
    uri = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(pages, uri)
    delete_at_exit(spark, uri)
    return read_archives(archives, uri)
