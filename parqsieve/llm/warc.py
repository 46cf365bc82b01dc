"""WARC archives with a two-level capture index.

Archives: one gzip member for each record (a record whose last byte of length isn't zero is followed by an empty member,
so that every record ends in a zero byte, which the text writer of Spark sets; so any Hadoop file system can be written
to). A file holds at most ``ARCHIVE_RECORDS`` records, and is read back as a stream, one record in memory at a time. Record ids
hold the page_id and the row's own number, so they differ where page_ids repeat; a revisit names the id of its response.
Rows are numbered by their place in the source, which has to read alike twice, as files do. Of records with equal payloads of at least ``REVISIT_BYTES`` the one with the smallest page_id is a response and the
others revisit it.

Index: the captures sorted by (reversed-host URL key, page_id), in compressed blocks, and a sparse directory with the
first capture of each block. A block holds at least ``BLOCK_CAPTURES`` captures and so many that the directory has at most
``DIRECTORY_ENTRIES`` entries of at most ``KEY_CHARS`` characters each: that bounds what is broadcast. A look-up searches
the directory, then the block, and reads the byte range of the record.

Null pages are empty payloads. A null url has the empty key, a null page_id its own capture id. Rows with equal page_ids
are records of their own. Null page_ids are never revisited, nor do they refer to others.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parqsieve.llm.common import pick, read_table, scratch_path, shuffle_partitions, slices, written

REVISIT_BYTES = 100
BLOCK_CAPTURES = 4096
DIRECTORY_ENTRIES = 200_000
KEY_CHARS = 512
LEVEL = 1
ARCHIVE_RECORDS = 50_000
READ = 1 << 20
FEED = 1 << 14
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "key string, id long, file string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
NO_ID = -(1 << 63)


def clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url or "")


def url_key(url: str) -> str:
    """com,example,www)/path?query in lower case; a longer one than KEY_CHARS ends in a digest of the whole."""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
        key = f"{host}{':%d' % parts.port if parts.port else ''}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()
    except ValueError:
        key = f"){url.lower()}"
    return key if len(key) <= KEY_CHARS else key[: KEY_CHARS - 64] + hashlib.sha256(key.encode()).hexdigest()


def record_id(page_id: int | None, number: int) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{number}>"


def page_of(name: str) -> int | None:
    page_id = name.split(":")[2]
    return None if page_id == "none" else int(page_id)


def record(name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Target-URI: {clean_url(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + http + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    if out[-1]:
        empty = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out += empty.flush()
    return out


def fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def parsed(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """The RECORD of a WARC record; a response whose payload doesn't match its digest or length is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(fields(http)["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha256:")
    page_id = page_of(warc["WARC-Record-ID"])
    if warc["WARC-Type"] == "revisit":
        return page_id, size, digest, "revisit", page_of(warc["WARC-Refers-To"])
    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of page {page_id} doesn't match its record")
    return page_id, size, digest, "response", None


def inflate(data: bytes) -> bytes:
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def write_archives(pages: DataFrame, path: str, records: int = ARCHIVE_RECORDS) -> None:
    """Archives at path of all rows of pages (page_id, url, html), of at most so many records each."""
    pages = pick(pages, page_id="page_id", url="url", html="html").withColumn("html", F.coalesce("html", F.lit(""))).withColumn("number", F.monotonically_increasing_id())
    pages = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = pages.where((F.octet_length("html") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    first = large.groupBy("digest").agg(F.min(F.struct("page_id", "number")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first.*").toDF("of", "first", "first_number")
    refers = F.col("page_id") > F.col("first")
    joined = pages.join(first, F.col("digest") == F.col("of"), "left").select("page_id", "number", "url", "html", "digest", F.when(refers, F.col("first")).alias("first"), F.when(refers, F.col("first_number")).alias("first_number"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = zip(*(c.to_pylist() for c in part.columns), strict=True)
            made = [member(record(record_id(i, number), url, text.encode(), digest, None if first_number is None else record_id(first, first_number)))[:-1] for i, number, url, text, digest, first, first_number in rows]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    joined.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", records).text(path)


def members(file: BinaryIO) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each record of an archive, which is read as a stream."""
    chunk, at, base, held = memoryview(b""), 0, 0, None
    while True:
        start, d, out = base + at, zlib.decompressobj(31), []
        while not d.eof:
            if at == len(chunk):
                chunk, at, base = memoryview(file.read(READ)), 0, base + len(chunk)
                if not len(chunk):
                    break
            fed = chunk[at : at + FEED]
            out.append(d.decompress(fed))
            at += len(fed) - len(d.unused_data)
        content, length = b"".join(out), base + at - start
        if content and not d.eof:
            raise ValueError(f"the archive ends within the record at {start}")
        if content:
            if held:
                yield held
            held = (start, length, content)
        elif length and held:
            held = (held[0], held[1] + length, held[2])
        if not d.eof:
            break
    if held:
        yield held


def captures(spark: SparkSession, path: str) -> DataFrame:
    """key, id, file, offset, length of each record in the archives at path, from reading them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        for b in batches:
            for name in b.column(0).to_pylist():
                with open_archive(name) as file:
                    rows = []
                    for offset, length, data in members(file):
                        warc = fields(data[: data.index(b"\r\n\r\n")])
                        page_id = page_of(warc["WARC-Record-ID"])
                        rows.append((url_key(warc.get("WARC-Target-URI", "")), NO_ID if page_id is None else page_id, name, offset, length))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "id", "file", "offset", "length"])

    return spark.read.format("binaryFile").load(path).where("length > 0").select("path").mapInArrow(scan, CAPTURE)


def build_index(archives: DataFrame, block_captures: int = BLOCK_CAPTURES) -> DataFrame:
    """The index blocks of captures: block, first_key, first_id, n, content; written in the shared folder."""
    entries = written(archives, "captures")
    n = entries.count()
    size = max(block_captures, -(-n // DIRECTORY_ENTRIES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number, rows = TaskContext.get().partitionId() << 32, 0, []

        def block() -> pa.RecordBatch:
            lines = "\n".join("\t".join(map(str, r)) for r in rows)
            return pa.RecordBatch.from_pylist([{"block": base + number, "first_key": rows[0][0], "first_id": rows[0][1], "n": len(rows), "content": zlib.compress(lines.encode())}], schema=pa.schema([("block", pa.int64()), ("first_key", pa.string()), ("first_id", pa.int64()), ("n", pa.int64()), ("content", pa.binary())]))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.append(row)
                if len(rows) == size:
                    yield block()
                    number, rows = number + 1, []
        if rows:
            yield block()

    parts = max(1, min(shuffle_partitions(entries.sparkSession), n // size))
    ordered = entries.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id", "file", "offset")
    return written(ordered.mapInArrow(pack, "block long, first_key string, first_id long, n long, content binary"), "index")


class Directory:
    """The first captures of the blocks, in order."""

    def __init__(self, index: DataFrame):
        rows = sorted((r.first_key, r.first_id, r.block) for r in index.select("first_key", "first_id", "block").collect())
        self.firsts, self.blocks = [r[:2] for r in rows], [r[2] for r in rows]

    def blocks_for(self, key: str, page_id: int) -> list[int]:
        """All blocks that may hold the capture; more than one only if equal captures lie on both sides of a cut."""
        low, high = bisect.bisect_left(self.firsts, (key, page_id)), bisect.bisect_right(self.firsts, (key, page_id))
        return self.blocks[max(0, low - 1) : high]


def in_block(content: bytes, key: str, page_id: int, known: dict | None = None) -> list[tuple[str, int, int]]:
    """(file, offset, length) of the captures in a block, by binary search."""
    lines = zlib.decompress(content).decode().split("\n")
    return searched([(k, int(i), f, int(o), int(n)) for k, i, f, o, n in (x.rsplit("\t", 4) for x in lines)], key, page_id)


def searched(entries: list[tuple[str, int, str, int, int]], key: str, page_id: int) -> list[tuple[str, int, int]]:
    at, out = bisect.bisect_left(entries, (key, page_id)), []
    while at < len(entries) and entries[at][:2] == (key, page_id):
        out.append(entries[at][2:])
        at += 1
    return out


def open_archive(name: str) -> pa.NativeFile:
    name = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?!/)", "file:///", name))
    system, path = pafs.FileSystem.from_uri(name)
    return system.open_input_file(path)


def look_up(spark: SparkSession, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the pages in wanted (page_id, url): a search of the directory, then of a block, then a range read each."""
    held = spark.sparkContext.broadcast(Directory(index))  # at most DIRECTORY_ENTRIES entries, see above
    wanted = pick(wanted, page_id="page_id", url="url")

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page_id, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key, i = url_key(clean_url(url)), NO_ID if page_id is None else page_id
                rows += [(block, key, i) for block in held.value.blocks_for(key, i)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["block", "key", "id"])

    def search(_: tuple, asked: pa.Table, blocks: pa.Table) -> pa.Table:
        out, asked = [], list(zip(asked.column("key").to_pylist(), asked.column("id").to_pylist(), strict=True))
        for content in blocks.column("content").to_pylist():
            entries = [(k, int(i), f, int(o), int(n)) for k, i, f, o, n in (x.rsplit("\t", 4) for x in zlib.decompress(content).decode().split("\n"))]
            out += [hit for key, i in asked for hit in searched(entries, key, i)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "offset", "length"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for part in slices(batches):
            rows = []
            for f, offset, length in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if f != name:
                    if file:
                        file.close()
                    name, file = f, open_archive(f)
                file.seek(offset)
                rows.append(parsed(inflate(file.read(length))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    asked = wanted.distinct().mapInArrow(direct, "block long, key string, id long").dropDuplicates()
    found = asked.groupBy("block").cogroup(index.select("block", "content").groupBy("block")).applyInArrow(search, "file string, offset long, length long")
    near = found.withColumn("stretch", F.shiftright("offset", 22)).repartition("file", "stretch").sortWithinPartitions("file", "offset")
    return near.select("file", "offset", "length").mapInArrow(fetch, RECORD)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = read_table(spark, sf_dir, "pages"), scratch_path(spark, "warc")
    write_archives(pages, path)
    return look_up(spark, build_index(captures(spark, path)), pages)


OP4_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id > first THEN first END AS refers_to FROM f
"""
