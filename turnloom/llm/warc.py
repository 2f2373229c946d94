"""WARC archives with a two-level capture index.

Writing. Each page is one record with its whole payload's SHA-256; of equal payloads of at least
MIN_REVISIT bytes the one of the smallest page_id is a response and the others revisit it. The
records are written by Spark's own text sink into the shared folder, so archives can lie in any
store that Spark writes. A record is one or two gzip members; the last byte of a member is the top
byte of its length, which is zero below 16 MiB, and the sink writes that byte as its line's end.

Index. Lines "reversed-host-key page_id file offset length" are sorted by key and packed into
zlib-compressed blocks of BLOCK lines each, or more lines where there would be over DIRECTORY
blocks. The sparse directory holds the first DIRECTORY_KEY characters of each block's first key,
so it has a fixed bound and is broadcast.

Look-up. The directory is searched by bisection for the blocks that can hold a key. Keys are dealt
to these blocks; a task opens a block once and finds each key in it by bisection. The captures'
byte ranges are then dealt by archive and place, and neighbouring ones are read together.

Reading back. round_trip() looks up every page's url in the index and reads what it finds.

Defined results: a null payload is empty (0 bytes, its own response); a null url is the empty
url; ids can be of any type and hold any characters, and a null one is told from an empty one; equal
page_ids are kept apart as rows; an empty table gives empty archives, index and result; extra
columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import dropped, prepare, shared_dir, written

MIN_REVISIT = 100
BLOCK = 3000
#: Bounds of the directory: blocks (and one more for each task that wrote some), and characters of a key.
DIRECTORY = 500_000
DIRECTORY_KEY = 200
#: An archive file holds about as many bytes; one record can be longer.
FILE_BYTES = 8 << 20
_CR = b"\r\n"
_END = b"\r\n\r\n"


def reversed_host_key(url: str) -> str:
    """com,example,www)/path?query: captures of a site and its subdomains stand together."""
    url = _one_line(url)
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return ")" + url
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return _one_line(f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else ""))


def _one_line(s: str) -> str:
    """Without white space around it, and with controls and blanks as percent codes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s.strip())


def _escaped(page_id: str) -> str:
    return quote(page_id, safe="")


def record(page_id: str | None, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit has no payload."""
    rid = uuid.UUID(sha256(f"{page_id}|{url}|{digest}".encode()).hexdigest()[:32])
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{rid}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Bytes: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"Page-Id: {_escaped(page_id)}")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Page-Refers-To: {_escaped(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def packed(rec: bytes) -> bytes:
    """Gzip members of one record; the last byte is zero, as it is the top byte of a length below 2 ** 24."""

    def member(data: bytes) -> bytes:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()

    return member(rec) if len(rec) < 1 << 24 else member(rec[:-4]) + member(rec[-4:])


def parsed(rec: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields and block of a record; None while it isn't complete."""
    cut = rec.find(_END)
    if cut < 0:
        return None
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in rec[:cut].decode().split("\r\n")[1:])
    end = cut + 4 + int(fields["Content-Length"])
    if len(rec) < end + 4:
        return None
    return fields, rec[cut + 4 : end]


def records(chunks: Iterator[bytes], offset: int = 0) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, fields, block) of the records in a stream of gzip members."""
    z, out, at, size = zlib.decompressobj(31), [], offset, 0
    for chunk in chunks:
        while chunk:
            out.append(z.decompress(chunk))
            size += len(chunk) - len(z.unused_data)
            if not z.eof:
                break
            chunk, z = z.unused_data, zlib.decompressobj(31)
            got = parsed(b"".join(out))
            if got is not None:
                yield at, size, *got
                at, size, out = at + size, 0, []


def payload_of(block: bytes) -> bytes:
    return block[block.index(_END) + 4 :]


class Store:
    """Byte ranges of files in whatever store the path names."""

    def __init__(self) -> None:
        self.path, self.file = None, None

    def open(self, path: str):
        from pyarrow import fs

        if path != self.path:
            if self.file is not None:
                self.file.close()
            store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
            self.path, self.file = path, store.open_input_file(inner)
        return self.file

    def chunks(self, path: str, start: int = 0, length: int | None = None, step: int = 1 << 20) -> Iterator[bytes]:
        f = self.open(path)
        end = f.size() if length is None else start + length
        while start < end:
            data = f.read_at(min(step, end - start), start)
            start += len(data)
            yield data


def write_archives(df: DataFrame, where: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Archives of gzip members under where, one record a row."""
    prepare(df.sparkSession)
    rows = df.select(df[key].cast("string").alias("id"), df[key].alias("page"), F.coalesce(df[url], F.lit("")).alias("url"), F.coalesce(df[payload], F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # narrow rows, summed before they are dealt: a payload that a third of all pages share is one row a task
    again = rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    joined = rows.join(again.drop("n"), "digest", "left").select("id", "url", "payload", "digest", F.when(F.col("page").eqNullSafe(F.col("first")), None).otherwise(F.col("first").cast("string")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # the sink ends each line with a zero byte, which is the member's own last one
            got = [packed(record(i, u, p, d, r))[:-1] for i, u, p, d, r in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "refers")))]
            yield pa.RecordBatch.from_pydict({"value": pa.array(got, pa.binary())})

    joined.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").text(where)


def write_index(spark: SparkSession, archives: str, where: str) -> None:
    """The capture index of all archives under a folder: table of compressed blocks."""
    files = spark.read.format("binaryFile").load(archives).select("path", "length").where("length > 0")
    files = files.repartition(max(1, min(files.count(), 100_000)), "path")

    def capture(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store()
        for b in batches:
            for path in b.column("path").to_pylist():
                got = [(reversed_host_key(f.get("WARC-Target-URI", "")), f.get("Page-Id", ""), path, at, size) for at, size, f, _ in records(store.chunks(path))]
                yield pa.RecordBatch.from_pydict({c: [g[i] for g in got] for i, c in enumerate(("key", "id", "path", "at", "size"))}, schema=pa.schema([("key", pa.string()), ("id", pa.string()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64())]))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        held: list[str] = []
        keys: list[str] = []

        def block() -> pa.RecordBatch:
            nonlocal n
            lines, first = held[:size], keys[0]
            del held[:size], keys[:size]
            n += 1
            return pa.RecordBatch.from_pydict({"first_key": [first[:DIRECTORY_KEY]], "block_id": pa.array([task << 32 | n], pa.int64()), "block": [zlib.compress("\n".join(lines).encode(), 6)]})

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("key", "id", "path", "at", "size")]
            held += ["\t".join(map(str, x)) for x in zip(*cols)]
            keys += cols[0]
            while len(held) >= size:
                yield block()
        if held:
            yield block()

    lines = written(files.mapInArrow(capture, "key string, id string, path string, at bigint, size bigint"), "captures")
    size = max(BLOCK, -(-lines.count() // DIRECTORY))
    order = ["key", "id", "path", "at"]
    # tasks follow each other in the keys' order, so (task, number) is the blocks' order
    lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, BLOCKS).write.parquet(where)
    dropped(lines)


BLOCKS = "first_key string, block_id bigint, block binary"
CAPTURES = "key string, id string, path string, at bigint, size bigint"


def _found(lines: list[str], key: str) -> list[list[str]]:
    """The captures of key among a block's sorted lines, by bisection."""
    i = lo = bisect_left(lines, key + "\t")
    while i < len(lines) and lines[i].startswith(key + "\t"):
        i += 1
    return [x.split("\t") for x in lines[lo:i]]


class Index:
    """Look-ups of many urls at once."""

    def __init__(self, spark: SparkSession, index: str) -> None:
        self.spark, self.blocks = spark, spark.read.schema(BLOCKS).parquet(index)
        # DIRECTORY rows of DIRECTORY_KEY characters, and a row a task, at most
        rows = sorted((r["block_id"], r["first_key"]) for r in self.blocks.select("block_id", "first_key").collect())
        self.ids, self.keys = [r[0] for r in rows], [r[1] for r in rows]

    def captures(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """(key, id, path, at, size) of all captures of the urls of a table, each capture once."""
        prepare(self.spark)
        directory = self.spark.sparkContext.broadcast((self.ids, self.keys))

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, first = directory.value
            for b in batches:
                keys, blocks = [], []
                for key in {reversed_host_key(u) for u in b.column("url").to_pylist()}:
                    # the directory has beginnings of keys: the block before the first equal one can hold key as well
                    lo, hi = max(0, bisect_left(first, key[:DIRECTORY_KEY]) - 1), bisect_right(first, key)
                    keys += [key] * (hi - lo)
                    blocks += ids[lo:hi]
                yield pa.RecordBatch.from_pydict({"block_id": pa.array(blocks, pa.int64()), "key": pa.array(keys, pa.string()), "block": pa.nulls(len(keys), pa.binary())})

        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, lines = None, []
            for b in batches:
                got = []
                for number, key, block in zip(*(b.column(c).to_pylist() for c in ("block_id", "key", "block"))):
                    if key is None:  # a block stands ahead of its keys
                        at, lines = number, zlib.decompress(block).decode().split("\n")
                    elif number == at:
                        got += _found(lines, key)
                k, i, p, a, n = zip(*got) if got else ((),) * 5
                yield pa.RecordBatch.from_pydict({"key": pa.array(k, pa.string()), "id": pa.array(i, pa.string()), "path": pa.array(p, pa.string()), "at": pa.array(map(int, a), pa.int64()), "size": pa.array(map(int, n), pa.int64())})

        asked = urls.select(F.coalesce(urls[url], F.lit("")).alias("url")).distinct().mapInArrow(dealt, "block_id bigint, key string, block binary").distinct()
        both = asked.union(self.blocks.select("block_id", F.lit(None).cast("string"), "block"))
        return both.repartition("block_id").sortWithinPartitions("block_id", F.asc_nulls_first("key")).mapInArrow(searched, CAPTURES)

    def find(self, url: str) -> list[tuple[str, str, int, int]]:
        """(id, path, offset, length) of all captures of one url; only its blocks are read."""
        key, found = reversed_host_key(url), []
        lo, hi = max(0, bisect_left(self.keys, key[:DIRECTORY_KEY]) - 1), bisect_right(self.keys, key)
        for r in self.blocks.where(F.col("block_id").between(self.ids[lo], self.ids[hi - 1])).select("block").toLocalIterator() if lo < hi else ():
            found += [(unquote(i), path, int(at), int(size)) for _, i, path, at, size in _found(zlib.decompress(r[0]).decode().split("\n"), key)]
        return sorted(found)

    def read(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """Fields and payload of all captures of url, by range reads."""
        store = Store()
        return [(f, payload_of(block)) for _, path, at, size in self.find(url) for _, _, f, block in records(store.chunks(path, at, size), at)]


def read_back(captures: DataFrame, id_type: str = "bigint", payload: bool = False) -> DataFrame:
    """One row a capture (path, at, size): page_id, payload_bytes, payload_digest, record_type, refers_to (and payload).

    Captures are dealt by archive and sorted by place, and neighbouring ranges are read together. A
    response's bytes and digest are taken from the payload that was read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store()

        def rows(path: str, start: int, length: int) -> pa.RecordBatch:
            got = []
            for _, _, f, block in records(store.chunks(path, start, length), start):
                kind, data = f["WARC-Type"], payload_of(block)
                own = kind == "response"
                got.append((unquote(f["Page-Id"]) if "Page-Id" in f else None, len(data) if own else int(f["Payload-Bytes"]), sha256(data).hexdigest() if own else f["WARC-Payload-Digest"].removeprefix("sha256:"), kind, unquote(f["Page-Refers-To"]) if "Page-Refers-To" in f else None, data if payload and own else None))
            names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
            return pa.RecordBatch.from_pydict({n: pa.array([g[i] for g in got], t) for i, (n, t) in enumerate(zip(names, types)) if payload or n != "payload"})

        path, start, end = None, 0, 0
        for b in batches:
            for p, a, s in zip(*(b.column(c).to_pylist() for c in ("path", "at", "size"))):
                if p == path and a == end and end - start < FILE_BYTES:
                    end += s
                    continue
                if path is not None:
                    yield rows(path, start, end - start)
                path, start, end = p, a, a + s
        if path is not None:
            yield rows(path, start, end - start)

    found = written(captures.select("path", "at", "size"), "found")
    # captures are small and what they stand for is not: the number of tasks follows the archives' bytes
    total = found.agg(F.sum("size")).first()[0] or 0
    places = found.repartition(1 + total // (2 * FILE_BYTES), "path", F.expr(f"at div {FILE_BYTES}")).sortWithinPartitions("path", "at")
    out = places.mapInArrow(run, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * payload)
    return out.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def archive(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> tuple[str, str]:
    """Writes archives and index of df's rows into the shared folder; returns both folders."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(df, f"{where}/archives", key, url, payload)
    write_index(spark, f"{where}/archives", f"{where}/index")
    return f"{where}/archives", f"{where}/index"


def round_trip(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes one record for each row of df, looks all rows' urls up in the index and reads what it has."""
    _, index = archive(df, key, url, payload)
    return read_back(Index(df.sparkSession, index).captures(df, url), dict(df.dtypes)[key])
