"""WARC archives with a two-level capture index.

Writing: payload digests are native columns; of records with equal payloads of at least REVISIT bytes the one with the
largest page id is a response and the others are revisits that refer to it. Each task appends its records, one gzip
member each, to files of its own in the shared folder (any URI that pyarrow opens) and emits a capture line for each:
reversed-host key, file, offset, length. Lines are sorted by range into compressed blocks of BLOCK lines; the
directory has the first key and the place of each block.

Reading: the ranges of the index files (one for each range of keys, as many as its sort had partitions) tell by binary
search in which files a key can be; the directory of such a file tells, by binary search, the blocks; a range read and a
binary search in a block's lines give the captures, and range reads the records. `lookup` does so for many urls at once:
they are dealt by index file, and the blocks that they need by place, so a key that a third of all pages have is read
from its many blocks by many tasks. Reading everything goes over the directory and takes each archive in order of
offsets.

Defined results: null html is an empty payload, and null urls have the key "-"; rows with the same id and payload are
all responses; rows with a null id revisit if an equal payload has an id; control characters in urls are written
percent-encoded. Empty tables have an empty index; equal keys are in order of page ids; other columns are passed over;
very large payloads are one record each, written from a slice of their own. A task that is run again writes new files,
and only those of the run that counts are in the index.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import partitions
from .shared import cut, fresh_path, sieve, small_batches, written

REVISIT = 1000
BLOCK = 1000
ROLL = 256 << 20
SLICE = 4 << 20
_URL = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^#]*)", re.I)
LINES = "key string, page_id long, file string, offset long, length long"


def key_of(url: str | None) -> str:
    """The reversed-host key of a url: com,example,www)/path?query."""
    if url is None:
        return "-"
    m = _URL.match(url.strip())
    if not m:
        return url
    host = ",".join(reversed(m[1].lower().strip(".").split(".")))
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    path = m[3] or "/"
    return f"{host}{port}){path if path.startswith('/') else '/' + path}"


def _open(path: str, write: bool = False):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(name.rpartition("/")[0], recursive=True)
        return system.open_output_stream(name, compression=None)
    return system.open_input_file(name)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int) -> bytes:
    """One gzip member with a response or, where refers_to is given, a revisit record."""
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), f"WARC-Record-ID: <urn:page:{page_id}>".encode(), b"WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url).encode())
    head += [f"WARC-Payload-Digest: sha1:{digest}".encode(), f"WARC-Payload-Length: {size}".encode(), b"Content-Type: application/http; msgtype=response"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>".encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}".encode())
    c = zlib.compressobj(3, zlib.DEFLATED, 31)
    return c.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def parse(member: bytes) -> dict:
    """page_id, url, record_type, refers_to, digest, size, payload (None for revisits); checks lengths and digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    block = rest[: int(fields[b"Content-Length"])]
    number = lambda x: None if x is None or x == b"<urn:page:None>" else int(x[10:-1])
    out = {
        "page_id": number(fields[b"WARC-Record-ID"]), "url": fields.get(b"WARC-Target-URI", b"").decode() or None, "record_type": fields[b"WARC-Type"].decode(),
        "refers_to": number(fields.get(b"WARC-Refers-To")), "digest": fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), "size": int(fields[b"WARC-Payload-Length"]), "payload": None,
    }
    if out["record_type"] == "response":
        out["payload"] = block.partition(b"\r\n\r\n")[2]
        if len(out["payload"]) != out["size"] or hashlib.sha1(out["payload"]).hexdigest() != out["digest"]:
            raise ValueError(f"record of page {out['page_id']}: its payload isn't what its headers say")
    return out


def with_references(pages: DataFrame, least: int = REVISIT) -> DataFrame:
    """pages (page_id, url, html) with size, digest and refers_to (null for responses)."""
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha1(html).alias("digest"))
    same = p.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("rep"), F.count("*").alias("n")).where("n > 1 and rep is not null").select("digest", "rep")
    same = written(same, "payloads")
    flagged = sieve(p, "digest", same.select("digest"))
    maybe = flagged.where("_maybe").drop("_maybe").join(same, "digest", "left").withColumn("refers_to", F.when((F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("rep")), F.col("rep")))
    names = ["page_id", "url", "html", "size", "digest", "refers_to"]
    return maybe.select(*names).unionByName(flagged.where("not _maybe").withColumn("refers_to", F.lit(None).cast("long")).select(*names))


def write(pages: DataFrame, path: str, least: int = REVISIT) -> DataFrame:
    """Write the archives below path; the capture lines, written as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        try:
            for batch in (part for b in batches if b.num_rows for part in cut(b, "html", SLICE)):
                rows = []
                for page_id, url, html, size, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at > ROLL:
                        if out is not None:
                            out.close()
                        name, at = f"{path}/{uuid.uuid4().hex}.warc.gz", 0
                        out = _open(name, True)
                    member = record(page_id, url, html.encode(), digest, refers_to, size)
                    out.write(member)
                    rows.append((key_of(url), page_id, name, at, len(member)))
                    at += len(member)
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    small_batches(pages.sparkSession)
    return written(with_references(pages, least).mapInArrow(run, LINES), "captures")


def index(lines: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """Write sorted, compressed blocks below path; the directory (first, last key, file, offset, length, lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at, rows, held, out = f"{path}/{uuid.uuid4().hex}.cdx.gz", 0, [], [], None

        def put(some: list[tuple]) -> None:
            nonlocal at, out
            out = out or _open(name, True)
            c = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = c.compress("".join("\t".join("\\N" if x is None else str(x).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n") for x in r) + "\n" for r in some).encode()) + c.flush()
            out.write(member)
            rows.append((some[0][0], some[-1][0], name, at, len(member), len(some)))
            at += len(member)

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= block:
                put(held[:block])
                held = held[block:]
        if held:
            put(held)
        if out:
            out.close()
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["first", "last", "file", "offset", "length", "lines"])

    ordered = lines.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return written(ordered.select("key", "page_id", "file", "offset", "length").mapInArrow(run, "first string, last string, file string, offset long, length long, lines long"), "directory")


def _lines(member: bytes) -> list[tuple[str, int | None, str, int, int]]:
    back = {"\\": "\\", "t": "\t", "n": "\n"}
    plain = lambda s: re.sub(r"\\(.)", lambda m: back[m[1]], s)
    rows = (x.split("\t") for x in zlib.decompress(member, 31).decode().split("\n")[:-1])
    return [(plain(k), None if i == "\\N" else int(i), f, int(o), int(n)) for k, i, f, o, n in rows]


def captures(directory: DataFrame) -> DataFrame:
    """All capture lines of an index, by range reads of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _open(file) as f:
                    rows = _lines(f.read_at(length, offset))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    return directory.select("file", "offset", "length").mapInArrow(run, LINES)


RECORDS = "page_id long, url string, record_type string, refers_to long, digest string, size long"


def read(lines: DataFrame, payload: bool = False) -> DataFrame:
    """The records of capture lines, by range reads; each archive in order of offsets."""
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("size", pa.int64())] + [("payload", pa.binary())] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = []
                for file, offset, length in zip(*(c.to_pylist() for c in batch.slice(i, 500).columns), strict=True):
                    if file != name:
                        if f:
                            f.close()
                        name, f = file, _open(file)
                    rows.append(parse(f.read_at(length, offset)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds], names=[k for k, _ in kinds])
        if f:
            f.close()

    ordered = lines.select("file", "offset", "length").repartition(partitions(lines, 1), "file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, RECORDS + ", payload binary" * payload)


def _ranges(directory: DataFrame) -> list[tuple[str, str, str]]:
    """(last key, first key, file) of each index file, in order; there are as many as the index's sort had partitions."""
    got = directory.groupBy("file").agg(F.min("first").alias("lo"), F.max("last").alias("hi")).collect()
    return sorted((r["hi"], r["lo"], r["file"]) for r in got)


def _holding(lasts: list[str], firsts: list[str], key: str) -> range:
    """Which of some ranges, in order of keys, can hold the key."""
    return range(bisect_left(lasts, key), bisect_right(firsts, key))


class Directory:
    """Look-ups of single urls. In memory are the ranges of the index files; a file's directory is read when it is asked."""

    def __init__(self, directory: DataFrame):
        self.directory, rows = directory, _ranges(directory)
        self.last, self.first, self.files = ([r[i] for r in rows] for i in range(3))

    def find(self, url: str) -> list[dict]:
        """The records of a url: binary search, range read of its blocks, binary search, range reads."""
        key, out = key_of(url), []
        for i in _holding(self.last, self.first, key):
            blocks = self.directory.where(F.col("file") == self.files[i]).orderBy("offset").collect()
            for j in _holding([r["last"] for r in blocks], [r["first"] for r in blocks], key):
                with _open(self.files[i]) as f:
                    rows = _lines(f.read_at(blocks[j]["length"], blocks[j]["offset"]))
                for x in _of_key(rows, [r[0] for r in rows], key):
                    with _open(x[2]) as f:
                        out.append(parse(f.read_at(x[4], x[3])))
        return out


def _of_key(rows: list[tuple], keys: list[str], key: str) -> list[tuple]:
    return rows[bisect_left(keys, key) : bisect_right(keys, key)]


def lookup(urls: DataFrame, directory: DataFrame) -> DataFrame:
    """Capture lines of many urls (a column url), each once, by the directory."""
    spark = urls.sparkSession
    rows = _ranges(directory)
    last, first, files = ([r[i] for r in rows] for i in range(3))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = [(files[i], k) for k in sorted({key_of(u) for u in b.column(0).to_pylist()}) for i in _holding(last, first, k)]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in asked], pa.string()), pa.array([k for _, k in asked], pa.string())], names=["file", "key"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each index file its blocks, then the keys asked of it in order: the keys that each block is asked for."""
        now, blocks, at, held = None, [], 0, []

        def put():
            f, i, keys = now, at, held
            cols = [[f], [blocks[i][2]], [blocks[i][3]], [keys]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["file", "offset", "length", "keys"])

        for b in batches:
            for file, key, *block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != now:
                    if held:
                        yield put()
                    now, blocks, firsts, lasts, at, held = file, [], [], [], 0, []
                if key is None:
                    blocks.append(block)
                    firsts.append(block[0])
                    lasts.append(block[1])
                    continue
                for i in _holding(lasts, firsts, key):
                    if held and (i != at or len(held) == BLOCK):
                        yield put()
                        held = []
                    at, held = i, [*held, key]
        if held:
            yield put()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        for b in batches:
            for file, offset, length, keys in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with _open(file) as f:
                    rows = _lines(f.read_at(length, offset))
                every = [r[0] for r in rows]
                some = [x for k in keys for x in _of_key(rows, every, k)]
                cols = list(zip(*some, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "page_id", "file", "offset", "length"])

    small_batches(spark)
    n = partitions(directory, 1)
    asked = urls.select("url").mapInArrow(deal, "file string, key string").distinct()
    blocks = directory.select("file", F.lit(None).cast("string").alias("key"), "first", "last", "offset", "length")
    both = blocks.unionByName(asked, allowMissingColumns=True).repartition(n, "file").sortWithinPartitions("file", F.col("key").asc_nulls_first(), "offset")
    wanted = both.mapInArrow(choose, "file string, offset long, length long, keys array<string>")
    return wanted.repartition(n, "file", "offset").mapInArrow(take, LINES)


def archive(spark: SparkSession, pages: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write pages and their index: (capture lines, directory)."""
    path = path or fresh_path(spark, "archive")
    lines = write(pages, f"{path}/warc")
    return lines, index(lines, f"{path}/index")
