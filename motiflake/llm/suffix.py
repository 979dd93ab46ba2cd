"""Removal of repeated passages: every byte covered by a `size`-byte string that starts twice or more in the corpus.

Suffixes are sorted as in column-wise multi-document construction, on aligned collections instead of on one corpus-wide
file, whose rounds would be as many as the longest text has bytes:

1. The windows of `size` bytes of a text are cut into runs whose smallest `k`-gram hash stands at the same place (their
   anchor; it depends on the window's bytes only). Equal windows have equal anchors at equal distances, so all windows
   that can be equal meet under their anchor's hash. Equal runs are one document of the collection with a multiplicity.
2. All runs of an anchor form a collection, aligned at it. From the last column to the first, one symbol of each
   document is inserted a round: the order of the suffixes and the common prefixes of neighbours are updated from the
   round before by a stable sort on the inserted symbols (the collection's transform, column by column) and range minima.
3. A window is repeated if in its column a neighbour shares `size` bytes or its run has several sites.

Collections are dealt by anchor hash; a task works through its collections in batches of bounded size. Whole-text
copies are one text with a count.

Defined results: null text is empty; texts shorter than `size` keep all; repeated rows count as several occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import by_bucket, gathered, partitions, sent
from .shared import carried, forget, map_slices, sieve, trim, unpacked, written
from .textkernel import BASE, BASE_INV, mix, power, raw, running, shifted

SIZE = 200
GRAM = 64
COLLECTION = 200_000
SLICE = 1 << 20
PLACE = np.uint64((1 << 26) - 1)
MOST = 1 << 21
RUN = np.dtype([("key", "<u8"), ("content", "<u8"), ("u", "<i8"), ("v", "<i8"), ("p", "<i4"), ("n", "<i2")])
HEAD = np.dtype([("key", "<u8"), ("u", "<i8"), ("v", "<i8"), ("p", "<i4"), ("n", "<i2"), ("left", "<i2"), ("many", "u1")])
SITE = np.dtype([("p", "<i4"), ("many", "u1")])
SPAN = np.dtype([("start", "<i4"), ("stop", "<i4")])


def runs(data: np.ndarray, off: np.ndarray, size: int = SIZE, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: anchor hash, content hash, text, first window, windows, anchor's distance."""
    n, w = len(data), size - k + 1
    if n > MOST:  # one very long text: stretches of windows, each run within one
        parts = []
        for c in range(0, n - size + 1, MOST - size + 1):
            part = runs(data[c : c + MOST], np.clip(off - c, 0, min(MOST, n - c)), size, k)
            parts.append((*part[:3], part[3] + np.maximum(0, c - off[part[2]]), *part[4:]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    if n < size:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    sums = running(data, BASE)
    gram = mix(shifted(sums[k:] - sums[:-k], BASE_INV))
    m = n - size + 1  # windows, also those across texts, which go below
    value = np.full(-(-len(gram) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    value[: len(gram)] = (gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64)
    table = value.reshape(-1, w)
    head = np.minimum.accumulate(table, axis=1).ravel()
    tail = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(tail[:m], head[w - 1 : w - 1 + m]) & PLACE).astype(np.int64)
    inside = np.zeros(m + 1, np.int8)
    lo, hi = off[:-1], np.minimum(off[1:] - size + 1, m)
    full = hi > lo
    inside[lo[full]] = 1
    np.add.at(inside, hi[full], -1)
    start_of = np.zeros(m, bool)
    start_of[lo[full]] = True
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | start_of[1:] | ~inside[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return runs(data[:0], off[:1], size, k)
    text = np.searchsorted(off, first, "right") - 1
    last = np.minimum(np.append(first[1:], m), off[text + 1] - size + 1)
    a = anchor[first]
    content = mix((sums[last - 1 + size] - sums[first]) * power(BASE_INV, first) + (last - first).astype(np.uint64))
    return gram[a], content, text, first - off[text], last - first, a - first


def _sites(records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of anchors with several sites: one site of each content goes to the collection, and the others of that
    content, being the same document of it, are spans as they are."""
    records = records[np.lexsort((records["p"], records["v"], records["u"], records["content"], records["key"]))]
    again = np.zeros(len(records), bool)  # a repeated row sent its runs again
    again[1:] = records[1:] == records[:-1]
    records = records[~again]
    key_new = np.concatenate([[True], records["key"][1:] != records["key"][:-1]])
    content_new = key_new | np.concatenate([[True], records["content"][1:] != records["content"][:-1]])
    of_key, of_content = np.cumsum(key_new) - 1, np.cumsum(content_new) - 1
    sites = np.bincount(of_content)[of_content]
    contents = np.bincount(of_key[content_new])[of_key]
    for kind, pick in ((0, (sites > 1) & ~content_new), (1, content_new & ((contents > 1) | (sites > 1)))):
        r = records[pick]
        r, many = r[order := np.lexsort((r["v"], r["u"]))], (sites[pick] > 1)[order]
        if kind:
            out = np.empty(len(r), SITE)
            out["p"], out["many"] = r["p"], many
        else:
            out = np.empty(len(r), SPAN)
            out["start"], out["stop"] = r["p"], r["p"].astype(np.int64) + r["n"] - 1 + SIZE
        yield from _by_text(r, out, kind)


def _by_text(r: np.ndarray, out: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """A row (name of the text, kind, blob) for each text; r, in the order of names, says whose each item is."""
    if not len(r):
        return
    u, v = r["u"], r["v"]
    ends = np.concatenate([[0], np.flatnonzero((u[1:] != u[:-1]) | (v[1:] != v[:-1])) + 1, [len(r)]])
    for i in range(0, len(ends) - 1, 5000):
        e = ends[i : i + 5001]
        blobs = [out[a:b].tobytes() for a, b in zip(e[:-1].tolist(), e[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(u[e[:-1]]), pa.array(v[e[:-1]]), pa.array(np.full(len(blobs), kind, np.int32)), pa.array(blobs, pa.binary())], names=["u", "v", "kind", "blob"])


def repeated_windows(head: np.ndarray, body: np.ndarray, start: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(document, window) pairs that are repeated in collections aligned at their anchors.

    head: HEAD records sorted by key; body[start[i] :] holds the bytes of document i, n + size - 1 of them.
    """
    m = len(head)
    left, length = head["left"].astype(np.int64), head["n"].astype(np.int64) + size - 1
    group = np.cumsum(np.concatenate([[True], head["key"][1:] != head["key"][:-1]])) - 1
    base = start + left
    order = np.arange(m)
    lcp = np.zeros(m, np.int32)  # with the document before in the order
    docs, wins = [], []
    for j in range(int((length - left).max()) - 1, -int(left.max()) - 1, -1):
        there = (j >= -left[order]) & (j < (length - left)[order])
        symbol = np.zeros(m, np.int64)
        symbol[there] = body[base[order[there]] + j].astype(np.int64) + 1
        rank = np.argsort(group[order] * 257 + symbol, kind="stable")
        s, g = symbol[rank], group[order[rank]]
        same = np.zeros(m, bool)
        same[1:] = (s[1:] == s[:-1]) & (g[1:] == g[:-1]) & (s[1:] > 0)
        new = np.zeros(m, np.int32)
        at = np.flatnonzero(same)
        if len(at):
            a, b = rank[at - 1] + 1, rank[at]  # least common prefix over old places a .. b
            near = a == b
            low = np.empty(len(at), np.int32)
            low[near] = lcp[a[near]]
            if not near.all():
                a, b = a[~near], b[~near]
                ends = np.stack([a, b + 1], 1).ravel()
                low[~near] = np.minimum.reduceat(np.append(lcp, 0), ends)[::2]
            new[at] = np.minimum(low + 1, size)
        order, lcp = order[rank], new
        begins = s > 0  # a window starts in this column if size bytes follow
        begins &= j + size <= (length - left)[order]
        hit = begins & ((lcp >= size) | np.append(lcp[1:] >= size, False) | (head["many"][order] > 0))
        if hit.any():
            d = order[hit]
            docs.append(d)
            wins.append(left[d] + j)
    return (np.concatenate(docs), np.concatenate(wins)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _compare(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows of all collections in a bucket."""
    head = np.concatenate([h for h, _ in parts])
    body = np.concatenate([b for _, b in parts])
    length = head["n"].astype(np.int64) + SIZE - 1
    start = np.cumsum(length) - length
    order = np.lexsort((head["p"], head["v"], head["u"], head["key"]))
    head, start = head[order], start[order]
    keep = np.ones(len(head), bool)  # a repeated row sent its runs again
    keep[1:] = np.any([head[c][1:] != head[c][:-1] for c in ("key", "u", "v", "p")], axis=0)
    head, start = head[keep], start[keep]
    cuts = np.flatnonzero(np.concatenate([[True], head["key"][1:] != head["key"][:-1], [True]]))
    a = 0
    while a < len(head):
        b = int(cuts[max(np.searchsorted(cuts, a, "right"), np.searchsorted(cuts, a + COLLECTION, "right") - 1)])
        doc, win = repeated_windows(head[a:b], body, start[a:b])
        doc, win = (x[np.lexsort((win, doc))] for x in (doc, win))
        if len(doc):
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (win[1:] != win[:-1] + 1)])
            first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(doc)) - 1
            h = head[a:b][doc[first]]
            out = np.empty(len(first), SPAN)
            out["start"], out["stop"] = h["p"] + win[first], h["p"] + win[last] + SIZE
            by = np.lexsort((h["v"], h["u"]))
            yield from _by_text(h[by], out[by], 0)
        a = b


def merged(blobs: list[bytes]) -> list[tuple[int, int]]:
    """The union of spans, touching ones joined."""
    s = np.sort(np.concatenate([np.frombuffer(b, SPAN) for b in blobs]), order=["start", "stop"])
    stop = np.maximum.accumulate(s["stop"])
    new = np.flatnonzero(np.concatenate([[True], s["start"][1:] > stop[:-1]]))
    return list(zip(s["start"][new].tolist(), stop[np.append(new[1:], len(s)) - 1].tolist(), strict=True))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: F.Column | None = None) -> DataFrame:
    """Per row: id, text (null as empty), spans (blobs of repeated spans in bytes, or null), copies of its whole text,
    and what else a caller wants carried (rest). A text's name is 128 bits (u, v)."""
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.lit(None) if rest is None else rest).alias("rest"))
    text = text.withColumns({"u": F.xxhash64("text"), "v": F.xxhash64(F.lit(1), "text")})
    names, name = ["id", "text", "spans", "copies", "rest"], ["u", "v"]
    parts = partitions(docs)

    def bucket_of(key: np.ndarray) -> np.ndarray:
        return ((key >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)

    def send(batch: pa.RecordBatch):
        u, v = (batch.column(i).to_numpy() for i in (0, 1))
        _, one = np.unique(np.stack([u, v], 1), axis=0, return_index=True)
        one.sort()
        part = batch.take(pa.array(one))
        data, off = raw(part.column(2))
        key, content, doc, p, n, _ = runs(data, off)
        rec = np.empty(len(key), RUN)
        rec["key"], rec["content"], rec["u"], rec["v"], rec["p"], rec["n"] = key, content, u[one][doc], v[one][doc], p, n
        return rec, bucket_of(key)

    sites = gathered(sent(text.select(*name, "text"), "text", send, SLICE), parts, RUN, _sites, "u long, v long, kind int, blob binary")
    sites = written(sites, "sites")
    one = written(text.groupBy(*name).agg(F.count("*").alias("copies"), F.min("id").alias("rep")), "texts")
    asked = sites.where("kind = 1").groupBy(*name).agg(F.collect_list("blob").alias("sites")).join(one, name).select(F.struct(*name).alias("name"), "rep", "sites")
    near = sieve(text.drop("rest"), "u", sites.where("kind = 1").select("u").distinct()).where("_maybe").drop("_maybe").withColumn("own", F.struct(*name))
    wanted = asked.where("rep is not null").join(near, (F.col("name") == F.col("own")) & (F.col("rep") == F.col("id"))).select(*name, "text", "sites")
    lost = asked.where("rep is null").join(near, F.col("name") == F.col("own")).select(*name, "text", "sites")
    wanted = wanted.unionByName(lost)

    def segments(batch: pa.RecordBatch):
        data, off = raw(batch.column(2))
        key, _, doc, p, n, left = runs(data, off)
        asked = [np.concatenate([np.frombuffer(x, SITE) for x in s]) for s in batch.column(3).to_pylist()]
        want_doc = np.repeat(np.arange(len(asked)), [len(x) for x in asked])
        want = np.concatenate(asked)
        mine, theirs = (doc << 32) + p, (want_doc << 32) + want["p"].astype(np.int64)
        order = np.argsort(mine)
        at = order[np.searchsorted(mine[order], theirs)]
        head = np.empty(len(at), HEAD)
        head["key"], head["u"], head["v"], head["p"] = key[at], batch.column(0).to_numpy()[doc[at]], batch.column(1).to_numpy()[doc[at]], p[at]
        head["n"], head["left"], head["many"] = n[at], left[at], want["many"]
        bucket = bucket_of(key[at])
        by = np.argsort(bucket, kind="stable")
        head, at, bucket = head[by], at[by], bucket[by]
        ends = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist()
        begin, size = (off[doc[at]] + p[at]).tolist(), (n[at] + SIZE - 1).tolist()
        bodies = [b"".join([data[begin[i] : begin[i] + size[i]].tobytes() for i in range(a, b)]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        heads = [head[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[ends[:-1]].astype(np.int32)), pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], names=["bucket", "head", "body"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for rows in by_bucket(batches):
            yield from _compare([(np.frombuffer(h.as_buffer(), HEAD), np.frombuffer(b.as_buffer(), np.uint8)) for h, b in rows])

    asked = map_slices(wanted, "text", segments, "bucket int, head binary, body binary", SLICE).repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = asked.mapInArrow(compare, "u long, v long, kind int, blob binary")
    spans = sites.where("kind = 0").unionByName(found).groupBy(*name).agg(F.collect_list("blob").alias("spans"))
    spans = written(one.select(*name, "copies").join(spans, name, "left").where("copies > 1 or spans is not null"), "spans")
    forget(sites, one)
    flagged = sieve(text, "u", spans.select("u"))
    hit = flagged.where("_maybe").join(spans, name, "left").select(*names)
    free = flagged.where("not _maybe").withColumns({"spans": F.lit(None).cast("array<binary>"), "copies": F.lit(None).cast("long")}).select(*names)
    return hit.unionByName(free)


def spans_of(n_bytes: int, copies: int | None, blobs: list[bytes] | None) -> list[tuple[int, int]]:
    if n_bytes >= SIZE and (copies or 1) > 1:
        return [(0, n_bytes)]
    return merged(blobs) if blobs else []


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batch: pa.RecordBatch):
        rows = []
        for t, blobs, copies in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            b = t.as_buffer().to_pybytes()
            s = spans_of(len(b), copies, blobs)
            rows.append((len(b), sum(y - x for x, y in s), len(s), hashlib.sha256(without(b, s) if s else b).hexdigest()))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = repeated(docs, id_col, text_col).drop("rest")
    return map_slices(found, "text", run, f"id {dict(docs.dtypes)[id_col]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def kept_text(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without its spans, each widened to whole characters."""
    wide = []
    for a, b in spans:
        while a > 0 and text[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        wide.append((a, b))
    joined: list[tuple[int, int]] = []
    for a, b in wide:
        joined[-1:] = [(joined[-1][0], max(b, joined[-1][1]))] if joined and a <= joined[-1][1] else [*joined[-1:], (a, b)]
    return without(text, joined).decode("utf-8", "replace")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without repeated passages (widened to whole characters); those left without a word go, unless
    they had none."""
    rest = F.struct(carried(docs, (id_col, text_col)).alias("row"), F.col(text_col).isNull().alias("null"))
    found = repeated(docs, id_col, text_col, rest)

    @F.pandas_udf("string")
    def kept(text, spans, copies):
        def one(t, s, c):
            b = t.encode()
            return kept_text(b, spans_of(len(b), None if c != c else c, None if s is None else list(s)))

        return text.combine(spans, lambda t, s: (t, s)).combine(copies, lambda ts, c: one(*ts, c))

    touched = F.col("spans").isNotNull() | (F.coalesce("copies", F.lit(1)) > 1)
    word = r"[^ \t\n\x0B\f\r]"
    plain = F.when(~F.col("rest.null"), F.col("text"))
    new = found.where(touched).withColumn("_new", kept("text", "spans", "copies")).where(F.col("_new").rlike(word) | ~F.col("text").rlike(word))
    new = new.withColumn("text", F.when(~F.col("rest.null"), F.col("_new"))).drop("_new")
    old = found.where(~touched).withColumn("text", plain)
    out = new.unionByName(old)
    return out.select(*unpacked(docs.columns, "rest.row", **{id_col: F.col("id"), text_col: F.col("text")}))
