"""Toxicity: class-conditional Kneser-Ney models over the letters of words, compared by length-normalised likelihood.

Words are runs of letters and digits; Unicode punctuation and spaces end them, and text without spaces (Han, Kana, Thai
and the like, symbols) is read by a window of WINDOW characters from each of its characters on, each counted as a word.
A word is a path of byte prefixes to its end, however long. For a prefix h and its continuation b, each class c has
    P_c(b | h) = max(n_c(hb) - D, 0) / n_c(h) + D * types_c(h) / n_c(h) * P(b | h)
where P is shared by both classes: the same formula over both classes' counts, whose own backoff is made of continuation
counts (in how many different prefixes b follows the last two bytes of h). Rare expressions so fall back on shared
counts and tell little about the class; an unseen continuation of a seen prefix gets the discounted shares of the
classes alone (the shared P cancels out), and what follows an unseen prefix nothing.

No prefix is left out. Counted words are dealt by their first HEAD bytes and kept as a table of buckets, so a bucket has
every prefix longer than that; shorter ones (the head) and the continuation counts are bounded by the alphabet, not by
the corpus, and are broadcast. Texts are scored by joining their different words with those buckets: each group of texts
(GROUP bytes of a partition) asks once for each of its words, and the answers go back to the group.

A text is compared by the difference of its two log-likelihoods, divided by its words. Few words of a toxic text are
toxic, so the toxic model draws a word from the ordinary model but for a share RARE, which it draws from the toxic one:
a word adds log(1 - RARE + RARE * P_toxic / P_ordinary). The score is a logistic curve of that difference (and of how
sure it is at the text's length), fitted on a sample of the calibration rows, at most CALIBRATION of them, scored by a
model without their words. Texts are then scored by a model of all rows, the sample's words too. Both models share the
continuation counts, which don't know classes. Contexts of whole words before a word were tried and left out: on the
labelled rows they lowered held-out accuracy, as nearly every pair of words is new.

Defined results: a null or empty text has a difference of zero and gets the score of the prior; unlabelled rows are scored
alike; without training rows of both classes the score is 0; repeated label rows count as often as they stand; repeated
rows score alike; an empty table gives none; other columns are passed over, or through by reject, whatever their names.
Very long texts are read whole, a slice of their own each.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import partitions
from .shared import cut, fresh_path, small_batches, trim, written
from .textkernel import ALNUM, BASE, BASE_INV, Words, mix, power, raw, running, words

DISCOUNT = 0.95
#: The share of a toxic text's words that come from the toxic model.
RARE = 0.001
HEAD = 4
GROUP = 32 << 20
LOOK, LOOK_ROWS = 1 << 18, 1024
#: Characters of a window over text without spaces.
WINDOW = 4
CALIBRATION = 20_000
#: Label rows (an id and a class) up to which they are broadcast to the documents; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
TOXIC_WEIGHT = 3.0
END = np.uint64(0xA5A5A5A5)
ROOT = np.uint64(0x1234567)
WORDS = "bucket int, grp long, size binary, chars binary, counts binary"


def _lowered(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return raw(pc.utf8_lower(col.fill_null("")))


class Paths:
    """Words as byte spans, with keys of their prefixes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.data, self.start, self.size = data, start, size
        self.run = running(data, BASE)
        self.hash = self.prefix(start, size)

    def prefix(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return mix((self.run[start + n] - self.run[start]) * power(BASE_INV, start) + n.astype(np.uint64))

    def only(self, which: np.ndarray) -> Paths:
        out = object.__new__(Paths)
        out.data, out.run = self.data, self.run
        out.start, out.size, out.hash = self.start[which], self.size[which], self.hash[which]
        return out

    def bucket(self, n: int) -> np.ndarray:
        """By the first HEAD bytes."""
        return (mix(self.prefix(self.start, np.minimum(self.size, HEAD))) % np.uint64(n)).astype(np.int32)

    def chars(self) -> np.ndarray:
        to = np.cumsum(self.size)
        return self.data[np.repeat(self.start - to + self.size, self.size) + np.arange(to[-1] if len(to) else 0)]

    def steps(self, low: int, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The low-th to high-th continuations of each word, its end being the last: which word, the keys of the prefix
        before and after, and the last two bytes before with the byte (0: the word's end; 1: its start)."""
        last = self.size + 1
        many = np.maximum((last if high is None else np.minimum(last, high)) - low + 1, 0)
        which = np.repeat(np.arange(len(many)), many)
        n = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + low
        start, size = self.start[which], self.size[which]
        parent = np.where(n == 1, ROOT, self.prefix(start, n - 1))
        key = self.prefix(start, np.minimum(n, size))
        key = np.where(n > size, mix(key ^ END), key)
        byte = lambda at, ok, other: np.where(ok, self.data[np.where(ok, at, 0)], other).astype(np.int64)
        tri = byte(start + n - 3, n > 2, 1) << 16 | byte(start + n - 2, n > 1, 1) << 8 | byte(start + n - 1, n <= size, 0)
        return which, parent, key, tri


#: Scripts written without spaces: Thai, Lao, Myanmar, Khmer, Kana, Han.
UNSPACED = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3041, 0x3100), (0x31F0, 0x3200), (0x3400, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x20000, 0x40000))


@cache
def _kinds() -> np.ndarray:
    """By code point: 0 between words (punctuation, spaces, controls), 2 without spaces around it (UNSPACED and symbols), 1 else."""
    out = np.ones(0x110000, np.uint8)
    for a, b in UNSPACED:
        out[a:b] = 2
    for c in range(0x80, 0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "PZ" or kind == "Cc":
            out[c] = 0
        elif kind[0] == "S":
            out[c] = 2
    out[0x200B] = 0
    return out


def _found(data: np.ndarray, off: np.ndarray) -> Words:
    """Words, and in runs without spaces a window of up to WINDOW characters from each character on."""
    lead = np.flatnonzero(data >= 0xC0)
    b, n = data[lead].astype(np.int64), 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    padded = np.append(data, np.zeros(3, np.uint8))
    one, two, three = (padded[lead + k].astype(np.int64) & 0x3F for k in (1, 2, 3))
    point = np.where(n == 2, (b & 0x1F) << 6 | one, np.where(n == 3, (b & 0xF) << 12 | one << 6 | two, (b & 7) << 18 | one << 12 | two << 6 | three))
    kind = _kinds()[point]
    apart, shown = kind != 1, data
    if apart.any():
        shown = data.copy()
        for k in range(4):
            shown[lead[apart & (n > k)] + k] = 0x20
    w = words(shown, off, ALNUM)
    u, n = lead[kind == 2], n[kind == 2]
    if not len(u):
        return w
    first = np.concatenate([[True], u[1:] != u[:-1] + n[:-1]]) | np.isin(u, off)
    last = np.append(np.flatnonzero(first)[1:], len(u)) - 1
    stop = np.minimum(np.arange(len(u)) + WINDOW - 1, last[np.cumsum(first) - 1])
    start, end = np.concatenate([w.start, u]), np.concatenate([w.end, u[stop] + n[stop]])
    order = np.argsort(start)
    return Words(data, off, start[order], end[order], np.searchsorted(start[order], off))


def _unique(paths: Paths, counts: np.ndarray | None) -> tuple[Paths, np.ndarray | None]:
    """Different words, their counts summed."""
    _, first, inverse = np.unique(paths.hash, return_index=True, return_inverse=True)
    if counts is not None:
        counts = np.stack([np.bincount(inverse, c, len(first)) for c in counts.T], 1).astype(np.int64)
    return paths.only(first), counts


def _joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]) -> tuple[Paths, np.ndarray | None]:
    """One set of different words from several of (size, chars, counts)."""
    size = np.concatenate([x[0] for x in parts]).astype(np.int64)
    paths = Paths(np.concatenate([x[1] for x in parts]), np.cumsum(size) - size, size)
    return _unique(paths, None if parts[0][2] is None else np.concatenate([x[2] for x in parts]))


def _rows(paths: Paths, counts: np.ndarray | None, n: int, grp: int) -> pa.RecordBatch:
    """Words dealt by bucket: a row for each bucket."""
    bucket = paths.bucket(n)
    order = np.argsort(bucket, kind="stable")
    ends = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
    out: list[list] = [[], [], [], [], []]
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        some = paths.only(order[a:b])
        row = (bucket[order[a]], grp, some.size.astype(np.uint32).tobytes(), some.chars().tobytes(), b"" if counts is None else counts[order[a:b]].tobytes())
        for column, x in zip(out, row, strict=True):
            column.append(x)
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["bucket", "grp", "size", "chars", "counts"])


def _read(size: bytes, chars: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    n = np.frombuffer(size, np.uint32).astype(np.int64)
    return n, np.frombuffer(chars, np.uint8), np.frombuffer(counts, np.int64).reshape(len(n), -1) if counts else None


def _name(parts: list[pa.RecordBatch], at: int) -> int:
    """A group's name, from its first LOOK bytes (or LOOK_ROWS rows) of text."""
    h, rows, size = hashlib.blake2b(digest_size=7), 0, 0
    for part in parts:
        for x in part.column(at):
            if rows == LOOK_ROWS or size >= LOOK:
                break
            text = x.as_buffer().to_pybytes() if x.is_valid else b""
            h.update(len(text).to_bytes(8, "little") + text)
            rows, size = rows + 1, size + len(text)
    return int.from_bytes(h.digest(), "little")


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of a partition with the name of their group: the same in every pass over the same rows, however these
    come in batches and wherever the partition stands in a plan. Groups that begin alike may share a name."""
    start, now, name, held, rows, size = 0, 0, None, [], 0, 0

    def named():
        nonlocal name, held
        if held:
            name = _name(held, held[0].schema.get_field_index(column)) if name is None else name
            for part in held:
                yield name, part
            held = []

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = start + np.cumsum(sizes)
        group = (ends - sizes) // GROUP
        start = int(ends[-1])
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]).tolist()
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if group[i] != now:
                yield from named()
                now, name, rows, size = group[i], None, 0, 0
            for part in cut(batch.slice(i, j - i), column, 1 << 20):
                held.append(part)
                if name is None:
                    rows, size = rows + part.num_rows, size + (pc.sum(pc.binary_length(part.column(part.schema.get_field_index(column)))).as_py() or 0)
                if name is not None or rows >= LOOK_ROWS or size >= LOOK:
                    yield from named()
    yield from named()


def _asked(docs: DataFrame, n: int, classes: list[str]) -> DataFrame:
    """Different words of each group of texts, dealt; with counts by the columns of classes (how often a row counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        now, have, fresh, room = None, [], 0, 0
        for grp, part in _grouped(batches, "text"):
            if grp != now and have:
                yield _rows(*_joined(have), n, now)
                have, fresh, room = [], 0, 0
            now = grp
            data, off = _lowered(part.column(0))
            w = _found(data, off)
            if not len(w.start):
                continue
            times = np.stack([part.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(classes))], 1).astype(np.int64)[w.doc_of()] if classes else None
            some, c = _unique(Paths(data, w.start, w.end - w.start), times)
            have.append((some.size, some.chars(), c))
            fresh += len(some.size)
            if fresh > max(400_000, room):
                some, c = _joined(have)
                have, fresh, room = [(some.size, some.chars(), c)], 0, len(some.size)
        if have:
            yield _rows(*_joined(have), n, now)
        have.clear()
        trim(False)

    return docs.select("text", *classes).mapInArrow(run, WORDS)


@dataclass
class Table:
    """Log-ratios of continuations seen (by key), and of unseen ones (by the prefix before)."""

    key: np.ndarray
    step: np.ndarray
    up: np.ndarray
    stop: np.ndarray

    def ratios(self, parent: np.ndarray, key: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(key))
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        up = np.minimum(np.searchsorted(self.up, parent), len(self.up) - 1)
        return np.where(self.key[at] == key, self.step[at], np.where(self.up[up] == parent, self.stop[up], 0.0))


def _summed(parent, key, tri, counts):
    """Different continuations in the order of their prefix, with summed counts."""
    order = np.lexsort((key, parent))
    parent, key = parent[order], key[order]
    head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (parent[1:] != parent[:-1])])) if len(key) else np.zeros(0, int)
    return parent[head], key[head], tri[order][head], np.add.reduceat(counts[order], head, axis=0) if len(head) else counts[:0]


@dataclass
class Continuations:
    """In how many different prefixes a byte follows two others."""

    tri: np.ndarray
    n: np.ndarray
    total: np.ndarray

    def share(self, tri: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.tri, tri), len(self.tri) - 1)
        return (np.where(self.tri[at] == tri, self.n[at], 0) + 0.1) / (self.total[tri >> 8] + 25.6)


def _table(parent, key, tri, counts, follow: Continuations, discount: float) -> Table:
    """Ratios from all continuations of some prefixes, as _summed gives them."""
    if not len(key):
        return Table(key, np.zeros(0), parent, np.zeros(0))
    up = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
    of = np.cumsum(np.concatenate([[False], parent[1:] != parent[:-1]]))
    a = np.concatenate([counts, counts.sum(1, keepdims=True)], 1).astype(float)
    n, types = np.add.reduceat(a, up, axis=0), np.add.reduceat((a > 0).astype(float), up, axis=0)
    left = np.where(n > 0, discount * types / np.maximum(n, 1), 1.0)
    p = lambda c, below: np.where(n[of, c] > 0, np.maximum(a[:, c] - discount, 0) / np.maximum(n[of, c], 1), 0) + left[of, c] * below
    shared = p(2, follow.share(tri))
    step, order = np.log(p(1, shared)) - np.log(p(0, shared)), np.argsort(key)
    return Table(key[order], step[order], parent[up], np.log(left[:, 1]) - np.log(left[:, 0]))


@dataclass
class Model:
    """The counted words in buckets (a table), and what is bounded by the alphabet: the head without and with the sample."""

    words: DataFrame
    buckets: int
    heads: tuple[Table, Table]
    follow: Continuations
    discount: float


def count(docs: DataFrame, classes: list[str]) -> tuple[DataFrame, int]:
    """Counted words of all labelled texts, by bucket, and how many buckets; classes are two columns, or four, the last
    two being those of the sample."""
    n = partitions(docs, 1)
    if len(classes) == 2:
        docs, classes = docs.withColumns({"s0": F.lit(0), "s1": F.lit(0)}), [*classes, "s0", "s1"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_read(*(x.as_py() for x in row)) for b in batches for row in zip(*b.columns[2:], strict=True)]
        if parts:
            yield _rows(*_joined(parts), 4 * n, -1)

    return written(_asked(docs, 4 * n, classes).repartition(n, "bucket").mapInArrow(add, WORDS), "words"), 4 * n


def _of(counts: np.ndarray, full: bool) -> np.ndarray:
    """The classes' counts, with the sample's or without."""
    return counts[:, :2] + counts[:, 2:] if full else counts[:, :2]


def build(vocabulary: DataFrame, buckets: int, discount: float = DISCOUNT) -> Model | None:
    """The model: nothing is left out of it."""
    sums = ("c0", "c1", "s0", "s1")
    kind = "parent long, key long, tri long, " + ", ".join(f"{c} long" for c in sums)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # short prefixes as they stand (key <> 0), of the longer ones how many have each tri (key 0)
        for b in batches:
            for row in zip(*b.columns[2:], strict=True):
                paths, counts = _joined([_read(*(x.as_py() for x in row))])
                which, parent, key, tri = paths.steps(1, HEAD)
                parent, key, tri, c = _summed(parent, key, tri, counts[which])
                many, each = np.unique(_summed(*(x := paths.steps(HEAD + 1))[1:], counts[x[0]])[2], return_counts=True)
                zero = np.zeros(len(many), np.int64)
                columns = [(parent.view(np.int64), zero), (key.view(np.int64), zero), (tri, many), (c[:, 0], each), *((c[:, i], zero) for i in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in columns], names=["parent", "key", "tri", *sums])

    got = vocabulary.mapInArrow(send, kind).groupBy("parent", "key", "tri").agg(*[F.sum(c).alias(c) for c in sums]).toArrow()
    parent, key, tri = (got.column(c).to_numpy() for c in ("parent", "key", "tri"))
    counts = np.stack([got.column(c).to_numpy() for c in sums], 1)
    deep = key == 0
    tris = np.concatenate([tri[deep], tri[~deep]])
    many, inverse = np.unique(tris, return_inverse=True)
    each = np.bincount(inverse, np.concatenate([counts[deep, 0], np.ones((~deep).sum())]))
    counts = counts[~deep]
    if not len(counts) or not counts[:, :2].sum(0).all():
        return None
    follow = Continuations(many, each, np.bincount(many >> 8, each, 1 << 16))
    *nodes, counts = _summed(parent[~deep].view(np.uint64), key[~deep].view(np.uint64), tri[~deep], counts)
    return Model(vocabulary, buckets, tuple(_table(*nodes, _of(counts, full), follow, discount) for full in (False, True)), follow, discount)


def ratios(asked: DataFrame, model: Model, full: bool = True) -> DataFrame:
    """log P(word | toxic) - log P(word | ordinary) of every asked word: rows (grp, hash, ratio) of arrays as bytes."""
    sent = asked.sparkSession.sparkContext.broadcast((model.heads[full], model.follow))
    discount = model.discount

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        known, wanted = [], {}
        for b in batches:
            for _, grp, *row in zip(*b.columns, strict=True):
                row = _read(*(x.as_py() for x in row))
                known.append(row) if grp.as_py() < 0 else wanted.setdefault(grp.as_py(), []).append(row)
        if not wanted:
            return
        head, follow = sent.value
        tail = None
        if known:
            paths, counts = _joined(known)
            which, *nodes = paths.steps(HEAD + 1)
            tail = _table(*_summed(*nodes, _of(counts, full)[which]), follow, discount)
        for grp, parts in wanted.items():
            paths, _ = _joined(parts)
            out = np.zeros(len(paths.size))
            for table, low, high in ((head, 1, HEAD), (tail, HEAD + 1, None)):
                if table is not None:
                    which, parent, key, _ = paths.steps(low, high)
                    out += np.bincount(which, table.ratios(parent, key), len(out))
            yield pa.RecordBatch.from_arrays([pa.array([grp], pa.int64()), pa.array([paths.hash.tobytes()], pa.binary()), pa.array([out.astype(np.float32).tobytes()], pa.binary())], names=["grp", "hash", "ratio"])

    n = max(1, model.buckets // 4)
    return asked.unionByName(model.words).repartition(n, "bucket").mapInArrow(run, "grp long, hash binary, ratio binary")


def gained(ratio: np.ndarray) -> np.ndarray:
    """What words add to the toxic model's log-likelihood over the ordinary one's, from their log-ratios."""
    return np.log1p(RARE * np.expm1(np.minimum(ratio, 60.0)))


def features(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), full: bool = True) -> DataFrame:
    """Per row: the kept columns, n_words and `gain`, the length-normalised difference of its log-likelihoods, by the
    model with the sample's words or without."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("text", *keep)
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():  # both passes have to see the same partitions
        docs = written(docs, "texts")
    answers = fresh_path(spark, "ratios")
    found = ratios(_asked(docs, model.buckets, []), model, full)
    found.repartition(partitions(docs, 1), "grp").write.option("compression", "zstd").partitionBy("grp").parquet(answers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        now, known, value = None, None, None
        for grp, part in _grouped(batches, "text"):
            data, off = _lowered(part.column(0))
            w = _found(data, off)
            r = np.zeros(0)
            if len(w.start):
                if grp != now:
                    known, value, now = *_answers(f"{answers}/grp={grp}"), grp
                h, inverse = np.unique(Paths(data, w.start, w.end - w.start).hash, return_inverse=True)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                if (known[at] != h).any():
                    raise ValueError("the rows of a partition changed between two passes over them")
                r = value[at][inverse].astype(float)
            n = w.counts
            safe = np.maximum(n, 1)
            run = np.concatenate([[0.0], np.cumsum(gained(r))])
            gain = (run[w.first[1:]] - run[w.first[:-1]]) / safe
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(n, pa.int64()), pa.array(gain)], names=[*keep, "n_words", "gain"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_words long, gain double"])
    return docs.mapInArrow(run, schema)


def _answers(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and ratios of the words of a group."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    names = [f.path for f in fs.get_file_info(pa.fs.FileSelector(path)) if f.path.endswith(".parquet")]
    rows = [r for name in names for r in pq.read_table(fs.open_input_file(name), partitioning=None).to_pylist()]
    known = np.concatenate([np.frombuffer(r["hash"], np.uint64) for r in rows])
    value = np.concatenate([np.frombuffer(r["ratio"], np.float32) for r in rows])
    order = np.argsort(known)
    return known[order], value[order]


def _inputs(n: np.ndarray, gain: np.ndarray) -> list[np.ndarray]:
    """What the curve sees, for arrays; a short text's mean weighs less."""
    x = np.arcsinh(gain / RARE)
    return [np.ones(len(n)), x, x * np.sqrt(np.minimum(n, 400.0) / 400.0)]


def fit(sample, y: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; a toxic row weighs TOXIC_WEIGHT ordinary ones."""
    x = np.stack(_inputs(*(sample[c].to_numpy().astype(float) for c in ("n_words", "gain"))), 1)
    w = np.where(y > 0, TOXIC_WEIGHT, 1.0)
    b = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.5)
    ridge[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * b)
        b += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, counted: Column, calibrated: Column, id_col: str = "doc_id", label: str = "toxic") -> tuple[Model, np.ndarray] | None:
    """Model and weights from the labelled rows that `counted` and `calibrated` (conditions on `id`) choose: all are
    counted, and of the calibrated ones that aren't `counted` a sample fits the weights by a model without them."""
    y = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("y is not null and id is not null")
    few = y.count() <= BROADCAST_LABELS
    text = docs.select(F.col(id_col).alias("id"), "text").where("text is not null")
    share = y.where(calibrated).count()
    chosen = F.coalesce(calibrated, F.lit(False))
    if share > CALIBRATION:  # a bound on what the curve is fitted on; rows beyond it are counted
        chosen = chosen & (F.pmod(F.xxhash64("id"), F.lit(int(share // CALIBRATION) + 1)) == 0)
    with_y = lambda which: text.where(which).join(F.broadcast(y.where(which)) if few else y.where(which), "id")
    held = chosen & ~F.coalesce(counted, F.lit(False))
    classes = {f"{c}{k}": (own & (F.col("y").cast("boolean") == bool(k))).cast("int") for c, own in (("c", ~held), ("s", held)) for k in (0, 1)}
    model = build(*count(with_y(counted | calibrated).select("text", *[x.alias(c) for c, x in classes.items()]), [*classes]))
    if model is None:
        return None
    sample = features(with_y(chosen), model, ("y",), full=False).toArrow().to_pandas()
    if not len(sample) or sample["y"].nunique() < 2:
        return None
    return model, fit(sample, sample["y"].to_numpy().astype(float))


def _score(b: np.ndarray) -> Column:
    n, x = F.col("n_words").cast("double"), F.asinh(F.col("gain") / RARE)
    terms = [F.lit(1.0), x, x * F.sqrt(F.least(n, F.lit(400.0)) / 400.0)]
    z = sum((t * float(w) for t, w in zip(terms, b, strict=True)), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def score(docs: DataFrame, trained: tuple[Model, np.ndarray] | None, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the kept columns, n_words, score in 0..1."""
    if trained is None:
        return docs.select(id_col, *keep, F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("score"))
    model, b = trained
    return features(docs, model, (id_col, *keep)).select(id_col, *keep, "n_words", _score(b).alias("score"))


def reject(docs: DataFrame, trained: tuple[Model, np.ndarray] | None, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, whole."""
    if trained is None:
        return docs
    model, b = trained
    named = docs.select(F.col("text"), F.struct(*docs.columns).alias("_row"))
    return features(named, model, ("_row",)).where(_score(b) < threshold).select("_row.*")
