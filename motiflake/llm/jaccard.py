"""Parity-sketch join: links between documents whose sets of word shingles have a Jaccard similarity of at least t.

1. A document's set becomes 64-bit shingle hashes; equal sets are one node (a 64-bit name), so copies cost once. A node's
   text is that of its least row by (id, name of the text), so repeated ids don't matter. Different sets may share a
   name (a second one tells them apart): nothing is left out of such a mixed node's candidates, and from step 5 on each
   of its sets is a node of its own.
2. Sizes are cut into bands that overlap, so that every two sets that can link share one (see Bands). In a band, sets
   that link differ in at most d shingles (|A - B| + |B - A| <= (1 - t) / t * smaller).
3. A band's sketch has d + 1 + e blocks of BITS bits; each shingle flips one bit of one block (parity), so the Hamming
   distance of two sketches is at most the symmetric difference, and a set of c filled blocks that may differ in d' <= d
   shingles agrees with a linked one in c - d' of them (pigeonhole). Blocks are sent in one order for all sets, those of
   many shingles first, as one common shingle alone is in many texts: if a set sends the first d' + k of its filled
   blocks (k is SURE, or c - d' if that is less), the first k that two linked sets share are among those of both, since
   at most d' others of a set stand before the last of them. A set with c <= d' sends every block, empty ones too.
   Blocks go as 64-bit sums over GF(2) of one random word for each set bit.
4. Nodes of a block with few are paired; a linked pair meets in as many blocks as step 3 says, or in a larger block,
   so others go. Larger blocks of the same nodes are one set. Nodes that are left, and those of a set, are compared by
   whole parity sketches, whose Hamming distance is at most the symmetric difference: pair by pair in blocks of few
   nodes, breadth first in larger ones. What stays are candidates; their components hold every true link. Large ones are
   split into chunks, each pair of chunks a task of bounded size.
5. A task verifies exactly: breadth first over the sets, skipping by size and by Hamming distance, intersecting the rest.

Defined results: texts without words (and null) have an empty set and link with nothing; fewer words than a shingle are
one shingle; repeated rows and ties are equal sets; rows that share an id are documents of their own, and a row without
an id has the least id that it reaches, or none. An empty table gives none; other columns are passed over, or through by
deduplicate, whatever their names. Very long texts are read whole, one to a slice. Only fixed-size records and the sets
of candidates are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import gathered, partitions, sent
from .graph import components
from .shared import carried, forget, map_slices, sieve, trim, unpacked, written
from .textkernel import LOWER, SOLID, mix, raw, whole, windows, words

REACH = 3
OWN = 4
BITS = 4096
#: Blocks of up to so many nodes are paired, which makes no more pairs than nodes.
FEW = 3
#: Linked sets share so many of the blocks they send, or all that they must share if that is less.
SURE = 4
CHUNK = 4096
_WORD = mix(np.arange(1, BITS + 1, dtype=np.uint64))
SLICE = 1 << 20
PAIR = np.dtype([("key", "<u8"), ("node", "<u8")])


def shingles(data: np.ndarray, off: np.ndarray, n: int, table: np.ndarray = SOLID) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after another, and n_texts + 1 offsets."""
    w = words(LOWER[data], off, table)
    h, counts = w.hashes(), w.counts
    wins = windows(h, n)
    at = np.flatnonzero(whole(w.first, n))
    docs, vals = [w.doc_of()[at]], [wins[at]]
    for k in range(1, n):  # texts of k words
        d = np.flatnonzero(counts == k)
        if len(d):
            docs.append(d)
            vals.append(windows(h, k)[w.first[d]])
    doc, val = np.concatenate(docs), np.concatenate(vals)
    order = np.lexsort((val, doc))
    doc, val = doc[order], val[order]
    keep = np.ones(len(val), bool)
    keep[1:] = (val[1:] != val[:-1]) | (doc[1:] != doc[:-1])
    doc, val = doc[keep], val[keep]
    return val, np.searchsorted(doc, np.arange(len(off)))


def _sums(values: np.ndarray, first: np.ndarray, op=np.add) -> np.ndarray:
    """op over each stretch; empty ones are 0."""
    out = np.zeros(len(first) - 1, values.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = op.reduceat(values, first[full])
    return out


def fingerprint(val: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A name of each set by its hashes' sum and its size, and another one to check it by."""
    size = np.diff(first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    node, check = (mix(_sums(mix(x), first) + size) for x in (val, val ^ np.uint64(0xC3A5C85C97CB3127)))
    return node, check


class Bands:
    """Which sizes are compared, with how many blocks.

    Sizes are cut into fine steps, REACH of them to a factor of 1/t, so sets that link are at most REACH steps apart.
    A band is OWN steps and the REACH above them.
    """

    def __init__(self, t: float):
        self.t, r, self.edges = t, t ** (-1 / REACH), [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, math.ceil(self.edges[-1] * r - 1e-9)))
        self.edges = np.array(self.edges)
        self.own = OWN if t < 0.85 else 3 * OWN
        self.kept: dict[int, tuple[int, int]] = {}

    def differ(self, smaller: np.ndarray | int) -> np.ndarray | int:
        return np.floor((1 - self.t) / self.t * smaller + 1e-9).astype(np.int64)

    def blocks(self, band: int) -> tuple[int, int]:
        """Blocks of a band and how many of them may be empty, so that hardly any set has more empty ones: n items fall
        into b blocks, of which about b * exp(-n / b) stay empty (the variance of that is of an occupancy)."""
        if band not in self.kept:
            low = int(self.edges[min(band * self.own, len(self.edges) - 1)])
            d = int(self.differ(int(self.edges[min((band + 1) * self.own + REACH, len(self.edges) - 1)]) - 1))
            b = d + 1
            while d and b < 4 * low:
                p = math.exp(-low / b)
                if b * (1 - p) - 3 * math.sqrt(max(0.0, b * p * (1 - (1 + low / b) * p))) > d:
                    break
                b += 1 + b // 100
            self.kept[band] = b, b - d - 1
        return self.kept[band]

    def of(self, sizes: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(band, which sets) with each set in one or two bands."""
        step = np.searchsorted(self.edges, sizes, "right") - 1
        band, out = step // self.own, []
        lower = (step % self.own < REACH) & (band > 0)
        for b in np.unique(np.concatenate([band, band[lower] - 1])):
            out.append((int(b), np.flatnonzero((band == b) | (lower & (band == b + 1)))))
        return out


def block_keys(val: np.ndarray, first: np.ndarray, node: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """The (block key, node) records of a batch of sets; and for each set how many sent blocks at least a linked one
    shares, in the band where that is least."""
    sizes, out, need = np.diff(first), [], np.full(len(first) - 1, 1 << 30)
    if not len(val):
        return np.zeros(0, PAIR), np.ones_like(need)
    for band, which in bands.of(np.where(sizes > 0, sizes, 1)):
        which = which[sizes[which] > 0]
        if not len(which):
            continue
        n, _ = bands.blocks(band)
        n_of = sizes[which]
        take = np.repeat(first[which] - np.concatenate([[0], np.cumsum(n_of)[:-1]]), n_of) + np.arange(n_of.sum())
        v = val[take]
        row = np.repeat(np.arange(len(which)), n_of)
        cell = row * n + ((v >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
        bit = _WORD[(v & np.uint64(BITS - 1)).astype(np.int64)]
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        sums, cells, held = np.bitwise_xor.reduceat(bit[order], head), cell[head], np.diff(np.append(head, len(cell)))
        there = np.bincount(cells // n, minlength=len(which))
        differ = bands.differ(n_of)
        bare = np.flatnonzero(there <= differ)
        sure = np.clip(there - differ, 1, SURE)
        need[which] = np.minimum(need[which], sure)
        most = np.where(there <= differ, n, differ + sure)
        key = mix(sums + mix(np.uint64(band << 32) + (cells % n).astype(np.uint64)))
        order = np.lexsort((key, -held, cells // n))  # in a set, blocks of many shingles come first
        rank = np.arange(len(cells)) - np.repeat(np.cumsum(there) - there, there)
        order = order[rank < most[cells // n]]
        key, rows = key[order], (cells // n)[order]
        if len(bare):  # these send their empty blocks too
            have = np.zeros((len(bare), n), bool)
            of = np.full(len(which), -1)
            of[bare] = np.arange(len(bare))
            inside = of[cells // n] >= 0
            have[of[cells[inside] // n], cells[inside] % n] = True
            r, c = np.nonzero(~have)
            key, rows = np.concatenate([key, mix(mix(np.uint64(band << 32) + c.astype(np.uint64)))]), np.concatenate([rows, bare[r]])
        rec = np.empty(len(key), PAIR)
        rec["key"], rec["node"] = key, node[which][rows]
        out.append(rec)
    return np.concatenate(out) if out else np.zeros(0, PAIR), np.where(need == 1 << 30, 1, need)


def meetings(records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(0, a, b, times) for all pairs of blocks with few nodes, (set, node, null, 1) for those of larger blocks: blocks with
    the same nodes, as near copies have many, are one set, named by its nodes."""
    records = records[np.lexsort((records["node"], records["key"]))]
    again = np.zeros(len(records), bool)
    again[1:] = records[1:] == records[:-1]
    records = records[~again]
    key, node = records["key"], records["node"].astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(cuts)
    pairs = [np.zeros((0, 2), np.int64)]
    for n in range(2, FEW + 1):
        first = cuts[:-1][size == n]
        pairs += [np.stack([node[first + i], node[first + j]], 1) for i in range(n) for j in range(i + 1, n)]
    pairs, times = _distinct(np.concatenate(pairs))
    many = np.repeat(size > FEW, size)
    names = mix(_sums(mix(node.astype(np.uint64)), cuts) + size.astype(np.uint64)).view(np.int64) | 1
    sets, _ = _distinct(np.stack([np.repeat(names, size)[many], node[many]], 1))
    for block, left, right, n in ((np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1], times), (sets[:, 0], sets[:, 1], None, np.ones(len(sets), np.int64))):
        for i in range(0, len(block), 100_000):
            part = [np.ascontiguousarray(x[i : i + 100_000]) for x in (block, left)]
            other = pa.nulls(len(part[0]), pa.int64()) if right is None else pa.array(np.ascontiguousarray(right[i : i + 100_000]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1]), other, pa.array(n[i : i + 100_000])], names=["block", "a", "b", "times"])


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of two columns, and how often each stands."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    head = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])) if len(rows) else np.zeros(0, np.int64)
    return rows[head], np.diff(np.append(head, len(rows)))


def sketches(val: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of two to four bits a shingle, one after another, and their offsets; lengths are powers of two
    words, so a longer one folds onto a shorter one."""
    n = np.diff(first)
    lanes = 1 << np.ceil(np.log2(np.maximum(n / 32, 1))).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(lanes)])
    m = mix(val.copy())
    at = np.repeat(start[:-1], n) + ((m >> np.uint64(6)) & np.repeat(lanes - 1, n).astype(np.uint64)).astype(np.int64)
    out = np.zeros(start[-1], np.uint64)
    np.bitwise_xor.at(out, at, np.uint64(1) << (m & np.uint64(63)))
    return out, start


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """Hamming distance of two sketches, the longer folded."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def near(sketch: list[np.ndarray], size: np.ndarray, t_num: int, t_den: int) -> Iterator[tuple[int, int]]:
    """Edges that span the components of sketches close enough to be linked."""
    short = min(map(len, sketch))
    fold = np.stack([np.bitwise_xor.reduce(s.reshape(-1, short), axis=0) for s in sketch])
    left = np.arange(len(size))
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            u = stack.pop()
            most = (t_den - t_num) * (size[left] + size[u])
            ok = np.abs(size[left] - size[u]) * (t_den + t_num) <= most
            ok[ok] = np.bitwise_count(fold[left[ok]] ^ fold[u]).sum(axis=1, dtype=np.int64) * (t_den + t_num) <= most[ok]
            found = [v for v in left[ok].tolist() if apart(sketch[u], sketch[v]) * (t_den + t_num) <= (t_den - t_num) * (size[u] + size[v])]
            for v in found:
                yield int(u), v
            stack.extend(found)
            left = left[~np.isin(left, found)]


def verify(sets: list[np.ndarray], t_num: int, t_den: int) -> np.ndarray:
    """For each set the index of its cluster's first member; clusters are the components of exact links."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    root = np.full(n, -1)
    lanes = max(1, min(256, int(size.max()) // 32 + 1)) if n else 1
    sketch = np.zeros((n, lanes), np.uint64)
    for i, s in enumerate(sets):
        m = mix(s.copy())
        np.bitwise_xor.at(sketch[i], (m >> np.uint64(6)).astype(np.int64) % lanes, np.uint64(1) << (m & np.uint64(63)))
    left = np.arange(n)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i], stack = i, [i]
        left = left[root[left] < 0]
        while stack and len(left):
            u = stack.pop()
            both = size[left] + size[u]  # 1 - t of the union, so (1 - t) / (1 + t) of the sizes' sum, may differ
            cand = left[np.abs(size[left] - size[u]) * (t_den + t_num) <= (t_den - t_num) * both]
            if len(cand):
                apart = np.bitwise_count(sketch[cand] ^ sketch[u]).sum(axis=1, dtype=np.int64)
                cand = cand[apart * (t_den + t_num) <= (t_den - t_num) * (size[cand] + size[u])]
            if not len(cand):
                continue
            near = []
            for a in range(0, len(cand), 512):
                part = cand[a : a + 512]
                every = np.concatenate([sets[x] for x in part])
                at = np.searchsorted(sets[u], every)
                at[at == size[u]] = 0
                same = np.add.reduceat((sets[u][at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(size[part])[:-1]]))
                near.append(part[t_den * same >= t_num * (size[part] + size[u] - same)])
            found = np.concatenate(near)
            root[found] = i
            stack.extend(found.tolist())
            left = left[root[left] < 0]
    return root


def _members(docs: DataFrame, n: int, t: tuple[int, int], chunk: int) -> DataFrame:
    """docs (id, text, u, v) -> id, u, v, n_shingles, root of every row; root is null without shingles."""
    kind, bands = dict(docs.dtypes)["id"], Bands(t[0] / t[1])

    def name(batch: pa.RecordBatch):
        val, first = shingles(*raw(batch.column(3)), n)
        sk, at = sketches(val, first)
        blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(at * 8), pa.py_buffer(sk)]).cast(pa.binary())
        node, check = fingerprint(val, first)
        need = block_keys(val, first, node, bands)[1].astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(first), pa.int64()), pa.array(node.view(np.int64)), pa.array(check.view(np.int64)), pa.array(need), blobs], names=["id", "u", "v", "n_shingles", "node", "check", "need", "sketch"])

    named = written(map_slices(docs.select("id", "u", "v", "text"), "text", name, f"id {kind}, u long, v long, n_shingles long, node long, check long, need int, sketch binary", SLICE), "sets")
    full = named.where("n_shingles > 0")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "u", "v")).alias("least")
    of_node = full.groupBy("node").agg(least, F.min("n_shingles").alias("n"), F.min("need").alias("need"), F.first("sketch").alias("sketch"), F.min("check").alias("check"), (F.min("check") != F.max("check")).alias("mixed"))
    of_node = written(of_node, "nodes")
    parts = partitions(docs)

    def send(batch: pa.RecordBatch):
        val, first = shingles(*raw(batch.column(0)), n)
        node, check = fingerprint(val, first)
        _, one = np.unique(np.stack([node, check], 1), axis=0, return_index=True)  # copies in a batch send once
        sizes = np.diff(first)[one]
        take = np.repeat(first[one] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        rec, _ = block_keys(val[take], np.concatenate([[0], np.cumsum(sizes)]), node[one], bands)
        return rec, ((rec["key"] >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)

    met = written(gathered(sent(docs.select("text"), "text", send, SLICE), parts, PAIR, meetings, "block long, a long, b long, times long"), "meetings")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n, m, free = (x.column(i).to_pylist() for i in (2, 3, 4))
            sa, sb = ([np.frombuffer(y.as_buffer(), np.uint64) for y in x.column(i)] for i in (5, 6))
            ok = [f or apart(p, q) * (t[1] + t[0]) <= (t[1] - t[0]) * (k + j) for p, q, k, j, f in zip(sa, sb, n, m, free, strict=True)]
            yield x.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    size_of = lambda c: of_node.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("need").alias(f"k_{c}"), F.col("mixed").alias(f"m_{c}"))
    sketch_of = lambda c: of_node.select(F.col("node").alias(c), F.col("sketch").alias(f"s_{c}"))
    often = met.where("block = 0").groupBy("a", "b").agg(F.sum("times").alias("times"))
    often = often.join(size_of("a"), "a").where("times >= k_a or m_a").join(size_of("b"), "b")
    often = often.where(f"m_a or m_b or (times >= k_b and abs(n_a - n_b) * {t[1] + t[0]} <= (n_a + n_b) * {t[1] - t[0]})")
    pairs = often.select("a", "b", "n_a", "n_b", F.expr("m_a or m_b").alias("free")).join(sketch_of("a"), "a").join(sketch_of("b"), "b")
    pairs = pairs.select("a", "b", "n_a", "n_b", "free", "s_a", "s_b").mapInArrow(close, "a long, b long")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for held in _runs(batches, 1):
            found = list(near([np.frombuffer(h[3], np.uint64) for h in held], np.array([h[1] for h in held]), *t)) if len(held) > 1 else []
            found += [(0, k) for h, k in zip(held, range(len(held)), strict=True) if k and (h[2] or held[0][2])]
            yield pa.RecordBatch.from_arrays([pa.array([held[p[i]][0] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    large = met.where("block <> 0").select("block", "a").distinct().join(size_of("a"), "a").join(sketch_of("a"), "a").select("block", "a", "n_a", "m_a", "s_a")
    large = large.repartition(parts, "block").sortWithinPartitions("block", F.desc("m_a"), "a").mapInArrow(within, "a long, b long")
    member = written(components(pairs.unionByName(large)), "candidates")
    forget(met)

    main = of_node.where("mixed").select("node", F.col("check").alias("main"))
    own = F.when(F.col("check") == F.col("main"), F.col("node")).otherwise(F.xxhash64("node", "check"))
    several = full.join(main, "node").groupBy("node", "check", "main").agg(least).select("node", own.alias("own"), "least")
    sets = of_node.where("not mixed").select("node", F.col("node").alias("own"), "least").unionByName(several)
    sizes = member.groupBy("root").agg(F.count("*").alias("size"))
    many = sizes.where(F.col("size") > chunk).select("root", F.ceil(F.col("size") / chunk).cast("int").alias("r"))
    mixed = of_node.where("mixed").join(member, "node", "left_anti").select("node", F.col("node").alias("root"))
    task = member.unionByName(mixed).join(many, "root", "left").join(sets.select("node", "own", "least.*"), "node").withColumn("c", F.when(F.col("r").isNotNull(), F.pmod(F.xxhash64("own"), "r").cast("int")))
    task = written(task.select("root", F.col("own").alias("node"), "r", "c", *[F.col(x).alias(f"of_{x}") for x in ("id", "u", "v")]), "tasks")
    some = sieve(docs.select("id", "u", "v", "text"), "u", task.select(F.col("of_u").alias("u"))).where("_maybe").drop("_maybe")
    wanted = some.join(task, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("u") == F.col("of_u")) & (F.col("v") == F.col("of_v"))).select("root", "node", "r", "c", "text")

    def sets_of(batch: pa.RecordBatch):
        val, first = shingles(*raw(batch.column(4)), n)
        blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((first * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(val))])
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], blobs.cast(pa.binary())], names=["root", "node", "r", "c", "set"])

    shown = map_slices(wanted, "text", sets_of, "root long, node long, r int, c int, set binary", SLICE)
    other = F.explode(F.coalesce(F.transform(F.sequence(F.lit(0), F.col("r") - 1), lambda k: F.struct(F.least(k, F.col("c")).alias("i"), F.greatest(k, F.col("c")).alias("j"))), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))))
    tasks = shown.select("root", "node", "set", other.alias("p")).select("root", "p.i", "p.j", "node", "set").repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "node")

    def check_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for held in _runs(batches, 3):
            held = [h for k, h in enumerate(held) if not k or h[0] != held[k - 1][0]]  # a repeated row brings its node again
            root = verify([np.frombuffer(h[1], np.uint64) for h in held], *t)
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([held[r][0] for r in root], pa.int64())], names=["a", "b"])

    links = written(tasks.mapInArrow(check_task, "a long, b long"), "links")
    root = components(links) if many.limit(1).count() else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    every = named.select("id", "u", "v", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"), "check")
    if main.limit(1).count():
        every = every.join(main, "node", "left").withColumn("node", F.when(F.col("main").isNull(), F.col("node")).otherwise(own))
    every = every.select("id", "u", "v", "n_shingles", "node").join(root, "node", "left")
    out = written(every.select("id", "u", "v", "n_shingles", F.coalesce("root", "node").alias("root")), "members")
    forget(named, of_node, member, task, links)
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Stretches of rows that agree in the first columns, without those columns, as Python values."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if held:
                    yield held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield held


def _texts(docs: DataFrame, id_col: str, text_col: str, *more: F.Column) -> DataFrame:
    """id, text, a 128-bit name (u, v) of the text, and more."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text).alias("u"), F.xxhash64(F.lit(1), text).alias("v"), *more)


def clusters(docs: DataFrame, n: int = 5, t: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per document: id, n_shingles, component_id (the smallest id that links reach). t is a fraction, as (4, 5)."""
    full = _members(_texts(docs, id_col, text_col), n, t, chunk)
    lone = full.where("root is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    least = full.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    linked = full.where("root is not null").join(least, "root").select("id", "n_shingles", "component_id")
    return linked.unionByName(lone).withColumnRenamed("id", id_col)


def deduplicate(docs: DataFrame, n: int = 5, t: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One document of each component: the one with the smallest id (ids before none; of one id, the least name of a
    text). Rows with one id and one text are one document; rows without an id and without a word stay."""
    texts = _texts(docs, id_col, text_col, carried(docs).alias("row"))
    full = _members(texts, n, t, chunk)
    name = ["id", "u", "v"]
    rows = full.groupBy(*name, "root").agg(F.count("*").alias("times"))
    best = rows.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), *name)).alias("best"), F.sum("times").alias("many")).where("many > 1")
    own = F.struct(F.col("id").isNull().alias("none"), *name)
    marked = rows.join(best, "root", "left").select(*[F.col(c).alias(f"of_{c}") for c in name], (F.col("best").isNotNull() & (own != F.col("best"))).alias("gone"), "times")
    marked = written(marked.where("gone or times > 1"), "marked")
    flagged = sieve(texts, "u", marked.select(F.col("of_u").alias("u")))
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("u") == F.col("of_u")) & (F.col("v") == F.col("of_v"))
    maybe = flagged.where("_maybe").join(marked, same, "left").where("gone is null or not gone")
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    several = F.col("gone").isNotNull() & (F.col("id").isNotNull() | words)
    kept = flagged.where("not _maybe").select("row").unionByName(maybe.where(~several).select("row")).unionByName(maybe.where(several).dropDuplicates(name).select("row"))
    return kept.select(*unpacked(docs.columns))
