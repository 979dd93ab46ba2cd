"""Best-fit packing by linear grouping on the histogram of piece lengths.

Only the histogram (at most `limit` rows) reaches the driver. There, large lengths are rounded up within groups of
equal cardinality, a configuration program over those few sizes is solved by column generation, actual lengths are
substituted for the rounded ones, and what is left, small lengths above all, is best-fit in decreasing order. The plan
is a list of patterns with repeat counts; its size follows the number of different lengths, not the documents. Pieces
are numbered within their length (salted, so a length that a third of all documents share is spread) and each finds its
sequence and offset in the plan by binary search.

Defined results: null text is empty; an empty text is one piece with the end id alone; repeated rows are separate
documents; ties of length go by the other columns; an empty table packs into nothing; other columns of items are carried
along, whatever their names. Very long texts are tokenized whole, a slice of their own each.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import carried, map_slices, unpacked, written
from .tokens import vocabulary

LIMIT = 4096
GROUPS = 16
LARGE = 1 / 3
#: Room that a substituted configuration may leave; each is tried, and the plan with the fewest sequences is taken.
ROOMS = (4096, 512, 128, 32, 8, 0)


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Per piece of a document: id, piece, start, length, ids_crc32; with ids also its ids."""

    def run(batch: pa.RecordBatch):
        flat, off = vocabulary(path).batch([t or "" for t in batch.column(1).to_pylist()], end_id)
        flat = flat.astype("<u4")
        n = -(-np.diff(off) // limit)
        row = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        a = off[row] + k * limit
        b = np.minimum(a + limit, off[row + 1])
        view = memoryview(flat).cast("B")
        cols = [batch.column(0).take(pa.array(row)), pa.array(k.astype(np.int32)), pa.array(k * limit), pa.array(b - a), pa.array([zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.int64())]
        names = ["id", "piece", "start", "length", "ids_crc32"]
        if ids:
            cols.append(pa.ListArray.from_arrays(pa.array(np.append(a, b[-1:] if len(b) else [0]).astype(np.int32)), pa.array(flat.astype(np.int32))))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"id {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", run, schema, 1 << 20, True).withColumnRenamed("id", id_col)


def grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths in descending order, cut into groups of equal cardinality; each a list of (length, how many)."""
    total, out, now, have = sum(counts.values()), [], [], 0
    size = max(1, -(-total // groups))
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            take = min(left, size - have)
            now.append((length, take))
            have, left = have + take, left - take
            if have == size:
                out.append(now)
                now, have = [], 0
    return [*out, now] if now else out


def _best_column(sizes: np.ndarray, value: np.ndarray, limit: int) -> tuple[float, np.ndarray]:
    """The configuration of most value: an unbounded knapsack over the sizes."""
    best, pick = np.zeros(limit + 1), np.full(limit + 1, -1)
    order = np.argsort(sizes)
    s, v = sizes[order], value[order]
    for c in range(int(s[0]), limit + 1):
        m = int(np.searchsorted(s, c, "right"))
        got = best[c - s[:m]] + v[:m]
        j = int(got.argmax())
        best[c], pick[c] = (got[j], j) if got[j] > best[c - 1] else (best[c - 1], -1)
    column, c = np.zeros(len(sizes)), limit
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            column[order[pick[c]]] += 1
            c -= int(s[pick[c]])
    return float(best[limit]), column


def configurations(sizes: list[int], need: list[int], limit: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Few-size packing: the linear program over configurations by column generation, rounded down."""
    s, n = np.array(sizes), np.array(need, float)
    basis = np.diag((limit // s).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x, price = inverse @ n, inverse.sum(axis=0)
        value, column = _best_column(s, price, limit)
        if value <= 1 + 1e-9:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-12, x / np.where(step > 1e-12, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.inv(basis) @ n
    return [(basis[:, j].astype(int), int(np.floor(x[j] + 1e-9))) for j in range(len(s)) if x[j] >= 1 - 1e-9]


def substitute(groups: list[list[tuple[int, int]]], chosen: list[tuple[np.ndarray, int]]) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Actual lengths in the slots of repeated configurations: (lengths, repeats), and how many of each length are left."""
    queues = [[list(x) for x in reversed(g)] for g in groups]
    patterns = []
    for column, repeats in chosen:
        slots = []
        for g, many in enumerate(column.tolist()):
            for _ in range(many):
                runs, left, q = [], repeats, queues[g]
                while left and q:
                    take = min(left, q[-1][1])
                    runs.append([q[-1][0], take])
                    q[-1][1] -= take
                    left -= take
                    if not q[-1][1]:
                        q.pop()
                if left:
                    runs.append([0, left])
                slots.append(runs[::-1])
        left = repeats
        while left and slots:
            step = min(s[-1][1] for s in slots)
            lengths = tuple(s[-1][0] for s in slots if s[-1][0])
            if lengths:
                patterns.append((lengths, step))
            for s in slots:
                s[-1][1] -= step
                if not s[-1][1]:
                    s.pop()
            left -= step
    rest: dict[int, int] = defaultdict(int)
    for q in queues:
        for length, many in q:
            rest[length] += many
    return patterns, rest


def best_fit(patterns: list[tuple[tuple[int, ...], int]], counts: dict[int, int], limit: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit in decreasing order of all counts into the patterns' room, then into new sequences.

    Equal sequences are one entry (contents, repeats); contents are (length, times) in order.
    """
    room: dict[int, list] = defaultdict(list)
    for lengths, many in patterns:
        room[limit - sum(lengths)].append((tuple((x, 1) for x in lengths), many))
    free = sorted(room)

    def put(left: int, contents: tuple, many: int) -> None:
        if left not in room or not room[left]:
            room[left] = []
            if (i := bisect_left(free, left)) == len(free) or free[i] != left:
                insort(free, left)
        room[left].append((contents, many))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            i = bisect_left(free, length)
            if i == len(free):
                fits = limit // length
                if full := todo // fits:
                    put(limit - fits * length, ((length, fits),), full)
                if part := todo % fits:
                    put(limit - part * length, ((length, part),), 1)
                break
            left = free[i]
            if not room[left]:
                free.pop(i)
                continue
            contents, many = room[left].pop()
            fits = left // length
            full, part = (many, 0) if many * fits <= todo else divmod(todo, fits)
            todo -= full * fits + part
            if full:
                put(left - fits * length, (*contents, (length, fits)), full)
            if part:
                put(left - part * length, (*contents, (length, part)), 1)
            if spare := many - full - bool(part):
                put(left, contents, spare)
    return [x for entries in room.values() for x in entries]


def plan(counts: dict[int, int], limit: int = LIMIT, groups: int = GROUPS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, times), ...) with repeats that hold every length as often as counted."""
    large = {x: n for x, n in counts.items() if limit * LARGE < x < limit}
    small = {x: n for x, n in counts.items() if x <= limit * LARGE or x == limit}
    if not large:
        return best_fit([], small, limit)
    sizes: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for g in grouped(large, groups):
        sizes[g[0][0]] += g  # groups that round to one size are one
    tops = sorted(sizes, reverse=True)
    chosen = configurations(tops, [sum(n for _, n in sizes[t]) for t in tops], limit)
    patterns, rest = substitute([sizes[t] for t in tops], chosen)
    best: list = []
    for most in ROOMS:
        pool = defaultdict(int, small)
        for x, n in rest.items():
            pool[x] += n
        kept = []
        for lengths, many in patterns:
            if limit - sum(lengths) <= most:
                kept.append((lengths, many))
            else:  # too loose once the actual lengths stand in it: these are best-fit with the rest
                for x in lengths:
                    pool[x] += many
        got = best_fit(kept, pool, limit)
        if not best or sum(m for _, m in got) < sum(m for _, m in best):
            best = got
    return best


class Places:
    """The plan by length: the place of the r-th piece of a length is found by binary search."""

    def __init__(self, patterns: list[tuple[tuple[tuple[int, int], ...], int]]):
        by: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        sequence = 0
        for contents, many in patterns:
            at, starts = 0, defaultdict(list)
            for length, times in contents:
                starts[length].append((at, times))
                at += length * times
            for length, runs in starts.items():
                for offset, times in runs:
                    by[length].append((many * times, sequence, times, offset))
            sequence += many
        self.sequences = sequence
        self.by = {}
        for length, rows in by.items():
            a = np.array(rows, np.int64)
            self.by[length] = (np.cumsum(a[:, 0]) - a[:, 0], a[:, 1], a[:, 2], a[:, 3])

    def find(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, sequence, times, offset = self.by[length]
        i = np.searchsorted(first, rank, "right") - 1
        k = rank - first[i]
        return sequence[i] + k // times[i], offset[i] + k % times[i] * length


def pack(items: DataFrame, limit: int = LIMIT, groups: int = GROUPS, salts: int | None = None) -> DataFrame:
    """items with an integer column length in 1..limit -> the same with sequence_id and offset, gapless from 0 (columns
    with these two names give way)."""
    spark = items.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names, kinds = items.columns, dict(items.dtypes)
    plain = [i for i, c in enumerate(names) if "array" not in kinds[c] and "map" not in kinds[c]]
    row = F.col("row")
    items = items.select("length", carried(items).alias("row"))
    items = items.withColumn("salt", F.pmod(F.xxhash64(*[row[f"c{i}"] for i in plain]), F.lit(salts)).cast("int"))
    cells = written(items.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")  # at most limit x salts rows
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    places = Places(plan(counts, limit, groups))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = [row[f"c{i}"] for i in plain if names[i] != "length"] or [F.lit(0)]
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1)
    ranked = ranked.join(cells, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        ln, rk = length.to_numpy(), rank.to_numpy()
        for x in np.unique(ln):
            at = np.flatnonzero(ln == x)
            seq[at], off[at] = places.find(int(x), rk[at])
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    kept = [c for c, name in zip(unpacked(names), names, strict=True) if name.lower() not in ("sequence_id", "offset")]
    return ranked.withColumn("place", place("length", "rank")).select(*kept, "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(pieces(docs, path, limit, end_id, id_col, text_col), "pieces"), limit)
