"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over every training window.

Items are read in blocks of about ITEM_CHARS characters; each block's windows become one sorted hash array that goes to
the executors with the task (its size is bounded by the block, not by the benchmark), and documents are scanned once a
block, one block at a time: the driver holds one. A hash hit counts only after its words compare equal. What a text is
hit by follows from the text alone, so each scan writes the texts with hits (few) under a 128-bit name, and documents
are joined with what all scans wrote; the number of blocks changes no row.

Defined results: null or wordless text has no words and no hits; items without words match nothing; repeated items
each count; an empty benchmark leaves every document clean; repeated rows, also those that share an id, each have their
row; an empty table gives none; very long texts are read whole, a slice of their own each; other columns are passed
over, or through by decontaminate, whatever their names. An item longer than a block is a block of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import carried, forget, map_slices, sieve, unpacked, written
from .textkernel import ALNUM, LOWER, raw, whole, windows, words

NGRAM = 10
ITEM_CHARS = 8 << 20
_SHIFT = np.uint64(42)
UPPER = ALNUM | (LOWER != np.arange(256))  # the same words before letters are lowered


class Items:
    """The windows of one block of items: by window length, sorted hashes with the places that have them."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.ids = [r[0] for r in rows]
        data, off = raw(pa.array([r[1] for r in rows], pa.large_string()))
        self.w = words(LOWER[data], off, ALNUM)
        h, self.places = self.w.hashes(), {}
        for size in sorted({min(n, int(c)) for c in self.w.counts if c}):
            wins = windows(h, size)
            ok = whole(self.w.first, size)
            counts = self.w.counts
            fits = (counts >= n) if size == n else (counts == size)
            at = np.flatnonzero(ok & fits[self.w.doc_of()[: len(ok)]])
            order = np.argsort(wins[at], kind="stable")
            at = at[order]
            near = np.zeros(1 << 22, bool)
            near[wins[at] >> _SHIFT] = True
            self.places[size] = (wins[at], at, near)
        self.item_of = self.w.doc_of()

    def scan(self, w) -> tuple[np.ndarray, dict[int, set]]:
        """Which words of a batch are hit, and by text the items whose windows occur in it."""
        hit, found = np.zeros(len(w.start) + 1, np.int32), defaultdict(set)
        if not self.places or not len(w.start):
            return hit[:-1] > 0, found
        h, doc = w.hashes(), None
        for size, (keys, at, near) in self.places.items():
            wins = windows(h, size)
            cand = np.flatnonzero(near[wins >> _SHIFT])
            cand = cand[whole(w.first, size)[cand]]
            lo, hi = np.searchsorted(keys, wins[cand], "left"), np.searchsorted(keys, wins[cand], "right")
            for p, a, b in zip(cand[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                mine = [w.text(x) for x in range(p, p + size)]
                for q in at[a:b].tolist():
                    if all(self.w.text(q + k) == x for k, x in enumerate(mine)):
                        hit[p] += 1
                        hit[p + size] -= 1
                        doc = w.doc_of() if doc is None else doc
                        found[int(doc[p])].add(self.ids[self.item_of[q]])
        return np.cumsum(hit[:-1]) > 0, found


_SPAN = pa.struct([(k, pa.int64()) for k in ("word", "words", "start", "stop")])
_HITS = "u long, v long, spans array<struct<word:long,words:long,start:long,stop:long>>, items array<long>"


def _scan_block(texts: DataFrame, items: Items) -> DataFrame:
    """Names, spans and items of the texts (u, v, text) that have hits; a text that stands twice may come twice."""

    def scan(batch: pa.RecordBatch):
        data, off = raw(batch.column(2))
        w = words(LOWER[data], off, ALNUM)
        hit, found = items.scan(w)
        at, spans = sorted(found), []
        for d in at:
            f, o, mine = int(w.first[d]), int(off[d]), hit[w.first[d] : w.first[d + 1]]
            edge = np.diff(np.concatenate([[0], mine.view(np.int8), [0]]).astype(np.int8))
            ends = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)
            spans.append([{"word": a, "words": b - a, "start": int(w.start[f + a]) - o, "stop": int(w.end[f + b - 1]) - o} for a, b in ends])
        ids = [sorted(found[d], key=lambda x: (x is not None, x or 0)) for d in at]
        where = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(spans, pa.list_(_SPAN)), pa.array(ids, pa.list_(pa.int64()))], names=["u", "v", "spans", "items"])

    return map_slices(texts, "text", scan, _HITS)


def merge_spans(spans: F.Column) -> F.Column:
    """The union of spans, those that touch joined."""
    last = lambda acc: F.element_at(acc, -1)
    end = lambda s: s["word"] + s["words"]
    wider = lambda a, s: F.struct(
        a["word"].alias("word"), (F.greatest(end(a), end(s)) - a["word"]).alias("words"), a["start"].alias("start"), F.greatest(a["stop"], s["stop"]).alias("stop")
    )
    return F.aggregate(
        F.array_sort(spans),
        F.filter(spans, lambda s: F.lit(False)),
        lambda acc, s: F.when((F.size(acc) > 0) & (end(last(acc)) >= s["word"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider(last(acc), s)))).otherwise(F.concat(acc, F.array(s))),
    )


def _blocks(benchmark: DataFrame, item_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about item_chars characters, an item at least, one block after another."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"] or ""))
        size += len(r["text"] or "")
        if size >= item_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def _named(text_col: str) -> dict[str, F.Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {"u": F.xxhash64(text), "v": F.xxhash64(F.lit(1), text)}


def _hits(texts: DataFrame, benchmark: DataFrame, n: int, item_chars: int) -> DataFrame:
    """u, v, spans, items of each different text that has hits; texts has u, v, text."""
    parts = [written(_scan_block(texts.select("u", "v", "text"), Items(rows, n)).dropDuplicates(["u", "v"]), "hits") for rows in _blocks(benchmark, item_chars)]
    if not parts:
        return texts.sparkSession.createDataFrame([], _HITS)
    if len(parts) == 1:
        return parts[0]
    out = reduce(DataFrame.unionByName, parts).groupBy("u", "v").agg(
        merge_spans(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    out = written(out, "hits")
    forget(*parts)
    return out


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, item_chars: int = ITEM_CHARS) -> DataFrame:
    """Per document: id, n_words, spans (of hit words: first word, words, UTF-8 bytes start and stop), items."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[c.alias(k) for k, c in _named(text_col).items()])
    hits = _hits(texts, benchmark, n, item_chars)
    kind = dict(docs.dtypes)[id_col]

    def count(batch: pa.RecordBatch):
        data, off = raw(batch.column(3))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words(data, off, UPPER).counts, pa.int64())], names=["id", "u", "v", "n_words"])

    counted = map_slices(texts.select("id", "u", "v", "text"), "text", count, f"id {kind}, u long, v long, n_words long")
    flagged = sieve(counted, "u", hits.select("u").distinct())
    none = {c: F.array().cast(dict(hits.dtypes)[c]) for c in ("spans", "items")}
    clean = flagged.where("not _maybe").select("id", "n_words", *[c.alias(k) for k, c in none.items()])
    hit = flagged.where("_maybe").join(hits, ["u", "v"], "left").select("id", "n_words", *[F.coalesce(F.col(k), c).alias(k) for k, c in none.items()])
    return clean.unionByName(hit).withColumnRenamed("id", id_col)


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "span", id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, item_chars: int = ITEM_CHARS) -> DataFrame:
    """Documents without benchmark passages. mode "span": hit words and what stands between them are cut out of the
    text, and a document goes only if no word is left; mode "document": every document with a hit goes."""
    rows = docs.select(F.col(text_col).alias("text"), carried(docs).alias("row"), *[c.alias(k) for k, c in _named(text_col).items()])
    hits = _hits(rows, benchmark, n, item_chars)
    flagged = sieve(rows, "u", hits.select("u").distinct())
    maybe = flagged.where("_maybe").join(hits, ["u", "v"], "left")
    names = unpacked(docs.columns)
    clean = flagged.where("not _maybe").select(*names).unionByName(maybe.where("spans is null").select(*names))
    if mode == "document":
        return clean

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: without_spans(t.encode(), [(x["start"], x["stop"]) for x in s]))

    solid = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    left = maybe.where("spans is not null").withColumn("left", cut("text", "spans")).where(F.col("left").rlike(solid))
    return clean.unionByName(left.select(*unpacked(docs.columns, **{text_col: F.col("left")})))
