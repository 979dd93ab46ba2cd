"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's features are shares of its bytes and words (symbols, capitals, digits, marks, repeats within the text) and
those of the lines before and after it. Forward and backward passes give each line's marginal; weighted by length, they
make the text's share of good lines, which a logistic curve maps to the score. Only documents are labelled, so training
starts from each line having its document's label and, between fits, gives the lines of bad documents the label that
the field finds likelier (the likeliest bad line stays bad). All lines of all texts in a batch go through the passes
together, one line of each text at a time.

Training sees at most SAMPLE labelled documents, by a hash of their id. Defined results: a null or empty text is one
empty line and has a score; without training rows of both classes the score is 0.5; repeated rows score alike, repeated
label rows count as often as they stand; an empty table gives none; other columns are passed over. A very long text is
scored column by column (about a hundred bytes of memory a line), and its chain in stretches side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_slices
from .textkernel import SOLID, mix, raw, whole, windows, words

SAMPLE = 6000
#: Lines above which a text's chain is cut into stretches.
LONG = 4096
#: Label rows (an id and a class) up to which they are broadcast to the documents; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
SLICE = 1 << 20

_CLASSES = [b"#*$%&<>@^~_=\\{}", b"|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b".,;:", b" \t"]
_TABLES = np.zeros((len(_CLASSES), 256), np.uint8)
for _i, _c in enumerate(_CLASSES):
    _TABLES[_i, list(_c)] = 1
OWN = 2 * len(_CLASSES) + 8
WIDTH = 3 * OWN + 3


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every line (at least one for each text) with the total at the end, and the first line of each text.

    A text's lines start at its own start and after each of its line ends, the last of which may be at its very end."""
    breaks = np.flatnonzero(data == 10) + 1
    n = len(off) - 1
    first = np.arange(n + 1) + np.searchsorted(breaks, off, "right")  # a break at a text's start ended the text before
    start = np.empty(int(first[-1]) + 1, np.int64)
    own = np.zeros(len(start), bool)
    own[first] = True
    start[own], start[~own] = off, breaks
    return start, first


def line_columns(data: np.ndarray, off: np.ndarray, start: np.ndarray) -> Iterator[np.ndarray]:
    """The OWN features of every line, one column after another."""
    size = np.diff(start)
    m = len(size)
    safe = np.maximum(size, 1)

    def per_line(values: np.ndarray) -> np.ndarray:
        run = np.zeros(len(values) + 1, np.int32 if len(values) < 1 << 31 else np.int64)
        np.cumsum(values, out=run[1:])
        return run[start[1:]] - run[start[:-1]]

    for t in _TABLES:
        yield (per_line(t[data]) / safe).astype(np.float32)
    for t in _TABLES:
        yield np.minimum((per_line(t[data]) / safe).astype(np.float32) * 15, 1)  # even a few
    w = words(data, off, SOLID)
    k = len(w.start)
    line_of = np.searchsorted(start, w.start, "right") - 1 if k else np.zeros(0, np.int64)
    n_words = np.bincount(line_of, minlength=m)
    some = np.maximum(n_words, 1)
    h = w.hashes()
    again = np.zeros(k + 1, np.int32)
    grams = windows(h, 3)
    at = np.flatnonzero(whole(w.first, 3))
    if len(at):
        key = mix(grams[at] + w.doc_of()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        dup = np.zeros(len(at), bool)
        dup[order[1:][same]] = dup[order[:-1][same]] = True
        again[at[dup]] += 1
        np.add.at(again, at[dup] + 3, -1)
    repeat = np.cumsum(again[:-1]) > 0
    echo = np.zeros(k, bool)
    echo[1:] = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
    share = lambda v: (np.bincount(line_of, v, m) / some).astype(np.float32)
    yield (np.log1p(size) / 5).astype(np.float32)
    yield share(repeat)
    echoes = share(echo)
    yield echoes
    yield np.minimum(share(w.end - w.start) / 10, 3)
    yield (n_words < 4).astype(np.float32)
    yield (size == 0).astype(np.float32)
    yield share(data[w.end - 1] == 33 if k else np.zeros(0, bool))
    yield np.minimum(echoes * 4, 1)


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, WIDTH) features, the lengths of the lines in bytes, and the first line of each text: for training."""
    start, first = lines(data, off)
    x = np.stack(list(line_columns(data, off, start)), 1)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    top, end = first[:-1], first[1:] - 1
    before[top], after[end] = 0, 0
    edges = np.zeros((len(x), 3), np.float32)
    edges[:, 0], edges[top, 1], edges[end, 2] = 1, 1, 1
    return np.concatenate([x, before, after, edges], axis=1), np.diff(start), first


def line_scores(data: np.ndarray, off: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the features of line_features score by these weights, column by column (three numbers a line are held), the
    lengths of the lines, and the first line of each text."""
    start, first = lines(data, off)
    own, before, after = (np.zeros(len(start) - 1) for _ in range(3))
    for i, x in enumerate(line_columns(data, off, start)):
        own += x * emit[i]
        before += x * emit[OWN + i]
        after += x * emit[2 * OWN + i]
    top, end = first[:-1], first[1:] - 1
    before, after = np.roll(before, 1), np.roll(after, -1)
    before[top], after[end] = 0, 0
    own += before
    own += after
    own += emit[3 * OWN]
    own[top] += emit[3 * OWN + 1]
    own[end] += emit[3 * OWN + 2]
    return own, np.diff(start), first


def forward(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log forward messages of one long chain (lines, 2): stretches of about the square root of its length side by side,
    whose transfer matrices are chained first."""
    n = len(e)
    step = int(np.sqrt(n)) + 1
    many = -(-n // step)
    x = np.concatenate([e, np.zeros((many * step - n, 2))]).reshape(many, step, 2)
    on = lambda v, k: np.logaddexp(v[..., :1] + t[0], v[..., 1:] + t[1]) + x[:, k]
    m = np.full((2, many, 2), -np.inf)
    m[0, :, 0] = m[1, :, 1] = 0
    for k in range(step):
        m = np.logaddexp(m[..., :1] + t[0], m[..., 1:] + t[1]) + x[:, k]
    come = np.zeros((many, 2))
    v = x[0, 0]
    for k in range(1, step):
        v = np.logaddexp(v[0] + t[0], v[1] + t[1]) + x[0, k]
    for b in range(1, many):
        come[b] = v
        v = np.logaddexp(v[0] + m[0, b], v[1] + m[1, b])
    out, v = np.empty((many, step, 2)), come
    for k in range(step):
        v = on(v, k)
        if not k:
            v[0] = x[0, 0]
        out[:, k] = v
    return out.reshape(-1, 2)[:n]


class Field:
    """Weights of a two-state chain: state 1 is bad. Emissions score state 1; trans[a, b] scores a step from a to b."""

    def __init__(self, emit: np.ndarray, trans: np.ndarray):
        self.emit, self.trans = emit, trans

    def marginals(self, x: np.ndarray, first: np.ndarray, pairs: bool = False):
        """P(bad) of every line; with pairs also the expected steps (2, 2) and the log partition's sum. x: features, or
        what they score."""
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        order, long = order[n[order] <= LONG], order[n[order] > LONG]
        top, n = first[:-1][order], n[order]
        score = x @ self.emit if x.ndim == 2 else x
        longest = int(n[0]) if len(n) else 0
        live = np.searchsorted(-n, -np.arange(longest), "left")  # texts with more than t lines
        alpha = np.empty((len(x), 2))
        beta = np.zeros((len(x), 2))
        e = np.stack([np.zeros(len(x)), score], 1)
        t = self.trans
        for k in range(longest):
            at = top[: live[k]] + k
            if k:
                a = alpha[at - 1]
                alpha[at] = np.logaddexp(a[:, :1] + t[0], a[:, 1:] + t[1]) + e[at]
            else:
                alpha[at] = e[at]
        for k in range(longest - 2, -1, -1):
            at = top[: live[k + 1]] + k
            b = beta[at + 1] + e[at + 1]
            beta[at] = np.logaddexp(b[:, :1] + t[:, 0], b[:, 1:] + t[:, 1])
        for d in long.tolist():
            at = slice(first[d], first[d + 1])
            alpha[at] = forward(e[at], t)
            beta[at] = forward(e[at][::-1], t.T)[::-1] - e[at]
        both = alpha + beta
        p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
        if not pairs:
            return p
        z = np.logaddexp(both[:, 0], both[:, 1])
        inner = np.ones(len(x), bool)
        inner[first[:-1]] = False
        i = np.flatnonzero(inner)
        steps = alpha[i - 1][:, :, None] + t + (e[i] + beta[i])[:, None, :] - z[i][:, None, None]
        return p, np.exp(steps).sum(axis=0), float(z[first[:-1]].sum())


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, field: Field | None = None, rounds: int = 120, ridge: float = 5e-4) -> Field:
    """Maximum likelihood of the line labels y, by Adam on whole passes; x is divided by nothing, its features are shares."""
    field = field or Field(np.zeros(x.shape[1]), np.zeros((2, 2)))
    w = np.concatenate([field.emit, field.trans.ravel()])
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    i = np.flatnonzero(inner)
    seen = np.concatenate([y @ x, np.bincount(y[i - 1].astype(int) * 2 + y[i].astype(int), minlength=4).astype(float)])
    m, v, n = np.zeros_like(w), np.zeros_like(w), len(x)
    for k in range(1, rounds + 1):
        field = Field(w[:-4], w[-4:].reshape(2, 2))
        p, steps, _ = field.marginals(x, first, True)
        g = (np.concatenate([p @ x, steps.ravel()]) - seen) / n + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field(w[:-4], w[-4:].reshape(2, 2))


def good_share(p: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The text's length-weighted share of good lines."""
    weight = size + 1.0
    total = np.add.reduceat(weight, first[:-1])
    return np.add.reduceat(weight * (1 - p), first[:-1]) / total


def logistic(q: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a q + b)))."""
    x, b = np.stack([q - 0.5, np.ones(len(q))], 1), np.array([4.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 0.05
        move = np.linalg.solve(h, x.T @ (y - p) - 0.05 * b)
        b += np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-6:
            break
    return float(b[0]), float(b[1] - 0.5 * b[0])


def train(docs: DataFrame, labels: DataFrame, chosen: Column, id_col: str = "doc_id", label: str = "quality", sample: int = SAMPLE, passes: int = 3) -> tuple[Field, float, float] | None:
    """The field and its curve, from the labelled rows that `chosen` (a condition on `id`) takes."""
    y = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("y is not null and id is not null").where(chosen)
    n = y.count()
    few = n <= BROADCAST_LABELS
    if n > sample:
        y = y.where(F.pmod(F.xxhash64("id"), F.lit(n)) < sample)
    text = docs.select(F.col(id_col).alias("id"), F.col("text"))
    rows = text.join(F.broadcast(y) if few else y, "id").select("y", "text")

    def run(batch: pa.RecordBatch):
        x, size, first = line_features(*raw(batch.column(1)))
        cuts = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([size[a:b].astype(np.int64).tobytes() for a, b in cuts], pa.binary())], names=["y", "x", "size"])

    got = map_slices(rows, "text", run, "y int, x binary, size binary", SLICE).toArrow().to_pandas()
    if not len(got) or got["y"].nunique() < 2:
        return None
    x = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got["x"]]).astype(float)
    sizes = [np.frombuffer(b, np.int64) for b in got["size"]]
    size, first = np.concatenate(sizes), np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
    good = got["y"].to_numpy().astype(bool)
    of = np.repeat(~good, np.diff(first))
    bad, field = of.astype(float), None
    for _ in range(passes):
        field = fit(x, first, bad, field)
        p = field.marginals(x, first)
        most = np.maximum.reduceat(p, first[:-1])
        bad = (of & ((p > 0.5) | (p >= np.repeat(most, np.diff(first))))).astype(float)
    a, b = logistic(good_share(field.marginals(x, first), size, first), good.astype(float))
    return field, a, b


def score(docs: DataFrame, trained: tuple[Field, float, float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score in 0..1, good_share, n_lines, bad_lines (marginal over a half)."""
    if trained is None:
        return docs.select(id_col, F.lit(0.5).alias("score"), F.lit(0.5).alias("good_share"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("bad_lines"))
    field, a, b = trained

    def run(batch: pa.RecordBatch):
        x, size, first = line_scores(*raw(batch.column(1)), field.emit)
        p = field.marginals(x, first)
        q = good_share(p, size, first)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(a * q + b, -30, 30)))), pa.array(q), pa.array(np.diff(first), pa.int64()), pa.array(np.add.reduceat((p > 0.5).astype(np.int64), first[:-1]), pa.int64())],
            names=["id", "score", "good_share", "n_lines", "bad_lines"],
        )

    schema = f"id {dict(docs.dtypes)[id_col]}, score double, good_share double, n_lines long, bad_lines long"
    return map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", run, schema, SLICE).withColumnRenamed("id", id_col)
