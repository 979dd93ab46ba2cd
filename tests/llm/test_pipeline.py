"""The pipeline's stages, each against brute force over its own input."""

import re
import zlib

import numpy as np
import pytest
from test_operators import brute_clusters, brute_spans, words_of

from motiflake.llm import suffix, tokens, toxicity
from motiflake.llm.queries import table, tokenizer_path, toxicity_model
from motiflake.llm.shared import written

pipeline = pytest.importorskip("corpus_pipeline")
WORD = r"[^\x20\x09-\x0D]"


@pytest.fixture(scope="module")
def stages(spark, small):
    """By stage: its input and its result, both as dictionaries by id (packing: rows)."""
    docs, out = table(spark, small, "documents"), {}
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = written(stage(spark, docs, small), name)
        if name != "packing":
            assert docs.columns == list(pipeline.COLUMNS)
        out[name] = (before, docs.collect())
    return out


def kept(stages, name):
    before, after = stages[name]
    rows = {r["doc_id"]: r for r in after}
    assert len(rows) == len(after) and set(rows) <= set(before)
    assert all(r["n_chars"] == len(r["text"] or "") for r in after)
    assert all(rows[i][c] == before[i][c] for i in rows for c in ("lang", "source"))
    return {i: r["text"] for i, r in before.items()}, {i: r["text"] for i, r in rows.items()}


def test_toxicity(spark, small, stages):
    before, after = kept(stages, "toxicity")
    docs = table(spark, small, "documents")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity_model(docs, table(spark, small, "labels"))).collect()}
    assert after == {i: t for i, t in before.items() if scores[i] < 0.5} and len(after) < len(before)


def test_near_copies(stages):
    before, after = kept(stages, "near_copies")
    ids = sorted(before)
    _, root = brute_clusters([before[i] for i in ids], 5, (4, 5))
    assert after == {i: before[i] for k, i in enumerate(ids) if root[k] == k} and len(after) < len(before)


def test_repeats(stages):
    before, after = kept(stages, "repeats")
    ids = sorted(before)
    raw, cover = brute_spans([before[i] for i in ids], suffix.SIZE)
    want = {}
    for i, b, c in zip(ids, raw, cover, strict=True):
        gone = c.copy()
        for k in np.flatnonzero(c):  # whole characters go
            a = k
            while b[a] & 0xC0 == 0x80:
                a -= 1
            z = k + 1
            while z < len(b) and b[z] & 0xC0 == 0x80:
                z += 1
            gone[a:z] = True
        text = np.frombuffer(b, np.uint8)[~gone].tobytes().decode() if len(b) else ""
        if re.search(WORD, text) or not re.search(WORD, before[i] or ""):
            want[i] = None if before[i] is None else text
    assert after == want


def test_benchmark(spark, small, stages):
    before, after = kept(stages, "benchmark")
    grams = set()
    for r in table(spark, small, "benchmark").collect():
        w = words_of(r["text"])
        n = min(10, len(w))
        grams |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want = {}
    for i, t in before.items():
        found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low)))
        w, hit = [m[0] for m in found], [False] * len(found)
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit[k : k + n] = [True] * n
        out, at, k = [], 0, 0
        while k < len(w):
            if hit[k]:
                z = k
                while z + 1 < len(w) and hit[z + 1]:
                    z += 1
                out.append(t[at : found[k].start()])
                at, k = found[z].end(), z
            k += 1
        if not any(hit):
            want[i] = t
        elif words_of("".join([*out, t[at:]])):
            want[i] = "".join([*out, t[at:]])
    assert after == want


def test_packing(stages):
    before, rows = stages["packing"]
    v, want = tokens.Vocabulary(tokenizer_path()), set()
    ids, off = v.batch([r["text"] or "" for r in before.values()], 1)
    for k, i in enumerate(before):
        x = ids[off[k] : off[k + 1]].astype("<u4")
        want |= {(i, a // 4096, a, len(x[a : a + 4096]), zlib.crc32(x[a : a + 4096].tobytes())) for a in range(0, len(x), 4096)}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert at.get(r["sequence_id"], 0) == r["offset"]
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 4096


def test_run_is_the_stages(spark, small, stages):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = pipeline.run(spark, small).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r[c] for c in cols) for r in stages["packing"][1])
