"""The operators against brute force and round trips, with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motiflake.llm import chat, decontam, graph, jaccard, licenses, packing, quality, rules, suffix, textkernel, tokens, toxicity, warc
from motiflake.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def docs_of(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)


def sample(small):
    import pandas as pd

    return [t for t in pd.read_parquet(f"{small}/documents.parquet").text]


@pytest.fixture(scope="module")
def texts(small):
    base = sample(small)
    return [None, "", " ", "x", "one two", "one two", "é" * 50, base[3] + " more words here", base[3], base[3], "word " * 400, *base[:60], "a" * 30_000]


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def test_word_kernel(texts):
    col = pa.array(texts)
    data, off = textkernel.raw(col)
    w = textkernel.words(textkernel.LOWER[data], off, textkernel.ALNUM)
    got = [[w.text(i).decode() for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [words_of(t) for t in texts]
    h = w.hashes()
    seen = {}
    for i in range(len(h)):
        assert seen.setdefault(w.text(i), h[i]) == h[i]
    assert len(set(seen.values())) == len(seen)


def test_quality_rules_counts(spark, texts):
    got = {r["doc_id"]: r for r in rules.judge(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k for j, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_clashing_names_dont_matter(spark, texts):
    d = docs_of(spark, texts[:30]).selectExpr("doc_id", "text", "doc_id n_words", "'x' _w", "doc_id row", "doc_id t", "doc_id `a.b`")
    plain = {r["doc_id"]: r for r in rules.judge(docs_of(spark, texts[:30])).collect()}
    for r in rules.judge(d).collect():
        assert r["row"] == r["t"] == r["a.b"] == r["doc_id"] and r["_w"] == "x"
        assert all(r[c] == plain[r["doc_id"]][c] for c in ("n_words", "n_repeat_words", "kept", "failed_rules"))
    items = spark.createDataFrame([(5 + k % 3, k, -k, k, k) for k in range(40)], "length long, _salt long, row long, salt long, offset long")
    got = packing.pack(items, 32).collect()
    assert sorted(r["_salt"] for r in got) == list(range(40)) and all(r["row"] == -r["_salt"] and r["salt"] == r["_salt"] for r in got)
    assert rules.judge(d.limit(0)).count() == packing.pack(items.limit(0), 32).count() == 0


def test_quality_rules_are_native(spark, texts):
    plan = rules.judge(docs_of(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination_against_brute_force(spark, texts, block):
    long = next(t for t in texts if t and len(words_of(t)) > 60)
    w = words_of(long)
    bench = [(1, " ".join(w[5:30])), (2, " ".join(w[5:30])), (3, "One, TWO"), (4, None), (5, ""), (6, "never seen anywhere at all in any text of these ten words")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.find(docs_of(spark, texts), b, item_chars=block).collect()}
    for i, t in enumerate(texts):
        d = words_of(t)
        hit, items = set(), set()
        for k, x in bench:
            x = words_of(x)
            n = min(10, len(x))
            for a in range(len(x) - n + 1 if n else 0):
                for p in range(len(d) - n + 1):
                    if d[p : p + n] == x[a : a + n]:
                        hit |= set(range(p, p + n))
                        items.add(k)
        assert (got[i]["n_words"], sum(s["words"] for s in got[i]["spans"]), list(got[i]["items"])) == (len(d), len(hit), sorted(items))
    kept = {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs_of(spark, texts), b).collect()}
    assert 4 not in kept and 5 not in kept and kept[0] is None and kept[2] == " "
    assert not any("one two" in (x or "") for k, x in kept.items())
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs_of(spark, texts), none, "document").count() == len(texts)


def test_decontamination_is_alike_in_any_number_of_blocks(spark, texts):
    w = words_of(texts[15])
    b = spark.createDataFrame([(k, " ".join(w[3 * k : 3 * k + 14])) for k in range(12)] + [(99, "one two")], "item_id long, text string")
    rows = [(1, " ".join(w[:30])), (1, "x " + " ".join(w[10:40])), (2, " ".join(w[5:20])), (2, " ".join(w[5:20])), (None, "a one two b"), (None, None), (3, "")]
    d = spark.createDataFrame([(i, t, k, "x", True, -k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _key int, _bits string, _maybe boolean, u int")
    plain = lambda df: sorted((str(r) for r in df.collect()))
    one, many = (plain(decontam.find(d, b, item_chars=k)) for k in (1 << 20, 40))
    assert one == many and len(one) == len(rows)
    for mode in ("span", "document"):
        one, many = (decontam.decontaminate(d, b, mode, item_chars=k) for k in (1 << 20, 40))
        assert plain(one) == plain(many) and one.columns == d.columns
        assert all(r["u"] == -r["_key"] and r["_bits"] == "x" and r["_maybe"] for r in one.collect())
    assert sorted(r["_key"] for r in decontam.decontaminate(d, b, "document").collect()) == [5, 6]
    assert decontam.find(d.limit(0), b).count() == decontam.decontaminate(d.limit(0), b).count() == 0


def test_licenses(spark):
    cases = ["Released under the MIT License.", "GNU General Public License, version 3 or later", "CC BY-SA 4.0", "cc; by the way", "nothing here", None, "", "Apache\nLicense, Version 2.0", "SPDX-License-Identifier: GPL-2.0-only"]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, cases)).collect()}
    label = lambda i: {d["label"] for d in got[i]["detections"]}
    assert label(0) == {"mit"} and label(1) == {"gpl-3.0"} and label(2) == {"cc-by-sa-4.0"} and label(4) == label(5) == set()
    assert [p["label"] for p in got[3]["places"]] == ["cc-by"] and [p["label"] for p in got[7]["places"]] == ["apache"] and label(8) == {"gpl-2.0"}
    names = [s.name for s in licenses.signatures()]
    assert len(names) == len(set(names)) > 300
    for s in licenses.signatures():
        assert re.compile(s.pattern)
    spans = licenses.detect("this is licensed under the apache license, version 2.0 and the mit license")
    assert not any(a <= x and y <= b and (a, b) != (x, y) for a, b, *_ in spans for x, y, *_ in spans)


def test_license_gates_hold_for_every_name(spark):
    forms = [(label, n.replace("[sc]", c)) for label, names, *_ in licenses.FAMILIES for n in names if "(?:" not in n for c in "sc"]
    forms += [(label, x) for label, x in (("bsd-2-clause", "two-clause bsd license"), ("bsd-2-clause", "bsd 2-clause"), ("bsd-3-clause", "new bsd licence"), ("bsd-3-clause", "bsd 3-clause license"))]
    for _, form in forms:
        for s in licenses.signatures():
            if re.search(s.pattern, form):
                assert any(k in form for k in s.keyword.split("|")), (s.name, s.keyword, form)
    got = {r["doc_id"]: {d["label"] for d in r["detections"]} for r in licenses.scan(docs_of(spark, [f"Some text. {f.title()}, and more." for _, f in forms])).collect()}
    everything = list(range(len(licenses.signatures())))
    for i, (_, form) in enumerate(forms):
        assert got[i] == {d[3] for d in licenses.detect(f"some text. {form}, and more.", everything)}, form
    assert all(got[i] for i in got) and {"cc0"} == got[forms.index(("cc0", "creative commons zero"))]
    assert {"wtfpl"} == got[forms.index(("wtfpl", "do what the fuck you want to public license"))]


def regex_samples(pattern):
    """Texts that a pattern matches: each branch once, the fewest and one more of each repeat."""
    from re import _parser as parser

    def walk(seq):
        out = [""]
        for op, arg in seq:
            name = str(op)
            if name == "LITERAL":
                some = [chr(arg)]
            elif name == "IN":
                kind, first = str(arg[0][0]), arg[0][1]
                some = [{"CATEGORY_SPACE": " ", "CATEGORY_DIGIT": "3", "CATEGORY_WORD": "w", "CATEGORY_NOT_WORD": '"'}.get(str(first), "") if kind == "CATEGORY" else chr(first[0]) if kind == "RANGE" else "0" if kind == "NEGATE" else chr(first)]
            elif name in ("ANY", "NOT_LITERAL"):
                some = ["x"]
            elif name == "BRANCH":
                some = [x for b in arg[1] for x in walk(b)]
            elif name == "SUBPATTERN":
                some = walk(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, body = arg
                some = ["".join(walk(body)[:1] * low)] + [x for x in walk(body) if high > low for x in [x * (low + (low == 0))]]
            else:
                some = [""]
            out = [a + b for a in out for b in some][:400]
        return out

    return walk(parser.parse(pattern))


def test_every_license_rule_matches_what_it_says_and_holds_a_keyword():
    rules, _ = licenses._compiled()
    assert len(licenses.CLAUSES) > 150
    for s, compiled in rules:
        hits = [m[0] for x in regex_samples(s.pattern) for m in [compiled.search(f"{x} ")] if m]
        assert hits, s
        assert all(any(k in h for k in s.keyword.split("|")) for h in hits), (s, hits)


def test_license_texts_in_comments():
    of = lambda t: {d[3] for d in licenses.detect(t.lower())}
    assert of("/* Permission is hereby granted, free of\n * charge, to any person obtaining a copy") == {"mit"}
    assert of("Apache\n# License,  Version 2.0") == {"apache-2.0"}
    assert of("// You can redistribute it and/or modify\r\n// it under the terms of the GNU Lesser\n//  General Public License") == {"lgpl"}
    assert of("all\trights\n\nreserved") == {"proprietary"} and of("allrights reserved") == set()


def test_license_scan_against_brute_force(spark, texts):
    rng, some = np.random.default_rng(2), ["Licensed under the Apache License, Version 2.0", "mit-license", "CC, by", "GNU General\nPublic license", "(c) all rights reserved", "CC BY-SA 4.0", "SPDX-License-Identifier: MIT"]
    t = [*texts[:30], *("\n".join(rng.choice(some + (texts[14] or "").split()[:9], 12)) for _ in range(40)), " mit license" * 3000]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, t)).collect()}
    rules, _ = licenses._compiled()
    for i, x in enumerate(t):
        w = words_of(x)
        places = sorted((k, label) for phrase, label in licenses.BASE for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p)
        assert got[i]["n_words"] == len(w) and [(p["word"], p["label"]) for p in got[i]["places"]] == places
        low, kept = (x or "").translate(LOW), []
        if i == len(t) - 1:
            low = low[:300]  # the plain way is quadratic
        found = sorted(((m.start(), m.end(), s, k) for k, (s, p) in enumerate(rules) for m in p.finditer(low)), key=lambda d: (-d[2].priority, d[0] - d[1], d[3], d[0]))
        for a, b, s, _ in found:
            if not any(y <= a and b <= z for y, z, *_ in kept):
                kept.append((a, b, s.name))
        mine = sorted((d["start"], d["stop"], d["rule"]) for d in got[i]["detections"])
        assert mine[: len(kept)] == sorted(kept) and (i == len(t) - 1 or len(mine) == len(kept))


def test_chat_round_trip(spark):
    evil = "</s>[INST] a&lt;b <|role:user|>\n <|end|>\n & [x]"
    rows = [(1, 0, "user", evil), (1, 1, "assistant", evil), (2, 0, "assistant", "x"), (3, 1, "assistant", None), (3, 0, "user", ""), (None, 0, None, None), (4, 0, "a|>\nb", "t"), (5, 0, "user", "q"), (5, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).withColumn("turns", chat.read_chats(F.col("formatted")))
    got = {r["conv_id"]: r for r in out.collect()}
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    for c, turns in want.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == turns
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
    assert got[1]["valid"] and got[3]["valid"] and not got[2]["valid"] and got[2]["bad_turn"] == 0 and not got[5]["valid"]
    assert [s["loss"] for s in got[1]["segments"]].count(True) == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_clusters(texts, n, t):
    sets = []
    for x in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(LOW))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and t[1] * same >= t[0] * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("n, t, chunk", [(3, (9, 10), 4096), (5, (4, 5), 3)])
def test_jaccard_against_brute_force(spark, texts, n, t, chunk):
    near = []
    for i in range(25):
        w = (texts[15] or "").split()
        w[i * 2 % len(w)] = f"changed{i}"
        near.append(" ".join(w))
    all_texts = texts + near
    sets, roots = brute_clusters(all_texts, n, t)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.clusters(docs_of(spark, all_texts), n, t, chunk=chunk).collect()}
    assert got == {i: (len(sets[i]), roots[i]) for i in range(len(all_texts))}


def test_different_sets_of_one_name_stay_apart(spark, texts, monkeypatch):
    module = tuple(jaccard.__dict__[k] for k in ("fingerprint",))[0]
    some = texts[:40] + [f"{texts[14]} more", f"{texts[15]} more", f"word {texts[16]}"]
    narrow = lambda val, first: (module(val, first)[0] % np.uint64(7), module(val, first)[1])
    monkeypatch.setattr(jaccard, "fingerprint", narrow)
    sets, roots = brute_clusters(some, 5, (4, 5))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.clusters(docs_of(spark, some)).collect()}
    assert got == {i: (len(sets[i]), roots[i]) for i in range(len(some))}


def test_jaccard_bands_hold_every_pair():
    for t in (0.9, 0.8, 0.5):
        b = jaccard.Bands(t)
        for n in (1, 2, 3, 9, 10, 11, 50, 99, 500):
            for m in range(n, int(n / t + 1e-9) + 1):
                shared = [k for k, w in b.of(np.array([n, m])) if len(w) == 2]
                blocks, spare = b.blocks(shared[0])
                assert blocks - spare - 1 >= n + m - 2 * -(-int(t * (n + m) * 1000) // int((1 + t) * 1000)) - 1


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    sets = []
    for size in (20, 100, 400, 70):
        core = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for k in range(12):
            sets.append(np.unique(np.concatenate([core[k // 2 :], rng.integers(0, 1 << 63, k, dtype=np.uint64)])))
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    flat, at = jaccard.sketches(np.concatenate(sets), first)
    sk = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    for i in range(len(sets)):
        for j in range(i):
            assert jaccard.apart(sk[i], sk[j]) <= len(np.setxor1d(sets[i], sets[j]))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in jaccard.near(sk, np.array([len(s) for s in sets]), 4, 5):
        root[find(u)] = find(v)
    exact = jaccard.verify(sets, 4, 5)
    assert all(find(i) == find(int(exact[i])) for i in range(len(sets)))


def test_linked_sets_share_sent_blocks():
    rng = np.random.default_rng(11)
    for t_num, t_den in ((9, 10), (4, 5), (1, 2)):
        bands, sets = jaccard.Bands(t_num / t_den), []
        for size in (1, 2, 4, 5, 9, 10, 11, 40, 100, 300, 900):
            core = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            most = int(bands.differ(size))
            for gone in sorted({0, 1, most // 2, most}):
                for more in sorted({0, 1, most - gone, most}):
                    sets.append(np.unique(np.concatenate([core[gone:], rng.integers(0, 1 << 63, max(0, more), dtype=np.uint64)])))
        sets = [x for x in sets if len(x)]
        first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        rec, need = jaccard.block_keys(np.concatenate(sets), first, np.arange(len(sets), dtype=np.uint64), bands)
        keys = [set(rec["key"][rec["node"] == i].tolist()) for i in range(len(sets))]
        linked = 0
        for i in range(len(sets)):
            for j in range(i):
                same = len(np.intersect1d(sets[i], sets[j]))
                if same and t_den * same >= t_num * (len(sets[i]) + len(sets[j]) - same):
                    linked += 1
                    assert len(keys[i] & keys[j]) >= max(need[i], need[j]) >= 1
        assert linked > len(sets)


def test_common_shingles_alone_bring_no_meetings():
    def meet(n):
        rng = np.random.default_rng(5)
        common = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(common, 20, replace=False), rng.integers(0, 1 << 63, 230, dtype=np.uint64)])) for _ in range(n)]
        first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        rec, _ = jaccard.block_keys(np.concatenate(sets), first, np.arange(n, dtype=np.uint64), jaccard.Bands(0.8))
        return sum(b.num_rows for b in jaccard.meetings(rec))

    assert meet(2000) < 200  # two sets share a shingle or so, and no more


def test_block_meetings_lose_no_pair():
    rec = np.array([(1, 5), (1, 6), (1, 6), (2, 7), *[(3, k) for k in range(20)]], jaccard.PAIR)
    rows = [r for b in jaccard.meetings(rec) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert (0, 5, 6, 1) in rows and sorted(a for k, a, *_ in rows if k) == list(range(20)) and len(rows) == 21
    twice = np.concatenate([rec, np.array([(4, k) for k in range(20)], jaccard.PAIR)])  # a second block of the same nodes
    assert sum(b.num_rows for b in jaccard.meetings(twice)) == 21


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


def test_deduplicate_keeps_one(spark, texts):
    d = docs_of(spark, texts).unionByName(docs_of(spark, texts[:12])).unionByName(spark.createDataFrame([(None, "no id", "en", "s", 5)], SCHEMA))
    _, roots = brute_clusters(texts, 5, (4, 5))
    kept = [r["doc_id"] for r in jaccard.deduplicate(d).collect()]
    assert sorted(kept, key=str) == sorted([*(i for i in range(len(texts)) if roots[i] == i), None], key=str)


def test_repeated_ids_are_documents_of_their_own(spark, texts):
    a, b, c = (f"{x} " + (texts[k] or "") for x, k in (("a", 14), ("b", 15), ("c", 16)))
    rows = [(3, a), (7, a), (7, b), (8, c), (5, a), (5, b), (6, b + " more"), (None, c), (None, c + " end"), (9, ""), (9, ""), (9, None), (None, ""), (None, None), (4, c), (4, c)]
    d = spark.createDataFrame([(i, t, k, "x", -k, 0, "y") for k, (i, t) in enumerate(rows)], "doc_id long, text string, _gone int, _again string, u int, row int, _maybe string")
    _, root = brute_clusters([t for _, t in rows], 5, (4, 5))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard.clusters(d).collect())
    assert got == Counter((i, least.get(root[k]) if (t or "").strip() else i) for k, (i, t) in enumerate(rows))
    out = jaccard.deduplicate(d)
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == d.columns and all(rows[r["_gone"]] == (r["doc_id"], r["text"]) and r["u"] == -r["_gone"] for r in out.collect())
    assert Counter(kept) == Counter([(3, a), (5, b), (4, c), (9, ""), (None, ""), (None, None)]) or Counter(kept) == Counter([(3, a), (5, b), (4, c), (9, None), (None, ""), (None, None)])
    assert jaccard.deduplicate(d.limit(0)).count() == jaccard.clusters(d.limit(0)).count() == 0


def test_long_chains_end(spark):
    n = 300  # a chain takes the most rounds
    e = spark.createDataFrame([((k * 37) % n, ((k + 1) * 37) % n) for k in range(n - 1)], "a long, b long")
    assert {r["root"] for r in graph.components(e).collect()} == {0}


def brute_spans(texts, size):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + size] for b in raw for p in range(len(b) - size + 1))
    out = []
    for b in raw:
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                cover[p] += 1
                cover[p + size] -= 1
        out.append(np.cumsum(cover)[: len(b)] > 0)
    return raw, out


def test_suffix_dedup_against_brute_force(spark, texts):
    tricky = [texts[14][:900] + "é" + texts[15][100:700], "xé" + texts[14][200:800], texts[15], "ab" * 700, "z" * 199, "z" * 200, "q" * 201]
    t = [*texts[:40], *tricky, tricky[0]]
    raw, cover = brute_spans(t, suffix.SIZE)
    got = {r["doc_id"]: r for r in suffix.digests(docs_of(spark, t)).collect()}
    for i, (b, c) in enumerate(zip(raw, cover, strict=True)):
        starts = int((c & ~np.concatenate([[False], c[:-1]])).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~c].tobytes() if b else b""
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(c.sum()), starts, hashlib.sha256(kept).hexdigest())
    out = suffix.deduplicate(docs_of(spark, t))
    assert out.columns == docs_of(spark, t).columns
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert left[0] is None and left[1] == "" and left[40 + 4] == "z" * 199 and "�" not in "".join(x or "" for x in left.values())


def test_very_long_text_in_stretches(monkeypatch):
    rng = np.random.default_rng(0)
    d = rng.integers(97, 100, 20_000).astype(np.uint8)
    off = np.array([0, 100, 100, 8000, 20_000])
    flat = lambda r: sorted((int(t), int(p) + i, int(k)) for k, c, t, p, n, a in zip(*r, strict=True) for i in range(n))
    a = flat(suffix.runs(d, off))
    monkeypatch.setattr(suffix, "MOST", 3000)
    assert flat(suffix.runs(d, off)) == a and len(a) == 7900 - 199 + 12_000 - 199


def test_tokens_are_the_tokenizers(texts):
    odd = ["it's <|endoftext|> don't", "naïve CAFÉ Œuvre", "日本語 text", "tab\tnew\nline", "a b\x85c", "ΑΣ", "١٢٣ 12 ½", "", "...!!!", "x" * 500, "\x1c\x1f"]
    v = tokens.Vocabulary(tokenizer_path())
    all_texts = [t or "" for t in texts] + odd
    for _ in range(2):  # with an empty and with a filled table
        ids, off = v.batch(all_texts, 1)
        want = v.tok.encode_batch(all_texts, add_special_tokens=False)
        for i, e in enumerate(want):
            assert ids[off[i] : off[i + 1]].tolist() == [*e.ids, 1], all_texts[i]


def test_packing(spark, texts):
    got = packing.pack_documents(docs_of(spark, texts), tokenizer_path(), 128).toPandas()
    v = tokens.Vocabulary(tokenizer_path())
    ids, off = v.batch([t or "" for t in texts], 1)
    want = set()
    for i in range(len(texts)):
        x = ids[off[i] : off[i + 1]].astype("<u4")
        want |= {(i, k // 128, k, len(x[k : k + 128]), zlib.crc32(x[k : k + 128].tobytes())) for k in range(0, len(x), 128)}
    assert set(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want and len(got) == len(want)
    s = got.sort_values(["sequence_id", "offset"])
    assert ((s.groupby("sequence_id").length.cumsum() - s.length) == s.offset).all()
    fill = s.groupby("sequence_id").length.sum()
    assert fill.max() <= 128 and len(fill) <= 1.02 * sum(fill) / 128 + 2
    assert packing.pack_documents(docs_of(spark, texts).limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4096, np.exp(rng.normal(6 + seed / 2, 0.8, 3000)).astype(int) + 1)
    counts = Counter(lengths.tolist())
    held = Counter()
    plan = packing.plan(counts)
    for contents, many in plan:
        assert sum(x * k for x, k in contents) <= 4096
        for x, k in contents:
            held[x] += k * many
    assert held == counts
    assert sum(m for _, m in plan) <= sum(m for _, m in packing.best_fit([], counts, 4096))


def test_configurations_solve_a_small_program():
    got = packing.configurations([60, 40, 30], [10, 10, 20], 100)
    assert all((c * [60, 40, 30]).sum() <= 100 for c, _ in got) and sum(n for _, n in got) <= 16


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 1200
    pages = [(1, "http://a.example.com/x?y#z", big), (2, "https://www.b.org:8080/", big), (9, None, big), (3, "nonsense \n url", "short"), (4, "http://a.example.com/x?y", "short"), (5, "http://c.net", None), (None, "http://d.net/", big), (9, "http://again.net/", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    lines, directory = warc.archive(spark, df)
    got = warc.read(warc.captures(directory), True).collect()
    assert len(got) == len(pages) and Counter(r["page_id"] for r in got) == Counter(p[0] for p in pages)
    for r in got:
        body = (next(h for i, u, h in pages if i == r["page_id"]) or "").encode()
        assert r["digest"] == hashlib.sha1(body).hexdigest() and r["size"] == len(body)
        revisit = len(body) >= 1000 and r["page_id"] != 9
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if revisit else ("response", None))
        assert r["payload"] is None if revisit else bytes(r["payload"]) == body
    found = warc.Directory(directory).find("http://A.example.com/x?y")
    assert sorted(f["page_id"] for f in found) == [1, 4]
    asked = spark.createDataFrame([("http://c.net",), ("http://none.example",)], "url string")
    assert [r["page_id"] for r in warc.lookup(asked, directory).collect()] == [5]
    everything = sorted(map(str, warc.captures(directory).collect()))
    assert sorted(map(str, warc.lookup(df.select("url"), directory).collect())) == everything and len(everything) == len(pages)
    assert warc.key_of("https://User@WWW.b.org:8080/p") == "org,b,www:8080)/p"
    _, empty = warc.archive(spark, df.limit(0))
    assert warc.read(warc.captures(empty)).count() == 0 == warc.lookup(df.select("url"), empty).count()


def test_warc_hot_key_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    rows = [(i, f"http://h{i % 3}.org/" if i % 5 else "http://hot.org/", f"p{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    lines = warc.write(df, warc.fresh_path(spark, "hot"))
    directory = warc.index(lines, warc.fresh_path(spark, "hot"), 7)
    assert directory.count() > 40
    asked = spark.createDataFrame([("http://hot.org/",), ("http://h1.org/",), ("http://hot.org",), ("http://zzz.org",)], "url string")
    want = sorted(i for i, u, _ in rows if u in ("http://hot.org/", "http://h1.org/"))
    assert sorted(r["page_id"] for r in warc.lookup(asked, directory).collect()) == want
    assert sorted(r["page_id"] for r in warc.Directory(directory).find("http://hot.org/")) == [i for i in range(300) if i % 5 == 0]


def labelled(spark, small):
    return spark.read.parquet(f"{os.path.dirname(small)}/sf0.01/documents.parquet"), spark.read.parquet(f"{os.path.dirname(small)}/sf0.01/labels.parquet")


def accuracy(scored, labels, label, threshold):
    j = scored.join(labels, "doc_id").where(F.col(label).isNotNull()).toPandas()
    return ((j.score >= threshold).astype(int) == j[label]).mean()


def test_quality_on_held_out_rows(spark, small, monkeypatch):
    docs, labels = labelled(spark, small)
    even = F.crc32(F.col("id").cast("string")) % 4 != 2
    trained = quality.train(docs, labels, even)
    scored = quality.score(docs, trained).cache()
    monkeypatch.setattr(quality, "BROADCAST_LABELS", 0)  # labels joined by a shuffle
    again = quality.train(docs.orderBy("doc_id"), labels, even)
    assert np.allclose(trained[0].emit, again[0].emit, atol=1e-2) and abs(trained[1] - again[1]) < 0.1
    held = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    assert accuracy(scored, held, "quality", 0.7) > 0.95 and scored.count() == docs.count()


def test_toxicity_on_held_out_rows(spark, small):
    docs, labels = labelled(spark, small)
    r = F.crc32(F.col("id").cast("string")) % 5
    trained = toxicity.train(docs, labels, r >= 2, r == 1)
    held = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    assert accuracy(toxicity.score(docs, trained), held, "toxic", 0.5) > 0.9
    kept = toxicity.reject(docs.withColumn("n_words", F.lit(1)), trained)
    assert kept.columns == [*docs.columns, "n_words"] and 0.75 * docs.count() < kept.count() < docs.count()


def brute_ratios(counted, asked, d=toxicity.DISCOUNT):
    """Log-ratio of each asked word from dictionaries: words are followed by a zero byte, prefixes are all kept."""
    n, follow = defaultdict(lambda: defaultdict(lambda: [0, 0])), Counter()
    for w, y in counted:
        w = w.encode() + b"\0"
        for i in range(len(w)):
            n[w[:i]][w[i]][y] += 1
    last = lambda h: (b"\1\1" + h)[-2:]
    for h, nexts in n.items():
        follow.update((last(h), b) for b in nexts)
    total = Counter()
    for (h, _), c in follow.items():
        total[h] += c
    out = {}
    for x in set(asked):
        w, r = x.encode() + b"\0", 0.0
        for i in range(len(w)):
            h, b = w[:i], w[i]
            if h not in n:
                break
            both = lambda k: (sum(k),)
            p, below = [], (follow[last(h), b] + 0.1) / (total[last(h)] + 25.6)
            for pick in (both, lambda k: k[:1], lambda k: k[1:]):
                c = {k: pick(v)[0] for k, v in n[h].items()}
                m, types = sum(c.values()), sum(v > 0 for v in c.values())
                p.append(max(c.get(b, 0) - d, 0) / m + d * types / m * below if m else below)
                below = p[0]
            r += np.log(p[2]) - np.log(p[1])
        out[x] = r
    return out


def toxicity_case(spark, rows, asked):
    """The length-normalised gain of texts by the operator and by brute force."""
    train = spark.createDataFrame([(t, 1 - y, y) for t, y in rows], "text string, c0 int, c1 int").repartition(3)
    model = toxicity.build(*toxicity.count(train, ["c0", "c1"]))
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["gain"] for r in toxicity.features(docs, model, ("doc_id",)).collect()}
    want = brute_ratios([(w, y) for t, y in rows for w in words_of(t)], [w for t in asked for w in words_of(t)])
    gain = lambda r: math.log(1 - toxicity.RARE + toxicity.RARE * math.exp(r))
    return got, {i: np.mean([gain(want[w]) for w in words_of(t)] or [0]) for i, t in enumerate(asked)}


def test_toxicity_keeps_rare_prefixes(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 6)))
    rows = [(" ".join(word() for _ in range(30)), int(i % 3 == 0)) for i in range(40)] + [("vermin abc", 1), ("gentle abc", 0)]
    got, want = toxicity_case(spark, rows, ["vermin", "gentle", "vermins", "verb", "zz", "", *(t for t, _ in rows[:5]), *(word() + word() for _ in range(50))])
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 + 1e-4 * abs(want[i]) for i in got)
    assert got[0] > got[2] > 0 > got[1] and got[5] == 0  # a word of one row, and its unseen continuation


def test_toxicity_reads_words_to_their_end(spark):
    stem, cyrillic = "verallgemeinerungs", "недоброжелатель"
    rows = [(f"{stem}trottel {cyrillic}ница vermin", 1), (f"{stem}freund {cyrillic}ство friend", 0)] * 4 + [("她是害虫吗", 1), ("她是朋友吗", 0)] * 4
    train = spark.createDataFrame([(t, 1 - y, y) for t, y in rows], "text string, c0 int, c1 int")
    model = toxicity.build(*toxicity.count(train, ["c0", "c1"]))
    pairs = [(f"{stem}trottel", f"{stem}freund"), (f"{cyrillic}ница", f"{cyrillic}ство"), ("something—vermin", "something—friend"), ("what\u00a0vermin…", "what\u00a0friend…"), ("我说害虫呢", "我说朋友呢")]
    docs = spark.createDataFrame([(i, x) for i, p in enumerate(pairs) for x in p], "doc_id int, text string")
    got = defaultdict(list)
    for r in toxicity.features(docs.coalesce(1), model, ("doc_id", "text")).collect():
        got[r["doc_id"]].append((r["text"] == pairs[r["doc_id"]][0], r["gain"]))
    for i in range(len(pairs)):
        (_, good), (_, bad) = sorted(got[i])
        assert bad > good + toxicity.RARE, (pairs[i], bad, good)
    data, off = textkernel.raw(pa.array(["a—b 害虫x", "虫€c", ""]))
    w = toxicity._found(data, off)
    assert [w.text(i).decode() for i in range(len(w.start))] == ["a", "b", "害虫", "虫", "x", "虫€", "€", "c"] and w.first.tolist() == [0, 5, 8, 8]


def test_toxicity_counts_calibration_rows_too(spark, monkeypatch):
    rows = [(f"quiet lines of text number{i} " + ("filth" if i % 2 else "plain") + (" vermin" * (i % 2) if i % 3 == 1 else ""), i % 2) for i in range(60)]
    docs = docs_of(spark, [t for t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    r = F.col("id") % 3
    probe = spark.createDataFrame([(0, "vermin")], "doc_id int, text string")
    gain = lambda trained, full: toxicity.features(probe, trained[0], ("doc_id",), full).first()["gain"]
    trained = toxicity.train(docs, labels, r != 1, r == 1)  # only rows of remainder 1 have the word
    got = gain(trained, True)
    assert got > 0 and got > gain(trained, False) + 0.001
    ratio = brute_ratios([(w, y) for t, y in rows for w in words_of(t)], ["vermin"])["vermin"]
    assert abs(got - toxicity.gained(np.array([ratio]))[0]) < 1e-4 * got
    monkeypatch.setattr(toxicity, "CALIBRATION", 5)  # rows beyond the sample are counted
    assert gain(toxicity.train(docs, labels, r != 1, r == 1), False) > 0.001
    monkeypatch.setattr(toxicity, "CALIBRATION", 20_000)
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)  # labels joined by a shuffle
    assert abs(gain(toxicity.train(docs, labels, r != 1, r == 1), True) - got) < 1e-9


def test_toxicity_groups_dont_follow_batches(monkeypatch):
    monkeypatch.setattr(toxicity, "GROUP", 500)
    monkeypatch.setattr(toxicity, "LOOK", 60)
    monkeypatch.setattr(toxicity, "LOOK_ROWS", 5)
    rng = np.random.default_rng(1)
    texts = [None if k % 17 == 0 else "x" * int(rng.integers(0, 90)) + str(k) for k in range(400)]
    table = pa.table({"id": list(range(400)), "text": texts})
    runs = []
    for rows in (1, 7, 400):
        got = [(name, i) for name, part in toxicity._grouped(iter(table.to_batches(max_chunksize=rows)), "text") for i in part.column(0).to_pylist()]
        runs.append(got)
    assert runs[0] == runs[1] == runs[2] and [i for _, i in runs[0]] == list(range(400)) and 20 < len({n for n, _ in runs[0]}) < 60


def test_classifiers_without_labels_or_texts(spark, texts):
    d = docs_of(spark, texts)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(d, none, F.lit(True)) is None and toxicity.train(d, none, F.lit(True), F.lit(True)) is None
    assert {r["score"] for r in quality.score(d, None).collect()} == {0.5} and toxicity.reject(d, None).count() == len(texts)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(20, 60)], "doc_id long, quality int, toxic int")
    out = quality.score(d, quality.train(d, labels, F.lit(True))).collect()
    assert len(out) == len(texts) and all(0 <= r["score"] <= 1 for r in out)


def test_long_chains_and_scores_by_column(texts, monkeypatch):
    rng = np.random.default_rng(7)
    some = [t or "" for t in texts[:40]] + ["\n" * 3000 + "end", "a\n\nb"]
    data, off = textkernel.raw(pa.array([t for t in some]))
    f = quality.Field(rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2)))
    x, size, first = quality.line_features(data, off)
    y, size2, first2 = quality.line_scores(data, off, f.emit)
    assert np.allclose(x @ f.emit, y, atol=1e-4) and (size == size2).all() and (first == first2).all()
    assert np.diff(first).tolist() == [t.count("\n") + 1 for t in some]
    want = f.marginals(y, first)
    monkeypatch.setattr(quality, "LONG", 2)
    assert np.allclose(f.marginals(y, first), want, atol=1e-9)


def test_a_very_long_text_of_line_ends():
    data, off = np.full(3_000_000, 10, np.uint8), np.array([0, 3_000_000])
    f = quality.Field(np.ones(quality.WIDTH) / 9, np.array([[1.0, -1], [-1, 1]]))
    y, size, first = quality.line_scores(data, off, f.emit)
    assert len(y) == 3_000_001 and 0 <= quality.good_share(f.marginals(y, first), size, first)[0] <= 1


def test_crf_marginals_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(5)
    x, first = rng.normal(size=(6, 3)), np.array([0, 4, 5, 6])
    f = quality.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
    want = np.zeros(6)
    for a, b in zip(first[:-1], first[1:], strict=True):
        total = 0.0
        for y in product((0, 1), repeat=b - a):
            w = np.exp(sum(y[k] * (x[a + k] @ f.emit) for k in range(b - a)) + sum(f.trans[y[k - 1], y[k]] for k in range(1, b - a)))
            total += w
            want[a:b] += w * np.array(y)
        want[a:b] /= total
    assert np.allclose(f.marginals(x, first), want)
