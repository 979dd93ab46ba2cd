"""Queries without SQL against plain Python over the same rows."""

import hashlib
import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from motiflake.kernels.consensus import consensus
from motiflake.operators import calling, stats
from motiflake.plans import kernels as plans
from motiflake.plans.fixtures import fixture
from motiflake.plans.queries import QUERIES
from motiflake.plans.stats import trio_reads


@pytest.fixture(scope="module")
def reads(spark, small):
    return [r.asDict() for r in fixture(spark, small, "reads").collect()]


def seeds(spark, ids):
    x = spark.createDataFrame([(i,) for i in ids], "locus_index long")
    return {r["locus_index"]: r["s"] for r in x.select("locus_index", F.pmod(F.xxhash64(F.lit(0), "locus_index"), F.lit(2**31 - 1)).cast("int").alias("s")).collect()}


def per_locus(rows, most=250):
    out = defaultdict(list)
    for r in rows:
        out[r["locus_index"]].append(r)
    return {k: sorted(v, key=lambda r: r["read_name"])[:most] for k, v in out.items()}


def by_hand(spark, rows, hp=False):
    groups = per_locus(rows)
    s = seeds(spark, groups)
    out = {}
    for k, v in groups.items():
        out[k] = calling.call_locus([r["cn"] for r in v], [r["w"] for r in v], [r["hp"] for r in v] if hp else None, [r["ps"] for r in v] if hp else [None] * len(v), None, None, 2, s[k])
    return out


def text(call):
    return ",".join(map(str, call["call"])) if call else None


def test_call_by_copies(spark, small, reads):
    want = by_hand(spark, [r for r in reads if r["smp"] == 0])
    got = {r["locus_index"]: r for r in QUERIES["m01_m06_m21_call_by_copies"](spark, small).collect()}
    assert got.keys() == want.keys() and any(want.values())
    for k, w in want.items():
        assert got[k]["call"] == (text(w) or None) and got[k]["method"] == (w["method"] if w else None)


def test_call_by_haplotype(spark, small, reads):
    want = by_hand(spark, [r | {"hp": r["p"], "ps": r["locus_index"] // 10} for r in reads], True)
    got = {r["locus_index"]: r for r in QUERIES["m09_call_by_haplotype"](spark, small).collect()}
    assert got.keys() == want.keys() and {w["method"] for w in want.values() if w} >= {"hp"}
    assert all(got[k]["call"] == text(w) and got[k]["method"] == (w["method"] if w else None) for k, w in want.items())
    for k, w in want.items():  # a haplotype's call lies among its reads
        if w and w["method"] == "hp":
            cn = sorted(r["cn"] for r in reads if r["locus_index"] == k)
            assert all(cn[0] <= c <= cn[-1] for c in w["call"])


def test_call_from_reads(spark, small, reads):
    """The chain from FASTA and SAM text gives the calls of the copies that its reads were made with."""
    rows = [r | {"w": None} for r in reads if r["smp"] == 0]
    got = {r["locus_index"]: r for r in QUERIES["m20_call_from_reads"](spark, small).collect()}
    groups = per_locus(rows)
    assert len(got) == fixture(spark, small, "loci").count()
    for k, r in got.items():
        cn = [x["cn"] for x in groups.get(k, [])]
        assert r["ref_cn"] == 8 + k % 5 and (r["depth"] or 0) == len(cn)
        assert (r["call"] is None) == (len(cn) < 4)
        if len(cn) >= 4:
            calls = list(map(int, r["call"].split(",")))
            assert calls == sorted(calls) and min(cn) <= calls[0] and calls[1] <= max(cn)
            assert len(set(cn)) > 1 or calls == [cn[0], cn[0]]


def test_calls_by_snvs_take_their_clusters(spark, small):
    got = QUERIES["m08_m10_call_by_snvs"](spark, small).collect()
    methods = {r["method"] for r in got}
    assert got and methods <= {"snv", "snv+dist", "dist", "single", None} and methods & {"snv", "snv+dist"}


def test_consensus(spark, small):
    rows = plans._sequences(spark, small).select("locus_index", "p", "seq").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["locus_index"], r["p"]].append(r["seq"])
    got = {(r["locus_index"], r["allele"]): (r["sequence"], r["method"]) for r in QUERIES["m17_consensus"](spark, small).collect()}
    assert got == {k: consensus(sorted(v)) for k, v in groups.items()} and {m for _, m in got.values()} == {"single", "poa"}
    assert all(m != "single" or len(set(groups[k])) == 1 for k, (_, m) in got.items())


def test_rephased_calls(spark, small):
    found = {(r["contig"], r["ps"]): r for r in QUERIES["m13_phase_components"](spark, small).collect()}
    loci = {r["locus_index"]: r for r in fixture(spark, small, "loci").collect()}
    got = QUERIES["m14_rephased_calls"](spark, small).collect()
    gt = {r["locus_index"]: r for r in fixture(spark, small, "gt").where("smp = 0").collect()}
    assert len(got) == len(gt)
    for r in got:
        k = r["locus_index"]
        c = found.get((loci[k]["contig"], k // 44))
        call = [gt[k]["a0"], gt[k]["a1"]]
        assert r["call"] == ",".join(map(str, call[::-1] if c and c["flip"] else call)) and r["ps"] == (c["root"] if c else k // 44)


@pytest.mark.parametrize("test", ["x2", "wmw", "wmw-gt"])
def test_de_novo(spark, small, test):
    rows = trio_reads(spark, small).collect()
    got = {r["locus_index"]: r for r in QUERIES[f"a17_f14_f15_de_novo_{test.replace('-', '_')}"](spark, small).collect()}
    for r in rows:
        p, config, source = stats.de_novo(r["c_reads"], r["m_reads"], r["f_reads"], test)
        g = got[r["locus_index"]]
        assert (g["config"], g["mutation_from"]) == (config, source) and (p is None or abs(g["p"] - p) < 1e-8)
        if test == "x2" and p is not None:  # of the four configurations the likeliest
            mine = [x for a in r["c_reads"] for x in a]
            each = [stats.chi2_test(*map(__import__("numpy").asarray, (mine, [*m, *f]))) for m in r["m_reads"] for f in r["f_reads"]]
            assert abs(max(each) - p) < 1e-12


def test_mi_json(spark, small):
    j = json.loads(QUERIES["k07_mi_json"](spark, small).first()["json"])
    t = fixture(spark, small, "trio").collect()
    strict = sum((r["c0"] in (r["m0"], r["m1"]) and r["c1"] in (r["f0"], r["f1"])) or (r["c0"] in (r["f0"], r["f1"]) and r["c1"] in (r["m0"], r["m1"])) for r in t) / len(t)
    se = (strict * (1 - strict) / len(t)) ** 0.5
    assert j["n_loci"] == len(t) and j["strict"]["val"] == pytest.approx(strict, abs=1e-6) and j["strict"]["stderr"] == pytest.approx(se, abs=1e-6)
    assert j["strict"]["ci"] == pytest.approx([strict - 1.96 * se, strict + 1.96 * se], abs=2e-6)


def test_catalog_hash(spark, small):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    each = defaultdict(list)
    for r in fixture(spark, small, "loci").collect():
        h = sha(f"{r['contig']}\t{r['start_pos']}\t{r['end_pos']}\t{r['motif']}")
        each[h[:2]].append(h)
    want = sha("".join(sha("".join(sorted(each[p]))) for p in sorted(each)))
    assert QUERIES["a19_a20_catalog_hash"](spark, small).first()["hash"] == want


def test_sub_seeds(spark, small):
    import xxhash

    for r in QUERIES["m22_sub_seeds"](spark, small).collect():
        h = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)
        h = xxhash.xxh64_intdigest(int(r["locus_index"]).to_bytes(8, "little"), h)
        h -= (h >= 1 << 63) << 64
        assert r["seed"] == h % 4096
