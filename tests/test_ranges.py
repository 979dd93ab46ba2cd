"""Numbers, sums and fills by sampled ranges are those of one ordered pass, however many ranges there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motiflake.operators import inherit, ranges
from motiflake.sources import reads, trf


@pytest.fixture(params=[200_000, 40])
def size(request, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", request.param)
    return request.param


def test_numbered_accumulated_filled(spark, size):
    rng = np.random.default_rng(1)
    rows = [(f"k{int(rng.integers(3))}", int(x), int(rng.integers(9))) for x in rng.permutation(3000)]
    df = spark.createDataFrame(rows, "a string, b long, v int").repartition(7)
    order = sorted(rows)
    assert [(r["a"], r["b"]) for r in sorted(ranges.numbered(df, ["a", "b"]).collect(), key=lambda r: r["line"])] == [r[:2] for r in order]
    sums = {(r["a"], r["b"]): r["s"] for r in ranges.accumulated(df, ["a", "b"], F.col("v"), "s").collect()}
    total = 0
    for r in order:
        assert sums[r[:2]] == total
        total += r[2]
    last, got = None, {(r["a"], r["b"]): r["f"] for r in ranges.filled(df, ["a", "b"], F.when(F.col("b") % 500 == 0, F.col("b")), "f").collect()}
    for r in order:
        last = str(r[1]) if r[1] % 500 == 0 else last
        assert got[r[:2]] == last
    assert ranges.numbered(df.limit(0), ["a", "b"]).count() == 0


def test_long_files(spark, size):
    rng = np.random.default_rng(2)
    contigs = {f"c{k}": "".join(rng.choice(list("ACGT"), int(rng.integers(1, 4000)))) for k in range(9)}
    fasta = [x for c, s in contigs.items() for x in [f">{c} words", *(s[i : i + 13] for i in range(0, len(s), 13))]]
    lines = spark.createDataFrame(list(enumerate(fasta)), "line long, value string").repartition(5)
    got = {}
    for r in sorted(reads.fasta_chunks(lines, 100).collect(), key=lambda r: (r["contig"], r["chunk"])):
        got[r["contig"]] = got.get(r["contig"], "") + r["seq"]
    assert got == contigs
    dat = [x for k in range(30) for x in [f"Sequence: chr{k}", "", *(f"{10 * i + 1} {10 * i + 9} 2 4.0 2 90 0 40 30 20 30 20 1.9 AT ATAT" for i in range(k % 7))]]
    found = trf.parse(spark.createDataFrame(list(enumerate(dat)), "line long, value string").repartition(3)).collect()
    assert sorted((r["cols"][0], int(r["cols"][1])) for r in found) == sorted((f"chr{k}", 10 * i) for k in range(30) for i in range(k % 7))


def test_parents_are_met_by_place(spark):
    call = "contig string, start long, end long, motif string, gt string"
    child = spark.createDataFrame([("a", 100, 130, "AT", "c1"), ("a", 500, 530, "GGC", "c2"), ("b", 5, 9, "AT", "c3")], call)
    mother = spark.createDataFrame([("a", 90, 101, "GGC", "m0"), ("a", 95, 140, "AT", "m1"), ("a", 505, 520, "GGC", "m2"), ("b", 9, 12, "AT", "m3")], call)
    father = spark.createDataFrame([("a", 129, 140, "AT", "f1"), ("a", 400, 501, "AT", "f2"), ("b", 1, 6, "AT", "f3")], call)
    got = lambda same: {(r["c_gt"], r["m_gt"], r["f_gt"]) for r in inherit.positional_trio(child, mother, father, same).collect()}
    assert got(False) == {("c1", "m0", "f1"), ("c2", "m2", "f2")} and got(True) == {("c1", "m1", "f1")}
