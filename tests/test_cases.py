"""Small cases with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motiflake.functions import scalars as S
from motiflake.kernels import align, cluster, consensus, em
from motiflake.operators import calling, inherit, intervals, phasing, stats
from motiflake.operators import catalog as K
from motiflake.params import CallParams, MiParams
from motiflake.sources import bed, callers, gff, ploidy, reads, trf


def lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line long, value string")


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("motif, ok", [("TTAGGG", True), ("RYSW", True), ("TTA1", False), ("TTA GGG", False), ("", False), ("ttaggg", False)])
def test_motifs(spark, motif, ok):
    assert one(spark, S.valid_motif(F.lit(motif))) is ok


@pytest.mark.parametrize("text, want", [("TTAGGG", ("locus7", "TTAGGG")), ("motif=GT", ("locus7", "GT")), ("MOTIF =GT; id= my_locus", ("my_locus", "GT")), ("Id=a-b;Motif=ggc", ("a-b", "GGC"))])
def test_last_column(spark, text, want):
    r = one(spark, bed.last_column(F.lit(text), F.lit(7)))
    assert (r["locus_id"], r["motif"], r["error"]) == (*want, None)


@pytest.mark.parametrize("text", ["ID=x1", "COLOR=red;MOTIF=GT", "MOTIF=", ""])
def test_bad_last_column(spark, text):
    assert one(spark, bed.last_column(F.lit(text), F.lit(0)))["error"]


def test_codes(spark):
    code = lambda *b: one(spark, S.code_of_bases(F.array(*map(F.lit, b))))
    assert (code("C", "G"), code("T", "G", "C"), code("C", "Q"), code("C", "A", "C"), code("G", "T", "A")) == ("S", "B", None, "M", None)


@pytest.mark.parametrize("a, b, ok", [((10, 14), (12, 20), True), ((10, 14), (14, 20), True), ((10, 14), (14.01, 20), False), ((10, 14), (3, 9.5), False), ((10, 14), (11, 12), True)])
def test_ci_overlap(spark, a, b, ok):
    assert one(spark, S.overlap(*[F.lit(float(x)) for x in (*a, *b)])) is ok


#: Probes of the loci a:10-60, a:50-90, a:55-58 and b:0-40, with how many they overlap, counted by hand.
PROBES = [("a", 0, 10, 0), ("a", 0, 11, 1), ("a", 56, 57, 3), ("a", 58, 59, 2), ("a", 89, 400, 1), ("a", 90, 400, 0), ("b", 39, 41, 1), ("b", 40, 41, 0), ("c", 0, 500, 0), ("a", 57, 57, 0), ("a", 0, 10_000, 3)]


@pytest.mark.parametrize("width", [8, 256, 4000])
def test_overlap_counts(spark, width):
    loci = spark.createDataFrame([("a", 10, 60), ("a", 50, 90), ("a", 55, 58), ("b", 0, 40)], "contig2 string, s long, e long")
    probes = spark.createDataFrame([(i, c, a, b) for i, (c, a, b, _) in enumerate(PROBES)], "i int, contig string, start long, end long")
    spans = (("contig", "contig2"), ("start", "end"), ("s", "e"))
    n = {r["i"]: r["count"] for r in intervals.overlap_join(probes, loci, *spans, width).groupBy("i").count().collect()}
    assert [n.get(i, 0) for i in range(len(PROBES))] == [x[3] for x in PROBES]
    assert {r["i"] for r in intervals.semi(probes, "i", loci, *spans, width=width).collect()} == {i for i, x in enumerate(PROBES) if x[3]}
    assert {r["i"] for r in intervals.anti(probes, "i", loci, *spans, width=width).collect()} == {i for i, x in enumerate(PROBES) if not x[3]}


def test_long_intervals_take_few_bins(spark):
    loci = spark.range(200).selectExpr("'a' contig", "id * 1000 start", "id * 1000 + 50 `end`", "id i")
    whole = spark.createDataFrame([("a", 0, 100_000_000), ("a", 5_010, 5_020), ("b", 0, 9)], "contig2 string, s long, e long")
    spans = (("contig", "contig2"), ("start", "end"), ("s", "e"))
    assert intervals.semi(loci, "i", whole, *spans).count() == 200
    assert intervals.levelled(whole, "s", "e", 256).count() < 2000
    assert intervals.anti(loci, "i", whole.where("e < 6000"), *spans).count() == 199


def test_dat_to_bed4(spark):
    text = "A header\n\nSequence: chr9 some words\nParameters: 2 7\n\n100 120 3 7.0 3 90 0 40 30 20 30 20 1.9 ACG ACGACG\n7 26 2 10.0 2 95 0 38 50 0 0 50 1.0 AT ATATAT"
    plain = [r["value"] for r in K.convert(trf.parse(lines(spark, text)), "trf", "bed4").orderBy("line").collect()]
    tidy = [r["value"] for r in K.convert(trf.parse(lines(spark, text), True), "trf", "bed4").orderBy("line").collect()]
    assert [x.split("\t")[1] for x in plain] == ["99", "6"] and [x.split("\t")[1] for x in tidy] == ["6", "99"]
    assert [x.split("\t")[0] for x in plain] == ["chr9 some words"] * 2 and plain[0].split("\t")[3] == "ACG"


def test_ploidy_configs():
    n = lambda name, c: ploidy.copies(c, ploidy.load(name))
    assert [n("haploid", c) for c in ("chr1", "X")] == [1, 1]
    assert [n("XX", c) for c in ("chrY", "M", "chrX")] == [0, 1, 2]
    assert [n("diploid_autosomes", c) for c in ("chrX", "M", "X")] == [None, 1, 2]
    for bad in ({}, {"default": "2"}, {"default": 2, "overrides": []}, {"default": 2, "more": 1}):
        with pytest.raises(ValueError):
            ploidy.checked(bad)


def test_loci_fail_fast(spark):
    rows = bed.rows(lines(spark, "# comment\n\nchr1\t5\t9\tCAG\nchr1\t9\t9\tCAG\nchrY\t1\t5\tAT"))
    kept = bed.loci(rows, ploidy.load("XX"), fail=False).orderBy("locus_index").collect()
    assert [(r["locus_index"], r["error"] is None) for r in kept] == [(1, True), (2, False)]
    with pytest.raises(Exception, match="catalog row 2"):
        bed.loci(rows, ploidy.load("XX")).collect()


def test_chi2_tail():
    assert abs(stats.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(stats.chi2_sf(5.991464547107979, 2) - 0.05) < 1e-12


def test_mann_whitney_exact_against_enumeration():
    from itertools import combinations

    x, y = [1.0, 5.0, 7.0], [2.0, 3.0, 4.0, 6.0]
    pool = sorted(x + y)
    u = lambda a: sum(p > q for p in a for q in [z for z in pool if z not in a])
    all_u = [u(c) for c in combinations(pool, 3)]
    want = min(1, 2 * min(np.mean([v >= u(x) for v in all_u]), np.mean([v <= u(x) for v in all_u])))
    assert math.isclose(stats.mann_whitney(np.array(x), np.array(y)), want)


def test_repeat_counts_and_mask():
    left, right = "ATTGCACCTGATTACG", "TGGATCCATTAGGCAT"
    for n in (0, 1, 7, 40):
        assert align.repeat_count("CAG" * n, left, right, "CAG", max(0, n - 3))[0] == n
    assert align.align("ACGT", "ACGT") == 8 and align.align("R", "A") == 2 and align.align("X", "A") == 0
    assert align.realigned("GG" + left + "CAG" * 4 + right + "TT", left, right) == (18, 30)


def test_linkage_and_consensus():
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 2], [9, 9, 2, 0]])
    assert cluster.average_linkage(d, 2).tolist() == [0, 0, 1, 1]
    assert consensus.consensus(["CAG"] * 3) == ("CAG", "single")
    assert consensus.consensus(["CAGCAG", "CAGCAG", "CAGAG"])[0] == "CAGCAG"
    assert consensus.edit_distance("kitten", "sitting") == 3


def test_calls_are_reproducible_and_find_two_alleles():
    cn = [10] * 9 + [11] * 3 + [25] * 10 + [24] * 2
    a, b = (em.call_alleles(cn, [1] * len(cn), 2, 7) for _ in range(2))
    assert a == b and a["call"] == [10, 25] and a["modal_n"] == 2 and abs(sum(a["weights"]) - 1) < 1e-9
    assert em.call_alleles([5] * 6, [1] * 6, 2, 1)["call"] == [5, 5] and em.call_alleles([5] * 3, [1] * 3, 2, 1) is None
    assert em.call_alleles([4, 4, 9, 9, 9], [1] * 5, 2, 1, em.Settings(bootstraps=1))["call"]


def test_calling_doesnt_follow_partitions(spark):
    rows = [(i, f"r{k}", 10 + (k % 2) * 8 + (k % 5 == 0), 1.0) for i in range(6) for k in range(20)]
    df = spark.createDataFrame(rows, "locus_index long, read_name string, cn int, w double")
    n = spark.range(6).selectExpr("id locus_index", "2 n_alleles")
    a, b = ({r["locus_index"]: r["call"] for r in calling.call(df.repartition(k), n).collect()} for k in (1, 7))
    assert a == b and len(a) == 6


def test_phase_sets():
    got = phasing.resolve([(1, 2, True), (2, 3, True), (5, 6, False), (7, 8, True), (8, 9, False), (7, 9, False)])
    assert got[3] == (1, False) and got[2] == (1, True) and got[6] == (5, False)
    assert got[7][0] is None and got[9][0] is None


def test_empty_trio(spark):
    empty = spark.createDataFrame([], callers.vcf.CALL)
    t = inherit.agreement(inherit.trio(empty, empty, empty))
    assert t.count() == 0 and inherit.by_contig(t).where("contig is not null").count() == 0


def test_trio_kinds(spark):
    ci = lambda *p: [(float(a), float(b)) for a, b in p]
    row = lambda gt, c: [("chr1", 1, 9, "CAG", gt, c, None, None, None, None, None)]
    df = lambda gt, c: spark.createDataFrame(row(gt, c), callers.vcf.CALL)
    child, mother, father = df([5.0, 8.0], ci((4, 6), (7, 9))), df([5.0, 5.0], ci((5, 5), (5, 5))), df([9.0, 12.0], None)
    r = inherit.agreement(inherit.trio(child, mother, father)).first()
    assert (r["strict"], r["pm1"], r["ci_95"], r["seq"]) == (False, True, None, None)


def test_gff_and_gtf(spark):
    g = lines(spark, "##gff\nchr1\tx\tCDS\t11\t20\t.\t+\t.\tParent=p;exon_id=E1").select("value")
    assert gff.parse(g, False).first()["fid"] == "CDS:E1"
    t = lines(spark, 'chr1\tx\tgene\t11\t20\t.\t+\t.\tgene_id "G"; tag "a"; tag "b";').select("value")
    assert gff.parse(t, True).first()["fid"] == "gene:chr1-10-20"


def test_sam_and_reference(spark):
    sam = "@HD\tVN:1\n@RG\tID:1\tSM:s1\nr1\t16\tchr1\t11\t60\t5S10M2D3M\t*\t0\t0\tACGT\tIIII\tHP:i:2\tPS:i:77"
    r = reads.from_sam(lines(spark, sam)).first()
    assert (r["start"], r["end"], r["strand"], r["hp"], r["ps"], r["quals"]) == (10, 25, "-", 2, 77, [40] * 4)
    assert reads.sample_of(lines(spark, sam)) == "s1"
    chunks = reads.fasta_chunks(lines(spark, ">c1 x\nACGTACGT\nTTTT\n>c2\nGG"), 5)
    assert {(r["contig"], r["chunk"]): r["seq"] for r in chunks.collect()} == {("c1", 0): "ACGTA", ("c1", 1): "CGTTT", ("c1", 2): "TT", ("c2", 0): "GG"}


def test_read_lines_and_cli(spark, tmp_path, capsys):
    from motiflake import cli

    p = tmp_path / "c.bed"
    p.write_text("# x\nchr2\t5\t9\tCAG\nchr1\t1\t4\tAT\n")
    assert [r["value"] for r in cli.convert(spark, str(p), "bed", "trgt").orderBy("line").collect()] == ["chr2\t5\t9\tID=locus0;MOTIFS=CAG;STRUC=(CAG)n", "chr1\t1\t4\tID=locus1;MOTIFS=AT;STRUC=(AT)n"]
    assert [r["contig"] for r in cli.combine(spark, [str(p), str(p)]).collect()] == ["chr1", "chr2"]


def test_params():
    p = CallParams(min_reads=3, min_allele_reads=5, vcf_anchor_size=0, targeted=True)
    assert (p.min_allele_reads, p.vcf_anchor_size, p.max_reads, p.max_terrible_reads) == (3, 1, 10_000, 5000)
    for bad in ({"caller": "gangstr", "test": "x2"}, {"caller": "gangstr", "only_phased": True}, {"caller": "straglr"}):
        with pytest.raises(ValueError):
            MiParams(**bad)


def test_stream_windows_are_the_batch_ones(spark, small, tmp_path):
    from motiflake.streaming import arrivals

    src = f"{small}/events.parquet"
    batch = spark.read.parquet(src)
    (tmp_path / "in").mkdir()
    batch.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = arrivals.tumbling(stream, "ts", "1 day", "1 hour", ["event_type"], "value").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r["event_type"], r["start"]): r["n"] for r in arrivals.tumbling(batch, "ts", "1 day", "1 hour", ["event_type"], "value").collect()}
    assert {(r["event_type"], r["start"]): r["n"] for r in spark.table("w").collect()} == want
