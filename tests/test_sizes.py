"""Work and results that small tables don't show: what a step costs by its input, and values beyond the small scales."""

import sys
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from motiflake.kernels import em
from motiflake.operators import genotype, intervals, ranges
from motiflake.plans import fixtures, formats
from motiflake.sources import reads


def calls_of(run) -> int:
    """How many functions a run calls."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(None)
    return n


def test_bootstraps_of_one_allele_are_not_looked_at_one_by_one():
    cn, w = [10, 11, 11, 12, 10, 12, 11], np.ones(7)
    few, many = (calls_of(lambda b=b: em.call_alleles(cn, w, 1, 3, em.Settings(bootstraps=b))) for b in (50, 400))
    assert many < 2 * few


def test_kmers_of_a_long_text(spark):
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("ACGTACGTACGTN\n\u00e9"), 400_000))
    text += "ACG" * 90 + "xAC" + "GT" * 70
    began = time.perf_counter()
    got = {r["kmer"]: r["n"] for r in genotype.kmers(spark.createDataFrame([("a", text), ("a", "AC"), ("a", None)], "g string, s string"), "s", 4, ["g"]).collect()}
    assert time.perf_counter() - began < 30  # places were sought from the start of the text, with the square of its length
    assert got == {k: n for k, n in Counter(text[i : i + 4] for i in range(len(text) - 3)).items() if set(k) <= set("ACGT")}


SPANS = (("contig", "contig2"), ("start", "end"), ("s", "e"))


@pytest.mark.parametrize("width", [64, 1 << 16])
def test_overlaps_of_dense_intervals_are_counted(spark, width):
    """All intervals lie in one wide bin and few overlap: pairs of a bin would be 900 million, counts are 60,000 rows."""
    a = spark.range(30_000).selectExpr("id i", "'a' contig", "id * 10 start", "id * 10 + 1 + id % 3 `end`")
    b = spark.range(30_000).selectExpr("'a' contig2", "id * 10 + 2 s", "id * 10 + 5 e")
    began = time.perf_counter()
    assert intervals.semi(a, "i", b, *SPANS, width=width).agg(F.count("*"), F.sum(F.col("i") % 3)).first() == (10_000, 20_000)
    assert intervals.anti(a, "i", b, *SPANS, width=width).agg(F.count("*"), F.max(F.col("i") % 3)).first() == (20_000, 1)
    assert time.perf_counter() - began < 20


def test_partly_covered_loci_need_no_table_on_the_driver(spark, small):
    from motiflake.plans.queries import QUERIES

    plan = QUERIES["p04_should_skip_locus"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and all("strategy=merge" in x for x in plan.splitlines() if "Join Left" in x)


def test_sections_of_far_loci(spark, tmp_path):
    keys = list(range(3_000_000, 3_000_044))
    spark.createDataFrame([(k, 7) for k in keys], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    want = {(f"chr{k % 22 + 1}", k // 22 * 40 + 30_000) for k in keys}
    assert {(r["contig"], r["start_pos"]) for r in formats.trf_dat(spark, str(tmp_path)).collect()} == want
    got = [(r["contig"], r["start_pos"]) for r in sorted(formats.trf_dat_sorted(spark, str(tmp_path)).collect(), key=lambda r: r["place"])]
    assert got == sorted(want, key=lambda x: (int(x[0][3:]), x[1]))


def test_record_expressions_are_not_copied(spark, small):
    plan = formats.vcf_records(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") < 20


def test_pvalues_have_the_bits_of_sql(spark, tmp_path):
    spark.range(20_000).selectExpr("id event_id", "id / 50.0D value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = {r[0]: r[1] for r in duckdb.connect().sql(f"with events as (select * from '{tmp_path}/events.parquet/*.parquet') {fixtures.PVALUES}").fetchall()}
    got = {r["id"]: r["p"] for r in fixtures.fixture(spark, str(tmp_path), "pvalues").collect()}
    assert got.keys() == want.keys() and sum(got[k] != want[k] for k in want) < 50  # 2,000 of Spark's own powers


def test_keys_are_made_once_for_all_bounds(spark, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", 40)
    lines = spark.range(3000).selectExpr("concat('  a', id, ' ') v").select(F.regexp_replace("v", r"^\s+|\s+$", "").alias("v"))
    got = ranges.numbered(lines.withColumn("k", F.length("v")), ["k", "v"])
    assert "< struct(" not in got._jdf.queryExecution().optimizedPlan().toString()  # made anew for each bound
    assert got.where("line = 1").first()["v"] == "a0"


def test_catalog_lines_and_genomes_are_made_on_all_cores(spark, small):
    from motiflake.plans import kernels

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert formats.rows(spark, small).rdd.getNumPartitions() >= n and kernels.genome(spark, small).rdd.getNumPartitions() == n


def test_chunks_take_one_deal_of_the_lines(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(reads, "ranged", lambda *a: dealt.append(a) or ranges.ranged(*a))
    monkeypatch.setattr(ranges, "ROWS", 5)
    fasta = ["lost", ">a x", "AC", "GT" * 9, ">none", ">b", *["ACGTT"] * 30]
    got = reads.fasta_chunks(spark.createDataFrame(list(enumerate(fasta)), "line long, value string").repartition(3), 7).collect()
    text = lambda c: "".join(r["seq"] for r in sorted(got, key=lambda r: r["chunk"]) if r["contig"] == c)
    assert len(dealt) == 1 and {r["contig"] for r in got} == {"a", "b"} and text("a") == "AC" + "GT" * 9 and text("b") == "ACGTT" * 30


def test_loci_and_reads_are_no_table_on_the_driver(spark, small):
    from motiflake.plans.queries import QUERIES

    for name in ("m19_m20_counts_from_reads", "f30_reference_count"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_long_text_is_cut_in_one_pass(spark, tmp_path):
    text = "AbcdeFghij" * 150_000
    spark.createDataFrame([(7, text), (8, "a b")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    began = time.perf_counter()
    assert {r["doc_id"]: r["ref_seq"] for r in formats.reference_slices(spark, str(tmp_path)).collect()} == {7: text[7:157].upper()}
    assert time.perf_counter() - began < 30  # each line was sought from the start
