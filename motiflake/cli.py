"""Command line: mi, combine-catalogs, convert, call and search."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import calling, from_reads, inherit, stats
from .operators import catalog as catalogs
from .operators import intervals as I
from .params import CallParams, MiParams
from .sinks import report
from .sinks import vcf as vcf_sink
from .sources import bed, callers, ploidy, trf
from .sources import reads as reads_source
from .sources import vcf as vcf_source

#: Callers whose records are met by place, and whether the motif has to be the same.
POSITIONAL = {"own-vcf": True, "gangstr": False, "expansionhunter": False, "trgt": False, "generic-vcf": False, "longtr": False, "strdust": False}
_SPANS = (("contig", "contig2"), ("start", "end"), ("start2", "end2"))


def session() -> SparkSession:
    return SparkSession.builder.appName("motiflake").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def _spans(spark: SparkSession, path: str) -> DataFrame:
    x = bed.intervals(bed.rows(bed.read_lines(spark, path)))
    return x.select(F.col("contig").alias("contig2"), F.col("start").alias("start2"), F.col("end").alias("end2"))


def mi(spark: SparkSession, params: MiParams, child: str, mother: str, father: str) -> DataFrame:
    """Trio rows with the seven kinds and, if a test is asked for, p, p_adj and mutation_from."""
    catalog = None
    if params.catalog:
        catalog = bed.load_loci(spark, params.catalog, {"default": 2})
    sides = [callers.read(spark, params.caller, p, catalog) for p in (child, mother, father)]
    sides = [s.where("ps is not null") if params.only_phased else s for s in sides]
    sides = [s.where(F.col("contig") == params.contig) if params.contig else s for s in sides]
    sides = [s.drop("pos", "ref") for s in sides]
    if params.caller in POSITIONAL:
        t = inherit.positional_trio(*sides, POSITIONAL[params.caller])
    else:
        t = inherit.trio(*sides)
    t = t.where(~F.col("contig").isin(inherit.SEX))
    t = t.withColumn("_key", F.xxhash64("contig", "start", "end", "motif"))
    if params.catalog:
        wanted = catalog.select(F.col("contig").alias("contig2"), F.col("start").alias("start2"), F.col("end").alias("end2"))
        t = I.semi(t, "_key", wanted, *_SPANS)
    if params.exclude:
        t = I.anti(t, "_key", _spans(spark, params.exclude), *_SPANS)
    t = inherit.agreement(t.drop("_key"), params.widen, params.caller == "straglr")
    if params.test == "none":
        return t
    named = t.withColumnsRenamed({f"{p}_read_counts": f"{p}_reads" for p in "cmf"})
    return stats.adjust(stats.de_novo_tests(named, params.test, params.level), params.correction, alpha=params.level)


def convert(spark: SparkSession, path: str, source: str, target: str, ordered: bool = False) -> DataFrame:
    """Lines (line, value) of a catalog in another format."""
    lines = bed.read_lines(spark, path)
    if path.endswith(".dat"):
        rows = trf.parse(lines, ordered)
    else:
        rows = bed.rows(lines)
        rows = bed.sorted_rows(rows).select(F.col("place").alias("line"), "cols") if ordered else rows
    return catalogs.convert(rows, source, target)


def combine(spark: SparkSession, paths: list[str]) -> DataFrame:
    return catalogs.ordered(catalogs.combine([bed.rows(bed.read_lines(spark, p)) for p in paths]))


def call(spark: SparkSession, params: CallParams, reads: DataFrame, catalog: str) -> DataFrame:
    """Calls of reads that are already counted (locus_index, read_name, cn, w and maybe tags and SNVs)."""
    loci = bed.load_loci(spark, catalog, ploidy.load(params.ploidy))
    settings = calling.em.Settings(params.min_reads, params.min_allele_reads, params.num_bootstrap)
    found = calling.call(reads, loci.select("locus_index", "n_alleles"), params.seed, settings, params.max_reads)
    return loci.drop("n_alleles").join(found, "locus_index", "left")


def call_reads(spark: SparkSession, params: CallParams, path: str, reference: str, catalog: str, snvs: str | None = None, methyl: bool = False) -> DataFrame:
    """Calls from SAM text, a FASTA reference and a catalog, with known SNVs (a VCF) if given."""
    loci = bed.load_loci(spark, catalog, ploidy.load(params.ploidy))
    chunks = reads_source.fasta_chunks(bed.read_lines(spark, reference))
    known = None
    if snvs:
        known = vcf_source.single_base(vcf_source.read(spark, snvs)).select("contig", "pos", F.concat_ws("_", "contig", F.col("pos").cast("string")).alias("id"), "ref")
    return from_reads.call(loci, reads_source.read_sam(spark, path), chunks, params, known, methyl=methyl)


def main_call_reads_vcf(spark: SparkSession, called: DataFrame, params: CallParams, sample: str, out: str, contigs: list[tuple[str, int]], methyl: bool = False) -> None:
    """The VCF of called loci below a folder."""
    meta = {"motiflakeCommand": "call", "motiflakeSeed": str(params.seed)}
    vcf_sink.write(vcf_sink.lines(called, params.vcf_anchor_size, methyl), out, vcf_sink.header(contigs, sample, meta, methyl))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="motiflake")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("mi", help="inheritance in a trio")
    m.add_argument("files", nargs=3, metavar=("child", "mother", "father"))
    m.add_argument("--caller", required=True, choices=sorted([*callers.READERS, *callers.WITH_CATALOG]))
    m.add_argument("--catalog")
    m.add_argument("--exclude")
    m.add_argument("--contig")
    m.add_argument("--widen", type=float, default=0.0)
    m.add_argument("--only-phased", action="store_true")
    m.add_argument("--test", default="none", choices=["none", "x2", "wmw", "wmw-gt", "wmw-lt"])
    m.add_argument("--mt-corr", default="none", choices=stats.METHODS)
    m.add_argument("--sig-level", type=float, default=0.05)
    m.add_argument("--out")
    c = sub.add_parser("convert", help="a catalog in another format")
    c.add_argument("path")
    c.add_argument("--in-format", default="bed", choices=["bed", "bed4", "trf", "trgt"])
    c.add_argument("--out-format", required=True, choices=sorted({b for _, b in catalogs.CONVERTERS}))
    c.add_argument("--sort", action="store_true")
    k = sub.add_parser("combine-catalogs", help="the union of catalogs")
    k.add_argument("paths", nargs="+")
    g = sub.add_parser("call", help="genotypes from aligned reads (SAM text with --ref) or from counted reads (Parquet)")
    g.add_argument("reads")
    g.add_argument("--loci", required=True)
    g.add_argument("--ref", help="FASTA; reads are SAM text then")
    g.add_argument("--snvs", help="VCF of known SNVs")
    g.add_argument("--methyl", action="store_true")
    g.add_argument("--sample-id")
    g.add_argument("--ploidy", default="diploid_autosomes")
    g.add_argument("--seed", type=int, default=0)
    g.add_argument("--targeted", action="store_true")
    g.add_argument("--out", required=True)
    s = sub.add_parser("search", help="loci of a report's results (JSON lines)")
    s.add_argument("results")
    s.add_argument("--text")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = session()
    try:
        if a.command == "mi":
            t = mi(spark, MiParams(a.caller, a.test, a.mt_corr, a.sig_level, a.widen, a.only_phased, a.contig, a.catalog, a.exclude), *a.files)
            if a.out:
                t.write.mode("overwrite").json(a.out)
            print(inherit.summary(t, inherit.KINDS).first()["txt"])
        elif a.command == "convert":
            for r in convert(spark, a.path, a.in_format, a.out_format, a.sort).orderBy("line").toLocalIterator():
                print(r["value"])
        elif a.command == "combine-catalogs":
            for r in combine(spark, a.paths).toLocalIterator():
                print(r["contig"], r["start"], r["end"], r["motif"], sep="\t")
        elif a.command == "call":
            params = CallParams(sample_id=a.sample_id, ploidy=a.ploidy, seed=a.seed, targeted=a.targeted)
            if a.ref:
                sample = params.sample_id or reads_source.sample_of(spark.read.text(a.reads)) or "sample"
                found = call_reads(spark, params, a.reads, a.ref, a.loci, a.snvs, a.methyl)
                sizes = reads_source.contig_lengths(reads_source.fasta_chunks(bed.read_lines(spark, a.ref)))
                main_call_reads_vcf(spark, found, params, sample, f"{a.out}/vcf", [tuple(r) for r in sizes.select("contig", "length").collect()], a.methyl)
            else:
                sample, found = params.sample_id, call(spark, params, spark.read.parquet(a.reads), a.loci)
            report.write(found, a.out, params.to_dict(), sample)
        else:
            for r in report.search(spark.read.json(a.results), a.text).toLocalIterator():
                print(r["locus_index"], r["contig"], r["start"], r["end"], sep="\t")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
