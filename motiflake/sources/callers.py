"""Text and JSON call sets as canonical call rows, and the registry of all readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import vcf
from .vcf import _call, _doubles

REPORT = "sample_id string, contigs array<string>, results array<struct<locus_id:string,contig:string,start:bigint,end:bigint,motif:string,ref_cn:double,call:array<double>,call_95_cis:array<array<double>>,call_99_cis:array<array<double>>,assign_method:string,ps:int,peaks:struct<modal_n:int,seqs:array<array<string>>>,reads:map<string,struct<cn:int,p:int,s:string,w:double>>>>"


def _col(i: int) -> Column:
    return F.get("c", F.lit(i))


def _split(lines: DataFrame) -> DataFrame:
    return lines.where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.split("value", "\t").alias("c"))


def own_tsv(lines: DataFrame) -> DataFrame:
    """contig, start, end, motif, copies, -, a|b, lo-hi|lo-hi; rows with a '.' in the call are left out."""
    x = _split(lines).where(~_col(6).contains("."))
    return _call(x, contig=_col(0), start=_col(1).cast("long"), end=_col(2).cast("long"), motif=_col(3), gt=_doubles(_col(6), r"\|"), ci95=S.parse_cis(_col(7)), ref_copies=_col(4).try_cast("double"))


def straglr(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """size(n);size(n) in the sixth column; one size is both alleles; sizes are scaled to the catalog's motif."""
    x = _split(lines).select(_col(0).alias("contig"), _col(1).cast("long").alias("start"), _col(2).cast("long").alias("end"), _col(3).alias("own"), F.transform(F.split(_col(5), ";"), lambda e: F.regexp_extract(e, r"^([0-9.]+)", 1).try_cast("double")).alias("s"))
    x = x.withColumn("s", F.when(F.size("s") == 1, F.concat("s", "s")).otherwise(F.col("s"))).join(catalog.select("contig", "start", "end", "motif"), ["contig", "start", "end"])
    return _call(x, contig=F.col("contig"), start=F.col("start"), end=F.col("end"), motif=F.col("motif"), gt=F.transform("s", lambda v: v * F.length("own") / F.length("motif")))


def tandem_genotypes(lines: DataFrame) -> DataFrame:
    x = _split(lines).where("c[6] <> '.' and c[7] <> '.'")
    return _call(x, contig=_col(0), start=_col(1).cast("long"), end=_col(2).cast("long"), motif=_col(3), gt=F.array(_col(6).try_cast("double"), _col(7).try_cast("double")))


def repeathmm(lines: DataFrame) -> DataFrame:
    """contig:start:end:motif a/b; a call of 0/0 is none."""
    x = lines.where(F.trim("value") != "").select(F.split("value", " ").alias("c")).withColumn("k", F.split(_col(0), ":"))
    x = x.withColumn("g", _doubles(_col(1), "/")).where("not (g[0] = 0 and g[1] = 0)")
    k = lambda i: F.get("k", F.lit(i))
    return _call(x, contig=k(0), start=k(1).cast("long"), end=k(2).cast("long"), motif=k(3), gt=F.col("g"))


def read_counts(reads: Column, method: Column) -> Column:
    """Copies of the reads of each peak, in order of copies; one peak called by distance is dealt out in turn."""
    called = F.filter(F.map_values(reads), lambda r: r["p"].isNotNull())
    peaks = F.array_sort(F.array_distinct(F.transform(called, lambda r: r["p"])))
    per = F.transform(peaks, lambda p: F.array_sort(F.transform(F.filter(called, lambda r: r["p"] == p), lambda r: r["cn"])))
    one = F.get(per, F.lit(0))
    dealt = F.array(F.filter(one, lambda _, i: i % 2 == 0), F.filter(one, lambda _, i: i % 2 == 1))
    return F.when((F.size(per) == 1) & (method == "dist"), dealt).otherwise(per)


def report(df: DataFrame) -> DataFrame:
    """Calls of JSON reports that were read with REPORT."""
    x = df.select(F.explode("results").alias("r")).select("r.*").where("call is not null")
    ci = lambda c: F.transform(c, lambda y: F.struct(F.get(y, F.lit(0)).alias("lo"), F.get(y, F.lit(1)).alias("hi")))
    return _call(
        x, contig=F.col("contig"), start=F.col("start"), end=F.col("end"), motif=F.col("motif"), gt=F.col("call"), ci95=ci("call_95_cis"), ci99=ci("call_99_cis"),
        seqs=F.transform("peaks.seqs", lambda s: F.get(s, F.lit(0))), read_counts=read_counts(F.col("reads"), F.col("assign_method")), ps=F.col("ps"), ref_copies=F.col("ref_cn"),
    )


def report_contigs(df: DataFrame) -> DataFrame:
    """The report's contigs, or those of its results where it lists none."""
    of = F.when(F.size("contigs") > 0, F.col("contigs")).otherwise(F.array_distinct(F.transform("results", lambda r: r["contig"])))
    return df.select(F.explode(of).alias("contig")).distinct()


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return report(spark.read.schema(REPORT).option("multiLine", True).json(path))


_text = lambda f: lambda spark, path: f(spark.read.text(path))
#: name -> (spark, path) -> call rows; generic VCFs and straglr also need a catalog
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "own-json": read_report,
    "own-tsv": _text(own_tsv),
    "tandem-genotypes": _text(tandem_genotypes),
    "repeathmm": _text(repeathmm),
    **{k: (lambda f: lambda spark, path: f(vcf.read(spark, path)))(f) for k, f in vcf.READERS.items()},
}
WITH_CATALOG: dict[str, Callable[[SparkSession, str, DataFrame], DataFrame]] = {
    "straglr": lambda spark, path, c: straglr(spark.read.text(path), c),
    **{k: (lambda spark, path, c: vcf.generic(vcf.read(spark, path), c)) for k in ("generic-vcf", "longtr", "strdust")},
}


def read(spark: SparkSession, caller: str, path: str, catalog: DataFrame | None = None) -> DataFrame:
    if caller in READERS:
        return READERS[caller](spark, path)
    if caller not in WITH_CATALOG:
        raise ValueError(f"unknown caller {caller}")
    if catalog is None:
        raise ValueError(f"{caller} needs a catalog of loci with motifs")
    return WITH_CATALOG[caller](spark, path, catalog)
