"""VCF text: records with INFO and one sample's FORMAT as maps, header contigs, and the callers' records as calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.genotype import decode_histogram, halves

CALL = "contig string, start bigint, end bigint, motif string, gt array<double>, ci95 array<struct<lo:double,hi:double>>, ci99 array<struct<lo:double,hi:double>>, seqs array<string>, read_counts array<array<int>>, ps int, ref_copies double"


def records(lines: DataFrame, sample: int = 0) -> DataFrame:
    """contig, pos (0-based), id, ref, alts, info (map), fmt (map of one sample's fields; '.' is null)."""
    x = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("c"))
    col = lambda i: F.get("c", F.lit(i))
    flag = F.transform(F.split(col(7), ";"), lambda e: F.struct(F.substring_index(e, "=", 1).alias("key"), F.when(e.contains("="), F.substr(e, F.instr(e, F.lit("=")) + 1)).alias("value")))
    fmt = F.map_from_arrays(F.split(col(8), ":"), F.slice(F.concat(F.transform(F.split(col(9 + sample), ":"), lambda v: F.nullif(v, F.lit("."))), F.array_repeat(F.lit(None).cast("string"), F.size(F.split(col(8), ":")))), 1, F.size(F.split(col(8), ":"))))
    return x.select(
        col(0).alias("contig"), (col(1).cast("long") - 1).alias("pos"), col(2).alias("id"), col(3).alias("ref"), F.filter(F.split(col(4), ","), lambda a: a != ".").alias("alts"),
        F.map_from_entries(flag).alias("info"), fmt.alias("fmt"),
    )


def read(spark: SparkSession, path: str, sample: int = 0) -> DataFrame:
    return records(spark.read.text(path), sample)


def header_contigs(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("value").startswith("##contig=")).select(F.regexp_extract("value", "ID=([^,>]+)", 1).alias("contig"))


def single_base(r: DataFrame) -> DataFrame:
    """Candidate SNVs: records whose alleles have one base each."""
    return r.where((F.length("ref") == 1) & (F.size("alts") > 0) & F.forall("alts", lambda a: F.length(a) == 1))


def _of(m: str, key: str) -> Column:
    return F.try_element_at(F.col(m), F.lit(key))


def alleles() -> Column:
    """The sequences of the genotype: ref and alts by GT's numbers."""
    all_of = F.concat(F.array("ref"), F.col("alts"))
    return F.transform(F.split(_of("fmt", "GT"), r"[/|]"), lambda g: F.get(all_of, g.try_cast("int")))


def _doubles(text: Column, separator: str) -> Column:
    return F.transform(F.split(text, separator), lambda x: x.try_cast("double"))


def _call(r: DataFrame, **cols: Column) -> DataFrame:
    """Columns of the canonical call row; what isn't given is null."""
    kinds = [x.strip() for x in CALL.replace(", ", "\n").split("\n")]
    out = []
    for k in kinds:
        name, kind = k.split(" ", 1)
        c = cols.get(name)
        out.append((c if c is not None else F.lit(None)).cast(kind).alias(name))
    return r.select(*out, *[F.col(c) for c in ("pos", "ref") if c in r.columns])


def own(r: DataFrame, only_phased: bool = False) -> DataFrame:
    """This library's records: VT=str with MC, MCCI; sequences by length; read counts from MCRL."""
    x = r.where((_of("info", "VT") == "str") & _of("fmt", "MC").isNotNull() & _of("fmt", "MCCI").isNotNull())
    if only_phased:
        x = x.where(_of("fmt", "PS").isNotNull())
    by_length = F.transform(F.array_sort(F.transform(alleles(), lambda s, i: F.struct(F.length(s).alias("n"), i.alias("i"), s.alias("s")))), lambda e: e["s"])
    lists = F.transform(F.split(_of("fmt", "MCRL"), ","), decode_histogram)
    lists = F.when(F.size(lists) == 1, halves(F.get(lists, F.lit(0)))).otherwise(lists)
    out = _call(
        x, contig=F.col("contig"), start=F.coalesce(_of("info", "BED_START").try_cast("long"), F.col("pos")), end=F.coalesce(_of("info", "BED_END").try_cast("long"), F.col("pos") + F.length("ref")), motif=_of("info", "MOTIF"),
        gt=_doubles(_of("fmt", "MC"), ","), ci95=S.parse_cis(_of("fmt", "MCCI"), ","), seqs=by_length, read_counts=lists, ps=_of("fmt", "PS").try_cast("int"), ref_copies=_of("info", "REFMC").try_cast("double"),
    )
    return out.where("gt[0] is not null and ci95[0] is not null")


def gangstr(r: DataFrame) -> DataFrame:
    out = _call(
        r, contig=F.col("contig"), start=F.col("pos"), end=_of("info", "END").try_cast("long"), motif=_of("info", "RU"), gt=_doubles(_of("fmt", "REPCN"), ","),
        ci95=S.parse_cis(_of("fmt", "REPCI"), ","), ref_copies=_of("info", "REF").try_cast("double"),
    )
    return out.where("gt[0] is not null and ci95[0] is not null")


def expansionhunter(r: DataFrame) -> DataFrame:
    """REPCN and REPCI by '/', sorted together by REPCN's text."""
    both = F.array_sort(F.transform(F.arrays_zip(F.split(_of("fmt", "REPCN"), "/").alias("n"), F.split(_of("fmt", "REPCI"), "/").alias("c")), lambda z: F.struct(z["n"].alias("n"), z["c"].alias("c"))))
    out = _call(
        r, contig=F.col("contig"), start=F.col("pos"), end=_of("info", "END").try_cast("long"), motif=_of("info", "RU"), gt=F.transform(both, lambda z: z["n"].try_cast("double")),
        ci95=F.transform(both, lambda z: S.parse_ci(z["c"])), ref_copies=_of("info", "REF").try_cast("double"),
    )
    return out.where("gt[0] is not null and ci95[0] is not null")


def trgt(r: DataFrame) -> DataFrame:
    """The first motif's counts of each allele, sorted; sequences by length."""
    seqs = F.transform(F.array_sort(F.transform(alleles(), lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))), lambda e: e["s"])
    counts = F.array_sort(F.transform(F.split(_of("fmt", "MC"), ","), lambda m: F.split(m, "_")[0].try_cast("double")))
    out = _call(r, contig=F.col("contig"), start=F.col("pos"), end=_of("info", "END").try_cast("long"), motif=F.split(_of("info", "MOTIFS"), ",")[0], gt=counts, seqs=seqs)
    return out.where("gt[0] is not null")


def generic(r: DataFrame, catalog: DataFrame) -> DataFrame:
    """Copies from allele lengths and the motif of the first catalog locus (contig, start, end, motif) that overlaps."""
    from ..operators.intervals import first_match, overlap_join

    n = r.withColumns({"_start": F.coalesce(_of("info", "START").try_cast("long") - 1, F.col("pos")), "_end": F.coalesce(_of("info", "END").try_cast("long"), F.col("pos") + F.length("ref"))})
    n = n.withColumn("_key", F.xxhash64("contig", "pos", "ref", F.array_join("alts", ",")))
    c = catalog.select(F.col("contig").alias("_cc"), F.col("start").alias("_cs"), F.col("end").alias("_ce"), F.col("motif").alias("_motif"))
    x = first_match(overlap_join(n, c, ("contig", "_cc"), ("_start", "_end"), ("_cs", "_ce")), ["_key"], ["_ce", "_cs", "_motif"])
    seqs = alleles()
    out = _call(x, contig=F.col("contig"), start=F.col("_cs"), end=F.col("_ce"), motif=F.col("_motif"), gt=F.transform(seqs, lambda s: F.bround(F.length(s) / F.length("_motif")).cast("double")), seqs=seqs)
    return out.where("gt[0] is not null")


READERS = {"own-vcf": own, "gangstr": gangstr, "expansionhunter": expansionhunter, "trgt": trgt}
