"""VCF output: header lines and records of called loci and of their SNVs, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators.genotype import histogram_text

# Ids, numbers and types of the fields that records have, as declared in the header.
INFO = (
    ("VT", "1", "String", "Kind of record: str or snv"),
    ("MOTIF", "1", "String", "Repeated unit"),
    ("REFMC", "1", "Integer", "Copies of the motif that the reference has"),
    ("BED_START", "1", "Integer", "Where the catalog says the locus starts, from 0"),
    ("BED_END", "1", "Integer", "Where the catalog says the locus ends, not included"),
    ("ANCH", "1", "Integer", "Bases before the repeat that the alleles begin with"),
    ("ANNOT", "1", "String", "Features that overlap the locus"),
)
FORMAT = (
    ("AD", ".", "Integer", "Reads of each allele"),
    ("ANCL", ".", "Integer", "Bases before the repeat in REF and in each ALT"),
    ("CONS", ".", "String", "How the sequence of each ALT was made: single, poa or best_rep"),
    ("DP", "1", "Integer", "Reads at the locus"),
    ("DPS", "1", "Integer", "Reads that belong to an allele"),
    ("GT", "1", "String", "Genotype"),
    ("MC", ".", "Integer", "Copies of the motif in each allele"),
    ("MCCI", ".", "String", "Interval of 95 percent for each allele's copies"),
    ("MCRL", ".", "String", "Histogram of the copies of each allele's reads"),
    ("MMAS", "1", "Float", "Mean over reads of the score of motif copies aligned to the read"),
    ("NSNV", "1", "Integer", "SNVs that told the alleles apart"),
    ("PS", "1", "Integer", "Phase set"),
    ("PM", "1", "String", "What the alleles were told apart by: dist, snv+dist, snv or hp"),
    ("SLR", ".", "String", "Histogram of the repeat lengths of each allele's reads"),
)
METHYLATION = (("AM", ".", "Float", "Mean 5-methyl share of each allele's CpG sites"), ("AMC", ".", "Float", "Mean number of such sites for each allele"))


def header(contigs: list[tuple[str, int]], sample: str, meta: dict[str, str] | None = None, methylation: bool = False) -> list[str]:
    out = ["##fileformat=VCFv4.2", *[f"##{k}={v}" for k, v in (meta or {}).items()], *[f"##contig=<ID={c},length={n}>" for c, n in contigs]]
    out += [f'##INFO=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in INFO]
    out += [f'##FORMAT=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in [*FORMAT, *(METHYLATION if methylation else ())]]
    return [*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]


def with_alleles(x: DataFrame, anchor_size: int) -> DataFrame:
    """Adds _offset, _ref, _alts, _gt, _ancl and _cons to rows with ref_anchor, ref_seq, anchors, seqs, n_alleles and
    cons: anchors without their common prefix (a base stays), distinct sorted alternatives with "*" for a deletion of
    everything, the genotype's indices, and the alternatives' anchor lengths (the reference's first) and methods. One
    sequence stands for all alleles.

    Each is a column of its own: nested in one expression, every use of an earlier one would be a copy of its whole tree.
    """
    up = lambda a: F.transform(a, F.upper)
    x = x.withColumns({"_ua": up("anchors"), "_us": up("seqs"), "_ur": F.upper("ref_anchor")})
    x = x.withColumn("_offset", F.least(F.length(S.common_prefix(F.concat(F.array("_ur"), "_ua"))), F.lit(anchor_size - 1)))
    pairs = F.transform(F.arrays_zip(F.col("_ua").alias("a"), F.col("_us").alias("s"), F.col("cons").alias("m")), lambda z: F.struct(F.concat(F.substr(z["a"], F.col("_offset") + 1), z["s"]).alias("x"), F.greatest(F.length(z["a"]) - F.col("_offset"), F.lit(0)).alias("n"), z["m"].alias("m")))
    x = x.withColumns({"_ref": F.concat(F.substr("_ur", F.col("_offset") + 1), F.upper("ref_seq")), "_pairs": pairs})
    x = x.withColumn("_full", F.when(F.size("_pairs") < F.col("n_alleles"), F.array_repeat(F.get("_pairs", F.lit(0)), F.col("n_alleles"))).otherwise(F.col("_pairs")))
    x = x.withColumn("_other", F.array_sort(F.array_distinct(F.transform(F.filter("_full", lambda p: p["x"] != F.col("_ref")), lambda p: p["x"]))))
    first = lambda a, k: F.get(F.filter("_full", lambda p: p["x"] == a), F.lit(0))[k]
    return x.withColumns({
        "_gt": F.transform("_full", lambda p: F.when(p["x"] == F.col("_ref"), F.lit(0)).otherwise(F.array_position("_other", p["x"]).cast("int"))),
        "_alts": F.when(F.size("_other") == 0, F.array(F.lit("."))).otherwise(F.transform("_other", lambda a: F.when(a == "", F.lit("*")).otherwise(a))),
        "_ancl": F.concat(F.array(F.length("ref_anchor") - F.col("_offset")), F.transform("_other", lambda a: first(a, "n"))), "_cons": F.transform("_other", lambda a: first(a, "m")),
    })


#: Columns that a called locus may lack.
OPTIONAL = {
    "cons": "array<string>", "lens": "array<array<int>>", "method": "string", "n_snvs": "int", "depth": "int", "mean_score": "double", "am": "array<double>", "amc": "array<double>", "annotations": "array<string>",
    "start_adj": "bigint",
}


def lines(called: DataFrame, anchor_size: int = 5, methylation: bool = False) -> DataFrame:
    """contig, pos (1-based), line of called loci: contig, start, end, locus_id, motif, ref_cn, ref_anchor, ref_seq,
    anchors, seqs, n_alleles, call, ci95, cns (array<array<int>>), ps, and those of OPTIONAL. Loci without a call have
    a record without alternatives."""
    x = called.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in called.columns})
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    x = x.withColumns({"seqs": none("seqs", "array<string>"), "anchors": none("anchors", "array<string>"), "cns": none("cns", "array<array<int>>"), "lens": none("lens", "array<array<int>>")})
    x = with_alleles(x.withColumn("cons", F.coalesce("cons", F.transform("seqs", lambda s: F.lit(".")))), anchor_size)
    pos = F.coalesce("start_adj", "start") - F.length("ref_anchor") + F.col("_offset") + 1
    text = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    many = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(c, ",")).otherwise(".")
    annot = F.when(F.size("annotations") > 0, F.concat(F.lit(";ANNOT="), F.array_join("annotations", ","))).otherwise("")
    info = F.concat(F.lit("VT=str;MOTIF="), "motif", F.lit(";REFMC="), text(F.col("ref_cn")), F.lit(";BED_START="), text(F.col("start")), F.lit(";BED_END="), text(F.col("end")), F.lit(";ANCH="), text(anchor_size - F.col("_offset")), annot)
    sep = F.when(F.col("ps").isNull(), "/").otherwise("|")
    called_here = F.col("call").isNotNull() & (F.size("seqs") > 0)
    gt = F.when(called_here, F.transform("_gt", lambda g: g.cast("string"))).otherwise(F.array_repeat(F.lit("."), F.col("n_alleles").cast("int")))
    n = F.transform("cns", F.size)
    total = F.aggregate(n, F.lit(0), lambda a, b: a + b)
    fields = {
        "GT": F.array_join(gt, "@"), "PM": text(F.col("method")), "NSNV": text(F.col("n_snvs")), "DP": text(F.coalesce("depth", total)), "MMAS": text(F.round("mean_score", 6)),
        "DPS": F.when(called_here, text(total)).otherwise("."), "AD": many(n), "MC": many(F.transform("call", text)),
        "MCCI": many(F.transform("ci95", lambda c: F.concat(text(c["lo"]), F.lit("-"), text(c["hi"])))), "ANCL": F.when(called_here, many(F.col("_ancl"))).otherwise("."), "CONS": many(F.col("_cons")),
        "MCRL": many(F.transform("cns", histogram_text)), "SLR": many(F.transform("lens", histogram_text)),
        **({k: many(F.transform(c, lambda v: text(F.round(v, 6)))) for k, c in (("AM", "am"), ("AMC", "amc"))} if methylation else {}), "PS": text(F.col("ps")),
    }
    sample = F.concat_ws(":", *fields.values())
    line = F.concat_ws("\t", "contig", text(pos), "locus_id", "_ref", F.array_join("_alts", ","), F.lit("."), F.lit("."), info, F.lit(":".join(fields)), F.replace(sample, F.lit("@"), sep))
    return x.select("contig", pos.alias("pos"), line.alias("line"))


def distinct_snvs(snvs: DataFrame) -> DataFrame:
    """One row for each contig and SNV id: that of the first locus."""
    w = Window.partitionBy("contig", "id").orderBy("locus_index")
    return snvs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def snv_lines(snvs: DataFrame) -> DataFrame:
    """contig, pos, line of SNVs (contig, pos 0-based, id, ref, call array, rcs array, and maybe ps); those without
    alternatives go."""
    alts = F.array_sort(F.array_distinct(F.filter("call", lambda b: b != F.col("ref"))))
    x = snvs.withColumn("_alts", alts).where(F.size("_alts") > 0)
    gt = F.array_join(F.transform("call", lambda b: F.when(b == F.col("ref"), F.lit(0)).otherwise(F.array_position("_alts", b).cast("int"))), "@")
    ps = F.col("ps") if "ps" in snvs.columns else F.lit(None).cast("int")
    gt, more = F.replace(gt, F.lit("@"), F.when(ps.isNull(), "/").otherwise("|")), F.when(ps.isNotNull(), F.concat(F.lit(":"), ps.cast("string"))).otherwise("")
    line = F.concat_ws("\t", "contig", (F.col("pos") + 1).cast("string"), "id", "ref", F.array_join("_alts", ","), F.lit("."), F.lit("."), F.lit("VT=snv"), F.concat(F.lit("GT:DP:AD"), F.when(ps.isNotNull(), ":PS").otherwise("")), F.concat(F.concat_ws(":", gt, F.aggregate("rcs", F.lit(0), lambda a, b: a + b).cast("string"), F.array_join("rcs", ",")), more))
    return x.select("contig", (F.col("pos") + 1).alias("pos"), line.alias("line"))


def in_order(records: DataFrame) -> DataFrame:
    """Partitions in chromosome order and position, each sorted."""
    key = S.chromosome_order(F.col("contig"))
    return records.withColumn("_k", key).repartitionByRange("_k", "pos").sortWithinPartitions("_k", "pos", "line").drop("_k")


def write(records: DataFrame, path: str, head: list[str]) -> None:
    """Sorted record lines as text parts below path, and the header beside them."""
    in_order(records).select("line").write.text(f"{path}/records")
    records.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(f"{path}/header")
