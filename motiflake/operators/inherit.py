"""Trio inheritance: joins of three call sets, the seven kinds of agreement, rates, histograms and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .intervals import first_match, overlap_join

KINDS = ("strict", "pm1", "ci_95", "ci_99", "seq", "sl", "sl_pm1")
KEY = ["contig", "start", "end", "motif"]
SEX = ["chrX", "X", "chrY", "Y"]


def trio(child: DataFrame, mother: DataFrame, father: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One wide row for each key that all three have; a caller's other columns get the prefixes c_, m_ and f_."""
    sides = []
    for prefix, df in (("c", child), ("m", mother), ("f", father)):
        sides.append(df.select(*key, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in key]))
    return sides[0].join(sides[1], key).join(sides[2], key)


def positional_trio(child: DataFrame, mother: DataFrame, father: DataFrame, same_motif: bool) -> DataFrame:
    """The rows of trio() where each of the child's loci has the first record of a parent that overlaps it (of equal
    motif, if asked for), wherever that record begins."""
    loci, out = child.select(*KEY).distinct(), child.select(*KEY, *[F.col(c).alias(f"c_{c}") for c in child.columns if c not in KEY])
    for prefix, df in (("m", mother), ("f", father)):
        p = df.select(*[F.col(c).alias(f"_p_{c}") for c in KEY], *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in KEY])
        pairs = overlap_join(loci, p, ("contig", "_p_contig"), ("start", "end"), ("_p_start", "_p_end"))
        if same_motif:
            pairs = pairs.where(F.col("motif") == F.col("_p_motif"))
        best = first_match(pairs, KEY, ["_p_start", "_p_end", "_p_motif"]).drop(*[f"_p_{c}" for c in KEY])
        out = out.join(best, KEY)
    return out


def agreement(t: DataFrame, widen: float = 0.0, decimal: bool = False) -> DataFrame:
    """Adds the seven kinds to a trio of canonical calls (gt, ci95, ci99, seqs arrays); unknown ones are null."""
    two = lambda p, c: [F.get(F.col(f"{p}_{c}"), F.lit(i)) for i in (0, 1)]
    gts = [two(p, "gt") for p in "cmf"]
    cis = lambda c: [[(x["lo"], x["hi"]) for x in two(p, c)] for p in "cmf"]
    seq = S.by_sequence(*[two(p, "seqs") for p in "cmf"])
    out = t.withColumns(
        {"strict": (S.decimal if decimal else S.strict)(*gts), "pm1": S.plus_minus_one(*gts), "ci_95": S.by_ci(*cis("ci95"), widen), "ci_99": S.by_ci(*cis("ci99"), widen), "_seq": seq}
    )
    return out.withColumns({k: F.col(f"_seq.{k}") for k in ("seq", "sl", "sl_pm1")}).drop("_seq")


def with_kinds(t: DataFrame) -> DataFrame:
    """strict and pm1 for a trio of plain columns c0, c1, m0, m1, f0, f1."""
    gts = [[F.col(f"{p}0"), F.col(f"{p}1")] for p in "cmf"]
    return t.withColumns({"strict": S.strict(*gts), "pm1": S.plus_minus_one(*gts)})


def rate(kind: Column) -> Column:
    """Share of rows where the kind holds; nulls stay in the denominator."""
    return F.sum(F.coalesce(kind, F.lit(False)).cast("int")) / F.count("*")


def bernoulli(p: Column, n: Column) -> Column:
    """struct<se, lo, hi> of a rate; null without rows."""
    se = F.sqrt(F.try_divide(p * (1 - p), n))
    return F.struct(se.alias("se"), (p - 1.96 * se).alias("lo"), (p + 1.96 * se).alias("hi"))


def by_contig(t: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Counts of each kind for each contig and, with a null contig, overall."""
    return t.rollup("contig").agg(F.count("*").alias("n_total"), *[F.sum(F.coalesce(k, F.lit(False)).cast("int")).alias(k) for k in kinds])


def mismatches(t: DataFrame, kind: str = "strict") -> DataFrame:
    """Rows where the kind is known and doesn't hold."""
    return t.where(F.col(kind).isNotNull() & ~F.col(kind))


def length_histogram(t: DataFrame, width: int, kinds: tuple[str, ...] = ("strict",), start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """bin_start, n and the mean of each kind over loci of that length; every bin up to the longest locus."""
    span = F.col(end) - F.col(start)
    have = t.groupBy((F.floor(span / width) * width).alias("bin_start")).agg(F.count("*").alias("n"), *[rate(F.col(k)).alias(k) for k in kinds])
    bins = t.agg(F.max(span).alias("top")).select(F.explode(F.expr(f"sequence(0L, top + {width} - 1, {width}L)")).alias("bin_start"))
    return bins.join(have, "bin_start", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def trio_contigs(mother: DataFrame, father: DataFrame, child: DataFrame, sex: bool = False, catalog: DataFrame | None = None) -> DataFrame:
    """Contigs of all three, without sex chromosomes unless wanted, and of the catalog where one is given."""
    out = mother.select("contig").intersect(father.select("contig")).intersect(child.select("contig"))
    if not sex:
        out = out.where(~F.col("contig").isin(SEX))
    return out.intersect(catalog.select("contig")) if catalog is not None else out


def tsv(t: DataFrame) -> DataFrame:
    """Adds line: contig, start, end, motif and the three genotypes, tab-separated."""
    gts = [S.genotype_text(F.array(f"{p}0", f"{p}1"), "bigint") for p in "cmf"]
    return t.withColumn("line", F.concat_ws("\t", "contig", "start_pos", "end_pos", "motif", *gts))


def report(t: DataFrame, kinds: tuple[str, ...] = ("strict", "pm1")) -> DataFrame:
    """One JSON text: each kind's value, standard error and 95% interval, and the loci that were seen."""
    a = t.agg(F.count("*").alias("n"), *[rate(F.col(k)).alias(k) for k in kinds])
    parts = []
    for k in kinds:
        e = bernoulli(F.col(k), F.col("n"))
        parts.append(F.struct(F.round(k, 6).alias("val"), F.round(e["se"], 6).alias("stderr"), F.array(F.round(e["lo"], 6), F.round(e["hi"], 6)).alias("ci")).alias(k))
    return a.select(F.to_json(F.struct(*parts, F.col("n").alias("n_loci"))).alias("json"))


def summary(t: DataFrame, kinds: tuple[str, ...] = ("strict", "pm1")) -> DataFrame:
    """The text summary: a line for each kind with its rate in percent."""
    a = t.agg(*[rate(F.col(k)).alias(k) for k in kinds])
    return a.select(F.concat_ws("\n", *[F.concat(F.lit(f"MI% ({k}): "), F.format_string("%.2f", F.col(k) * 100)) for k in kinds]).alias("txt"))
