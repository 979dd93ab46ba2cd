"""Column functions: genotype predicates, intervals, nucleotide codes and text forms."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-4

# Nucleotide codes with their bases; D repeats H as in the format this library exchanges data with.
IUPAC = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "ACT", "H": "ACT", "V": "ACG", "N": "ACGT"}
STANDARD_D = "AGT"
# The order of chromosomes.
CHROMOSOMES = [*(str(i) for i in range(1, 23)), *(f"chr{i}" for i in range(1, 23)), "chrX", "X", "chrY", "Y", "chrM", "M"]
# Which allele of the child comes from which allele of a parent.
PARENT_CONFIGS = [(0, 0), (0, 1), (1, 0), (1, 1)]


def code_of_bases(bases: Column, standard: bool = False) -> Column:
    """The code for an array of bases, whatever their order; null for other sets. Of equal sets the later code wins."""
    table = {v: k for k, v in ({**IUPAC, "D": STANDARD_D} if standard else IUPAC).items()}
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.array_join(F.array_sort(F.array_distinct(bases)), ""))


def bases_of_code(code: Column, standard: bool = False) -> Column:
    """The sorted bases of a code, as text; a plain base is itself."""
    table = {**{b: b for b in "ACGT"}, **IUPAC, **({"D": STANDARD_D} if standard else {})}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), code)


def chromosome_order(contig: Column) -> Column:
    """0-based place in the chromosome order; unknown contigs come last."""
    at = F.array_position(F.array(*map(F.lit, CHROMOSOMES)), contig)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(CHROMOSOMES)))


def valid_motif(motif: Column) -> Column:
    return motif.rlike("^[ACGTRYSWKMBDHVN]+$")


def locus_error(start: Column, end: Column, motif: Column) -> Column:
    """Why a locus is invalid, or null."""
    return F.when(start >= end, F.lit("start is not before end")).when(~valid_motif(motif), F.lit("invalid motif"))


def parse_ci(text: Column) -> Column:
    """'lo-hi' or 'lo,hi' -> struct<lo, hi>; null where it can't be read."""
    parts = F.regexp_extract_all(text, F.lit(r"^\s*(-?[0-9.]+)\s*[-,]\s*(-?[0-9.]+)\s*$"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"^\s*(-?[0-9.]+)\s*[-,]\s*(-?[0-9.]+)\s*$"), F.lit(2))
    lo, hi = (F.get(p, F.lit(0)).try_cast("double") for p in parts)
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))


def parse_cis(text: Column, separator: str = r"\|") -> Column:
    return F.transform(F.split(text, separator), parse_ci)


def numbers(text: Column, separator: str, kind: str = "int") -> Column:
    """An array of numbers; entries that aren't become null."""
    return F.transform(F.split(text, separator), lambda x: x.try_cast(kind))


def overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Whether two confidence intervals overlap, up to EPSILON."""
    return (b_hi - a_lo > -EPSILON) & (a_hi - b_lo > -EPSILON)


def strict(c: list[Column], m: list[Column], f: list[Column]) -> Column:
    """One allele is in the mother's and the other in the father's genotype."""
    has = lambda x, g: F.array_contains(F.array(*g), x)
    return (has(c[0], m) & has(c[1], f)) | (has(c[0], f) & has(c[1], m))


def _any_config(test, child: list, mother: list, father: list) -> Column:
    found = [test(child[k], mother[i]) & test(child[1 - k], father[j]) for k, (i, j) in product((0, 1), PARENT_CONFIGS)]
    out = found[0]
    for x in found[1:]:
        out = out | x
    return out


def decimal(c: list[Column], m: list[Column], f: list[Column], threshold: float = 0.5) -> Column:
    return _any_config(lambda x, y: F.abs(x - y) < threshold, c, m, f)


def by_ci(c: list[tuple], m: list[tuple], f: list[tuple], widen: float = 0.0) -> Column:
    """Any assignment of overlapping intervals; only the parents' are widened; null if any bound is null."""
    wide = lambda p: (p[0] - p[0] * widen, p[1] + p[1] * widen)
    known = F.lit(True)
    for lo, hi in [*c, *m, *f]:
        known = known & lo.isNotNull() & hi.isNotNull()
    return F.when(known, _any_config(lambda x, y: overlap(*x, *y), c, [wide(x) for x in m], [wide(x) for x in f]))


def plus_minus_one(c: list[Column], m: list[Column], f: list[Column]) -> Column:
    return by_ci([(x - 1, x + 1) for x in c], [(x, x) for x in m], [(x, x) for x in f])


def by_sequence(c: list[Column], m: list[Column], f: list[Column]) -> Column:
    """struct<seq, sl, sl_pm1>: sequences, their lengths, and lengths give or take one; null if a sequence is."""
    known = F.lit(True)
    for x in [*c, *m, *f]:
        known = known & x.isNotNull()
    lengths = [[F.length(x) for x in g] for g in (c, m, f)]
    return F.struct(F.when(known, strict(c, m, f)).alias("seq"), F.when(known, strict(*lengths)).alias("sl"), F.when(known, plus_minus_one(*lengths)).alias("sl_pm1"))


def mutation_source(mat_p: Column, pat_p: Column, level: float = 0.05) -> Column:
    return F.when((mat_p < level) & (pat_p < level), "both").when(mat_p < level, "mat").when(pat_p < level, "pat").otherwise("?")


def estimated_copies(start: Column, end: Column, motif: Column) -> Column:
    return F.bround((end - start) / F.length(motif)).cast("long")


def search_schedule(copies: Column, most: int = 250) -> Column:
    """struct<step, iterations, range> of the reference search."""
    row = lambda s, i, r: F.struct(F.lit(s).alias("step"), F.lit(i).alias("iterations"), F.lit(r).alias("range"))
    return F.when(copies < 200, row(1, most, 3)).when(copies < 1000, row(3, 200, 3)).when(copies < 2000, row(5, 150, 3)).otherwise(row(15, 50, 1))


def with_chr(contig: Column, chr_names: bool) -> Column:
    """The contig's name with or without chr."""
    if chr_names:
        return F.when(contig.startswith("chr"), contig).otherwise(F.concat(F.lit("chr"), contig))
    return F.regexp_replace(contig, "^chr", "")


def feature_id(attributes: Column, kind: Column, contig: Column, start: Column, end: Column) -> Column:
    """ID, else kind:exon_id for parts of a transcript, else kind:contig-start-end. attributes is a map."""
    # Kinds that are named by their exon.
    parts = ["five_prime_UTR", "three_prime_UTR", "UTR", "CDS", "start_codon", "stop_codon"]
    exon = F.when(kind.isin(parts), F.concat_ws(":", kind, F.try_element_at(attributes, F.lit("exon_id"))))
    exon = F.when(F.try_element_at(attributes, F.lit("exon_id")).isNotNull(), exon)
    return F.coalesce(F.try_element_at(attributes, F.lit("ID")), exon, F.concat(kind, F.lit(":"), contig, F.lit("-"), start.cast("string"), F.lit("-"), end.cast("string")))


def common_prefix(texts: Column) -> Column:
    """The longest common prefix of an array of texts."""
    n = F.array_min(F.transform(texts, F.length))
    good = F.filter(F.sequence(F.lit(0), n), lambda k: F.size(F.array_distinct(F.transform(texts, lambda t: F.substring(t, F.lit(1), k)))) == 1)
    return F.substring(F.get(texts, F.lit(0)), F.lit(1), F.array_max(good))


def genotype_text(values: Column, kind: str) -> Column:
    """Alleles joined by |; decimals with one place, nulls empty."""
    one = (lambda x: F.format_string("%.1f", x)) if kind == "double" else (lambda x: x.cast("string"))
    return F.array_join(F.transform(values, lambda x: F.coalesce(one(x), F.lit(""))), "|")


def ci_text(cis: Column) -> Column:
    """Intervals lo,hi joined by |."""
    return F.array_join(F.transform(cis, lambda c: F.concat_ws(",", c["lo"].cast("string"), c["hi"].cast("string"))), "|")


def locus_text(contig: Column, start: Column, end: Column, child: Column, mother: Column, father: Column, cis: tuple[Column, Column, Column] | None = None) -> Column:
    """contig:start-end (child: ..., mother: ..., father: ...), with the 95% intervals where they are known."""
    names = ("child", "mother", "father")
    said = []
    for i, g in enumerate((child, mother, father)):
        more = F.coalesce(F.concat(F.lit(" [95%: "), cis[i], F.lit("]")), F.lit("")) if cis else F.lit("")
        said.append(F.concat(F.lit(f"{names[i]}: "), g, more))
    return F.concat(contig, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" ("), F.concat_ws(", ", *said), F.lit(")"))


def allele_number(text: Column) -> Column:
    """'.' and what isn't a number are null."""
    return text.try_cast("int")


def flipped(a: Column, b: Column) -> Column:
    """Genotypes (arrays) that differ, one being the other reversed."""
    return (a != b) & (a == F.reverse(b))


def masked(bases: Column, quality: Column, least: int = 3) -> Column:
    """Bases of low quality as X; bases is text, quality an array."""
    return F.array_join(F.zip_with(F.split(bases, ""), quality, lambda b, q: F.when(q < least, F.lit("X")).otherwise(b)), "")


def composition_copies(seq: Column, motif: Column) -> Column:
    """Copies by base composition: the sequence's bases that the motif has, over the motif's length."""
    hits = F.size(F.filter(F.split(seq, ""), lambda b: F.instr(motif, b) > 0))
    return F.bround(hits / F.length(motif)).cast("long")


def ploidy(contig: Column, config: dict) -> Column:
    """Copies of a contig: the first override that matches whole, else null if ignored, else the default."""
    out = F.lit(config["default"]).cast("int")
    for pattern in config.get("ignore", []):
        out = F.when(contig.rlike(f"^(?:{pattern})$"), F.lit(None).cast("int")).otherwise(out)
    for pattern, n in reversed(list(config.get("overrides", {}).items())):
        out = F.when(contig.rlike(f"^(?:{pattern})$"), F.lit(n)).otherwise(out)
    return out
