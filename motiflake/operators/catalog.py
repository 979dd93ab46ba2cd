"""Catalog conversions between formats, and the union of catalogs. Rows are (line, cols); results are text lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranges import numbered

TAB = "\t"


def _first3() -> list:
    return [F.get("cols", F.lit(i)) for i in range(3)]


def _motif():
    return F.element_at("cols", -1)


def bed4(rows: DataFrame) -> DataFrame:
    return rows.select("line", F.concat_ws(TAB, *_first3(), _motif()).alias("value"))


def gangstr(rows: DataFrame) -> DataFrame:
    return rows.select("line", F.concat_ws(TAB, *_first3(), F.length(_motif()).cast("string"), _motif()).alias("value"))


def hipstr(rows: DataFrame) -> DataFrame:
    """Needs six columns; the sixth is rounded, halves to even."""
    copies = F.bround(F.get("cols", F.lit(5)).cast("double")).cast("long").cast("string")
    return rows.select("line", F.concat_ws(TAB, *_first3(), F.length(_motif()).cast("string"), copies).alias("value"))


def same(rows: DataFrame) -> DataFrame:
    return rows.select("line", F.array_join("cols", TAB).alias("value"))


def trgt(rows: DataFrame) -> DataFrame:
    """rows have place, 0 for the first."""
    m = _motif()
    return rows.select("line", F.concat_ws(TAB, *_first3(), F.concat(F.lit("ID=locus"), F.col("place").cast("string"), F.lit(";MOTIFS="), m, F.lit(";STRUC=("), m, F.lit(")n"))).alias("value"))


def expansionhunter(rows: DataFrame) -> DataFrame:
    """A JSON object for each locus; rows have place, 0 for the first."""
    c = _first3()
    o = F.struct(
        F.concat(F.lit("Locus"), (F.col("place") + 1).cast("string")).alias("LocusId"), F.concat(F.lit("("), _motif(), F.lit(")*")).alias("LocusStructure"),
        F.concat(c[0], F.lit(":"), c[1], F.lit("-"), c[2]).alias("ReferenceRegion"), F.lit("Repeat").alias("VariantType"),
    )
    return rows.select("line", F.to_json(o).alias("value"))


def from_trgt(rows: DataFrame, with_id: bool = False) -> DataFrame:
    """One motif for each locus: several motifs of one length that only alternate become codes, else the first is taken
    (column simple says which); a motif of half the length counts twice."""
    info = F.str_to_map(F.get("cols", F.lit(3)), F.lit(";"), F.lit("="))
    x = rows.withColumn("_i", info).withColumn("_m", F.split(F.try_element_at("_i", F.lit("MOTIFS")), ","))
    longest = F.array_max(F.transform("_m", F.length))
    x = x.withColumn("_n", longest)
    half = F.forall("_m", lambda m: (F.length(m) == F.col("_n")) | (F.length(m) == F.floor(F.col("_n") / 2)))
    x = x.withColumn("_m", F.when(half, F.transform("_m", lambda m: F.when(F.length(m) == F.col("_n"), m).otherwise(F.concat(m, m)))).otherwise(F.col("_m")))
    struc, locus = F.try_element_at("_i", F.lit("STRUC")), F.try_element_at("_i", F.lit("ID"))
    plain = (struc == F.array_join(F.transform("_m", lambda m: F.concat(F.lit("("), m, F.lit(")n"))), "")) | (struc == F.concat(F.lit("<"), locus, F.lit(">"))) | (struc == "<TR>")
    one_length = F.forall("_m", lambda m: F.length(m) == F.col("_n"))
    code = F.transform(
        F.sequence(F.lit(1), F.col("_n")),
        lambda i: F.get(
            F.transform(
                F.array(F.array_distinct(F.transform("_m", lambda m: F.substr(m, i, F.lit(1))))),
                lambda b: F.when(F.size(b) == 1, F.get(b, F.lit(0))).otherwise(S.code_of_bases(b)),
            ),
            F.lit(0),
        ),
    )
    x = x.withColumn("_c", F.when((F.size("_m") > 1) & plain & one_length, code))
    good = F.col("_c").isNotNull() & F.forall("_c", lambda b: b.isNotNull())
    motif = F.when(good, F.array_join("_c", "")).otherwise(F.get("_m", F.lit(0)))
    last = F.when(F.lit(with_id) & locus.isNotNull(), F.concat(F.lit("ID="), locus, F.lit(";MOTIF="), motif)).otherwise(motif)
    return x.select("line", F.concat_ws(TAB, *_first3(), last).alias("value"), (good | (F.size("_m") == 1)).alias("simple"))


#: (from, to) -> rows -> lines; "bed" is any catalog whose last column is the motif
CONVERTERS: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {
    ("trf", "trf"): same,
    ("bed", "expansionhunter"): expansionhunter,
    ("bed", "hipstr"): hipstr,
    ("bed", "gangstr"): gangstr,
    ("bed", "repeathmm"): same,
    ("bed", "bed4"): bed4,
    ("bed", "straglr"): bed4,
    ("bed", "own"): bed4,
    ("bed", "tandem-genotypes"): bed4,
    ("bed", "trgt"): trgt,
    ("trgt", "straglr"): from_trgt,
    ("trgt", "own"): lambda rows: from_trgt(rows, True),
    ("trgt", "tandem-genotypes"): from_trgt,
}


def convert(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Lines (line, value) of rows in another format; ValueError for a pair that isn't known."""
    kind = source if (source, target) in CONVERTERS else "bed" if source in ("bed4", "trf") else source
    if (kind, target) not in CONVERTERS:
        raise ValueError(f"can't convert {source} to {target}")
    if target in ("trgt", "expansionhunter") and "place" not in rows.columns:
        rows = numbered(rows.withColumnRenamed("line", "_line"), ["_line"]).select(F.col("_line").alias("line"), "cols", (F.col("line") - 1).alias("place"))
    return CONVERTERS[kind, target](rows)


def combine(catalogs: list[DataFrame]) -> DataFrame:
    """Distinct (contig, start, end, motif) of several catalogs' rows."""
    out = None
    for rows in catalogs:
        x = rows.select(F.get("cols", F.lit(0)).alias("contig"), F.get("cols", F.lit(1)).cast("long").alias("start"), F.get("cols", F.lit(2)).cast("long").alias("end"), _motif().alias("motif"))
        out = x if out is None else out.unionByName(x)
    return out.distinct()


def ordered(catalog: DataFrame) -> DataFrame:
    """In chromosome order, then start, end and motif."""
    return catalog.orderBy(S.chromosome_order(F.col("contig")), "start", "end", "motif")
