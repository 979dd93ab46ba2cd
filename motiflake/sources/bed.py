"""Tab-separated catalogs and intervals: lines with their order, rows whose last column has the motif, loci."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators.ranges import numbered


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (any increasing number) and value of a text file, in the file's order."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return numbered(raw, ["_f", "_b", "_i"]).select("line", "value")


def rows(lines: DataFrame) -> DataFrame:
    """line and cols (array) of the lines that are neither blank nor comments."""
    text = F.btrim("value", F.lit(" \t\n\x0b\f\r"))
    return lines.where((text != "") & ~text.startswith("#")).select("line", F.split(text, "\t").alias("cols"))


def last_column(value: Column, index: Column) -> Column:
    """struct<locus_id, motif, error> of a bare motif or of ID=..;MOTIF=.. in any case; the id is locus{index} if unset."""
    value = F.trim(value)
    pairs = F.transform(F.filter(F.split(value, "; *"), lambda p: p != ""), lambda p: F.split(p, " *= *"))
    bad = F.exists(pairs, lambda p: (F.size(p) != 2) | ~F.lower(F.trim(F.get(p, F.lit(0)))).isin("id", "motif") | (F.trim(F.coalesce(F.get(p, F.lit(1)), F.lit(""))) == ""))
    of = lambda k: F.get(F.transform(F.filter(pairs, lambda p: F.lower(F.trim(F.get(p, F.lit(0)))) == k), lambda p: F.trim(F.get(p, F.lit(1)))), F.lit(0))
    default = F.concat(F.lit("locus"), index.cast("string"))
    keyed = value.contains("=")
    motif = F.when(keyed, F.upper(of("motif"))).otherwise(value)
    error = F.when(value == "", "empty").when(keyed & bad, "bad key or value").when(keyed & of("motif").isNull(), "no motif")
    return F.struct(F.when(keyed, F.coalesce(of("id"), default)).otherwise(default).alias("locus_id"), motif.alias("motif"), error.alias("error"))


def loci(parsed: DataFrame, config: dict, fail: bool = True) -> DataFrame:
    """Loci of catalog rows: index (1 for the first row), id, contig, start, end, motif, n_alleles.

    Contigs of ploidy 0 or null go. A row that can't be a locus raises when the result is computed, or is kept with its
    error if fail is false.
    """
    n = numbered(parsed.withColumnRenamed("line", "_line"), ["_line"])
    col = lambda i: F.get("cols", F.lit(i))
    x = n.withColumn("_l", last_column(F.element_at("cols", -1), F.col("line")))
    x = x.select(
        F.col("line").alias("locus_index"), F.col("_l.locus_id").alias("locus_id"), col(0).alias("contig"), col(1).try_cast("long").alias("start"), col(2).try_cast("long").alias("end"),
        F.col("_l.motif").alias("motif"), S.ploidy(col(0), config).alias("n_alleles"),
        F.coalesce(F.when(F.size("cols") < 4, "fewer than four columns"), F.col("_l.error"), F.when(col(1).try_cast("long").isNull() | col(2).try_cast("long").isNull(), "coordinates aren't numbers")).alias("_e"),
    )
    x = x.withColumn("error", F.coalesce("_e", S.locus_error(F.col("start"), F.col("end"), F.col("motif")))).drop("_e").where("n_alleles > 0")
    if not fail:
        return x
    said = F.concat(F.lit("catalog row "), F.col("locus_index").cast("string"), F.lit(": "), F.col("error"))
    return x.withColumn("locus_id", F.when(F.col("error").isNull(), F.col("locus_id")).otherwise(F.raise_error(said))).drop("error")


def load_loci(spark: SparkSession, path: str, config: dict, fail: bool = True) -> DataFrame:
    return loci(rows(read_lines(spark, path)), config, fail)


def intervals(parsed: DataFrame, one_based: bool = False, unique: bool = True) -> DataFrame:
    """contig, start, end, rest; of rows with one span the last line stays if unique."""
    x = parsed.select("line", F.get("cols", F.lit(0)).alias("contig"), (F.get("cols", F.lit(1)).cast("long") - int(one_based)).alias("start"), F.get("cols", F.lit(2)).cast("long").alias("end"), F.slice("cols", 4, 1000).alias("rest"))
    if unique:
        w = Window.partitionBy("contig", "start", "end").orderBy(F.desc("line"))
        x = x.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return x


def sorted_rows(parsed: DataFrame) -> DataFrame:
    """Rows by their contig's first line, then start and end, with `place`."""
    c = F.get("cols", F.lit(0))
    x = parsed.withColumns({"_c": c, "_s": F.get("cols", F.lit(1)).cast("long"), "_e": F.get("cols", F.lit(2)).cast("long")})
    first = x.groupBy("_c").agg(F.min("line").alias("_first"))
    return numbered(x.withColumnRenamed("line", "_line").join(first, "_c"), ["_first", "_s", "_e", "_line"]).select(F.col("line").alias("place"), F.col("_line").alias("line"), "cols")


def contigs(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.get("cols", F.lit(0)).alias("contig")).distinct()


def catalog_hash(catalog: DataFrame) -> DataFrame:
    """One hash of a catalog, whatever the order of its loci: a digest of each contig's digests."""
    h = F.sha2(F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), "motif"), 256)
    part = F.substring(h, 1, 2)
    each = catalog.select(h.alias("h"), part.alias("p")).groupBy("p").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), ""), 256).alias("hash"))


def disease_loci(parsed: DataFrame) -> DataFrame:
    """Loci of a disease catalog's rows of ten columns: span, diseases and their inheritance (lists), gene, citations,
    the least pathogenic number of copies where the form says one, notes, id and motif."""
    col = lambda i: F.nullif(F.trim(F.get("cols", F.lit(i))), F.lit(""))
    last = last_column(F.get("cols", F.lit(9)), F.col("line"))
    return parsed.where(F.size("cols") == 10).select(
        col(0).alias("contig"), col(1).try_cast("long").alias("start"), col(2).try_cast("long").alias("end"), F.split(col(3), ";").alias("diseases"), F.split(col(4), ";").alias("inheritance"), col(5).alias("gene"),
        F.split(col(6), ";").alias("citations"), F.regexp_extract(col(7), r"CN>=(\d+)", 1).try_cast("int").alias("least_pathogenic"), col(8).alias("notes"), last["locus_id"].alias("locus_id"), last["motif"].alias("motif"),
    )


def bundled_disease_loci(spark: SparkSession) -> DataFrame:
    """The catalog of well-known loci that comes with the package (a dozen rows)."""
    from importlib import resources

    lines = resources.files("motiflake").joinpath("data/disease_loci.tsv").read_text().splitlines()
    return disease_loci(rows(spark.createDataFrame(list(enumerate(lines, 1)), "line long, value string")))
