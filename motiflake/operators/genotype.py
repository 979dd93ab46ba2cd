"""Per-locus aggregates and gates over reads, in columns: depth, histograms, percentiles, SNV evidence, read distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GAP, OUTSIDE = "_", "-"


def depth(reads: DataFrame) -> DataFrame:
    """Mean reads of a called locus by contig and, with a null contig, overall."""
    per = reads.groupBy("contig", "locus_index").agg(F.count("*").alias("n"))
    return per.rollup("contig").agg((F.sum("n") / F.count("*")).alias("depth"))


def histogram_text(values: Column) -> Column:
    """valuexcount joined by |, in order of value, for an aggregated list of values."""
    v = F.array_sort(F.array_distinct(values))
    return F.array_join(F.transform(v, lambda x: F.concat(x.cast("string"), F.lit("x"), F.size(F.filter(values, lambda y: y == x)).cast("string"))), "|")


def decode_histogram(text: Column) -> Column:
    """The values of a valuexcount text."""
    return F.flatten(F.transform(F.split(text, r"\|"), lambda t: F.array_repeat(F.split(t, "x")[0].cast("int"), F.split(t, "x")[1].cast("int"))))


def halves(values: Column) -> Column:
    """Two lists from one: its entries in turn."""
    even = F.filter(values, lambda _, i: i % 2 == 0)
    return F.array(even, F.filter(values, lambda _, i: i % 2 == 1))


def most_common(df: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """The k commonest values of each group with their counts; of equal counts the smaller value is first."""
    n = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group).orderBy(F.desc("n"), value)
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def percentile(values: Column, q: float) -> Column:
    """The interpolated inverted empirical distribution of an aggregated list of numbers at q."""
    x = F.array_sort(values)
    n = F.size(values)
    t = F.greatest(F.lit(0.0), n * q - 1)
    lo = F.get(x, F.floor(t).cast("int"))
    hi = F.get(x, F.least(n - 1, F.floor(t).cast("int") + 1))
    return lo + (t - F.floor(t)) * (hi - lo)


def interval(values: Column, level: int) -> Column:
    """struct<lo, hi> of whole numbers: the 95 or 99 percent interval, halves rounded to even."""
    tail = {95: 0.025, 99: 0.005}[level]
    return F.struct(F.rint(percentile(values, tail)).cast("int").alias("lo"), F.rint(percentile(values, 1 - tail)).cast("int").alias("hi"))


def median_row(rows: Column) -> Column:
    """The upper median of an aggregated list of structs, by their first field."""
    return F.get(F.array_sort(rows), F.floor(F.size(rows) / 2).cast("int"))


def modal(column: str) -> Column:
    """The commonest value; the smallest of equally common ones."""
    return F.mode(column, True)


def gaussian(column: str) -> tuple[Column, Column]:
    return F.avg(column), F.var_pop(column)


#: A sequence is cut into pieces of so many k-mers: finding a place in a text costs as much as the text before it.
PIECE = 64


def kmers(df: DataFrame, seq: str, k: int, group: list[str]) -> DataFrame:
    """How often each k-mer of A, C, G and T stands in the sequences of a group."""
    runs = f"(?=([ACGT]{{{k},{PIECE + k - 1}}}))[ACGT]{{1,{PIECE}}}"  # each goes on for k - 1 letters of the next
    piece = df.select(*group, F.explode(F.regexp_extract_all(seq, F.lit(runs), F.lit(1))).alias("_p"))
    each = piece.select(*group, F.explode(F.transform(F.sequence(F.lit(1), F.length("_p") - k + 1), lambda i: F.substr(F.col("_p"), i, F.lit(k)))).alias("kmer"))
    return each.groupBy(*group, "kmer").agg(F.count("*").alias("n"))


def methylation(df: DataFrame, group: list[str], allele: str, m: str) -> DataFrame:
    """Mean of each allele's values, and whether every allele of the group has one."""
    per = df.groupBy(*group, allele).agg(F.avg(m).alias("am"), F.count(m).alias("_n"))
    return per.withColumn("usable", F.min("_n").over(Window.partitionBy(*group)) > 0).drop("_n")


def base_counts(snvs: DataFrame, quality: int = 20) -> DataFrame:
    """Reads of each base by locus, SNV and allele; gaps count at any quality and what lies outside never."""
    good = (F.col("base") == GAP) | ((F.col("base") != OUTSIDE) & (F.col("qual") >= quality))
    return snvs.where(good).groupBy("locus_index", "snv", "p").agg(F.count("*").alias("n"), *[F.sum((F.col("base") == b).cast("long")).alias(f"n_{x}") for b, x in zip("ACGT_", ["a", "c", "g", "t", "gap"], strict=True)])


def useful_snvs(snvs: DataFrame, least: int) -> DataFrame:
    """SNVs with at least two bases that `least` reads have."""
    n = snvs.where(~F.col("base").isin(GAP, OUTSIDE)).groupBy("locus_index", "snv", "base").agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= least).groupBy("locus_index", "snv").agg(F.count("*").alias("bases")).where("bases >= 2")


def snv_genotype(snvs: DataFrame, quality: int = 20) -> DataFrame:
    """The top base of each allele (ties: the first by letter), where both alleles have reads, differ, and neither has
    more than half its share of the other's base."""
    good = ~F.col("base").isin(GAP, OUTSIDE) & (F.col("qual") >= quality)
    n = snvs.where(good).groupBy("locus_index", "snv", "p", "base").agg(F.count("*").alias("n"))
    w = Window.partitionBy("locus_index", "snv", "p")
    n = n.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "base")))
    top = n.where("r = 1").select("locus_index", "snv", "p", "base", "share")
    a, b = (top.where(f"p = {k}").select("locus_index", "snv", F.col("base").alias(f"b{k}"), F.col("share").alias(f"s{k}")) for k in (0, 1))
    pair = a.join(b, ["locus_index", "snv"]).where("b0 <> b1")
    other = n.select("locus_index", "snv", "p", "base", F.col("share").alias("_x"))
    for k in (0, 1):
        cross = other.where(f"p = {1 - k}").select("locus_index", "snv", F.col("base").alias(f"b{k}"), F.col("_x").alias(f"x{k}"))
        pair = pair.join(cross, ["locus_index", "snv", f"b{k}"], "left")
    return pair.where("coalesce(x0, 0) <= s0 / 2 and coalesce(x1, 0) <= s1 / 2").select("locus_index", "snv", "b0", "b1")


def predicted_peak(value: Column, means: Column, weights: Column, stdevs: Column) -> Column:
    """The mixture component of most posterior weight; of equal ones the first."""
    sd = lambda s: F.when(s == 0, F.lit(1e-5)).otherwise(s)
    score = F.transform(
        F.arrays_zip(means.alias("m"), weights.alias("w"), stdevs.alias("s")),
        lambda c: F.log(c["w"]) - F.log(sd(c["s"])) - F.pow(value - c["m"], 2) / (2 * F.pow(sd(c["s"]), 2)),
    )
    return (F.array_position(score, F.array_max(score)) - 1).cast("int")


def read_distances(reads: DataFrame, quality: int = 20) -> DataFrame:
    """Distance of every two reads of a locus: SNVs in which they differ, and a tenth (with three comparable SNVs or
    more, else a fifth) of their difference in copies. reads has snvs array<struct<base, qual>> in the SNVs' order."""
    r = reads.select("locus_index", "read_name", "cn", "snvs")
    a = r.select("locus_index", F.col("read_name").alias("a"), F.col("cn").alias("cn_a"), F.col("snvs").alias("sa"))
    b = r.select("locus_index", F.col("read_name").alias("b"), F.col("cn").alias("cn_b"), F.col("snvs").alias("sb"))
    fine = lambda s: (s["base"] == GAP) | ((s["base"] != OUTSIDE) & (s["qual"] >= quality))
    both = F.filter(F.arrays_zip("sa", "sb"), lambda z: fine(z["sa"]) & fine(z["sb"]))
    pair = a.join(b, "locus_index").where("a < b").withColumn("_z", both)
    apart = F.size(F.filter("_z", lambda z: z["sa"]["base"] != z["sb"]["base"]))
    weight = F.when(F.size("_z") >= 3, F.lit(0.1)).otherwise(F.lit(0.2))
    return pair.select("locus_index", "a", "b", (apart + F.abs(F.col("cn_a") - F.col("cn_b")) * weight).alias("distance"))


def use_snvs(n: Column, any_snv: Column, two_snvs: Column) -> Column:
    """Whether SNVs may tell alleles apart: enough reads with two or more (then every read has two or none), or any."""
    return (two_snvs >= F.least(0.68 * n, F.lit(16))) | (any_snv >= F.least(0.8 * n, F.lit(16)))


def rare_realigned(reads: DataFrame) -> DataFrame:
    """By locus: how many reads were realigned, and whether one has a copy number that no other kind of read has."""
    lists = reads.groupBy("locus_index").agg(
        F.collect_set(F.when(F.col("realigned"), F.col("cn"))).alias("r"), F.collect_set(F.when(~F.col("realigned"), F.col("cn"))).alias("o"), F.sum(F.col("realigned").cast("long")).alias("n_realigned")
    )
    return lists.select("locus_index", "n_realigned", (F.size(F.array_except("r", "o")) > 0).alias("rare"), ((F.col("n_realigned") < 2) & (F.size(F.array_except("r", "o")) == 0)).alias("snvs_ok"))


def normalised_weights(reads: DataFrame) -> DataFrame:
    return reads.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("locus_index")))


def combined(calls: DataFrame, field: str) -> Column:
    """One list of a field over alleles, in order of allele; calls are aggregated structs (allele, field)."""
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("allele", field))), lambda x: x[field]))


def sub_seed(seed: int, locus: Column) -> Column:
    """A seed of 0 to 4095 for each locus, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), locus), F.lit(4096)).cast("int")


def capped_reads(reads: DataFrame, most: int, order: list[str]) -> DataFrame:
    """The first reads of each locus by the given order."""
    return reads.withColumn("_r", F.row_number().over(Window.partitionBy("locus_index").orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def flank_ok(start: Column, end: Column, left: Column, right: Column, one_suffices: bool = False) -> Column:
    a, b = start <= left, end >= right
    return (a | b) if one_suffices else (a & b)


def read_weight(lengths: Column, size: Column, own: Column | None = None) -> Column:
    """How much a read counts whose repeat with flanks has `size` bases, from the lengths of the reads at its locus: long
    repeats are seen whole by fewer reads. The reads that could hold it have the mean length m (with targeted sequencing
    the read's own length): (m + size - 2) / (m - size + 1); null if none could."""
    able = F.filter(lengths, lambda x: x >= size)
    m = own if own is not None else F.aggregate(able, F.lit(0.0), lambda a, x: a + x) / F.size(able)
    return F.when(F.size(able) > 0, (m + size - 2) / (m - size + 1))


def mean_quality(quals: Column) -> Column:
    return F.aggregate(quals, F.lit(0.0), lambda a, q: a + q) / F.size(quals)


def gated(n: Column, least: int, value: Column) -> Column:
    """The value where there are enough reads, else null."""
    return F.when(n >= least, value)


def phased_by_reads(reads: DataFrame, n_alleles: int = 2, least: int = 8) -> DataFrame:
    """By locus, whether haplotype tags can call it: enough tagged reads, one haplotype for each allele, and a phase set
    that most tagged reads share."""
    tagged = reads.where("hp is not null and ps is not null")
    per = tagged.groupBy("locus_index").agg(F.count("*").alias("n"), F.countDistinct("hp").alias("hps"))
    top = most_common(tagged, ["locus_index"], "ps", 1).select("locus_index", "ps", F.col("n").alias("n_ps"))
    return per.join(top, "locus_index").select("locus_index", "ps", ((F.col("n") >= least) & (F.col("hps") == n_alleles) & (F.col("n_ps") >= least)).alias("ok"))


def reference_ok(left: Column, right: Column, flank: int, motif_size: Column) -> Column:
    """Flanks of full size that don't touch the repeat with a motif's length of N."""
    n = F.repeat(F.lit("N"), motif_size)
    return (F.length(left) >= flank) & (F.length(right) >= flank) & ~F.endswith(left, n) & ~F.startswith(right, n)
