"""Interval joins by bins: contig and bin are equal, a pair counts in the bin of its larger start.

Catalyst turns a contig equality with a range into a sort-merge join with a residual filter, quadratic in each contig;
bins of about the median length leave an equi-join whose work follows the output. Intervals are 0-based and half open;
empty ones overlap nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 256


def binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    return df.where(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))


def overlap_join(a: DataFrame, b: DataFrame, contig: tuple[str, str], a_span: tuple[str, str], b_span: tuple[str, str], width: int = WIDTH, hint: str | None = None) -> DataFrame:
    """All overlapping pairs; the columns of a and b have different names. A hint ("merge") keeps wide rows, whose size
    is hard to estimate, from being broadcast."""
    (s, e), (t, u) = a_span, b_span
    x, y = binned(a, s, e, width), binned(b, t, u, width).withColumnRenamed("_bin", "_bin2")
    on = (F.col(contig[0]) == F.col(contig[1])) & (F.col("_bin") == F.col("_bin2"))
    pair = (F.col(s) < F.col(u)) & (F.col(t) < F.col(e)) & (F.col("_bin") == F.floor(F.greatest(s, t) / width))
    return x.join(y.hint(hint) if hint else y, on & pair).drop("_bin", "_bin2")


#: Widths grow by this factor; an interval of a level has at most so many bins there.
FACTOR = 64


def levelled(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Adds _level, _bin and _own: the bins of an interval at the level of its length, and those of all wider levels.

    Two intervals that overlap meet at the wider one's level, where that one has a bin of its own, so an interval of a
    hundred million bases has a few hundred bins and not one for each `width` bases.
    """
    widths = [width]
    while widths[-1] * FACTOR < 1 << 36:
        widths.append(widths[-1] * FACTOR)
    size = F.col(end) - F.col(start)
    level = sum(((size > w * FACTOR).cast("int") for w in widths[:-1]), F.lit(0))
    each = F.flatten(F.array(*[
        F.when(level <= k, F.transform(F.sequence(F.floor(F.col(start) / w), F.floor((F.col(end) - 1) / w)), lambda b, k=k: F.struct(F.lit(k).alias("level"), b.alias("bin"), (level == k).alias("own")))).otherwise(
            F.array().cast("array<struct<level:int,bin:bigint,own:boolean>>")
        ) for k, w in enumerate(widths)
    ]))
    x = df.where(F.col(start) < F.col(end)).withColumn("_z", F.explode(each))
    return x.select(*df.columns, F.col("_z.level").alias("_level"), F.col("_z.bin").alias("_bin"), F.col("_z.own").alias("_own"))


#: Places of a contig that are ordered in one task.
SPAN = 1 << 16


def overlap_keys(a: DataFrame, key: str, b: DataFrame, contig: tuple[str, str], a_span: tuple[str, str], b_span: tuple[str, str], span: int = SPAN) -> DataFrame:
    """The distinct keys of a that overlap something in b, by counts and not by pairs: what starts before an interval's
    end, less what has ended by its start, overlaps it. Running counts are of different places (whole numbers), within
    spans of a contig, so neither long intervals nor many at one place cost more than their rows."""
    (s, e), (t, u) = a_span, b_span
    mark = lambda at, starts, ends: F.struct(at.cast("long").alias("at"), F.lit(starts).cast("long").alias("s"), F.lit(ends).cast("long").alias("e"))
    probe = lambda at, sign: F.struct(at.cast("long").alias("at"), F.lit(sign).alias("sign"))
    asked = a.where(F.col(s) < F.col(e)).select(F.col(key), F.col(contig[0]).alias("_c"), F.explode(F.array(probe(F.col(e) - 1, 1), probe(F.col(s), -1))).alias("_z"))
    asked = asked.select(key, "_c", F.col("_z.at").alias("_at"), F.col("_z.sign").alias("_sign"))
    marks = b.where(F.col(t) < F.col(u)).select(F.col(contig[1]).alias("_c"), F.explode(F.array(mark(F.col(t), 1, 0), mark(F.col(u), 0, 1))).alias("_z"))
    marks = marks.select("_c", "_z.*").unionByName(asked.select("_c", F.col("_at").alias("at"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("e")))
    marks = marks.groupBy("_c", "at").agg(F.sum("s").alias("s"), F.sum("e").alias("e")).withColumn("_part", F.floor(F.col("at") / span))
    before = Window.partitionBy("_c").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each span
    parts = marks.groupBy("_c", "_part").agg(F.sum("s").alias("_s"), F.sum("e").alias("_e"))
    parts = parts.select("_c", "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_s", "_e")])
    upto = Window.partitionBy("_c", "_part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counts = marks.select("_c", "_part", F.col("at").alias("_at"), *[F.sum(c).over(upto).alias(c) for c in ("s", "e")]).join(parts, ["_c", "_part"])
    counts = counts.select("_c", "_at", (F.col("s") + F.col("_s")).alias("s"), (F.col("e") + F.col("_e")).alias("e"))
    each = asked.join(counts.hint("merge"), ["_c", "_at"]).select(key, F.when(F.col("_sign") > 0, F.col("s")).otherwise(-F.col("e")).alias("_n"))
    return each.groupBy(key).agg(F.sum("_n").alias("_n")).where("_n > 0").select(key)


def semi(a: DataFrame, key: str, b: DataFrame, *spans, width: int = SPAN) -> DataFrame:
    return a.join(overlap_keys(a, key, b, *spans, span=width).hint("merge"), key, "left_semi")


def anti(a: DataFrame, key: str, b: DataFrame, *spans, width: int = SPAN) -> DataFrame:
    return a.join(overlap_keys(a, key, b, *spans, span=width).hint("merge"), key, "left_anti")


def first_match(pairs: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One partner of each probe: the least by the given order."""
    best = Window.partitionBy(*key).orderBy(*order)
    return pairs.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def blocks(loci: DataFrame, size: int, gap: int = 20_000) -> DataFrame:
    """Adds block: a contig's loci in order of start, cut after `size` loci or a gap of more than `gap` bases."""
    order = Window.partitionBy("contig").orderBy("start_pos", "end_pos", "locus_index")
    island = loci.withColumn("_new", (F.col("start_pos") - F.lag("end_pos").over(order) > gap).cast("int"))
    island = island.withColumn("_island", F.coalesce(F.sum("_new").over(order), F.lit(0)))
    inside = Window.partitionBy("contig", "_island").orderBy("start_pos", "end_pos", "locus_index")
    return island.withColumn("block", F.floor((F.row_number().over(inside) - 1) / size)).withColumnRenamed("_island", "island").drop("_new")
