"""Repeat-finder .dat files: contig headers filled forward over data lines of fifteen fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import filled, numbered

PREFIX = "Sequence: "


def parse(lines: DataFrame, ordered: bool = False) -> DataFrame:
    """line and cols (contig, start, end, "trf", fields 3 to 14) of a file's lines; starts become 0-based. Each data line
    has the contig of the last header before it; data before any header goes."""
    head = F.when(F.col("value").startswith(PREFIX), F.concat_ws("\t", F.col("line").cast("string"), F.trim(F.substr("value", F.lit(len(PREFIX) + 1)))))
    f = F.split(F.trim("value"), " ")
    x = filled(lines.select("line", "value"), ["line"], head, "_head").withColumn("f", f).where((F.size("f") == 15) & F.get("f", F.lit(0)).rlike("^[0-9]+$") & F.col("_head").isNotNull())
    x = x.select("line", "f", F.substring_index("_head", "\t", 1).cast("long").alias("_from"), F.substr("_head", F.instr("_head", F.lit("\t")) + 1).alias("contig"))
    start = (F.get("f", F.lit(0)).cast("long") - 1).cast("string")
    x = x.select("line", F.concat(F.array(F.col("contig"), start, F.get("f", F.lit(1)), F.lit("trf")), F.slice("f", 3, 12)).alias("cols"), "_from")
    if not ordered:
        return x.select("line", "cols")
    x = x.withColumns({"_s": F.get("cols", F.lit(1)).cast("long"), "_e": F.get("cols", F.lit(2)).cast("long"), "_line": F.col("line")}).drop("line")
    return numbered(x, ["_from", "_s", "_e", "_line"]).select("line", "cols")
