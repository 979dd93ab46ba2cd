"""GFF3 and GTF annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import feature_id


def parse(lines: DataFrame, gtf: bool) -> DataFrame:
    """contig, kind, start (0-based), end, attributes (map), fid."""
    x = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 9)
    pair = r'\s*([^\s;]+)\s+"([^"]*)"' if gtf else r"\s*([^=;]+)=([^;]*)"
    keys, values = (F.regexp_extract_all(F.get("c", F.lit(8)), F.lit(pair), F.lit(i)) for i in (1, 2))
    first = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e, i: F.array_position(keys, e["k"]) == i + 1)
    x = x.select(
        F.get("c", F.lit(0)).alias("contig"), F.get("c", F.lit(2)).alias("kind"), (F.get("c", F.lit(3)).cast("long") - 1).alias("start"), F.get("c", F.lit(4)).cast("long").alias("end"),
        F.map_from_entries(F.transform(first, lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value")))).alias("attributes"),
    )
    return x.withColumn("fid", feature_id(F.col("attributes"), F.col("kind"), F.col("contig"), F.col("start"), F.col("end")))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path), ".gtf" in path.rsplit("/", 1)[-1])
