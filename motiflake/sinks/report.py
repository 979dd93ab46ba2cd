"""JSON reports: a header, one line for each locus, and a summary; and look-ups in a report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.genotype import depth


def result_lines(called: DataFrame) -> DataFrame:
    """locus_index and one JSON object for each locus, nulls left out."""
    return called.select("locus_index", F.to_json(F.struct(*called.columns)).alias("json"))


def write(called: DataFrame, path: str, params: dict, sample: str | None) -> None:
    """results as JSON lines in order of locus, contigs as a table, and metadata as one JSON object."""
    called.repartitionByRange("locus_index").sortWithinPartitions("locus_index").write.json(f"{path}/results")
    spark = called.sparkSession
    spark.read.schema("contig string").json(f"{path}/results").distinct().write.json(f"{path}/contigs")
    meta = json.dumps({"sample_id": sample, "parameters": params})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/metadata")


def read_depth(reads: DataFrame) -> DataFrame:
    return depth(reads)


def metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata").first()["value"])


def search(loci: DataFrame, text: str | None = None, most: int = 10) -> DataFrame:
    """Loci whose contig:start-end holds the text (the text in lower case, as typed by users), else the first ones."""
    name = F.concat("contig", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    if text:
        return loci.where(name.contains(text.lower()))
    return loci.orderBy("locus_index").limit(most)


def call_data(loci: DataFrame, index: int) -> DataFrame:
    return loci.where(F.col("locus_index") == index)
