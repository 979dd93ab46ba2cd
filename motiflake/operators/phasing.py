"""Phase sets: links between loci with or without a flip, joined for each contig with parity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(links: list[tuple[int, int, bool]]) -> dict[int, tuple[int | None, bool]]:
    """(root, flip) of each phase set; root is the smallest of its component, or None if flips contradict each other."""
    parent: dict[int, int] = {}
    odd: dict[int, bool] = {}
    broken: set[int] = set()

    def find(x: int) -> tuple[int, bool]:
        parent.setdefault(x, x)
        odd.setdefault(x, False)
        path, flip = [], False
        while parent[x] != x:
            path.append(x)
            x = parent[x]
        for y in reversed(path):
            flip ^= odd[y]
            odd[y], parent[y] = flip, x
        return x, flip

    for a, b, f in sorted(links):
        (x, i), (y, j) = find(a), find(b)
        if x == y:
            if i ^ j != f:
                broken.add(x)
            continue
        x, y = min(x, y), max(x, y)
        parent[y], odd[y] = x, i ^ j ^ f
        if y in broken:
            broken.add(x)
    out = {}
    for x in list(parent):
        root, flip = find(x)
        out[x] = (None, False) if root in broken else (root, flip)
    return out


def components(links: DataFrame) -> DataFrame:
    """contig, ps, root, flip of links (contig, a, b, flip); root is null where flips contradict. A contig is one group:
    there are few phase sets to a contig, not one for each locus."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = resolve(list(zip(pdf["a"], pdf["b"], pdf["flip"], strict=True)))
        return pd.DataFrame([(pdf["contig"].iloc[0], k, r, f) for k, (r, f) in got.items()], columns=["contig", "ps", "root", "flip"]).astype({"root": "Int64"})

    return links.select("contig", "a", "b", "flip").distinct().groupBy("contig").applyInPandas(run, "contig string, ps long, root long, flip boolean")


def rephased(calls: DataFrame, found: DataFrame, fields: list[str]) -> DataFrame:
    """Calls (contig, ps, and array fields by allele) in their component's phase set, reversed where it is flipped."""
    names = calls.columns
    x = calls.join(found.withColumn("_known", F.lit(True)), ["contig", "ps"], "left")
    turn = F.coalesce("flip", F.lit(False))
    new = {f: F.when(turn, F.reverse(f)).otherwise(F.col(f)) for f in fields}
    return x.withColumns(new | {"ps": F.when(F.col("_known"), F.col("root")).otherwise(F.col("ps"))}).select(*names)


def global_ids(reads: DataFrame) -> DataFrame:
    """Adds ps_id: whole numbers for each (contig, ps) of haplotype-tagged reads, in their order within the contig, made
    unique by the contig's offset (few contigs are ordered, not all reads)."""
    from pyspark.sql.window import Window

    each = reads.where("ps is not null").select("contig", "ps").distinct()
    each = each.withColumn("_n", F.row_number().over(Window.partitionBy("contig").orderBy("ps")))
    size = each.groupBy("contig").agg(F.max("_n").alias("_k"))
    size = size.withColumn("_o", F.coalesce(F.sum("_k").over(Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ids = each.join(size, "contig").select("contig", "ps", (F.col("_o") + F.col("_n")).alias("ps_id"))
    return reads.join(ids, ["contig", "ps"], "left")


