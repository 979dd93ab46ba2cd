"""Order without one task: rows are dealt to ranges by sampled bounds, numbered within each, and offset by earlier counts.

The bounds are literals of the plan, so every branch that uses them and every recomputation deals rows alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS = 200_000
MOST = 1024
STEP = 32


def buckets(rows: int) -> int:
    """How many ranges a table of so many rows gets."""
    return max(1, min(MOST, -(-rows // ROWS)))


def bucket_of(key: Column, bounds: Column, n: int) -> Column:
    """How many of n ascending bounds (an array) are less than the key, by a coarse and a fine step.

    The key is the one entry of an array: as a plain column the optimiser may put its whole expression (the parsing of a
    line, say) into the comparison with each bound."""

    def found(k: Column) -> Column:
        if n <= STEP:
            return F.size(F.filter(bounds, lambda b: b < k))
        coarse = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(n), F.lit(STEP)), lambda i: F.element_at(bounds, i)), lambda b: b < k))
        fine = F.transform(F.array(coarse), lambda c: F.when(c == 0, F.lit(0)).otherwise((c - 1) * STEP + F.size(F.filter(F.slice(bounds, F.greatest((c - 1) * STEP + 1, F.lit(1)), F.lit(STEP)), lambda b: b < k))))
        return F.get(fine, F.lit(0))

    return F.get(F.transform(F.array(key), found), F.lit(0))


def bounds_of(df: DataFrame, order: list[str], rows: int) -> tuple[Column, int]:
    """Bounds (an array of structs of the order columns) of near equal ranges, from a sample of about 48 rows a range."""
    n = buckets(rows)
    if n == 1:
        return F.array(), 0
    by = lambda r: [(x is not None, x) for x in r]
    got = sorted(df.select(*order).sample(min(1.0, 48 * n / rows), seed=7).collect(), key=by)
    cuts = sorted({tuple(got[len(got) * i // n]) for i in range(1, n)}, key=by) if got else []
    kinds = dict(df.dtypes)
    literal = lambda t: F.struct(*[F.lit(x).cast(kinds[c]).alias(f"o{i}") for i, (c, x) in enumerate(zip(order, t, strict=True))])
    return F.array(*[literal(t) for t in cuts]), len(cuts)


def ranged(df: DataFrame, order: list[str], name: str = "bucket") -> tuple[DataFrame, int]:
    """df with the range of each row, and the number of ranges."""
    bounds, n = bounds_of(df, order, df.count())
    key = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    return df.withColumn(name, bucket_of(key, bounds, n) if n else F.lit(0)), n + 1


def _offset(carry: list, kind: str) -> Column:
    """What comes before the range of a row."""
    return F.element_at(F.array(*[F.lit(x).cast(kind) for x in carry]).cast(f"array<{kind}>"), F.col("_part") + 1)


def accumulated(df: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """Adds the sum of the amount (whole numbers) over the rows before each row."""
    x, ranges = ranged(df.withColumn("_amount", amount.cast("long")), order, "_part")
    sums = {r["_part"]: r["n"] for r in x.groupBy("_part").agg(F.coalesce(F.sum("_amount"), F.lit(0)).alias("n")).collect()}  # a row for each range
    carry, total = [], 0
    for k in range(ranges):
        carry.append(total)
        total += sums.get(k, 0)
    inside = F.sum("_amount").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return x.withColumn(name, F.coalesce(inside, F.lit(0)) + _offset(carry, "bigint")).drop("_part", "_amount")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds line, 1 for the first row by the given order."""
    return accumulated(df, order, F.lit(1), "line").withColumn("line", F.col("line") + 1)


def filled(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the last value that isn't null (a text) up to and with each row."""
    x, ranges = ranged(df.withColumn("_value", value.cast("string")), order, "_part")
    last = {r["_part"]: r["v"] for r in x.where("_value is not null").groupBy("_part").agg(F.max_by("_value", F.struct(*order)).alias("v")).collect()}  # a row for each range
    carry, now = [], None
    for k in range(ranges):
        carry.append(now)
        now = last.get(k, now)
    inside = F.last("_value", True).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn(name, F.coalesce(inside, _offset(carry, "string"))).drop("_part", "_value")
