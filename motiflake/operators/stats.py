"""Tests between read sets, and corrections for many tests that don't sort all rows in one task."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import PARENT_CONFIGS
from .ranges import bucket_of
from .ranges import buckets as bucket_count

METHODS = ("none", "bonferroni", "sidak", "holm-sidak", "holm", "simes-hochberg", "fdr_bh", "fdr_by", "fdr_tsbh", "fdr_tsbky")


def ranked(df: DataFrame, p: str = "p", buckets: int | None = None) -> tuple[DataFrame, int]:
    """Each different p with its count n, the rows before it, and a bucket of near values; and the number of rows.

    Equal p-values have equal adjusted values, so they are one row here, and running extremes work by bucket: only one
    row for each bucket is ever ordered in one task.
    """
    each = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.count("*").alias("n"))
    rows, m = each.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    k = buckets or bucket_count(rows)
    cuts = (each.agg(F.percentile_approx("p", [i / k for i in range(1, k)], 10 * k)).first()[0] if k > 1 else None) or []
    cuts = sorted(set(map(float, cuts)))
    each = each.withColumn("bucket", bucket_of(F.col("p"), F.array(*map(F.lit, cuts)), len(cuts)) if cuts else F.lit(0))
    sizes = {r["bucket"]: r["n"] for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # a row for each bucket
    earlier, total = [], 0
    for i in range(len(cuts) + 1):
        earlier.append(total)
        total += sizes.get(i, 0)
    inside = Window.partitionBy("bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.element_at(F.array(*map(F.lit, earlier)).cast("array<bigint>"), F.col("bucket") + 1)
    return each.select("p", "n", "bucket", (offset + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before")), m


def harmonic(m: int) -> float:
    """1 + 1/2 + ... + 1/m: the first terms, and the asymptotic series for the rest, exact to double precision."""
    few = min(m, 1000)
    head = math.fsum(1 / i for i in range(1, few + 1))
    tail = lambda n: math.log(n) + 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4)
    return head + (tail(m) - tail(few) if m > few else 0.0)


def running(df: DataFrame, value: str, down: bool) -> DataFrame:
    """Adds adj: the running maximum of value in order of p (down), or the running minimum from the largest p."""
    f, order = (F.max, F.asc) if down else (F.min, F.desc)
    inside = Window.partitionBy("bucket").orderBy(order("p")).rowsBetween(Window.unboundedPreceding, 0)
    best = df.groupBy("bucket").agg(f(value).alias("_v"))
    best = best.withColumn("_other", f("_v").over(Window.orderBy(order("bucket")).rowsBetween(Window.unboundedPreceding, -1))).drop("_v")
    both = F.greatest if down else F.least
    return df.withColumn("_own", f(value).over(inside)).join(best, "bucket").withColumn("adj", both("_own", "_other")).drop("_own", "_other")


def adjust(df: DataFrame, method: str, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Adds p_adj to every row (null where p is); method is one of METHODS."""
    if method not in METHODS:
        raise ValueError(f"method has to be one of {', '.join(METHODS)}")
    if method == "none":
        return df.withColumn("p_adj", F.col(p))
    r, m = ranked(df, p)
    first, last = F.col("before") + 1, F.col("before") + F.col("n")
    x = F.col("p")
    if method in ("bonferroni", "sidak"):
        r = r.withColumn("adj", x * m if method == "bonferroni" else 1 - F.pow(1 - x, F.lit(m)))
    elif method in ("holm", "holm-sidak"):
        left = F.lit(m) - first + 1
        r = running(r.withColumn("_v0", x * left if method == "holm" else 1 - F.pow(1 - x, left)), "_v0", True)
    elif method == "simes-hochberg":
        r = running(r.withColumn("_v0", x * (F.lit(m) - last + 1)), "_v0", False)
    else:
        factor = harmonic(m) if method == "fdr_by" else 1.0
        r = running(r.withColumn("_v0", x * (factor * m) / last), "_v0", False)
        if method in ("fdr_tsbh", "fdr_tsbky"):
            bky = method == "fdr_tsbky"
            level = alpha / (1 + alpha) if bky else alpha
            hits = r.where(F.least("adj", F.lit(1.0)) <= level).agg(F.sum("n")).first()[0] or 0
            scale = ((m - hits) / m if 0 < hits < m else 1.0) * ((1 + alpha) if bky else 1.0)
            r = r.withColumn("adj", F.least("adj", F.lit(1.0)) * scale)
    r = r.select(F.col("p").alias("_p"), F.least("adj", F.lit(1.0)).alias("p_adj"))
    return df.join(r, df[p] == F.col("_p"), "left").drop("_p")


def significant(df: DataFrame, level: float = 0.05, column: str = "p_adj") -> DataFrame:
    return df.where(F.col(column) < level)


# --- distributions ---


def gamma_q(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function."""
    if x <= 0 or a <= 0:
        return 1.0
    log_scale = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:  # series for the lower part
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * math.exp(log_scale)
    b, c = x + 1 - a, 1e300  # continued fraction for the upper part
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(log_scale)


def chi2_sf(x: float, df: int) -> float:
    return gamma_q(df / 2, x / 2)


def chi2_test(a: np.ndarray, b: np.ndarray) -> float:
    """p of a 2 x K table of the values' counts, without continuity correction."""
    values = np.unique(np.concatenate([a, b]))
    if len(values) < 2:
        return 1.0
    table = np.array([[(s == v).sum() for v in values] for s in (a, b)], float)
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    return chi2_sf(float(((table - expected) ** 2 / expected).sum()), len(values) - 1)


def _u_counts(m: int, n: int) -> np.ndarray:
    """How many orders of m and n different values have each U: the coefficients of a Gaussian binomial."""
    out = np.zeros(m * n + 1)
    out[0] = 1
    for i in range(1, m + 1):
        for k in range(len(out) - 1, n + i - 1, -1):
            out[k] -= out[k - n - i]
        for k in range(i, len(out)):
            out[k] += out[k - i]
    return out


def mann_whitney(x: np.ndarray, y: np.ndarray, alternative: str = "two-sided") -> float:
    """p of the U test without continuity correction: exact for small samples without ties, else normal."""
    m, n = len(x), len(y)
    both = np.concatenate([x, y])
    values, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
    mid = np.cumsum(counts) - (counts - 1) / 2
    u = float(mid[inverse][:m].sum()) - m * (m + 1) / 2
    if min(m, n) <= 8 and counts.max() == 1:
        share = _u_counts(m, n) / math.comb(m + n, m)
        more = float(share[math.ceil(u) :].sum())
        less = float(share[: math.floor(u) + 1].sum())
        return more if alternative == "greater" else min(1.0, 2 * min(more, less))
    size = m + n
    ties = float((counts.astype(float) ** 3 - counts).sum())
    sd = math.sqrt(m * n / 12 * (size + 1 - ties / (size * (size - 1))))
    if sd == 0:
        return math.nan
    z = (u - m * n / 2) / sd
    tail = lambda v: 0.5 * math.erfc(v / math.sqrt(2))
    return tail(z) if alternative == "greater" else min(1.0, 2 * tail(abs(z)))


def de_novo(child: list, mother: list, father: list, test: str = "x2", level: float = 0.05) -> tuple[float | None, str | None, str | None]:
    """(p, configuration, source) of the likeliest inheritance of two alleles' reads; nulls where a set is missing.

    test: x2, wmw, wmw-gt (parents larger), wmw-lt (child larger).
    """
    sides = (child, mother, father)
    if any(s is None or len(s) < 2 for s in sides):
        return None, None, None
    child, mother, father = ([np.asarray(r, float) for r in s] for s in sides)
    mine, best, which = np.concatenate(child), -1.0, None
    for i, j in PARENT_CONFIGS:
        theirs = np.concatenate([mother[i], father[j]])
        if not len(mother[i]) or not len(father[j]) or not len(mine):
            return None, None, None
        if test != "x2" and len(set(mine)) == 1 and set(mine) == set(theirs):
            return None, None, None
        if test == "x2":
            p = chi2_test(mine, theirs)
        elif test == "wmw-lt":
            p = mann_whitney(mine, theirs, "greater")
        else:
            p = mann_whitney(theirs, mine, "greater" if test == "wmw-gt" else "two-sided")
        if p > best:
            best, which = p, (i, j)
    if which is None:
        return None, None, None
    source = "none"
    if best < level:
        m, f = mother[which[0]], father[which[1]]
        apart = [abs(child[k].mean() - m.mean()) + abs(child[1 - k].mean() - f.mean()) if len(child[0]) and len(child[1]) else 0.0 for k in (0, 1)]
        if apart[0] == apart[1]:
            source = "?"
        else:
            k = int(apart[1] < apart[0])
            a, b = mann_whitney(m, child[k]) < level, mann_whitney(f, child[1 - k]) < level
            source = "both" if a and b else "mat" if a else "pat" if b else "?"
    return float(best), f"{which[0]}{which[1]}", source


def de_novo_tests(trios: DataFrame, test: str = "x2", level: float = 0.05) -> DataFrame:
    """Adds p, config and mutation_from to rows with c_reads, m_reads and f_reads (array<array<int>> each)."""

    @F.pandas_udf("p double, config string, mutation_from string")
    def run(c: pd.Series, m: pd.Series, f: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([de_novo(x, y, z, test, level) for x, y, z in zip(c, m, f, strict=True)], columns=["p", "config", "mutation_from"])

    return trios.withColumn("_t", run("c_reads", "m_reads", "f_reads")).select(*trios.columns, "_t.*")


def chi2_statistic(reads: DataFrame, group: str, side: str, value: str) -> DataFrame:
    """The 2 x K statistic and K for each group, from counts of values on two sides, natively."""
    cells = reads.groupBy(group, value).agg(*[F.sum((F.col(side) == s).cast("double")).alias(f"n{s}") for s in (0, 1)])
    per = cells.groupBy(group).agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count("*").alias("k"))
    x = cells.join(per, group)
    total = F.col("t0") + F.col("t1")
    part = [F.pow(F.col(f"n{s}") - F.col(f"t{s}") * (F.col("n0") + F.col("n1")) / total, 2) / (F.col(f"t{s}") * (F.col("n0") + F.col("n1")) / total) for s in (0, 1)]
    return x.where("t0 > 0 and t1 > 0").groupBy(group).agg(F.sum(part[0] + part[1]).alias("chi2"), F.max("k").alias("k"))


def rank_sums(reads: DataFrame, group: str, side: str, value: str) -> DataFrame:
    """U of side 0 against side 1 for each group, with ties at their mean rank."""
    cells = reads.groupBy(group, value).agg(*[F.sum((F.col(side) == s).cast("long")).alias(f"n{s}") for s in (0, 1)])
    before = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    all_before = F.coalesce(F.sum(F.col("n0") + F.col("n1")).over(before), F.lit(0))
    mid = all_before + (F.col("n0") + F.col("n1") + 1) / 2
    ranks = cells.withColumn("_r", mid * F.col("n0")).groupBy(group).agg(F.sum("_r").alias("r"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return ranks.select(group, (F.col("r") - F.col("n0") * (F.col("n0") + 1) / 2).alias("u"), "n0", "n1")
