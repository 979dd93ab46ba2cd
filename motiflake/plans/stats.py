"""Queries over tests and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as T
from ..operators.ranges import numbered
from .fixtures import fixture, sql
from .registry import query

_R = "with r as (select id, p, row_number() over (order by p, id) i, count(*) over () m from pvalues) "
_LAST = "order by p desc, id desc rows between unbounded preceding and current row"
_FIRST = "order by p, id rows between unbounded preceding and current row"
ADJUSTED = {
    "none": "select id, p p_adj from r",
    "bonferroni": "select id, least(1, p*m) p_adj from r",
    "sidak": "select id, 1-power(1-p, m) p_adj from r",
    "holm": f"select id, least(1, max(p*(m-i+1)) over ({_FIRST})) p_adj from r",
    "holm-sidak": f"select id, least(1, max(1-power(1-p, m-i+1)) over ({_FIRST})) p_adj from r",
    "simes-hochberg": f"select id, least(1, min(p*(m-i+1)) over ({_LAST})) p_adj from r",
    "fdr_bh": f"select id, least(1, min(p*m/i) over ({_LAST})) p_adj from r",
    "fdr_by": f", c as (select sum(1.0e0/k) c from (select unnest(range(1, (select count(*) from pvalues)+1)) k)) select id, least(1, min(p*m*c/i) over ({_LAST})) p_adj from r, c",
    "fdr_tsbh": f", b as (select id, p, m, least(1, min(p*m/i) over ({_LAST})) q from r), h as (select count(*) filter (where q<=0.05e0) hits from b) select id, least(1, q*case when hits>0 and hits<m then (m-hits)*1.0e0/m else 1 end) p_adj from b, h",
    "fdr_tsbky": f", b as (select id, p, m, least(1, min(p*m/i) over ({_LAST})) q from r), h as (select count(*) filter (where q<=0.05e0/1.05e0) hits from b) select id, least(1, q*case when hits>0 and hits<m then (m-hits)*1.0e0/m else 1 end*1.05e0) p_adj from b, h",
}


def _adjusted(method):
    return lambda spark, sf: T.adjust(fixture(spark, sf, "pvalues"), method).select("id", F.round("p_adj", 6).alias("p_adj"))


for _m, _s in ADJUSTED.items():
    query(f"a18_w07_adjust_{_m.replace('-', '_')}", "select id, round(cast(p_adj as double), 6) p_adj from (" + sql(_R + _s, "pvalues") + ")")(_adjusted(_m))


@query("p14_significant_loci", "select count(*) n from (" + sql(_R + ADJUSTED["fdr_bh"], "pvalues") + ") where p_adj<0.05")
def significant_loci(spark, sf):
    return T.significant(T.adjust(fixture(spark, sf, "pvalues"), "fdr_bh")).agg(F.count("*").alias("n"))


@query("o02_sorted_by_p", "select id, row_number() over (order by round(cast(p_adj as double), 12), id) rk from (" + sql(_R + ADJUSTED["fdr_bh"], "pvalues") + ")")
def sorted_by_p(spark, sf):
    x = T.adjust(fixture(spark, sf, "pvalues"), "fdr_bh").select("id", F.round("p_adj", 12).alias("p"))
    return numbered(x, ["p", "id"]).select("id", F.col("line").alias("rk"))


_SIDES = "with s as (select locus_index, cast(smp=0 as int) child, cn from reads), "
_CHI = _SIDES + "c as (select locus_index, cn, sum(child)*1.0e0 n1, sum(1-child)*1.0e0 n0 from s group by 1,2), t as (select locus_index, sum(n0) t0, sum(n1) t1, count(*) k from c group by 1) select locus_index, round(sum(power(n0-t0*(n0+n1)/(t0+t1),2)/(t0*(n0+n1)/(t0+t1))+power(n1-t1*(n0+n1)/(t0+t1),2)/(t1*(n0+n1)/(t0+t1))),6) chi2, max(k) k from c join t using (locus_index) where t0>0 and t1>0 group by 1"


@query("f12_chi2_statistic", sql(_CHI, "reads"))
def chi2_statistic(spark, sf):
    r = fixture(spark, sf, "reads").withColumn("child", (F.col("smp") == 0).cast("int"))
    return T.chi2_statistic(r, "locus_index", "child", "cn").select("locus_index", F.round("chi2", 6).alias("chi2"), "k")


_U = _SIDES + "c as (select locus_index, cn, sum(child) n1, sum(1-child) n0 from s group by 1,2), k as (select *, coalesce(sum(n0+n1) over (partition by locus_index order by cn rows between unbounded preceding and 1 preceding),0)+(n0+n1+1)/2.0e0 mid from c) select locus_index, sum(mid*n0)-sum(n0)*(sum(n0)+1)/2.0e0 u, cast(sum(n0) as bigint) n0, cast(sum(n1) as bigint) n1 from k group by 1"


@query("f13_rank_sums", sql(_U, "reads"))
def rank_sums(spark, sf):
    r = fixture(spark, sf, "reads").withColumn("child", (F.col("smp") == 0).cast("int"))
    return T.rank_sums(r, "locus_index", "child", "cn")


def trio_reads(spark, sf):
    """One row for each locus with the reads of both alleles of child, mother and father."""
    r = fixture(spark, sf, "reads").groupBy("locus_index", "smp").agg(*[F.array_sort(F.collect_list(F.when(F.col("p") == k, F.col("cn")))).alias(f"r{k}") for k in (0, 1)])
    r = r.select("locus_index", "smp", F.array("r0", "r1").alias("reads"))
    side = lambda k, name: r.where(f"smp = {k}").select("locus_index", F.col("reads").alias(name))
    return side(0, "c_reads").join(side(1, "m_reads"), "locus_index").join(side(2, "f_reads"), "locus_index")


def _de_novo(test):
    return lambda spark, sf: T.de_novo_tests(trio_reads(spark, sf), test).select("locus_index", F.round("p", 9).alias("p"), "config", "mutation_from")


for _t in ("x2", "wmw", "wmw-gt"):
    query(f"a17_f14_f15_de_novo_{_t.replace('-', '_')}")(_de_novo(_t))
