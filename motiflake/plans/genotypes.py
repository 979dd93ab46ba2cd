"""Queries over per-locus read aggregates and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genotype as G
from ..operators.ranges import numbered
from .fixtures import fixture, sql
from .registry import query

_BASE = "substr('ACGT-_', cast(1+(length(read_name)*(k+3)+cn*(p+1)+locus_index)%6 as int), 1)"
_QUAL = "cast(10+(cn*7+k*5+length(read_name))%30 as int)"
SNVS_SQL = f"snvs as (select locus_index, read_name, cn, p, k snv, {_BASE} base, {_QUAL} qual from reads, (values (0),(1),(2)) as v(k) where smp=0)"


def snvs(spark, sf):
    r = fixture(spark, sf, "reads").where("smp = 0").withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    return r.select("locus_index", "read_name", "cn", "p", F.col("k").alias("snv"), F.expr(_BASE).alias("base"), F.expr(_QUAL).alias("qual"))


def reads(spark, sf):
    return fixture(spark, sf, "reads")


@query("a06_read_depth", sql("select contig, round(sum(n)*1.0e0/count(*),6) depth from (select contig, locus_index, count(*) n from reads join loci using (locus_index) group by 1,2) group by rollup (contig)", "reads", "loci"))
def read_depth(spark, sf):
    r = reads(spark, sf).join(fixture(spark, sf, "loci").select("locus_index", "contig"), "locus_index")
    return G.depth(r).select("contig", F.round("depth", 6).alias("depth"))


@query("a07_histogram_text", sql("select locus_index, smp, p, string_agg(cn||'x'||n, '|' order by cn) txt from (select locus_index, smp, p, cn, count(*) n from reads group by 1,2,3,4) group by 1,2,3", "reads"))
def histogram_text(spark, sf):
    return reads(spark, sf).groupBy("locus_index", "smp", "p").agg(F.collect_list("cn").alias("v")).select("locus_index", "smp", "p", G.histogram_text(F.col("v")).alias("txt"))


@query("s11_decode_histogram", sql("select locus_index, count(*) n, cast(sum(cn) as bigint) total, cast(list_sum(list_filter(list(cn order by cn), lambda x, i: i%2=1)) as bigint) evens from reads where smp=0 group by 1", "reads"))
def decode_histogram(spark, sf):
    h = reads(spark, sf).where("smp = 0").groupBy("locus_index").agg(F.collect_list("cn").alias("v")).select("locus_index", G.decode_histogram(G.histogram_text(F.col("v"))).alias("v"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return h.select("locus_index", F.size("v").cast("long").alias("n"), total(F.col("v")).alias("total"), total(F.get(G.halves(F.col("v")), F.lit(0))).alias("evens"))


@query("a08_most_common", sql("select locus_index, cn, n, rk from (select locus_index, cn, n, row_number() over (partition by locus_index order by n desc, cn) rk from (select locus_index, cn, count(*) n from reads group by 1,2)) where rk<=2", "reads"))
def most_common(spark, sf):
    return G.most_common(reads(spark, sf), ["locus_index"], "cn", 2).select("locus_index", "cn", "n", F.col("rank").cast("long").alias("rk"))


@query("a09_kmers", sql("select kmer, count(*) n from (select substr(seq,i,3) kmer from (select seq, unnest(range(1,length(seq)-1)) i from sequences)) where regexp_full_match(kmer,'[ACGT]{3}') group by 1", "sequences"))
def kmers(spark, sf):
    return G.kmers(fixture(spark, sf, "sequences").withColumn("all", F.lit(1)), "seq", 3, ["all"]).select("kmer", "n")


@query("a10_a13_mean_and_variance", sql("select locus_index, round(avg(cn),6) mean, round(var_pop(cn),6) var, round(avg(case when cn>11 then cn end),6) some_ from reads group by 1", "reads"))
def mean_and_variance(spark, sf):
    m, v = G.gaussian("cn")
    return reads(spark, sf).groupBy("locus_index").agg(F.round(m, 6).alias("mean"), F.round(v, 6).alias("var"), F.round(F.avg(F.when(F.col("cn") > 11, F.col("cn"))), 6).alias("some_"))


@query("a11_methylation", sql("with a as (select locus_index, p, avg(case when cn%3<>0 or p=0 then w end) am, count(case when cn%3<>0 or p=0 then w end) n from reads group by 1,2) select locus_index, p, round(am,6) am, min(n) over (partition by locus_index)>0 usable from a", "reads"))
def methylation(spark, sf):
    r = reads(spark, sf).withColumn("m", F.when((F.col("cn") % 3 != 0) | (F.col("p") == 0), F.col("w")))
    return G.methylation(r, ["locus_index"], "p", "m").select("locus_index", "p", F.round("am", 6).alias("am"), "usable")


@query("a12_snv_base_counts", sql(f"with {SNVS_SQL} select locus_index, snv, p, count(*) n, " + ", ".join(f"count(*) filter (where base='{b}') n_{x}" for b, x in zip("ACGT_", ["a", "c", "g", "t", "gap"], strict=True)) + " from snvs where base='_' or (base<>'-' and qual>=20) group by 1,2,3", "reads"))
def snv_base_counts(spark, sf):
    return G.base_counts(snvs(spark, sf))


@query(
    "a14_percentile_intervals",
    sql("with v as (select locus_index, list(cn*1.0e0 order by cn) x, count(*) n from reads group by 1), q as (select locus_index, x, n, unnest([0.025e0,0.975e0,0.005e0,0.995e0]) q from v), t as (select locus_index, x, n, q, greatest(0.0e0, n*q-1) t from q), r as (select locus_index, q, x[cast(floor(t) as int)+1]+(t-floor(t))*(x[cast(least(n-1,floor(t)+1) as int)+1]-x[cast(floor(t) as int)+1]) v from t) select locus_index, cast(round_even(max(v) filter (where q=0.025e0),0) as int) lo95, cast(round_even(max(v) filter (where q=0.975e0),0) as int) hi95, cast(round_even(max(v) filter (where q=0.005e0),0) as int) lo99, cast(round_even(max(v) filter (where q=0.995e0),0) as int) hi99 from r group by 1", "reads"),
)
def percentile_intervals(spark, sf):
    v = reads(spark, sf).groupBy("locus_index").agg(F.collect_list(F.col("cn").cast("double")).alias("x"))
    v = v.select("locus_index", G.interval(F.col("x"), 95).alias("a"), G.interval(F.col("x"), 99).alias("b"))
    return v.selectExpr("locus_index", "a.lo lo95", "a.hi hi95", "b.lo lo99", "b.hi hi99")


@query("a15_a16_medians", sql("select locus_index, list(cn order by cn, read_name)[count(*)//2+1] med, list(read_name order by cn, read_name)[count(*)//2+1] med_read, (select cn from (select cn, count(*) n from reads s where s.locus_index=r.locus_index group by 1) order by n desc, cn limit 1) modal from reads r group by locus_index", "reads"))
def medians(spark, sf):
    m = reads(spark, sf).groupBy("locus_index").agg(F.collect_list(F.struct("cn", "read_name")).alias("r"), G.modal("cn").alias("modal"))
    return m.select("locus_index", G.median_row(F.col("r")).alias("m"), "modal").selectExpr("locus_index", "m.cn med", "m.read_name med_read", "modal")


@query("m05_predicted_peak", sql("with g as (select locus_index, avg(cn) filter (where p=0) m0, avg(cn) filter (where p=1) m1, stddev_pop(cn) filter (where p=0) s0, stddev_pop(cn) filter (where p=1) s1, avg(1-p) w0, avg(p) w1 from reads group by 1 having count(distinct p)=2), d as (select locus_index, cn, m0, m1, case when s0=0 then 1e-5 else s0 end s0, case when s1=0 then 1e-5 else s1 end s1, w0, w1 from g, (values (9),(12),(15),(18),(21)) v(cn)) select locus_index, cn, case when ln(w0)-ln(s0)-power(cn-m0,2)/(2*s0*s0) >= ln(w1)-ln(s1)-power(cn-m1,2)/(2*s1*s1) then 0 else 1 end peak from d", "reads"))
def predicted_peak(spark, sf):
    x = lambda k: F.when(F.col("p") == k, F.col("cn"))
    g = reads(spark, sf).groupBy("locus_index").agg(F.array(F.avg(x(0)), F.avg(x(1))).alias("m"), F.array(F.stddev_pop(x(0)), F.stddev_pop(x(1))).alias("s"), F.array(F.avg(1 - F.col("p")), F.avg("p")).alias("w"), F.countDistinct("p").alias("k")).where("k = 2")
    g = g.withColumn("cn", F.explode(F.array(*map(F.lit, (9, 12, 15, 18, 21)))))
    return g.select("locus_index", "cn", G.predicted_peak(F.col("cn"), F.col("m"), F.col("w"), F.col("s")).alias("peak"))


@query("m07_j12_read_distances", sql(f"with {SNVS_SQL}, z as (select a.locus_index, a.read_name a, b.read_name b, a.cn cn_a, b.cn cn_b, count(*) filter (where (a.base='_' or (a.base<>'-' and a.qual>=20)) and (b.base='_' or (b.base<>'-' and b.qual>=20))) n, count(*) filter (where (a.base='_' or (a.base<>'-' and a.qual>=20)) and (b.base='_' or (b.base<>'-' and b.qual>=20)) and a.base<>b.base) d from snvs a join snvs b on a.locus_index=b.locus_index and a.snv=b.snv and a.read_name<b.read_name group by 1,2,3,4,5) select locus_index, a, b, round(d+abs(cn_a-cn_b)*case when n>=3 then 0.1e0 else 0.2e0 end,6) distance from z", "reads"))
def read_distances(spark, sf):
    s = snvs(spark, sf).groupBy("locus_index", "read_name", "cn").agg(F.array_sort(F.collect_list(F.struct("snv", "base", "qual"))).alias("s"))
    s = s.withColumn("snvs", F.transform("s", lambda x: F.struct(x["base"].alias("base"), x["qual"].alias("qual"))))
    return G.read_distances(s).withColumn("distance", F.round("distance", 6))


_GT = f"with {SNVS_SQL}, n as (select locus_index, snv, p, base, count(*) n from snvs where base not in ('-','_') and qual>=20 group by 1,2,3,4), s as (select *, n*1.0e0/sum(n) over (partition by locus_index,snv,p) sh, row_number() over (partition by locus_index,snv,p order by n desc, base) r from n) select a.locus_index, a.snv, a.base b0, b.base b1 from s a join s b on a.locus_index=b.locus_index and a.snv=b.snv and a.p=0 and b.p=1 and a.r=1 and b.r=1 and a.base<>b.base left join s x on x.locus_index=a.locus_index and x.snv=a.snv and x.p=1 and x.base=a.base left join s y on y.locus_index=a.locus_index and y.snv=a.snv and y.p=0 and y.base=b.base where coalesce(x.sh,0)<=a.sh/2 and coalesce(y.sh,0)<=b.sh/2"


@query("m11_snv_genotype", sql(_GT, "reads"))
def snv_genotype(spark, sf):
    return G.snv_genotype(snvs(spark, sf))


@query("m12_useful_snvs", sql(f"with {SNVS_SQL} select locus_index, snv, count(*) bases from (select locus_index, snv, base, count(*) n from snvs where base not in ('-','_') group by 1,2,3) where n>=2 group by 1,2 having count(*)>=2", "reads"))
def useful_snvs(spark, sf):
    return G.useful_snvs(snvs(spark, sf), 2)


@query("m16_combined_calls", sql("select locus_index, string_agg(cast(v as varchar), ',' order by p, i) txt from (select locus_index, p, unnest([min(cn),max(cn)]) v, unnest([0,1]) i from reads group by 1,2) group by 1", "reads"))
def combined_calls(spark, sf):
    per = reads(spark, sf).groupBy("locus_index", F.col("p").alias("allele")).agg(F.array(F.min("cn"), F.max("cn")).alias("call"))
    return per.groupBy("locus_index").agg(F.array_join(G.combined(per, "call"), ",").alias("txt"))


@query("m21_normalised_weights", sql("select locus_index, read_name, round(w/sum(w) over (partition by locus_index),9) w from reads where smp=1", "reads"))
def normalised_weights(spark, sf):
    return G.normalised_weights(reads(spark, sf).where("smp = 1")).select("locus_index", "read_name", F.round("w", 9).alias("w"))


@query("m22_sub_seeds")
def sub_seeds(spark, sf):
    return fixture(spark, sf, "loci").select("locus_index", G.sub_seed(1, F.col("locus_index")).alias("seed"))


@query("m01_single_value_call", sql("select locus_index, min(cn) call, min(cn) lo, min(cn) hi, 0.5e0 weight, 0.0e0 sd, 1 modal from reads where smp=0 and p=1 group by 1 having count(*)>=4 and count(distinct cn)=1", "reads"))
def single_value_call(spark, sf):
    r = reads(spark, sf).where("smp = 0 and p = 1").groupBy("locus_index").agg(F.count("*").alias("n"), F.min("cn").alias("call"), F.max("cn").alias("top"))
    return r.where("n >= 4 and call = top").select("locus_index", "call", F.col("call").alias("lo"), F.col("call").alias("hi"), F.lit(0.5).alias("weight"), F.lit(0.0).alias("sd"), F.lit(1).alias("modal"))


@query("o04_read_cap", sql("select locus_index, read_name from (select *, row_number() over (partition by locus_index order by cn, read_name) r from reads) where r<=5", "reads"))
def read_cap(spark, sf):
    return G.capped_reads(reads(spark, sf), 5, ["cn", "read_name"]).select("locus_index", "read_name")


@query("o05_consensus_downsample", sql("select locus_index, string_agg(cast(cn as varchar), ',' order by read_name) txt from (select *, row_number() over (partition by locus_index order by read_name) r, first_value(cn) over (partition by locus_index order by read_name) f from reads where smp=2) where f<=15 or r<=3 group by 1", "reads"))
def consensus_downsample(spark, sf):
    s = reads(spark, sf).where("smp = 2").groupBy("locus_index").agg(F.array_sort(F.collect_list(F.struct("read_name", "cn"))).alias("r"))
    some = F.when(F.get("r", F.lit(0))["cn"] > 15, F.slice("r", 1, 3)).otherwise(F.col("r"))
    return s.select("locus_index", F.array_join(F.transform(some, lambda x: x["cn"]), ",").alias("txt"))


@query("o06_o07_allele_order", sql("select locus_index, string_agg(cast(p as varchar), ',' order by m, lo, p) by_mean, string_agg(cast(p as varchar), ',' order by hi, p) by_len from (select locus_index, p, avg(cn) m, min(cn) lo, max(cn) hi from reads group by 1,2) group by 1", "reads"))
def allele_order(spark, sf):
    per = reads(spark, sf).groupBy("locus_index", "p").agg(F.avg("cn").alias("m"), F.min("cn").alias("lo"), F.max("cn").alias("hi"))
    put = lambda *c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x["p"]), ",")
    return per.groupBy("locus_index").agg(put("m", "lo", "p").alias("by_mean"), put("hi", "p").alias("by_len"))


@query("o03_locus_merge_order", sql("select locus_index, row_number() over (order by locus_index) rk from loci", "loci"))
def locus_merge_order(spark, sf):
    return numbered(fixture(spark, sf, "loci").select("locus_index"), ["locus_index"]).select("locus_index", F.col("line").alias("rk"))


@query("p08_flank_sufficiency", sql("select l.locus_index, count(*) filter (where f.start_pos<=l.start_pos-10 and f.end_pos>=l.end_pos+10) both_, count(*) filter (where f.start_pos<=l.start_pos-10 or f.end_pos>=l.end_pos+10) either from loci l join features f on l.contig=f.contig and l.start_pos<f.end_pos and f.start_pos<l.end_pos group by 1", "loci", "features"))
def flank_sufficiency(spark, sf):
    from .core import _SPANS, _features
    from ..operators.intervals import overlap_join

    j = overlap_join(fixture(spark, sf, "loci"), _features(spark, sf), *_SPANS)
    ok = lambda one: G.flank_ok(F.col("fstart"), F.col("fend"), F.col("start_pos") - 10, F.col("end_pos") + 10, one).cast("long")
    return j.groupBy("locus_index").agg(F.sum(ok(False)).alias("both_"), F.sum(ok(True)).alias("either"))


@query("p09_mean_quality", sql(f"with {SNVS_SQL} select locus_index, read_name, round(avg(qual),6) q from snvs group by 1,2 having avg(qual)>=20", "reads"))
def mean_quality(spark, sf):
    q = snvs(spark, sf).groupBy("locus_index", "read_name").agg(F.collect_list("qual").alias("q")).withColumn("q", G.mean_quality(F.col("q")))
    return q.where("q >= 20").select("locus_index", "read_name", F.round("q", 6).alias("q"))


@query("p10_p12_read_gates", sql("select locus_index, count(*) filter (where w>=1.02e0) n_good, count(*) filter (where w<1.02e0) n_bad, case when count(*) filter (where w<1.02e0)<=6 and count(*) filter (where w>=1.02e0)>=8 then min(cn) filter (where w>=1.02e0) end call from reads group by 1", "reads"))
def read_gates(spark, sf):
    good = F.col("w") >= 1.02
    a = reads(spark, sf).groupBy("locus_index").agg(F.sum(good.cast("long")).alias("n_good"), F.sum((~good).cast("long")).alias("n_bad"), F.min(F.when(good, F.col("cn"))).alias("m"))
    return a.select("locus_index", "n_good", "n_bad", F.when(F.col("n_bad") <= 6, G.gated(F.col("n_good"), 8, F.col("m"))).alias("call"))


@query("p11_reference_guards", sql("with s as (select doc_id, substr(seq,1,20) l, substr(seq,30,20) r from sequences), t as (select doc_id, case when doc_id%5=0 then substr(l,1,17)||'NNN' else l end l, case when doc_id%7=0 then 'NNN'||substr(r,4) else r end r from s) select doc_id, length(l)>=20 and length(r)>=20 and substr(l,length(l)-2)<>'NNN' and substr(r,1,3)<>'NNN' ok from t", "sequences"))
def reference_guards(spark, sf):
    s = fixture(spark, sf, "sequences").selectExpr("doc_id", "case when doc_id%5=0 then concat(substr(seq,1,17),'NNN') else substr(seq,1,20) end l", "case when doc_id%7=0 then concat('NNN',substr(seq,33,17)) else substr(seq,30,20) end r")
    return s.select("doc_id", G.reference_ok(F.col("l"), F.col("r"), 20, F.lit(3)).alias("ok"))


@query("p13_alignment_flags", "select l_orderkey, count(*) filter (where (l_linenumber*256+l_suppkey)&256=0 and (l_linenumber*1024)&2048=0) n from lineitem group by 1")
def alignment_flags(spark, sf):
    from ..sources.reads import primary
    from .fixtures import table

    x = table(spark, sf, "lineitem").select("l_orderkey", (F.expr("((l_linenumber*256+l_suppkey)&256) | ((l_linenumber*1024)&2048)")).cast("int").alias("flag"))
    return x.groupBy("l_orderkey").agg(F.sum(primary(F.col("flag")).cast("long")).alias("n"))


@query("p15_p16_rare_realigns", sql("with x as (select locus_index, cn, cn%3=0 and p=0 re from reads where smp=0), a as (select locus_index, count(*) filter (where re) n_realigned from x group by 1) select locus_index, n_realigned, exists (select 1 from x y where y.locus_index=a.locus_index and y.re and not exists (select 1 from x z where z.locus_index=a.locus_index and not z.re and z.cn=y.cn)) rare from a", "reads"))
def rare_realigns(spark, sf):
    r = reads(spark, sf).where("smp = 0").withColumn("realigned", F.expr("cn % 3 = 0 and p = 0"))
    return G.rare_realigned(r).select("locus_index", "n_realigned", "rare")


@query("p17_snv_gate", sql(f"with {SNVS_SQL}, c as (select locus_index, read_name, count(*) filter (where base not in ('-')) k from snvs group by 1,2), a as (select locus_index, count(*) n, count(*) filter (where k>0) n_any, count(*) filter (where k>=2) n_two from c group by 1) select locus_index, n_two>=least(0.68e0*n,16) or n_any>=least(0.8e0*n,16) ok from a", "reads"))
def snv_gate(spark, sf):
    c = snvs(spark, sf).groupBy("locus_index", "read_name").agg(F.sum((F.col("base") != "-").cast("int")).alias("k"))
    a = c.groupBy("locus_index").agg(F.count("*").alias("n"), F.sum((F.col("k") > 0).cast("int")).alias("one"), F.sum((F.col("k") >= 2).cast("int")).alias("two"))
    return a.select("locus_index", G.use_snvs(F.col("n"), F.col("one"), F.col("two")).alias("ok"))


@query("p18_haplotype_gate", sql("with t as (select locus_index, case when cn%5>0 then p end hp, case when cn%5>0 then locus_index//10+cn%2 end ps from reads), g as (select locus_index, count(*) n, count(distinct hp) hps from t where hp is not null group by 1), s as (select locus_index, ps, n_ps from (select locus_index, ps, count(*) n_ps, row_number() over (partition by locus_index order by count(*) desc, ps) r from t where hp is not null group by 1,2) where r=1) select locus_index, ps, n>=8 and hps=2 and n_ps>=8 ok from g join s using (locus_index)", "reads"))
def haplotype_gate(spark, sf):
    t = reads(spark, sf).selectExpr("locus_index", "case when cn%5>0 then p end hp", "case when cn%5>0 then locus_index div 10 + cn%2 end ps")
    return G.phased_by_reads(t)
