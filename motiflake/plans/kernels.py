"""Queries over the numeric kernels: calls, repeat counts, consensus, phasing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..kernels import align, segments
from ..operators import calling, from_reads, phasing
from ..operators import genotype as G
from ..operators.intervals import overlap_join
from ..params import CallParams
from ..sources import reads as sources
from .fixtures import fixture, spread_loci, sql
from .genotypes import snvs
from .registry import query


def _two(spark, sf):
    return fixture(spark, sf, "loci").select("locus_index", F.lit(2).alias("n_alleles"))


@query("m01_m06_m21_call_by_copies")
def call_by_copies(spark, sf):
    r = fixture(spark, sf, "reads").where("smp = 0")
    c = calling.call(r, _two(spark, sf))
    return c.select("locus_index", "method", "modal_n", F.array_join("call", ",").alias("call"), F.array_join(F.transform("ci95", lambda x: F.concat_ws("-", x["lo"].cast("string"), x["hi"].cast("string"))), ",").alias("ci95"))


@query("m09_call_by_haplotype")
def call_by_haplotype(spark, sf):
    r = fixture(spark, sf, "reads").selectExpr("locus_index", "read_name", "cn", "w", "p hp", "cast(locus_index div 10 as int) ps")
    return calling.call(r, _two(spark, sf)).select("locus_index", "method", F.array_join("call", ",").alias("call"))


@query("m08_m10_call_by_snvs")
def call_by_snvs(spark, sf):
    s = snvs(spark, sf).withColumn("base", F.when(F.col("p") == 0, F.lit("A")).otherwise(F.lit("C")))
    r = s.groupBy("locus_index", "read_name", "cn").agg(F.array_sort(F.collect_list(F.struct("snv", "base", F.lit(30).alias("qual")))).alias("s"))
    r = r.select("locus_index", "read_name", "cn", F.lit(1.0).alias("w"), F.transform("s", lambda x: x["base"]).alias("bases"), F.transform("s", lambda x: x["qual"]).alias("quals"))
    return calling.call(r, _two(spark, sf)).select("locus_index", "method", F.array_join("call", ",").alias("call"))


_SEEN = "repeat(translate(motif,'WKN','AGC'),cast(cn as int))"


def _sequences(spark, sf):
    """Each read of sample 0 with its locus's motif and a sequence of so many copies of it."""
    r = fixture(spark, sf, "reads").where("smp = 0").join(fixture(spark, sf, "loci").select("locus_index", "motif"), "locus_index")
    return r.withColumn("seq", F.expr(_SEEN))


@query("f28_f33_repeat_count", sql("select locus_index, read_name, cn, case when cn>0 then 2.0e0 end score from reads where smp=0", "reads"))
def repeat_count(spark, sf):
    """Sequences of whole copies between flanks are counted exactly, and every base matches."""
    r = _sequences(spark, sf).select("locus_index", "read_name", "seq", F.lit("ATTGCACCTGATTACG").alias("left"), F.lit("TGGATCCATTAGGCAT").alias("right"), "motif")
    return calling.counted(r, 16).select("locus_index", "read_name", "cn", "score")


@query("m17_consensus")
def consensus(spark, sf):
    return calling.consensus_of(_sequences(spark, sf).select("locus_index", F.col("p").alias("allele"), "seq"))


@query("m18_realignment", sql("select locus_index, read_name, 19 start_, 19+length(motif)*cn end_ from reads join loci using (locus_index) where smp=0", "reads", "loci"))
def realignment(spark, sf):
    """A clipped read's repeat is found between its flanks; equal reads are placed once."""

    @F.pandas_udf("start int, end int")
    def run(seq: pd.Series) -> pd.DataFrame:
        left, right = "ATTGCACCTGATTACG", "TGGATCCATTAGGCAT"
        return pd.DataFrame([align.realigned("GGT" + left + s + right + "ACC", left, right) or (None, None) for s in seq], columns=["start", "end"])

    x = _sequences(spark, sf)
    each = x.select("seq").distinct().withColumn("r", run("seq"))
    return x.join(each, "seq").select("locus_index", "read_name", F.col("r.start").alias("start_"), F.col("r.end").alias("end_").cast("long"))


def genome(spark, sf):
    """One contig for each locus: 128 bases, 8 to 12 copies of the motif, 128 bases; the loci on them; and their lines."""
    side = lambda k: F.translate(F.concat(*[F.md5(F.concat(F.col("locus_index").cast("string"), F.lit(f"{k}{i}"))) for i in range(4)]), "0123456789abcdef", "ACGTACGTACGTACGT")
    l = spread_loci(spark, sf).select("locus_index", "motif", (8 + F.col("locus_index") % 5).cast("int").alias("n"))
    l = l.withColumns({"l": F.concat(F.substr(side("l"), F.lit(1), F.lit(127)), F.when(F.col("motif") == "AT", "C").otherwise("T")), "r": F.concat(F.lit("T"), F.substr(side("r"), F.lit(2)))})
    return l.withColumn("unit", F.translate("motif", "WKN", "AGC")).withColumn("contig", F.concat(F.lit("k"), "locus_index"))


def genome_parts(spark, sf):
    """(loci, FASTA chunks, reads) of the made-up genome: reads span it with their own number of copies."""
    g = genome(spark, sf)
    whole = F.concat("l", F.expr("repeat(unit, n)"), "r")
    text = g.select(F.explode(F.array(F.struct((F.col("locus_index") * 2).alias("line"), F.concat(F.lit(">"), "contig").alias("value")), F.struct((F.col("locus_index") * 2 + 1).alias("line"), whole.alias("value")))).alias("x")).select("x.*")
    loci = g.select("locus_index", F.concat(F.lit("L"), "locus_index").alias("locus_id"), "contig", F.lit(128).cast("long").alias("start"), (128 + F.col("n") * F.length("unit")).cast("long").alias("end"), "motif", F.lit(2).alias("n_alleles"))
    r = fixture(spark, sf, "reads").where("smp = 0").join(g.drop("motif").hint("merge"), "locus_index")
    seq = F.concat("l", F.expr("repeat(unit, cn)"), "r")
    d = (F.col("cn") - F.col("n")) * F.length("unit")
    mid = F.when(d > 0, F.concat(d.cast("string"), F.lit("I"))).when(d < 0, F.concat((-d).cast("string"), F.lit("D"))).otherwise("")
    rest = F.length("unit") * F.col("n") + 128 - F.greatest(-d, F.lit(0))
    line = F.concat_ws("\t", "read_name", F.when(F.col("strand") == "-", "16").otherwise("0"), "contig", F.lit("1"), F.lit("60"), F.concat(F.lit("128M"), mid, rest.cast("string"), F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), seq, F.repeat(F.lit("I"), F.length(seq)))
    return loci, sources.fasta_chunks(text, 512), sources.from_sam(r.select(line.alias("value")))


@query("f30_reference_count", sql("select locus_index, 8+locus_index%5 ref_cn, 128 start_adj from loci", "loci"))
def reference_count(spark, sf):
    loci, chunks, _ = genome_parts(spark, sf)
    return from_reads.with_reference(loci, chunks, CallParams(), 512).select("locus_index", "ref_cn", "start_adj")


@query("m19_m20_counts_from_reads", sql("select locus_index, read_name, cn, length(motif)*cn tr_length from (select *, row_number() over (partition by locus_index order by read_name) r from reads where smp=0) join loci using (locus_index) where r<=250", "reads", "loci"))
def counts_from_reads(spark, sf):
    """Reference slices, read coordinates, flanks, qualities, counts and weights, over all loci."""
    loci, chunks, reads = genome_parts(spark, sf)
    placed = from_reads.with_reference(loci, chunks, CallParams(), 512)
    got = from_reads.counted(from_reads.seen(placed, reads, CallParams()), CallParams())
    return got.select("locus_index", "read_name", "cn", F.length("tr").cast("long").alias("tr_length"))


@query("m20_call_from_reads")
def call_from_reads(spark, sf):
    loci, chunks, reads = genome_parts(spark, sf)
    c = from_reads.call(loci, reads, chunks, CallParams(), chunk=512)
    return c.select("locus_index", "ref_cn", "depth", "method", F.array_join("call", ",").alias("call"), F.array_join("seqs", ",").alias("seqs"))


def _feature_reads(spark, sf):
    return fixture(spark, sf, "features").withColumn("seq", F.expr("substr(repeat('ACGGTTCA',60), cast(1+fid%8 as int), cast(end_pos-start_pos as int))"))


@query("m19_f35_locus_alignments", sql("select locus_index, fid, substr(seq, cast(l.start_pos-f.start_pos+1 as int), cast(l.end_pos-l.start_pos as int)) tr, substr(seq, cast(l.start_pos-f.start_pos-4 as int), 5) anchor from loci l join (select *, substr(repeat('ACGGTTCA',60), cast(1+fid%8 as int), cast(end_pos-start_pos as int)) seq from features) f on l.contig=f.contig and f.start_pos<=l.start_pos-10 and f.end_pos>l.end_pos+10", "loci", "features"))
def locus_alignments(spark, sf):
    f = _feature_reads(spark, sf).select("fid", F.col("contig").alias("contig2"), F.col("start_pos").alias("fstart"), F.col("end_pos").alias("fend"), "seq")
    pairs = overlap_join(fixture(spark, sf, "loci"), f, ("contig", "contig2"), ("start_pos", "end_pos"), ("fstart", "fend"))

    @F.pandas_udf("tr string, anchor string")
    def show(seq: pd.Series, start: pd.Series, s: pd.Series, e: pd.Series) -> pd.DataFrame:
        got = [segments.of_locus(q, np.full(len(q), 40), f"{len(q)}M", a, (x, z), "N" * 10, "N" * 10) for q, a, x, z in zip(seq, start, s, e, strict=True)]
        return pd.DataFrame([(g["tr"], g["before"][-5:]) if g else (None, None) for g in got], columns=["tr", "anchor"])

    return pairs.select("locus_index", "fid", show("seq", "fstart", "start_pos", "end_pos").alias("g")).where("g.tr is not null").select("locus_index", "fid", "g.*")


@query("f32_read_weights", sql("with x as (select locus_index, read_name, 60+cn*9+p*30 l, 3*cn+60 t from reads where smp=0) select a.locus_index, a.read_name, round((avg(b.l)+a.t-2)/(avg(b.l)-a.t+1),6) w, round((a.l+a.t-2)*1.0e0/(a.l-a.t+1),6) own from x a join x b on a.locus_index=b.locus_index and b.l>=a.t group by a.locus_index, a.read_name, a.l, a.t", "reads"))
def read_weights(spark, sf):
    x = fixture(spark, sf, "reads").where("smp = 0").selectExpr("locus_index", "read_name", "60+cn*9+p*30 l", "3*cn+60 t")
    per = x.groupBy("locus_index").agg(F.collect_list("l").alias("lengths"))
    size = F.col("t")
    return x.join(per, "locus_index").select("locus_index", "read_name", F.round(G.read_weight(F.col("lengths"), size), 6).alias("w"), F.round(G.read_weight(F.col("lengths"), size, F.col("l")), 6).alias("own"))


@query("f34_methylation_tags", sql("select fid, (cast(fid%256>127 as int)+cast((fid*7)%256>127 as int))/2.0e0 m, 2 mc from features", "features"))
def methylation_tags(spark, sf):
    @F.pandas_udf("m double, mc int")
    def run(seq: pd.Series, mm: pd.Series, ml: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([segments.methylation(segments.methylated_sites(t, list(v), s, False), 0, len(s)) for s, t, v in zip(seq, mm, ml, strict=True)], columns=["m", "mc"])

    line = F.concat_ws("\t", F.col("fid").cast("string"), F.lit("0"), "contig", F.lit("1"), F.lit("60"), F.lit("9M"), F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("I"), F.lit("MM:Z:C+m,0,1;"), F.concat(F.lit("ML:B:C,"), F.col("fid") % 256, F.lit(","), (F.col("fid") * 7) % 256))
    r = sources.from_sam(_feature_reads(spark, sf).select(line.alias("value")))
    return r.select(F.col("read_name").cast("long").alias("fid"), run("seq", "mm", "ml").alias("g")).select("fid", "g.*")


def phase_links(spark, sf):
    x = fixture(spark, sf, "loci").selectExpr("contig", "locus_index div 44 as a")
    return x.selectExpr("contig", "a", "a + 1 as b", "a % 2 = 1 as flip").where("a % 3 <> 2").distinct()


@query("m13_phase_components", sql("with x as (select distinct contig, locus_index//44 a from loci), l as (select contig, a, a+1 b, a%2=1 flip from x where a%3<>2), n as (select contig, a ps from l union select contig, b from l), y as (select *, sum(case when not exists (select 1 from l where l.contig=n.contig and l.b=n.ps) then 1 else 0 end) over (partition by contig order by ps) g from n), z as (select *, min(ps) over (partition by contig, g) root from y) select z.contig, ps, root, (select coalesce(sum(cast(flip as int)),0) from l where l.contig=z.contig and l.a>=root and l.b<=ps)%2=1 flip from z", "loci"))
def phase_components(spark, sf):
    return phasing.components(phase_links(spark, sf))


@query("m14_rephased_calls")
def rephased_calls(spark, sf):
    g = fixture(spark, sf, "gt").where("smp = 0").join(fixture(spark, sf, "loci"), "locus_index")
    c = g.selectExpr("contig", "locus_index div 44 ps", "locus_index", "array(a0, a1) call")
    return phasing.rephased(c, phasing.components(phase_links(spark, sf)), ["call"]).select("locus_index", "ps", F.array_join("call", ",").alias("call"))


@query("m15_global_phase_ids", sql("with x as (select distinct contig, locus_index%10 ps from loci where locus_index%10<7) select contig, ps, row_number() over (order by contig, ps) ps_id from x", "loci"))
def global_phase_ids(spark, sf):
    x = fixture(spark, sf, "loci").selectExpr("contig", "case when locus_index%10<7 then locus_index%10 end ps")
    return phasing.global_ids(x).where("ps is not null").select("contig", "ps", "ps_id").distinct()
