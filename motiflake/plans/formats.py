"""Queries over text formats: catalogs, annotations, call sets, conversions and output lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog as K
from ..operators import inherit as H
from ..operators.ranges import numbered
from ..sinks import report as R
from ..sinks import vcf as V
from ..sources import bed, callers, gff, reads, trf
from ..sources import ploidy as P
from ..sources import vcf as vcf_source
from .fixtures import fixture, spread_loci, sql
from .registry import query


def bed_lines(spark, sf):
    """The loci as catalog lines between comments and blank lines; every third names an id."""
    loci = spread_loci(spark, sf)
    last = F.when(F.col("locus_index") % 3 == 0, F.concat(F.lit("ID=L"), F.col("locus_index"), F.lit("; Motif = "), F.lower("motif"))).otherwise(F.col("motif"))
    row = F.concat_ws("\t", "contig", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), last)
    x = loci.select((F.col("locus_index") * 3).alias("line"), row.alias("value"))
    noise = loci.where("locus_index % 5 = 0")
    return x.unionByName(noise.select((F.col("locus_index") * 3 + 1).alias("line"), F.lit("# a comment").alias("value"))).unionByName(noise.select((F.col("locus_index") * 3 + 2).alias("line"), F.lit("  ").alias("value")))


def rows(spark, sf):
    return bed.rows(bed_lines(spark, sf))


_ID = "case when locus_index%3=0 then 'L'||locus_index else 'locus'||locus_index end"


@query("s01_parse_bed", sql("select locus_index*3 line, contig, end_pos from loci", "loci"))
def parse_bed(spark, sf):
    return rows(spark, sf).selectExpr("line", "get(cols, 0) contig", "cast(get(cols, 2) as bigint) end_pos")


@query("s02_s03_load_loci", sql(f"select locus_index, {_ID} locus_id, contig, start_pos, end_pos, motif from loci", "loci"))
def load_loci(spark, sf):
    return bed.loci(rows(spark, sf), P.CONFIGS["XY"]).select("locus_index", "locus_id", "contig", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "motif")


@query("s04_interval_bed_unique", sql("select contig, start_pos-1 start_pos, max(locus_index*3) line from loci group by contig, start_pos, start_pos//1000", "loci"))
def interval_bed_unique(spark, sf):
    x = bed.rows(bed_lines(spark, sf)).withColumn("cols", F.transform("cols", lambda c, i: F.when(i == 2, F.lit("99999999")).otherwise(c)))
    return bed.intervals(x, one_based=True).select("contig", F.col("start").alias("start_pos"), "line")


@query("s05_interval_bed_all", sql("select contig, start_pos, end_pos, locus_index*3 line from loci", "loci"))
def interval_bed_all(spark, sf):
    return bed.intervals(rows(spark, sf), unique=False).select("contig", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "line")


def dat_lines(spark, sf):
    """A section for each contig, its rows from the last place to the first: a section has room for 10**15 lines."""
    loci = fixture(spark, sf, "loci")
    n = "cast(substr(contig,4) as bigint)"
    head = loci.groupBy("contig").agg(F.max("start_pos").alias("m")).selectExpr(f"{n}*1000000000000000L line", "concat('Sequence: ',contig) value")
    noise = head.selectExpr("line+1 line", "'Parameters: 2 7 7 80 10 50 500' value")
    row = loci.selectExpr(f"{n}*1000000000000000L + 900000000000000L - end_pos*100 - locus_index%100 line", "concat(start_pos+1,' ',end_pos,' ',length(motif),' 2.5 3 90 5 50 20 30 30 20 1.9 ',motif,' ',repeat(motif,2)) value")
    return head.unionByName(noise).unionByName(row)


@query("s06_w03_trf_dat", sql("select contig, start_pos, end_pos, motif from loci", "loci"))
def trf_dat(spark, sf):
    return trf.parse(dat_lines(spark, sf)).selectExpr("cols[0] contig", "cast(cols[1] as bigint) start_pos", "cast(cols[2] as bigint) end_pos", "cols[size(cols)-1] motif")


@query("s07_trf_dat_sorted", sql("select row_number() over (order by cast(substr(contig,4) as int), start_pos, end_pos, locus_index%100 desc) place, contig, start_pos from loci", "loci"))
def trf_dat_sorted(spark, sf):
    return trf.parse(dat_lines(spark, sf), ordered=True).selectExpr("line place", "cols[0] contig", "cast(cols[1] as bigint) start_pos")


@query("s07_bed_sorted_by_first_contig", sql("select row_number() over (order by f, start_pos, end_pos, locus_index) place, locus_index*3 line from (select *, min(locus_index) over (partition by contig) f from loci)", "loci"))
def bed_sorted(spark, sf):
    return bed.sorted_rows(rows(spark, sf)).select("place", "line")


@query("s24_f38_annotations", sql("select contig, start_pos, end_pos, case when fid%3=0 then 'G'||fid when fid%3=1 then 'CDS:E'||fid else 'gene:'||contig||'-'||start_pos||'-'||end_pos end id from features", "features"))
def annotations(spark, sf):
    attrs = F.expr("case when fid%3=0 then concat('ID=G',fid,';Name=x') when fid%3=1 then concat('Name=y;exon_id=E',fid) else 'Name=z' end")
    line = F.concat_ws("\t", "contig", F.lit("src"), F.expr("case when fid%3=1 then 'CDS' else 'gene' end"), (F.col("start_pos") + 1).cast("string"), F.col("end_pos").cast("string"), F.lit("."), F.lit("+"), F.lit("."), attrs)
    return gff.parse(fixture(spark, sf, "features").select(line.alias("value")), False).select("contig", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.col("fid").alias("id"))


@query("s25_ploidy_configs", "select * from (values ('haploid',1,1,1), ('diploid_autosomes',2,null,1), ('diploid_xx',2,2,1), ('XX',2,2,1), ('diploid_xy',2,1,1), ('XY',2,1,1)) v(name, chr1, x, m)")
def ploidy_configs(spark, sf):
    got = [(n, P.copies("chr1", c), P.copies("chrX", c), P.copies("chrM", c)) for n, c in P.CONFIGS.items()]
    return spark.createDataFrame(got, "name string, chr1 int, x int, m int")


@query("s28_disease_catalog", sql("select contig, start_pos, end_pos, 'L'||locus_index locus_id, motif, 1+locus_index%2 n_diseases, case when locus_index%3=0 then locus_index end least_pathogenic from loci", "loci"))
def disease_catalog(spark, sf):
    form = F.expr("case when locus_index%3=0 then concat('CN>=',locus_index) else '' end")
    line = F.concat_ws("\t", "contig", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), F.expr("case when locus_index%2=0 then 'D1' else 'D1;D2' end"), F.lit("AD;AR"), F.lit("GENE"), F.lit("A 2001;B 2002"), form, F.lit(""), F.concat(F.lit("ID=L"), "locus_index", F.lit(";MOTIF="), "motif"))
    x = bed.disease_loci(bed.rows(fixture(spark, sf, "loci").select(F.col("locus_index").alias("line"), line.alias("value"))))
    return x.select("contig", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "locus_id", "motif", F.size("diseases").alias("n_diseases"), "least_pathogenic")


@query("s23_sample_of_header", sql("select contig, case when count(distinct locus_index%3)=1 then 's'||min(locus_index%3) end sample from loci where locus_index%22<>5 or locus_index%3=0 group by contig", "loci"))
def sample_of_header(spark, sf):
    """The one sample of each header's read groups, or null: a header for each contig."""
    line = F.concat(F.lit("@RG\tID:"), "locus_index", F.lit("\tPL:x\tSM:s"), F.col("locus_index") % 3)
    h = fixture(spark, sf, "loci").where("locus_index%22<>5 or locus_index%3=0").select("contig", line.alias("value"))
    return reads.samples(h, "contig")


@query("s26_bed_contigs", sql("select distinct contig from loci", "loci"))
def bed_contigs(spark, sf):
    return bed.contigs(rows(spark, sf))


@query("a19_a20_catalog_hash")
def catalog_hash(spark, sf):
    return bed.catalog_hash(bed.loci(rows(spark, sf), P.CONFIGS["XY"]))


def _rows6(spark, sf):
    """Catalog rows with a sixth column of copies, and the motif last."""
    l = fixture(spark, sf, "loci")
    return l.select(F.col("locus_index").alias("line"), F.array(F.col("contig"), F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), F.lit("trf"), F.lit("3"), (F.col("locus_index") / 2).cast("string"), F.col("motif")).alias("cols"))


_C3 = "contig||chr(9)||start_pos||chr(9)||end_pos||chr(9)||"
_CONVERSIONS = {
    ("bed", "bed4", "f16"): _C3 + "motif",
    ("bed", "gangstr", "f18"): _C3 + "length(motif)||chr(9)||motif",
    ("bed", "hipstr", "f19"): _C3 + "length(motif)||chr(9)||cast(round_even(locus_index/2.0e0,0) as bigint)",
    ("bed", "trgt", "f20"): _C3 + "'ID=locus'||(locus_index-1)||';MOTIFS='||motif||';STRUC=('||motif||')n'",
    ("bed", "expansionhunter", "f17"): "'{\"LocusId\":\"Locus'||locus_index||'\",\"LocusStructure\":\"('||motif||')*\",\"ReferenceRegion\":\"'||contig||':'||start_pos||'-'||end_pos||'\",\"VariantType\":\"Repeat\"}'",
    ("trf", "trf", "f23"): _C3 + "'trf'||chr(9)||'3'||chr(9)||printf('%.1f', locus_index/2.0e0)||chr(9)||motif",
}
for (_a, _b, _n), _e in _CONVERSIONS.items():
    query(f"{_n}_convert_to_{_b}", sql(f"select locus_index line, {_e} as value from loci", "loci"))(lambda spark, sf, a=_a, b=_b: K.convert(_rows6(spark, sf), a, b).select("line", "value"))


def _trgt_rows(spark, sf):
    kind = F.expr("case locus_index%4 when 0 then concat('ID=T',locus_index,';MOTIFS=CAG,CAA;STRUC=(CAG)n(CAA)n') when 1 then concat('ID=T',locus_index,';MOTIFS=CACA,CATA,CA;STRUC=<TR>') when 2 then concat('ID=T',locus_index,';MOTIFS=CAG,TTTTT;STRUC=(CAG)n(TTTTT)n') else concat('ID=T',locus_index,';MOTIFS=',motif,';STRUC=(',motif,')n') end")
    return fixture(spark, sf, "loci").select(F.col("locus_index").alias("line"), F.array(F.col("contig"), F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), kind).alias("cols"))


_TRGT = "case locus_index%4 when 0 then 'CAR' when 1 then 'CAYA' when 2 then 'CAG' else motif end"


@query("f21_trgt_to_bed4", sql(f"select locus_index line, {_C3}{_TRGT} as value from loci", "loci"))
def trgt_to_bed4(spark, sf):
    return K.convert(_trgt_rows(spark, sf), "trgt", "straglr").select("line", "value")


@query("f22_trgt_to_own", sql(f"select locus_index line, {_C3}'ID=T'||locus_index||';MOTIF='||{_TRGT} as value from loci", "loci"))
def trgt_to_own(spark, sf):
    return K.convert(_trgt_rows(spark, sf), "trgt", "own").select("line", "value")


@query("u01_o08_combine_catalogs", sql("select contig, start_pos, end_pos, motif, row_number() over (order by cast(substr(contig,4) as int), start_pos, end_pos, motif) rk from (select contig, start_pos, end_pos, motif from loci where locus_index%2=0 union select contig, start_pos, end_pos, motif from loci where locus_index%3<>0)", "loci"))
def combine_catalogs(spark, sf):
    plain = _rows6(spark, sf)
    both = K.combine([plain.where("line % 2 = 0"), plain.where("line % 3 <> 0")])
    placed = numbered(both.withColumn("c", S.chromosome_order(F.col("contig"))), ["c", "start", "end", "motif"])
    return placed.select("contig", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "motif", F.col("line").alias("rk"))


# --- call sets: each sample of the trio written as a caller's text, read back, joined ---


def _calls(spark, sf, smp):
    g = fixture(spark, sf, "gt").where(f"smp = {smp}").join(fixture(spark, sf, "loci"), "locus_index")
    return g.withColumn("k", F.concat_ws("\t", "contig", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), "motif"))


def _own_tsv(g):
    miss = F.when(F.col("locus_index") % 11 == 0, F.concat(F.col("a0"), F.lit("|."))).otherwise(F.concat_ws("|", "a0", "a1"))
    return g.select(F.concat_ws("\t", "k", F.lit("5"), F.lit("x"), miss, F.expr("concat(a0-1,'-',a0+1,'|',a1-1,'-',a1+1)")).alias("value"))


_KEYED = "contig, start_pos, end_pos, motif"
_SEEN = "count(*) n, cast(sum(cast({s} as int)) as bigint) n_strict"


def _counted(t):
    a = H.agreement(t)
    return a.groupBy("contig").agg(F.count("*").alias("n"), F.sum(F.coalesce("strict", F.lit(False)).cast("int")).alias("n_strict"), F.sum(F.coalesce("ci_95", F.lit(False)).cast("int")).alias("n_ci"))


def _ci_sql(w):
    return "(" + " or ".join(f"(abs(c{k}-m{i})<={w} and abs(c{1-k}-f{j})<={w})" for k in (0, 1) for i in (0, 1) for j in (0, 1)) + ")"


_STRICT = "((c0 in (m0,m1) and c1 in (f0,f1)) or (c0 in (f0,f1) and c1 in (m0,m1)))"


@query("s08_p07_own_tsv_trio", sql(f"select contig, count(*) n, cast(sum(cast({_STRICT} as int)) as bigint) n_strict, cast(sum(cast({_ci_sql(2)} as int)) as bigint) n_ci from trio where locus_index%11<>0 group by contig", "trio"))
def own_tsv_trio(spark, sf):
    return _counted(H.trio(*[callers.own_tsv(_own_tsv(_calls(spark, sf, s))) for s in range(3)]))


_PLAIN = sql(f"select contig, count(*) n, cast(sum(cast({_STRICT} as int)) as bigint) n_strict from trio group by contig", "trio")


def _strict_only(t):
    return _counted(t).drop("n_ci")


@query("s18_tandem_genotypes_trio", _PLAIN)
def tandem_genotypes_trio(spark, sf):
    text = lambda g: g.select(F.concat_ws("\t", "k", F.lit("."), F.lit("."), F.col("a0").cast("string"), F.col("a1").cast("string")).alias("value"))
    return _strict_only(H.trio(*[callers.tandem_genotypes(text(_calls(spark, sf, s))) for s in range(3)]))


@query("s19_repeathmm_trio", _PLAIN)
def repeathmm_trio(spark, sf):
    text = lambda g: g.select(F.concat(F.concat_ws(":", "contig", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), "motif"), F.lit(" "), F.concat_ws("/", "a0", "a1")).alias("value"))
    return _strict_only(H.trio(*[callers.repeathmm(text(_calls(spark, sf, s))) for s in range(3)]))


@query("s17_j08_straglr_trio", sql(f"select contig, count(*) n, cast(sum(cast({_ci_sql('0.4999e0')} as int)) as bigint) n_decimal from trio group by contig", "trio"))
def straglr_trio(spark, sf):
    text = lambda g: g.select(F.concat_ws("\t", "k", F.lit("x"), F.expr("case when a0=a1 then concat(a0,'.0(9)') else concat(a0,'.0(4);',a1,'.0(5)') end")).alias("value"))
    catalog = fixture(spark, sf, "loci").select("contig", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "motif")
    t = H.trio(*[callers.straglr(text(_calls(spark, sf, s)), catalog) for s in range(3)])
    return H.agreement(t, decimal=True).groupBy("contig").agg(F.count("*").alias("n"), F.sum(F.col("strict").cast("int")).alias("n_decimal"))


def _vcf(g, ref, alts, info, fmt, values):
    head = ["contig", (F.col("start_pos") + 1).cast("string"), F.concat(F.lit("L"), F.col("locus_index")), ref, alts, F.lit("."), F.lit("PASS"), info, F.lit(fmt), values]
    return vcf_source.records(g.select(F.concat_ws("\t", *head).alias("value")))


_N = F.lit


@query("s10_j05_own_vcf_trio", sql(f"select contig, count(*) n, cast(sum(cast({_STRICT} as int)) as bigint) n_strict, cast(sum(cast({_ci_sql(2)} as int)) as bigint) n_ci from trio group by contig", "trio"))
def own_vcf_trio(spark, sf):
    def side(s):
        info = F.concat(_N("VT=str;MOTIF="), F.col("motif"), _N(";REFMC=4;BED_START="), F.col("start_pos"), _N(";BED_END="), F.col("end_pos"))
        vals = F.expr("concat('0/1:',a0,',',a1,':',a0-1,'-',a0+1,',',a1-1,'-',a1+1,':',a0,'x3|',a1,'x2:.')")
        return vcf_source.own(_vcf(_calls(spark, sf, s), _N("A"), _N("AT"), info, "GT:MC:MCCI:MCRL:PS", vals)).drop("pos", "ref")

    return _counted(H.trio(*[side(s) for s in range(3)]))


@query("s12_p06_only_phased", sql("select contig, count(*) n from trio where locus_index%4=0 group by contig", "trio"))
def only_phased(spark, sf):
    def side(s):
        info = F.concat(_N("VT=str;MOTIF="), F.col("motif"), _N(";REFMC=4;BED_START="), F.col("start_pos"), _N(";BED_END="), F.col("end_pos"))
        vals = F.expr("concat('0|1:',a0,',',a1,':',a0-1,'-',a0+1,',',a1-1,'-',a1+1,':',a0,'x3|',a1,'x2:',case when locus_index%4=0 then '7' else '.' end)")
        return vcf_source.own(_vcf(_calls(spark, sf, s), _N("A"), _N("AT"), info, "GT:MC:MCCI:MCRL:PS", vals), True).drop("pos", "ref")

    return H.trio(*[side(s) for s in range(3)]).groupBy("contig").agg(F.count("*").alias("n"))


@query("s14_gangstr_trio", sql(f"select contig, count(*) n, cast(sum(cast({_STRICT} as int)) as bigint) n_strict, cast(sum(cast({_ci_sql(2)} as int)) as bigint) n_ci from trio group by contig", "trio"))
def gangstr_trio(spark, sf):
    def side(s):
        info = F.concat(_N("RU="), F.col("motif"), _N(";REF=4;END="), F.col("end_pos"))
        return vcf_source.gangstr(_vcf(_calls(spark, sf, s), _N("A"), _N("."), info, "GT:REPCN:REPCI", F.expr("concat('0/1:',a0,',',a1,':',a0-1,'-',a0+1,',',a1-1,'-',a1+1)"))).drop("pos", "ref")

    return _counted(H.trio(*[side(s) for s in range(3)]))


@query("s15_expansionhunter_trio", sql(f"select contig, count(*) n, cast(sum(cast({_STRICT} as int)) as bigint) n_strict, cast(sum(cast({_ci_sql(2)} as int)) as bigint) n_ci from trio group by contig", "trio"))
def expansionhunter_trio(spark, sf):
    def side(s):
        info = F.concat(_N("RU="), F.col("motif"), _N(";REF=4;END="), F.col("end_pos"))
        return vcf_source.expansionhunter(_vcf(_calls(spark, sf, s), _N("A"), _N("<STR9>"), info, "GT:REPCN:REPCI", F.expr("concat('0/1:',a1,'/',a0,':',a1-1,'-',a1+1,'/',a0-1,'-',a0+1)"))).drop("pos", "ref")

    return _counted(H.trio(*[side(s) for s in range(3)]))


@query("s16_trgt_trio", sql(f"select contig, count(*) n, cast(sum(cast({_STRICT} as int)) as bigint) n_strict, cast(sum(cast({_STRICT} as int)) as bigint) n_seq from trio group by contig", "trio"))
def trgt_trio(spark, sf):
    def side(s):
        info = F.concat(_N("MOTIFS="), F.col("motif"), _N(",A;END="), F.col("end_pos"))
        return vcf_source.trgt(_vcf(_calls(spark, sf, s), F.expr("repeat('CAG',cast(a1 as int))"), F.expr("repeat('CAG',cast(a0 as int))"), info, "GT:MC", F.expr("concat('1/0:',a1,'_2,',a0,'_3')"))).drop("pos", "ref")

    a = H.agreement(H.trio(*[side(s) for s in range(3)]))
    return a.groupBy("contig").agg(F.count("*").alias("n"), F.sum(F.col("strict").cast("int")).alias("n_strict"), F.sum(F.col("seq").cast("int")).alias("n_seq"))


@query("s13_generic_vcf", sql("select contig, count(*) n, cast(sum(a0) as double) s0, cast(sum(a1) as double) s1 from gt join loci using (locus_index) where smp=0 group by contig", "gt", "loci"))
def generic_vcf(spark, sf):
    g = _calls(spark, sf, 0)
    r = _vcf(g, F.expr("repeat(motif,cast(a0 as int))"), F.expr("repeat(motif,cast(a1 as int))"), F.concat(_N("START="), F.col("start_pos") + 1, _N(";END="), F.col("start_pos") + 2), "GT", _N("0/1"))
    catalog = g.select("contig", F.col("start_pos").alias("start"), (F.col("start_pos") + 3).alias("end"), "motif")
    return vcf_source.generic(r, catalog).groupBy("contig").agg(F.count("*").alias("n"), F.sum(F.get("gt", F.lit(0))).alias("s0"), F.sum(F.get("gt", F.lit(1))).alias("s1"))


@query("s09_json_report", sql("select contig, count(*) n, cast(sum(a0+a1) as double) s, cast(sum(a0-1) as double) lo from gt join loci using (locus_index) where smp=0 group by contig", "gt", "loci"))
def json_report(spark, sf):
    x = _calls(spark, sf, 0).select(F.struct("contig", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "motif", F.array("a0", "a1").alias("call"), F.expr("array(array(a0-1,a0+1),array(a1-1,a1+1))").alias("call_95_cis")).alias("r"), "contig")
    doc = x.groupBy("contig").agg(F.to_json(F.struct(F.lit("s").alias("sample_id"), F.collect_list("r").alias("results"))).alias("j"))
    parsed = doc.select(F.from_json("j", callers.REPORT).alias("d")).select("d.*")
    return callers.report(parsed).groupBy("contig").agg(F.count("*").alias("n"), F.sum(F.col("gt")[0] + F.col("gt")[1]).alias("s"), F.sum(F.col("ci95")[0]["lo"]).alias("lo"))


@query("s27_vcf_header_contigs", sql("select distinct contig from loci", "loci"))
def vcf_header_contigs(spark, sf):
    c = fixture(spark, sf, "loci").select("contig").distinct()
    return vcf_source.header_contigs(c.select(F.concat(F.lit("##contig=<ID="), "contig", F.lit(",length=5>")).alias("value")))


@query("s22_j11_snvs_in_reads", sql("select f.fid, count(*) n from features f join (select locus_index, contig, start_pos+locus_index%7 pos from loci where locus_index%3<>0) s on s.contig=f.contig and s.pos>=f.start_pos and s.pos<f.end_pos group by 1", "features", "loci"))
def snvs_in_reads(spark, sf):
    from ..operators.intervals import overlap_join

    l = fixture(spark, sf, "loci")
    line = F.concat_ws("\t", "contig", (F.col("start_pos") + F.col("locus_index") % 7 + 1).cast("string"), F.lit("rs"), F.lit("A"), F.when(F.col("locus_index") % 3 == 0, F.lit("AT")).otherwise(F.lit("C")), F.lit("."), F.lit("."), F.lit("X=1"), F.lit("GT"), F.lit("0/1"))
    s = vcf_source.single_base(vcf_source.records(l.select(line.alias("value")))).select(F.col("contig").alias("contig2"), F.col("pos").alias("fstart"), (F.col("pos") + 1).alias("fend"))
    return overlap_join(fixture(spark, sf, "features"), s, ("contig", "contig2"), ("start_pos", "end_pos"), ("fstart", "fend")).groupBy("fid").agg(F.count("*").alias("n"))


def _sam(spark, sf):
    cig = F.expr("concat(fid%3*60,'S',end_pos-start_pos,'M5D',(fid+1)%2*150,'S')")
    line = F.concat_ws("\t", F.concat(F.lit("r"), F.col("fid") % 500), F.expr("cast(case when fid%13=0 then 2048 when fid%7=0 then 256 else fid%2*16 end as string)"), "contig", (F.col("start_pos") + 1).cast("string"), F.lit("60"), cig, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGT"), F.lit("IIII"), F.lit("NM:i:1"), F.concat(F.lit("HP:i:"), F.col("fid") % 2))
    return reads.from_sam(fixture(spark, sf, "features").select(line.alias("value")))


@query("s21_sam_reads", sql("select contig, count(*) n, cast(sum(end_pos+5) as bigint) ends, cast(sum(fid%2) as bigint) hp from features where fid%13<>0 and fid%7<>0 group by 1", "features"))
def sam_reads(spark, sf):
    r = _sam(spark, sf)
    return r.where(reads.primary(F.col("flag"))).groupBy("contig").agg(F.count("*").alias("n"), F.sum("end").alias("ends"), F.sum(F.col("hp").cast("long")).alias("hp"))


@query("f36_chimeric_reads", sql("select 'r'||(fid%500) read_name, bit_or(case when fid%3*60>=100 then 1 else 0 end + case when (fid+1)%2*150>=100 then 2 else 0 end)=3 and count(*)>1 chimeric from features group by 1", "features"))
def chimeric_reads(spark, sf):
    return reads.chimeric(_sam(spark, sf)).select("read_name", "chimeric")


@query("s20_j10_reference_slices", sql("select doc_id, substr(replace(upper(text), chr(10), ''), cast(doc_id%100+1 as int), 150) ref_seq from (select doc_id, regexp_replace(text, '[^A-Za-z]', 'n', 'g') text from documents) where length(text)>doc_id%100"))
def reference_slices(spark, sf):
    from .fixtures import table

    d = table(spark, sf, "documents").selectExpr("doc_id", "regexp_replace(text,'[^A-Za-z]','n') t").where("length(t) > doc_id%100")
    body = d.select("doc_id", F.posexplode(F.regexp_extract_all("t", F.lit(".{1,60}"), F.lit(0))).alias("i", "value"))  # letters only
    lines = body.selectExpr("doc_id*1000000L+i+1 line", "value").unionByName(d.selectExpr("doc_id*1000000L line", "concat('>',doc_id,' x') value"))
    chunks = reads.fasta_chunks(lines, 128)
    spans = d.selectExpr("doc_id", "cast(doc_id as string) contig", "doc_id%100 s", "doc_id%100+150 e")
    return reads.slices(spans, chunks, "doc_id", "s", "e", 128)


@query("s20_contig_lengths", sql("select cast(doc_id as varchar) contig, cast(length(t) as bigint) length from (select doc_id, text t from documents where length(text)>0)"))
def contig_lengths(spark, sf):
    from .fixtures import table

    d = table(spark, sf, "documents").where("length(text) > 0").selectExpr("doc_id", "regexp_replace(text,'[^A-Za-z]','n') t")
    lines = d.selectExpr("doc_id*10L+1 line", "t value").unionByName(d.selectExpr("doc_id*10L line", "concat('>',doc_id) value"))
    return reads.contig_lengths(reads.fasta_chunks(lines, 500))


# --- output ---


@query("k03_k05_vcf_records", sql("select contig, start_pos-1 pos, contig||chr(9)||(start_pos-1)||chr(9)||'L'||locus_index||chr(9)||'GA'||repeat(motif,2)||chr(9)||case when a0=a1 then 'GA'||repeat(motif,cast(a0 as int)) else least('GA'||repeat(motif,cast(a0 as int)),'GA'||repeat(motif,cast(a1 as int)))||','||greatest('GA'||repeat(motif,cast(a0 as int)),'GA'||repeat(motif,cast(a1 as int))) end||chr(9)||'.'||chr(9)||'.'||chr(9)||'VT=str;MOTIF='||motif||';REFMC=2;BED_START='||start_pos||';BED_END='||end_pos||';ANCH=1'||case when locus_index%2=0 then ';ANNOT=g'||locus_index||',CDS:x' else '' end||chr(9)||'GT:PM:NSNV:DP:MMAS:DPS:AD:MC:MCCI:ANCL:CONS:MCRL:SLR:AM:AMC:PS'||chr(9)||case when a0=a1 then '1/1' when 'GA'||repeat(motif,cast(a0 as int))<'GA'||repeat(motif,cast(a1 as int)) then '1/2' else '2/1' end||':'||case when locus_index%3=0 then 'snv:2' else 'dist:.' end||':5:1.5:3:2,1:'||a0||','||a1||':'||(a0-1)||'-'||(a0+1)||','||(a1-1)||'-'||(a1+1)||':'||case when a0=a1 then '2,2:single' else '2,2,2:single,poa' end||':'||a0||'x2,'||a1||'x1:'||a0*3||'x2,'||a1*3||'x1:0.5,0.25:2.0,3.0:.' as line from gt join loci using (locus_index) where smp=0", "gt", "loci"))
def vcf_records(spark, sf):
    g = _calls(spark, sf, 0).selectExpr(
        "contig", "start_pos start", "end_pos end", "concat('L',locus_index) locus_id", "motif", "2 ref_cn", "'TTTGA' ref_anchor", "repeat(motif,2) ref_seq", "array('TTTGA','tttga') anchors",
        "array(repeat(motif,cast(a0 as int)),repeat(motif,cast(a1 as int))) seqs", "2 n_alleles", "array(a0,a1) call", "array(struct(a0-1 as lo,a0+1 as hi),struct(a1-1 as lo,a1+1 as hi)) ci95", "array(array(a0,a0),array(a1)) cns", "cast(null as int) ps",
        "array('single','poa') cons", "array(array(cast(a0*3 as int),cast(a0*3 as int)),array(cast(a1*3 as int))) lens", "case when locus_index%3=0 then 'snv' else 'dist' end method", "case when locus_index%3=0 then 2 end n_snvs", "5 depth",
        "cast(1.5 as double) mean_score", "array(cast(0.5 as double),cast(0.25 as double)) am", "array(cast(2 as double),cast(3 as double)) amc", "case when locus_index%2=0 then array(concat('g',locus_index),'CDS:x') else array() end annotations",
    )
    ready = g.withColumn("anchors", F.array(F.lit("TTTGA"), F.lit("tttga")))
    return V.lines(ready, 4, True)


@query("k04_w05_snv_records", sql("with s as (select contig, 's'||(start_pos//100) id, locus_index, row_number() over (partition by contig, start_pos//100 order by locus_index) r from loci) select contig, id, locus_index from s where r=1", "loci"))
def snv_records(spark, sf):
    s = fixture(spark, sf, "loci").select("contig", F.expr("concat('s', start_pos div 100)").alias("id"), "locus_index")
    return V.distinct_snvs(s)


@query("k04_snv_lines", sql("select contig, start_pos+1 pos, contig||chr(9)||(start_pos+1)||chr(9)||'s'||locus_index||chr(9)||'A'||chr(9)||case locus_index%3 when 0 then 'C' else 'C,G' end||chr(9)||'.'||chr(9)||'.'||chr(9)||'VT=snv'||chr(9)||'GT:DP:AD'||chr(9)||case locus_index%3 when 0 then '0/1:9:4,5' else '2/1:9:4,5' end as line from loci where locus_index%3<2", "loci"))
def snv_lines(spark, sf):
    s = fixture(spark, sf, "loci").selectExpr("contig", "start_pos pos", "concat('s',locus_index) id", "'A' ref", "case locus_index%3 when 0 then array('A','C') when 1 then array('G','C') else array('A','A') end call", "array(4,5) rcs")
    return V.snv_lines(s)


@query("k07_mi_json")
def mi_json(spark, sf):
    return H.report(H.with_kinds(fixture(spark, sf, "trio")))


@query("k08_mi_summary", sql(f"select 'MI% (strict): '||printf('%.2f', avg(cast({_STRICT} as int))*100)||chr(10)||'MI% (pm1): '||printf('%.2f', avg(cast({_ci_sql(1)} as int))*100) txt from trio", "trio"))
def mi_summary(spark, sf):
    return H.summary(H.with_kinds(fixture(spark, sf, "trio")))


@query("k01_f42_json_results", sql("select locus_index, '{\"locus_index\":'||locus_index||',\"contig\":\"'||contig||'\",\"call\":['||a0||','||a1||']}' json from gt join loci using (locus_index) where smp=0", "gt", "loci"))
def json_results(spark, sf):
    return R.result_lines(_calls(spark, sf, 0).select("locus_index", "contig", F.array("a0", "a1").alias("call")))


_FIELDS = """INFO VT 1 String|INFO MOTIF 1 String|INFO REFMC 1 Integer|INFO BED_START 1 Integer|INFO BED_END 1 Integer|INFO ANCH 1 Integer|INFO ANNOT 1 String
|FORMAT AD . Integer|FORMAT AM . Float|FORMAT AMC . Float|FORMAT ANCL . Integer|FORMAT CONS . String|FORMAT DP 1 Integer|FORMAT DPS 1 Integer|FORMAT GT 1 String|FORMAT MC . Integer|FORMAT MCCI . String
|FORMAT MCRL . String|FORMAT MMAS 1 Float|FORMAT NSNV 1 Integer|FORMAT PS 1 Integer|FORMAT PM 1 String|FORMAT SLR . String"""


@query("k02_vcf_header", sql("select string_split(x,' ')[1] kind, string_split(x,' ')[2] id, string_split(x,' ')[3] number, string_split(x,' ')[4] type from (select unnest(string_split('" + _FIELDS.replace("\n", "") + "','|')) x) union all select 'contig', contig, cast(max(end_pos) as varchar), null from loci group by contig union all select 'last', 's1', null, null", "loci"))
def vcf_header(spark, sf):
    """Every declared field and contig of a header; the contigs are a few rows."""
    contigs = [(r["contig"], r["n"]) for r in fixture(spark, sf, "loci").groupBy("contig").agg(F.max("end_pos").alias("n")).collect()]
    h = spark.createDataFrame([(x,) for x in V.header(contigs, "s1", {"source": "x"}, True)], "value string")
    part = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    kind = F.when(F.col("value").startswith("#CHROM"), "last").otherwise(part("^##(INFO|FORMAT|contig)="))
    ident = F.when(kind == "last", F.element_at(F.split("value", "\t"), -1)).otherwise(part("ID=([^,>]+)"))
    return h.select(kind.alias("kind"), ident.alias("id"), F.coalesce(part("Number=([^,>]+)"), part("length=([0-9]+)")).alias("number"), part("Type=([^,>]+)").alias("type")).where("kind is not null")


@query("k10_f40_locus_search", sql("select locus_index from loci where contig||':'||start_pos||'-'||end_pos like '%chr2:1%'", "loci"))
def locus_search(spark, sf):
    l = fixture(spark, sf, "loci").select("locus_index", "contig", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    return R.search(l, "CHR2:1").select("locus_index")


@query("k10_first_loci", sql("select locus_index from loci order by locus_index limit 10", "loci"))
def first_loci(spark, sf):
    l = fixture(spark, sf, "loci").select("locus_index", "contig", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    return R.search(l).select("locus_index")


@query("k10_call_data", sql("select locus_index, motif from loci where locus_index=42", "loci"))
def call_data(spark, sf):
    return R.call_data(fixture(spark, sf, "loci"), 42).select("locus_index", "motif")
