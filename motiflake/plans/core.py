"""Queries over scalar functions, interval joins and trio inheritance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import inherit as H
from ..operators import intervals as I
from .fixtures import fixture, sql, table
from .registry import query



class Alleles(Sequence):
    """Columns by name, made when they are asked for: there may be no session yet when this module is imported."""

    def __init__(self, *names: str):
        self.names = names

    def __getitem__(self, i: int):
        return F.col(self.names[i])

    def __len__(self) -> int:
        return len(self.names)


C, M, P = Alleles("c0", "c1"), Alleles("m0", "m1"), Alleles("f0", "f1")
STRICT_SQL = "((c0 in (m0,m1) and c1 in (f0,f1)) or (c0 in (f0,f1) and c1 in (m0,m1)))"


def _configs_sql(test: str) -> str:
    """All eight assignments; test has {a} for a child's and {b} for a parent's allele."""
    return " or ".join(f"({test.format(a=f'c{k}', b=f'm{i}')} and {test.format(a=f'c{1-k}', b=f'f{j}')})" for k in (0, 1) for i in (0, 1) for j in (0, 1))


PM1_SQL = f"({_configs_sql('abs({a}-{b})<=1')})"


@query("j05_trio_mi_by_contig", sql(f"select contig, count(*) n, cast(sum(cast({STRICT_SQL} as int)) as bigint) n_strict, cast(sum(cast({PM1_SQL} as int)) as bigint) n_pm1 from trio group by contig", "trio"))
def trio_mi_by_contig(spark, sf):
    kinds = H.with_kinds(fixture(spark, sf, "trio"))
    return kinds.groupBy("contig").agg(F.count("*").alias("n"), F.sum(F.col("strict").cast("int")).alias("n_strict"), F.sum(F.col("pm1").cast("int")).alias("n_pm1"))


@query("f06_f09_strict_and_pm1", sql(f"select locus_index, {STRICT_SQL} strict, {PM1_SQL} pm1 from trio", "trio"))
def strict_and_pm1(spark, sf):
    return fixture(spark, sf, "trio").select("locus_index", S.strict(C, M, P).alias("strict"), S.plus_minus_one(C, M, P).alias("pm1"))


@query("f07_decimal_mi", sql(f"select locus_index, ({_configs_sql('abs({a}*0.3e0-{b}*0.31e0)<0.5e0')}) ok from trio", "trio"))
def decimal_mi(spark, sf):
    scale = lambda g, k: [x * F.lit(k) for x in g]
    return fixture(spark, sf, "trio").select("locus_index", S.decimal(scale(C, 0.3), scale(M, 0.31), scale(P, 0.31)).alias("ok"))


@query(
    "f04_f08_ci_mi",
    sql(
        "select locus_index, case when locus_index%7=0 then null else ("
        + _configs_sql("(({b}+2)*1.1-({a}-1)>-0.0001 and ({a}+1)-({b}-2)*0.9>-0.0001)").replace("+2)*1.1", "+2)+({0}+2)*0.1").replace("{0}", "{b}")
        + ") end ok from trio",
        "trio",
    ).replace("+2)+({b}+2)*0.1", "+2)*1.1"),
)
def ci_mi(spark, sf):
    hole = F.when(F.col("locus_index") % 7 == 0, F.lit(None).cast("double"))
    ci = lambda x, d: (F.when(F.col("locus_index") % 7 != 0, x - F.lit(float(d))).otherwise(hole), x + F.lit(float(d)))
    return fixture(spark, sf, "trio").select("locus_index", S.by_ci([ci(x, 1) for x in C], [ci(x, 2) for x in M], [ci(x, 2) for x in P], 0.1).alias("ok"))


def _alleles(g):
    return [F.repeat(F.lit("CAG"), x) if i == 0 else F.concat(F.repeat(F.lit("CAG"), x - 1), F.lit("CAA")) for i, x in enumerate(g)]


_SEQ_SQL = "select *, " + ", ".join(f"repeat('CAG',cast({g}0 as int)) s{g}0, repeat('CAG',cast({g}1-1 as int))||'CAA' s{g}1" for g in "cmf") + " from trio"


@query(
    "f10_f50_sequence_mi",
    sql(
        f"""with q as ({_SEQ_SQL}) select locus_index, ((sc0 in (sm0,sm1) and sc1 in (sf0,sf1)) or (sc0 in (sf0,sf1) and sc1 in (sm0,sm1))) seq,
        {STRICT_SQL.replace("in (m0,m1)", "in (m0,m1)")} sl, ({_configs_sql("abs({a}*3-{b}*3)<=1")}) sl_pm1 from q""",
        "trio",
    ),
)
def sequence_mi(spark, sf):
    kinds = S.by_sequence(_alleles(C), _alleles(M), _alleles(P))
    return fixture(spark, sf, "trio").select("locus_index", kinds.alias("k")).select("locus_index", "k.seq", "k.sl", "k.sl_pm1")


@query(
    "a01_a02_overall_rates",
    sql(f"select contig, count(*) n_total, cast(sum(cast({STRICT_SQL} as int)) as bigint) n_strict, round(avg(cast({STRICT_SQL} as int)), 6) strict, round(sum(case when locus_index%7=0 then 0 else cast({PM1_SQL} as int) end)/count(*), 6) ci_like from trio group by rollup (contig)", "trio"),
)
def overall_rates(spark, sf):
    t = H.with_kinds(fixture(spark, sf, "trio")).withColumn("ci", F.when(F.col("locus_index") % 7 != 0, F.col("pm1")))
    return t.rollup("contig").agg(
        F.count("*").alias("n_total"), F.sum(F.col("strict").cast("int")).alias("n_strict"), F.round(H.rate(F.col("strict")), 6).alias("strict"), F.round(H.rate(F.col("ci")), 6).alias("ci_like")
    )


@query(
    "a03_length_histogram",
    sql(f"with b as (select unnest(range(0, (select max(end_pos-start_pos) from trio)+10, 10)) bin_start), h as (select (end_pos-start_pos)//10*10 bin_start, count(*) n, avg(cast({STRICT_SQL} as int)) strict from trio group by 1) select cast(b.bin_start as bigint) bin_start, cast(coalesce(n,0) as bigint) n, round(strict,6) strict from b left join h using (bin_start)", "trio"),
)
def length_histogram(spark, sf):
    return H.length_histogram(H.with_kinds(fixture(spark, sf, "trio")), 10).select("bin_start", "n", F.round("strict", 6).alias("strict"))


@query("a04_seen_loci", sql("select contig, count(distinct (contig,start_pos,end_pos)) n_seen, cast(sum(end_pos-start_pos) as bigint) bases from trio group by contig", "trio"))
def seen_loci(spark, sf):
    return fixture(spark, sf, "trio").groupBy("contig").agg(F.countDistinct("contig", "start_pos", "end_pos").alias("n_seen"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))


@query("a05_bernoulli_error", sql(f"with r as (select contig, avg(cast({STRICT_SQL} as int)) p, count(*) n from trio group by contig) select contig, round(sqrt(p*(1-p)/n),6) se, round(p-1.96*sqrt(p*(1-p)/n),6) lo, round(p+1.96*sqrt(p*(1-p)/n),6) hi from r", "trio"))
def bernoulli_error(spark, sf):
    r = H.with_kinds(fixture(spark, sf, "trio")).groupBy("contig").agg(H.rate(F.col("strict")).alias("p"), F.count("*").alias("n"))
    e = H.bernoulli(F.col("p"), F.col("n"))
    return r.select("contig", *[F.round(e[x], 6).alias(x) for x in ("se", "lo", "hi")])


@query("k06_mi_tsv", sql("select locus_index, contig||chr(9)||start_pos||chr(9)||end_pos||chr(9)||motif||chr(9)||c0||'|'||c1||chr(9)||m0||'|'||m1||chr(9)||f0||'|'||f1 as line from trio", "trio"))
def mi_tsv(spark, sf):
    return H.tsv(fixture(spark, sf, "trio")).select("locus_index", "line")


@query("f45_locus_text", sql("select locus_index, contig||':'||start_pos||'-'||end_pos||' (child: '||c0||'|'||c1||', mother: '||m0||'|'||m1||', father: '||f0||'|'||f1||')' as txt from trio", "trio"))
def locus_text(spark, sf):
    gt = lambda g: S.genotype_text(F.array(*g), "bigint")
    return fixture(spark, sf, "trio").select("locus_index", S.locus_text(F.col("contig"), F.col("start_pos"), F.col("end_pos"), gt(C), gt(M), gt(P)).alias("txt"))


@query("f44_genotype_text", sql("select locus_index, printf('%.1f', c0*0.5)||'|'||printf('%.1f', c1*0.5) dec, c0||'|'||case when locus_index%3=0 then '' else cast(c1 as varchar) end ints from trio", "trio"))
def genotype_text(spark, sf):
    holed = F.array(F.col("c0"), F.when(F.col("locus_index") % 3 != 0, F.col("c1")))
    return fixture(spark, sf, "trio").select("locus_index", S.genotype_text(F.array(*[x * F.lit(0.5) for x in C]), "double").alias("dec"), S.genotype_text(holed, "bigint").alias("ints"))


@query("f46_rates_csv", sql(f"select printf('%.4f', avg(cast({STRICT_SQL} as int)))||','||printf('%.4f', avg(cast({PM1_SQL} as int))) csv from trio", "trio"))
def rates_csv(spark, sf):
    r = H.with_kinds(fixture(spark, sf, "trio")).agg(H.rate(F.col("strict")).alias("a"), H.rate(F.col("pm1")).alias("b"))
    return r.select(F.concat_ws(",", F.format_string("%.4f", "a"), F.format_string("%.4f", "b")).alias("csv"))


@query("f47_flip_test", sql("select locus_index, (c0<>m1 or c1<>m0) and c0=m0 and c1=m1 and false or (not (c0=m0 and c1=m1) and c0=m1 and c1=m0) flip from trio", "trio"))
def flip_test(spark, sf):
    return fixture(spark, sf, "trio").select("locus_index", S.flipped(F.array(*C), F.array(*M)).alias("flip"))


@query("j13_inheritance_configs", sql("select locus_index, cast(least(" + ",".join(f"abs(c{k}-m{i})+abs(c{1-k}-f{j})" for k in (0, 1) for i in (0, 1) for j in (0, 1)) + ") as bigint) d from trio", "trio"))
def inheritance_configs(spark, sf):
    """Least distance over the assignments, by a join with the eight of them (a broadcast of eight rows)."""
    configs = spark.createDataFrame([(k, i, j) for k in (0, 1) for i, j in S.PARENT_CONFIGS], "k int, i int, j int")
    t = fixture(spark, sf, "trio").crossJoin(F.broadcast(configs))
    pick = lambda g, at: F.get(F.array(*g), at)
    d = F.abs(pick(C, F.col("k")) - pick(M, F.col("i"))) + F.abs(pick(C, 1 - F.col("k")) - pick(P, F.col("j")))
    return t.groupBy("locus_index").agg(F.min(d).cast("long").alias("d"))


_J1 = "l.contig=f.contig and l.start_pos<f.end_pos and f.start_pos<l.end_pos"
_SPANS = (("contig", "contig2"), ("start_pos", "end_pos"), ("fstart", "fend"))


def _features(spark, sf):
    return fixture(spark, sf, "features").select("fid", F.col("contig").alias("contig2"), F.col("start_pos").alias("fstart"), F.col("end_pos").alias("fend"))


@query("j01_interval_overlap", sql(f"select l.locus_index, f.fid from loci l join features f on {_J1}", "loci", "features"))
def interval_overlap(spark, sf):
    return I.overlap_join(fixture(spark, sf, "loci"), _features(spark, sf), *_SPANS).select("locus_index", "fid")


@query("j01_first_overlap", sql(f"select locus_index, fid from (select l.locus_index, f.fid, row_number() over (partition by l.locus_index order by f.end_pos, f.start_pos, f.fid) r from loci l join features f on {_J1}) where r=1", "loci", "features"))
def first_overlap(spark, sf):
    return I.first_match(I.overlap_join(fixture(spark, sf, "loci"), _features(spark, sf), *_SPANS), ["locus_index"], ["fend", "fstart", "fid"]).select("locus_index", "fid")


@query("j02_locus_annotations", sql(f"select l.locus_index, coalesce(string_agg(cast(f.fid as varchar), ',' order by f.fid), '') ids from loci l left join features f on {_J1} group by l.locus_index", "loci", "features"))
def locus_annotations(spark, sf):
    loci = fixture(spark, sf, "loci")
    found = I.overlap_join(loci, _features(spark, sf), *_SPANS).groupBy("locus_index").agg(F.array_sort(F.collect_list("fid")).alias("ids"))
    return loci.select("locus_index").join(found, "locus_index", "left").select("locus_index", F.array_join(F.coalesce("ids", F.array().cast("array<bigint>")), ",").alias("ids"))


@query("j03_overlap_semi", sql(f"select locus_index from loci l where exists (select 1 from features f where {_J1})", "loci", "features"))
def overlap_semi(spark, sf):
    return I.semi(fixture(spark, sf, "loci"), "locus_index", _features(spark, sf), *_SPANS).select("locus_index")


@query("j04_overlap_anti", sql(f"select locus_index from loci l where not exists (select 1 from features f where {_J1})", "loci", "features"))
def overlap_anti(spark, sf):
    return I.anti(fixture(spark, sf, "loci"), "locus_index", _features(spark, sf), *_SPANS).select("locus_index")


@query("p04_should_skip_locus", sql(f"select locus_index from loci l where exists (select 1 from features f where {_J1}) and not exists (select 1 from features f where l.contig=f.contig and l.start_pos<f.start_pos+1 and f.start_pos<l.end_pos)", "loci", "features"))
def should_skip_locus(spark, sf):
    """Loci that some feature covers in part, but none begins in: catalog and exclusion intervals are different ones."""
    f = _features(spark, sf)
    kept = I.semi(fixture(spark, sf, "loci"), "locus_index", f, *_SPANS)
    return I.anti(kept, "locus_index", f.withColumn("fend", F.col("fstart") + 1), *_SPANS).select("locus_index")


@query("j06_positional_first_same_motif", sql(f"select locus_index, fid from (select l.locus_index, f.fid, row_number() over (partition by l.locus_index order by f.start_pos, f.end_pos, f.fid) r from loci l join features f on {_J1} and f.fid%5=l.locus_index%5) where r=1", "loci", "features"))
def positional_first_same_motif(spark, sf):
    pairs = I.overlap_join(fixture(spark, sf, "loci"), _features(spark, sf), *_SPANS).where("fid % 5 = locus_index % 5")
    return I.first_match(pairs, ["locus_index"], ["fstart", "fend", "fid"]).select("locus_index", "fid")


@query("j07_positional_first", sql(f"select locus_index, fid from (select l.locus_index, f.fid, row_number() over (partition by l.locus_index order by f.start_pos, f.end_pos, f.fid) r from loci l join features f on {_J1}) where r=1", "loci", "features"))
def positional_first(spark, sf):
    return I.first_match(I.overlap_join(fixture(spark, sf, "loci"), _features(spark, sf), *_SPANS), ["locus_index"], ["fstart", "fend", "fid"]).select("locus_index", "fid")


@query("j09_locus_reads_flanked", sql("select l.locus_index, count(*) n, min(f.fid) first_fid from loci l join features f on l.contig=f.contig and l.start_pos-70<f.end_pos and f.start_pos<l.end_pos+70 group by 1", "loci", "features"))
def locus_reads_flanked(spark, sf):
    wide = fixture(spark, sf, "loci").select("locus_index", "contig", (F.col("start_pos") - 70).alias("start_pos"), (F.col("end_pos") + 70).alias("end_pos"))
    return I.overlap_join(wide, _features(spark, sf), *_SPANS).groupBy("locus_index").agg(F.count("*").alias("n"), F.min("fid").alias("first_fid"))


@query(
    "w01_locus_blocks",
    sql(
        "with g as (select *, case when start_pos-lag(end_pos) over w>20000 then 1 else 0 end nw from loci window w as (partition by contig order by start_pos,end_pos,locus_index)), i as (select *, sum(nw) over (partition by contig order by start_pos,end_pos,locus_index) island from g), b as (select *, (row_number() over (partition by contig,island order by start_pos,end_pos,locus_index)-1)//20 block from i) select contig, cast(island as bigint) island, cast(block as bigint) block, count(*) n, min(start_pos) lo, max(end_pos) hi from b group by 1,2,3",
        "loci",
    ),
)
def locus_blocks(spark, sf):
    return I.blocks(fixture(spark, sf, "loci"), 20).groupBy("contig", "island", "block").agg(F.count("*").alias("n"), F.min("start_pos").alias("lo"), F.max("end_pos").alias("hi"))


@query("o01_chromosome_sort", sql("select contig, row_number() over (order by cast(substr(contig,4) as int)) rk, n from (select contig, count(*) n from loci group by contig)", "loci"))
def chromosome_sort(spark, sf):
    per = fixture(spark, sf, "loci").groupBy("contig").agg(F.count("*").alias("n"))
    return per.select("contig", F.row_number().over(Window.orderBy(S.chromosome_order(F.col("contig")))).cast("long").alias("rk"), "n")


_CODES = "case list_aggregate(list_sort(list_distinct(string_split(b,''))), 'string_agg', '') when 'AG' then 'R' when 'CT' then 'Y' when 'CG' then 'S' when 'AT' then 'W' when 'GT' then 'K' when 'AC' then 'M' when 'CGT' then 'B' when 'ACT' then 'H' when 'ACG' then 'V' when 'ACGT' then 'N' end"


@query("f01_code_of_bases", sql(f"with s as (select doc_id, substr(seq, cast(1+doc_id%50 as int), cast(2+doc_id%3 as int)) b from sequences) select doc_id, {_CODES} code from s", "sequences"))
def code_of_bases(spark, sf):
    b = F.col("seq").substr((1 + F.col("doc_id") % 50).cast("int"), (2 + F.col("doc_id") % 3).cast("int"))
    return fixture(spark, sf, "sequences").select("doc_id", S.code_of_bases(F.split(b, "")).alias("code"))


@query("f02_bases_of_code", sql("select locus_index, case substr(motif,5,1) when 'K' then 'GT' else case substr(motif,3,1) when 'N' then 'ACGT' when '' then null else substr(motif,3,1) end end b from loci", "loci"))
def bases_of_code(spark, sf):
    last = F.when(F.length("motif") == 5, F.substring("motif", 5, 1)).otherwise(F.substring("motif", 3, 1))
    return fixture(spark, sf, "loci").select("locus_index", S.bases_of_code(last).alias("b"))


@query("f03_parse_ci", sql("select locus_index, cast(c0-1 as double) lo, cast(c0+1 as double) hi, case when locus_index%4=0 then null else cast(c1 as double) end lo2 from trio", "trio"))
def parse_ci(spark, sf):
    text = F.concat(F.col("c0") - 1, F.lit("-"), F.col("c0") + 1, F.lit("|"), F.when(F.col("locus_index") % 4 == 0, F.lit(".")).otherwise(F.concat(F.col("c1"), F.lit(","), F.col("c1") + 2)))
    return fixture(spark, sf, "trio").select("locus_index", S.parse_cis(text).alias("x")).selectExpr("locus_index", "x[0].lo lo", "x[0].hi hi", "x[1].lo lo2")


@query("f05_f48_number_lists", sql("select locus_index, case when locus_index%3=0 then null else c0 end a, c1 b, cast(c0 as double)/2 d from trio", "trio"))
def number_lists(spark, sf):
    first = F.when(F.col("locus_index") % 3 == 0, F.lit(".")).otherwise(F.col("c0").cast("string"))
    ints = S.numbers(F.concat_ws("/", first, F.col("c1").cast("string")), "/")
    half = S.numbers((F.col("c0") / 2).cast("string"), ",", "double")
    return fixture(spark, sf, "trio").select("locus_index", F.get(ints, F.lit(0)).alias("a"), F.get(ints, F.lit(1)).alias("b"), F.get(half, F.lit(0)).alias("d"))


@query("f11_mutation_source", sql("select id, case when p<0.05 and q<0.05 then 'both' when p<0.05 then 'mat' when q<0.05 then 'pat' else '?' end src from (select id, p, 1-p q from pvalues)", "pvalues"))
def mutation_source(spark, sf):
    return fixture(spark, sf, "pvalues").select("id", S.mutation_source(F.col("p"), 1 - F.col("p")).alias("src"))


@query("f26_estimated_copies", sql("select locus_index, cast(round_even((end_pos-start_pos)/length(motif), 0) as bigint) n from loci", "loci"))
def estimated_copies(spark, sf):
    return fixture(spark, sf, "loci").select("locus_index", S.estimated_copies(F.col("start_pos"), F.col("end_pos"), F.col("motif")).alias("n"))


@query("f31_search_schedule", sql("with x as (select locus_index, (end_pos-start_pos)*17 n from loci) select locus_index, case when n<200 then 1 when n<1000 then 3 when n<2000 then 5 else 15 end step, case when n<200 then 250 when n<1000 then 200 when n<2000 then 150 else 50 end iterations, case when n<2000 then 3 else 1 end rng from x", "loci"))
def search_schedule(spark, sf):
    s = S.search_schedule((F.col("end_pos") - F.col("start_pos")) * 17)
    return fixture(spark, sf, "loci").select("locus_index", s.alias("s")).select("locus_index", "s.step", "s.iterations", F.col("s.range").alias("rng"))


@query("f37_normalize_contig", sql("select locus_index, substr(contig,4) bare, 'chr'||substr(contig,4) named from loci", "loci"))
def normalize_contig(spark, sf):
    bare = S.with_chr(F.col("contig"), False)
    return fixture(spark, sf, "loci").select("locus_index", bare.alias("bare"), S.with_chr(bare, True).alias("named"))


@query("f29_composition_copies", sql("select doc_id, cast(round_even(length(regexp_replace(seq,'[^CAG]','','g'))/3, 0) as bigint) n from sequences", "sequences"))
def composition_copies(spark, sf):
    return fixture(spark, sf, "sequences").select("doc_id", S.composition_copies(F.col("seq"), F.lit("CAG")).alias("n"))


@query("f27_mask_low_quality", sql("with s as (select doc_id, seq, generate_subscripts(string_split(seq,''),1) i, unnest(string_split(seq,'')) b from sequences) select doc_id, string_agg(case when (doc_id+i)%11<3 then 'X' else b end, '' order by i) masked from s group by doc_id", "sequences"))
def mask_low_quality(spark, sf):
    quality = F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: (F.col("doc_id") + i) % 11)
    return fixture(spark, sf, "sequences").select("doc_id", S.masked(F.col("seq"), quality).alias("masked"))


@query("f39_common_prefix", sql("with s as (select doc_id, substr(seq,1,6) a, substr(seq,1,cast(doc_id%5 as int))||'TTTT' b from sequences) select doc_id, substr(a,1,cast((select coalesce(max(k),0) from (select unnest(range(0,5)) k) where substr(a,1,k)=substr(b,1,k) and k<=length(b) and k<=length(a)) as int)) pre from s", "sequences"))
def common_prefix(spark, sf):
    a, b = F.substring("seq", 1, 6), F.concat(F.col("seq").substr(F.lit(1), (F.col("doc_id") % 5).cast("int")), F.lit("TTTT"))
    pre = S.common_prefix(F.array(a, F.substring(b, 1, 4)))
    return fixture(spark, sf, "sequences").select("doc_id", pre.alias("pre"))


@query("p01_ploidy", sql("with x as (select locus_index, case locus_index%5 when 0 then 'chrX' when 1 then 'Y' when 2 then 'chrM' else contig end contig from loci) select locus_index, contig, case when contig in ('X','chrX') then 1 when contig in ('Y','chrY') then 1 when contig in ('M','chrM') then 1 else 2 end xy, case when contig='chrM' or contig='M' then 1 when contig in ('chrX','chrY') then null else 2 end autosomes from x", "loci"))
def ploidy(spark, sf):
    from ..sources.ploidy import CONFIGS

    name = F.expr("case locus_index % 5 when 0 then 'chrX' when 1 then 'Y' when 2 then 'chrM' else contig end")
    return fixture(spark, sf, "loci").select("locus_index", name.alias("contig")).select("locus_index", "contig", S.ploidy(F.col("contig"), CONFIGS["diploid_xy"]).alias("xy"), S.ploidy(F.col("contig"), CONFIGS["diploid_autosomes"]).alias("autosomes"))


@query("p02_p03_locus_validation", sql("select locus_index, case when start_pos>=end_pos-9 then 'start is not before end' when not regexp_full_match(case when locus_index%6=0 then '('||motif||')n' else motif end, '[ACGTRYSWKMBDHVN]+') then 'invalid motif' end err from loci", "loci"))
def locus_validation(spark, sf):
    motif = F.when(F.col("locus_index") % 6 == 0, F.concat(F.lit("("), F.col("motif"), F.lit(")n"))).otherwise(F.col("motif"))
    return fixture(spark, sf, "loci").select("locus_index", S.locus_error(F.col("start_pos"), F.col("end_pos") - 9, motif).alias("err"))


@query("p05_contig_predicate", sql("select locus_index from trio where contig='chr7'", "trio"))
def contig_predicate(spark, sf):
    return fixture(spark, sf, "trio").where("contig = 'chr7'").select("locus_index")


@query("u02_trio_contigs", sql("select contig from (select contig from loci where locus_index%3=0 intersect select contig from loci where locus_index%3=1 intersect select contig from loci where locus_index%3=2) where contig not in ('chrX','X','chrY','Y')", "loci"))
def trio_contigs(spark, sf):
    loci = fixture(spark, sf, "loci")
    return H.trio_contigs(*[loci.where(f"locus_index % 3 = {i}").select("contig") for i in range(3)])


@query("u03_snv_set_equality", sql("select locus_index, (c0=m0 and c1=m1) or (c0=m1 and c1=m0) or (c0=c1 and m0=m1 and c0=m0) same from trio", "trio"))
def snv_set_equality(spark, sf):
    as_set = lambda g: F.array_sort(F.array_distinct(F.array(*g)))
    return fixture(spark, sf, "trio").select("locus_index", (as_set(C) == as_set(M)).alias("same"))


@query("f43_a21_w08_builtin_checks", "select n_nationkey, r_name, count(*) over (partition by n_regionkey) n, rank() over (partition by n_regionkey order by n_name) rk from nation join region on n_regionkey=r_regionkey")
def builtin_checks(spark, sf):
    w = Window.partitionBy("n_regionkey")
    j = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    return j.select("n_nationkey", "r_name", F.count("*").over(w).alias("n"), F.rank().over(w.orderBy("n_name")).cast("long").alias("rk"))
