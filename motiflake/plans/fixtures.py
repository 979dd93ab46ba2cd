"""Deterministic projections of the driver's star-schema tables onto loci, reads, genotypes, features and the like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOCI = """
select p_partkey+1 as locus_index, concat('chr', cast(p_partkey%22+1 as {s})) as contig,
    cast(floor(p_partkey/22.0)*40 + (case when floor(p_partkey/22.0)>=45 then 30000 else 0 end) as bigint) as start_pos,
    cast(floor(p_partkey/22.0)*40 + (case when floor(p_partkey/22.0)>=45 then 30000 else 0 end) + p_size*3 as bigint) as end_pos,
    case p_partkey%5 when 0 then 'CAG' when 1 then 'AT' when 2 then 'GGC' when 3 then 'AAAWK' else 'GCN' end as motif
from part"""
READS = """
select l_partkey+1 as locus_index, cast(l_suppkey%3 as int) as smp,
    concat(cast(l_orderkey as {s}),'/',cast(l_linenumber as {s}),'/',cast(l_partkey as {s}),'/',cast(l_suppkey as {s}),'/',cast(cast(round(l_extendedprice*100,0) as bigint) as {s})) as read_name,
    cast(10 + cast(l_quantity as int)%3 + 8*(l_linenumber%2) as int) as cn,
    case when l_returnflag='R' then '-' else '+' end as strand, cast(l_linenumber%2 as int) as p, cast(1 + l_discount as double) as w
from lineitem"""
GT = "select locus_index, smp, min(cn) a0, max(cn) a1, count(*) dp from reads group by locus_index, smp having count(*)>=4"
TRIO = """
select l.locus_index, l.contig, l.start_pos, l.end_pos, l.motif, c.a0 c0, c.a1 c1, m.a0 m0, m.a1 m1, f.a0 f0, f.a1 f1
from gt c join gt m on c.locus_index=m.locus_index and m.smp=1 join gt f on c.locus_index=f.locus_index and f.smp=2
join loci l on l.locus_index=c.locus_index where c.smp=0"""
FEATURES = """
select o_orderkey as fid, concat('chr',cast(o_custkey%22+1 as {s})) as contig,
    cast((o_orderkey*7)%37000 as bigint) as start_pos, cast((o_orderkey*7)%37000+20+o_custkey%300 as bigint) as end_pos
from orders"""
SEQUENCES = """
select doc_id, translate(lower(coalesce(text,'')),'abcdefghijklmnopqrstuvwxyz','ACGTACGTACGTACGTACGTACGTAC') as seq
from documents"""
PVALUES = "select event_id as id, power(value/500.0,3) as p from events"
#: The same in Spark, whose power is a last bit off for one value in ten: x*x*x with the rounding errors of both products
#: (each factor in halves of 26 bits). A last bit of p is m of them in (1-p)**m.
_HALF = "({x}*134217729.0D - ({x}*134217729.0D - {x}))"
_LOST = "((({a}-{p}) + {b}) + {c}) + {d}"
CUBES = (
    ("h", "x*x"), ("xh", _HALF.format(x="x")), ("xl", "x-xh"), ("l", _LOST.format(a="xh*xh", p="h", b="xh*xl", c="xl*xh", d="xl*xl")),
    ("g", "h*x"), ("hh", _HALF.format(x="h")), ("hl", "h-hh"), ("k", _LOST.format(a="hh*xh", p="g", b="hh*xl", c="hl*xh", d="hl*xl")), ("p", "g+(k+l*x)"),
)
BASES = {"loci": ("part", LOCI), "reads": ("lineitem", READS), "features": ("orders", FEATURES), "sequences": ("documents", SEQUENCES), "pvalues": ("events", PVALUES)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """loci, reads, features, sequences, pvalues, gt or trio."""
    if name == "gt":
        return spark.sql(GT.replace("from reads", "from {reads}"), reads=fixture(spark, sf_dir, "reads"))
    if name == "trio":
        gt, loci = fixture(spark, sf_dir, "gt"), fixture(spark, sf_dir, "loci")
        return spark.sql(TRIO.replace("from gt", "from {gt}").replace("join gt", "join {gt}").replace("join loci", "join {loci}"), gt=gt, loci=loci)
    if name == "pvalues":
        out = table(spark, sf_dir, "events").selectExpr("event_id as id", "value/500.0D as x")
        for column, text in CUBES:
            out = out.selectExpr("*", f"{text} as {column}")
        return out.select("id", "p")
    base, text = BASES[name]
    return spark.sql(text.replace("{s}", "string").replace(f"from {base}", "from {base}"), base=table(spark, sf_dir, base))


def spread_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """loci, dealt to all cores before anything is made of them: a file of millions of them is a few megabytes, one task."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return spark.sql(LOCI.replace("{s}", "string").replace("from part", "from {part}"), part=part)


def sql(body: str, *names: str) -> str:
    """DuckDB text: the body after the projections it names (and those that they need)."""
    need = []
    for n in names:
        need += {"gt": ["reads", "gt"], "trio": ["reads", "gt", "loci", "trio"]}.get(n, [n])
    parts = []
    for n in dict.fromkeys(need):
        text = {"gt": GT, "trio": TRIO}.get(n) or BASES[n][1].replace("{s}", "varchar")
        parts.append(f"{n} as ({text})")
    body = body.strip()
    more = body.removeprefix("with ") if body.startswith("with ") else None
    return ("with " + ", ".join(parts) + (", " + more if more else " " + body)) if parts else body
