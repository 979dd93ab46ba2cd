"""The registered queries of this subpackage: each applies one operator to its whole table and derives its digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, jaccard, licenses, oracle, packing, quality, rules, suffix, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc(column: str, n: int) -> F.Column:
    return F.crc32(F.col(column).cast("string")) % n


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trained = quality.train(docs, table(spark, sf_dir, "labels"), crc("id", 4) != 2)
    return quality.score(docs, trained).select(
        "doc_id", (crc("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_lines", "bad_lines"
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    _, directory = warc.archive(spark, pages)
    got = warc.read(warc.lookup(pages.select("url"), directory))
    return got.select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    own = F.transform("detections", lambda d: d["label"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"), F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        (1 - F.aggregate("detections", F.lit(1.0), lambda a, d: a * (1 - d["relevance"] * 0.99))).alias("score"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.clusters(table(spark, sf_dir, "documents"), n=3, t=(9, 10))


def toxicity_model(docs: DataFrame, labels: DataFrame):
    """Fitted without the rows whose crc32(doc_id) mod 5 is 0: counts of remainders 1 to 4, weights of a sample of remainder 1."""
    return toxicity.train(docs, labels, crc("id", 5) >= 2, crc("id", 5) == 1)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


OP10_EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select * from values " + ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in OP10_EXTRA) + " as v(conv_id, turn, role, text)")
    out = chat.format_chats(rows.unionByName(extra)).withColumn("turns", chat.read_chats(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


QUERIES = {"op1_quality_classifier": op1_quality_classifier, "op2_best_fit_packing": op2_best_fit_packing, "op5_warc": op5_warc, "op7_jaccard_join": op7_jaccard_join, "op8_toxicity": op8_toxicity, "op9_suffix_dedup": op9_suffix_dedup, "op3_decontaminate": op3_decontaminate, "op4_quality_rules": op4_quality_rules, "op6_license_scan": op6_license_scan, "op10_chat_format": op10_chat_format}
SQL = oracle.SQL
