"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embeddings, minhash, packing, quality, suffix, toxicity, urls, warc

TOKENIZER = "byte_bpe_50k.json"
#: Fixed rules of the URL query: (verdict, host and start of the path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), max_len=1024, end_id=2)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), length=100).drop("kept")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.with_matches(docs, table(spark, sf_dir, "benchmark"), k=5, at=0.8)
    return marked.select(
        "doc_id",
        (~decontaminate.clean()).alias("contaminated"),
        decontaminate.clean().alias("kept"),
        F.col("matches.item_id").alias("item_ids"),
        F.coalesce(F.array_max("matches.similarity"), F.lit(0.0)).alias("similarity"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_and_read(table(spark, sf_dir, "pages"), min_payload=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def remainder(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3, F.lit(-1))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.learn(docs, table(spark, sf_dir, "labels"), usable=remainder() != 1)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), at=0.9)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (remainder() == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(chat.with_tools(table(spark, sf_dir, "conversations")), chat.SCHEMAS)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), usable=remainder() != 1)
    return quality.score(docs, weights)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_minhash_dedup, op3_suffix_dedup, op4_decontamination, op5_warc, op6_embedding_dedup, op7_toxicity, op8_chat_formatting, op9_url_filter, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op8_chat_formatting": chat.TOOLS_SQL, "op9_url_filter": urls.sql(RULES)}
