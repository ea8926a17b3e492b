"""The ten operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypnoframe.llm import chat, decontam, fingerprint, langid, neardup, packing, quality, secrets, tokens, urls
from hypnoframe.llm.store import narrow_batches

#: parameters of the queries: the vocabularies' places
COUNT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PACK_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CAPACITY, OPEN_BINS = 4096, 1024
RULES = [urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/")]
FLOOR, Z = 0.5, 1.645


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    narrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(rows.unionByName(extra)))


def language_model(docs: DataFrame) -> langid.PPMModel:
    return langid.train(langid.sample(docs.where(remainder("doc_id", 3) != 1)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, language_model(docs)).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(*quality.sample(docs, labels.where(remainder("doc_id", 4) != 2)))
    return quality.score(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.trained_on(docs))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is its document's label: the last path segment's leading number is the doc_id; good is quality 1 and not toxic."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    path = urls.split_url(F.col("url"))[1]
    of = pages.select("url", F.regexp_extract(path, r"/([0-9]{1,18})[^/]*/?$", 1).try_cast("long").alias("doc_id")).where("doc_id is not null")
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"))
    return urls.judge(pages, of.join(good, "doc_id").select("url", "good"), RULES, FLOOR, Z).select("page_id", "host", "path", "rule", "verdict")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), COUNT_VOCABULARY, 512)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokens.token_pieces(table(spark, sf_dir, "documents"), PACK_VOCABULARY, CAPACITY)
    return packing.pack(pieces, CAPACITY, OPEN_BINS)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_chat_format, op3_language_id, op4_quality, op5_secret_scan, op6_url_filter, op7_token_counts, op8_best_fit_packing, op9_decontamination, op10_fingerprints)}
