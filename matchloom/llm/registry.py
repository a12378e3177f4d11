"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, byte_bpe, conversation_trie, decontaminate, html_text, licenses, mixing, quality, secrets, simhash, token_files, vector_codes, warc
from .common import load
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decontaminate.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.array_join("item_ids", ","), 256)
    return r.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", sha.alias("items_sha256"), "contaminated", "n_near_items")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = licenses.scan(load(spark, sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = warc.write_and_read(load(spark, sf_dir, "pages"))
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = attribution.count(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), rule="first")
    return r.withColumnRenamed("id", "doc_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    r, mix = mixing.assign(docs)
    m = F.col(mix)
    return r.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["copies"] * m["size"]).alias("taken"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = simhash.components(load(spark, sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = quality.judge(load(spark, sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boilerplate", "clean_chars", "clean_md5", "base_failed", "kept")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(load(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = secrets.scan(load(spark, sf_dir, "documents"))
    join = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return r.select(F.col("id").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(join("base"), 256).alias("base_sha256"), join("spans").alias("spans"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(load(spark, sf_dir, "embeddings"))
    sha = F.lit(books.sha256() if books else hashlib.sha256(b"").hexdigest())
    r = vector_codes.with_label_error(coded)
    return r.select(F.col("id").alias("vec_id"), vector_codes.code_string("codes").alias("code"), "error", "label_error", sha.alias("codebooks_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.nodes(*conversation_trie.rebuilt(conversation_trie.numbered(load(spark, sf_dir, "conversations")))).drop("key")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    r = byte_bpe.decode(byte_bpe.encode(load(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return r.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_license_scan, op3_token_files, op4_warc, op5_token_counts, op6_mixing, op7_simhash, op8_quality, op9_html_text, op10_secrets, op11_vector_codes, op12_conversation_trie, op13_byte_bpe)
}
