"""A corpus pipeline in five stages: each is written as Parquet and read again as the next one's documents.

The quality rules, near-duplicates, benchmark passages, the mix and the token files follow each other; every stage
works on all rows that the one before it kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import decontaminate, mixing, quality, simhash, token_files
from matchloom.llm.common import load, materialize
from matchloom.llm.registry import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and so do boilerplate lines, of any length, of all others.

    A null or blank text has no words and goes; a null source is a host of its own; repeated rows are judged alike and all stay or
    go; rows equal in id are told apart by text and source; an empty table stays empty. A column n_chars follows the text.
    """
    kept = quality.keep(docs)
    if "n_chars" not in kept.columns:
        return kept
    n = F.length("text").cast(kept.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", F.coalesce(n, F.col("n_chars")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8 or more) stays: that of the least id.

    Null and blank texts are copies of each other; a null id stays only where its component has no other; of repeated rows one
    stays, of rows equal in id and text the least by a hash of all columns; an empty table stays empty.
    """
    return simhash.one_per_component(docs, shingle=5, similarity=(4, 5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    A null or wordless text holds none and stays; items without words have no window; repeated rows all stay or go; rows equal in
    id are told apart by text; an empty table, of documents or of items, takes nothing out.
    """
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for.

    A null or blank text has no size and takes no part in the targets; a null source is a source, and the last; repeated rows are
    sampled as separate documents; ties go by all columns; an empty table stays empty.
    """
    return mixing.emit(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files, read back: doc_id, start, n_tokens, ids_crc32.

    A null or blank text has the end id alone; null ids come first; equal ids go by text; repeated rows are written as often as
    they occur; an empty table gives no shards and no rows.
    """
    return token_files.encode_and_read(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mix),
    ("token output", token_output),
]

#: SQL has no MinHash of the second stage and no tokenizer of the last; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
