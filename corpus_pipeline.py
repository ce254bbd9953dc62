"""A corpus pipeline: rules, near copies, repeated passages, mixing and tokens, each stage written and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm import suffixes
from tideframe.llm.bpe import encode_digest
from tideframe.llm.mixing import mix_sources
from tideframe.llm.nearcopies import one_of_each, row_id
from tideframe.llm.quality import keep_good, train_field
from tideframe.llm.store import bound_batches, discard, durable, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line field keep; the field learns from the input's labelled documents."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs.select(*COLUMNS), train_field(docs, labels))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one of smallest doc_id; five words, Jaccard similarity 0.8 or more."""
    bound_batches(spark)
    return one_of_each(docs.select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that also start earlier go; a document of which nothing is left goes too."""
    bound_batches(spark)
    kept = suffixes.remove_repeats(docs.select(*COLUMNS), with_text=True, carry=("lang", "source"))
    kept = kept.where((F.col("n_removed") == 0) | (F.trim("kept") != ""))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources to their weights takes it, as whole rows.

    Rows are told apart by all they hold, not by doc_id; full duplicates are each taken as often as one of them.
    """
    rows = docs.select(*COLUMNS)
    rows = rows.withColumn("_row", row_id(rows))
    taken = mix_sources(rows, cut="documents", keep=("_row",)).groupBy("_row").agg(F.max("copies").alias("_copies")).where(F.col("_copies") > 0)
    mixed = rows.join(durable(taken, "pipeline-mix"), "_row")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).drop("_copy")


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text of each row of the mix."""
    bound_batches(spark)
    return encode_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mixing),
    ("bpe_tokens", bpe_tokens),
]

#: The line field, suffix sorting and the tokenizer have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written as Parquet and read as the next one's input.

    What a stage wrote on its way goes when its result is written, and a result when the next one is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            kept.append(durable(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(docs)
        docs = kept[0]
    return STAGES[-1][1](spark, docs, sf_dir)
