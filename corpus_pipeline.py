"""Corpus pipeline over ``documents``: quality, site lines, near duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the
shared folder and hands the next stage what it reads back. All stages but the last return the columns of
``documents``. Part of subpackage ``wordloom.llm``.

Defined results: the operators' docstrings state what becomes of nulls, empty texts, repeated rows and
empty tables. A null or blank text is scored as an empty one by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.bpe import code_texts
from wordloom.llm.classifier import THRESHOLD, features_of, fit, score
from wordloom.llm.common import documents, keep
from wordloom.llm.contamination import drop_contaminated
from wordloom.llm.near_dups import keep_one_of_each
from wordloom.llm.queries import held_out, tokenizer_path
from wordloom.llm.site_lines import drop_site_lines

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL cannot express the classifier, MinHash and BPE; tests compare the stages with brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the discriminant, learnt from the labels not held out, rejects."""
    labels = documents(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    labelled = docs.select("doc_id", "text").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    vectors = keep(labelled.select("doc_id", features_of("text").alias("features")), "labelled-vectors")
    scored = score(docs.select(*COLUMNS, features_of("text").alias("features")), fit(vectors, labels), THRESHOLD)
    return scored.where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that stand on too many pages of their source. A page that holds nothing else stays as
    an empty text."""
    cleaned = drop_site_lines(docs.select(*COLUMNS), "source", "text")
    length = F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return cleaned.withColumn("n_chars", length).select(*COLUMNS)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates, linked from 80 % on."""
    return keep_one_of_each(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return drop_contaminated(docs, documents(spark, sf_dir, "benchmark")).select(*COLUMNS)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 32 bits), and digests of ids and of the decoded text."""
    return code_texts(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("bpe_tokens", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
