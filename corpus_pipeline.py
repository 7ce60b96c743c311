"""From raw documents to packed training sequences, each stage on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and reads it for the
next. All but the last return the columns of documents; n_chars, where it is there, follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborank.llm import decontamination, line_dedup, packing, simhash, toxicity
from arborank.llm.common import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.7 or more."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~toxicity.held_out())
    return docs.filter(toxicity.score(toxicity.train(docs, labels), F.col("text")) < 0.7)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents share stay in the last of them only."""
    index = line_dedup.LineIndex.build(docs, min_docs=3, min_chars=20)
    kept = index.applied(docs, index.postings)
    return kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType)) if "n_chars" in kept.columns else kept


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of their five-word shingles of 0.8 or more, the first stays."""
    return simhash.one_of_each(docs, n=5, least=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage that is similar to a benchmark item (0.8 or more)."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), least=0.8)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 4096 tokens at most, placed in sequences of 4096."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=1)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Trained scores, fingerprints and token ids are beyond SQL; tests/llm compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
