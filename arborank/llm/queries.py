"""The numbered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, infilling, kernel_quality, line_dedup, packing, quality, secrets, simhash, substring, toxicity, url_filter, warc
from .common import table
from .oracles import SQL


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=3, min_chars=20)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), n=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_windows(table(spark, sf_dir, "documents"), size=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=1)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_sentences", "worst")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    order = F.create_map(*[x for n, k in enumerate(secrets.KINDS) for x in (F.lit(k), F.lit(n))])
    every = F.transform(F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("order"), x["end"].alias("end"), x["kind"].alias("kind")))), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    def number(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))


#: The rules of the contract.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the quality label of the document with the page's id."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    found = url_filter.filter_urls(table(spark, sf_dir, "pages"), labels, URL_RULES)
    return found.withColumns({c: F.round(c, 6) for c in ("p_good", "good_from")})


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=0.8)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=1000)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "p_good")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), most_words=3, least=10, top=2000, inside=50)


def op12_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kernel_quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), features=384)
    return found.select("doc_id", kernel_quality.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op13_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infilling.fill_in_middle(table(spark, sf_dir, "documents"), percent=50, spm_percent=80)
    digests = [F.sha2(x, 256).alias(n) for n, x in (("output_sha256", F.col("output")), ("restored_sha256", infilling.restored(F.col("output"), F.col("form"))))]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_toxicity, op3_simhash, op4_secrets, op5_url_filter, op6_decontamination, op7_warc, op8_substring, op9_quality, op10_packing, op11_collocations, op12_kernel_quality, op13_infilling)
}

__all__ = ["QUERIES", "SQL"]
