"""The driver-facing queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, filters, fingerprint, jaccard, language, layout, lines, minhash, packing, quality, substrings, toxicity, urls
from .common import table

#: The vocabulary that queries use; operators take the path as a parameter.
VOCABULARY = "byte_bpe_50k.json"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.result(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Plan(width=3, percent=85))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.result(table(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.result(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.result(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Given rules of the page filter (fixed values of its contract).
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, URL_RULES, urls.mine(pages, table(spark, sf_dir, "labels")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.result(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.layout(table(spark, sf_dir, "documents"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline; its module is at the repository's top."""
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_bpe, op3_language, op4_packing, op5_minhash, op6_substrings, op7_lines, op8_quality, op9_urls, op10_toxicity, op11_filter_audit, op12_layout, op13_jaccard_join, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op5_minhash": minhash.SQL, "op7_lines": lines.SQL, "op11_filter_audit": filters.SQL, "op12_layout": layout.SQL, "op13_jaccard_join": jaccard.SQL}
