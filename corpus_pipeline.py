"""The corpus pipeline: quality rules, line dedup, near dedup, substring dedup, packing; each stage written and reread.

Every stage takes an empty table, rows that repeat, null ids and texts, texts of any length, and extra columns of any name,
which all stages but the last pass on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from casegraph.llm import lines, minhash, packing, quality, substrings
from casegraph.llm.common import materialize, table
from casegraph.llm.queries import VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject.

    Null and empty texts have under 20 words and go; copies are judged alike; without labels only the base rules judge.
    """
    return quality.stage(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of three-line windows; a document goes if nothing but blanks is left of its cut text.

    Null texts and those of under three lines stay; rows of one id and text count as one document.
    """
    return lines.stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: five-word shingles, similarity of at least 0.8.

    The least doc_id stays, once if its row repeats (a null id only if there is no other); texts without words all stay.
    """
    return minhash.keep_one(docs, minhash.Plan(width=5, percent=80))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 50-byte strings that a document of a smaller id holds; one goes if nothing but blanks is left of it.

    Null and shorter texts stay, rows of one id don't cut each other, a null id is the smallest, and a character that a cut
    splits goes with it.
    """
    return substrings.stage(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and places; null and empty texts are one piece of the closing token each."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The learned list, MinHash and tokens are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
