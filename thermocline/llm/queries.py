"""Queries of the operators for training text: problems 7 to 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermocline.llm.contamination import LeakFinder
from thermocline.llm.mixing import mix_plan, mix_shares, token_counts
from thermocline.llm.reading_level import ReadingLevel
from thermocline.operators.support import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 13 consecutive words of a test item's prompt."""
    found = LeakFinder(min_run=13).passages(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "prompt"))
    return found.where(F.col("longest_run") >= 13).select("doc_id", "item_id")


def p7_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reported pairs, edited copies included, with their scores."""
    return LeakFinder().find(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "prompt"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document enters the mixture."""
    return mix_plan(_tokens(spark, sf_dir), table(spark, sf_dir, "mix_targets")).select("doc_id", "source", "tokens", "copies")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    targets = table(spark, sf_dir, "mix_targets")
    return mix_shares(mix_plan(_tokens(spark, sf_dir), targets), targets)


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of every document with prose of its own."""
    return ReadingLevel().levels(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "level_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose own prose is at grade 4."""
    return p9_levels(spark, sf_dir).where(F.col("level") == 4).select("doc_id")


QUERIES = {"p7_found": p7_found, "p7_alignments": p7_alignments, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_levels": p9_levels}
SQL: dict[str, str] = {}
