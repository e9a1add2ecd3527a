"""The queries p8 to p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeglass.llm import chunking, mixing, tiling, tokens
from tapeglass.session import cut
from tapeglass.sources.tables import table


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return tiling.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), least=13)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).where(F.col("longest") >= 13).select("doc_id", "item_id")


def p8_reordered(spark: SparkSession, d: str) -> DataFrame:
    """Items half or more of which stands in a document, in passages of eight or more words in any order."""
    return tiling.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), least=8).where(F.col("coverage") >= 0.5)


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets").select("source").distinct()
    return tokens.with_tokens(docs.where(F.col("source").isNotNull()).join(targets, "source", "left_semi"), ["source", "doc_id"])


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(_sizes(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(_sizes(spark, d).select("source", "doc_id", "n_tokens"))
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mixture(sizes, targets), targets, sizes)


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_oversized(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that come out in more than one piece."""
    p = chunking.split_oversized(table(spark, d, "documents"), with_text=False, only_split=True)
    return p.where(F.col("piece_no") == 1).select("doc_id")


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks, "p8_reordered": p8_reordered, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_pieces": p10_pieces}
SQL: dict[str, str] = {}
