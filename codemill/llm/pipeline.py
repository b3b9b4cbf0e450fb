"""Stages of the corpus pipeline over documents; each gets (spark, the rows of the stage before, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codemill.llm.leakage import leaked
from codemill.llm.tokenizing import encode
from codemill.storage import table


def usable(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a text that is not only white space; repeated rows of a doc_id count once, the latest."""
    some = documents.where(F.col("text").rlike(r"\S"))
    last = some.groupBy("doc_id").agg(F.max_by(F.struct("text", "lang", "source", "project", "updated_at"), "updated_at").alias("r"))
    return last.select("doc_id", "r.*")


def decontaminated(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no run of eight words with a held-out passage."""
    return documents.join(leaked(documents, table(spark, sf_dir, "eval_items")).select("doc_id").distinct(), "doc_id", "left_anti")


def tokenized(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    return documents.join(encode(documents), "doc_id")


STAGES = [("usable", usable), ("decontaminated", decontaminated), ("tokenized", tokenized)]
