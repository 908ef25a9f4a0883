"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.tokens import encode_corpus, round_trip
from skeinflow.session import spread
from skeinflow.sources.tables import table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(_documents(spark, d))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return round_trip(_documents(spark, d))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents, those whose ids decode to the text's own bytes, and those without ids; its twin holds what must come out."""
    back = p7_round_trip(spark, d)
    return back.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("exact").alias("n_exact"), F.count_if(F.col("n_tokens") == 0).alias("n_without_ids"))


QUERIES = {f.__name__: f for f in (p7_ids, p7_round_trip, p7_check)}
ORACLE = {"p7_check": "select count(*) as n_documents, count(*) as n_exact, count(*) filter (where text is null or text = '') as n_without_ids from documents"}
