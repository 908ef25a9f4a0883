"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.residue import find_residue, residue_report, without_residue
from skeinflow.session import spread
from skeinflow.sources.tables import table


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(spread(table(spark, d, "documents").select("doc_id", "text"))).where(F.col("residue").isNotNull()).select("doc_id")


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue_report(spread(table(spark, d, "documents").select("source", "text")))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_residue(spread(table(spark, d, "documents").select("doc_id", "text")))


QUERIES = {f.__name__: f for f in (p9_found, p9_kinds, p9_clean)}
ORACLE: dict[str, str] = {}
