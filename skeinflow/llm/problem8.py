"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.containers import broken_rules, fill_report, pack_each
from skeinflow.llm.tokens import count_tokens
from skeinflow.session import materialize, spread
from skeinflow.sources.tables import table


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return materialize(count_tokens(spread(table(spark, d, "documents").select("doc_id", "text"))), "document-sizes")


def _budgets(spark: SparkSession, d: str) -> DataFrame:
    """The container sizes, a table of a few rows: budget_name, capacity."""
    known = table(spark, d, "context_budget").where("capacity_tokens > 0")
    return known.select("budget_name", F.col("capacity_tokens").cast("long").alias("capacity"))


def _packed(spark: SparkSession, d: str, sized: DataFrame) -> DataFrame:
    return pack_each(sized, [r["capacity"] for r in _budgets(spark, d).collect()])


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or piece of a text larger than the capacity, with its container in each budget."""
    placed = _packed(spark, d, _sized(spark, d)).join(_budgets(spark, d), "capacity")
    return placed.select("budget_name", "doc_id", "piece_no", "from_token", "n_tokens", "container_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    report = fill_report(_packed(spark, d, _sized(spark, d))).join(_budgets(spark, d), "capacity")
    return report.select(
        "budget_name", F.col("capacity").cast("int").alias("capacity_tokens"), "n_containers", "n_tokens", "n_items", "least_containers", F.round("filled", 6).alias("filled_share")
    )


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """The rules of packing, counted over all texts and containers of each budget; its twin holds what must come out."""
    sized = _sized(spark, d)
    wrong = broken_rules(_packed(spark, d, sized), sized).join(_budgets(spark, d), "capacity")
    return wrong.select("budget_name", "n_texts", "n_over_full", "n_cut_though_fitting", "n_not_adding_up")


QUERIES = {f.__name__: f for f in (p8_containers, p8_fill, p8_check)}
ORACLE = {
    "p8_check": """select budget_name, (select count(*) from documents) as n_texts, 0::bigint as n_over_full, 0::bigint as n_cut_though_fitting, 0::bigint as n_not_adding_up
        from context_budget where capacity_tokens > 0""",
}
