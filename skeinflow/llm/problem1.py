"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.components import record_groups
from skeinflow.llm.group_splits import assign_splits
from skeinflow.operators.skew import salted_lookup
from skeinflow.plans import sqlkit
from skeinflow.session import materialize
from skeinflow.sources.tables import flow_states, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return record_groups(flow_states(table(spark, d, "flow_state"))).select("state_id", "group_host")


def _assigned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    groups = materialize(record_groups(flow_states(table(spark, d, "flow_state"))), "record-groups")
    labels = [r[0] for r in table(spark, d, "traffic_class").select(F.lower(F.trim("label"))).distinct().orderBy(F.lit(1)).collect() if r[0]]
    splits = [(r["split_name"], r["proportion"]) for r in table(spark, d, "split_plan").collect() if r["split_name"] and r["proportion"] is not None]
    return groups, materialize(assign_splits(groups, sorted(labels), splits).select("group_key", "split_name"), "group-splits")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    groups, splits = _assigned(spark, d)
    return salted_lookup(groups, splits, "group_key").select("state_id", "group_key", "split_name")


def p1_balance(spark: SparkSession, d: str) -> DataFrame:
    """Records per split and label, with the split's share of all records."""
    groups, splits = _assigned(spark, d)
    per_group = groups.groupBy("group_key", "label").agg(F.count(F.lit(1)).alias("n"))
    out = per_group.join(splits, "group_key").groupBy("split_name", "label").agg(F.sum("n").alias("n_records"))
    return out


def p1_check(spark: SparkSession, d: str) -> DataFrame:
    """One row: records, records without a split, groups in two splits; its twin holds what must come out."""
    rows = p1_splits(spark, d)
    per = rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split_name").isNull()).alias("_none"), (F.min("split_name") != F.max("split_name")).alias("_two"))
    return per.agg(F.sum("n").alias("n_records"), F.sum("_none").alias("n_without_split"), F.count_if("_two").alias("n_groups_in_two_splits"))


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_balance, p1_check)}
ORACLE = {
    # Hosts and flow ids as one graph: from every host or flow id, all smaller hosts reached over shared records.
    "p1_found": f"""with recursive fs as ({sqlkit.flow_state()}),
      e0 as (select distinct src_host as h, coalesce(fid, 'row ' || state_id) as k from fs where src_host is not null union select distinct dst_host, coalesce(fid, 'row ' || state_id) from fs where dst_host is not null
        union select distinct src_host, '=' || dst_host from fs where src_host is not null and dst_host is not null union select distinct dst_host, '=' || dst_host from fs where src_host is not null and dst_host is not null),
      near as (select distinct x.h as a, y.h as b from e0 x join e0 y on x.k = y.k), reach as (select a, b from near union select r.a, n.b from reach r join near n on r.b = n.a),
      lab as (select a as h, min(b) as g from reach group by 1), of_flow as (select k, min(h) as h from e0 group by 1)
      select state_id, lab.g as group_host from fs left join of_flow on of_flow.k = coalesce(fid, 'row ' || state_id) left join lab on lab.h = coalesce(src_host, dst_host, of_flow.h)""",
    "p1_check": "select count(*) as n_records, 0::bigint as n_without_split, 0::bigint as n_groups_in_two_splits from flow_state",
}
