"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.vector_overlap import node_pairs, overlap_report, record_coverage, split_overlaps
from skeinflow.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return node_pairs(*split_overlaps(table(spark, d, "graph_flow")))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    out = overlap_report(*split_overlaps(table(spark, d, "graph_flow")))
    return out.withColumns({c: F.round(c, 6) for c in ("max_coverage", "mean_coverage")})


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    return record_coverage(*split_overlaps(table(spark, d, "graph_flow"))).withColumn("coverage", F.round("coverage", 6))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p2_coverage)}

_NODES = """
with n as (select node_id, source, lower(trim(split)) as side, node_features as v, len(node_features) as n from graph_flow where node_features is not null)
"""
_DIFFER = """
len(list_filter(range(least(t.n, e.n)), lambda k:
    abs((case when t.v[k + 1] is null or isnan(t.v[k + 1]) then 0.0 else t.v[k + 1] end)::double
      - (case when e.v[k + 1] is null or isnan(e.v[k + 1]) then 0.0 else e.v[k + 1] end)::double)
    > 0.01 * greatest(abs((case when t.v[k + 1] is null or isnan(t.v[k + 1]) then 0.0 else t.v[k + 1] end)::double),
                      abs((case when e.v[k + 1] is null or isnan(e.v[k + 1]) then 0.0 else e.v[k + 1] end)::double))))
"""
_PAIRS = _NODES + f""", p as (select t.node_id as t_id, e.node_id as e_id, least(t.n, e.n) - {_DIFFER.strip()} as same, {_DIFFER.strip()} as differ, t.n = e.n and {_DIFFER.strip().replace('> 0.01 *', '> 0.0 *')} = 0 as exact
  from n t join n e on t.side = 'train' and e.side in ('val', 'test')), q as (select * from p where differ <= 3),
 c as (select e_id, count(*) as n_pairs, count(*) filter (where exact) as n_exact_pairs, max(same) as same from q group by 1),
 r as (select node_id, side as eval_split, source, coalesce(n_pairs, 0) as n_pairs, coalesce(n_exact_pairs, 0) as n_exact_pairs, coalesce(same / n::double, 0.0)::double as coverage from n left join c on node_id = e_id where side in ('val', 'test'))"""
ORACLE = {
    "p2_found": _NODES + f"""select least(t.node_id, e.node_id) as node_id_1, greatest(t.node_id, e.node_id) as node_id_2
        from n t join n e on t.side = 'train' and e.side in ('val', 'test') where {_DIFFER} <= 3""",
    "p2_report": _PAIRS + "select eval_split, source, count(*) as n_nodes, count(*) filter (where n_pairs > 0) as n_overlapping, cast(sum(n_pairs) as bigint) as n_pairs, cast(sum(n_exact_pairs) as bigint) as n_exact_pairs, round(max(coverage), 6) as max_coverage, round(avg(coverage), 6) as mean_coverage from r group by 1, 2",
    "p2_coverage": _PAIRS + "select node_id, eval_split, source, n_pairs, n_exact_pairs, round(coverage, 6) as coverage from r",
}
