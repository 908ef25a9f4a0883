"""The whole graph of a capture from its packets and the reference knowledge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.functions import payload as P
from skeinflow.operators import evidence, flows, graph
from skeinflow.session import materialize

EDGE = "src_type string, rel string, dst_type string, src string, dst string, weight double"


@dataclass
class Graph:
    """Node tables by type, one table of typed edges, and the flow vectors with their evidence summary."""

    nodes: dict[str, DataFrame]
    edges: DataFrame
    flow_vectors: DataFrame


def _edge(df: DataFrame, src_type: str, rel: str, dst_type: str, src: str, dst: str, weight: F.Column) -> DataFrame:
    return df.select(F.lit(src_type).alias("src_type"), F.lit(rel).alias("rel"), F.lit(dst_type).alias("dst_type"), F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), weight.cast("double").alias("weight"))


def build(packets: DataFrame, pmi: DataFrame, literals: DataFrame, techniques: DataFrame, tau: float = 0.4, **flow_options) -> Graph:
    """Flows, packets with payload, hosts, techniques and tactics with all their relations.

    ``packets``: the packet table with payload; ``pmi``: token, technique, family, weight;
    ``literals``: pattern, technique (reference data, collected for the automaton); ``techniques``: technique, family, tactic.
    Control packets (no payload) shape flows but are no nodes. Edges of families without
    a relation of their own count in the evidence summary and are not emitted.
    """
    flowed = materialize(flows.assign_flows(packets, **flow_options), "graph-packets")  # read by every tier
    features = materialize(flows.flow_features(flowed), "graph-flows")
    kept = flowed.where(F.col("payload_len") > 0)
    tokens = P.token_rows(kept, ["seq"], "payload", 200)
    text = kept.select("seq", P.latin("payload").alias("text"))
    patterns = [r["pattern"] for r in literals.select("pattern").distinct().collect()]
    hits = evidence.literal_weights(evidence.literal_hits(text, "seq", "text", patterns), "seq", literals)
    consensus = flows.flow_consensus(features).join(kept.select("flow_id", "seq"), "flow_id").select("seq", "technique", "weight")
    voted = evidence.vote(evidence.pmi_hits(tokens, "seq", pmi), hits, consensus, techniques.select("technique", "family"), "seq", tau)
    voted = materialize(voted, "graph-evidence")
    summary = evidence.evidence_summary(voted.join(kept.select("seq", "flow_id"), "seq"), "flow_id")
    vectors = features.join(summary, "flow_id", "left").fillna(0, ["ev_count", "ev_max_weight", "ev_n_distinct_families", "ev_sum_log1p_weight"])

    one = F.lit(1.0)
    hosts = graph.flow_host_edges(features)
    near = graph.burst_neighbours(features.select("flow_id", F.col("flow_start_ts").alias("ts"), "src_ip", "dst_ip"))
    subs = graph.subtechnique_edges(techniques.select(F.col("technique").alias("technique_id")))
    parts = [
        _edge(kept, "flow", "contain", "packet", "flow_id", "seq", one),
        _edge(graph.next_packet(kept), "packet", "link", "packet", "src", "dst", F.col("dt")),
        *[_edge(hosts.where(F.col("rel") == r), "flow", r, "host", "flow_id", "host", F.col("bytes")) for r in ("from_host", "to_host")],
        _edge(near, "flow", "burst_neighbor", "flow", "src", "dst", F.col("share_src").cast("double") + F.col("share_dst").cast("double")),
        *[_edge(voted.where(F.col("family") == f), "packet", f"evidence_{f}", "technique", "seq", "technique", F.col("weight")) for f in evidence.EDGE_FAMILIES],
        _edge(subs, "technique", "has_subtechnique", "technique", "parent", "child", one),
        _edge(techniques.where("tactic is not null"), "technique", "belongs_to", "tactic", "technique", "tactic", one),
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionAll(p)
    nodes = {
        "flow": vectors,
        "packet": kept.select("seq", "flow_id", "ts", "payload_len", "payload"),
        "host": graph.host_tier(features.select("src_ip", "dst_ip", "dst_port")),
        "technique": techniques.select("technique", "family").distinct(),
        "tactic": techniques.select("tactic").where("tactic is not null").distinct(),
    }
    return Graph(nodes, edges, vectors)


def expected_relations() -> list[str]:
    return ["contain", "link", "from_host", "to_host", "burst_neighbor", *(f"evidence_{f}" for f in evidence.EDGE_FAMILIES), "has_subtechnique", "belongs_to"]
