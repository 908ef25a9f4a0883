"""Queries of the graph, vector and window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinflow.functions import canon
from skeinflow.operators import flows, graph, vectors, windows
from skeinflow.plans import sqlkit
from skeinflow.session import materialize
from skeinflow.sources import views
from skeinflow.sources.tables import flow_states, table


def _states(spark: SparkSession, d: str) -> DataFrame:
    return flow_states(table(spark, d, "flow_state"))


def _flows(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).select(F.col("state_id").alias("flow_id"), (F.col("start_ms") / 1000.0).alias("ts"), F.col("src_host").alias("src_ip"), F.col("dst_host").alias("dst_ip"), "dst_port", "label")


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Host to host edges: src, dst, n."""
    known = _states(spark, d).where("src_host is not null and dst_host is not null")
    return known.groupBy(F.col("src_host").alias("src"), F.col("dst_host").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def host_ids(spark: SparkSession, d: str) -> DataFrame:
    s = _states(spark, d)
    return graph.encode_ids(s.select(F.col("src_host").alias("host")).unionAll(s.select("dst_host")), "host", 6)


def label_ids(spark: SparkSession, d: str) -> DataFrame:
    return graph.encode_ids(_states(spark, d), "label", 1)


def control_packets(spark: SparkSession, d: str) -> DataFrame:
    """Payload packets per flow label after the filter of empty ones and of packets without a flow record."""
    p = table(spark, d, "packet_event").where("payload_len_raw > 0").select(canon.flow_id("flow_id").alias("flow_id"), canon.label("flow_label", "unknown").alias("label"))
    known = _states(spark, d).select(F.col("fid").alias("flow_id")).distinct()
    return graph.drop_orphans(p, known).groupBy("label").agg(F.count(F.lit(1)).alias("n_packets"))


def host_tier(spark: SparkSession, d: str) -> DataFrame:
    return graph.host_tier(_flows(spark, d))


def flow_host_edges(spark: SparkSession, d: str) -> DataFrame:
    e = graph.flow_host_edges(flows.flow_features(flows.assign_flows(views.packets(spark, d))))
    return e.groupBy("rel", "host").agg(F.count(F.lit(1)).alias("n_flows"), F.sum(F.col("bytes").cast("long")).alias("bytes"))


def next_packet(spark: SparkSession, d: str) -> DataFrame:
    e = graph.next_packet(flows.assign_flows(views.packets(spark, d)))
    return e.select("src", "dst", F.round("dt", 6).alias("dt"), F.round(graph.temporal_weight(F.col("dt")), 4).alias("weight"))


def burst_neighbor(spark: SparkSession, d: str) -> DataFrame:
    return graph.burst_neighbours(_flows(spark, d), radius_s=60.0)


def _techniques(spark: SparkSession, d: str) -> DataFrame:
    """Technique ids with sub-techniques for the flood and recon families, and one whose parent is unknown."""
    t = table(spark, d, "traffic_class").where("technique_id is not null")
    subs = t.where(F.col("family").isin("flood", "recon")).select(F.concat("technique_id", F.lit("."), F.lpad(F.col("class_id").cast("string"), 3, "0")).alias("technique_id"))
    return t.select("technique_id").unionAll(subs).unionAll(t.limit(1).select(F.lit("TX999.001")))


def parent_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.subtechnique_edges(_techniques(spark, d))


def tier_edges(spark: SparkSession, d: str) -> DataFrame:
    """technique -> family edges of techniques that occur as labels; unknown ones are dropped."""
    t = table(spark, d, "traffic_class")
    seen = _states(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n_flows"))
    return t.where("technique_id is not null").join(seen, "label").select(F.col("technique_id").alias("technique"), F.col("family").alias("tactic"), "n_flows")


def reverse_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.both_ways(_links(spark, d))


def edge_except(spark: SparkSession, d: str) -> DataFrame:
    dns = _states(spark, d).where("dst_port = 53").select(F.col("src_host").alias("src"), F.col("dst_host").alias("dst"))
    return graph.except_edges(_links(spark, d), dns)


def fanout_capped(spark: SparkSession, d: str) -> DataFrame:
    return graph.fan_out_cap(_links(spark, d), 3, "g1")


def khop_2(spark: SparkSession, d: str) -> DataFrame:
    return graph.k_hop(_seeds(spark, d), graph.both_ways(_links(spark, d)), 2)


def khop_capped(spark: SparkSession, d: str) -> DataFrame:
    return graph.k_hop(_seeds(spark, d), graph.both_ways(_links(spark, d)), 2, fan_out=2, seed="g2")


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """Hosts of documents about one technique card kind."""
    return table(spark, d, "documents").where("kind = 'card'").select(canon.host("src_ip").alias("node")).where("node is not null").distinct()


def out_neighbors(spark: SparkSession, d: str) -> DataFrame:
    e = _links(spark, d).withColumn("rel", F.when(F.col("n") > 1, "often").otherwise("once"))
    return graph.out_neighbours(e, "often", _seeds(spark, d).withColumnRenamed("node", "src"))


def local_id_map(spark: SparkSession, d: str) -> DataFrame:
    return graph.local_ids(_states(spark, d).where("src_host is not null"), "src_host", "state_id").withColumn("local", F.col("local").cast("long"))


def edge_softmax(spark: SparkSession, d: str) -> DataFrame:
    out = graph.edge_softmax(_links(spark, d).withColumn("score", F.log1p("n")))
    return out.select("src", "dst", F.round("attention", 6).alias("attention"))


def contribution_filter(spark: SparkSession, d: str) -> DataFrame:
    """Host edges kept by their contribution score, at least 0.02."""
    e = _links(spark, d)
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("o"))
    into = e.groupBy("dst").agg(F.count(F.lit(1)).alias("i"))
    s = e.join(out, "src").join(into, "dst").withColumn("score", graph.contribution(F.log1p("n") / 10.0, F.col("o"), F.col("i"), F.lit(1)))
    return s.where("score >= 0.02").select("src", "dst", F.round("score", 6).alias("score"))


def _consensus(spark: SparkSession, d: str) -> DataFrame:
    labels = _states(spark, d).where("label is not null").select(F.col("state_id").alias("node"), F.col("label").alias("y"))
    tc = table(spark, d, "traffic_class").select("class_id", F.col("label").alias("class"))
    nodes = labels.select("node", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("class_id"))
    probs = nodes.join(tc, "class_id").select("node", "class", (F.col("node") * (F.col("class_id") + 1) % 17 / 17.0).alias("p"))
    return graph.neighbour_consensus(burst_neighbor(spark, d), labels, probs)


def neighbor_consensus(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).withColumn("consensus", F.round("consensus", 6))


def soft_targets(spark: SparkSession, d: str) -> DataFrame:
    """Evidence support, clean confidence, curriculum weight and the share that stays on the label."""
    tc = table(spark, d, "traffic_class").select("label", "class_id", "technique_id")
    rows = _states(spark, d).select(F.col("state_id").alias("node"), "label", "packet_count").join(tc, "label")
    rows = rows.join(_consensus(spark, d).withColumn("consensus", F.round("consensus", 6)), "node")
    attack = F.col("class_id").isin(7, 8, 9, 10)
    support = graph.evidence_support(attack, F.col("packet_count") - 4)
    suspect = attack & (support == 0)
    p_own, p_benign = (F.col("node") * (F.col("class_id") + 1) % 17 / 17.0), (F.col("node") % 17 / 17.0)
    confidence = graph.clean_confidence(support, F.col("consensus"), 0.5)
    return rows.select(
        "node", support.alias("support"), F.round(confidence, 6).alias("confidence"), F.round(graph.curriculum_weight(confidence, 6, 5, 0.2), 6).alias("weight"),
        F.round(graph.soft_target(suspect, p_own, p_benign, F.col("consensus")), 6).alias("beta"),
    )


def ema_series(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("value"), 4).alias("value"))
    return graph.exponential_mean(e, "user_id", "day", "value").withColumn("ema", F.round("ema", 6))


def graph_audit(spark: SparkSession, d: str) -> DataFrame:
    g, s = table(spark, d, "graph_flow"), _states(spark, d)
    return graph.audit([
        ("label in range", "error", g, F.col("flow_y").between(0, 13)),
        ("known version", "error", g, F.col("artifact_version").isin("v2", "v3")),
        ("vector length", "error", g, F.size("node_features").isin(74, 79)),
        ("source host", "warning", s, F.col("src_host").isNotNull()),
        ("ordered interval", "error", s.where("start_ms is not null"), F.col("end_ms") >= F.col("start_ms")),
        ("no infinite feature", "error", g, F.forall("node_features", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(True)) | F.isnan(x))),
        ("ten classes or more", "warning", g.agg(F.count_distinct("flow_y").alias("n")), F.col("n") >= 10),
        ("nodes in every split", "error", table(spark, d, "split_plan").join(g.groupBy(F.lower(F.trim("split")).alias("split_name")).agg(F.count(F.lit(1)).alias("n")), "split_name", "left"), F.col("n") > 0),
        ("each node once", "error", g.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")), F.col("n") == 1),
        ("flow in packets", "warning", s.where("fid is not null").select("fid").distinct().join(table(spark, d, "packet_event").select(canon.flow_id("flow_id").alias("fid"), F.lit(1).alias("n")).distinct(), "fid", "left"), F.col("n") == 1),
        ("five flow ids a family", "warning", table(spark, d, "traffic_class").where("family is not null").join(s, "label").groupBy("family").agg(F.count_distinct("fid").alias("n")), F.col("n") >= 5),
    ])


def graph_inventory(spark: SparkSession, d: str) -> DataFrame:
    s = _states(spark, d)
    counts = s.agg(F.count(F.lit(1)).alias("flows"), F.count_distinct("src_host").alias("sources"), F.count_distinct("dst_host").alias("targets"), F.count_distinct("fid").alias("flow_ids"))
    return counts.unpivot([], ["flows", "sources", "targets", "flow_ids"], "item", "n")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    got = vectors.cosine_top_k(e, e.where("vec_id % 50 = 0"), 10)
    return got.select("query", "vec_id", F.round("cosine", 6).alias("cosine"), "rank")


def knn_purity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vectors.label_purity(vectors.cosine_top_k(e, e.where("vec_id % 50 = 0"), 10), e).withColumn("purity", F.round("purity", 6))


def centroid_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    both = e.join(vectors.centroids(e), "label")
    return both.select("vec_id", "label", F.round(vectors.cosine("embedding", "centroid"), 6).alias("cosine"))


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", vectors.normalised("embedding").alias("u"))
    return v.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("u").alias("dims"))


def rolling_pair(spark: SparkSession, d: str) -> DataFrame:
    """Over the last 350 packets of a host pair: bytes, mean payload, distinct ports, packets to name ports."""
    p = views.packets(spark, d)
    m = {
        "bytes_350": ("sum", F.col("ip_len")), "payload_350": ("mean", F.col("payload_len")), "ports_350": ("distinct", F.col("dst_port")),
        "dns_350": ("sum", F.col("dst_port").isin(53, 5353).cast("int")),
    }
    out = windows.rolling_rows(p, ["src_ip", "dst_ip"], ["ts", "seq"], m, block=100_000)
    return out.select("seq", "bytes_350", F.round("payload_350", 6).alias("payload_350"), F.col("ports_350").cast("long").alias("ports_350"), "dns_350")


def rolling_destination(spark: SparkSession, d: str) -> DataFrame:
    """The same by destination, in blocks: a busy destination is windowed by many tasks."""
    p = views.packets(spark, d)
    m = {"bytes_350": ("sum", F.col("ip_len")), "web_350": ("sum", F.col("dst_port").isin(80, 443, 8080, 8443).cast("int")), "payload_350": ("mean", F.col("payload_len"))}
    out = windows.rolling_rows(p, ["dst_ip"], ["ts", "seq"], m, block=100_000)
    return out.select("seq", "bytes_350", "web_350", F.round("payload_350", 6).alias("payload_350"))


def rolling_features(spark: SparkSession, d: str) -> DataFrame:
    """The 28 rolling features of every flow."""
    p = materialize(views.packets(spark, d), "packets")
    out = windows.rolling_flow_features(materialize(flows.flow_features(flows.assign_flows(p), {"": 60.0}, packets=p), "flow-features"))
    return out.select("flow_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "flow_id"])


def length_sequence(spark: SparkSession, d: str) -> DataFrame:
    f = flows.assign_flows(views.packets(spark, d))
    seq = windows.length_sequence(f, "flow_id", ["ts", "seq"], F.when(F.col("is_fwd"), F.col("ip_len")).otherwise(-F.col("ip_len")).cast("long"), 32)
    return seq.select("flow_id", F.array_join("sequence", ",").alias("lengths"))


def flow_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Per flow its first 32 signed lengths and the burst aggregates over all its packets."""
    f = flows.assign_flows(views.packets(spark, d)).withColumn("signed", F.when(F.col("is_fwd"), F.col("ip_len")).otherwise(-F.col("ip_len")).cast("long"))
    bursts = windows.burst_aggregates(f, "flow_id", ["ts", "seq"], F.col("signed"))
    both = windows.length_sequence(f, "flow_id", ["ts", "seq"], F.col("signed")).join(bursts, "flow_id")
    return both.withColumn("sequence", F.array_join("sequence", ",")).withColumns({c: F.round(c, 7) for c in bursts.columns if bursts.schema[c].dataType.typeName() == "double"})


def packet_rank(spark: SparkSession, d: str) -> DataFrame:
    """Importance of packets in their flow: 0.4 size, 0.3 gap, 0.2 flag count, 0.1 position, each min-max scaled; five best per flow."""
    f = flows.assign_flows(views.packets(spark, d))
    o = W.partitionBy("flow_id").orderBy("ts", "seq")
    every = W.partitionBy("flow_id")
    rows = f.withColumn("pos", F.row_number().over(o) - 1).withColumn("n", F.count(F.lit(1)).over(every)).withColumn("gap", F.coalesce(F.round(F.col("ts") - F.lag("ts").over(o), 3), F.lit(0.0)))
    rows = rows.withColumn("temp", windows.position_score(F.col("pos"), F.col("n")))
    parts = {"payload_len": 0.4, "gap": 0.3, "flags": 0.2, "temp": 0.1}
    rows = rows.withColumns({f"_{c}": windows.min_max(F.col(c), every) for c in parts})
    rows = rows.withColumn("score", F.round(sum((F.col(f"_{c}") * w for c, w in parts.items()), F.lit(0.0)), 6))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("flow_id").orderBy(F.desc("score"), "seq"))).where("rank <= 5").select("seq", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        host_ids, label_ids, control_packets, host_tier, flow_host_edges, next_packet, burst_neighbor, parent_edges, tier_edges, reverse_edges, edge_except, fanout_capped, khop_2,
        khop_capped, out_neighbors, local_id_map, edge_softmax, contribution_filter, neighbor_consensus, soft_targets, ema_series, graph_audit, graph_inventory, cosine_topk, knn_purity,
        centroid_cosine, vector_norms, rolling_pair, rolling_destination, rolling_features, length_sequence, flow_bursts, packet_rank,
    )
}

_FS = f"fs as ({sqlkit.flow_state()}), st as (select state_id, src_host, dst_host, fid, dst_port, packet_count, nullif(lower(trim(label)), '') as label, start_ms, end_ms from fs)"
_LK = f"{_FS}, lk as (select src_host as src, dst_host as dst, count(*) as n from st where src_host is not null and dst_host is not null group by 1, 2)"
_BI = f"{_LK}, bi as (select * from lk union all select dst, src, n from lk)"
_SEEDS = f"sd as (select distinct {sqlkit.host('src_ip')} as node from documents where kind = 'card' and {sqlkit.host('src_ip')} is not null)"


def _cap(src: str, k: int, seed: str) -> str:
    return f"(select src, dst, n from (select *, row_number() over (partition by src order by md5('{seed}|' || src || '|' || dst), dst) as r from {src}) where r <= {k})"


_BURST = f"""{_FS}, fl as (select state_id as id, start_ms / 1000.0::double as ts, src_host as s, dst_host as t from st where start_ms is not null),
 pr as (select a.id as a, b.id as b, b.ts as bt, coalesce(a.s = b.s, false) as share_src, coalesce(a.t = b.t, false) as share_dst from fl a join fl b on a.s = b.s and (b.ts, b.id) > (a.ts, a.id) and b.ts <= a.ts + 60.0
   union select a.id, b.id, b.ts, coalesce(a.s = b.s, false), coalesce(a.t = b.t, false) from fl a join fl b on a.t = b.t and (b.ts, b.id) > (a.ts, a.id) and b.ts <= a.ts + 60.0),
 tp as (select *, row_number() over (partition by a order by bt, b) as r from pr),
 bn as (select a as src, b as dst, share_src, share_dst from tp where r <= 5 union all select b, a, share_src, share_dst from tp where r <= 5)"""
_CONS = f"""{_BURST}, lb as (select state_id as node, label as y from st where label is not null),
 cn as (select bn.dst as node, avg(case when l2.node is null then 0.0 else coalesce((bn.src * (t.class_id + 1) % 17) / 17.0::double, 0.0) end) as c
   from bn join lb on lb.node = bn.dst left join lb l2 on l2.node = bn.src left join traffic_class t on t.label = lb.y group by 1),
 con as (select lb.node, round(coalesce(cn.c, 1.0), 6) as consensus from lb left join cn on lb.node = cn.node)"""


def _khop(edges: str, pre: str) -> str:
    return f"""with {pre}, {_SEEDS}, e as {edges}, h1 as (select distinct dst as node from sd join e on sd.node = e.src where dst not in (select node from sd)),
      h2 as (select distinct dst as node from h1 join e on h1.node = e.src where dst not in (select node from sd) and dst not in (select node from h1))
      select node, 0 as hop from sd union all select node, 1 from h1 union all select node, 2 from h2"""


_ROLL = "rows between 349 preceding and current row"
_COS = "qs as (select vec_id as query, embedding::double[] as q from embeddings where vec_id % 50 = 0), pr as (select query, vec_id, e.label, list_cosine_similarity(q, embedding::double[]) as c from qs, embeddings e where e.vec_id <> query), rk as (select *, cast(row_number() over (partition by query order by round(c, 12) desc, vec_id) as integer) as rank from pr)"


def _mm(c: str) -> str:
    return f"case when max({c}) over e > min({c}) over e then ({c} - min({c}) over e)::double / (max({c}) over e - min({c}) over e) else 0.0 end"


_BURST_STATS = ", ".join(f"round(coalesce({f}({v}), 0.0), 7)::double as {n}_{k}" for n, v in (("fwd", "case when v > 0 then v::double end"), ("bwd", "case when v < 0 then -v::double end"), ("gap", "gap::double")) for k, f in (("mean", "avg"), ("std", "stddev_pop"), ("max", "max")))
_SUMS = {**{f"{n}_flows": f"(proto = {v})::int" for n, v in {"tcp": 0, "udp": 1, "icmp": 2}.items()}, **{f"{f}_packets": f"n_{f}" for f in ("syn", "ack", "fin", "rst", "psh")}, "web_port": "(dst_port in (80, 443, 8080))::int", "name_port": "(dst_port = 53)::int", "name_port_2": "(dst_port = 53)::int"}
_ROLLING_SQL = [f"round(sum({e}) over {w[0]}, 6)::double as {n}_{w}" for w in ("pair", "dst") for n, e in _SUMS.items()] + [
    "count(distinct dst_port) over p::double as ports_pair", "round(avg(dur) over p, 6) as duration_pair", "round(sum((dst_port in (20, 21, 22, 23, 25, 53, 80, 110, 143, 443, 445, 3389, 8080))::int) over p, 6)::double as watched_port_pair",
    "round(avg(dur) over d, 6) as duration_dst", "round(sum(fwd_pkts) over d, 6) as packets_dst", "round(sum(tot_pkts) over d, 6) as all_packets_dst",
]
ORACLE = {
    "host_ids": f"with {_FS}, h as (select src_host as host from st union select dst_host from st) select host, row_number() over (order by host) - 1 as idx from h where host is not null",
    "label_ids": f"with {_FS}, h as (select distinct label from st where label is not null) select label, row_number() over (order by label) - 1 as idx from h",
    "control_packets": f"with {_FS}, k as (select distinct fid from st) select coalesce(nullif(lower(trim(flow_label)), ''), 'unknown') as label, count(*) as n_packets from packet_event where payload_len_raw > 0 and {sqlkit.flow_id('flow_id')} in (select fid from k where fid is not null) group by 1",
    "host_tier": f"with {_FS}, o as (select src_host as host, count(*) as out_degree, count(distinct dst_port) as n_dst_ports, count(distinct dst_host) as n_dst_hosts from st where src_host is not null group by 1), i as (select dst_host as host, count(*) as in_degree from st where dst_host is not null group by 1) select coalesce(o.host, i.host) as host, coalesce(out_degree, 0) as out_degree, coalesce(in_degree, 0) as in_degree, coalesce(n_dst_ports, 0) as n_dst_ports, coalesce(n_dst_hosts, 0) as n_dst_hosts from o full join i on o.host = i.host",
    "flow_host_edges": f"with {views.features_sql()} select 'from_host' as rel, src_ip as host, count(*) as n_flows, cast(sum(fwd_bytes::bigint) as bigint) as bytes from feats group by 2 union all select 'to_host', dst_ip, count(*), cast(sum(bwd_bytes::bigint) as bigint) from feats group by 2",
    "next_packet": f"with {views.flowed_sql()}, e as (select lag(seq) over w as src, seq as dst, ts - lag(ts) over w as dt from flowed window w as (partition by flow_id order by ts, seq)) select src, dst, round(dt, 6) as dt, round(1.0 / (dt + 0.001::double), 4) as weight from e where src is not null",
    "burst_neighbor": f"with {_BURST} select * from bn",
    "parent_edges": "with t as (select technique_id, family, class_id from traffic_class where technique_id is not null), i as (select technique_id from t union select technique_id || '.' || lpad(class_id::varchar, 3, '0') from t where family in ('flood', 'recon') union select 'TX999.001') select split_part(c.technique_id, '.', 1) as parent, c.technique_id as child from i c where contains(c.technique_id, '.') and split_part(c.technique_id, '.', 1) in (select technique_id from i)",
    "tier_edges": f"with {_FS}, n as (select label, count(*) as n_flows from st group by 1) select t.technique_id as technique, t.family as tactic, n.n_flows from traffic_class t join n on t.label = n.label where t.technique_id is not null",
    "reverse_edges": f"with {_BI} select * from bi",
    "edge_except": f"with {_LK} select * from lk where not exists (select 1 from st where st.dst_port = 53 and st.src_host = lk.src and st.dst_host = lk.dst)",
    "fanout_capped": f"with {_LK} select * from {_cap('lk', 3, 'g1')}",
    "khop_2": _khop("(select src, dst from bi)", _BI),
    "khop_capped": _khop(_cap("bi", 2, "g2"), _BI),
    "out_neighbors": f"with {_LK}, {_SEEDS} select src, dst, n, 'often' as rel from lk where n > 1 and src in (select node from sd)",
    "local_id_map": f"with {_FS}, m as (select src_host, min(state_id) as o from st where src_host is not null group by 1) select src_host, row_number() over (order by o, src_host) - 1 as local from m",
    "edge_softmax": f"with {_LK}, m as (select *, max(ln(1 + n)) over (partition by dst) as m from lk), e as (select *, exp(ln(1 + n) - m) as e from m) select src, dst, round(e / sum(e) over (partition by dst), 6) as attention from e",
    "contribution_filter": f"with {_LK}, s as (select src, dst, ln(1 + n) / 10.0::double * least(1.0, (count(*) over (partition by src) + 1)::double / (count(*) over (partition by dst) + 1)) * exp(-0.5::double) as score from lk) select src, dst, round(score, 6) as score from s where score >= 0.02",
    "neighbor_consensus": f"with {_CONS} select * from con",
    "soft_targets": f"""with {_CONS}, r as (select st.state_id as node, t.class_id, case when t.class_id not in (7, 8, 9, 10) then 1.0 when st.packet_count - 4 > 0 then 1.0 else 0.0 end::double as support, con.consensus,
        (st.state_id * (t.class_id + 1) % 17) / 17.0::double as po, (st.state_id % 17) / 17.0::double as pb from st join traffic_class t on st.label = t.label join con on con.node = st.state_id),
        c as (select *, pow(support, 0.5) * pow(consensus, 0.5) as confidence from r)
        select node, support, round(confidence, 6) as confidence, round(greatest(0.2, least(1.0, confidence)), 6) as weight,
        round(case when class_id in (7, 8, 9, 10) and support = 0 then pow(greatest(1e-8, least(1.0, po / greatest(po + pb, 1e-12))), 0.7::double) * pow(greatest(1e-8, least(1.0, consensus)), 1 - 0.7::double) else 1.0 end, 6) as beta from c""",
    "ema_series": "with recursive e as (select user_id, strftime(ts, '%Y-%m-%d') as day, round(sum(value), 4) as value from events group by 1, 2), n as (select *, row_number() over (partition by user_id order by day) as r from e), m as (select user_id, day, r, value as ema from n where r = 1 union all select n.user_id, n.day, n.r, m.ema * 0.9::double + n.value * (1 - 0.9::double) from m join n on n.user_id = m.user_id and n.r = m.r + 1) select user_id, day, round(ema, 6) as ema from m",
    "graph_audit": f"""with {_FS}, pe as (select {sqlkit.flow_id('flow_id')} as pf from packet_event), g as (select 'label in range' as gate, 'error' as severity, count(*) filter (where flow_y is null or flow_y not between 0 and 13) as n_bad from graph_flow union all select 'known version', 'error', count(*) filter (where artifact_version is null or artifact_version not in ('v2', 'v3')) from graph_flow union all select 'vector length', 'error', count(*) filter (where node_features is null or len(node_features) not in (74, 79)) from graph_flow union all select 'source host', 'warning', count(*) filter (where src_host is null) from st union all select 'ordered interval', 'error', count(*) filter (where end_ms < start_ms) from st
        union all select 'no infinite feature', 'error', count(*) filter (where node_features is null or len(list_filter(node_features, lambda x: isinf(x))) > 0) from graph_flow
        union all select 'ten classes or more', 'warning', (count(distinct flow_y) < 10)::int from graph_flow
        union all select 'nodes in every split', 'error', count(*) filter (where split_name not in (select lower(trim(split)) from graph_flow where split is not null)) from split_plan
        union all select 'each node once', 'error', count(*) from (select node_id from graph_flow group by 1 having count(*) > 1)
        union all select 'flow in packets', 'warning', count(*) from (select distinct fid from st where fid is not null and fid not in (select pf from pe where pf is not null))
        union all select 'five flow ids a family', 'warning', count(*) from (select family from traffic_class t join st on st.label = t.label where family is not null group by 1 having count(distinct fid) < 5)) select *, n_bad = 0 as ok from g""",
    "graph_inventory": f"with {_FS} select 'flows' as item, count(*) as n from st union all select 'sources', count(distinct src_host) from st union all select 'targets', count(distinct dst_host) from st union all select 'flow_ids', count(distinct fid) from st",
    "cosine_topk": f"with {_COS} select query, vec_id, round(c, 6) as cosine, rank from rk where rank <= 10",
    "knn_purity": f"with {_COS} select query, round(avg((rk.label = o.label)::int::double), 6) as purity from rk join embeddings o on o.vec_id = rk.query where rank <= 10 group by 1",
    "centroid_cosine": "with x as (select vec_id, label, unnest(range(len(embedding))) as i, embedding from embeddings), c as (select label, i, avg(embedding[i + 1]::double) as m from x group by 1, 2), k as (select label, list(m order by i) as c from c group by 1) select vec_id, e.label, round(list_cosine_similarity(embedding::double[], c), 6) as cosine from embeddings e join k on e.label = k.label",
    "vector_norms": "select vec_id, round(list_sum(embedding::double[]) / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as total, cast(len(embedding) as integer) as dims from embeddings",
    "flow_bursts": f"""with {views.flowed_sql()}, g as (select flow_id, case when is_fwd then ip_len else -ip_len end as v, ts - lag(ts) over w as gap, row_number() over w as r, ts, seq from flowed window w as (partition by flow_id order by ts, seq))
        select flow_id, array_to_string(list_resize(list(v order by r) filter (where r <= 32), 32, 0), ',') as sequence, count(*) as n_packets, count(*) filter (where v > 0) as fwd_count, coalesce(sum(v) filter (where v > 0), 0)::double as fwd_sum,
        count(*) filter (where v < 0) as bwd_count, coalesce(-sum(v) filter (where v < 0), 0)::double as bwd_sum, {_BURST_STATS} , round(coalesce(sum(v) filter (where v > 0), 0)::double / (coalesce(-sum(v) filter (where v < 0), 0)::double + 1.0), 7) as up_down from g group by 1""",
    "rolling_features": f"with {views.features_sql()} select flow_id, " + ", ".join(_ROLLING_SQL) + f" from feats window p as (partition by src_ip, dst_ip order by flow_start_ts, flow_id {_ROLL}), d as (partition by dst_ip order by flow_start_ts, flow_id {_ROLL})",
    "rolling_pair": f"with {views.PACKETS_SQL} select seq, cast(sum(ip_len) over w as bigint) as bytes_350, round(avg(payload_len) over w, 6) as payload_350, cast(count(distinct dst_port) over w as bigint) as ports_350, cast(sum((dst_port in (53, 5353))::int) over w as bigint) as dns_350 from pkt window w as (partition by src_ip, dst_ip order by ts, seq {_ROLL})",
    "rolling_destination": f"with {views.PACKETS_SQL} select seq, cast(sum(ip_len) over w as bigint) as bytes_350, cast(sum((dst_port in (80, 443, 8080, 8443))::int) over w as bigint) as web_350, round(avg(payload_len) over w, 6) as payload_350 from pkt window w as (partition by dst_ip order by ts, seq {_ROLL})",
    "length_sequence": f"with {views.flowed_sql()}, r as (select flow_id, case when is_fwd then ip_len else -ip_len end as v, row_number() over (partition by flow_id order by ts, seq) as r from flowed), k as (select flow_id, unnest(range(1, 33)) as r from (select distinct flow_id from flowed)) select k.flow_id, string_agg(coalesce(v, 0)::varchar, ',' order by k.r) as lengths from k left join r on k.flow_id = r.flow_id and k.r = r.r group by 1",
    "packet_rank": f"with {views.flowed_sql()}, a as (select *, row_number() over o - 1 as pos, count(*) over (partition by flow_id) as n, coalesce(round(ts - lag(ts) over o, 3), 0.0) as gap from flowed window o as (partition by flow_id order by ts, seq)), b as (select *, 1.0::double - pos / greatest(n - 1, 1) as temp from a), s as (select seq, flow_id, round({_mm('payload_len')} * 0.4::double + {_mm('gap')} * 0.3::double + {_mm('flags')} * 0.2::double + {_mm('temp')} * 0.1::double, 6) as score from b window e as (partition by flow_id)), r as (select *, cast(row_number() over (partition by flow_id order by score desc, seq) as integer) as rank from s) select seq, score, rank from r where rank <= 5",
}
