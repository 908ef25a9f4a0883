"""Queries of label cleaning, audits, reports and assorted projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinflow.functions import canon
from skeinflow.operators import evidence, flows, graph, labels, metrics, reports
from skeinflow.operators.ranking import distributed_rank, hash_order
from skeinflow.plans import sqlkit
from skeinflow.plans.eval_queries import _LOGITS as LOGITS_SQL
from skeinflow.plans.eval_queries import _logits
from skeinflow.plans.graph_queries import _FS, _LK, _links, _states
from skeinflow.plans.text_queries import _LITS, _hits, payloads
from skeinflow.plans.text_queries import _HX as HX_SQL
from skeinflow.sources import views
from skeinflow.sources.tables import table

LITERALS = {"note": ("scanner", "rate of"), "ticket": ("injection", "probe"), "report": ("watch list",)}


def _requests(spark: SparkSession, d: str) -> DataFrame:
    docs = payloads(spark, d).select("doc_id", "label", F.coalesce("flow", F.lit("none")).alias("flow"), "text")
    verb = F.when(F.col("doc_id") % 3 == 0, "SEND ").otherwise("POST ")
    return docs.withColumn("request", F.concat(verb, F.lit("/ "), F.col("text")))


def _isolated(spark: SparkSession, d: str) -> DataFrame:
    r = _requests(spark, d)
    return labels.isolate(r, "label", "flow", labels.request_matches(F.col("request"), F.col("label"), LITERALS), list(LITERALS), "benign")


def label_isolation(spark: SparkSession, d: str) -> DataFrame:
    return _isolated(spark, d).select("doc_id", "label", "clean_label")


def label_isolation_by_capture(spark: SparkSession, d: str) -> DataFrame:
    """The same within one capture: an attack elsewhere on the same flow id says nothing about this one. The source of a document stands for the capture."""
    origin = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("capture"))
    r = _requests(spark, d).join(origin, "doc_id").withColumn("seen", F.concat_ws("|", "capture", "flow"))
    out = labels.isolate(r, "label", "seen", labels.request_matches(F.col("request"), F.col("label"), LITERALS), list(LITERALS), "benign")
    return out.select("doc_id", "label", "clean_label")


def isolation_audit(spark: SparkSession, d: str) -> DataFrame:
    return labels.isolation_audit(_isolated(spark, d), "label")


def answer_key(spark: SparkSession, d: str) -> DataFrame:
    """Flow records keep an attack label only if their flow id occurs in flow_context."""
    s = _states(spark, d)
    keys = table(spark, d, "flow_context").select(canon.flow_id("flow_id").alias("fid"))
    names = [r[0] for r in table(spark, d, "traffic_class").where("class_id > 0").select("label").collect()]
    out = labels.apply_answer_key(s, "fid", keys, "label", names, "benign")
    return out.groupBy("label", "clean_label").agg(F.count(F.lit(1)).alias("n"))


def key_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Flow ids in both tables, in records only and in packets only."""
    a = _states(spark, d).select("fid").where("fid is not null")
    b = table(spark, d, "packet_event").select(canon.flow_id("flow_id").alias("fid")).where("fid is not null")
    parts = {"both": a.intersect(b), "records_only": a.subtract(b), "packets_only": b.subtract(a)}
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n") for k, df in parts.items()]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


def anchor_sweep(spark: SparkSession, d: str) -> DataFrame:
    s = _states(spark, d).where("label is not null")
    out = labels.threshold_sweep(s.withColumn("score", F.col("packet_count").cast("double")), "score", F.col("label") != "benign", (1, 5, 10, 20, 50))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


def mask_audit(spark: SparkSession, d: str) -> DataFrame:
    s = _states(spark, d).where("label is not null and packet_count is not null")
    out = labels.mask_audit(s, "label", F.col("packet_count") >= 10, F.col("dst_port").isin(80, 443, 8080, 8443))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


def rare_classes(spark: SparkSession, d: str) -> DataFrame:
    return labels.rare_classes(_states(spark, d), "label", 3, 100)


def class_composition(spark: SparkSession, d: str) -> DataFrame:
    p = views.packets(spark, d)
    infra = F.col("dst_port").isin(22, 53, 123, 443)
    return p.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(infra.cast("double")), 6).alias("infra_share"), F.round(F.avg((F.col("payload_len") == 0).cast("double")), 6).alias("empty_share"),
        *[F.sum((F.col("proto") == k).cast("long")).alias(n) for k, n in enumerate(("tcp", "udp", "icmp", "other"))],
    )


def top_ports(spark: SparkSession, d: str) -> DataFrame:
    n = views.packets(spark, d).groupBy("label", "dst_port").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(F.desc("n"), "dst_port"))).where("rank <= 4")


def row_features(spark: SparkSession, d: str) -> DataFrame:
    """Private addresses, infrastructure ports, one-hot protocol and the deviation of four sizes per flow context."""
    c = table(spark, d, "flow_context")
    private = F.col("src_ip").rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)")
    stats = [F.coalesce(canon.measured(F.col("flow_feature_stats")[k]), F.lit(0.0)) for k in ("plen_mean", "plen_max", "iat_mean", "iat_std")]
    mean = sum(stats[1:], stats[0]) / 4.0
    std = F.sqrt(sum(((s - mean) * (s - mean) for s in stats[1:]), (stats[0] - mean) * (stats[0] - mean)) / 3.0)
    hot = {p: F.when(F.upper("protocol") == p, 1).otherwise(0).alias(f"is_{p.lower()}") for p in ("TCP", "UDP", "ICMP")}
    return c.select("context_id", F.coalesce(private, F.lit(False)).alias("private_source"), F.col("dst_port").isin(53, 123, 67, 68).alias("infra_port"), *hot.values(), F.round(std, 4).alias("spread"))


def port_pair(spark: SparkSession, d: str) -> DataFrame:
    """Ports read from four big-endian bytes, smaller first."""
    c = table(spark, d, "flow_context").where("src_port is not null and dst_port is not null")
    raw = F.unhex(F.concat(*[F.lpad(F.hex(F.col(p)), 4, "0") for p in ("src_port", "dst_port")]))
    a, b = (F.conv(F.hex(F.substring(raw, at, 2)), 16, 10).cast("int") for at in (1, 3))
    return c.select("context_id", F.least(a, b).alias("low_port"), F.greatest(a, b).alias("high_port"))


def parsed_lists(spark: SparkSession, d: str) -> DataFrame:
    """JSON properties and a list literal parsed from text."""
    e = table(spark, d, "events")
    k = F.from_json("props", "k int")["k"]
    xs = F.from_json(F.concat(F.lit("["), k.cast("string"), F.lit(", "), F.col("user_id").cast("string"), F.lit("]")), "array<int>")
    return e.select("event_id", k.alias("k"), F.aggregate(xs, F.lit(0), lambda a, x: a + x).alias("total"))


def store_flow_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per flow id of packet_event: packets, bytes, duration and payload statistics with population deviation, mean gap in ms."""
    p = table(spark, d, "packet_event").select(canon.flow_id("flow_id").alias("fid"), canon.millis("timestamp").alias("ms"), F.greatest(F.col("payload_len_raw"), F.lit(0)).alias("size")).where("fid is not null and ms is not null")
    n = F.count(F.lit(1))
    gap = F.when(n > 1, (F.max("ms") - F.min("ms")) / (n - 1)).otherwise(0.0)
    return p.groupBy("fid").agg(
        n.alias("n_packets"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"), (F.max("ms") - F.min("ms")).alias("duration_ms"), F.round(F.avg("size"), 6).alias("mean_size"),
        F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.round(F.stddev_pop("size"), 4).alias("std_size"), F.round(gap, 4).alias("mean_gap_ms"),
    )


def flow_technique_topk(spark: SparkSession, d: str) -> DataFrame:
    """Per flow the five strongest techniques by literal weight."""
    docs = payloads(spark, d).select("doc_id", "flow").where("flow is not null")
    dic = table(spark, d, "traffic_class").where("technique_id is not null").select(F.lower("label").alias("pattern"), F.col("technique_id").alias("technique"))
    best = evidence.literal_weights(_hits(spark, d), "doc_id", dic).join(docs, "doc_id").groupBy("flow", "technique").agg(F.round(F.max("weight"), 6).alias("weight"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("flow").orderBy(F.desc("weight"), "technique"))).where("rank <= 5")


def literal_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per label: share of documents with any literal, and mean number of distinct ones."""
    docs = payloads(spark, d).select("doc_id", "label")
    n = _hits(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    out = docs.join(n, "doc_id", "left").groupBy("label")
    return out.agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(F.col("n").isNotNull().cast("double")), 6).alias("hit_share"), F.round(F.avg(F.coalesce("n", F.lit(0)).cast("double")), 6).alias("mean_hits"))


def hits_per_connection(spark: SparkSession, d: str) -> DataFrame:
    docs = payloads(spark, d).select("doc_id", "flow").where("flow is not null")
    hit = _hits(spark, d).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_semi").groupBy("flow").agg(F.count(F.lit(1)).alias("n_documents"))


def capture_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Capture-wide fan-out of each flow's source under its label."""
    f = flows.assign_flows(views.packets(spark, d))
    fan = f.groupBy("label", "src_ip").agg(F.count_distinct("dst_ip").alias("n_targets"), F.count_distinct("dst_port").alias("n_ports"), F.count(F.lit(1)).alias("n_packets"))
    first = f.groupBy("flow_id").agg(F.min(F.struct("ts", "seq", "label", "src_ip")).alias("x")).select("flow_id", "x.label", "x.src_ip")
    return first.join(fan, ["label", "src_ip"], "left").select("flow_id", "n_targets", "n_ports", "n_packets")


def flow_basic(spark: SparkSession, d: str) -> DataFrame:
    """Six basic and some richer features of flow records by flow id, with guarded division."""
    s = _states(spark, d).where("fid is not null")
    span = F.max("end_ms") - F.min("start_ms")
    return s.groupBy("fid").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("packet_count").alias("n_packets"), F.count_distinct("dst_port").alias("n_ports"), F.count_distinct("dst_host").alias("n_hosts"), span.alias("span_ms"),
        F.round(F.when(span > 0, F.sum("packet_count") * 1000.0 / span).otherwise(0.0), 6).alias("packets_per_s"),
    )


def text_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints named in the flow line of graph texts, counted by target."""
    docs = payloads(spark, d)
    got = docs.select(F.regexp_extract("text", r"dst=(\d+\.\d+\.\d+\.\d+) port=(\d+)", 1).alias("target"), F.regexp_extract("text", r"dst=(\d+\.\d+\.\d+\.\d+) port=(\d+)", 2).alias("port")).where("target <> ''")
    return got.groupBy("target", "port").agg(F.count(F.lit(1)).alias("n"))


def graph_text(spark: SparkSession, d: str) -> DataFrame:
    t = reports.flow_text(flows.assign_flows(views.packets(spark, d)))
    return t.select("flow_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def report_verification(spark: SparkSession, d: str) -> DataFrame:
    s = _states(spark, d)
    valid = s.select(F.col("src_host").alias("entity")).unionAll(s.select("dst_host")).unionAll(s.select("fid"))
    out = reports.verify_entities(payloads(spark, d), "doc_id", "text", valid)
    return out.select("doc_id", "n_entities", "n_unknown", F.round("unknown_share", 6).alias("unknown_share"))


def report_claims(spark: SparkSession, d: str) -> DataFrame:
    c = payloads(spark, d).select("label", F.explode(reports.claims("text")).alias("c"))
    return c.groupBy("label").agg(F.count(F.lit(1)).alias("n_claims"), F.sum(F.col("c").rlike(r"\d").cast("long")).alias("with_numbers"), F.max(F.octet_length("c")).cast("long").alias("longest"))


def report_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "flow_context").select("context_id")
    i = F.col("context_id")
    full, without, only = (i % 101 / 100.0), (i % 37 / 100.0), (i % 89 / 100.0)
    f = reports.fidelity(full, without, only)
    star = reports.harmonic([full, 1.0 - without, only, f["characterization"]])
    return c.select("context_id", *[F.round(v, 6).alias(k) for k, v in f.items()], F.round(star, 6).alias("f_star"))


def counterfactual_drop(spark: SparkSession, d: str) -> DataFrame:
    f = flows.assign_flows(views.packets(spark, d)).withColumn("v", F.col("payload_len").cast("double"))
    return reports.leave_one_out(f, "flow_id", "v").select("seq", F.round("drop", 6).alias("drop"))


def pruned_links(spark: SparkSession, d: str) -> DataFrame:
    """Next-packet edges both of whose packets are among the three largest of their flow."""
    f = flows.assign_flows(views.packets(spark, d))
    best = f.withColumn("_r", F.row_number().over(W.partitionBy("flow_id").orderBy(F.desc("payload_len"), "seq"))).where("_r <= 3")
    return reports.keep_connected(graph.next_packet(f).select("src", "dst"), best, ("src", "dst"), "seq")


def evidence_bundles(spark: SparkSession, d: str) -> DataFrame:
    f = flows.assign_flows(views.packets(spark, d))
    return reports.bundles(f, flows.flow_consensus(flows.flow_features(f)))


def packet_lists(spark: SparkSession, d: str) -> DataFrame:
    """Per flow the sizes and flags of its first 20 packets, as lists."""
    f = flows.assign_flows(views.packets(spark, d))
    r = f.withColumn("_r", F.row_number().over(W.partitionBy("flow_id").orderBy("ts", "seq"))).where("_r <= 20")
    xs = F.array_sort(F.collect_list(F.struct("_r", "ip_len", "flags")))
    return r.groupBy("flow_id").agg(xs.alias("x")).select("flow_id", F.array_join(F.transform("x", lambda s: s["ip_len"].cast("string")), ",").alias("sizes"), F.array_join(F.transform("x", lambda s: s["flags"].cast("string")), ",").alias("flags"))


def template_report(spark: SparkSession, d: str) -> DataFrame:
    s = _states(spark, d)
    text = F.format_string("Flow %s from %s to %s was labelled %s after %d packets.", *[F.coalesce(c, F.lit("unknown")) for c in ("fid", "src_host", "dst_host", "label")], F.coalesce("packet_count", F.lit(0)))
    return s.select("state_id", text.alias("report"))


def loss_terms(spark: SparkSession, d: str) -> DataFrame:
    """Cross entropy, focal loss (gamma 2) and the class of prior-adjusted scores (tau 1)."""
    rows = _logits(spark, d)
    n = rows.count()
    prior = {r["y4"]: r["n"] / n for r in rows.groupBy("y4").agg(F.count(F.lit(1)).alias("n")).collect()}
    p = F.element_at(metrics.softmax(F.col("logits")), F.col("y4").cast("int") + 1)
    ce = -F.log(F.greatest(p, F.lit(1e-12)))
    import math

    bias = [-math.log(max(prior.get(k, 0.0), 1e-12)) for k in range(4)]
    return rows.select("node_id", F.round(ce, 5).alias("cross_entropy"), F.round(ce * (1 - p) * (1 - p), 5).alias("focal"), metrics.biased_argmax(F.col("logits"), bias).alias("adjusted"))


def edge_dropout(spark: SparkSession, d: str) -> DataFrame:
    """A pseudo-random half of the host edges, a quarter of them turned."""
    e = _links(spark, d).withColumn("h", hash_order("a1", "src", "dst"))
    kept = e.where(F.substring("h", 1, 1) < "8")
    turn = F.substring("h", 2, 1) < "4"
    return kept.select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"), "n")


def node_visits(spark: SparkSession, d: str) -> DataFrame:
    """Links of every host, most linked first: the order in which a cache of any capacity is filled."""
    e = graph.both_ways(_links(spark, d))
    return e.groupBy("src").agg(F.sum("n").alias("visits")).orderBy(F.desc("visits"), "src")


def hot_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every host with its links and its place in the cache: most linked first, ties by name. Places come from the magnitude of the links, ranked by many tasks."""
    e = graph.both_ways(_links(spark, d)).groupBy("src").agg(F.sum("n").alias("visits"))
    return distributed_rank(e.withColumn("_all", F.lit(0)), ["_all"], [F.desc("visits"), "src"], -F.floor(F.log2("visits")), "place", "_n").select("src", "visits", "place")


def label_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Labels of flow contexts matched to class ids by name; those without a class show null."""
    c = table(spark, d, "flow_context").groupBy(canon.label("label", "unknown").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return c.join(table(spark, d, "traffic_class").select("label", "class_id"), "label", "left")


def attention_max(spark: SparkSession, d: str) -> DataFrame:
    a = graph.edge_softmax(_links(spark, d).withColumn("score", F.log1p("n")))
    return a.groupBy("src").agg(F.round(F.max("attention"), 6).alias("attention"))


def first_tactic(spark: SparkSession, d: str) -> DataFrame:
    """The first family seen for each technique prefix."""
    t = table(spark, d, "traffic_class").where("technique_id is not null").withColumn("prefix", F.substring("technique_id", 1, 3))
    return t.withColumn("_r", F.row_number().over(W.partitionBy("prefix").orderBy("class_id"))).where("_r = 1").select("prefix", "family", "class_id")


def source_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Label of a flow id: from flow records, else from contexts, else from packets."""
    s = _states(spark, d).where("fid is not null").groupBy("fid").agg(F.min("label").alias("a"))
    c = table(spark, d, "flow_context").select(canon.flow_id("flow_id").alias("fid"), canon.label("label").alias("l")).where("fid is not null").groupBy("fid").agg(F.min("l").alias("b"))
    p = table(spark, d, "packet_event").select(canon.flow_id("flow_id").alias("fid"), canon.label("flow_label").alias("l")).where("fid is not null").groupBy("fid").agg(F.min("l").alias("c"))
    out = s.join(c, "fid", "full").join(p, "fid", "full")
    origin = F.when(F.col("a").isNotNull(), "records").when(F.col("b").isNotNull(), "contexts").when(F.col("c").isNotNull(), "packets")
    return out.select("fid", F.coalesce("a", "b", "c").alias("label"), origin.alias("origin"))


def literal_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Literals set in backticks in documents."""
    x = payloads(spark, d).select(F.explode(evidence.extract_literals("text")).alias("literal"))
    return x.groupBy("literal").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        label_isolation, label_isolation_by_capture, isolation_audit, answer_key, key_overlap, anchor_sweep, mask_audit, rare_classes, class_composition, top_ports, row_features, port_pair, parsed_lists,
        store_flow_stats, flow_technique_topk, literal_coverage, hits_per_connection, capture_fanout, flow_basic, text_endpoints, graph_text, report_verification, report_claims,
        report_metrics, counterfactual_drop, pruned_links, evidence_bundles, packet_lists, template_report, loss_terms, edge_dropout, node_visits, hot_nodes, label_alignment, attention_max,
        first_tactic, source_precedence, literal_extraction,
    )
}

_REQ = f"""rq as (select doc_id, coalesce(nullif(lower(trim(kind)), ''), 'none') as label, coalesce({sqlkit.flow_id('flow_id')}, 'none') as flow, text, doc_id % 3 <> 0 as http from documents where text is not null),
 hit as (select distinct label, flow from rq where http and ((label = 'note' and (contains(lower(text), 'scanner') or contains(lower(text), 'rate of'))) or (label = 'ticket' and (contains(lower(text), 'injection') or contains(lower(text), 'probe'))) or (label = 'report' and contains(lower(text), 'watch list')))),
 iso as (select rq.doc_id, rq.label, case when rq.label in ('note', 'ticket', 'report') and hit.flow is null then 'benign' else rq.label end as clean_label from rq left join hit on rq.label = hit.label and rq.flow = hit.flow)"""
_PE_FID = f"(select distinct {sqlkit.flow_id('flow_id')} as fid from packet_event where {sqlkit.flow_id('flow_id')} is not null)"
_PR = "round({0} / greatest({1}, 1), 6)"
_ST4 = ", ".join(f"coalesce((case when flow_feature_stats['{k}'] is null or isnan(flow_feature_stats['{k}']) or isinf(flow_feature_stats['{k}']) or flow_feature_stats['{k}'] = -1 then null else flow_feature_stats['{k}'] end), 0.0)" for k in ("plen_mean", "plen_max", "iat_mean", "iat_std"))
_FID_MIN = "select {fid} as fid, min(nullif(lower(trim({label})), '')) as l from {t} where {fid} is not null group by 1"
ORACLE = {
    "label_isolation": f"with {_REQ} select * from iso",
    "label_isolation_by_capture": f"with {_REQ.replace(', text, doc_id', " || '|' || coalesce(source, 'none') as flow, text, doc_id").replace(" as flow || '|'", " || '|'")} select * from iso",
    "isolation_audit": f"with {_REQ} select label, count(*) as total, count(*) filter (where clean_label = label) as kept, count(*) filter (where clean_label <> label) as demoted from iso group by 1",
    "answer_key": f"with {_FS}, k as (select distinct {sqlkit.flow_id('flow_id')} as fid from flow_context) select st.label, case when st.label in (select label from traffic_class where class_id > 0) and k.fid is null then 'benign' else st.label end as clean_label, count(*) as n from st left join k on st.fid = k.fid group by 1, 2",
    "key_overlap": f"with {_FS}, a as (select distinct fid from st where fid is not null), b as {_PE_FID} select 'both' as part, count(*) as n from a where fid in (select fid from b) union all select 'records_only', count(*) from a where fid not in (select fid from b) union all select 'packets_only', count(*) from b where fid not in (select fid from a)",
    "anchor_sweep": f"with {_FS}, t as (select unnest([1.0, 5.0, 10.0, 20.0, 50.0]::double[]) as threshold), c as (select threshold, count(*) filter (where packet_count >= threshold and label <> 'benign') as tp, count(*) filter (where packet_count >= threshold and label = 'benign') as fp, count(*) filter (where packet_count < threshold and label <> 'benign') as fn from st, t where label is not null group by 1) select threshold, tp, fp, fn, {_PR.format('tp', 'tp + fp')} as precision, {_PR.format('tp', 'tp + fn')} as recall from c",
    "mask_audit": f"with {_FS}, r as (select label, (packet_count >= 10)::int as m, (case when dst_port is null then null else (dst_port in (80, 443, 8080, 8443))::int end) as o from st where label is not null and packet_count is not null), a as (select coalesce(label, 'TOTAL') as label, cast(sum(m) as bigint) as masked, cast(sum(m * o) as bigint) as correct, cast(sum(o) as bigint) as true_rows from r group by rollup(label)) select *, {_PR.format('correct', 'masked')} as precision, {_PR.format('correct', 'true_rows')} as recall from a",
    "rare_classes": f"with {_FS}, n as (select label, count(*) as n from st where label is not null group by 1), r as (select *, cast(row_number() over (order by n, label) as integer) as rank from n) select * from r where rank <= 3 or n < 100",
    "class_composition": f"with {views.PACKETS_SQL} select label, count(*) as n, round(avg((dst_port in (22, 53, 123, 443))::int), 6) as infra_share, round(avg((payload_len = 0)::int), 6) as empty_share, count(*) filter (where proto = 0) as tcp, count(*) filter (where proto = 1) as udp, count(*) filter (where proto = 2) as icmp, count(*) filter (where proto = 3) as other from pkt group by 1",
    "top_ports": f"with {views.PACKETS_SQL}, n as (select label, dst_port, count(*) as n from pkt group by 1, 2), r as (select *, cast(row_number() over (partition by label order by n desc, dst_port) as integer) as rank from n) select * from r where rank <= 4",
    "row_features": f"with r as (select *, [{_ST4}] as s from flow_context), m as (select *, (s[1] + s[2] + s[3] + s[4]) / 4.0 as m from r) select context_id, coalesce(regexp_matches(src_ip, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2\\d|3[01])\\.)'), false) as private_source, dst_port in (53, 123, 67, 68) as infra_port, (upper(protocol) = 'TCP')::int as is_tcp, (upper(protocol) = 'UDP')::int as is_udp, (upper(protocol) = 'ICMP')::int as is_icmp, round(sqrt(((s[1] - m) * (s[1] - m) + (s[2] - m) * (s[2] - m) + (s[3] - m) * (s[3] - m) + (s[4] - m) * (s[4] - m)) / 3.0), 4) as spread from m",
    "port_pair": "select context_id, least(src_port, dst_port) as low_port, greatest(src_port, dst_port) as high_port from flow_context where src_port is not null and dst_port is not null",
    "parsed_lists": "with k as (select event_id, user_id, try_cast(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) as integer) as k from events) select event_id, k, cast(k + user_id as integer) as total from k",
    "store_flow_stats": f"with p as (select {sqlkit.flow_id('flow_id')} as fid, {sqlkit.millis('"timestamp"')} as ms, greatest(payload_len_raw, 0) as size from packet_event) select fid, count(*) as n_packets, cast(coalesce(sum(size), 0) as bigint) as n_bytes, max(ms) - min(ms) as duration_ms, round(avg(size), 6) as mean_size, min(size) as min_size, max(size) as max_size, round(stddev_pop(size), 4) as std_size, round(case when count(*) > 1 then (max(ms) - min(ms)) / (count(*) - 1) else 0.0 end, 4) as mean_gap_ms from p where fid is not null and ms is not null group by 1",
    "flow_technique_topk": f"with {HX_SQL}{_LITS}, b as (select hx.flow, lw.technique, round(max(weight), 6) as weight from lw join hx on lw.doc_id = hx.doc_id where hx.flow is not null group by 1, 2), r as (select *, cast(row_number() over (partition by flow order by weight desc, technique) as integer) as rank from b) select * from r where rank <= 5",
    "literal_coverage": f"with {HX_SQL}{_LITS}, n as (select doc_id, count(*) as n from lh group by 1) select label, count(*) as n_docs, round(avg((c.n is not null)::int), 6) as hit_share, round(avg(coalesce(c.n, 0)), 6) as mean_hits from hx left join n c on hx.doc_id = c.doc_id group by 1",
    "hits_per_connection": f"with {HX_SQL}{_LITS} select flow, count(*) as n_documents from hx where flow is not null and doc_id in (select doc_id from lh) group by 1",
    "capture_fanout": f"with {views.flowed_sql()}, fan as (select label, src_ip, count(distinct dst_ip) as n_targets, count(distinct dst_port) as n_ports, count(*) as n_packets from flowed group by 1, 2), f as (select flow_id, arg_min(label, (ts, seq)) as label, arg_min(src_ip, (ts, seq)) as src_ip from flowed group by 1) select flow_id, n_targets, n_ports, n_packets from f left join fan on f.label = fan.label and f.src_ip = fan.src_ip",
    "flow_basic": f"with {_FS} select fid, count(*) as n_records, cast(sum(packet_count) as bigint) as n_packets, count(distinct dst_port) as n_ports, count(distinct dst_host) as n_hosts, max(end_ms) - min(start_ms) as span_ms, round(case when max(end_ms) - min(start_ms) > 0 then sum(packet_count) * 1000.0::double / (max(end_ms) - min(start_ms)) else 0.0 end, 6) as packets_per_s from st where fid is not null group by 1",
    "text_endpoints": "with g as (select regexp_extract(text, 'dst=(\\d+\\.\\d+\\.\\d+\\.\\d+) port=(\\d+)', 1) as target, regexp_extract(text, 'dst=(\\d+\\.\\d+\\.\\d+\\.\\d+) port=(\\d+)', 2) as port from documents where text is not null) select target, port, count(*) as n from g where target <> '' group by 1, 2",
    "graph_text": f"with {views.flowed_sql()}, r as (select *, row_number() over (partition by flow_id order by ts, seq) - 1 as r from flowed), t as (select flow_id, 'flow ' || flow_id || chr(10) || string_agg('pkt #' || r || ' len=' || payload_len || ' dir=' || case when is_fwd then 'fwd' else 'bwd' end, chr(10) order by r) as x from r group by 1) select flow_id, length(x) as n_chars, md5(x) as text_md5 from t",
    "report_verification": f"with {_FS}, v as (select src_host as e from st union select dst_host from st union select fid from st), x as (select doc_id, list_concat(regexp_extract_all(text, '\\b(flow_\\w+)', 1), regexp_extract_all(text, '\\b(\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})\\b', 1)) as l from documents where text is not null), m as (select distinct doc_id, lower(e) as e from (select doc_id, unnest(l) as e from x)), c as (select m.doc_id, count(*) as n_entities, count(*) filter (where v.e is null) as n_unknown from m left join v on m.e = v.e group by 1) select x.doc_id, coalesce(n_entities, 0) as n_entities, coalesce(n_unknown, 0) as n_unknown, round(coalesce(n_unknown / n_entities, 0.0), 6) as unknown_share from x left join c on x.doc_id = c.doc_id",
    "node_visits": f"with {_LK}, b as (select src, n from lk union all select dst, n from lk) select src, cast(sum(n) as bigint) as visits from b group by 1",
    "report_metrics": "with i as (select context_id, (context_id % 101) / 100.0::double as f, (context_id % 37) / 100.0::double as w, (context_id % 89) / 100.0::double as o from flow_context), p as (select *, round(f - w, 6) as fp, round(f - o, 6) as fm from i), q as (select *, greatest(least(fp, 1.0), 0.0) as a, greatest(least(1.0 - fm, 1.0), 0.0) as b from p), c as (select *, case when a > 0 and b > 0 then 1.0 / (0.5 / a + 0.5 / b) else 0.0 end as ch from q), h as (select *, greatest(least(f, 1.0), 0.0) as h1, greatest(least(1.0 - w, 1.0), 0.0) as h2, greatest(least(o, 1.0), 0.0) as h3, greatest(least(ch, 1.0), 0.0) as h4 from c) select context_id, round(fp, 6) as fidelity_plus, round(fm, 6) as fidelity_minus, round(ch, 6) as characterization, round(case when least(h1, h2, h3, h4) > 0 then 4.0 / (1.0 / h1 + 1.0 / h2 + 1.0 / h3 + 1.0 / h4) else 0.0 end, 6) as f_star from h",
    "counterfactual_drop": f"with {views.flowed_sql()}, w as (select seq, payload_len::double as v, count(*) over (partition by flow_id) as n, sum(payload_len::double) over (partition by flow_id) as t from flowed) select seq, round(case when n > 1 then t / n - (t - v) / (n - 1) else 0.0 end, 6) as drop from w",
    "pruned_links": f"with {views.flowed_sql()}, b as (select seq, row_number() over (partition by flow_id order by payload_len desc, seq) as r from flowed), k as (select seq from b where r <= 3), e as (select lag(seq) over (partition by flow_id order by ts, seq) as src, seq as dst from flowed) select src, dst from e where src in (select seq from k) and dst in (select seq from k)",
    "packet_lists": f"with {views.flowed_sql()}, r as (select *, row_number() over (partition by flow_id order by ts, seq) as r from flowed) select flow_id, string_agg(ip_len::varchar, ',' order by r) as sizes, string_agg(flags::varchar, ',' order by r) as flags from r where r <= 20 group by 1",
    "template_report": f"with {_FS} select state_id, 'Flow ' || coalesce(fid, 'unknown') || ' from ' || coalesce(src_host, 'unknown') || ' to ' || coalesce(dst_host, 'unknown') || ' was labelled ' || coalesce(label, 'unknown') || ' after ' || coalesce(packet_count, 0) || ' packets.' as report from st",
    "loss_terms": f"with {LOGITS_SQL}, y as (select node_id, flow_y % 4 as y4 from graph_flow where flow_y is not null), pr as (select y4, count(*) / (select count(*) from y)::double as p from y group by 1), e as (select lg.node_id, y4, l, list_transform(l, lambda x: exp(x - list_max(l))) as e from lg join y on lg.node_id = y.node_id), p as (select node_id, l, e[y4 + 1] / list_sum(e) as p from e), b as (select node_id, [l[1] - ln((select p from pr where y4 = 0)), l[2] - ln((select p from pr where y4 = 1)), l[3] - ln((select p from pr where y4 = 2)), l[4] - ln((select p from pr where y4 = 3))] as lb, p from p) select node_id, round(-ln(greatest(p, 1e-12)), 5) as cross_entropy, round(-ln(greatest(p, 1e-12)) * (1 - p) * (1 - p), 5) as focal, cast(list_position(lb, list_max(lb)) - 1 as integer) as adjusted from b",
    "edge_dropout": f"with {_LK}, h as (select *, md5('a1|' || src || '|' || dst) as h from lk) select case when substr(h, 2, 1) < '4' then dst else src end as src, case when substr(h, 2, 1) < '4' then src else dst end as dst, n from h where substr(h, 1, 1) < '8'",
    "hot_nodes": f"with {_LK}, b as (select src, n from lk union all select dst, n from lk) select src, cast(sum(n) as bigint) as visits, row_number() over (order by sum(n) desc, src) as place from b group by 1",
    "label_alignment": "with c as (select coalesce(nullif(lower(trim(label)), ''), 'unknown') as label, count(*) as n from flow_context group by 1) select c.label, c.n, t.class_id from c left join traffic_class t on c.label = t.label",
    "attention_max": f"with {_LK}, m as (select *, max(ln(1 + n)) over (partition by dst) as m from lk), e as (select *, exp(ln(1 + n) - m) as e from m), a as (select src, e / sum(e) over (partition by dst) as a from e) select src, round(max(a), 6) as attention from a group by 1",
    "first_tactic": "with t as (select substr(technique_id, 1, 3) as prefix, family, class_id, row_number() over (partition by substr(technique_id, 1, 3) order by class_id) as r from traffic_class where technique_id is not null) select prefix, family, class_id from t where r = 1",
    "source_precedence": f"with s as ({_FID_MIN.format(fid=sqlkit.flow_id('flow_id'), label='label', t='flow_state')}), c as ({_FID_MIN.format(fid=sqlkit.flow_id('flow_id'), label='label', t='flow_context')}), p as ({_FID_MIN.format(fid=sqlkit.flow_id('flow_id'), label='flow_label', t='packet_event')}), k as (select fid from s union select fid from c union select fid from p) select k.fid, coalesce(s.l, c.l, p.l) as label, case when s.l is not null then 'records' when c.l is not null then 'contexts' when p.l is not null then 'packets' end as origin from k left join s on k.fid = s.fid left join c on k.fid = c.fid left join p on k.fid = p.fid",
    "literal_extraction": "with x as (select doc_id, unnest(regexp_extract_all(text, '`([^`]+)`', 1)) as l from documents where text is not null), y as (select distinct doc_id, lower(trim(regexp_replace(l, '\\s+', ' ', 'g'))) as literal from x) select literal, count(*) as n from y where length(literal) between 3 and 80 group by 1",
}
