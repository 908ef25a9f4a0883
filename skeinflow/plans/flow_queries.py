"""Queries of the flow operators over the packet view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.operators import flows
from skeinflow.schemas import FLOW_FEATURES
from skeinflow.session import materialize
from skeinflow.sources import views


def _flowed(spark: SparkSession, d: str, **kw) -> DataFrame:
    return flows.assign_flows(views.packets(spark, d), **kw)


def _features(spark: SparkSession, d: str, windows: dict[str, float] | None = None) -> DataFrame:
    p = materialize(views.packets(spark, d), "packets")  # the segmentation and the fan-outs read it
    return flows.flow_features(flows.assign_flows(p), windows, packets=p)


def flow_ids_bidirectional(spark: SparkSession, d: str) -> DataFrame:
    return _flowed(spark, d).select("seq", "flow_id", "segment", "chunk", "is_fwd")


def flow_subwindows_per_class(spark: SparkSession, d: str) -> DataFrame:
    out = _flowed(spark, d, max_packets=8, per_class={"benign": 3, "syn_wave": 2, "udp_wave": -5})
    return out.groupBy("label", "chunk").agg(F.count_distinct("flow_id").alias("n_flows"), F.count(F.lit(1)).alias("n_packets"))


def flow_key_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = flows.key_parts()
    out = _flowed(spark, d).select(*[c.alias(n) for n, c in parts.items()])
    return out.groupBy("key_label", "canonical_key").agg(F.count(F.lit(1)).alias("n_packets"))


def flow_features_full(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d)
    return f.select("flow_id", "label", "src_ip", "dst_ip", F.round("flow_start_ts", 3).alias("flow_start_ts"), *[F.round(c, 6).alias(c) for c in FLOW_FEATURES])


def flow_fanout_long(spark: SparkSession, d: str) -> DataFrame:
    return flows.fan_out(views.packets(spark, d), 60.0).withColumn("bin", F.col("bin").cast("long"))


def flow_fanout_short(spark: SparkSession, d: str) -> DataFrame:
    return flows.fan_out(views.packets(spark, d), 5.0, "_5s").withColumn("bin", F.col("bin").cast("long"))


def flow_rules(spark: SparkSession, d: str) -> DataFrame:
    out = _features(spark, d, {"": 60.0}).select("flow_id", *[F.round(w, 6).alias(name) for name, _, w in flows.flow_rules()])
    return out


def flow_consensus(spark: SparkSession, d: str) -> DataFrame:
    return flows.flow_consensus(_features(spark, d, {"": 60.0})).select("flow_id", "technique", F.round("weight", 6).alias("weight"))


def flow_start(spark: SparkSession, d: str) -> DataFrame:
    return _flowed(spark, d).groupBy("flow_id").agg(F.round(F.min("ts"), 3).alias("first_ts"))


def flow_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of TPC-side events by user with Spark's session window, gap six hours."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("total"), F.unix_micros(F.max("ts")).alias("last_us"))
    return s.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "last_us", "n_events", "total")


QUERIES = {
    f.__name__: f
    for f in (
        flow_ids_bidirectional, flow_subwindows_per_class, flow_key_parts, flow_features_full, flow_fanout_long, flow_fanout_short, flow_rules, flow_consensus,
        flow_start, flow_sessions,
    )
}

_FAN = "{p} select src_ip, cast(floor(ts / {w}) as bigint) as bin, count(distinct dst_ip) as fan_dst_ip{s}, count(distinct dst_port) as fan_dst_port{s}, count(distinct regexp_extract(dst_ip, '^(.*)\\.[^.]*$', 1)) as fan_dst_subnet{s}, cast(sum(case when flags & 2 > 0 and proto = 0 then 1 else 0 end) as bigint) as fan_syn{s}, count(ts) as fan_pkts{s} from pkt group by 1, 2"
RULES_SQL = """
ruled as (select flow_id,
 case when proto = 0 and fan_dst_port >= 50 and r_syn >= 0.7 and plen_pay_mean <= 16 then least(fan_dst_port / 200.0, 1.0) * 0.5 + r_syn * 0.5 else 0.0 end::double as syn_fanout,
 case when fan_dst_ip >= 50 then least(fan_dst_ip / 200.0, 1.0) else 0.0 end::double as host_fanout,
 case when proto = 2 and tot_pkts >= 50 and pkts_per_s >= 100 then least(pkts_per_s / 1000.0, 1.0) else 0.0 end::double as icmp_flood,
 case when proto = 2 and fan_dst_ip >= 20 then least(fan_dst_ip / 100.0, 1.0) else 0.0 end::double as icmp_pingsweep,
 case when proto = 0 and r_syn >= 0.9 and pkts_per_s >= 200 then least(pkts_per_s / 1000.0, 1.0) else 0.0 end::double as syn_flood,
 case when proto = 0 and r_rst >= 0.3 and tot_pkts >= 20 then least(r_rst, 1.0) else 0.0 end::double as rst_burst,
 case when proto = 0 and dur >= 30 and r_psh >= 0.2 and r_rst <= 0.05 and pkts_per_s <= 5 then 0.6 else 0.0 end::double as slowloris,
 case when proto = 0 and fwd_bytes >= 1000000 and bwd_bytes <= 100000 then least(fwd_bytes / 10000000.0, 1.0) else 0.0 end::double as exfil_asymmetric from feats)
"""
RULE_TECHNIQUES = {"syn_fanout": "T1046", "host_fanout": "T1018", "icmp_flood": "T1498", "icmp_pingsweep": "T1018", "syn_flood": "T1498", "rst_burst": "T1499", "slowloris": "T1499", "exfil_asymmetric": "T1041"}
CONSENSUS_SQL = "hits as (" + " union all ".join(f"select flow_id, '{t}' as technique, {r} as weight from ruled where {r} > 0" for r, t in RULE_TECHNIQUES.items()) + "), consensus as (select flow_id, technique, least(1.0, sum(weight))::double as weight from hits group by 1, 2)"
ORACLE = {
    "flow_ids_bidirectional": f"with {views.flowed_sql()} select seq, flow_id, segment, chunk, is_fwd from flowed",
    "flow_subwindows_per_class": f"with {views.flowed_sql("(case label when 'benign' then 3 when 'syn_wave' then 2 else 8 end)")} select label, chunk, count(distinct flow_id) as n_flows, count(*) as n_packets from flowed group by 1, 2",
    "flow_key_parts": f"with {views.flowed_sql()} select split_part(flow_id, '|', 1) as key_label, regexp_replace(regexp_extract(flow_id, '^(.*)#[^#]*$', 1), '^[^|]*\\|', '') as canonical_key, count(*) as n_packets from flowed group by 1, 2",
    "flow_features_full": f"with {views.features_sql()} select flow_id, label, src_ip, dst_ip, round(flow_start_ts, 3) as flow_start_ts, " + ", ".join(f"round({c}::double, 6) as {c}" for c in FLOW_FEATURES) + " from feats",
    "flow_fanout_long": _FAN.format(p=f"with {views.PACKETS_SQL}", w="60.0", s=""),
    "flow_fanout_short": _FAN.format(p=f"with {views.PACKETS_SQL}", w="5.0", s="_5s"),
    "flow_rules": f"with {views.features_sql()}, {RULES_SQL} select flow_id, " + ", ".join(f"round({r}, 6) as {r}" for r in RULE_TECHNIQUES) + " from ruled",
    "flow_consensus": f"with {views.features_sql()}, {RULES_SQL}, {CONSENSUS_SQL} select flow_id, technique, round(weight, 6) as weight from consensus",
    "flow_start": f"with {views.flowed_sql()} select flow_id, round(min(ts), 3) as first_ts from flowed group by 1",
    "flow_sessions": """with g as (select *, case when lag(ts) over w is null or ts - lag(ts) over w > interval 6 hours then 1 else 0 end as cut from events window w as (partition by user_id order by ts)),
        s as (select *, sum(cut) over (partition by user_id order by ts rows unbounded preceding) as n from g)
        select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as last_us, count(*) as n_events, round(sum(value), 4) as total from s group by user_id, n""",
}
