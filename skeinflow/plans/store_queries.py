"""Queries that write to a store, a capture or a stream and read back what came of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import tls
from skeinflow.plans.graph_queries import _FS, _states
from skeinflow.plans.stream_queries import _drain, _streamed
from skeinflow.plans.text_queries import _HX, payloads
from skeinflow.session import scratch
from skeinflow.sources import knowledge, stores, views
from skeinflow.sources.pcap import PcapSource
from skeinflow.sources.tables import table
from skeinflow.streaming.flow_stream import alert_sink, enrich, stream_fan_out, zoned


def _writable(spark: SparkSession, d: str) -> DataFrame:
    """Packets that a datagram can hold: TCP and UDP with ports, ICMP, at most 65,000 payload bytes."""
    port = F.col("src_port").between(0, 65535) & F.col("dst_port").between(0, 65535)
    return views.packets(spark, d).where(((F.col("proto") == 2) | (F.col("proto").isin(0, 1) & port)) & (F.col("payload_len") <= 65000))


def capture_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The packet view written as captures, one folder a label, and read again."""
    spark.dataSource.register(PcapSource)
    path = scratch(spark, "captures").removeprefix("file://")
    _writable(spark, d).withColumn("payload", F.lit(None).cast("binary")).write.format("pcap").mode("append").save(path)
    back = spark.read.format("pcap").option("payloadBytes", "0").load(path)
    return back.select(F.round(F.col("ts") * 1000).cast("long").alias("at_ms"), "src_ip", "dst_ip", "src_port", "dst_port", "proto", "flags", "ip_len", "payload_len", "label")


def log_shards(spark: SparkSession, d: str) -> DataFrame:
    """Events appended as a log, counted by the shard they went to."""
    path = scratch(spark, "event-log")
    stores.append_log(table(spark, d, "events").select("ts", "user_id"), path, shard_hours=24)
    return stores.read_log(spark, path, "user_id long").groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))


def log_retained(spark: SparkSession, d: str) -> DataFrame:
    """The shards that stay when those before the middle of the time are dropped, the newest unsealed."""
    path = scratch(spark, "event-log")
    stores.append_log(table(spark, d, "events").select("ts", "user_id"), path, shard_hours=24)
    names = [name for name, _ in stores.shards(spark, path)]
    stores.retain(spark, path, oldest=names[len(names) // 2] if names else None)
    kept = stores.read_log(spark, path, "user_id long")
    newest = names[-1] if names else ""
    return kept.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).withColumn("sealed", F.col("shard") < newest)


def splits_stored(spark: SparkSession, d: str) -> DataFrame:
    """Two protocols of splits written to one store; one is read back."""
    path = scratch(spark, "splits")
    flow = F.col("state_id").cast("string").alias("flow_id")
    s = _states(spark, d).select(flow, F.when(F.col("state_id") % 5 == 0, "test").otherwise("train").alias("split"), F.explode(F.array(F.lit("random"), F.lit("temporal"))).alias("protocol"))
    stores.write_splits(path, s)
    return stores.read_splits(spark, path, "temporal").groupBy("split").agg(F.count(F.lit(1)).alias("n_flows"))


def artifact_stored(spark: SparkSession, d: str) -> DataFrame:
    """Flow nodes and host edges written as an artifact and counted by relation after reading."""
    path = scratch(spark, "artifact")
    s = _states(spark, d)
    ends = {"from_host": "src_host", "to_host": "dst_host"}
    parts = [s.where(F.col(c).isNotNull()).select(F.lit(r).alias("rel"), F.col("state_id").cast("string").alias("src"), F.col(c).alias("dst")) for r, c in ends.items()]
    stores.write_artifact(path, {"flow": s.select("state_id", "label")}, parts[0].unionAll(parts[1]), {"source": "flow_state"})
    nodes, edges, _ = stores.read_artifact(spark, path, ["flow"])
    n = nodes["flow"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("flow").alias("part"), "n")
    return n.unionAll(edges.groupBy(F.col("rel").alias("part")).agg(F.count(F.lit(1)).alias("n")))


def class_map_csv(spark: SparkSession, d: str) -> DataFrame:
    """The class table as CSV, read as a class map: unreadable weights are 1, empty and unknown techniques are left out."""
    path = scratch(spark, "class-map")
    weight = F.when(F.col("class_id") % 3 == 0, "n/a").otherwise((F.col("class_id") / 10.0).cast("string"))
    c = table(spark, d, "traffic_class")
    c.select("label", F.when(F.col("class_id") != 5, F.col("technique_id")).alias("technique"), weight.alias("weight")).coalesce(1).write.csv(path, header=True)
    known = c.where("class_id <> 7").select(F.col("technique_id").alias("technique")).where("technique is not null")
    return knowledge.class_map(knowledge.read_csv(spark, path, "label string, technique string, weight string"), known)


def stix_literals(spark: SparkSession, d: str) -> DataFrame:
    """The class table written as a bundle of technique objects, and the literals set as code in their descriptions; a revoked object and one without technique are left out."""
    path = scratch(spark, "stix")
    refs = F.array(F.struct(F.lit("other").alias("source_name"), F.lit("x").alias("external_id")), F.struct(F.lit("mitre-attack").alias("source_name"), F.col("technique_id").alias("external_id")))
    text = F.concat(F.lit("Seen as <code>"), F.upper("label"), F.lit("\n probe</code> and `"), F.col("family"), F.lit("`."))
    each = F.struct(F.lit("attack-pattern").alias("type"), F.col("label").alias("name"), text.alias("description"), (F.col("class_id") == 5).alias("revoked"), refs.alias("external_references"))
    bundle = table(spark, d, "traffic_class").agg(F.to_json(F.struct(F.collect_list(each).alias("objects"))).alias("value"))  # a fixed table of 14 rows
    bundle.coalesce(1).write.text(path)
    return knowledge.literal_dictionary(knowledge.techniques(spark, path))


def tls_records(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the records of made payloads: the text in one record, a second record of three bytes, then what is none."""
    docs = payloads(spark, d).where(F.length("payload").between(1, 16000))
    size = F.unhex(F.lpad(F.hex(F.length("payload")), 4, "0"))
    raw = F.concat(F.unhex(F.lit("170303")), size, "payload", F.unhex(F.lit("1503030003010203")), F.unhex(F.lit("00ff")))
    return docs.select("doc_id", F.array_join(tls.tls_record_sizes(raw), ",").alias("sizes"))


def tls_hello(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint and server name of made client hellos: one cipher by document, the flow as server name."""
    docs = payloads(spark, d).where("flow is not null and length(flow) < 200")
    cipher = F.lpad(F.hex(F.col("doc_id") % 200 + 4096), 4, "0")
    name, n = F.hex(F.encode("flow", "UTF-8")), F.length(F.encode("flow", "UTF-8"))

    def two(v: F.Column) -> F.Column:
        return F.lpad(F.hex(v), 4, "0")

    sni = F.concat(F.lit("0000"), two(n + 5), two(n + 3), F.lit("00"), two(n), name)
    hello = F.concat(F.lit("0303"), F.lit("00" * 32), F.lit("00"), F.lit("0004"), cipher, F.lit("1a1a"), F.lit("0100"), two(n + 9), sni)
    body = F.concat(F.lit("01"), F.lpad(F.hex(F.length(hello) / 2), 6, "0"), hello)
    raw = F.unhex(F.concat(F.lit("160301"), two(F.length(body) / 2), body))
    got = docs.select("doc_id", tls.tls_client_hello(raw).alias("h"))
    return got.select("doc_id", "h.ja3", "h.ja3_md5", "h.sni")


def stream_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Exact fan-out of each user's events over tumbling days that the watermark closed; the value's sign stands for the flag."""
    e = zoned(_streamed(spark, d, "events"), "ts").select(F.col("user_id").alias("src_ip"), F.col("ts").alias("at"), F.col("event_type").alias("dst_ip"), F.when(F.col("value") > 50, 2).otherwise(0).alias("flags"))
    out = _drain(spark, stream_fan_out(e, "1 day", "0 seconds"), "stream-fanout")
    return out.select(F.col("src_ip").alias("user_id"), F.unix_micros("window.start").alias("start_us"), "n_packets", "n_syn", "n_targets")


def stream_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Streamed flow records with the family and technique of their label from the class table."""
    s = _streamed(spark, d, "flow_state").select("state_id", F.lower(F.trim("label")).alias("label"))
    known = table(spark, d, "traffic_class").select("label", "family", "technique_id")
    return _drain(spark, enrich(s, known, "label"), "stream-enriched").select("state_id", "family", "technique_id")


def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of the idempotent sink: flow contexts of at least 40 packets. A second run finds nothing new and adds nothing."""
    path, check = scratch(spark, "alerts"), scratch(spark, "alerts-checkpoint")
    s = _streamed(spark, d, "flow_context").select("context_id", F.col("packet_count").cast("double").alias("score"))
    for _ in range(2):
        q = s.writeStream.foreachBatch(alert_sink(path, 40.0)).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema("context_id long, score double").parquet(f"{path}/*")


QUERIES = {
    f.__name__: f
    for f in (
        capture_round_trip, log_shards, log_retained, splits_stored, artifact_stored, class_map_csv, stix_literals, tls_records, tls_hello, stream_fanout, stream_enriched, stream_alerts,
    )
}

_SHARDS = "s as (select strftime(date_trunc('day', ts), '%Y%m%dT%HZ') as shard, user_id from events), n as (select shard, count(*) as n, count(distinct user_id) as n_users from s group by 1)"
ORACLE = {
    "capture_round_trip": f"""with {views.PACKETS_SQL} select cast(round(ts * 1000) as bigint) as at_ms, src_ip, dst_ip, case when proto = 2 then -1 else src_port end as src_port, case when proto = 2 then -1 else dst_port end as dst_port, proto,
        case when proto = 0 then flags else 0 end as flags, cast(payload_len + case when proto = 0 then 40 else 28 end as integer) as ip_len, payload_len, label
        from pkt where (proto = 2 or (proto in (0, 1) and src_port between 0 and 65535 and dst_port between 0 and 65535)) and payload_len <= 65000""",
    "log_shards": f"with {_SHARDS} select * from n",
    "log_retained": f"with {_SHARDS}, r as (select *, row_number() over (order by shard) - 1 as i, count(*) over () as c from n) select shard, n, i < c - 1 as sealed from r where i >= c // 2 or i = c - 1",
    "splits_stored": "select case when state_id % 5 = 0 then 'test' else 'train' end as split, count(*) as n_flows from flow_state group by 1",
    "artifact_stored": f"with {_FS} select 'flow' as part, count(*) as n from st union all select 'from_host', count(*) from st where src_host is not null union all select 'to_host', count(*) from st where dst_host is not null",
    "class_map_csv": """select label, technique_id as technique, case when class_id % 3 = 0 then 1.0 else class_id / 10.0 end::double as map_weight from traffic_class
        where technique_id is not null and class_id <> 5 and technique_id in (select technique_id from traffic_class where class_id <> 7)""",
    "stix_literals": "with t as (select * from traffic_class where technique_id is not null and class_id <> 5) select distinct lower(label) || ' probe' as pattern, technique_id as technique from t where family is not null union select lower(family), technique_id from t where family is not null",
    "tls_records": f"with {_HX} select doc_id, n || ',3' as sizes from hx where n between 1 and 16000",
    "tls_hello": f"with {_HX}, j as (select doc_id, flow, '771,' || (doc_id % 200 + 4096) || ',0,,' as ja3 from hx where flow is not null and length(flow) < 200) select doc_id, ja3, md5(ja3) as ja3_md5, flow as sni from j",
    "stream_fanout": """with w as (select user_id, date_trunc('day', ts) as s, count(*) as n_packets, cast(sum(case when value > 50 then 1 else 0 end) as bigint) as n_syn, count(distinct event_type) as n_targets from events group by 1, 2)
        select user_id, epoch_us(s) as start_us, n_packets, n_syn, n_targets from w where s + interval 1 day <= (select max(ts) from events)""",
    "stream_enriched": "select f.state_id, t.family, t.technique_id from flow_state f left join traffic_class t on lower(trim(f.label)) = t.label",
    "stream_alerts": "select context_id, packet_count::double as score from flow_context where packet_count >= 40",
}
