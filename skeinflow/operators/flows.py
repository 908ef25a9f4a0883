"""Bidirectional, session-segmented flows and their features."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinflow.schemas import FLAG_BITS, FLOW_FEATURES, ICMP, TCP
from skeinflow.session import materialize


def endpoint(ip: str, port: str) -> Column:
    return F.concat_ws(":", F.col(ip), F.col(port).cast("string"))


def connection_key(label: bool = True) -> Column:
    """``label|lo|hi|proto`` with the endpoints ``ip:port`` in byte order, so both directions share one key."""
    a, b = endpoint("src_ip", "src_port"), endpoint("dst_ip", "dst_port")
    parts = [F.least(a, b), F.greatest(a, b), F.col("proto").cast("string")]
    return F.concat_ws("|", *([F.col("label")] if label else []), *parts)


def key_parts(flow_id: str = "flow_id") -> dict[str, Column]:
    """The label and the canonical endpoint part of a flow id ``label|lo|hi|proto#segment.chunk``."""
    whole = F.regexp_extract(flow_id, r"^(.*)#[^#]*$", 1)
    return {"key_label": F.substring_index(whole, "|", 1), "canonical_key": F.regexp_replace(whole, r"^[^|]*\|", "")}


def assign_flows(
    packets: DataFrame, timeout_s: float = 30.0, max_packets: int = 256, per_class: Mapping[str, int] | None = None, bucket_s: float = 3600.0
) -> DataFrame:
    """Give every packet its flow: adds key, segment, chunk, flow_id and is_fwd.

    A connection is cut where the gap between packets exceeds ``timeout_s``
    (strictly), and each segment is cut into chunks of ``max_packets`` packets
    (``per_class`` overrides by label; non-positive overrides are ignored; 0 for
    all cuts no chunks). ``is_fwd`` compares a packet's direction with that of the
    first packet of its flow. Order is (ts, seq), so seq must be unique.

    A connection may hold any share of all packets: rows are windowed by
    connection and time bucket, and only one summary row per bucket carries
    segment numbers and open lengths over to the next. The result does not depend on ``bucket_s``.
    """
    a, b = endpoint("src_ip", "src_port"), endpoint("dst_ip", "dst_port")
    rows = packets.withColumn("key", connection_key()).withColumn("_low_first", a <= b).withColumn("_b", F.floor(F.col("ts") / bucket_s))
    w = W.partitionBy("key", "_b").orderBy("ts", "seq")
    rows = rows.withColumn("_cut", F.coalesce((F.col("ts") - F.lag("ts").over(w) > timeout_s).cast("int"), F.lit(0))).withColumn("_rn", F.row_number().over(w))
    rows = rows.withColumn("_cum", F.sum("_cut").over(w))
    rows = rows.withColumn("_run", F.max(F.when((F.col("_cut") == 1) | (F.col("_rn") == 1), F.col("_rn"))).over(w))

    buckets = rows.groupBy("key", "_b").agg(
        F.min("ts").alias("_lo"), F.max("ts").alias("_hi"), F.count(F.lit(1)).alias("_n"), F.sum("_cut").alias("_cuts"),
        F.max_by(F.col("_rn") - F.col("_run") + 1, "_rn").alias("_tail"),
    )
    over = W.partitionBy("key").orderBy("_b")
    before = F.lag("_hi").over(over)
    buckets = buckets.withColumn("_opens", (before.isNull() | (F.col("_lo") - before > timeout_s)).cast("int"))
    buckets = buckets.withColumn("_first", F.sum(F.col("_opens") + F.col("_cuts")).over(over) - F.col("_cuts"))
    fresh = F.sum(((F.col("_cuts") > 0) | (F.col("_opens") == 1)).cast("int")).over(over)
    buckets = buckets.withColumn("_grp", fresh).withColumn("_adds", F.when(F.col("_cuts") > 0, F.col("_tail")).otherwise(F.col("_n")))
    buckets = buckets.withColumn("_open", F.sum("_adds").over(W.partitionBy("key", "_grp").orderBy("_b")))
    buckets = buckets.withColumn("_carry", F.when(F.col("_opens") == 1, F.lit(0)).otherwise(F.lag("_open").over(over)))
    rows = rows.join(buckets.select("key", "_b", "_first", "_carry"), ["key", "_b"])

    position = F.col("_rn") - F.col("_run") + F.when(F.col("_cum") == 0, F.col("_carry")).otherwise(0)
    window = F.lit(max_packets)
    for name, size in (per_class or {}).items():
        if size > 0:
            window = F.when(F.col("label") == name, F.lit(size)).otherwise(window)
    segment = F.col("_first") + F.col("_cum")
    rows = rows.withColumn("segment", segment.cast("long"))
    tail = F.concat(F.col("key"), F.lit("#"), F.col("segment").cast("string"))
    if max_packets > 0:
        rows = rows.withColumn("chunk", F.floor(position / window).cast("long"))
        tail = F.concat(tail, F.lit("."), F.col("chunk").cast("string"))
    else:
        rows = rows.withColumn("chunk", F.lit(0).cast("long"))
    rows = rows.withColumn("flow_id", tail)
    first = F.first("_low_first").over(W.partitionBy("flow_id").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.withColumn("is_fwd", F.col("_low_first") == first).drop(*[c for c in rows.columns if c.startswith("_")])


def ratio(x: Column, y: Column, least: float = 1.0) -> Column:
    return x / F.greatest(y, F.lit(least))


def _stats(value: str, name: str, when: Column | None = None, total: bool = True) -> list[Column]:
    """mean, std (ddof 1), min, max and sum where ``when`` holds; 0 where there is nothing (std: fewer than two)."""
    v = F.col(value).cast("double")
    v = v if when is None else F.when(when, v)
    parts = {"mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v), "sum": F.sum(v)}
    return [F.coalesce(c, F.lit(0.0)).alias(f"{name}_{k}") for k, c in parts.items() if total or k != "sum"]


def contacts(packets: DataFrame, window_s: float) -> DataFrame:
    """Per source, tumbling window and target (address and port): packets and SYN packets. The base of every fan-out whose window is a multiple of ``window_s``."""
    syn = ((F.col("flags").bitwiseAND(FLAG_BITS["syn"]) > 0) & (F.col("proto") == TCP)).cast("long")
    return packets.groupBy("src_ip", F.floor(F.col("ts") / window_s).alias("bin"), "dst_ip", "dst_port").agg(F.sum(syn).alias("n_syn"), F.count("ts").alias("n_pkts"))


def fan_out(packets: DataFrame, window_s: float, suffix: str = "", base: DataFrame | None = None, base_s: float | None = None) -> DataFrame:
    """Per source and tumbling window: distinct destinations, ports and /24 subnets, SYN packets, packets.

    Counted over the distinct targets of each window (``contacts``), which a source repeats itself in rather than over its packets. ``base`` gives
    those of a window of ``base_s`` seconds that divides ``window_s``, so that several windows share one pass.
    """
    own = contacts(packets, window_s) if base is None else base.withColumn("bin", F.floor(F.col("bin") / round(window_s / base_s)))
    return own.groupBy("src_ip", "bin").agg(
        F.count_distinct("dst_ip").alias(f"fan_dst_ip{suffix}"),
        F.count_distinct("dst_port").alias(f"fan_dst_port{suffix}"),
        F.count_distinct(F.substring_index("dst_ip", ".", 3)).alias(f"fan_dst_subnet{suffix}"),
        F.sum("n_syn").alias(f"fan_syn{suffix}"),
        F.sum("n_pkts").alias(f"fan_pkts{suffix}"),
    )


def flow_features(flowed: DataFrame, windows: Mapping[str, float] | None = None, packets: DataFrame | None = None) -> DataFrame:
    """One row per flow with the 73 window features of ``FLOW_FEATURES`` (all double), label, endpoints and start.

    One aggregation by flow - flows are bounded by the chunk size - after the
    inter-arrival windows, whose partitioning it shares; the two fan-out tables join
    by source and window and are small next to the packets. They are counted over
    ``packets`` (the input of ``assign_flows``) if given, which spares them the segmentation, and from one table of
    distinct targets for all windows. With other ``windows`` the features of the missing ones are left out.
    """
    order = W.partitionBy("flow_id").orderBy("ts", "seq")
    side = W.partitionBy("flow_id", "is_fwd").orderBy("ts", "seq")
    rows = flowed.withColumn("_iat", F.col("ts") - F.lag("ts").over(order)).withColumn("_iat_side", F.col("ts") - F.lag("ts").over(side))
    fwd, bwd = F.col("is_fwd"), ~F.col("is_fwd")
    flag = {f: F.sum(((F.col("flags").bitwiseAND(m) > 0) & (F.col("proto") == TCP)).cast("double")) for f, m in FLAG_BITS.items()}
    lead = ("label", "proto", "src_port", "dst_port", "src_ip", "dst_ip")
    base = rows.groupBy("flow_id").agg(
        F.min(F.struct("ts", "seq", *lead)).alias("_first"),
        F.count(F.lit(1)).cast("double").alias("tot_pkts"),
        F.sum(fwd.cast("double")).alias("fwd_pkts"),
        F.sum(F.col("ip_len").cast("double")).alias("tot_bytes"),
        F.sum(F.when(fwd, F.col("ip_len")).otherwise(0).cast("double")).alias("fwd_bytes"),
        F.max("ts").alias("_end"),
        *[n.alias(f"n_{f}") for f, n in flag.items()],
        *_stats("ip_len", "plen"),
        *_stats("ip_len", "plen_fwd", fwd),
        *_stats("ip_len", "plen_bwd", bwd),
        *_stats("payload_len", "plen_pay"),
        *_stats("_iat", "iat", total=False),
        *_stats("_iat_side", "iat_fwd", fwd, total=False),
        *_stats("_iat_side", "iat_bwd", bwd, total=False),
    )
    base = base.select("*", F.col("_first.ts").alias("flow_start_ts"), *[F.col(f"_first.{x}").alias(x) for x in lead])
    base = base.drop("_first")
    c = F.col
    base = base.withColumns({"bwd_pkts": c("tot_pkts") - c("fwd_pkts"), "bwd_bytes": c("tot_bytes") - c("fwd_bytes"), "dur": c("_end") - c("flow_start_ts")})
    per_s = {f"{n}_per_s": ratio(c(v), c("dur"), 1e-6) for n, v in (("bytes", "tot_bytes"), ("pkts", "tot_pkts"), ("fwd_pkts", "fwd_pkts"), ("bwd_pkts", "bwd_pkts"))}
    base = base.withColumns(per_s).withColumns(
        {
            "down_up_ratio": ratio(c("bwd_pkts"), c("fwd_pkts")),
            "mean_pkt_size": ratio(c("tot_bytes"), c("tot_pkts")),
            "mean_ip_len_fwd_minus_bwd": c("plen_fwd_mean") - c("plen_bwd_mean"),
            **{f"r_{f}": ratio(c(f"n_{f}"), c("tot_pkts")) for f in FLAG_BITS},
        }
    )
    windows = windows or {"": 60.0, "_5s": 5.0}
    least = min(windows.values())
    shared = materialize(contacts(packets if packets is not None else flowed, least), "flow-contacts") if len(windows) > 1 and all(s % least == 0 for s in windows.values()) else None
    for suffix, seconds in windows.items():
        fan = fan_out(packets if packets is not None else flowed, seconds, suffix, shared, least)
        names = [x for x in fan.columns if x not in ("src_ip", "bin")]
        base = base.withColumn("bin", F.floor(c("flow_start_ts") / seconds)).join(fan, ["src_ip", "bin"], "left").drop("bin")
        base = base.withColumns({x: F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in names})
        base = base.withColumn(f"fan_rate_pkts{suffix or '_60s'}", c(f"fan_pkts{suffix}") / seconds)
    known = [x for x in FLOW_FEATURES if x in base.columns]
    return base.select("flow_id", "label", "src_ip", "dst_ip", "flow_start_ts", *[c(x).cast("double").alias(x) for x in known])


def flow_rules() -> list[tuple[str, str, Column]]:
    """(rule, technique, weight) of the eight behavioural rules; the weight is 0 where a rule does not fire.

    Fixed values: thresholds, scales and technique ids.
    """
    c = F.col
    tcp, icmp = c("proto") == TCP, c("proto") == ICMP

    def fires(*tests: Column) -> Column:
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def upto(name: str, scale: float) -> Column:
        return F.least(c(name) / scale, F.lit(1.0))

    scan = fires(tcp, c("fan_dst_port") >= 50, c("r_syn") >= 0.7, c("plen_pay_mean") <= 16)
    slow = fires(tcp, c("dur") >= 30, c("r_psh") >= 0.2, c("r_rst") <= 0.05, c("pkts_per_s") <= 5)
    rules = [
        ("syn_fanout", "T1046", scan, upto("fan_dst_port", 200) * 0.5 + c("r_syn") * 0.5),
        ("host_fanout", "T1018", c("fan_dst_ip") >= 50, upto("fan_dst_ip", 200)),
        ("icmp_flood", "T1498", fires(icmp, c("tot_pkts") >= 50, c("pkts_per_s") >= 100), upto("pkts_per_s", 1000)),
        ("icmp_pingsweep", "T1018", fires(icmp, c("fan_dst_ip") >= 20), upto("fan_dst_ip", 100)),
        ("syn_flood", "T1498", fires(tcp, c("r_syn") >= 0.9, c("pkts_per_s") >= 200), upto("pkts_per_s", 1000)),
        ("rst_burst", "T1499", fires(tcp, c("r_rst") >= 0.3, c("tot_pkts") >= 20), upto("r_rst", 1)),
        ("slowloris", "T1499", slow, F.lit(0.6)),
        ("exfil_asymmetric", "T1041", fires(tcp, c("fwd_bytes") >= 1e6, c("bwd_bytes") <= 1e5), upto("fwd_bytes", 1e7)),
    ]
    return [(name, technique, F.when(test, weight).otherwise(0.0)) for name, technique, test, weight in rules]


def flow_consensus(features: DataFrame) -> DataFrame:
    """Per flow and technique the summed rule weight, at most 1; flows for which no rule fires have no row."""
    hits = F.array(*[F.struct(F.lit(t).alias("technique"), w.alias("weight")) for _, t, w in flow_rules()])
    fired = features.select("flow_id", F.explode(F.filter(hits, lambda h: h["weight"] > 0)).alias("h"))
    return fired.groupBy("flow_id", F.col("h.technique").alias("technique")).agg(F.least(F.lit(1.0), F.sum("h.weight")).alias("weight"))
