"""Fixed column orders and value codes shared by operators."""

from __future__ import annotations

from pyspark.sql import types as T

#: Transport codes of the packet table.
TCP, UDP, ICMP, OTHER = 0, 1, 2, 3
#: TCP flag bits, in the order the features use them.
FLAG_BITS = {"syn": 0x02, "ack": 0x10, "fin": 0x01, "rst": 0x04, "psh": 0x08, "urg": 0x20}

PACKETS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("proto", T.IntegerType()),
        T.StructField("flags", T.IntegerType()),
        T.StructField("ip_len", T.IntegerType()),
        T.StructField("payload_len", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)

_STATS = ("mean", "std", "min", "max", "sum")
_IAT = ("mean", "std", "min", "max")
_FAN = ("fan_dst_ip", "fan_dst_port", "fan_dst_subnet", "fan_syn", "fan_pkts")

#: The flow vector, 73 window features, the start time, and five evidence summaries, in order.
FLOW_FEATURES = (
    *("proto", "src_port", "dst_port"),
    *("tot_pkts", "fwd_pkts", "bwd_pkts", "tot_bytes", "fwd_bytes", "bwd_bytes"),
    *("dur", "bytes_per_s", "pkts_per_s", "fwd_pkts_per_s", "bwd_pkts_per_s", "down_up_ratio", "mean_pkt_size"),
    *(f"{p}_{s}" for p in ("plen", "plen_fwd", "plen_bwd", "plen_pay") for s in _STATS),
    *(f"{p}_{s}" for p in ("iat", "iat_fwd", "iat_bwd") for s in _IAT),
    *(f"{k}_{f}" for f in FLAG_BITS for k in ("n", "r")),
    *_FAN,
    "fan_rate_pkts_60s",
    *(f"{f}_5s" for f in _FAN),
    "fan_rate_pkts_5s",
    "mean_ip_len_fwd_minus_bwd",
)
#: The evidence summaries that end the vector, in order.
EVIDENCE_FEATURES = ("ev_count", "ev_max_weight", "ev_dominant_family_id", "ev_n_distinct_families", "ev_sum_log1p_weight")
FLOW_VECTOR = (*FLOW_FEATURES, "flow_start_ts", *EVIDENCE_FEATURES)
