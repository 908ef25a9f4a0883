import math
import random

import pytest
from pyspark.sql import functions as F

from skeinflow.operators import flows
from skeinflow.schemas import FLOW_FEATURES, FLOW_VECTOR

COLS = "seq long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, proto int, flags int, ip_len int, payload_len int, label string"
#: A mail client on 192.0.2.9: three packets with its server (two out, one back, 0.5 and 1.5 s apart), a name query and its answer, one ping.
DESK = [
    (1, 10.0, "192.0.2.9", "198.51.100.4", 41000, 25, 0, 0x02, 48, 0, "mail"),
    (2, 10.5, "198.51.100.4", "192.0.2.9", 25, 41000, 0, 0x12, 52, 4, "mail"),
    (3, 12.0, "192.0.2.9", "198.51.100.4", 41000, 25, 0, 0x19, 150, 98, "mail"),
    (4, 12.5, "192.0.2.9", "203.0.113.53", 52000, 53, 1, 0, 70, 42, "mail"),
    (5, 12.6, "203.0.113.53", "192.0.2.9", 53, 52000, 1, 0, 130, 102, "mail"),
    (6, 13.0, "192.0.2.9", "203.0.113.77", -1, -1, 2, 0, 84, 56, "mail"),
]


def test_vector_order():
    assert len(FLOW_FEATURES) == 73 and len(FLOW_VECTOR) == 79 and len(set(FLOW_VECTOR)) == 79


def test_desk_packets(spark):
    flowed = flows.assign_flows(spark.createDataFrame(DESK, COLS))
    mail = flowed.where("proto = 0").orderBy("seq").collect()
    assert [r["is_fwd"] for r in mail] == [True, False, True]
    assert {r["flow_id"] for r in mail} == {"mail|192.0.2.9:41000|198.51.100.4:25|0#1.0"}
    f = {int(r["proto"]): r for r in flows.flow_features(flowed).collect()}
    assert set(f) == {0, 1, 2}
    for name, value in {
        "tot_pkts": 3, "fwd_pkts": 2, "bwd_pkts": 1, "tot_bytes": 250, "fwd_bytes": 198, "bwd_bytes": 52, "dur": 2.0, "bytes_per_s": 125, "down_up_ratio": 0.5,
        "n_syn": 2, "n_ack": 2, "n_fin": 1, "n_psh": 1, "n_rst": 0, "r_fin": 1 / 3, "iat_mean": 1.0, "iat_min": 0.5, "iat_max": 1.5, "iat_fwd_mean": 2.0, "iat_bwd_mean": 0,
        "plen_pay_sum": 102, "plen_fwd_mean": 99, "fan_dst_ip": 3, "fan_dst_subnet": 2, "fan_pkts": 4,
    }.items():
        assert f[0][name] == pytest.approx(value), name
    assert f[2]["dst_port"] == -1 and f[1]["plen_bwd_max"] == 130 and f[1]["dur"] == pytest.approx(0.1)


def pings(n, label="ping_wave", step=0.002):
    return [(i, i * step, "a", "b", -1, -1, 2, 0, 84, 56, label) for i in range(n)]


def test_long_flow_is_cut_into_chunks(spark):
    df = spark.createDataFrame(pings(75), COLS)
    sizes = sorted(r["n"] for r in flows.assign_flows(df, max_packets=20).groupBy("flow_id").agg(F.count("*").alias("n")).collect())
    assert sizes == [15, 20, 20, 20]
    assert flows.assign_flows(df, max_packets=20, per_class={"ping_wave": 15}).select("flow_id").distinct().count() == 5
    assert flows.assign_flows(df, max_packets=20, per_class={"ping_wave": 0}).select("flow_id").distinct().count() == 4
    assert flows.assign_flows(df, max_packets=0).select("flow_id").distinct().count() == 1


def test_gap_is_strict(spark):
    rows = [(1, 0.0, "a", "b", 1, 2, 0, 0, 40, 0, "x"), (2, 30.0, "a", "b", 1, 2, 0, 0, 40, 0, "x"), (3, 60.5, "a", "b", 1, 2, 0, 0, 40, 0, "x")]
    got = {r["seq"]: r["segment"] for r in flows.assign_flows(spark.createDataFrame(rows, COLS)).collect()}
    assert got == {1: 1, 2: 1, 3: 2}


@pytest.mark.parametrize("bucket", [1.0, 7.0, 100.0, 1e9])
def test_buckets_do_not_change_the_result(spark, bucket):
    rnd = random.Random(5)
    ts, rows = 0.0, []
    for i in range(400):
        ts += rnd.choice([0.0, 0.1, 3.0, 29.0, 30.0, 31.0, 200.0])
        rows.append((i, ts, *rnd.choice([("a", "b"), ("b", "a")]), 1, 1, 0, 0, 40, 0, "x"))
    got = {r["seq"]: (r["segment"], r["chunk"]) for r in flows.assign_flows(spark.createDataFrame(rows, COLS), max_packets=5, bucket_s=bucket).collect()}
    segment, pos, last, want = 0, 0, -math.inf, {}
    for seq, t, *_ in rows:
        if t - last > 30.0:
            segment, pos = segment + 1, 0
        want[seq] = (segment, pos // 5)
        pos, last = pos + 1, t
    assert got == want


def test_rules_fire(spark):
    zero = dict.fromkeys(FLOW_FEATURES, 0.0)
    cases = {
        "scan": zero | {"proto": 0.0, "fan_dst_port": 100.0, "r_syn": 0.9, "plen_pay_mean": 4.0},
        "sweep": zero | {"proto": 2.0, "fan_dst_ip": 40.0},
        "benign": zero | {"proto": 1.0},
        "both": zero | {"proto": 2.0, "fan_dst_ip": 250.0},
    }
    df = spark.createDataFrame([(k, *[float(v[c]) for c in FLOW_FEATURES]) for k, v in cases.items()], "flow_id string, " + ", ".join(f"{c} double" for c in FLOW_FEATURES))
    got = {(r["flow_id"], r["technique"]): r["weight"] for r in flows.flow_consensus(df).collect()}
    assert got == {("scan", "T1046"): pytest.approx(0.7), ("sweep", "T1018"): pytest.approx(0.4), ("both", "T1018"): 1.0}


def test_key_parts(spark):
    df = spark.createDataFrame([("mail|192.0.2.9:41000|198.51.100.4:25|0#3.2",)], "flow_id string")
    parts = flows.key_parts()
    assert tuple(df.select(*parts.values()).first()) == ("mail", "192.0.2.9:41000|198.51.100.4:25|0")
