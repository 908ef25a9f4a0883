import json
import math

import pytest
from pyspark.sql import functions as F

from skeinflow import session
from skeinflow.operators import evidence, labels, reports, windows
from skeinflow.sources import pcap, stores
from skeinflow.streaming.flow_stream import run_available, stream_fan_out
from skeinflow.streaming.hot_buffer import hot_flows


def test_claims_keep_citations_with_their_sentence(spark):
    text = "A flow was seen. [E_ALERT] It shows two ports!  Then it  stopped? [E_FLOW_001]\nEnd"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    got = [r["c"] for r in df.select(reports.claims("t").alias("c")).collect()]
    assert got == [["A flow was seen. [E_ALERT] It shows two ports!", "Then it  stopped? [E_FLOW_001]\nEnd"], [], None]
    assert df.select(reports.claims("t", True).alias("c")).first()["c"] == ["A flow was seen. [E_ALERT]", "It shows two ports!", "Then it  stopped? [E_FLOW_001]", "End"]


def validated(spark, text, techniques=False):
    row = (1, text, ["10.0.0.1", "flow_a", "443"], ["E_ALERT"], [0.88, 443.0], techniques)
    df = spark.createDataFrame([row], "k long, t string, e array<string>, i array<string>, n array<double>, m boolean")
    return reports.validate(df, "k", "t", "e", "i", "n", "m").first()


def test_validation(spark):
    r = validated(spark, "Host 10.0.0.1 shows a probability of 88 % on port 443. [E_ALERT]")
    assert (r["n_entailed"], r["n_numbers"], r["n_numbers_supported"], r["grounding_rate"], r["overall_pass"]) == (1, 2, 2, 1.0, True)
    assert validated(spark, "Host 10.0.0.9 shows it. [E_ALERT]")["n_contradicted"] == 1
    assert validated(spark, "The confidence is 0.31. [E_ALERT]")["n_contradicted"] == 1
    r = validated(spark, "The host 10.0.0.1 indicates trouble. [E_PKT_001]")
    assert (r["n_unsupported"], r["grounding_rate"], r["overall_pass"]) == (1, 0.0, False)
    r = validated(spark, "This proves that it is a scan attack.")
    assert r["n_overclaims"] == 1 and not r["overall_pass"]
    assert not validated(spark, "Fine.", True)["caution_pass"] and validated(spark, "Statistical evidence only.", True)["overall_pass"]
    assert not validated(spark, "See how to bypass it.")["safety_pass"] and not validated(spark, "x " + "ab" * 40)["safety_pass"]
    r = validated(spark, None)
    assert r["overall_pass"] and r["n_entailed"] == 0


def test_repair_leaves_only_what_holds(spark):
    text = "Host 10.0.0.1 shows a scan. [E_ALERT] Host 10.0.0.9 shows more. [E_ALERT] The confidence is 0.31. It was noon."
    df = spark.createDataFrame([(text, ["10.0.0.1"], ["E_ALERT"], [0.88])], "t string, e array<string>, i array<string>, n array<double>")
    for needs, want in ((False, "It was noon."), (True, "It was noon. Technique links are statistical evidence.")):
        got = df.select(reports.repaired("t", F.col("e"), F.col("i"), F.col("n"), F.lit(needs)).alias("r")).first()["r"]
        assert got == want  # the first two sentences are one claim, as no cut follows a citation


def test_json_leaves_out_what_json_cannot_hold(spark):
    df = spark.createDataFrame([(1, math.nan, "a"), (2, 2.5, None), (3, math.inf, "b")], "k long, v double, s string")
    text = reports.json_safe([("k", F.col("k")), ("v", F.col("v")), ("s", F.col("s"))], ("v",))
    assert [json.loads(r["j"]) for r in df.select(text.alias("j")).collect()] == [{"k": 1, "s": "a"}, {"k": 2, "v": 2.5}, {"k": 3, "s": "b"}]
    assert [r["n"] for r in spark.createDataFrame([("",), ("x" * 9,)], "t string").select(reports.token_estimate(F.col("t")).alias("n")).collect()] == [1, 2]


def test_bundles_nest_paths_drops_and_attention(spark):
    rows = [(i, float(i), "f", "a", "b", "x", 100, p, True) for i, p in enumerate([3, 0, 9, 1])]
    flowed = spark.createDataFrame(rows, "seq long, ts double, flow_id string, src_ip string, dst_ip string, label string, ip_len int, payload_len int, is_fwd boolean")
    b = reports.bundles(flowed, spark.createDataFrame([], "flow_id string, technique string, weight double"), top=3).first()
    assert [p["seq"] for p in b["packets"]] == [2, 0, 3] and [(x["src"], x["dst"], x["dt"]) for x in b["paths"]] == [(2, 3, 1.0)]
    assert b["packets"][0]["drop"] == pytest.approx(13 / 4 - 4 / 3) and b["packets"][0]["attention"] == pytest.approx(10 / 17) and b["techniques"] == []


def test_quantiles_and_anchors(spark):
    values = [0.0, 1.0, 1.0, 2.5, 7.0, 100.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 3.0), ("b", None)], "k string, v double")
    got = {(r["k"], r["prob"]): r["value"] for r in labels.quantiles(df, ["k"], "v", (0.0, 0.5, 0.9, 1.0)).collect()}
    assert got == {("a", 0.0): 0.0, ("a", 0.5): 1.75, ("a", 0.9): 53.5, ("a", 1.0): 100.0, **{("b", p): 3.0 for p in (0.0, 0.5, 0.9, 1.0)}}
    packets = spark.createDataFrame([("f", 1), ("f", 2), ("g", 3)], "flow string, p long")
    edges = spark.createDataFrame([(1, 0.5), (1, 0.7)], "p long, w double")
    out = {r["flow"]: (r["n_ev"], r["frac_ev"], r["sum_w"], r["max_w"]) for r in labels.anchor_statistics(edges, packets, "flow", "p", "w").collect()}
    assert out == {"f": (1.0, 0.5, pytest.approx(1.2), 0.7), "g": (0.0, 0.0, 0.0, 0.0)}


def test_requests_and_families(spark):
    rows = [(1, b"GET /a HTTP/1.1\r\nHost:  x.org \r\n\r\nBody"), (2, b"SSH-2.0"), (3, None), (4, b"POST /" + b"b" * 300)]
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows], "k long, p binary")
    got = {r["k"]: (r["line"], r["host"], r["body"][-4:]) for r in labels.collect_requests(df, "p").collect()}
    assert got[1] == ("GET /a HTTP/1.1", "x.org", "body") and len(got[4][0]) == 120 and set(got) == {1, 4}
    m = spark.createDataFrame([("c", "recon", 0.4), ("c", "flood", 0.3), ("c", "flood", 0.2), ("d", "recon", 1.0), ("d", "flood", 1.0), ("e", None, 1.0)], "label string, family string, map_weight double")
    assert {(r["label"], r["family"]) for r in evidence.dominant_family(m).collect()} == {("c", "flood"), ("d", "flood")}


def test_rolling_flow_features_in_blocks(spark):
    cols = ["n_syn", "n_ack", "n_fin", "n_rst", "n_psh"]
    rows = [(f"f{i:03d}", float(i), "a" if i % 3 else "b", "t", float(80 + i % 2), float(i % 2), 0.5 * i, 1.0, 2.0, *[float(i % 4)] * 5) for i in range(60)]
    df = spark.createDataFrame(rows, "flow_id string, flow_start_ts double, src_ip string, dst_ip string, dst_port double, proto double, dur double, fwd_pkts double, tot_pkts double, " + ", ".join(f"{c} double" for c in cols))
    whole = sorted(map(tuple, windows.rolling_flow_features(df, rows=7, block=None).collect()))
    assert whole == sorted(map(tuple, windows.rolling_flow_features(df, rows=7, block=10).collect())) and len(whole[0]) == 29
    last = dict(zip(windows.rolling_flow_features(df, rows=7).columns, whole[-1], strict=True))
    assert last["packets_dst"] == 7.0 and last["syn_packets_dst"] == sum(i % 4 for i in range(53, 60)) and last["ports_pair"] == 2.0


def test_capture_writer_refuses_what_does_not_fit(spark):
    row = {"seq": 1, "ts": 1.5, "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "src_port": 1, "dst_port": 2, "proto": 0, "flags": 2, "payload_len": 3, "payload": None, "label": "x"}
    assert pcap.packet(pcap.frame(row), 1.5, 1, "x", 9)[4:] == (1, 2, 0, 2, 43, 3, "x", bytes(3))
    assert pcap.frame(row | {"src_port": -1}) is None and pcap.frame(row | {"proto": 3}) is None and pcap.frame(row | {"payload_len": 65530}) is None
    assert pcap.packet(pcap.frame(row | {"proto": 2, "payload": b"hi"}), 0.0, 1, "x", 9)[11] == b"hi"


def test_log_shards_are_sealed_by_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2024-02-01 00:{i:02d}:00") for i in range(25)], "k long, t string").select("k", F.to_timestamp("t").alias("ts"))
    stores.append_log(df, str(tmp_path / "log"), most_rows=10, key="k")
    got = {r["shard"]: (r["n"], r["a"]) for r in stores.read_log(spark, str(tmp_path / "log"), "k long").groupBy("shard").agg(F.count("k").alias("n"), F.min("k").alias("a")).collect()}
    assert got == {"20240201T00Z": (10, 0), "20240201T00Z-0001": (10, 10), "20240201T00Z-0002": (5, 20)}


def test_hot_buffer_keeps_the_newest_within_its_time(spark, tmp_path):
    schema = "flow_id string, at_ms long, seq long, size long"
    parts = [[("a", t * 1000, t, 10) for t in range(1, 51)], [("a", 120_000, 200, 1), ("b", 130_000, 201, 1), (None, 1, 202, 1), ("b", None, 203, 1)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_available(hot_flows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 60_000, 8), str(tmp_path / "out"), str(tmp_path / "c"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert ("a", 8, 80, 43_000, 50_000, 42) in got and ("b", 1, 1, 130_000, 130_000, 0) in got
    assert [r for r in got if r[0] == "a" and r[4] == 120_000][0][1:3] == (1, 1)


def test_hot_buffer_works_on_many_flows_at_once(spark, tmp_path):
    schema = "flow_id string, at_ms long, seq long, size long"
    spark.range(6000).selectExpr("concat('f', id % 2000) as flow_id", "1000 + id as at_ms", "id as seq", "id as size").coalesce(1).write.parquet(str(tmp_path / "in"))
    run_available(hot_flows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 60_000, 2), str(tmp_path / "out"), str(tmp_path / "c"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((f"f{i}", 2, 6000 + 2 * i, 3000 + i, 5000 + i, 1) for i in range(2000))
    assert 0 < spark.read.format("statestore").load(str(tmp_path / "c")).count() <= 1024


def test_hot_buffer_flows_of_a_bucket_keep_their_own_timers(spark, tmp_path):
    schema = "flow_id string, at_ms long, seq long, size long"
    first = [("a", t * 1000, t, 10) for t in range(1, 501)] + [("b", 497_000, 501, 1), ("c", 499_000, None, 100), ("c", 499_000, 5, 7), ("c", 499_000, 6, None)]
    got = []
    for k, part in enumerate([first, [("d", 530_000, 600, 1), ("b", 530_000, 601, 2)], [("d", 565_000, 700, 1)], [("a", 566_000, 800, 3), ("b", 566_000, 801, 4)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_available(hot_flows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 60_000, 2, buckets=1, block=50), str(tmp_path / "out"), str(tmp_path / "c"))
        rows = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        got.append(sorted(rows - {r for x in got for r in x}))
    assert got[0] == [("a", 2, 20, 499_000, 500_000, 498), ("b", 1, 1, 497_000, 497_000, 0), ("c", 2, 7, 499_000, 499_000, 1)]
    assert got[1] == [("b", 2, 3, 497_000, 530_000, 0), ("d", 1, 1, 530_000, 530_000, 0)] and got[2] == [("d", 2, 2, 530_000, 565_000, 0)]
    assert got[3] == [("a", 1, 3, 566_000, 566_000, 0), ("b", 2, 6, 530_000, 566_000, 1)]  # a's timer took all of it, b's only what had expired


def test_stream_fan_out_is_exact_by_default(spark, tmp_path):
    rows = [(f"2024-02-01 00:00:{i % 60:02d}", "a", f"t{i % 37}", 2 if i % 2 else 0) for i in range(200)] + [("2024-02-01 03:00:00", "a", "t", 0)]
    df = spark.createDataFrame(rows, "t string, src_ip string, dst_ip string, flags int").select(F.to_timestamp("t").alias("at"), "src_ip", "dst_ip", "flags")
    df.write.parquet(str(tmp_path / "in"))
    run_available(stream_fan_out(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "60 seconds", "0 seconds"), str(tmp_path / "out"), str(tmp_path / "c"))
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert (r["n_packets"], r["n_syn"], r["n_targets"]) == (200, 100, 37)


class _Conf:
    def get(self, *a):
        return None


class _Context:
    master = "spark://head:7077"

    def getConf(self):
        return _Conf()

    def getCheckpointDir(self):
        return None


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        sparkContext, conf = _Context(), _Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Fake())
