import json
import os
import struct

from pyspark.sql import functions as F

from skeinflow.operators.sessions import sessionize
from skeinflow.sources import knowledge, stores
from skeinflow.sources.pcap import PcapSource, read_capture
from skeinflow.streaming.flow_stream import alert_sink, run_available, stream_fan_out
from skeinflow.streaming.session_stream import session_stream
from tests.test_problems_core import ACTIVITY, random_activity

T0 = 1_700_000_000


def ip(proto, src, dst, body):
    a, b = (bytes(map(int, x.split("."))) for x in (src, dst))
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, 0, 64, proto, 0, a, b) + body


def tcp(sport, dport, flags, data=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0) + data


def frames():
    """A name query with its answer, then a mail session of four packets."""
    return [
        ip(17, "192.0.2.9", "203.0.113.53", struct.pack(">HHHH", 52000, 53, 8 + 21, 0) + b"mail.example.org query"[:21]),
        ip(17, "203.0.113.53", "192.0.2.9", struct.pack(">HHHH", 53, 52000, 8 + 12, 0) + b"198.51.100.4"),
        ip(6, "192.0.2.9", "198.51.100.4", tcp(41000, 25, 0x02)),
        ip(6, "198.51.100.4", "192.0.2.9", tcp(25, 41000, 0x12, b"220 ready\r\n")),
        ip(6, "192.0.2.9", "198.51.100.4", tcp(41000, 25, 0x19, b"EHLO desk\r\n")),
        ip(1, "192.0.2.9", "203.0.113.77", struct.pack(">BBHHH", 8, 0, 0, 7, 1) + b"still there?"),
    ]


def classic(order="<", nanos=False, link=1):
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for i, f in enumerate(frames()):
        f = {1: bytes(12) + b"\x08\x00", 101: b"", 113: bytes(14) + b"\x08\x00"}[link] + f
        out += struct.pack(order + "IIII", T0, i * (1_000_000 if nanos else 1000), len(f), len(f)) + f
    return out


def next_generation():
    def block(kind, body):
        body += bytes(-len(body) % 4)
        n = 12 + len(body)
        return struct.pack("<II", kind, n) + body + struct.pack("<I", n)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 101, 0, 0))
    for i, f in enumerate(frames()):
        t = T0 * 1_000_000 + i * 1000
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def test_captures():
    for data in (classic(), classic(">"), classic("<", True), classic("<", False, 101), classic(">", False, 113), next_generation()):
        rows = list(read_capture(data, "X"))
        assert len(rows) == 6
        assert [r[6] for r in rows] == [1, 1, 0, 0, 0, 2] and [r[7] for r in rows] == [0, 0, 0x02, 0x12, 0x19, 0]
        assert rows[5][4:6] == (-1, -1) and rows[4][11] == b"EHLO desk\r\n" and rows[1][11] == b"198.51.100.4" and abs(rows[5][1] - T0 - 0.005) < 1e-5
    assert [r[6] for r in read_capture(classic()[:-3], "X")] == [1, 1, 0, 0, 0]  # the cut record is left out
    assert list(read_capture(b"nothing", "X")) == [] and list(read_capture(b"", "X")) == []
    assert len(list(read_capture(classic(), "X", most=2))) == 2


def test_pcap_source(spark, tmp_path):
    for label in ("benign", "scan"):
        os.makedirs(tmp_path / label)
        (tmp_path / label / "a.pcap").write_bytes(classic())
    spark.dataSource.register(PcapSource)
    df = spark.read.format("pcap").option("payloadBytes", "8").load(str(tmp_path))
    assert df.count() == 12 and df.select("seq").distinct().count() == 12
    assert {r["label"] for r in df.select("label").distinct().collect()} == {"benign", "scan"}
    assert df.agg(F.max(F.length("payload"))).first()[0] == 8


def test_knowledge(spark, tmp_path):
    def pattern(tid, text, **more):
        return {"type": "attack-pattern", "name": tid, "description": text, "external_references": [{"source_name": "capec", "external_id": "C"}, {"source_name": "mitre-attack", "external_id": tid}]} | more

    objects = [pattern("T1190", "`UNION SELECT` `information_schema`"), pattern("T1059", "<code>cmd.exe</code>"), pattern("T1", "x", revoked=True), {"type": "malware"}]
    (tmp_path / "stix.json").write_text(json.dumps({"objects": objects}))
    t = knowledge.techniques(spark, str(tmp_path / "stix.json"))
    assert {r["technique_id"] for r in t.collect()} == {"T1190", "T1059"}
    assert {tuple(r) for r in knowledge.literal_dictionary(t).collect()} == {("union select", "T1190"), ("information_schema", "T1190"), ("cmd.exe", "T1059")}
    (tmp_path / "map.csv").write_text("label,technique,weight\nSqli,T1190,0.5\nCmd,T1059,oops\nBenign,,0\nOdd,T9,1\n")
    m = knowledge.class_map(knowledge.read_csv(spark, str(tmp_path / "map.csv"), "label string, technique string, weight string"), t.select(F.col("technique_id").alias("technique")))
    assert {tuple(r) for r in m.select("label", "technique", "map_weight").collect()} == {("Sqli", "T1190", 0.5), ("Cmd", "T1059", 1.0)}


def test_stores(spark, tmp_path):
    p = str(tmp_path)
    edges = spark.createDataFrame([("contain", 0, 1), ("link", 1, 2)], "rel string, src long, dst long")
    stores.write_artifact(f"{p}/g", {"flow": spark.range(2)}, edges, {"name": "x"})
    nodes, back, meta = stores.read_artifact(spark, f"{p}/g", ["flow"])
    assert nodes["flow"].count() == 2 and back.where("rel = 'link'").count() == 1 and meta["name"] == "x"
    log = spark.createDataFrame([(f"2024-02-01 0{h}:10:00", h) for h in range(5)], "t string, v int").select(F.to_timestamp("t").alias("ts"), "v")
    stores.append_log(log, f"{p}/log")
    stores.append_log(log, f"{p}/log")
    assert len(stores.shards(spark, f"{p}/log")) == 5
    assert stores.read_log(spark, f"{p}/log", "v int", since="20240201T03Z").count() == 4
    assert stores.retain(spark, f"{p}/log", oldest="20240201T02Z") == ["20240201T00Z", "20240201T01Z"]
    assert stores.retain(spark, f"{p}/log", quota_bytes=0) == ["20240201T02Z", "20240201T03Z"]
    assert [s for s, _ in stores.shards(spark, f"{p}/log")] == ["20240201T04Z"]
    s = spark.createDataFrame([("random", "train", "f1"), ("temporal", "test", "f1")], "protocol string, split string, flow_id string")
    stores.write_splits(f"{p}/s", s)
    assert [tuple(r) for r in stores.read_splits(spark, f"{p}/s", "temporal").collect()] == [("test", "f1")]


def test_upsert_and_pending(spark):
    a = spark.createDataFrame([(1, 5, "old"), (2, 9, "keep")], "k long, v long, x string")
    b = spark.createDataFrame([(1, 5, "new"), (2, 3, "late"), (3, 1, "fresh")], "k long, v long, x string")
    assert {r["k"]: r["x"] for r in stores.upsert(a, b, "k", "v").collect()} == {1: "new", 2: "keep", 3: "fresh"}
    assert [r["k"] for r in stores.pending(b, a, "k").collect()] == [3]


def test_session_stream_equals_batch(spark, tmp_path):
    rows = [r for r in random_activity(3) if r[0] is not None and r[1] is not None]
    rows.sort(key=lambda r: r[1])
    half = len(rows) // 2
    rows.append(("end", 10**12, 10**12, 1, 0))  # moves the watermark past every other session
    for i, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, ACTIVITY).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ACTIVITY).parquet(str(tmp_path / "in"))
        run_available(session_stream(stream, delay="0 seconds"), str(tmp_path / "out"), str(tmp_path / "check"))
        assert i in (0, 1)
    cols = ["src_host", "start_ms", "end_ms", "flow_records", "packets"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*cols).collect())
    want = sorted(tuple(r) for r in sessionize(spark.createDataFrame(rows, ACTIVITY)).select(*cols).where("src_host <> 'end'").collect())
    assert got == want


def test_stream_fan_out_and_alerts(spark, tmp_path):
    rows = [(f"2024-02-01 00:00:{s:02d}", "a", f"t{s % 3}", 2) for s in range(0, 50, 5)] + [("2024-02-01 02:00:00", "a", "t9", 0)]
    df = spark.createDataFrame(rows, "t string, src_ip string, dst_ip string, flags int").select(F.to_timestamp("t").alias("at"), "src_ip", "dst_ip", "flags")
    df.write.parquet(str(tmp_path / "in"))
    run_available(stream_fan_out(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "60 seconds", "0 seconds"), str(tmp_path / "out"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["n_packets"], r["n_syn"], r["n_targets"]) for r in got] == [(10, 10, 3)]
    sink = alert_sink(str(tmp_path / "alerts"), 0.5)
    batch = spark.createDataFrame([(1, 0.9), (2, 0.1)], "id long, score double")
    sink(batch, 0)
    sink(batch, 0)
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 1
