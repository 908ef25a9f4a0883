import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.functions import tls
from skeinflow.operators import artifact, attention


def hello(name=b"example.org", alpn=(b"h2", b"http/1.1")):
    def ext(kind, body):
        return struct.pack(">HH", kind, len(body)) + body

    sni = struct.pack(">HBH", len(name) + 3, 0, len(name)) + name
    protocols = b"".join(bytes([len(p)]) + p for p in alpn)
    exts = ext(0x1A1A, b"") + ext(0, sni) + ext(10, struct.pack(">HHH", 4, 0x2A2A, 29)) + ext(11, b"\x01\x00") + ext(16, struct.pack(">H", len(protocols)) + protocols)
    body = b"\x03\x03" + bytes(32) + b"\x00" + struct.pack(">HHHH", 6, 0x0A0A, 4865, 4866) + b"\x01\x00" + struct.pack(">H", len(exts)) + exts
    shake = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(shake)) + shake


def test_client_hello(spark):
    raw = hello()
    rows = [(1, bytearray(raw)), (2, bytearray(raw[:60])), (3, bytearray(b"GET /")), (4, None), (5, bytearray(b""))]
    df = spark.createDataFrame(rows, "id long, p binary").select("id", tls.tls_client_hello("p").alias("h"), tls.tls_record_sizes("p").alias("r"))
    got = {r["id"]: r for r in df.collect()}
    assert got[1]["h"]["ja3"] == "771,4865-4866,0-10-11-16,29,0" and got[1]["h"]["sni"] == "example.org" and got[1]["h"]["alpn"] == ["h2", "http/1.1"]
    assert all(got[i]["h"]["ja3"] is None for i in (2, 3, 4, 5))
    assert got[1]["r"] == [len(raw) - 5] and got[3]["r"] == [] and got[4]["r"] is None


def test_typed_attention_matches_numpy(spark):
    rng = np.random.default_rng(3)
    xs = {"flow": rng.normal(size=(4, 3)), "host": rng.normal(size=(3, 2))}
    w = {"flow": {m: rng.normal(size=(5, 3)) for m in "qkv"}, "host": {m: rng.normal(size=(5, 2)) for m in "qkv"}}
    priors = {("flow", "to", "host"): 0.7, ("host", "of", "flow"): 1.2, ("flow", "near", "flow"): 1.0}
    edges = [("flow", "to", "host", 0, 0, 1.0), ("flow", "to", "host", 1, 0, 2.0), ("host", "of", "flow", 1, 2, 1.0), ("flow", "near", "flow", 0, 2, 0.5), ("flow", "near", "flow", 3, 2, 1.0)]
    nodes = {t: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, x array<double>") for t, x in xs.items()}
    got = attention.typed_attention(nodes, spark.createDataFrame(edges, "src_type string, rel string, dst_type string, src long, dst long, weight double"), w, priors)
    for t, x in xs.items():
        have = {r["node"]: r["h"] for r in got[t].collect()}
        for i in range(len(x)):
            mine = [e for e in edges if e[2] == t and e[4] == i]
            want = np.zeros(5)
            if mine:
                s = np.array([(w[t]["q"] @ x[i]) @ (w[e[0]]["k"] @ xs[e[0]][e[3]]) * priors[e[:3]] / np.sqrt(5) + np.log(e[5]) for e in mine])
                a = np.exp(s - s.max())
                want = sum(p * (w[e[0]]["v"] @ xs[e[0]][e[3]]) for p, e in zip(a / a.sum(), mine, strict=True))
            assert have[i] == pytest.approx(want.tolist())


def test_graph_of_a_small_capture(spark):
    cols = "seq long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, proto int, flags int, ip_len int, payload_len int, label string, payload binary"
    get = b"GET /?q=union select x from information_schema HTTP/1.1"
    rows = [(1, 0.0, "a", "b", 1, 80, 0, 2, 40, 0, "x", bytearray()), (2, 0.1, "a", "b", 1, 80, 0, 24, 99, len(get), "x", bytearray(get)), (3, 0.2, "b", "a", 80, 1, 0, 24, 99, 4, "x", bytearray(b"pong")), (4, 0.5, "a", "c", 2, 80, 0, 2, 40, 0, "x", bytearray())]
    pmi = spark.createDataFrame([("t:union", "T1190", "injection", 0.9), ("t:select", "T1190", "injection", 0.8)], "token string, technique string, family string, weight double")
    lit = spark.createDataFrame([("information_schema", "T1190")], "pattern string, technique string")
    tech = spark.createDataFrame([("T1190", "injection", "initial-access"), ("T1059", "command_exec", "execution"), ("T1059.004", "command_exec", "execution")], "technique string, family string, tactic string")
    g = artifact.build(spark.createDataFrame(rows, cols), pmi, lit, tech)
    n = {r["rel"]: r["n"] for r in g.edges.groupBy("rel").agg(F.count("*").alias("n")).collect()}
    assert n == {"contain": 2, "link": 1, "from_host": 2, "to_host": 2, "burst_neighbor": 2, "evidence_injection": 1, "has_subtechnique": 1, "belongs_to": 3}
    assert set(n) <= set(artifact.expected_relations())
    assert {r["ev_count"] for r in g.flow_vectors.collect()} == {0, 1} and g.nodes["packet"].count() == 2 and g.nodes["host"].count() == 3
