import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.operators import graph, ranking, splits, vectors, windows
from skeinflow.plans import graph_queries


def brute_burst(rows, radius, limit):
    out = set()
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0]))
    for i, a in enumerate(order):
        near = [b for b in order[i + 1 :] if b[1] <= a[1] + radius and ((a[2] is not None and a[2] == b[2]) or (a[3] is not None and a[3] == b[3]))][:limit]
        for b in near:
            shares = (a[2] is not None and a[2] == b[2], a[3] is not None and a[3] == b[3])
            out |= {(a[0], b[0], *shares), (b[0], a[0], *shares)}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_burst_neighbours(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([None, rnd.randrange(4000) / 8.0]), rnd.choice(["a", "b", "hot", "hot", None]), rnd.choice(["x", "y", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "flow_id long, ts double, src_ip string, dst_ip string")
    for radius, limit in ((1.0, 5), (10.0, 2)):
        got = {tuple(r) for r in graph.burst_neighbours(df, radius, limit).collect()}
        assert got == brute_burst(rows, radius, limit)


def test_burst_bound_is_inclusive(spark):
    rows = [(0, 0.0, "s", "a"), (1, 1.0, "s", "b"), (2, 5.0, "t", "c"), (3, 6.0, "u", "c")]
    got = {tuple(r) for r in graph.burst_neighbours(spark.createDataFrame(rows, "flow_id long, ts double, src_ip string, dst_ip string")).collect()}
    assert got == {(0, 1, True, False), (1, 0, True, False), (2, 3, False, True), (3, 2, False, True)}


def test_subtechniques(spark):
    df = spark.createDataFrame([("T1190",), ("T1059",), ("T1059.004",), ("T1059.007",), ("T9.1",), (None,)], "technique_id string")
    assert {tuple(r) for r in graph.subtechnique_edges(df).collect()} == {("T1059", "T1059.004"), ("T1059", "T1059.007")}


def test_consensus_without_neighbours_is_one(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    labels = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "node long, y string")
    probs = spark.createDataFrame([(0, "b", 0.875), (1, "a", 0.025)], "node long, class string, p double")
    assert {r["node"]: r["consensus"] for r in graph.neighbour_consensus(edges, labels, probs).collect()} == {0: 0.025, 1: 0.875, 2: 1.0}


def test_fan_out_cap(spark):
    edges = spark.createDataFrame([("h", i) for i in range(200)] + [("x", 1)], "src string, dst long")
    got = graph.fan_out_cap(edges, 3, "s").collect()
    assert len(got) == 4 and {tuple(r) for r in got} == {tuple(r) for r in graph.fan_out_cap(edges.repartition(5), 3, "s").collect()}


def test_k_hop(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in graph.k_hop(seeds, edges, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_edge_softmax_sums_to_one(spark):
    df = spark.createDataFrame([(1, 9, 0.5), (2, 9, 700.0), (3, 8, -3.0)], "src long, dst long, score double")
    sums = graph.edge_softmax(df).groupBy("dst").agg(F.sum("attention").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)


def test_ema(spark):
    df = spark.createDataFrame([("k", 1, 1.0), ("k", 2, 0.0), ("k", 3, 1.0)], "k string, t int, v double")
    assert [r["ema"] for r in graph.exponential_mean(df, "k", "t", "v").orderBy("t").collect()] == [pytest.approx(x) for x in (1.0, 0.9, 0.91)]


def test_split_sizes(spark):
    df = spark.createDataFrame([(2,), (3,), (4,), (10,), (25,)], "n long")
    a, b = splits.split_sizes(F.col("n"), 0.8, 0.1)
    assert [tuple(r) for r in df.select(a, b).collect()] == [(2, 0), (1, 1), (2, 1), (8, 1), (20, 2)]


def test_distributed_rank(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "a", "b", None]), rnd.randrange(50)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, v int")
    got = {r["id"]: (r["rank"], r["group_size"]) for r in ranking.distributed_rank(df, ["g"], ["v", "id"], F.floor(F.col("v") / 7)).collect()}
    for g in ("a", "b", None):
        mine = sorted((v, i) for i, k, v in rows if k == g)
        assert all(got[i] == (n + 1, len(mine)) for n, (_, i) in enumerate(mine))


def test_small_classes_are_repeated(spark):
    df = spark.createDataFrame([(i, "tiny" if i < 3 else "big") for i in range(500)], "id long, label string")
    n = {r["label"]: r["count"] for r in splits.stratified_subsample(df, "label", "id", "s", 120).groupBy("label").count().collect()}
    assert n == {"tiny": 30, "big": 120}


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 9 + [("b",)], "label string")
    w = {r["label"]: r["weight"] for r in splits.class_weights(df, "label").collect()}
    assert sum(w.values()) == pytest.approx(2.0) and w["b"] == pytest.approx(9 * w["a"])


def test_cosine_top_k(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(60)] + [(99, None)], "vec_id long, embedding array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -9)
    rows = df.repartition(7)
    for block in (100, 1 << 20):
        got = vectors.cosine_top_k(rows, df.where("vec_id % 5 = 0"), 3, block_bytes=block).orderBy("query", "rank").collect()
        assert [(r["query"], r["vec_id"]) for r in got] == [(q, int(i)) for q in range(0, 60, 5) for i in np.argsort(-sim[q])[:3]]


@pytest.mark.parametrize("block", [None, 40, 64])
def test_rolling_rows(spark, block):
    rnd = random.Random(8)
    rows = [(i, rnd.choice("aab"), rnd.randrange(500), rnd.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, t int, v int")
    m = {"s": ("sum", F.col("v")), "m": ("mean", F.col("v")), "d": ("distinct", F.col("v"))}
    got = {r["id"]: (r["s"], r["m"], r["d"]) for r in windows.rolling_rows(df, ["k"], ["t", "id"], m, rows=20, block=block).collect()}
    assert len(got) == 300
    for k in "ab":
        mine = sorted((t, i, v) for i, g, t, v in rows if g == k)
        for n, (_, i, _) in enumerate(mine):
            last = [v for _, _, v in mine[max(0, n - 19) : n + 1]]
            assert got[i] == (sum(last), pytest.approx(sum(last) / len(last)), len(set(last)))


def test_flow_bursts_hold_all_packets(spark):
    df = spark.createDataFrame([("a", float(i), 100 if i % 2 == 0 else -(i + 1)) for i in range(40)] + [("b", 0.0, 7)], "k string, t double, v long")
    seq = {r["k"]: r["sequence"] for r in windows.length_sequence(df, "k", ["t"], F.col("v")).collect()}
    got = {r["k"]: r for r in windows.burst_aggregates(df, "k", ["t"], F.col("v")).collect()}
    a, b = got["a"], got["b"]
    assert len(seq["a"]) == 32 and seq["a"][31] == -32 and seq["b"] == [7] + [0] * 31
    assert (a["n_packets"], a["fwd_count"], a["bwd_count"], a["fwd_sum"], a["bwd_sum"], a["bwd_max"]) == (40, 20, 20, 2000.0, 420.0, 40.0)
    assert (a["fwd_std"], a["gap_mean"], a["gap_std"], a["gap_max"], a["bwd_mean"]) == (0.0, 1.0, 0.0, 1.0, 21.0) and abs(a["bwd_std"] - 133**0.5) < 1e-9 and a["up_down"] == 2000 / 421
    assert (b["bwd_count"], b["bwd_mean"], b["bwd_std"], b["gap_mean"], b["fwd_std"]) == (0, 0.0, 0.0, 0.0, 0.0)


def test_flow_bursts_query(spark):
    small = "/root/testdata/sf0.001"
    rows = graph_queries.flow_bursts(spark, small).collect()
    assert rows and all(len(r["sequence"].split(",")) == 32 for r in rows) and sum(r["n_packets"] for r in rows) == graph_queries.flows.assign_flows(graph_queries.views.packets(spark, small)).count()
