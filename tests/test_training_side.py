import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.operators import augmentation as A
from skeinflow.operators import losses

EDGES = "src string, dst string, n long"


def links(spark, n=40):
    return spark.createDataFrame([(f"h{i % 9}", f"h{i}", i) for i in range(n)], EDGES)


def test_added_and_perturbed_edges(spark):
    e = links(spark)
    nodes = e.select(F.col("src").alias("node")).unionAll(e.select("dst")).distinct()
    more = A.add_edges(e, nodes, "n", "s", 0.25)
    assert more.count() == 50 and sorted(r["n"] for r in more.collect()).count(19.5) == 10
    assert sorted(map(tuple, more.collect())) == sorted(map(tuple, A.add_edges(e.repartition(5), nodes, "n", "s", 0.25).collect()))
    known = {r["node"] for r in nodes.collect()}
    assert all(r["src"] in known and r["dst"] in known for r in more.collect())
    assert 36 <= A.perturb_edges(e, nodes, "n", "s", 0.25).count() <= 40
    assert A.add_edges(e.limit(0), nodes, "n", "s", 0.5).count() == 0 and A.perturb_edges(e.limit(0), nodes, "n", "s", 0.5).count() == 0


def test_turned_edges_keep_their_attributes(spark):
    e = links(spark)
    before = {r["n"]: (r["src"], r["dst"]) for r in e.collect()}
    after = {r["n"]: (r["src"], r["dst"]) for r in A.turn_edges(e, "s", 0.3).collect()}
    turned = [k for k in after if after[k] != before[k]]
    assert len(after) == 40 and all(after[k] == before[k][::-1] for k in turned) and 10 <= len(turned) <= 12


def test_features_move_within_a_label(spark):
    rows = [(i, "ab"[i % 2], float(i)) for i in range(20)] + [(90, "solo", 90.0), (91, None, 91.0), (92, "a", None)]
    df = spark.createDataFrame(rows, "k long, y string, x double")
    got = {r["k"]: (r["y"], r["x"]) for r in A.swap_features(df, "k", "y", "x", "s", 0.5).collect()}
    assert len(got) == len(rows) and got[90] == ("solo", 90.0) and got[91] == (None, 91.0)
    for y in "ab":
        assert sorted(str(x) for _, g, x in rows if g == y) == sorted(str(x) for g, x in got.values() if g == y)
    assert any(got[k] != (y, x) for k, y, x in rows)


def test_buffer_nodes_only_for_few_under_pressure(spark):
    e = spark.createDataFrame([(f"m{i}", "t", 1) for i in range(4)] + [("r", "t", 1), ("r", "u", 1)], EDGES)
    got = {(r["src"], r["dst"]): r["dst_node"] for r in A.buffer_nodes(e, spark.createDataFrame([("r",)], "src string"), 3).collect()}
    assert got[("r", "t")] == "t#r" and got[("r", "u")] == "u" and got[("m0", "t")] == "t" and len(got) == 6


def test_soft_loss_of_one_hot_is_the_focal_loss(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.5], [0.0, 1.0, 0.0])], "l array<double>, t array<double>")
    p = math.exp(2) / (math.exp(1) + math.exp(2) + math.exp(0.5))
    loss = losses.soft_target_loss
    r = df.select(loss(F.col("l"), F.col("t")).alias("a"), loss(F.col("l"), F.col("t"), [1, 3, 1], 2.0).alias("b"), loss(F.col("l"), F.col("t"), smoothing=1.0).alias("c"), losses.norm_scaled(F.col("l"), [1, 4, 1], 0.5).alias("d")).first()
    assert r["a"] == pytest.approx(-math.log(p)) and r["b"] == pytest.approx(-3 * (1 - p) ** 2 * math.log(p)) and r["d"] == [1.0, 1.0, 0.5]
    assert r["c"] == pytest.approx(math.log(math.exp(1) + math.exp(2) + math.exp(0.5)) - 3.5 / 3)
    assert losses.deferred_weights({"a": 2.0}, 7, 10, 0.8) is None and losses.deferred_weights({"a": 2.0}, 8, 10, 0.8) == {"a": 2.0}


def test_contrastive_loss(spark):
    rng = np.random.default_rng(1)
    p = {f"p{i}": rng.normal(size=4) for i in range(5)}
    rows = [(i, "x" if i % 2 else "y", rng.normal(size=4).tolist()) for i in range(6)] + [(7, "z", [1.0] * 4), (8, "x", None)]
    a = spark.createDataFrame(rows, "k long, y string, v array<double>")
    t = spark.createDataFrame([(n, v.tolist()) for n, v in p.items()], "name string, vector array<double>")
    own = spark.createDataFrame([("x", "p0"), ("x", "p1"), ("y", "p2"), ("z", None)], "y string, name string")
    got = {r["k"]: r["loss"] for r in losses.contrastive_loss(a, "k", "y", "v", t, own, 0.5).collect()}
    assert set(got) == set(range(6))
    for i, y, v in rows[:6]:
        s = {n: math.exp(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) / 0.5) for n, w in p.items()}
        assert got[i] == pytest.approx(-math.log(sum(s[n] for n in (("p0", "p1") if y == "x" else ("p2",))) / sum(s.values())))
    assert losses.contrastive_loss(a, "k", "y", "v", t, own, 0.5, negatives=2).count() == 6 and losses.contrastive_loss(a.limit(0), "k", "y", "v", t, own).count() == 0
    with pytest.raises(ValueError):
        losses.contrastive_loss(a, "k", "y", "v", t, own, most=4)
