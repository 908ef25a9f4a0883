import random

import pytest
from pyspark.sql import functions as F

from skeinflow.llm import problem1
from skeinflow.llm.components import record_groups, smallest_in_component
from skeinflow.llm.group_splits import _Item, assign_splits, even_out, plan

STATES = "state_id long, src_host string, dst_host string, fid string, dst_port int, packet_count long, label string, start_ms long, end_ms long"


def components(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "shuffled_chain"])
def test_components(spark, shape):
    rnd = random.Random(7)
    names = [f"n{i:03d}" for i in range(120)]
    if shape == "random":
        edges = [(rnd.choice(names), rnd.choice(names)) for _ in range(70)]
    elif shape == "star":
        edges = [("n060", n) for n in names]
    else:
        order = names if shape == "chain" else rnd.sample(names, len(names))
        edges = list(zip(order, order[1:], strict=False))
    df = spark.createDataFrame(edges + [(None, "n001"), ("n002", None)], "a string, b string")
    got = {r["node"]: r["label"] for r in smallest_in_component(df).collect()}
    root = components(edges)
    least = {}
    for n, r in root.items():
        least[r] = min(least.get(r, n), n)
    assert got == {n: least[r] for n, r in root.items()}


def test_components_of_nothing(spark):
    assert smallest_in_component(spark.createDataFrame([], "a string, b string")).count() == 0


def rows(seed, n=300):
    rnd = random.Random(seed)
    hosts = [f"10.0.0.{i}" for i in range(60)] + [None] * 8
    flows = [f"f{i}" for i in range(250)] + [None] * 20
    return [(i, rnd.choice(hosts), rnd.choice(hosts), rnd.choice(flows), 1, 1, rnd.choice(["x", "y", None]), 0, 0) for i in range(n)]


@pytest.mark.parametrize(("seed", "n"), [(1, 12), (2, 25), (3, 300)])
def test_record_groups(spark, seed, n):
    data = rows(seed, n)
    links = [(("row", r[0]), k) for r in data for k in (r[1] and ("host", r[1]), r[2] and ("host", r[2]), r[3] and ("flow", r[3])) if k]
    root = components(links + [(("row", r[0]), ("row", r[0])) for r in data])
    least = {}
    for (kind, name), r in root.items():
        if kind == "host":
            least[r] = min(least.get(r, name), name)
    got = record_groups(spark.createDataFrame(data, STATES)).collect()
    assert {r["state_id"]: r["group_host"] for r in got} == {r[0]: least.get(root["row", r[0]]) for r in data}
    by_key = {}
    for r in got:
        by_key.setdefault(r["group_key"], set()).add(root["row", r["state_id"]])
    assert all(len(x) == 1 for x in by_key.values()) and len(by_key) == len({root["row", r[0]] for r in data})


def test_repeated_rows_and_null_rows(spark):
    data = [(1, None, None, None, None, None, None, None, None), (2, None, None, "f", None, None, None, None, None), (3, None, None, "f", None, None, None, None, None), (1, None, None, None, None, None, None, None, None)]
    got = [(r["state_id"], r["group_host"], r["group_key"]) for r in record_groups(spark.createDataFrame(data, STATES)).collect()]
    assert sorted(got) == [(1, None, "row:1"), (1, None, "row:1"), (2, None, "flow:f"), (3, None, "flow:f")]
    assert record_groups(spark.createDataFrame([], STATES)).count() == 0


def test_plan_serves_the_rarest_label_first():
    items = [_Item(1, [10, 0], "big"), _Item(2, [0, 2], "rare1"), _Item(2, [0, 2], "rare2"), _Item(1, [100, 0])]
    shares = plan(items, [0.5, 0.5])
    assert {shares[1].index(1.0), shares[2].index(1.0)} == {0, 1}
    assert all(abs(sum(s) - 1) < 1e-9 for s in shares)
    assert plan([], [1.0]) == []


def test_splits_keep_groups_and_proportions(spark):
    rnd = random.Random(4)
    data = [(i, f"10.1.{i % 900 // 3}.{i % 900 % 3}", None, None, 1, 1, rnd.choice(["a"] * 8 + ["b", "c", None, "other label"]), 0, 0) for i in range(3000)]
    groups = record_groups(spark.createDataFrame(data, STATES))
    for heavy in (10, 2000):
        out = assign_splits(groups, ["a", "b", "c"], [("train", 0.8), ("val", 0.1), ("test", 0.1)], heavy_parts=heavy).collect()
        assert len(out) == 900 and len({r["group_key"] for r in out}) == 900
        n = {}
        for r in out:
            n[r["split_name"]] = n.get(r["split_name"], 0) + r["n_records"]
        assert abs(n["train"] - 2400) < 60 and abs(n["val"] - 300) < 60 and abs(n["test"] - 300) < 60
    assert assign_splits(groups.limit(0), ["a"], [("train", 1.0)]).count() == 0
    with pytest.raises(ValueError):
        assign_splits(groups, ["a"], [("train", 0.0)])


def test_splits_of_the_table_meet_their_proportions(spark):
    d = "/root/testdata/sf0.01"
    got = {r["split_name"]: r["n"] for r in problem1.p1_splits(spark, d).groupBy("split_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {r["split_name"]: r["proportion"] for r in spark.read.parquet(f"{d}/split_plan.parquet").collect()}
    whole = sum(got.values())
    assert set(got) == set(wanted) and all(abs(got[s] / whole - p) <= 0.02 * p for s, p in wanted.items())
    r = problem1.p1_check(spark, d).first()
    assert (r["n_records"], r["n_without_split"], r["n_groups_in_two_splits"]) == (whole, 0, 0)


def test_heavy_groups_are_evened_out():
    items = [_Item(1, [n, m], f"g{i}") for i, (n, m) in enumerate([(50, 0), (30, 5), (20, 5), (9, 1), (8, 0), (7, 1), (5, 0), (4, 2)])]
    before = plan(items, [0.8, 0.1, 0.1])
    after = even_out(items, [list(s) for s in before], [0.8, 0.1, 0.1])

    def off(shares):
        return sum(abs(sum(s[k] * sum(i.counts) for s, i in zip(shares, items, strict=True)) - p * 147) for k, p in enumerate([0.8, 0.1, 0.1]))

    assert off(after) <= off(before) and all(sorted(s) == [0.0, 0.0, 1.0] for s in after)
    assert even_out([], [], [1.0]) == []


def test_queries_keep_every_row(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/flow_state.parquet").count()
    assert problem1.p1_found(spark, d).count() == n and problem1.p1_splits(spark, d).count() == n
