import math

import numpy as np
import pandas as pd
import pytest

from skeinflow.llm.vector_overlap import CellBits, Winnower, node_pairs, overlap_report, record_coverage, split_overlaps, spread_join

NODES = "node_id long, source string, split string, flow_y int, node_features array<float>"


def brute(rows, most=3, tol=0.01):
    def clean(v):
        return [0.0 if x is None or math.isnan(x) else float(np.float32(x)) for x in v]

    used = [(i, s.strip().lower(), clean(v)) for i, _, s, _, v in rows if s is not None and v is not None]
    out = set()
    for i, s, a in used:
        for j, t, b in used:
            if s == "train" and t in ("val", "test"):
                differ = sum(not (x == y or abs(x - y) <= tol * max(abs(x), abs(y))) for x, y in zip(a, b, strict=False))
                if differ <= most:
                    out.add((min(i, j), max(i, j)))
    return out


def corpus(seed, n=60, dims=79):
    rng = np.random.default_rng(seed)
    rows, i = [], 0

    def add(split, v):
        nonlocal i
        i += 1
        rows.append((i, f"c{i % 3}", split, int(rng.integers(14)), None if v is None else [None if x is None else float(x) for x in v]))

    for _ in range(n):
        base = np.where(rng.random(dims) < 0.3, 0.0, rng.lognormal(0, 3, dims) * rng.choice([1, -1], dims, p=[0.9, 0.1]))
        add(rng.choice(["train", " Train", "TRAIN "]), base)
        for _ in range(3):
            v = base * (1 + rng.uniform(-0.0049, 0.0049, dims) * rng.integers(0, 2))
            at = rng.choice(dims, rng.integers(0, 6), replace=False)
            v[at] = v[at] * 3 + 1
            if len(at) and rng.random() < 0.3:
                v[rng.choice(at)] = np.nan
            add(rng.choice(["val", "Test", "test", "train"]), v[: 74 if rng.random() < 0.3 else dims])
        if rng.random() < 0.3:
            add("val", base)
    add("val", None), add("val", []), add(None, base), add("other", base), add("train", [0.0] * dims), add("val", [0.0] * dims), add("val", [None] * dims)
    add("val", [-0.0] * dims), add("train", [1.0, 2.0]), add("val", [1.0, 2.0]), add("train", [math.inf] + [1.0] * 78), add("test", [math.inf] + [1.0] * 78)
    return rows


@pytest.fixture(autouse=True)
def quiet():
    with np.errstate(all="ignore"):
        yield


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_found_pairs_equal_brute_force(spark, seed):
    rows = corpus(seed)
    members, pairs = split_overlaps(spark.createDataFrame(rows, NODES))
    got = [tuple(r) for r in node_pairs(members, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_short_vectors_have_their_own_pass(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        v = rng.lognormal(0, 2, 12)
        rows += [(2 * i, "s", "train", 1, v.tolist()), (2 * i + 1, "s", "val", 1, (v * 1.004).tolist() + [5.0] * (67 if i % 2 else 0))]
    members, pairs = split_overlaps(spark.createDataFrame(rows, NODES))
    assert {tuple(r) for r in node_pairs(members, pairs).collect()} == brute(rows)


def test_report_counts(spark):
    v = [float(i + 1) for i in range(79)]
    rows = [(1, "a", "train", 0, v), (2, "a", "train", 0, v), (3, "a", "val", 0, v), (4, "b", "test", 0, [x * 1.003 for x in v]), (5, "b", "test", 0, [x * 9 for x in v])]
    members, pairs = split_overlaps(spark.createDataFrame(rows, NODES))
    got = {(r["eval_split"], r["source"]): (r["n_nodes"], r["n_overlapping"], r["n_pairs"], r["n_exact_pairs"]) for r in overlap_report(members, pairs).collect()}
    assert got == {("val", "a"): (1, 1, 2, 2), ("test", "b"): (2, 1, 2, 0)}


def test_empty_table(spark):
    members, pairs = split_overlaps(spark.createDataFrame([], NODES))
    assert node_pairs(members, pairs).count() == 0 and overlap_report(members, pairs).count() == 0


def test_kept_grams_cover_every_window():
    rng = np.random.default_rng(1)
    w = Winnower(74)
    x = rng.lognormal(0, 2, (20, 74))
    r, c, _ = w.kept(x, np.ones((20, 74)))
    assert w.gram + w.window - 1 == 18
    for row in range(20):
        places = sorted(c[r == row])
        assert places[0] < w.window and max(np.diff(places), default=0) <= w.window


def test_minima_of_agreeing_vectors_are_selected():
    w = Winnower(74)
    rng = np.random.default_rng(2)
    x = np.where(rng.random((300, 74)) < 0.3, 0.0, rng.lognormal(0, 2, (300, 74)))
    y = x * (1 + rng.choice([-0.0099, 0.0099], x.shape))
    y = np.where(np.abs(x - y) <= 0.01 * np.maximum(x, y), y, x)
    cells = w.cells(x)[0]
    counted = pd.concat([pd.DataFrame({"place": p, "cell": c, "n": n}) for p in range(74) for c, n in [np.unique(cells[:, p], return_counts=True)]])
    table = CellBits(counted, 74)
    r, c, h = w.kept(x, table.of(cells))
    parts = list(w.asked(y, table))
    asked = {k for rr, cc, hh in parts for k in zip(rr.tolist(), cc.tolist(), hh.tolist(), strict=True)}
    assert all(k in asked for k in zip(r.tolist(), c.tolist(), h.tolist(), strict=True))
    assert len(asked) < 300 * 69  # fewer than one a gram: this side is winnowed too
    assert not any(len(a) for a, _, _ in w.asked(x * -7.0, table))


def test_hot_grams_are_spread(spark):
    kept = spark.createDataFrame([(i, 0, 7 if i < 50 else i) for i in range(80)], "train_class long, place int, gram long")
    asked = spark.createDataFrame([(100 + i, 0, g) for i, g in enumerate([7, 7, 60, 99])], "eval_class long, place int, gram long")
    got = sorted((r["eval_class"], r["train_class"]) for r in spread_join(asked, kept, ["place", "gram"], limit=5).collect())
    assert got == sorted([(e, t) for e in (100, 101) for t in range(50)] + [(102, 60)])


def test_short_and_empty_vectors_agree_with_every_vector(spark):
    rows = [(1, "a", "train", 0, [1.0, 2.0]), (2, "a", "val", 0, [9.0] * 79), (3, "a", "test", 0, []), (4, "a", "train", 0, [5.0] * 74), (5, "b", "val", None, [1.0, 2.0]), (6, "b", "val", 0, None)]
    members, pairs = split_overlaps(spark.createDataFrame(rows, NODES))
    assert {tuple(r) for r in node_pairs(members, pairs).collect()} == brute(rows) == {(1, 2), (1, 3), (3, 4), (1, 5), (4, 5)}


def test_coverage_of_records(spark):
    v = [float(i + 1) for i in range(79)]
    rows = [(1, "a", "train", 0, v), (2, "a", "train", 0, v[:74]), (3, "a", "val", 0, v[:2] + [0.5] + v[3:]), (4, "b", "test", 0, [x * 9 for x in v])]
    got = {r["node_id"]: (r["n_pairs"], r["n_exact_pairs"], r["coverage"]) for r in record_coverage(*split_overlaps(spark.createDataFrame(rows, NODES))).collect()}
    assert got == {3: (2, 0, 78 / 79), 4: (0, 0, 0.0)}
