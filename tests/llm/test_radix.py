import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from skeinflow.llm import radix, registry

PROBS = (0.01, 0.5, 0.9, 0.99, 1.0)


def values(seed):
    rnd = random.Random(seed)
    special = [0.0, -0.0, 1.0, 2.0, -1.5, 0.5, 1e300, -1e300, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 3.0, 1024.0, 1023.9999999999999]
    return special + [rnd.choice([rnd.lognormvariate(0, 4), -rnd.lognormvariate(0, 4), float(rnd.randrange(100)), 7.25]) for _ in range(800)]


def test_bits_keep_order_and_invert(spark):
    xs = values(1)
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", radix.ordered_bits(F.col("x")).alias("k")).withColumn("y", radix.from_bits(F.col("k")))
    for r in df.collect():
        bits = struct.unpack(">q", struct.pack(">d", abs(r["x"])))[0]
        assert r["k"] == (-bits if r["x"] < 0 else bits) and r["y"] == r["x"]


@pytest.mark.parametrize("seed", [1, 2])
def test_select_is_exact_and_states_are_bounded(spark, seed):
    xs = values(seed)
    rows = [(g, d, x) for i, x in enumerate(xs) for g, d in [(("a", "b", None)[i % 3], i % 4)]] + [("a", 0, None)]
    df = spark.createDataFrame(rows, "g string, d int, value double")
    exact = {(r["g"], r["prob"]): (r["n_values"], r["value"]) for r in radix.select(df, ["g"], PROBS).collect()}
    days = radix.state(df, ["g", "d"])
    merged = {(r["g"], r["prob"]): r["value"] for r in radix.read(radix.merge(days, ["g"]), ["g"], PROBS).collect()}
    refined = {(r["g"], r["prob"]): r["value"] for r in radix.select(df, ["g"], PROBS, first=radix.merge(days, ["g"])).collect()}
    for g in ("a", "b", None):
        mine = sorted(x for k, _, x in rows if k == g and x is not None)
        for p in PROBS:
            want = mine[max(1, math.ceil(p * len(mine))) - 1]
            assert exact[g, p] == (len(mine), want) and refined[g, p] == want
            assert abs(merged[g, p] - want) <= radix.RELATIVE_ERROR * abs(want) + 1e-307


def test_nothing_to_measure(spark):
    df = spark.createDataFrame([("a", None)], "g string, value double")
    assert radix.select(df, ["g"], PROBS).count() == 0 and radix.read(radix.state(df, ["g"]), ["g"], PROBS).count() == 0


def test_registry():
    assert {"p1_found", "p2_found", "p6_percentiles", "p7_ids", "p8_containers", "p9_found"} <= set(registry.queries()) and set(registry.oracle_sql()) <= set(registry.queries())
