import math

from pyspark.sql import functions as F

from skeinflow.functions import canon


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr("v").alias("x")).first()["x"]


HOSTS = {
    "10.0.0.7": "10.0.0.7", "10.0.0.7\n": "10.0.0.7", "010.000.000.007": "10.0.0.7", " 10.0.3.40 \t": "10.0.3.40", "[10.0.0.7]": "10.0.0.7", "10.0.0.7:1941": "10.0.0.7", "10.0.0.7/32": "10.0.0.7",
    "[10.0.0.7]:80": "10.0.0.7", "::ffff:10.1.0.85": "10.1.0.85", "::FFFF:10.1.0.85": "10.1.0.85", "::ffff:0a01:005a": "10.1.0.90", "::ffff:a01:5": "10.1.0.5",
    "0:0:0:0:0:ffff:10.1.0.5": "10.1.0.5", "167772167": "10.0.0.7", "4294967295": "255.255.255.255", "0.0.0.0": "0.0.0.0", "255.255.255.255": "255.255.255.255",
    "": None, "-": None, "N/A": None, "unknown": None, "10.0.0": None, "10.0.0.256": None, "4294967296": None, "10.0.0.7.8": None, "host": None, "::1": None, None: None,
}


def test_hosts(spark):
    df = spark.createDataFrame([(k,) for k in HOSTS], "v string").select("v", canon.host("v").alias("x"))
    assert {r["v"]: r["x"] for r in df.collect()} == HOSTS


def test_flow_ids(spark):
    assert one(spark, "\tFLOW_1_AB ", "string", canon.flow_id) == "flow_1_ab"
    assert one(spark, " \t", "string", canon.flow_id) is None
    assert one(spark, None, "string", canon.flow_id) is None


def test_times(spark):
    assert one(spark, 1706747341.651, "double", canon.millis) == 1706747341651
    assert one(spark, 1706747341651.0, "double", canon.millis) == 1706747341651
    for bad in (None, math.nan, math.inf, -math.inf):
        assert one(spark, bad, "double", canon.millis) is None


def test_interval(spark):
    a, b = canon.interval("a", "b")
    rows = [(5.0, 7.0), (7.0, 5.0), (5.0, None), (None, 5.0), (None, None), (1706747341651.0, 1706747341.650)]
    got = spark.createDataFrame(rows, "a double, b double").select(a.alias("s"), b.alias("e")).collect()
    assert [tuple(r) for r in got] == [(5000, 7000), (5000, 7000), (5000, 5000), (None, None), (None, None), (1706747341650, 1706747341651)]


def test_ports_and_measures(spark):
    df = spark.createDataFrame([(0,), (-1,), (None,), (80,)], "p int").select(canon.port("p").alias("x"))
    assert [r["x"] for r in df.collect()] == [None, None, None, 80]
    df = spark.createDataFrame([(-1.0,), (math.nan,), (math.inf,), (None,), (0.0,), (1e300,)], "p double").select(canon.measured("p").alias("x"))
    assert [r["x"] for r in df.collect()] == [None, None, None, None, 0.0, 1e300]


def test_labels(spark):
    df = spark.createDataFrame([(" Benign ",), ("",), (None,)], "l string").select(canon.label("l", "none").alias("x"), canon.label("l").alias("y"))
    assert [tuple(r) for r in df.collect()] == [("benign", "benign"), ("none", None), ("none", None)]
    assert F is not None
