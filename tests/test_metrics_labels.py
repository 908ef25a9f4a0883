import inspect
import random

import pytest
from pyspark.sql import functions as F

from skeinflow.operators import labels, metrics, reports
from skeinflow.plans import label_queries


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "t int, p int")


def test_scores_and_summary(spark):
    df = frame(spark, [(0, 0)] * 8 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 2)] + [(None, 1)])
    s = {r["class"]: r for r in metrics.scores(metrics.class_counts(df, "t", "p")).collect()}
    assert (s[0]["tp"], s[0]["fp"], s[0]["fn"], s[1]["fp"], s[2]["support"]) == (8, 0, 2, 2, 0)
    r = metrics.summary(metrics.scores(metrics.class_counts(df, "t", "p"))).first()
    assert r["n_rows"] == 14 and r["accuracy"] == pytest.approx(11 / 14) and r["macro_f1"] == pytest.approx((8 / 9 + 2 / 3) / 2)


def test_empty_predictions(spark):
    assert metrics.class_counts(frame(spark, []), "t", "p").count() == 0
    assert metrics.confusion(frame(spark, []), "t", "p", (0, 1)).agg(F.sum("n")).first()[0] == 0


def test_bootstrap_brackets_the_point(spark):
    rnd = random.Random(1)
    df = frame(spark, [(k, k if rnd.random() < 0.8 else (k + 1) % 3) for k in (rnd.randrange(3) for _ in range(500))])
    for r in metrics.bootstrap(df, "t", "p", (0, 1, 2), reps=60).collect():
        assert r["low"] <= r["point"] <= r["high"] and r["high"] - r["low"] < 0.2


def test_calibration_never_hurts(spark):
    rnd = random.Random(2)
    rows = [(y, [rnd.gauss(0, 1) + (1.0 if y == 0 else 0) + 1.5, rnd.gauss(0, 1) + (1.0 if y == 1 else 0)]) for y in (rnd.randrange(2) for _ in range(300))]
    df = spark.createDataFrame(rows, "y int, s array<double>")
    bias = metrics.calibrate_bias(df, "y", "s", 2, rounds=2)

    def f1(b):
        return metrics.summary(metrics.scores(metrics.class_counts(df.select("y", metrics.biased_argmax(F.col("s"), b).alias("p")), "y", "p"))).first()["macro_f1"]

    assert f1(bias) > f1([0.0, 0.0])


def test_softmax(spark):
    v = spark.createDataFrame([([1.0, 1.0, 1000.0],)], "v array<double>").select(metrics.softmax(F.col("v")).alias("p"), metrics.argmax(F.col("v")).alias("a")).first()
    assert sum(v["p"]) == pytest.approx(1.0) and v["a"] == 2


def test_isolation(spark):
    rows = [(1, "web", "k1", "GET /exec"), (2, "web", "k1", "x"), (3, "web", "k2", "HEY /exec"), (4, "udp", "k2", "y"), (5, None, "k1", "z"), (6, "web", None, "GET /exec")]
    df = spark.createDataFrame(rows, "id long, label string, k string, t string")
    hit = labels.request_matches(F.col("t"), F.col("label"), {"web": ("/exec",)})
    got = {r["id"]: r["clean_label"] for r in labels.isolate(df, "label", "k", hit, ["web"], "benign").collect()}
    assert got == {1: "web", 2: "web", 3: "benign", 4: "udp", 5: None, 6: "benign"}


def test_claims(spark):
    df = spark.createDataFrame([("Flow 0.88 rises. [E_ALERT] It fell! Why? ",), (None,), ("",)], "t string")
    got = [r["c"] for r in df.select(reports.claims("t").alias("c")).collect()]
    assert got == [["Flow 0.88 rises. [E_ALERT] It fell!", "Why?"], None, []]


def test_fidelity(spark):
    f = reports.fidelity(F.lit(0.9), F.lit(0.4), F.lit(0.8))
    r = spark.range(1).select(*[c.alias(k) for k, c in f.items()], reports.harmonic([F.lit(1.0), F.lit(0.5)]).alias("h"), reports.harmonic([F.lit(0.0), F.lit(0.5)]).alias("z")).first()
    assert (r["fidelity_plus"], r["fidelity_minus"]) == (0.5, 0.1) and r["characterization"] == pytest.approx(1 / (0.5 / 0.5 + 0.5 / 0.9)) and r["h"] == pytest.approx(2 / 3) and r["z"] == 0.0


def test_numbers_supported(spark):
    df = spark.createDataFrame([(0.88,), (88.0,), (0.9,)], "v double").select(reports.number_supported(F.col("v"), F.array(F.lit(0.88))).alias("ok"))
    assert [r["ok"] for r in df.collect()] == [True, True, False]


def test_calibration_reaches_far_biases(spark):
    rows = [(0, [5.9, 0.0])] * 40 + [(1, [4.6, 0.0])] * 40
    df = spark.createDataFrame(rows, "y int, s array<double>")
    bias = metrics.calibrate_bias(df.coalesce(1), "y", "s", 2)
    wrong = df.where(metrics.biased_argmax(F.col("s"), bias) != F.col("y")).count()
    assert wrong == 0 and bias[1] - bias[0] > 4.6


def test_bootstrap_of_means_does_not_depend_on_partitions(spark):
    rows = [("a", float(i % 7)) for i in range(200)] + [("b", 3.0), ("b", None), ("b", float("nan")), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    one, two = ({r["g"]: tuple(round(x, 9) for x in r[1:]) for r in metrics.bootstrap_mean(df.repartition(n), "g", "v", reps=100).collect()} for n in (1, 5))
    mean = sum(v for g, v in rows if g == "a") / 200
    assert one == two and one["a"][0] == round(mean, 9) and one["a"][1] < mean < one["a"][2] and one["b"] == (3.0, 3.0, 3.0) and one[None] == (1.0, 1.0, 1.0)
    assert metrics.bootstrap_mean(df.limit(0), "g", "v").count() == 0


def test_default_repetitions():
    for f in (metrics.bootstrap, metrics.bootstrap_mean):
        assert inspect.signature(f).parameters["reps"].default == 1000


def test_node_visits_holds_every_host(spark):
    small = "/root/testdata/sf0.001"
    rows = [(r["src"], r["visits"]) for r in label_queries.node_visits(spark, small).collect()]
    hosts = {h for r in label_queries._links(spark, small).select("src", "dst").collect() for h in r}
    assert {h for h, _ in rows} == hosts and len(rows) == len(hosts) > 20
    assert rows == sorted(rows, key=lambda r: (-r[1], r[0])) and rows == [(r["src"], r["visits"]) for r in label_queries.hot_nodes(spark, small).orderBy("place").collect()]
