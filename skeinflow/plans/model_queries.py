"""Queries of model-side operators: typed attention, sampling, baselines, augmentation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.operators import artifact, attention, metrics
from skeinflow.plans.graph_queries import _LK, _SEEDS, _cap, _links, _seeds
from skeinflow.plans.text_queries import class_map, dictionary, payloads
from skeinflow.sources.tables import table

DIMS = 4


def _typed_edges(spark: SparkSession, d: str) -> DataFrame:
    e = _links(spark, d)
    return e.select(F.lit("host").alias("src_type"), F.lit("talks").alias("rel"), F.lit("host").alias("dst_type"), "src", "dst", F.col("n").cast("double").alias("weight"))


def typed_attention(spark: SparkSession, d: str) -> DataFrame:
    """One attention layer over host edges; node vectors are degrees, weights are fixed."""
    e = _typed_edges(spark, d)
    degrees = e.select(F.col("src").alias("node"), F.col("weight").alias("o"), F.lit(0.0).alias("i")).unionAll(e.select("dst", F.lit(0.0), "weight"))
    nodes = degrees.groupBy("node").agg(F.array(F.log1p(F.sum("o")), F.log1p(F.sum("i")), F.lit(1.0)).alias("x"))
    rng = np.random.default_rng(0)
    w = {m: rng.normal(size=(DIMS, 3)) for m in ("q", "k", "v")}
    out = attention.typed_attention({"host": nodes}, e, {"host": w}, {("host", "talks", "host"): 1.0})["host"]
    return out.select("node", F.transform("h", lambda x: F.round(x, 6)).alias("h"))


def typed_sampling(spark: SparkSession, d: str) -> DataFrame:
    seeds = _seeds(spark, d).select(F.lit("host").alias("type"), "node")
    return attention.sample_typed(seeds, _typed_edges(spark, d), {("host", "talks", "host"): (3, 2)}, "m1").select("node", "hop")


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """node_id, split, y and the 79 features; gaps, and the positions that shorter vectors lack, are 0."""
    at = [F.get("node_features", F.lit(i)) for i in range(79)]
    f = F.array(*[F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x.cast("double")) for x in at])
    return table(spark, d, "graph_flow").where("flow_y is not null").select("node_id", F.lower(F.trim("split")).alias("split"), F.col("flow_y").cast("double").alias("y"), f.alias("f"))


def baseline_forest(spark: SparkSession, d: str) -> DataFrame:
    """Random forest on flow vectors of the train split; its scores on the others."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = feature_rows(spark, d).withColumn("v", array_to_vector("f"))
    model = RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=20, maxDepth=6, seed=1).fit(rows.where("split = 'train'"))
    got = model.transform(rows.where("split <> 'train'")).select("split", F.col("y").cast("int").alias("t"), F.col("prediction").cast("int").alias("p"))
    return metrics.summary(metrics.scores(metrics.class_counts(got, "t", "p", ["split"])), ["split"])


def packet_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges by relation of the graph built from packets whose payload is the text of a document about their flow."""
    from skeinflow.functions import canon
    from skeinflow.sources import views

    docs = payloads(spark, d).where("flow is not null").groupBy("flow").agg(F.min_by("payload", "doc_id").alias("payload"))
    of_flow = table(spark, d, "packet_event").select(F.col("event_seq").alias("seq"), canon.flow_id("flow_id").alias("flow"))
    p = views.packets(spark, d).join(of_flow.join(docs, "flow").select("seq", "payload"), "seq", "left")
    p = p.withColumn("payload_len", F.coalesce(F.length("payload"), F.lit(0)))
    m = class_map(spark, d)
    pmi = m.select(F.concat(F.lit("t:"), F.regexp_replace("label", "_", "")).alias("token"), "technique", "family", (F.col("map_weight") * 0.9).alias("weight"))
    t = table(spark, d, "traffic_class").where("technique_id is not null").select(F.col("technique_id").alias("technique"), "family", F.col("family").alias("tactic"))
    g = artifact.build(p, pmi, dictionary(spark, d), t)
    return g.edges.groupBy("src_type", "rel", "dst_type").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.avg("weight"), 4).alias("mean_weight"))


QUERIES = {f.__name__: f for f in (typed_attention, typed_sampling, baseline_forest, packet_graph)}
ORACLE = {
    "typed_sampling": f"""with {_LK}, {_SEEDS}, e1 as {_cap('lk', 3, 'm1|talks')}, e2 as {_cap('lk', 2, 'm1|talks')},
      h1 as (select distinct dst as node from sd join e1 on sd.node = e1.src where dst not in (select node from sd)),
      h2 as (select distinct dst as node from h1 join e2 on h1.node = e2.src where dst not in (select node from sd) and dst not in (select node from h1))
      select node, 0 as hop from sd union all select node, 1 from h1 union all select node, 2 from h2""",
}
