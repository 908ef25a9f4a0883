"""Queries of augmentation and loss terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import canon
from skeinflow.operators import augmentation, losses, vectors
from skeinflow.plans.eval_queries import _LOGITS, _logits
from skeinflow.plans.graph_queries import _LK, _links
from skeinflow.session import materialize
from skeinflow.sources.tables import table

NORMS = (1.0, 4.0, 0.25, 2.0)
WEIGHTS = (0.5, 1.0, 2.0, 4.0)


def _hosts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = materialize(_links(spark, d), "host-links")
    return e, e.select(F.col("src").alias("node")).unionAll(e.select("dst")).distinct()


def edges_added(spark: SparkSession, d: str) -> DataFrame:
    e, nodes = _hosts(spark, d)
    return augmentation.add_edges(e, nodes, "n", "x1", 0.1).withColumn("n", F.round("n", 6))


def edges_turned(spark: SparkSession, d: str) -> DataFrame:
    return augmentation.turn_edges(_hosts(spark, d)[0], "x2", 0.2)


def edges_perturbed(spark: SparkSession, d: str) -> DataFrame:
    """Per host, how many edges leave it after a tenth was dropped and replaced."""
    e, nodes = _hosts(spark, d)
    return augmentation.perturb_edges(e, nodes, "n", "x1", 0.1).groupBy("src").agg(F.count(F.lit(1)).alias("n_edges"))


def features_swapped(spark: SparkSession, d: str) -> DataFrame:
    """Durations of flow contexts moved among half the contexts of their label."""
    c = table(spark, d, "flow_context").select("context_id", canon.label("label").alias("label"), "packet_count")
    return augmentation.swap_features(c, "context_id", "label", "packet_count", "x3", 0.5)


def buffer_targets(spark: SparkSession, d: str) -> DataFrame:
    """Host edges whose rare sources (fewer than five targets) get targets of their own where three others share them."""
    e, _ = _hosts(spark, d)
    few = e.groupBy("src").agg(F.count(F.lit(1)).alias("c")).where("c < 5").select("src")
    return augmentation.buffer_nodes(e, few, 3).select("src", "dst", "dst_node")


def soft_losses(spark: SparkSession, d: str) -> DataFrame:
    """Soft-target loss of graph nodes whose target is shared between their class and class 0, plain, and focal with class weights and smoothing; the norm-scaled class."""
    rows = _logits(spark, d)
    y = F.col("y4").cast("int")
    target = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == y, 0.75).otherwise(0.0) + F.when(i == 0, 0.25).otherwise(0.0))
    scaled = losses.norm_scaled(F.col("logits"), NORMS, 0.5)
    return rows.select(
        "node_id", F.round(losses.soft_target_loss(F.col("logits"), target), 5).alias("soft"), F.round(losses.soft_target_loss(F.col("logits"), target, WEIGHTS, 2.0, 0.1), 5).alias("focal"),
        (F.array_position(scaled, F.array_max(scaled)) - 1).cast("int").alias("scaled_class"),
    )


def contrastive(spark: SparkSession, d: str) -> DataFrame:
    """Contrastive loss of every embedding against the centroids of all labels, its own being the positive."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    c = materialize(vectors.centroids(e.where("label is not null")).select(F.col("label").cast("string").alias("name"), F.col("centroid").alias("vector")), "centroids")
    own = e.select("label").distinct().select("label", F.col("label").cast("string").alias("name"))
    return losses.contrastive_loss(e, "vec_id", "label", "embedding", c, own, 0.5, 1000).withColumn("loss", F.round("loss", 5))


QUERIES = {f.__name__: f for f in (edges_added, edges_turned, edges_perturbed, features_swapped, buffer_targets, soft_losses, contrastive)}

_N = f"{_LK}, nd as (select src as node from lk union select dst from lk), nn as (select node, row_number() over (order by node) as i, count(*) over () as c from nd)"
_DRAW = "cast(('0x' || substr(md5('{0}|' || i), 1, 8)) as bigint) % (select max(c) from nn) + 1"
_NEW = f"nw as (select a.node as src, b.node as dst from (select {_DRAW.format('x1|src')} as s, {_DRAW.format('x1|dst')} as t from (select unnest(range(cast(floor((select count(*) from lk) * 0.1::double) as bigint))) as i)) r join nn a on a.i = r.s join nn b on b.i = r.t)"
_PT = "list_transform([0, 1, 2, 3], lambda i: case when i = y4 then 0.75::double else 0.0 end + case when i = 0 then 0.25::double else 0.0 end)"
ORACLE = {
    "edges_added": f"with {_N}, {_NEW} select src, dst, n::double as n from lk union all select src, dst, round((select avg(n) from lk), 6) from nw",
    "edges_turned": f"with {_LK}, h as (select *, row_number() over (order by md5('x2|' || src || '|' || dst), src, dst) <= floor((select count(*) from lk) * 0.2::double) as t from lk) select case when t then dst else src end as src, case when t then src else dst end as dst, n from h",
    "edges_perturbed": f"""with {_N}, {_NEW}, k as (select src, dst, n::double as n from (select *, row_number() over (order by md5('x1|drop|' || src || '|' || dst), src, dst) as r from lk) where r > floor((select count(*) from lk) * 0.1::double)),
        f as (select src, dst, n::double as n from lk union all select src, dst, (select avg(n) from lk) from nw), g as (select src, dst, n from f except select src, dst, n::double from lk)
        select src, count(*) as n_edges from (select * from k union all select * from g) group by 1""",
    "features_swapped": """with c as (select context_id, nullif(lower(trim(label)), '') as label, packet_count from flow_context), r as (select *, row_number() over (partition by label order by md5('x3|' || context_id), context_id) as r, count(*) over (partition by label) as n from c where label is not null),
        w as (select *, case when n >= 2 then greatest(floor(n * 0.5::double), 1) else 0 end as k from r)
        select w.context_id, w.label, case when w.r <= w.k then g.packet_count else w.packet_count end as packet_count from w left join w g on g.label = w.label and g.r <= g.k and g.r % g.k + 1 = w.r and w.r <= w.k
        union all select * from c where label is null""",
    "buffer_targets": f"with {_LK}, o as (select dst, count(*) - 1 as others from lk group by 1), f as (select src from lk group by 1 having count(*) < 5) select lk.src, lk.dst, case when f.src is not null and others >= 3 then lk.dst || '#' || lk.src else lk.dst end as dst_node from lk join o on o.dst = lk.dst left join f on f.src = lk.src",
    "soft_losses": f"""with {_LOGITS}, y as (select g.node_id, flow_y % 4 as y4, l, list_max(l) as m from graph_flow g join lg on g.node_id = lg.node_id),
        p as (select *, {_PT} as t, list_transform(l, lambda x: x - m - ln(list_sum(list_transform(l, lambda z: exp(z - m))))) as lp, list_transform(list_zip(l, [1.0, 2.0, 0.5, sqrt(2.0::double)]), lambda z: z[1] / z[2]) as sc from y),
        s as (select *, list_dot_product(t, list_transform(lp, lambda x: exp(x))) as pt, list_transform(t, lambda x: x * 0.9::double + 0.025::double) as tm from p)
        select node_id, round(-list_dot_product(t, lp), 5) as soft, round(-list_dot_product(tm, lp) * pow(1 - pt, 2) * list_dot_product(t, [0.5::double, 1.0, 2.0, 4.0]), 5) as focal, cast(list_position(sc, list_max(sc)) - 1 as integer) as scaled_class from s""",
    "contrastive": """with e as (select vec_id, label, embedding::double[] as v from embeddings), x as (select label, i, avg(v[i]) as m from (select label, v, unnest(range(1, len(v) + 1)) as i from e where label is not null) group by 1, 2),
        c as (select label, list(m order by i) as c from x group by 1), s as (select e.vec_id, e.label = c.label as own, exp(list_cosine_similarity(v, c.c) / 0.5::double) as s from e, c where v is not null and e.label is not null)
        select vec_id, round(-ln(sum(s) filter (where own) / sum(s)), 5) as loss from s group by 1""",
}
