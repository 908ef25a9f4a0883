"""Inference of a typed attention layer over a heterogeneous graph, and typed neighbourhood sampling.

Training is out of scope; weights come as arrays whose size is that of the model.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.operators.graph import fan_out_cap

Relation = tuple[str, str, str]


def project(nodes: DataFrame, weight: np.ndarray, bias: np.ndarray | None = None, vector: str = "x", out: str = "h") -> DataFrame:
    """node and W x + b, in Arrow batches."""
    kinds = dict(nodes.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b[vector].to_numpy()).astype(np.float64) if len(b) else np.empty((0, weight.shape[1]))
            h = x @ weight.T + (0 if bias is None else bias)
            yield pd.DataFrame({"node": b["node"], out: list(h)})

    return nodes.select("node", vector).mapInPandas(run, f"node {kinds['node']}, {out} array<double>")


def typed_attention(nodes: Mapping[str, DataFrame], edges: DataFrame, weights: Mapping[str, Mapping[str, np.ndarray]], priors: Mapping[Relation, float]) -> dict[str, DataFrame]:
    """New vectors of every node type: node, h.

    ``nodes``: type -> (node, x); ``edges``: src_type, rel, dst_type, src, dst, weight;
    ``weights``: type -> {"q", "k", "v"} matrices; ``priors``: relation -> scale. The score of an edge is q.k times the
    prior over sqrt(d), plus the log of its weight; softmax runs over all edges into
    a node, whatever their relation; a node without edges gets zeros.
    """
    parts = {t: {m: project(df, w[m], out=m) for m in ("q", "k", "v")} for t, df in nodes.items() for w in [weights[t]]}
    scored = None
    for (src_type, rel, dst_type), prior in priors.items():
        e = edges.where((F.col("src_type") == src_type) & (F.col("rel") == rel) & (F.col("dst_type") == dst_type)).select("src", "dst", "weight")
        kv = parts[src_type]["k"].join(parts[src_type]["v"], "node").withColumnRenamed("node", "src")
        q = parts[dst_type]["q"].withColumnRenamed("node", "dst")
        dot = F.aggregate(F.zip_with("q", "k", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        rows = e.join(kv, "src").join(q, "dst").select(F.lit(dst_type).alias("type"), "dst", "v", (dot * prior / F.sqrt(F.size("q")) + F.log(F.greatest("weight", F.lit(1e-12)))).alias("score"))
        scored = rows if scored is None else scored.unionAll(rows)
    best = scored.groupBy("type", "dst").agg(F.max("score").alias("_m"))
    weighted = scored.join(best, ["type", "dst"]).withColumn("_e", F.exp(F.col("score") - F.col("_m")))
    long = weighted.select("type", "dst", "_e", F.posexplode("v").alias("i", "x"))
    summed = long.groupBy("type", "dst", "i").agg((F.sum(F.col("_e") * F.col("x")) / F.sum("_e")).alias("x"))
    vectors = summed.groupBy("type", "dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("h"))
    out = {}
    for t, df in nodes.items():
        size = weights[t]["v"].shape[0]
        mine = vectors.where(F.col("type") == t).select(F.col("dst").alias("node"), "h")
        out[t] = df.select("node").join(mine, "node", "left").select("node", F.coalesce("h", F.array_repeat(F.lit(0.0), size)).alias("h"))
    return out


def sample_typed(seeds: DataFrame, edges: DataFrame, fan_outs: Mapping[Relation, tuple[int, ...]], seed: str) -> DataFrame:
    """Neighbours by hop and type: type, node, hop. ``seeds``: type, node; ``fan_outs``: relation -> cap per hop.

    Every hop follows each relation from the nodes reached in the hop before, at most its cap of edges a node.
    """
    hops = max(len(f) for f in fan_outs.values())
    seen = seeds.select("type", "node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for h in range(hops):
        reached = None
        for (src_type, rel, dst_type), caps in fan_outs.items():
            if h >= len(caps) or caps[h] == 0:
                continue
            start = front.where(F.col("type") == src_type).select(F.col("node").alias("src"))
            e = edges.where((F.col("src_type") == src_type) & (F.col("rel") == rel) & (F.col("dst_type") == dst_type)).select("src", "dst").join(start, "src", "left_semi")
            step = fan_out_cap(e, caps[h], f"{seed}|{rel}").select(F.lit(dst_type).alias("type"), F.col("dst").alias("node"))
            reached = step if reached is None else reached.unionAll(step)
        if reached is None:
            break
        front = reached.distinct().join(seen.select("type", "node"), ["type", "node"], "left_anti").withColumn("hop", F.lit(h + 1))
        seen = seen.unionByName(front)
    return seen
