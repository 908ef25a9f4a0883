"""Typed graph of flows, packets, hosts, techniques and tactics: node tiers, edges, neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinflow.operators.ranking import distributed_rank


def encode_ids(df: DataFrame, col: str, lead: int = 2) -> DataFrame:
    """``col`` and ``idx``: dense ids from 0 in sorted order of the distinct non-null values.

    Values are strings; they are ranked in buckets of their first ``lead`` characters.
    """
    names = df.select(F.col(col).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    out = distributed_rank(names, [], ["_v"], F.substring(F.col("_v").cast("string"), 1, lead))
    return out.select(F.col("_v").alias(col), (F.col("rank") - 1).cast("long").alias("idx"))


def drop_orphans(packets: DataFrame, flows: DataFrame, key: str = "flow_id") -> DataFrame:
    return packets.join(flows.select(key), key, "left_semi")


def host_tier(flows: DataFrame) -> DataFrame:
    """host, out_degree, in_degree, n_dst_ports, n_dst_hosts over all endpoints of flows (src_ip, dst_ip, dst_port)."""
    out = flows.groupBy(F.col("src_ip").alias("host")).agg(
        F.count(F.lit(1)).alias("out_degree"), F.count_distinct("dst_port").alias("n_dst_ports"), F.count_distinct("dst_ip").alias("n_dst_hosts")
    )
    into = flows.groupBy(F.col("dst_ip").alias("host")).agg(F.count(F.lit(1)).alias("in_degree"))
    both = out.join(into, "host", "full")
    return both.select("host", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("out_degree", "in_degree", "n_dst_ports", "n_dst_hosts")]).where("host is not null")


def flow_host_edges(features: DataFrame) -> DataFrame:
    """from_host and to_host edges: rel, flow_id, host, bytes (forward or backward)."""
    e = F.array(
        F.struct(F.lit("from_host").alias("rel"), F.col("src_ip").alias("host"), F.col("fwd_bytes").alias("bytes")),
        F.struct(F.lit("to_host").alias("rel"), F.col("dst_ip").alias("host"), F.col("bwd_bytes").alias("bytes")),
    )
    return features.select("flow_id", F.explode(e).alias("e")).select("e.rel", "flow_id", "e.host", "e.bytes")


def next_packet(flowed: DataFrame) -> DataFrame:
    """Edges from each packet to the next of its flow, with the time between them."""
    w = W.partitionBy("flow_id").orderBy("ts", "seq")
    rows = flowed.select("flow_id", F.lag("seq").over(w).alias("src"), F.col("seq").alias("dst"), (F.col("ts") - F.lag("ts").over(w)).alias("dt"))
    return rows.where(F.col("src").isNotNull())


def burst_neighbours(flows: DataFrame, radius_s: float = 1.0, limit: int = 5) -> DataFrame:
    """Edges between flows that start within ``radius_s`` of each other and share source or destination.

    ``flows``: flow_id, ts, src_ip, dst_ip. For each flow the first ``limit`` later
    ones in order of (ts, flow_id) are taken, whichever side they share; both
    directions come out: src, dst, share_src, share_dst.

    A bounded band join without pairs: each flow keeps the next ``limit``
    flows of its own source, and of its own destination, found by looking ahead in
    the order of starts. Any of the overall first ``limit`` neighbours is among
    the first ``limit`` of a side it shares, so nothing is lost, and a
    host with any number of flows adds ``limit`` rows a flow. A hot host's order is cut into
    time buckets; the head of the next bucket is repeated at the end of each.
    """
    ahead = F.struct("ts", "flow_id", "src_ip", "dst_ip")

    def side(col: str) -> DataFrame:
        # Bucket by radius: a later flow within the radius lies in the same or the next bucket.
        rows = flows.where(F.col(col).isNotNull() & F.col("ts").isNotNull()).withColumn("_b", F.floor(F.col("ts") / (radius_s * 64)))
        heads = rows.where((F.col("ts") / (radius_s * 64) - F.col("_b")) <= 1.0 / 64 + 1e-9).withColumn("_b", F.col("_b") - 1)
        first = W.partitionBy(col, "_b").orderBy("ts", "flow_id")
        heads = heads.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= limit).drop("_r").withColumn("_own", F.lit(False))
        both = rows.withColumn("_own", F.lit(True)).unionByName(heads)
        w = W.partitionBy(col, "_b").orderBy("ts", "flow_id").rowsBetween(1, limit)
        near = both.withColumn("_next", F.collect_list(ahead).over(w)).where("_own")
        out = near.select(F.col("flow_id").alias("a"), F.col("ts").alias("_t"), F.col("src_ip").alias("_s"), F.col("dst_ip").alias("_d"), F.explode("_next").alias("n"))
        return out.where(F.col("n.ts") <= F.col("_t") + radius_s)

    pairs = side("src_ip").unionAll(side("dst_ip"))
    pairs = pairs.select("a", F.col("n.flow_id").alias("b"), F.col("n.ts").alias("bt"), F.coalesce(F.col("_s") == F.col("n.src_ip"), F.lit(False)).alias("share_src"), F.coalesce(F.col("_d") == F.col("n.dst_ip"), F.lit(False)).alias("share_dst")).distinct()
    pairs = pairs.withColumn("_r", F.row_number().over(W.partitionBy("a").orderBy("bt", "b"))).where(F.col("_r") <= limit)
    return both_ways(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "share_src", "share_dst"))


def both_ways(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The edges and their reverses."""
    turned = edges.select(*[F.col(dst).alias(c) if c == src else F.col(src).alias(c) if c == dst else F.col(c) for c in edges.columns])
    return edges.unionByName(turned)


def subtechnique_edges(techniques: DataFrame, col: str = "technique_id") -> DataFrame:
    """parent, child for ids such as T1190.001 whose parent exists."""
    ids = techniques.select(F.col(col).alias("child")).where(F.col("child").isNotNull()).distinct()
    children = ids.where(F.contains("child", F.lit("."))).withColumn("parent", F.substring_index("child", ".", 1))
    return children.join(ids.select(F.col("child").alias("parent")), "parent", "left_semi").select("parent", "child")


def except_edges(edges: DataFrame, minus: DataFrame) -> DataFrame:
    """Edges whose (src, dst) is not among ``minus``."""
    return edges.join(minus.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def fan_out_cap(edges: DataFrame, k: int, seed: str) -> DataFrame:
    """At most ``k`` edges per source: the smallest by the md5 of seed, source and target.

    The cap is taken per (source, salt) first, so a source with any number of edges is cut down by many tasks.
    """
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col("src").cast("string"), F.col("dst").cast("string")).cast("binary"))
    rows = edges.withColumn("_h", h).withColumn("_salt", F.substring("_h", 32, 1))
    for keys in (["src", "_salt"], ["src"]):
        rows = rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("_h", "dst"))).where(F.col("_r") <= k)
    return rows.drop("_h", "_salt", "_r")


def k_hop(seeds: DataFrame, edges: DataFrame, hops: int, fan_out: int | None = None, seed: str = "0") -> DataFrame:
    """node, hop: nodes reachable from ``seeds`` (node) within ``hops`` steps, with the first hop that reaches them.

    With ``fan_out`` each step follows at most that many edges per node.
    """
    links = fan_out_cap(edges, fan_out, seed) if fan_out else edges
    links = links.select("src", "dst")
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for h in range(1, hops + 1):
        step = front.join(links, front["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(front)
    return seen


def local_ids(ids: DataFrame, col: str, order: str, width: int = 100_000) -> DataFrame:
    """``col`` and ``local``: ids from 0 by first occurrence along the numeric ``order``, ranked in buckets of ``width``."""
    first = ids.groupBy(col).agg(F.min(order).alias("_o"))
    ranked = distributed_rank(first, [], ["_o", col], F.floor(F.col("_o") / width))
    return ranked.select(col, (F.col("rank") - 1).cast("long").alias("local"))


def out_neighbours(edges: DataFrame, rel: str, sources: DataFrame) -> DataFrame:
    """Edges of a relation that leave the given sources (src); an unknown relation gives none."""
    return edges.where(F.col("rel") == rel).join(sources.select("src").distinct(), "src", "left_semi")


def edge_softmax(scored: DataFrame, dst: str = "dst", score: str = "score") -> DataFrame:
    """Softmax of edge scores over the edges into each node, as ``attention``."""
    best = scored.groupBy(dst).agg(F.max(score).alias("_m"))
    e = scored.join(best, dst).withColumn("_e", F.exp(F.col(score) - F.col("_m")))
    total = e.groupBy(dst).agg(F.sum("_e").alias("_t"))
    return e.join(total, dst).withColumn("attention", F.col("_e") / F.col("_t")).drop("_m", "_e", "_t")


def temporal_weight(dt: Column, eps: float = 1e-3) -> Column:
    return 1.0 / (dt + eps)


def contribution(weight: Column, out_degree: Column, in_degree: Column, hop: Column, alpha: float = 0.5) -> Column:
    """Edge score: weight * min(1, (out + 1) / (in + 1)) * exp(-alpha hop)."""
    ratio = F.least(F.lit(1.0), (F.greatest(out_degree, F.lit(0)) + 1) / (F.greatest(in_degree, F.lit(0)) + 1))
    return weight * ratio * F.exp(-alpha * F.greatest(hop, F.lit(0)))


def neighbour_consensus(edges: DataFrame, labels: DataFrame, probs: DataFrame) -> DataFrame:
    """node, consensus: mean probability that a node's neighbours give to its own label, 1 without neighbours.

    ``labels``: node, y; ``probs``: node, class, p.
    """
    asked = edges.join(labels.withColumnRenamed("node", "dst").withColumnRenamed("y", "class"), "dst")
    given = asked.join(probs.withColumnRenamed("node", "src"), ["src", "class"], "left")
    mean = given.groupBy(F.col("dst").alias("node")).agg(F.avg(F.coalesce("p", F.lit(0.0))).alias("consensus"))
    return labels.select("node").join(mean, "node", "left").withColumn("consensus", F.coalesce("consensus", F.lit(1.0)))


def evidence_support(attack: Column, weight: Column) -> Column:
    """1 for labels that need no evidence or have some, else 0."""
    return F.when(~attack, 1.0).otherwise((F.coalesce(weight, F.lit(0.0)) > 0).cast("double"))


def clean_confidence(evidence: Column, consensus: Column, lam: float) -> Column:
    zero = F.lit(0.0)
    return F.pow(F.greatest(evidence, zero), F.lit(lam)) * F.pow(F.greatest(consensus, zero), F.lit(1 - lam))


def curriculum_weight(confidence: Column, epoch: int, warm_up: int, w_min: float) -> Column:
    return F.lit(1.0) if epoch < warm_up else F.greatest(F.lit(w_min), F.least(F.lit(1.0), confidence))


def soft_target(suspect: Column, p_own: Column, p_benign: Column, consensus: Column, lam: float = 0.7) -> Column:
    """Share of a node's target that stays on its own label (the rest is benign): 1 unless it is a suspect."""
    raw = p_own / F.greatest(p_own + p_benign, F.lit(1e-12))

    def within(x: Column) -> Column:
        return F.greatest(F.lit(1e-8), F.least(F.lit(1.0), x))

    return F.when(suspect, F.pow(within(raw), F.lit(lam)) * F.pow(within(consensus), F.lit(1 - lam))).otherwise(1.0)


def exponential_mean(series: DataFrame, key: str, order: str, value: str, decay: float = 0.9) -> DataFrame:
    """key, order, ema: e_0 = x_0, e_t = decay e_(t-1) + (1 - decay) x_t.

    Series are streamed in order, and only the last mean of a key is carried from one
    Arrow batch to the next, so a series of any length takes constant memory. Null values repeat the mean.
    """
    kinds = dict(series.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last = None, None
        for b in batches:
            if not len(b):
                continue
            carried = last is not None and b[key].iloc[0] == last_key
            x = b[value].astype("float64")
            keys = b[key]
            if carried:
                x = pd.concat([pd.Series([last]), x], ignore_index=True)
                keys = pd.concat([pd.Series([last_key]), keys], ignore_index=True)
            mean = x.reset_index(drop=True).groupby(keys.to_numpy(), sort=False, dropna=False).transform(lambda g: g.ewm(alpha=1 - decay, adjust=False, ignore_na=True).mean())
            mean = mean.to_numpy()[1 if carried else 0 :]
            last_key, last = b[key].iloc[-1], float(mean[-1])
            yield pd.DataFrame({key: b[key].to_numpy(), order: b[order].to_numpy(), "ema": mean})

    ordered = series.select(key, order, F.col(value).cast("double").alias(value)).repartition(key).sortWithinPartitions(key, order)
    return ordered.mapInPandas(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, ema double")


def audit(checks: Sequence[tuple[str, str, DataFrame, Column]]) -> DataFrame:
    """gate, severity, n_bad, ok: how many rows of each frame break its condition (null counts as broken)."""
    parts = [
        df.agg(F.coalesce(F.sum((~F.coalesce(cond, F.lit(False))).cast("long")), F.lit(0)).alias("n_bad")).select(F.lit(g).alias("gate"), F.lit(s).alias("severity"), "n_bad", (F.col("n_bad") == 0).alias("ok"))
        for g, s, df, cond in checks
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
