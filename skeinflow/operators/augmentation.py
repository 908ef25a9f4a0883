"""Augmentation of graphs by pseudo-random but repeatable choices: every choice is an order of md5 hashes, so any engine makes the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.operators.ranking import distributed_rank, hash_bucket, hash_order


def chosen(df: DataFrame, key: Sequence[str], seed: str, share: float, keys: Sequence[str] = (), least: int = 0) -> DataFrame:
    """Adds ``pick``: the place of a row among the chosen ones of its group (1 on), null for the others.

    Of each group of ``keys`` floor(``share`` * rows) rows are chosen, ``least`` at least if there are two or more, in the order of their hash.
    """
    rows = df.withColumn("_h", hash_order(seed, *key))
    one = F.lit(0).alias("_all")
    ranked = distributed_rank(rows.select("*", one), list(keys) or ["_all"], ["_h", *key], hash_bucket("_h"), "_r", "_n")
    wanted = F.floor(F.col("_n") * share)
    wanted = F.when(F.col("_n") >= 2, F.greatest(wanted, F.lit(least))).otherwise(0) if least else wanted
    return ranked.withColumn("pick", F.when(F.col("_r") <= wanted, F.col("_r"))).drop("_h", "_all", "_r", "_n")


def _draw(seed: str, n: int) -> Column:
    """A pseudo-random number 1..n from a seed and the row's ``id``."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % n + 1


def add_edges(edges: DataFrame, nodes: DataFrame, weight: str, seed: str, share: float) -> DataFrame:
    """``edges`` (src, dst, ``weight``) and floor(``share`` * edges) new ones between pseudo-random ``nodes`` (node), with the mean weight."""
    n_edges, mean = edges.agg(F.count(F.lit(1)), F.avg(weight)).first()
    n_new = int(n_edges * share)
    numbered = distributed_rank(nodes.select("node", F.lit(0).alias("_all")), ["_all"], ["node"], F.substring("node", 1, 8), "_i", "_n").select("node", "_i")
    n_nodes = nodes.count()
    if not n_new or not n_nodes:
        return edges.select("src", "dst", F.col(weight).cast("double").alias(weight))
    ends = edges.sparkSession.range(n_new).select("id", _draw(f"{seed}|src", n_nodes).alias("_s"), _draw(f"{seed}|dst", n_nodes).alias("_t"))
    a, b = numbered.select(F.col("_i").alias("_s"), F.col("node").alias("src")), numbered.select(F.col("_i").alias("_t"), F.col("node").alias("dst"))
    new = ends.join(a, "_s").join(b, "_t").select("src", "dst", F.lit(float(mean)).alias(weight))
    return edges.select("src", "dst", F.col(weight).cast("double").alias(weight)).unionAll(new)


def turn_edges(edges: DataFrame, seed: str, share: float) -> DataFrame:
    """Edges (src, dst, ...) of which floor(``share`` * edges) are turned; the rest of a row stays with it."""
    rows = chosen(edges, ["src", "dst"], seed, share)
    turned = F.col("pick").isNotNull()
    return rows.withColumns({"src": F.when(turned, F.col("dst")).otherwise(F.col("src")), "dst": F.when(turned, F.col("src")).otherwise(F.col("dst"))}).drop("pick")


def perturb_edges(edges: DataFrame, nodes: DataFrame, weight: str, seed: str, share: float) -> DataFrame:
    """floor(``share`` * edges) edges dropped and as many new ones added as in ``add_edges``."""
    n_edges = edges.count()
    kept = chosen(edges, ["src", "dst"], f"{seed}|drop", share).where("pick is null").select("src", "dst", F.col(weight).cast("double").alias(weight))
    old = edges.select("src", "dst", F.col(weight).cast("double").alias(weight))
    fresh = add_edges(old, nodes, weight, seed, share).subtract(old) if n_edges else old
    return kept.unionAll(fresh)


def swap_features(nodes: DataFrame, key: str, label: str, feature: str, seed: str, share: float) -> DataFrame:
    """Features moved in a ring among pseudo-random nodes of one label: floor(``share`` * nodes) of each, one at least, take part.

    A label with a single node, and nodes with a null label, keep theirs.
    """
    rows = chosen(nodes.where(F.col(label).isNotNull()), [key], seed, share, [label], least=1)
    ring = rows.where("pick is not null").select(F.col(label).alias("_l"), F.col("pick").alias("_p"), F.col(feature).alias("_f"))
    n = ring.groupBy("_l").agg(F.count(F.lit(1)).alias("_c"))
    giver = ring.join(n, "_l").select("_l", (F.col("_p") % F.col("_c") + 1).alias("_to"), "_f")
    out = rows.join(giver, (F.col(label) == F.col("_l")) & (F.col("pick") == F.col("_to")), "left")
    moved = F.when(F.col("_l").isNotNull(), F.col("_f")).otherwise(F.col(feature))
    changed = out.withColumn(feature, moved).select(*nodes.columns)
    return changed.unionByName(nodes.where(F.col(label).isNull()))


def buffer_nodes(edges: DataFrame, minority: DataFrame, pressure: int = 3) -> DataFrame:
    """Edges (src, dst, ...) of ``minority`` sources (src) whose target at least ``pressure`` other sources share go to a copy of the target of their own.

    Adds ``dst_node``: the target, or ``target#source`` for a copy.
    """
    shared = edges.select("src", "dst").distinct().groupBy("dst").agg((F.count(F.lit(1)) - 1).alias("_others"))
    few = minority.select("src").distinct().withColumn("_few", F.lit(True))
    rows = edges.join(shared, "dst").join(few, "src", "left")
    copy = F.coalesce(F.col("_few"), F.lit(False)) & (F.col("_others") >= pressure)
    own = F.concat_ws("#", F.col("dst").cast("string"), F.col("src").cast("string"))
    return rows.select(*edges.columns, F.when(copy, own).otherwise(F.col("dst").cast("string")).alias("dst_node"))
