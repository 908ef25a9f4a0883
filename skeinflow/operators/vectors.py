"""Similarity, neighbours and centroids of dense vectors, in blocks of queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _best(known: pd.DataFrame, k: int, key: str) -> pd.DataFrame:
    """The ``k`` best rows of each query, ties by the smaller id."""
    order = np.lexsort((known[key].to_numpy(), -np.round(known["cosine"].to_numpy(), 12), known["query"].to_numpy()))
    known = known.iloc[order]
    query = known["query"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.array([], dtype=int)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return known[rank < k]


def cosine_top_k(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block_bytes: int = 64 << 20, keep_self: bool = False) -> DataFrame:
    """query, key, cosine, rank: the ``k`` most similar rows of each query, exactly.

    Queries are a stated set, taken in blocks of at most ``block_bytes`` of vectors. One block at a time is broadcast
    and the rows stream past it where they lie, unmoved: a partition keeps the ``k`` best of each query so far, and only those
    leave it, so no pair beyond k * partitions per query is shuffled. Ties go to
    the smaller id. Null vectors take no part; ids must be numbers.
    """
    known = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).alias("v"))
    size, kinds, spark = known.agg(F.coalesce(F.sum(F.size("v") * 8), F.lit(0))).first()[0], dict(rows.dtypes), rows.sparkSession
    schema = f"query {kinds[key]}, `{key}` {kinds[key]}, cosine double"
    blocks = max(1, -(-size // block_bytes))
    dealt = known.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        own = dealt.where(F.col("b") == b).select("q", "v").toPandas()  # bounded by ``block_bytes``
        if not len(own):
            continue
        block = spark.sparkContext.broadcast((own["q"].to_numpy(), _unit(np.stack([np.asarray(v, dtype=np.float64) for v in own["v"]]))))

        def best(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            qid, q = block.value
            kept = None
            for batch in batches:
                if not len(batch):
                    continue
                ids = batch[key].to_numpy()
                sim = q @ _unit(np.stack([np.asarray(v, dtype=np.float64) for v in batch[vector]])).T
                if not keep_self:
                    sim[qid[:, None] == ids[None, :]] = -np.inf
                least = np.partition(sim, -k, axis=1)[:, -k] if sim.shape[1] > k else np.full(len(qid), -2.0)
                r, c = np.nonzero(sim >= np.maximum(least, -2.0)[:, None] - 1e-11)
                fresh = pd.DataFrame({"query": qid[r], key: ids[c], "cosine": sim[r, c]})
                kept = _best(fresh if kept is None else pd.concat([kept, fresh], ignore_index=True), k, key)
            if kept is not None:
                yield kept

        part = rows.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(best, schema)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    w = W.partitionBy("query").orderBy(F.desc(F.round("cosine", 12)), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def label_purity(neighbours: DataFrame, labels: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """query, purity: share of a query's neighbours that have its label."""
    near = neighbours.join(labels.select(key, F.col(label).alias("_n")), key)
    own = labels.select(F.col(key).alias("query"), F.col(label).alias("_o"))
    return near.join(own, "query").groupBy("query").agg(F.avg(F.col("_n").eqNullSafe(F.col("_o")).cast("double")).alias("purity"))


def centroids(rows: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, centroid: element-wise mean."""
    long = rows.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("m"))
    return long.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def cosine(a: str, b: str) -> F.Column:
    def total(v: F.Column) -> F.Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norms = [F.sqrt(total(F.transform(c, lambda x: x.cast("double") * x.cast("double")))) for c in (a, b)]
    return F.try_divide(dot, norms[0] * norms[1])


def normalised(vector: str) -> F.Column:
    n = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x / F.greatest(n, F.lit(1e-12)))

