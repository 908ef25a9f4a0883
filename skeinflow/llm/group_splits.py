"""Train, validation and test splits that keep related records together.

Grouped iterative stratification: groups are the connected components of
``components.record_groups``; their label vectors are aggregated; then, label by
label from the rarest outstanding one, the groups that hold it go, largest first,
into the split that needs most of it. Moves and exchanges of heavy groups then even
out what whole groups leave uneven.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinflow.session import materialize

UNLABELLED = "unlabelled"
OTHER = "other"


@dataclass
class _Item:
    """What the planner places: one heavy group, or all light groups with the same set of labels."""

    mask: int
    counts: list[int]
    group: str | None = None


def plan(items: Sequence[_Item], proportions: Sequence[float]) -> list[list[float]]:
    """The share of each item that goes to each split; a heavy group goes to one split as a whole."""
    n_labels = len(items[0].counts) if items else 0
    whole = sum(proportions)
    need = [[p / whole * sum(i.counts[k] for i in items) for k in range(n_labels)] for p in proportions]
    shares: list[list[float]] = [[] for _ in items]
    waiting = set(range(len(items)))
    while waiting:
        outstanding = [sum(items[i].counts[k] for i in waiting) for k in range(n_labels)]
        present = [k for k in range(n_labels) if outstanding[k]]
        if not present:
            for i in waiting:
                shares[i] = [p / whole for p in proportions]
            break
        rarest = min(present, key=lambda k: (outstanding[k], k))
        holders = [i for i in waiting if items[i].counts[rarest]]
        heavy = sorted((i for i in holders if items[i].group is not None), key=lambda i: (-items[i].counts[rarest], items[i].group))
        for i in heavy + sorted(i for i in holders if items[i].group is None):
            wants = [need[s][rarest] for s in range(len(proportions))]
            totals = [sum(need[s]) for s in range(len(proportions))]
            if items[i].group is not None:
                best = max(range(len(proportions)), key=lambda s: (wants[s], totals[s], -s))
                shares[i] = [float(s == best) for s in range(len(proportions))]
            else:
                open_wants = [max(0.0, x) for x in wants]
                base = open_wants if sum(open_wants) > 0 else [max(0.0, x) for x in totals] if max(totals) > 0 else list(proportions)
                shares[i] = [x / sum(base) for x in base]
            for s, share in enumerate(shares[i]):
                for k in range(n_labels):
                    need[s][k] -= share * items[i].counts[k]
            waiting.discard(i)
    return shares


def even_out(items: Sequence[_Item], shares: list[list[float]], proportions: Sequence[float], steps: int = 500, total_weight: float = 3.0) -> list[list[float]]:
    """Move or exchange heavy groups while that lowers the squared deviations from the wanted records per split and label.

    All records of a split count ``total_weight`` times as much as one label's. At most ``steps`` moves,
    each the best there is; fewer than a few thousand groups, so all pairs of them fit in memory.
    """
    heavy = [i for i, item in enumerate(items) if item.group is not None]
    if not heavy:
        return shares
    counts = np.array([i.counts for i in items], dtype=float)
    vectors = np.column_stack([counts.sum(axis=1) * total_weight, counts])
    parts = np.array(shares, dtype=float)
    part = np.asarray(proportions, dtype=float) / sum(proportions)
    error = parts.T @ vectors - np.outer(part, vectors.sum(axis=0))
    own = vectors[heavy]
    where = parts[heavy].argmax(axis=1)
    squares, dots = (own**2).sum(axis=1), own @ own.T
    for _ in range(steps):
        best = (-1e-6, None)
        for s in range(len(part)):
            for t in range(len(part)):
                here, there = np.flatnonzero(where == s), np.flatnonzero(where == t)
                if s == t or not len(here) or part[t] == 0:
                    continue
                gap = error[s] - error[t]
                gain = own @ gap
                move = 2 * squares[here] - 2 * gain[here]
                i = int(move.argmin())
                if move[i] < best[0]:
                    best = (float(move[i]), (here[i], None, s, t))
                if s < t and len(there):
                    swap = 2 * (squares[here][:, None] + squares[there][None, :] - 2 * dots[np.ix_(here, there)]) - 2 * (gain[here][:, None] - gain[there][None, :])
                    i, j = np.unravel_index(int(swap.argmin()), swap.shape)
                    if swap[i, j] < best[0]:
                        best = (float(swap[i, j]), (here[i], there[j], s, t))
        if best[1] is None:
            break
        i, j, s, t = best[1]
        change = own[i] - (own[j] if j is not None else 0)
        error[s], error[t] = error[s] - change, error[t] + change
        where[i] = t
        if j is not None:
            where[j] = s
    for i, s in zip(heavy, where, strict=True):
        shares[i] = [float(s == k) for k in range(len(part))]
    return shares


def assign_splits(
    groups: DataFrame, labels: Sequence[str], splits: Sequence[tuple[str, float]], heavy_parts: int = 2000, bucket_groups: int = 100_000
) -> DataFrame:
    """Give every group of ``record_groups`` one split: group_key, split_name, n_records.

    Groups holding more than 1/``heavy_parts`` of the records are placed one by one
    on the driver - there are fewer than ``heavy_parts`` of them. All others are
    summed by their set of labels (at most 2^labels sums, and no more than groups);
    the planner sees only the sums and says what share goes where, and the groups
    are dealt in a fixed pseudo-random order until each share is full. So any
    share is met up to one light group. Records with a null label count as
    "unlabelled", labels outside ``labels`` as "other". A group larger than every
    split's room still goes to one split whole. Light groups are dealt in buckets of about
    ``bucket_groups``, so their number grows and not their size. No records give no rows.
    """
    names = [*labels, OTHER, UNLABELLED]
    if len(names) > 60:
        raise ValueError("at most 58 labels; merge rare ones first")
    if not splits or any(p < 0 for _, p in splits) or not sum(p for _, p in splits):
        raise ValueError("proportions must not be negative nor all 0")
    known = F.when(F.col("label").isNull(), UNLABELLED).when(F.col("label").isin(list(labels)), F.col("label")).otherwise(OTHER)
    counts = [F.sum((F.col("_l") == n).cast("long")).alias(f"c{k}") for k, n in enumerate(names)]
    vectors = groups.withColumn("_l", known).groupBy("group_key").agg(F.count(F.lit(1)).alias("n_records"), *counts)
    mask = sum((F.when(F.col(f"c{k}") > 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in range(len(names))), F.lit(0).cast("long"))
    vectors = materialize(vectors.withColumn("mask", mask), "label-vectors")
    spark = groups.sparkSession
    total, n_groups = vectors.agg(F.coalesce(F.sum("n_records"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(64, -(-n_groups // bucket_groups))
    cut = max(1, total // heavy_parts)
    cols = [f"c{k}" for k in range(len(names))]
    heavy = [_Item(r["mask"], [r[c] for c in cols], r["group_key"]) for r in vectors.where(F.col("n_records") > cut).collect()]
    light = vectors.where(F.col("n_records") <= cut)
    sums = light.groupBy("mask").agg(F.sum("n_records").alias("n_records"), *[F.sum(c).alias(c) for c in cols]).collect()
    items = heavy + [_Item(r["mask"], [r[c] for c in cols]) for r in sums]
    proportions = [p for _, p in splits]
    shares = even_out(items, plan(items, proportions), proportions)

    split_names = [s for s, _ in splits]
    placed = [(i.group, split_names[sh.index(1.0)]) for i, sh in zip(items, shares, strict=True) if i.group is not None]
    heavy_df = spark.createDataFrame(placed, "group_key string, split_name string")
    ends = []
    for item, share in zip(items, shares, strict=True):
        if item.group is None:
            edge = 0.0
            for name, part in zip(split_names, share, strict=True):
                if part > 0:
                    ends.append((item.mask, name, edge, edge + part))
                    edge += part
    reach = spark.createDataFrame(ends, "mask long, split_name string, from_share double, to_share double")

    light = light.select("group_key", "mask", "n_records", F.xxhash64("group_key").alias("_h")).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    per_bucket = light.groupBy("mask", "_b").agg(F.sum("n_records").alias("_n"))
    w = W.partitionBy("mask").orderBy("_b")
    per_bucket = per_bucket.select(
        "mask", "_b", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy("mask")).alias("_all")
    )
    inner = W.partitionBy("mask", "_b").orderBy("_h", "group_key")
    placed_at = light.withColumn("_upto", F.sum("n_records").over(inner)).join(per_bucket, ["mask", "_b"])
    middle = (F.col("_before") + F.col("_upto") - F.col("n_records") / 2.0) / F.col("_all")
    dealt = placed_at.withColumn("_p", middle).join(reach, "mask").where("_p >= from_share and _p < to_share")
    leftover = W.partitionBy("group_key")  # a share edge met twice by rounding
    dealt = dealt.withColumn("_k", F.row_number().over(leftover.orderBy("from_share"))).where("_k = 1")
    sizes = vectors.select("group_key", "n_records")
    return dealt.select("group_key", "split_name").unionAll(heavy_df).join(sizes, "group_key")
