"""Filling containers of fixed capacity with whole texts.

Items of one size are interchangeable, so the packing is planned on the histogram
of sizes - at most ``capacity`` numbers, whatever the number of texts - and carried
out on the items by their rank within their size. Large-item matching: items above
a third of the capacity go at most two to a container, each with the largest partner
that still fits; smaller items then fill the tightest remaining gap they fit into.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Segment:
    """Items of ``size`` ranked from ``first`` on go to containers from ``container`` on, ``per`` to each."""

    size: int
    first: int
    container: int
    per: int


class Plan:
    """Run-length plan of a packing: runs of equal containers are handled as one."""

    def __init__(self, counts: dict[int, int], capacity: int):
        if capacity < 1 or any(s < 1 or s > capacity for s in counts):
            raise ValueError("sizes must lie between 1 and the capacity")
        self.capacity = capacity
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.next_rank = dict.fromkeys(self.left, 0)
        self.segments: list[Segment] = []
        self.containers = 0
        self._gaps: dict[int, list[tuple[int, int]]] = {}
        self._gap_sizes: list[int] = []
        self._match_large()
        self._fill_small()

    def _put(self, size: int, container: int, runs: int, per: int) -> None:
        """``per`` items of ``size`` into each of ``runs`` containers from ``container`` on."""
        self.segments.append(Segment(size, self.next_rank[size], container, per))
        self.next_rank[size] += runs * per
        self.left[size] -= runs * per

    def _open(self, runs: int) -> int:
        first, self.containers = self.containers, self.containers + runs
        return first

    def _add_gap(self, gap: int, container: int, runs: int) -> None:
        if gap and runs:
            if gap not in self._gaps:
                self._gaps[gap] = []
                insort(self._gap_sizes, gap)
            self._gaps[gap].append((container, runs))

    def _match_large(self) -> None:
        large = sorted(s for s in self.left if 3 * s > self.capacity)
        while large:
            size = large[-1]
            n = self.left[size]
            fits = bisect_left(large, self.capacity - size + 1) - 1
            partner = large[fits] if fits >= 0 else None
            if partner is None or (partner == size and n == 1 and fits == 0):
                at = self._open(n)
                self._put(size, at, n, 1)
                self._add_gap(self.capacity - size, at, n)
            elif partner == size and n > 1:
                at = self._open(n // 2)
                self._put(size, at, n // 2, 2)
                self._add_gap(self.capacity - 2 * size, at, n // 2)
            else:
                if partner == size:  # a single one is left: the next smaller size is its partner
                    partner = large[fits - 1]
                runs = min(n, self.left[partner])
                at = self._open(runs)
                self._put(size, at, runs, 1)
                self._put(partner, at, runs, 1)
                self._add_gap(self.capacity - size - partner, at, runs)
            large = [s for s in large if self.left[s]]

    def _fill_small(self) -> None:
        for size in sorted((s for s in self.left if self.left[s]), reverse=True):
            while self.left[size]:
                at = bisect_left(self._gap_sizes, size)
                if at == len(self._gap_sizes):
                    self._open_small(size)
                    continue
                gap = self._gap_sizes[at]
                container, runs = self._gaps[gap].pop()
                per = min(gap // size, self.left[size])
                used = min(runs, self.left[size] // per)
                self._put(size, container, used, per)
                if used < runs:
                    self._gaps[gap].append((container + used, runs - used))
                if not self._gaps[gap]:
                    del self._gaps[gap], self._gap_sizes[at]
                self._add_gap(gap - per * size, container, used)

    def _open_small(self, size: int) -> None:
        per = min(self.capacity // size, self.left[size])
        runs = self.left[size] // per
        at = self._open(runs)
        self._put(size, at, runs, per)
        self._add_gap(self.capacity - per * size, at, runs)


def pieces(sized: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """The items to place: key, piece_no, from_token, n_tokens.

    A text within the capacity is one item. A larger one is cut into full
    containers and a rest, the only case where anything is split. Texts of size 0 (null size
    counts as 0) are one item of size 0.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    last = F.greatest(F.ceil(n / capacity) - 1, F.lit(0))
    cut = sized.select(F.col(key), n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece_no"))
    start = F.col("piece_no") * capacity
    return cut.select(key, "piece_no", start.alias("from_token"), F.least(F.lit(capacity).cast("long"), F.col("_n") - start).alias("n_tokens"))


def pack(sized: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Assign every item of ``pieces`` to a container: key, piece_no, from_token, n_tokens, container_id."""
    return pack_each(sized, [capacity], key, size).drop("capacity")


def pack_each(sized: DataFrame, capacities: Sequence[int], key: str = "doc_id", size: str = "n_tokens", bucket_rows: int = 1_000_000) -> DataFrame:
    """Assign every item of ``pieces`` to a container of each capacity, in one pass: capacity, key, piece_no, from_token, n_tokens, container_id.

    ``key`` identifies a text. Items of size 0 fill nothing and get a null
    container. Ranks within a size come from bucket counts and the order within a
    bucket of about ``bucket_rows`` items, so a size that a third of all texts share is ranked by many tasks. The
    driver sees the histograms of sizes (at most ``capacity`` rows each) and makes the plans;
    their length depends on the capacities alone. The result is the same for any order of rows; repeated keys
    are texts of their own.
    """
    wanted = sorted(set(capacities))
    parts = [pieces(sized, c, key, size).select(F.lit(c).cast("long").alias("capacity"), "*") for c in wanted]
    items = reduce(DataFrame.unionAll, parts)
    counts: dict[int, dict[int, int]] = {c: {} for c in wanted}
    for r in items.where("n_tokens > 0").groupBy("capacity", "n_tokens").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["capacity"]][r["n_tokens"]] = r["n"]
    width = 1 << 44
    plans = {}
    for c in wanted:
        segments = sorted(Plan(counts[c], c).segments, key=lambda s: (s.size, s.first))
        table = [(s.size * width + s.first, s.first, s.container, s.per) for s in segments]
        plans[c] = tuple(np.array(column, dtype=np.int64) for column in zip(*table, strict=True)) if table else None
    shared = sized.sparkSession.sparkContext.broadcast(plans)
    buckets = max(64, -(-max((sum(n.values()) for n in counts.values()), default=0) // bucket_rows))

    h = F.xxhash64(F.col(key), F.col("piece_no"))
    own = ["capacity", "n_tokens"]
    spread = items.withColumn("_h", h).withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))
    per_bucket = spread.groupBy(*own, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = per_bucket.select(*own, "_b", (F.sum("_c").over(W.partitionBy(*own).orderBy("_b")) - F.col("_c")).alias("_before"))
    inner = W.partitionBy(*own, "_b").orderBy("_h", key, "piece_no")
    ranked = spread.withColumn("_r", F.row_number().over(inner) - 1).join(before, [*own, "_b"])
    ranked = ranked.select("capacity", key, "piece_no", "from_token", "n_tokens", (F.col("_before") + F.col("_r")).alias("_rank"))

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            where = np.zeros(len(b), dtype=np.int64)
            for c, plan in shared.value.items():
                rows = np.flatnonzero((b["capacity"].to_numpy() == c) & (b["n_tokens"].to_numpy() > 0))
                if plan is not None and len(rows):
                    starts, first, container, per = plan
                    ranks = b["_rank"].to_numpy()[rows]
                    i = np.searchsorted(starts, b["n_tokens"].to_numpy()[rows] * width + ranks, side="right") - 1
                    where[rows] = container[i] + (ranks - first[i]) // per[i]
            out = b.drop(columns="_rank")
            out["container_id"] = pd.array(where, dtype="Int64")
            out.loc[b["n_tokens"].to_numpy() == 0, "container_id"] = pd.NA
            yield out

    kinds = dict(items.dtypes)
    return ranked.mapInPandas(place, f"capacity long, `{key}` {kinds[key]}, piece_no long, from_token long, n_tokens long, container_id long")


def fill_report(packed: DataFrame) -> DataFrame:
    """Per capacity of ``pack_each``: containers, tokens, items, the least possible number of containers, and the share of capacity filled."""
    used = F.col("container_id").isNotNull()
    out = packed.groupBy("capacity").agg(
        (F.coalesce(F.max("container_id"), F.lit(-1)) + 1).alias("n_containers"),
        F.coalesce(F.sum(F.when(used, F.col("n_tokens"))), F.lit(0)).alias("n_tokens"),
        F.count_if(used).alias("n_items"),
    )
    least = F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers")
    return out.select("*", least, F.try_divide("n_tokens", F.col("n_containers") * F.col("capacity")).alias("filled"))


def broken_rules(packed: DataFrame, sized: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Per capacity: texts, containers above the capacity, texts cut though they fit, and texts whose pieces do not add up to their tokens.

    All but the first must be 0. ``key`` must be unique here.
    """
    full = packed.where(F.col("container_id").isNotNull()).groupBy("capacity", "container_id").agg(F.sum("n_tokens").alias("n"))
    over = full.groupBy("capacity").agg(F.count_if(F.col("n") > F.col("capacity")).alias("n_over_full"))
    texts = packed.groupBy("capacity", key).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("_pieces"), F.max(F.col("piece_no") * F.col("capacity") - F.col("from_token")).alias("_off"))
    known = sized.select(key, F.coalesce(F.col(size), F.lit(0)).alias("_size"))
    wrong = texts.join(known, key, "full").groupBy("capacity").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if((F.col("_pieces") > 1) & (F.col("_size") <= F.col("capacity"))).alias("n_cut_though_fitting"),
        F.count_if(~F.col("n").eqNullSafe(F.col("_size")) | (F.col("_off") != 0)).alias("n_not_adding_up"),
    )
    return wrong.join(over, "capacity", "left").withColumn("n_over_full", F.coalesce("n_over_full", F.lit(0)))
