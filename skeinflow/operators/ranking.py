"""Ranks within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distributed_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, rank: str = "rank", size: str = "group_size") -> DataFrame:
    """Add the 1-based rank of each row within its group, and the group's size.

    ``bucket`` must never decrease along ``order`` (a day of a time, leading digits
    of a hash). Rows are ranked within (group, bucket) and only the bucket counts
    are summed over the group, so a group that holds most rows is still ranked by
    as many tasks as it has buckets. ``order`` must be total for a repeatable result.
    """
    rows = df.withColumn("_bk", bucket)
    counts = rows.groupBy(*keys, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    by = W.partitionBy(*keys).orderBy("_bk")
    counts = counts.select(*keys, F.col("_bk"), (F.sum("_n").over(by) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy(*keys)).alias(size))
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bk").alias("_kb"), "_before", size)
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_bk").orderBy(*order)))
    same = [F.col("_bk").eqNullSafe(F.col("_kb")), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    out = ranked.join(counts, same)
    return out.select(*df.columns, (F.col("_before") + F.col("_r")).alias(rank), size)


def hash_order(seed: str, *cols: str) -> Column:
    """A pseudo-random order that other engines can reproduce: the md5 of the seed and the columns' text."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in cols]).cast("binary"))


def hash_bucket(h: str, digits: int = 2) -> Column:
    """Leading hexadecimal digits of a hash: buckets of even size that follow its order."""
    return F.substring(h, 1, digits)
