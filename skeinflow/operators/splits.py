"""Train, validation and test splits, subsampling, and class weights."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinflow.operators.ranking import distributed_rank, hash_bucket, hash_order


def _half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def split_sizes(n: Column, train: float, val: float) -> tuple[Column, Column]:
    """Train and validation sizes of a class of ``n``: half-even rounding; from 3 on each split gets one; below, all is train."""
    n_train = F.least(_half_even(n * F.lit(train)), n - 2)
    n_val = F.greatest(F.lit(1), F.least(_half_even(n * F.lit(val)), n - n_train - 1))
    return F.when(n < 3, n).otherwise(n_train), F.when(n < 3, F.lit(0)).otherwise(n_val)


def _by_rank(ranked: DataFrame, n_train: Column, n_val: Column) -> DataFrame:
    r = F.col("rank")
    split = F.when(r <= n_train, "train").when(r <= n_train + n_val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("rank", "group_size")


def temporal_split(df: DataFrame, label: str, ts: str, key: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Per label the earliest rows to train, the next to val, the latest to test; rows without time come last."""
    bucket = F.coalesce(F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")), F.lit(2**31 - 1))
    ranked = distributed_rank(df, [label], [F.col(ts).asc_nulls_last(), F.col(key)], bucket)
    return _by_rank(ranked, *split_sizes(F.col("group_size"), train, val))


def hashed_split(df: DataFrame, label: str, key: str, seed: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Per label a pseudo-random split of the same sizes, repeatable by seed."""
    rows = df.withColumn("_h", hash_order(seed, key))
    ranked = distributed_rank(rows, [label], ["_h", key], hash_bucket("_h"))
    return _by_rank(ranked, *split_sizes(F.col("group_size"), train, val)).drop("_h")


def test_first_split(df: DataFrame, label: str, key: str, seed: str, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """Per label test, then val, then train; classes of 3 on give each at least one, and train always keeps one."""
    rows = df.withColumn("_h", hash_order(seed, key))
    ranked = distributed_rank(rows, [label], ["_h", key], hash_bucket("_h"))
    n = F.col("group_size")
    n_test, n_val = _half_even(n * test), _half_even(n * val)
    n_test = F.when((n >= 3) & F.lit(test > 0), F.greatest(F.lit(1), n_test)).otherwise(n_test)
    n_val = F.when((n >= 3) & F.lit(val > 0), F.greatest(F.lit(1), n_val)).otherwise(n_val)
    over = n_test + n_val - n + 1
    n_val = F.when(n_test + n_val >= n, F.greatest(F.lit(0), n_val - over)).otherwise(n_val)
    n_test = F.when(n_test >= n, F.greatest(F.lit(0), n - 1)).otherwise(n_test)
    r = F.col("rank")
    split = F.when(r <= n_test, "test").when(r <= n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_h", "rank", "group_size")


def stratified_subsample(df: DataFrame, label: str, key: str, seed: str, per_class: int, small: int = 100) -> DataFrame:
    """At most ``per_class`` rows of each label; labels with fewer than ``small`` rows are repeated instead.

    A small label gives min(per_class // 4, max(4 n, 50)) rows, its rows taken in turn.
    Adds ``copy``, 0 for the first use of a row.
    """
    rows = df.withColumn("_h", hash_order(seed, key))
    ranked = distributed_rank(rows, [label], ["_h", key], hash_bucket("_h"))
    n, r = F.col("group_size"), F.col("rank")
    wanted = F.least(F.lit(per_class // 4), F.greatest(n * 4, F.lit(50)))
    copies = F.when(n < small, F.floor((wanted - r) / n) + 1).otherwise((r <= per_class).cast("long"))
    return ranked.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("_h", "rank", "group_size")


def take_per_class(df: DataFrame, label: str, key: str, seed: str, targets: Mapping[str, int] | int) -> DataFrame:
    """Exactly min(target, n) pseudo-random rows of each label; labels without target give none."""
    rows = df.withColumn("_h", hash_order(seed, key))
    ranked = distributed_rank(rows, [label], ["_h", key], hash_bucket("_h"))
    want = F.lit(targets) if isinstance(targets, int) else F.coalesce(*[F.when(F.col(label) == k, F.lit(v)) for k, v in targets.items()], F.lit(0))
    return ranked.where(F.col("rank") <= want).drop("_h", "rank", "group_size")


def exact_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """Exactly ``n`` pseudo-random rows: a distributed top-n by hash."""
    return df.withColumn("_h", hash_order(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def interleave(df: DataFrame, label: str, key: str, bucket: Column) -> DataFrame:
    """Round robin over labels: adds ``turn`` (order by turn, label)."""
    return distributed_rank(df, [label], [key], bucket, rank="turn").drop("group_size")


def class_weights(df: DataFrame, label: str, n_classes: int | None = None, beta: float | None = None, max_weight: float | None = None) -> DataFrame:
    """Weight per label with mean 1: inverse frequency, or class-balanced with ``beta``; then at most ``max_weight``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy(F.lit(0))  # one row per class
    n = F.col("n").cast("double")
    raw = (1.0 - beta) / (1.0 - F.pow(F.lit(beta), n)) if beta else F.sum("n").over(every) / (F.lit(n_classes) if n_classes else F.count(F.lit(1)).over(every)) / n
    out = counts.withColumn("_w", raw).withColumn("weight", F.col("_w") / F.avg("_w").over(every)).drop("_w")
    return out.withColumn("weight", F.least("weight", F.lit(max_weight))) if max_weight else out


def scaling(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of each column in long form: feature, mean, std."""
    parts = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")) for c in columns]
    return df.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def standardize(df: DataFrame, columns: list[str], stats: Mapping[str, tuple[float, float]], floor: float = 1e-6) -> DataFrame:
    """(x - mean) / max(std, floor) with given statistics."""
    return df.withColumns({c: (F.col(c) - stats[c][0]) / max(stats[c][1], floor) for c in columns})
