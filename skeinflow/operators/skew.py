"""Per-key totals and lookups that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def fan_in_rounds(partitions: int, fan_in: int) -> int:
    """Rounds of merging ``fan_in`` neighbours until one of ``partitions`` states is left."""
    rounds = 0
    while partitions > 1:
        partitions = -(-partitions // fan_in)
        rounds += 1
    return rounds


def tree_aggregate(df: DataFrame, keys: Sequence[str], measures: Mapping[str, tuple[str, Column]], fan_in: int = 8, partitions: int | None = None) -> DataFrame:
    """Aggregate per key in rounds of bounded fan-in.

    ``measures`` maps an output column to (how, expression) with how one of
    "sum", "min", "max" (a count is the sum of ones). Every input partition is a chunk, and is combined by itself
    before anything is shuffled; then the states of ``fan_in`` neighbouring chunks are merged per round,
    in log(partitions)/log(fan_in) rounds. In none of them, the first included, does a reducer get more than
    ``fan_in`` states of a key and chunk, so a key with any share of the rows costs
    what any other key costs. ``partitions`` defaults to the number ``df`` has, which must not stand
    on a shuffle then. Null keys form a group; empty input gives no rows.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    rounds = fan_in_rounds(partitions or df.rdd.getNumPartitions(), fan_in)
    state = df.select(*keys, *[e.alias(n) for n, (_, e) in measures.items()], F.spark_partition_id().alias("_chunk"))
    merge = [_MERGE[how](n).alias(n) for n, (how, _) in measures.items()]
    for _ in range(rounds - 1):
        state = state.withColumn("_chunk", F.floor(F.col("_chunk") / fan_in).cast("int")).groupBy(*keys, "_chunk").agg(*merge)
    return state.groupBy(*keys).agg(*merge)


def totals_by_host(states: DataFrame) -> DataFrame:
    """Per source host of flow_state: rows, packets and the time span. Rows without host come out under a null key."""
    one = F.lit(1).cast("long")
    out = tree_aggregate(
        states,
        ["src_host"],
        {"n_rows": ("sum", one), "packets": ("sum", F.col("packet_count")), "first_ms": ("min", F.col("start_ms")), "last_ms": ("max", F.col("end_ms"))},
    )
    none = F.lit(None).cast("long")
    return out.select(F.lit("src_ip").alias("key_field"), F.col("src_host").alias("key_value"), "n_rows", "packets", none.alias("bytes"), "first_ms", "last_ms")


def totals_by_flow(packets: DataFrame) -> DataFrame:
    """Per flow id of packet_event: rows, packets, measured bytes and the time span. Rows without flow id come out under a null key."""
    one = F.lit(1).cast("long")
    out = tree_aggregate(
        packets,
        ["fid"],
        {"n_rows": ("sum", one), "bytes": ("sum", F.col("payload")), "first_ms": ("min", F.col("at_ms")), "last_ms": ("max", F.col("at_ms"))},
    )
    return out.select(F.lit("flow_id").alias("key_field"), F.col("fid").alias("key_value"), "n_rows", F.col("n_rows").alias("packets"), "bytes", "first_ms", "last_ms")


def heavy_keys(totals: DataFrame, all_rows: int, share_percent: int = 4) -> DataFrame:
    """Keys holding at least ``share_percent`` of ``all_rows`` rows; the null key is none."""
    hit = F.col("key_value").isNotNull() & (F.col("n_rows") * 100 >= F.lit(all_rows) * share_percent)
    return totals.where(hit).select("key_field", "key_value")


def small_enough(df: DataFrame, rows: int, size: int = 64 << 20) -> bool:
    """Whether a table has at most ``rows`` rows, counted, and ``size`` bytes, by its files: what may be broadcast. Give a materialised one."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= size and df.count() <= rows


def salted_lookup(big: DataFrame, dim: DataFrame, key: str, salts: int = 8, how: str = "left", broadcast_rows: int = 50_000) -> DataFrame:
    """Join a table with hot keys to one with at most one row per key.

    The lookup side is measured first (pass a materialised one). Up to ``broadcast_rows``
    rows and 64 MB it is sent to every executor and no row of the big side moves. Beyond, it is repeated once per salt,
    the big side takes a salt from all its columns, and both are shuffled, never
    broadcast: a hot key is spread over ``salts`` tasks. Null keys match nothing.
    """
    if small_enough(dim, broadcast_rows):
        return big.join(F.broadcast(dim), key, how)
    a = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    b = dim.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return a.hint("merge").join(b, [key, "_salt"], how).drop("_salt")


def hot_lookup(big: DataFrame, dim: DataFrame, key: str, how: str = "inner", counted: DataFrame | None = None, part_rows: int = 1_000_000, hot_keys: int = 1000) -> DataFrame:
    """Join a materialised table with hot keys to one with one row per key, both too large to broadcast.

    Keys with more than ``part_rows`` rows of ``big``, and more than 1/``hot_keys`` of all its rows, are hot: there are
    fewer than ``hot_keys``, so their list may go to the driver. Their rows are cut by hash into parts of
    ``part_rows`` at most about, and their one row of ``dim`` goes to each part. Other rows
    move once, as in a plain join, and no other row of ``dim`` is repeated. Null keys match nothing. ``counted`` is a
    materialised table with as many rows per key, where ``big`` is none.
    """
    counted = big if counted is None else counted
    rows = counted.count()
    limit = max(part_rows, -(-rows // hot_keys))
    hot = {}
    if rows > limit:
        sizes = counted.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
        hot = {r[key]: -(-r["n"] // limit) for r in sizes.collect() if r[key] is not None}
    if not hot:
        return big.join(dim, key, how)
    parts = F.create_map(*[F.lit(x) for k, n in sorted(hot.items()) for x in (k, n)])
    n_parts = F.coalesce(F.try_element_at(parts, F.col(key)), F.lit(1))
    a = big.withColumn("_part", F.pmod(F.xxhash64(*big.columns), n_parts).cast("int"))
    b = dim.withColumn("_part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    return a.join(b, [key, "_part"], how).drop("_part")
