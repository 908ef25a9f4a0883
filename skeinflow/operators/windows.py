"""Row-count windows and scores over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rolling_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], measures: dict[str, tuple[str, Column]], rows: int = 350, block: int | None = None) -> DataFrame:
    """Sum, mean or distinct count over the last ``rows`` rows of each key, the current one included.

    ``measures``: output -> ("sum" | "mean" | "distinct", expression). A key may hold any
    share of the rows: with ``block`` (a number of rows per block, at least ``rows``) each
    key's rows are numbered across tasks, windowed in blocks, and each block brings the ``rows`` - 1
    rows before it along.
    """
    how = {"sum": F.sum, "mean": F.avg, "distinct": lambda e: F.size(F.collect_set(e).over(w)), "std": F.stddev_samp}
    work = df
    if block:
        from skeinflow.operators.ranking import distributed_rank

        first = F.floor(F.col(order[0]) / block)
        numbered = distributed_rank(df, keys, [F.col(o) for o in order], first, rank="_n", size="_all")
        own = F.floor((F.col("_n") - 1) / block)
        nxt = F.when((F.col("_n") - 1) % block >= block - rows + 1, F.array(own, own + 1)).otherwise(F.array(own))
        work = numbered.withColumn("_own", own).withColumn("_blk", F.explode(nxt))
        w = W.partitionBy(*keys, "_blk").orderBy("_n").rowsBetween(1 - rows, 0)
    else:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)
    for name, (kind, expr) in measures.items():
        work = work.withColumn(name, how[kind](expr) if kind == "distinct" else how[kind](expr).over(w))
    if block:
        work = work.where(F.col("_own") == F.col("_blk")).drop("_n", "_all", "_own", "_blk")
    return work


#: Ports of the rolling features.
WEB_PORTS, NAME_PORTS = (80, 443, 8080), (53,)
WATCHED_PORTS = (20, 21, 22, 23, 25, 53, 80, 110, 143, 443, 445, 3389, 8080)
#: Rolling counts by pair and by destination: name and the flow feature or protocol code summed.
_PROTOCOLS, _FLAGS = {"tcp": 0.0, "udp": 1.0, "icmp": 2.0}, ("syn", "ack", "fin", "rst", "psh")


def rolling_flow_features(features: DataFrame, rows: int = 350, block: int = 100_000) -> DataFrame:
    """flow_id and 28 rolling features over the last ``rows`` flows of the flow's host pair and of its destination.

    Sixteen sums (flows by protocol, packets by TCP flag), distinct ports of the pair, two mean durations, seven counts of flows to
    web, name (twice, as the vector has it) and watched ports, forward and all packets of the destination. Flows come by start, then id;
    keys of any size are windowed in blocks (see ``rolling_rows``).
    """
    c = F.col

    def among(ports: Sequence[int]) -> Column:
        return c("dst_port").isin([float(p) for p in ports]).cast("double")

    both = {**{f"{n}_flows": (c("proto") == v).cast("double") for n, v in _PROTOCOLS.items()}, **{f"{f}_packets": c(f"n_{f}") for f in _FLAGS}, "web_port": among(WEB_PORTS), "name_port": among(NAME_PORTS), "name_port_2": among(NAME_PORTS)}
    pair = {f"{n}_pair": ("sum", e) for n, e in both.items()} | {"ports_pair": ("distinct", c("dst_port")), "duration_pair": ("mean", c("dur")), "watched_port_pair": ("sum", among(WATCHED_PORTS))}
    target = {f"{n}_dst": ("sum", e) for n, e in both.items()} | {"duration_dst": ("mean", c("dur")), "packets_dst": ("sum", c("fwd_pkts")), "all_packets_dst": ("sum", c("tot_pkts"))}
    order = ["flow_start_ts", "flow_id"]
    need = features.select("flow_id", "flow_start_ts", "src_ip", "dst_ip", "dst_port", "proto", "dur", "fwd_pkts", "tot_pkts", *[f"n_{f}" for f in _FLAGS])
    out = rolling_rows(rolling_rows(need, ["src_ip", "dst_ip"], order, pair, rows, block), ["dst_ip"], order, target, rows, block)
    return out.select("flow_id", *[c(n).cast("double").alias(n) for n in (*pair, *target)])


def min_max(value: Column, over: W) -> Column:
    """Scaled to [0, 1] within a window; a constant gives 0."""
    lo, hi = F.min(value).over(over), F.max(value).over(over)
    return F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(0.0)


def position_score(order: Column, n: Column) -> Column:
    return 1.0 - order / F.greatest(n - 1, F.lit(1))


def length_sequence(df: DataFrame, key: str, order: Sequence[str], signed: Column, size: int = 32) -> DataFrame:
    """key, sequence: the first ``size`` signed lengths in order, padded with 0."""
    ranked = df.select(key, *order, signed.alias("_v")).withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_r") <= size)
    xs = F.transform(F.array_sort(F.collect_list(F.struct("_r", "_v"))), lambda s: s["_v"])
    return ranked.groupBy(key).agg(xs.alias("_x")).select(key, F.concat("_x", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("_x"))).alias("sequence"))


def burst_aggregates(df: DataFrame, key: str, order: Sequence[str], signed: Column) -> DataFrame:
    """Per key over all its rows: counts, sums, mean, deviation and maximum of lengths by direction, and of the gaps in the first order column.

    ``signed`` lengths above 0 are forward, below 0 backward; deviations are of the population, absent values give 0.
    """
    w = W.partitionBy(key).orderBy(*order)
    rows = df.select(key, *order, signed.cast("double").alias("_v")).withColumn("_gap", (F.col(order[0]) - F.lag(order[0]).over(w)).cast("double"))
    fwd, bwd = F.when(F.col("_v") > 0, F.col("_v")), F.when(F.col("_v") < 0, -F.col("_v"))
    stats = {"mean": F.avg, "std": F.stddev_pop, "max": F.max}
    out = [F.count(F.lit(1)).alias("n_packets")]
    for name, v in (("fwd", fwd), ("bwd", bwd)):
        out += [F.count(v).alias(f"{name}_count"), F.coalesce(F.sum(v), F.lit(0.0)).alias(f"{name}_sum")]
    for name, v in (("fwd", fwd), ("bwd", bwd), ("gap", F.col("_gap"))):
        out += [F.coalesce(f(v), F.lit(0.0)).alias(f"{name}_{s}") for s, f in stats.items()]
    return rows.groupBy(key).agg(*out).withColumn("up_down", F.col("fwd_sum") / (F.col("bwd_sum") + 1.0))
