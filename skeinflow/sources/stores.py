"""Stores: graph artifacts, splits, append logs with manifest, sealing and retention."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.operators.ranking import distributed_rank

VERSION = "v3"


def write_artifact(path: str, nodes: Mapping[str, DataFrame], edges: DataFrame, meta: Mapping[str, str]) -> None:
    """Node tables by type, edges partitioned by relation, and one metadata row."""
    for kind, df in nodes.items():
        df.write.mode("overwrite").parquet(os.path.join(path, "nodes", kind))
    edges.write.mode("overwrite").partitionBy("rel").parquet(os.path.join(path, "edges"))
    rows = [(k, str(v)) for k, v in {**meta, "version": VERSION}.items()]
    edges.sparkSession.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "meta"))


def read_artifact(spark: SparkSession, path: str, kinds: list[str]) -> tuple[dict[str, DataFrame], DataFrame, dict[str, str]]:
    """Nodes, edges and metadata; a version other than ``VERSION`` is refused."""
    meta = {r["key"]: r["value"] for r in spark.read.parquet(os.path.join(path, "meta")).collect()}
    if meta.get("version") != VERSION:
        raise ValueError(f"artifact version {meta.get('version')!r}, expected {VERSION!r}")
    return {k: spark.read.parquet(os.path.join(path, "nodes", k)) for k in kinds}, spark.read.parquet(os.path.join(path, "edges")), meta


def write_adjacency(edges: DataFrame, path: str) -> None:
    """Edges (rel, src, dst, ...) by relation, in ranges of ``src`` and sorted by (src, dst) within: readers of few nodes skip the other row groups."""
    ordered = edges.repartitionByRange("rel", "src").sortWithinPartitions("rel", "src", "dst")
    ordered.write.mode("overwrite").partitionBy("rel").parquet(path)


def neighbours_of(spark: SparkSession, path: str, rel: str, nodes: list) -> DataFrame:
    """The edges of a relation that leave the given nodes (a short list, pushed down to the files)."""
    return spark.read.parquet(path).where((F.col("rel") == rel) & F.col("src").isin(nodes))


def write_splits(path: str, splits: DataFrame) -> None:
    """Long table (protocol, split, flow_id)."""
    splits.select("protocol", "split", "flow_id").write.mode("overwrite").partitionBy("protocol").parquet(path)


def read_splits(spark: SparkSession, path: str, protocol: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("protocol") == protocol).select("split", "flow_id")


def append_log(df: DataFrame, path: str, ts: str = "ts", shard_hours: int = 1, most_rows: int | None = None, key: str | None = None) -> None:
    """Append rows as JSON lines in shards by event time (folder ``shard=yyyymmddThhZ``).

    With ``most_rows`` a shard is sealed at that many rows, in order of time and ``key`` (unique), and the next ones go to ``-0001`` and so on.
    """
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / (3600 * shard_hours)) * 3600 * shard_hours)
    rows = df.withColumn("shard", F.date_format(start, "yyyyMMdd'T'HH'Z'"))
    if most_rows:
        ranked = distributed_rank(rows, ["shard"], [ts, key], F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 60), "_rank", "_all")
        part = F.floor((F.col("_rank") - 1) / most_rows)
        rows = ranked.withColumn("shard", F.when(part > 0, F.concat_ws("-", "shard", F.lpad(part.cast("string"), 4, "0"))).otherwise(F.col("shard"))).drop("_rank", "_all")
    rows.write.mode("append").partitionBy("shard").json(path)


def read_log(spark: SparkSession, path: str, schema: str, since: str | None = None) -> DataFrame:
    """Log rows; blank and broken lines are skipped. ``since`` (a shard name) prunes folders."""
    df = spark.read.schema(schema + ", shard string").option("mode", "DROPMALFORMED").json(path)
    return df.where(F.col("shard") >= since) if since else df


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def shards(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(shard, bytes) in order of time."""
    where, fs = _fs(spark, path)
    if not fs.exists(where):
        return []
    found = [s for s in fs.listStatus(where) if s.isDirectory() and s.getPath().getName().startswith("shard=")]
    return sorted((s.getPath().getName()[6:], fs.getContentSummary(s.getPath()).getLength()) for s in found)


def retain(spark: SparkSession, path: str, oldest: str | None = None, quota_bytes: int | None = None) -> list[str]:
    """Drop shards before ``oldest`` and the oldest ones beyond the quota; the newest (unsealed) shard always stays."""
    there = shards(spark, path)
    doomed, held = [], there[:-1]
    total = sum(n for _, n in there)
    for name, n in held:
        if (oldest and name < oldest) or (quota_bytes is not None and total > quota_bytes):
            doomed.append(name)
            total -= n
    for name in doomed:
        where, fs = _fs(spark, os.path.join(path, f"shard={name}"))
        fs.delete(where, True)
    return doomed


def sealed(df: DataFrame, newest: str) -> DataFrame:
    """Rows of all shards before the newest one."""
    return df.where(F.col("shard") < newest)


def upsert(current: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """Latest row per key over a table and its updates (ties: the update wins)."""
    both = current.withColumn("_u", F.lit(0)).unionByName(updates.withColumn("_u", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c not in (key, "_u")]
    best = both.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(version, "_u")).alias("r"))
    return best.select(key, "r.*")


def pending(items: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Items not yet in the manifest: what a resumed run still has to do."""
    return items.join(manifest.select(key).distinct(), key, "left_anti")
