"""Driver tables and the canonical views the operators work on.

Each view selects only the columns it needs, so the parquet scan prunes the
rest, and keeps every row: what is missing becomes null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import canon


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flow_states(raw: DataFrame) -> DataFrame:
    """flow_state rows with canonical keys and the interval in milliseconds.

    Columns: state_id, src_host, dst_host, fid, dst_port, packet_count, label, start_ms, end_ms.
    """
    start, end = canon.interval("first_seen", "last_seen")
    return raw.select(
        "state_id",
        canon.host("src_ip").alias("src_host"),
        canon.host("dst_ip").alias("dst_host"),
        canon.flow_id("flow_id").alias("fid"),
        F.col("dst_port").cast("int").alias("dst_port"),
        F.col("packet_count").cast("long").alias("packet_count"),
        canon.label("label").alias("label"),
        start.alias("start_ms"),
        end.alias("end_ms"),
    )


def packet_events(raw: DataFrame) -> DataFrame:
    """packet_event rows with canonical keys and the instant in milliseconds.

    Columns: event_seq, packet_id, src_host, fid, payload, label, at_ms; payload is null where it was not measured.
    """
    size = F.col("payload_len_raw").cast("long")
    return raw.select(
        "event_seq",
        "packet_id",
        canon.host("src_ip").alias("src_host"),
        canon.flow_id("flow_id").alias("fid"),
        F.when(size >= 0, size).alias("payload"),
        canon.label("flow_label").alias("label"),
        canon.millis("timestamp").alias("at_ms"),
    )
