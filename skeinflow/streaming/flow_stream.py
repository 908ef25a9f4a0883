"""Online flow tracking on Structured Streaming.

Late data: the watermark trails the newest event time by ``delay``; events older
than it are dropped, and a session is emitted once the watermark passes its end plus the gap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zoned(df: DataFrame, ts: str) -> DataFrame:
    """Zone-less timestamps as UTC instants, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_sessions(events: DataFrame, key: str, ts: str, gap: str, delay: str, value: str) -> DataFrame:
    """key, start_us, end_us (last event plus gap), n_events, total of each closed session."""
    timed = zoned(events, ts).withWatermark(ts, delay)
    s = timed.groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("total"))
    return s.select(key, F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n_events", "total")


def stream_fan_out(packets: DataFrame, window: str, delay: str, approximate: bool = False) -> DataFrame:
    """Packets, SYN packets and distinct targets per source and tumbling window, exactly unless ``approximate``.

    The exact form first counts per target, so its state is one row per source, window and target until the watermark
    closes the window, and then counts those rows; the approximate one holds a sketch per source and window.
    """
    timed = packets.withWatermark("at", delay)
    syn = F.sum((F.col("flags").bitwiseAND(2) > 0).cast("long"))
    if approximate:
        return timed.groupBy("src_ip", F.window("at", window)).agg(F.count(F.lit(1)).alias("n_packets"), syn.alias("n_syn"), F.approx_count_distinct("dst_ip").alias("n_targets"))
    each = timed.groupBy("src_ip", "dst_ip", F.window("at", window)).agg(F.count(F.lit(1)).alias("n"), syn.alias("s"))
    return each.groupBy("src_ip", F.window("window", window)).agg(F.sum("n").alias("n_packets"), F.sum("s").alias("n_syn"), F.count(F.lit(1)).alias("n_targets"))


def enrich(stream: DataFrame, static: DataFrame, on: str) -> DataFrame:
    """Stream-static left join; the static side is re-planned per batch, broadcast only if it is small."""
    return stream.join(static, on, "left")


def alert_sink(path: str, threshold: float) -> Callable[[DataFrame, int], None]:
    """foreachBatch function writing alerts once: a batch replayed after a failure overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.where(F.col("score") >= threshold).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all there is now into parquet and stop; a second call goes on where this one ended."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
