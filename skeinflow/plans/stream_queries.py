"""Queries that run a stream over the tables to its end."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.operators.sessions import activity
from skeinflow.plans.core_problems import _SESSIONS as SESSIONS_SQL
from skeinflow.session import scratch
from skeinflow.sources.tables import flow_states, packet_events
from skeinflow.streaming.flow_stream import run_available, stream_sessions
from skeinflow.streaming.session_stream import session_stream


def _streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a file stream, whether it is one file or a folder of parts."""
    path = f"{d}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if os.path.isdir(path) else f"{d}/{name}.parquet*")


def _drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    base = scratch(spark, name)
    run_available(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_flows(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of events by user that the watermark closed (gap six hours, no delay)."""
    s = stream_sessions(_streamed(spark, d, "events").select("user_id", "ts", "value"), "user_id", "ts", "6 hours", "0 seconds", "value")
    return _drain(spark, s, "stream-flows").withColumn("total", F.round("total", 4))


def stream_host_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Host sessions of problem 4 from the keyed timers on a stream; those still open at its end are not emitted."""
    a = activity(flow_states(_streamed(spark, d, "flow_state")), packet_events(_streamed(spark, d, "packet_event")))
    return _drain(spark, session_stream(a, delay="0 seconds"), "stream-sessions")


QUERIES = {f.__name__: f for f in (stream_flows, stream_host_sessions)}
ORACLE = {
    "stream_host_sessions": SESSIONS_SQL + """, c as (select src_host, min(start_ms) as start_ms, max(end_ms) as end_ms, cast(sum(f) as bigint) as flow_records, cast(sum(p) as bigint) as packets
        from numbered group by src_host, s) select * from c where end_ms + 180000 < (select max(start_ms) from act)""",
    "stream_flows": """with g as (select *, case when lag(ts) over w is null or ts - lag(ts) over w > interval 6 hours then 1 else 0 end as cut from events window w as (partition by user_id order by ts)),
        s as (select *, sum(cut) over (partition by user_id order by ts rows unbounded preceding) as n from g),
        f as (select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts) + interval 6 hours) as end_us, count(*) as n_events, round(sum(value), 4) as total from s group by user_id, n)
        select * from f where end_us <= (select (epoch_us(max(ts)) // 1000) * 1000 from events)""",
}
