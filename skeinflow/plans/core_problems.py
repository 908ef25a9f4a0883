"""Queries of the general problems: rolling totals, sessions, hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.operators import rolling, sessions, skew
from skeinflow.plans import sqlkit
from skeinflow.sources.tables import flow_states, packet_events, table


def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    rolled = rolling.rolling_totals(rolling.daily_flow_records(flow_states(table(spark, d, "flow_state"))), ["src_host", "dst_port"])
    return rolled.select(
        "src_host", "dst_port", rolling.day_text(F.col("day")).alias("activity_day"), "records",
        "records_7d", F.round("records_7d_avg", 6).alias("records_7d_avg"), "records_30d", F.round("records_30d_avg", 6).alias("records_30d_avg"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling.bursts(rolling.rolling_totals(rolling.daily_flow_records(flow_states(table(spark, d, "flow_state"))), ["src_host", "dst_port"]))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessionize(sessions.activity(flow_states(table(spark, d, "flow_state")), packet_events(table(spark, d, "packet_event"))))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("src_host", "start_ms", "end_ms")


def p4_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("src_host", "start_ms", "end_ms", "duration_ms", "flow_records", "packets")


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    hosts = skew.totals_by_host(flow_states(table(spark, d, "flow_state")))
    both = hosts.unionAll(skew.totals_by_flow(packet_events(table(spark, d, "packet_event"))))
    return both.withColumn("span_ms", F.col("last_ms") - F.col("first_ms"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    states, packets = table(spark, d, "flow_state"), table(spark, d, "packet_event")
    return skew.heavy_keys(skew.totals_by_host(flow_states(states)), states.count()).unionAll(
        skew.heavy_keys(skew.totals_by_flow(packet_events(packets)), packets.count())
    )


QUERIES = {f.__name__: f for f in (p3_rolling, p3_found, p4_found, p4_sessions, p5_totals, p5_found)}

_DAILY = f"""
with fs as ({sqlkit.flow_state()}),
once as (select distinct src_host, dst_port, fid, start_ms from fs where src_host is not null and start_ms is not null and dst_port >= 1),
daily as (select src_host, dst_port, cast(floor(start_ms / 86400000.0) as integer) as dayno, count(*) as records from once group by 1, 2, 3),
ends as (select src_host, dst_port, min(dayno) as lo, max(dayno) as hi from daily group by 1, 2),
cal as (select src_host, dst_port, lo, cast(unnest(range(lo, hi + 1)) as integer) as dayno from ends),
dense as (select c.src_host, c.dst_port, c.lo, c.dayno, coalesce(d.records, 0) as records
          from cal c left join daily d on c.src_host = d.src_host and c.dst_port = d.dst_port and c.dayno = d.dayno),
rolled as (select *, sum(records) over (partition by src_host, dst_port order by dayno rows 6 preceding) as r7,
                     sum(records) over (partition by src_host, dst_port order by dayno rows 29 preceding) as r30 from dense)
"""
_SESSIONS = f"""
with fs as ({sqlkit.flow_state()}), pe as ({sqlkit.packet_event()}),
act as (select src_host, start_ms, end_ms, 1 as f, 0 as p from fs where src_host is not null and start_ms is not null
        union all select src_host, at_ms, at_ms, 0, 1 from pe where src_host is not null and at_ms is not null),
seen as (select *, max(end_ms) over (partition by src_host order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as before from act),
numbered as (select *, sum(case when before is null or start_ms > before + 180000 then 1 else 0 end)
             over (partition by src_host order by start_ms, end_ms rows unbounded preceding) as s from seen)
"""
_TOTALS = f"""
with fs as ({sqlkit.flow_state()}), pe as ({sqlkit.packet_event()}),
tot as (select 'src_ip' as key_field, src_host as key_value, count(*) as n_rows, cast(sum(packet_count) as bigint) as packets,
               cast(null as bigint) as bytes, min(start_ms) as first_ms, max(end_ms) as last_ms from fs group by src_host
        union all
        select 'flow_id', fid, count(*), count(*), cast(sum(case when payload_len_raw >= 0 then payload_len_raw end) as bigint), min(at_ms), max(at_ms)
        from pe group by fid)
"""
ORACLE = {
    "p3_rolling": _DAILY + """select src_host, dst_port, cast(date '1970-01-01' + dayno as varchar) as activity_day, cast(records as bigint) as records,
        cast(r7 as bigint) as records_7d, round(r7 / 7.0, 6) as records_7d_avg, cast(r30 as bigint) as records_30d, round(r30 / 30.0, 6) as records_30d_avg from rolled""",
    "p3_found": _DAILY + """select src_host, dst_port, cast(date '1970-01-01' + dayno as varchar) as activity_day from rolled
        where dayno >= lo + 29 and r7 >= 5 and r7 * 2 > r30""",
    "p4_found": _SESSIONS + "select src_host, min(start_ms) as start_ms, max(end_ms) as end_ms from numbered group by src_host, s",
    "p4_sessions": _SESSIONS + """select src_host, min(start_ms) as start_ms, max(end_ms) as end_ms, max(end_ms) - min(start_ms) as duration_ms,
        cast(sum(f) as bigint) as flow_records, cast(sum(p) as bigint) as packets from numbered group by src_host, s""",
    "p5_totals": _TOTALS + "select *, last_ms - first_ms as span_ms from tot",
    "p5_found": _TOTALS + """select key_field, key_value from tot where key_value is not null
        and n_rows * 100 >= 4 * (case key_field when 'src_ip' then (select count(*) from fs) else (select count(*) from pe) end)""",
}
