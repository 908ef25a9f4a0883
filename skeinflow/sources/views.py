"""Readings of the driver tables as the domain inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import canon
from skeinflow.plans import sqlkit
from skeinflow.sources.tables import table


def protocol_code(c: str) -> F.Column:
    p = F.upper(F.trim(c))
    return F.when(p.isin("TCP", "6"), 0).when(p.isin("UDP", "17"), 1).when(p.isin("ICMP", "1"), 2).otherwise(3)


def packets(spark: SparkSession, d: str) -> DataFrame:
    """packet_event as the packet table; every third packet is read as a reply, flag bits come from event_seq."""
    src, dst = canon.host("src_ip"), canon.host("dst_ip")
    sp, dp = (F.coalesce(F.col(p), F.lit(-1)) for p in ("src_port", "dst_port"))
    reply = F.col("event_seq") % 3 == 0
    size = F.greatest(F.lit(0), F.coalesce("payload_len_raw", F.lit(0)))
    rows = table(spark, d, "packet_event").select(
        F.col("event_seq").alias("seq"), (canon.millis("timestamp") / 1000.0).alias("ts"), src.alias("s"), dst.alias("t"), sp.alias("sp"), dp.alias("tp"),
        protocol_code("protocol").alias("proto"), (F.col("event_seq") % 64).cast("int").alias("flags"), size.alias("payload_len"), (size + 40).alias("ip_len"),
        canon.label("flow_label", "unknown").alias("label"), reply.alias("r"),
    )
    rows = rows.where(F.col("s").isNotNull() & F.col("t").isNotNull() & F.col("ts").isNotNull())

    def turned(a: str, b: str) -> F.Column:
        return F.when(F.col("r"), F.col(b)).otherwise(F.col(a))

    return rows.select(
        "seq", "ts", turned("s", "t").alias("src_ip"), turned("t", "s").alias("dst_ip"), turned("sp", "tp").alias("src_port"), turned("tp", "sp").alias("dst_port"),
        "proto", "flags", "ip_len", "payload_len", "label",
    )


PACKETS_SQL = f"""
pkt_raw as (select event_seq as seq, ({sqlkit.millis('"timestamp"')}) / 1000.0 as ts, {sqlkit.host('src_ip')} as s, {sqlkit.host('dst_ip')} as t,
  coalesce(src_port, -1) as sp, coalesce(dst_port, -1) as tp,
  case when upper(trim(protocol)) in ('TCP', '6') then 0 when upper(trim(protocol)) in ('UDP', '17') then 1 when upper(trim(protocol)) in ('ICMP', '1') then 2 else 3 end as proto,
  cast(event_seq % 64 as integer) as flags, greatest(0, coalesce(payload_len_raw, 0)) as payload_len,
  coalesce(nullif(lower(trim(flow_label)), ''), 'unknown') as label, event_seq % 3 = 0 as r from packet_event),
pkt as (select seq, ts, case when r then t else s end as src_ip, case when r then s else t end as dst_ip,
  case when r then tp else sp end as src_port, case when r then sp else tp end as dst_port, proto, flags, payload_len + 40 as ip_len, payload_len, label
  from pkt_raw where s is not null and t is not null and ts is not null)
"""

FLOWED_SQL = """
keyed as (select *, src_ip || ':' || src_port as ea, dst_ip || ':' || dst_port as eb from pkt),
keyed2 as (select *, label || '|' || least(ea, eb) || '|' || greatest(ea, eb) || '|' || proto as key, ea <= eb as low_first from keyed),
cuts as (select *, case when lag(ts) over w is null or ts - lag(ts) over w > 30.0 then 1 else 0 end as cut from keyed2 window w as (partition by key order by ts, seq)),
segs as (select *, cast(sum(cut) over (partition by key order by ts, seq rows unbounded preceding) as bigint) as segment from cuts),
poss as (select *, row_number() over (partition by key, segment order by ts, seq) - 1 as pos from segs),
chunked as (select *, cast(pos // {chunk} as bigint) as chunk from poss),
named as (select *, key || '#' || segment || '.' || chunk as flow_id from chunked),
flowed as (select *, low_first = first_value(low_first) over (partition by flow_id order by ts, seq) as is_fwd from named)
"""


def flowed_sql(chunk: str = "256") -> str:
    return f"{PACKETS_SQL}, {FLOWED_SQL.replace('{chunk}', chunk)}"


def _stat_sql(value: str, name: str, when: str = "true", total: bool = True) -> str:
    v = f"case when {when} then {value}::double end"
    parts = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"} | ({"sum": "sum"} if total else {})
    return ", ".join(f"coalesce({f}({v}), 0.0) as {name}_{k}" for k, f in parts.items())


def features_sql() -> str:
    """CTEs up to ``feats``: the flow features of the packet view."""
    flags = {"syn": 2, "ack": 16, "fin": 1, "rst": 4, "psh": 8, "urg": 32}
    counts = ", ".join(f"sum(case when flags & {m} > 0 and proto = 0 then 1.0 else 0.0 end) as n_{f}" for f, m in flags.items())
    firsts = ", ".join(f"arg_min({c}, (ts, seq)) as {c}" for c in ("label", "proto", "src_port", "dst_port", "src_ip", "dst_ip"))
    rates = ", ".join(f"n_{f} / greatest(tot_pkts, 1.0) as r_{f}" for f in flags)

    def fan(s: str, w: float) -> str:
        return f"""fan{s} as (select src_ip as fsrc, floor(ts / {w}) as bin, count(distinct dst_ip) as fan_dst_ip{s}, count(distinct dst_port) as fan_dst_port{s},
          count(distinct regexp_extract(dst_ip, '^(.*)\\.[^.]*$', 1)) as fan_dst_subnet{s}, sum(case when flags & 2 > 0 and proto = 0 then 1 else 0 end) as fan_syn{s},
          count(ts) as fan_pkts{s} from flowed group by 1, 2)"""

    def picked(s: str, w: float) -> str:
        names = ("fan_dst_ip", "fan_dst_port", "fan_dst_subnet", "fan_syn", "fan_pkts")
        return ", ".join(f"coalesce(f{s or 'l'}.{n}{s}::double, 0.0) as {n}{s}" for n in names) + f", coalesce(f{s or 'l'}.fan_pkts{s}::double, 0.0) / {w} as fan_rate_pkts{s or '_60s'}"

    return f"""{flowed_sql()},
iats as (select *, ts - lag(ts) over (partition by flow_id order by ts, seq) as iat, ts - lag(ts) over (partition by flow_id, is_fwd order by ts, seq) as iat_side from flowed),
agg as (select flow_id, {firsts}, count(*)::double as tot_pkts, sum(case when is_fwd then 1.0 else 0.0 end)::double as fwd_pkts, sum(ip_len)::double as tot_bytes,
  sum(case when is_fwd then ip_len else 0 end)::double as fwd_bytes, min(ts) as flow_start_ts, max(ts) as ts_end,
  {_stat_sql('ip_len', 'plen')}, {_stat_sql('ip_len', 'plen_fwd', 'is_fwd')}, {_stat_sql('ip_len', 'plen_bwd', 'not is_fwd')}, {_stat_sql('payload_len', 'plen_pay')},
  {_stat_sql('iat', 'iat', total=False)}, {_stat_sql('iat_side', 'iat_fwd', 'is_fwd', False)}, {_stat_sql('iat_side', 'iat_bwd', 'not is_fwd', False)}, {counts}
  from iats group by flow_id),
derived as (select *, tot_pkts - fwd_pkts as bwd_pkts, tot_bytes - fwd_bytes as bwd_bytes, ts_end - flow_start_ts as dur from agg),
rated as (select *, tot_bytes / greatest(dur, 1e-6) as bytes_per_s, tot_pkts / greatest(dur, 1e-6) as pkts_per_s, fwd_pkts / greatest(dur, 1e-6) as fwd_pkts_per_s,
  bwd_pkts / greatest(dur, 1e-6) as bwd_pkts_per_s, bwd_pkts / greatest(fwd_pkts, 1.0) as down_up_ratio, tot_bytes / greatest(tot_pkts, 1.0) as mean_pkt_size,
  plen_fwd_mean - plen_bwd_mean as mean_ip_len_fwd_minus_bwd, {rates} from derived),
{fan('', 60.0)}, {fan('_5s', 5.0)},
feats as (select r.*, {picked('', 60.0)}, {picked('_5s', 5.0)} from rated r
  left join fan fl on fl.fsrc = r.src_ip and fl.bin = floor(r.flow_start_ts / 60.0)
  left join fan_5s f_5s on f_5s.fsrc = r.src_ip and f_5s.bin = floor(r.flow_start_ts / 5.0))
"""
