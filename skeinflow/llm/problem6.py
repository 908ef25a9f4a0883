"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinflow.functions import canon
from skeinflow.llm import radix
from skeinflow.operators.rolling import day_number, day_text
from skeinflow.plans import sqlkit
from skeinflow.session import materialize
from skeinflow.sources.tables import table

PROBS = (0.25, 0.5, 0.75, 0.9, 0.99)
GROUPS = ["metric", "label", "stat_key"]


def measurements(spark: SparkSession, d: str) -> DataFrame:
    """metric, label, stat_key, day, value of everything measured; day is null where the time is."""
    context, packets = table(spark, d, "flow_context"), table(spark, d, "packet_event")
    day = F.datediff(F.col("captured_at").cast("date"), F.lit("1970-01-01").cast("date")).cast("int").alias("day")
    label = canon.label("label").alias("label")
    none = F.lit(None).cast("string").alias("stat_key")
    stats = context.select(label, day, F.explode("flow_feature_stats").alias("stat_key", "v")).select(
        F.lit("flow_feature_stats").alias("metric"), "label", "stat_key", "day", canon.measured("v").alias("value")
    )
    durations = context.select(F.lit("duration_seconds").alias("metric"), label, none, day, canon.measured("duration_seconds").alias("value"))
    size = F.col("payload_len_raw")
    payloads = packets.select(
        F.lit("payload_len_raw").alias("metric"), canon.label("flow_label").alias("label"), none,
        day_number(canon.millis("timestamp")).alias("day"), F.when(size >= 0, size.cast("double")).alias("value"),
    )
    return stats.unionAll(durations).unionAll(payloads).where(F.col("value").isNotNull())


def _day_states(spark: SparkSession, d: str) -> DataFrame:
    return materialize(radix.state(measurements(spark, d), [*GROUPS, "day"]), "radix-states")


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Single days from their states (bounded error), and the union of all days exactly: its merged states refined."""
    days = _day_states(spark, d)
    single = radix.read(days.where(F.col("day").isNotNull()), [*GROUPS, "day"], PROBS)
    whole = radix.select(measurements(spark, d), GROUPS, PROBS, first=radix.merge(days, GROUPS), keep=lambda t: materialize(t, "radix-targets"))
    cols = [*GROUPS, "n_values", "prob", "value", "max_relative_error"]
    return single.select(day_text(F.col("day")).alias("day"), *cols).unionAll(whole.select(F.lit(None).cast("string").alias("day"), *cols))


def p6_merged(spark: SparkSession, d: str) -> DataFrame:
    """The union of all days from merged states alone, without another pass over the values."""
    return radix.read(radix.merge(_day_states(spark, d), GROUPS), GROUPS, PROBS)


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of single days, and how many of them lie farther from the exact nearest-rank value than the stated error; its twin holds what must come out."""
    own = [*GROUPS, "day"]
    values = measurements(spark, d).where(F.col("day").isNotNull())
    single = radix.read(radix.state(values, own), own, PROBS)
    ranked = values.withColumn("_r", F.row_number().over(W.partitionBy(*own).orderBy("value")))
    cells = single.withColumn("_r", F.greatest(F.lit(1), F.ceil(F.col("prob") * F.col("n_values")))).alias("a")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in own] + [F.col("a._r") == F.col("b._r")]
    exact = cells.join(ranked.withColumnRenamed("value", "exact").alias("b"), same, "left")
    off = ~F.coalesce(F.abs(F.col("a.value") - F.col("exact")) <= F.col("max_relative_error") * F.abs("exact"), F.lit(False))
    return exact.groupBy(F.col("a.metric").alias("metric")).agg(F.count(F.lit(1)).alias("n_percentiles"), F.count_if(off).alias("n_beyond_error"))


QUERIES = {f.__name__: f for f in (p6_percentiles, p6_merged, p6_check)}

_ok = "{0} is not null and not isnan({0}) and not isinf({0}) and {0} <> -1"
_VALUES = f"""
with probs as (select unnest([{", ".join(f"{p}::double" for p in PROBS)}]) as prob),
entries as (select label, captured_at, unnest(map_entries(flow_feature_stats)) as kv from flow_context),
vals as (
  select 'flow_feature_stats' as metric, nullif(lower(trim(label)), '') as label, kv.key as stat_key, cast(captured_at as date) as dt, kv.value as value
  from entries where {_ok.format('kv.value')}
  union all select 'duration_seconds', nullif(lower(trim(label)), ''), null, cast(captured_at as date), duration_seconds from flow_context
  where {_ok.format('duration_seconds')}
  union all select 'payload_len_raw', nullif(lower(trim(flow_label)), ''), null,
    date '1970-01-01' + cast(floor(({sqlkit.millis('"timestamp"')}) / 86400000.0) as integer), payload_len_raw::double
  from packet_event where payload_len_raw >= 0)
"""


def _ranked(by: str) -> str:
    return f"""(select *, row_number() over (partition by {by} order by value) as r, count(*) over (partition by {by}) as n from vals)"""


def _middle(v: str) -> str:
    """The middle of the first digit's range, for normal doubles."""
    e = f"(floor(log2(abs({v}))) + (case when abs({v}) / pow(2.0, floor(log2(abs({v})))) >= 2 then 1 when abs({v}) / pow(2.0, floor(log2(abs({v})))) < 1 then -1 else 0 end))"
    m = f"(abs({v}) / pow(2.0, {e}) - 1)"
    cell = f"case when {v} > 0 then floor({m} * 512.0) + 0.5 else ceil({m} * 512.0) - 0.5 end"
    return f"case when {v} = 0 then 0.0 else sign({v}) * pow(2.0, {e}) * (1 + ({cell}) / 512.0) end"


ORACLE = {
    "p6_percentiles": _VALUES + f"""
select cast(dt as varchar) as day, metric, label, stat_key, n as n_values, prob, {_middle('value')} as value, {radix.RELATIVE_ERROR}::double as max_relative_error
from {_ranked('metric, label, stat_key, dt')}, probs where dt is not null and r = greatest(1, ceil(prob * n))
union all
select null, metric, label, stat_key, n, prob, value, 0.0::double from {_ranked('metric, label, stat_key')}, probs where r = greatest(1, ceil(prob * n))""",
    "p6_check": _VALUES + f"select metric, count(*) as n_percentiles, 0::bigint as n_beyond_error from (select distinct metric, label, stat_key, dt from vals where dt is not null), (select unnest([{', '.join(f'{p}::double' for p in PROBS)}]) as p) group by 1",
    "p6_merged": _VALUES + f"""
select metric, label, stat_key, n as n_values, prob, {_middle('value')} as value, {radix.RELATIVE_ERROR}::double as max_relative_error
from {_ranked('metric, label, stat_key')}, probs where r = greatest(1, ceil(prob * n))""",
}
