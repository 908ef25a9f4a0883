"""Rolling totals over trailing days, idle days included."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def day_number(ms: Column) -> Column:
    """UTC days since 1970-01-01 of a time in milliseconds."""
    return F.floor(ms / DAY_MS).cast("int")


def day_text(day: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string")


def densify(daily: DataFrame, keys: Sequence[str], day: str, measures: Sequence[str], end_day: int | None = None) -> DataFrame:
    """One row per key and calendar day from the key's first to its last active day, or to ``end_day`` if that is later.

    Each active day brings the idle days up to the next one along, so the calendar
    of an entity is made from its own rows: no join, and the single shuffle by key
    serves the rolling windows too (``entity_calendar`` is the form with a join; both give the same rows). ``daily`` has one row per key and day; null
    days are left out.
    """
    w = W.partitionBy(*keys).orderBy(day)
    last = F.col(day) if end_day is None else F.greatest(F.col(day), F.lit(end_day))
    until = F.coalesce(F.lead(day).over(w) - 1, last)
    return (
        daily.where(F.col(day).isNotNull())
        .withColumn("_days", F.sequence(F.col(day), until))
        .select(*keys, F.col(day).alias("_active"), *measures, F.explode("_days").alias("_d"))
        .select(*keys, F.col("_d").alias(day), *[F.when(F.col("_d") == F.col("_active"), F.col(m)).otherwise(0).alias(m) for m in measures])
    )


def entity_calendar(daily: DataFrame, keys: Sequence[str], day: str, measures: Sequence[str], end_day: int | None = None) -> DataFrame:
    """The rows of ``densify`` by crossing each key with the days of its own calendar and joining the daily rows to that.

    The crossing is an explode per key, never a cross join of tables; aggregate, explode and join share one partitioning by key.
    """
    known = daily.where(F.col(day).isNotNull())
    last = F.max(day) if end_day is None else F.greatest(F.max(day), F.lit(end_day))
    calendar = known.groupBy(*keys).agg(F.min(day).alias("_first"), last.alias("_last")).select(*keys, F.explode(F.sequence("_first", "_last")).alias(day))
    a, b = calendar.alias("a"), known.alias("b")
    same = reduce(and_, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, day)])
    return a.join(b, same, "left").select(*[F.col(f"a.{c}").alias(c) for c in (*keys, day)], *[F.coalesce(F.col(f"b.{m}"), F.lit(0)).alias(m) for m in measures])


def rolling_totals(
    daily: DataFrame, keys: Sequence[str], day: str = "day", measures: Sequence[str] = ("records",), periods: Sequence[int] = (7, 30), end_day: int | None = None, calendar_join: bool = False
) -> DataFrame:
    """Totals and daily averages of each measure over the trailing ``periods`` days.

    Adds ``<measure>_<n>d`` and ``<measure>_<n>d_avg`` for every period, and
    ``days_known``: how many days of the key's calendar lie in [first day, this day].
    Days before a key's first active day hold nothing, so an average always divides
    by the full length of the period. ``end_day`` carries every key on to that day, while its totals still fall;
    ``calendar_join`` densifies by ``entity_calendar``. Per key there is one row a day, so a key
    that holds a third of all records still brings a window of calendar length.
    Empty input gives no rows; null keys form a group of their own.
    """
    dense = (entity_calendar if calendar_join else densify)(daily, keys, day, measures, end_day)
    order = W.partitionBy(*keys).orderBy(day)
    out = dense.withColumn("days_known", F.row_number().over(order))
    for m in measures:
        for n in periods:
            out = out.withColumn(f"{m}_{n}d", F.sum(m).over(order.rowsBetween(1 - n, 0)))
            out = out.withColumn(f"{m}_{n}d_avg", F.col(f"{m}_{n}d") / F.lit(float(n)))
    return out


def daily_flow_records(states: DataFrame) -> DataFrame:
    """Flow records per source host, destination port and UTC day of the start.

    ``states`` is the canonical flow_state view. Rows without host, time or port
    (null or below 1) do not count; rows equal in host, port, flow id and start
    count once (a null flow id equals another null one).
    """
    known = states.where(F.col("src_host").isNotNull() & F.col("start_ms").isNotNull() & (F.col("dst_port") >= 1))
    once = known.select("src_host", "dst_port", "fid", "start_ms").distinct()
    return once.groupBy("src_host", "dst_port", day_number(F.col("start_ms")).alias("day")).agg(F.count(F.lit(1)).alias("records"))


def bursts(rolled: DataFrame, warm_up: int = 29, at_least: int = 5) -> DataFrame:
    """Days whose trailing week holds at least ``at_least`` records and more than half of the trailing 30 days' records."""
    hit = (F.col("days_known") > warm_up) & (F.col("records_7d") >= at_least) & (F.col("records_7d") * 2 > F.col("records_30d"))
    return rolled.where(hit).select("src_host", "dst_port", day_text(F.col("day")).alias("activity_day"))
