"""Sessions of activity: keyed inactivity timers over ordered, pre-merged events.

Two intervals belong to one session when the later one starts no more than ``gap``
after the latest end so far. That makes sessions the connected unions of intervals
widened by the gap, so merging is associative and can begin before the shuffle:
all activity of a host that starts within one tile of ``gap`` milliseconds is in
one session by itself. ``tiles`` merges it there with map-side combination, which
leaves each host at most one row per tile however many events it has; the timers
then run over tiles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP_MS = 180_000
SESSION_SCHEMA = "src_host string, start_ms long, end_ms long, flow_records long, packets long"


def activity(states: DataFrame, packets: DataFrame) -> DataFrame:
    """Activity rows (src_host, start_ms, end_ms, flow_records, packets) of the canonical views; rows without host or time have none."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    flows = states.select("src_host", "start_ms", "end_ms", one.alias("flow_records"), none.alias("packets"))
    instants = packets.select("src_host", F.col("at_ms").alias("start_ms"), F.col("at_ms").alias("end_ms"), none.alias("flow_records"), one.alias("packets"))
    return flows.unionAll(instants).where(F.col("src_host").isNotNull() & F.col("start_ms").isNotNull())


def tiles(events: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Merge the activity of each host that starts in the same tile of ``gap_ms``; exact, see the module text."""
    return (
        events.groupBy("src_host", F.floor(F.col("start_ms") / gap_ms).alias("_tile"))
        .agg(
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            F.sum("flow_records").alias("flow_records"),
            F.sum("packets").alias("packets"),
        )
        .drop("_tile")
    )


class SessionTimers:
    """Open sessions by key, each with an inactivity timer at its latest end plus the gap.

    ``advance`` takes events ordered by key and start: an event at or before the
    timer joins the session and resets it, a later one finds the timer expired, so
    the session is emitted and a new one opened. ``expire`` fires what is due.
    Whole batches are advanced with array operations, not event by event.
    """

    columns = ("src_host", "start_ms", "end_ms", "flow_records", "packets")

    def __init__(self, gap_ms: int = GAP_MS):
        self.gap_ms = gap_ms
        self.open: pd.DataFrame | None = None

    def advance(self, events: pd.DataFrame) -> pd.DataFrame:
        """Emit the sessions closed by these events; the last session of the last key stays open."""
        if not len(events):
            return self._empty()
        if self.open is not None:
            events = pd.concat([self.open, events], ignore_index=True)
        key = events["src_host"].to_numpy()
        start = events["start_ms"].to_numpy(dtype=np.int64)
        end = events["end_ms"].to_numpy(dtype=np.int64)
        fresh_key = np.ones(len(key), dtype=bool)
        fresh_key[1:] = key[1:] != key[:-1]
        lowest, span = int(end.min()), int(end.max()) - int(end.min()) + 1
        rank = np.cumsum(fresh_key) - 1
        if span * (int(rank[-1]) + 1) < 2**62:  # latest end so far within each key, as one running maximum
            latest = np.maximum.accumulate(end - lowest + rank * span) - rank * span + lowest
        else:
            latest = pd.Series(end).groupby(rank).cummax().to_numpy()
        opens = fresh_key.copy()
        opens[1:] |= start[1:] > latest[:-1] + self.gap_ms
        first = np.flatnonzero(opens)
        made = pd.DataFrame(
            {
                "src_host": key[first],
                "start_ms": start[first],
                "end_ms": np.maximum.reduceat(end, first),
                "flow_records": np.add.reduceat(events["flow_records"].to_numpy(dtype=np.int64), first),
                "packets": np.add.reduceat(events["packets"].to_numpy(dtype=np.int64), first),
            }
        )
        self.open = made.iloc[-1:]
        return made.iloc[:-1]

    def expire(self, now_ms: int | None = None) -> pd.DataFrame:
        """Fire the timer if it is due at ``now_ms`` (None: end of input, every timer is)."""
        if self.open is None or (now_ms is not None and int(self.open["end_ms"].iloc[0]) + self.gap_ms >= now_ms):
            return self._empty()
        out, self.open = self.open, None
        return out

    def _empty(self) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(dtype="object" if c == "src_host" else "int64") for c in self.columns})


def sessionize(events: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Sessions of each host: src_host, start_ms, end_ms, flow_records, packets, duration_ms.

    ``events`` has src_host, start_ms, end_ms, flow_records and packets (see
    ``activity``); rows with a null host or start are left out, a null end is the
    start. Repeated rows count again but never move a session's ends. The order
    of rows and the number of partitions do not change the result. After ``tiles``
    a host brings at most one row per tile, so no task is long for a hot host.
    The streaming form is ``skeinflow.streaming.session_stream``.
    """
    known = events.where(F.col("src_host").isNotNull() & F.col("start_ms").isNotNull())
    known = known.withColumn("end_ms", F.coalesce("end_ms", "start_ms"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        timers = SessionTimers(gap_ms)
        for batch in batches:
            yield timers.advance(batch)
        yield timers.expire()

    ordered = tiles(known, gap_ms).repartition("src_host").sortWithinPartitions("src_host", "start_ms")
    return ordered.select(*SessionTimers.columns).mapInPandas(run, SESSION_SCHEMA).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
