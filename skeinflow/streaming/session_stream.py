"""Sessions on a stream: keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skeinflow.operators.sessions import GAP_MS, SESSION_SCHEMA, SessionTimers

_COLUMNS = list(SessionTimers.columns)
_STATE = "starts array<long>, ends array<long>, flow_records array<long>, packets array<long>"


def _merge_tiles(gap_ms: int):
    """Merge what each batch of a partition holds of a host and tile, so a hot host sends a row per tile and batch instead of its events."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tile = b["start_ms"] // gap_ms
            merged = b.groupby(["src_host", tile.rename("_tile")], sort=False).agg(
                start_ms=("start_ms", "min"), end_ms=("end_ms", "max"), flow_records=("flow_records", "sum"), packets=("packets", "sum"), latest_ms=("start_ms", "max")
            )
            yield merged.reset_index()[[*_COLUMNS, "latest_ms"]]

    return run


def session_stream(events: DataFrame, gap_ms: int = GAP_MS, delay: str = "10 minutes") -> DataFrame:
    """Emit each session of a streaming ``activity`` frame once its timer expires.

    Events of one host and tile of ``gap_ms`` are merged within each Arrow batch before they are
    shuffled (exact, as in the batch form), so the task of a hot host gets tiles, not events.
    State per host: its open sessions, as arrays. An event joins (and may bridge) open
    sessions and resets their timer to the latest end plus the gap; when the
    watermark passes the timer the session is emitted with its start, end and
    counts, and dropped from the state. Tiles whose every event starts before the watermark
    are late and ignored; a late event merged with one that is not may still count. Events may arrive in
    any order within ``delay``; sessions still open when the stream stops stay in
    the checkpoint.
    """
    timed = events.where(F.col("src_host").isNotNull() & F.col("start_ms").isNotNull())
    timed = timed.withColumn("end_ms", F.coalesce("end_ms", "start_ms")).select(*_COLUMNS)
    tiled = timed.mapInPandas(_merge_tiles(gap_ms), f"{SESSION_SCHEMA}, latest_ms long")
    tiled = tiled.withColumn("at", F.timestamp_millis("latest_ms")).withWatermark("at", delay)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = [pd.DataFrame(dict(zip(_COLUMNS, ([key[0]] * len(state.get[0]), *state.get), strict=True)))] if state.exists else []
        fresh = [b.loc[b["latest_ms"] >= now, _COLUMNS] for b in batches]
        rows = pd.concat(held + fresh, ignore_index=True) if held or fresh else pd.DataFrame(columns=_COLUMNS)
        timers = SessionTimers(gap_ms)
        made = timers.advance(rows.sort_values("start_ms", kind="stable"))
        if timers.open is not None:
            made = pd.concat([made, timers.open], ignore_index=True)
        due = made["end_ms"] + gap_ms < now
        left = made[~due]
        if len(left):
            state.update(tuple(left[c].astype("int64").tolist() for c in _COLUMNS[1:]))
            state.setTimeoutTimestamp(max(int(left["end_ms"].min()) + gap_ms + 1, now + 1))
        elif state.exists:
            state.remove()
        yield made[due]

    return tiled.groupBy("src_host").applyInPandasWithState(update, SESSION_SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
