"""Hot buffer of the packets of live flows: keyed state with a time to live and a cap per flow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A packet in the state, with what its flow let go so far and when the flow's timer is due.
_COLUMNS = ["flow_id", "at_ms", "seq", "size", "n_dropped", "due_ms"]
_LEAST = -(2**63)
HELD = "flow_id string, n_held long, bytes_held long, oldest_ms long, newest_ms long, n_dropped long"


def hot_flows(packets: DataFrame, ttl_ms: int = 60_000, most: int = 256, delay: str = "0 seconds", buckets: int = 1024, block: int = 100_000) -> DataFrame:
    """What the buffer holds of a flow after each batch that brings packets of it: number, bytes, times, and how many it let go so far.

    ``packets`` is a stream of flow_id, at_ms, seq, size. A flow keeps its packets of the last ``ttl_ms`` before its newest one, the newest ``most``
    of them (ties by seq, a missing one first), so its state is bounded; what is older or beyond the cap is dropped and the totals are computed anew. An event-time timer
    drops what has expired when no packets come, and the flow with the last of them. Rows without flow or time are left out; a missing size counts as 0.

    A call of Python costs more than the few packets of most flows, so the state is keyed by ``buckets`` hashes of the flow, each with the packets and timers
    of its flows as one Arrow table, and all flows of a bucket are worked on at once. ``buckets`` is fixed by the checkpoint. A bucket's new packets
    are taken in by ``block`` rows, or as many as it holds by then, so a hot flow never lies in memory whole.
    """
    long = {"at_ms": F.col("at_ms").cast("long"), "seq": F.coalesce(F.col("seq").cast("long"), F.lit(_LEAST)), "size": F.coalesce(F.col("size").cast("long"), F.lit(0))}
    timed = packets.where(F.col("flow_id").isNotNull() & F.col("at_ms").isNotNull()).select("flow_id", *(c.alias(k) for k, c in long.items()))
    timed = timed.withColumns({"bucket": F.pmod(F.xxhash64("flow_id"), F.lit(buckets)), "at": F.timestamp_millis("at_ms")}).withWatermark("at", delay)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        parts = [_unpack(state.get[0])] if state.exists else []
        held = waiting = 0
        for b in () if state.hasTimedOut else batches:
            parts.append(_marked({c: b[c].to_numpy() for c in _COLUMNS[:4]}, True))
            waiting += len(b)
            if waiting >= max(block, held):
                parts = [_kept(parts, ttl_ms, most)[0]]
                held, waiting = len(parts[0]["at_ms"]), 0
        rows, told = _kept(parts, ttl_ms, most, now)
        if len(rows["at_ms"]):
            state.update((_pack(rows),))
            state.setTimeoutTimestamp(max(int(rows["due_ms"].min()), now + 1))
        elif state.exists:
            state.remove()
        if len(told["flow_id"]):
            yield pd.DataFrame(told)

    return timed.groupBy("bucket").applyInPandasWithState(update, HELD, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def _marked(rows: dict[str, np.ndarray], fresh: bool) -> dict[str, np.ndarray]:
    n = len(rows["at_ms"])
    return {c: np.zeros(n, "int64") for c in _COLUMNS} | rows | {"fresh": np.full(n, fresh)}


def _kept(parts: list[dict[str, np.ndarray]], ttl_ms: int, most: int, now: int | None = None) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The packets that flows keep, by flow and time, and the ``HELD`` columns of flows with fresh packets.

    With the watermark ``now``, flows without fresh packets whose timer is due also drop what has expired, and timers are set anew.
    """
    rows = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]} if parts else _marked({"at_ms": np.empty(0, "int64")}, False)
    if not len(rows["at_ms"]):
        return rows, {"flow_id": rows["flow_id"]}
    flow = pd.factorize(rows["flow_id"])[0]
    order = np.lexsort((rows["seq"], rows["at_ms"], flow))
    rows, flow = {c: v[order] for c, v in rows.items()}, flow[order]
    at, last = rows["at_ms"], np.flatnonzero(np.diff(flow, append=-1))
    n = np.diff(last, prepend=-1)
    first = last - n + 1
    fresh, due = np.logical_or.reduceat(rows["fresh"], first), np.maximum.reduceat(rows["due_ms"], first)
    expired = ~fresh & (due < now) if now is not None else np.zeros(len(n), bool)
    newest = np.where(expired, now or 0, at[last])
    stays = np.repeat(~fresh & ~expired, n) | (at > np.repeat(newest - ttl_ms, n)) & (np.repeat(last, n) - np.arange(len(at)) < most)
    n_held = np.add.reduceat(stays.astype("int64"), first)
    dropped = np.maximum.reduceat(rows["n_dropped"], first) + n - n_held
    oldest = at[np.minimum(last - n_held + 1, last)]
    if now is not None:
        due = np.where(fresh | expired, np.maximum(oldest + ttl_ms, now + 1), due)
    told = {"flow_id": rows["flow_id"][last], "n_held": n_held, "bytes_held": np.add.reduceat(np.where(stays, rows["size"], 0), first), "oldest_ms": oldest, "newest_ms": at[last], "n_dropped": dropped}
    kept = {c: v[stays] for c, v in rows.items()} | {c: np.repeat(v, n_held) for c, v in (("n_dropped", dropped), ("due_ms", due), ("fresh", fresh))}
    return kept, {c: v[fresh & (n_held > 0)] for c, v in told.items()}


def _pack(rows: dict[str, np.ndarray]) -> bytes:
    """The state of a bucket as an Arrow stream; compressed, as ids, counts and timers repeat within a flow."""
    batch = pa.record_batch([pa.array(rows[c]) for c in _COLUMNS], _COLUMNS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(state: bytes) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(bytes(state)).read_next_batch()
    return _marked({c: batch.column(c).to_numpy(zero_copy_only=False) for c in _COLUMNS}, False)
