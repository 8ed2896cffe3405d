"""Observations that are still open after their pass: state by observation, with a timer at the pass's end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import expr as X
from ..sources.bronze import TERMINAL

#: The newest version of an observation: its time, its end (milliseconds, null if unknown) and its status.
STATE = "version long, ends long, status string"
OUT = "observation_id long, end_utc timestamp, status string"


def _newer(rows: pd.DataFrame, known: tuple | None) -> tuple:
    """The newest of rows and what is known: by version, then by the later end, a known one first."""
    key = lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")
    own = [(int(v), None if pd.isna(e) else int(e), None if pd.isna(s) else s) for v, e, s in zip(rows["version"], rows["ends"], rows["status"], strict=True)]
    return max([*own, *([known] if known else [])], key=key)


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the newest version; when its end has passed, say whether it is still open, and forget it."""
    known = tuple(state.get) if state.exists else None
    if not state.hasTimedOut:
        for rows in batches:
            known = _newer(rows, known)
    version, ends, status = known
    # once the watermark is past a version, all that still comes is newer
    over = max(version // 1000 + 1, ends or 0)
    if over < state.getCurrentWatermarkMs():
        if state.exists:
            state.remove()
        if ends is not None and (status or "").strip().lower() not in TERMINAL:
            yield pd.DataFrame({"observation_id": [key[0]], "end_utc": [pd.Timestamp(ends, unit="ms")], "status": pd.Series([status], dtype=object)})
    else:
        state.update(known)
        state.setTimeoutTimestamp(over)


def still_open(observations: DataFrame, late: str = "1 hour") -> DataFrame:
    """The id, end and last status of each observation that has no final status when its pass is over, as a stream.

    `observations` has observation_id, snapshot_at_utc (its version and the stream's time), end_utc and status. A pass is over when the
    watermark, `late` behind the newest snapshot, has come to its end and to its newest version; until then newer versions replace
    older ones in whatever order they come. An observation is forgotten then, so that state is bounded by the passes ahead. One that
    comes again afterwards, still open, is said again. Without an end nothing is said.
    """
    known = observations.where("observation_id IS NOT NULL AND snapshot_at_utc IS NOT NULL")
    rows = known.select(F.col("observation_id").cast("long"), F.col("snapshot_at_utc").cast("timestamp").alias("at"), F.unix_micros(F.col("snapshot_at_utc").cast("timestamp")).alias("version"), F.unix_millis(F.col("end_utc").cast("timestamp")).alias("ends"), X.col("status"))
    return rows.withWatermark("at", late).groupBy("observation_id").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
