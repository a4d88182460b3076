"""The sliding rate limit over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.state import accepted

OUT = "session_id string, ts timestamp, accepted boolean"


def rate_limited(stream: DataFrame, limit: int = 30, window_s: float = 60.0) -> DataFrame:
    """session_id, ts, accepted of a stream of (session_id, ts). The state of a
    session is its accepted times of the last window; it ends when idle."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts")
        seconds = [t.timestamp() for t in rows["ts"]]
        ok, held = accepted(seconds, limit, window_s, held)
        state.update((held,))
        state.setTimeoutDuration(int(window_s * 1000))
        yield pd.DataFrame({"session_id": key[0], "ts": rows["ts"].to_numpy(), "accepted": ok})

    grouped = stream.groupBy("session_id")
    return grouped.applyInPandasWithState(step, OUT, "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
