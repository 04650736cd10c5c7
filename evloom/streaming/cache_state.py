"""The search cache as state of a stream: entries are put and asked for as events, and go when they are too old."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.config import SearchConfig

#: Events: put has results_json, get has request_id.
EVENT = "cache_key string, kind string, at timestamp, results_json string, request_id string"
ANSWER = "request_id string, cache_key string, at timestamp, results_json string, hit boolean"


def answers(events: DataFrame, hours: int = SearchConfig().cache_hours, delay: str = "1 hour") -> DataFrame:
    """ANSWER rows for the gets among events (EVENT), as cache.lookup() has them over cache.upsert() of the puts up to then: an entry is good for so many hours, and of
    several of a key the latest counts. Events of a key are taken in order of time, puts first, within a batch; those that are later than delay are dropped. An
    entry's state goes once the watermark says that no get can be answered from it. One key's events of a batch are one group."""
    life = pd.Timedelta(hours=hours)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        made, body = (pd.Timestamp(state.get[0], unit="us"), state.get[1]) if state.exists else (None, None)
        rows = pd.concat(list(frames), ignore_index=True)
        rows["get"] = rows["kind"] == "get"
        out = []
        for r in rows.sort_values(["at", "get", "results_json"], kind="stable").itertuples():
            if not r.get:
                if made is None or r.at >= made:
                    made, body = r.at, r.results_json
            else:
                hit = made is not None and r.at - life <= made <= r.at
                out.append((r.request_id, key[0], r.at, body if hit else None, hit))
        if made is not None:
            state.update((made.value // 1000, body))
            end = int((made + life).value // 1_000_000) + 1
            if end > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(end)
            else:
                state.remove()
        yield pd.DataFrame(out, columns=["request_id", "cache_key", "at", "results_json", "hit"])

    marked = events.withWatermark("at", delay)
    return marked.groupBy("cache_key").applyInPandasWithState(step, ANSWER, "made long, body string", "append", GroupStateTimeout.EventTimeTimeout)
