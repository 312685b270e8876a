"""Gap actions as a stream, with state and timers kept for each cache key.

A request is an action that some plan names, and what became of it if it is
tried. The state of its key says whether it is tried, waits or is a cache hit.
One that waits comes up again by a timer when its interval is over, unless its
key has succeeded by then.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REQUEST = "cache_key string, action_id string, asked_at timestamp, min_interval_seconds int, succeeds boolean"
OUT = "cache_key string, action_id string, status string, at timestamp, next_eligible_at timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(time: pd.Timestamp) -> int:
    return int(time.timestamp() * 1000)


def _time(ms: int | None) -> datetime | None:
    return None if ms is None else datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


class Attempts(StatefulProcessor):
    """Value state (succeeded, last attempt) and a list of what waits, for one cache key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "succeeded boolean, last long")
        self.waiting = handle.getListState("waiting", "action_id string, eligible long, succeeds boolean")

    def _try(self, key: str, action: str, at: int, succeeds: bool) -> tuple:
        self.known.update((bool(succeeds), at))
        return key, action, "SUCCEEDED" if succeeds else "FAILED", _time(at), None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["asked_at", "action_id"])
        out = []
        for r in own.itertuples(index=False):
            at, wait = _ms(r.asked_at), int(r.min_interval_seconds) * 1000
            succeeded, last = self.known.get() if self.known.exists() else (False, None)
            if succeeded:
                out.append((key[0], r.action_id, "CACHE_HIT", _time(at), None))
            elif last is not None and wait and at < last + wait:
                self.waiting.appendValue((r.action_id, last + wait, bool(r.succeeds)))
                self.handle.registerTimer(last + wait)
                out.append((key[0], r.action_id, "SCHEDULED", _time(at), _time(last + wait)))
            else:
                out.append(self._try(key[0], r.action_id, at, r.succeeds))
        yield pd.DataFrame(out, columns=["cache_key", "action_id", "status", "at", "next_eligible_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        out, rest = [], []
        for action, eligible, succeeds in held:
            if eligible > now:
                rest.append((action, eligible, succeeds))
                continue
            succeeded = self.known.exists() and self.known.get()[0]
            out.append((key[0], action, "CACHE_HIT", _time(now), None) if succeeded else self._try(key[0], action, now, succeeds))
        self.waiting.clear()
        for x in rest:
            self.waiting.appendValue(x)
        if out:
            yield pd.DataFrame(out, columns=["cache_key", "action_id", "status", "at", "next_eligible_at"])

    def close(self) -> None:
        pass


def attempted(requests: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """A stream of REQUEST rows to what became of each; timers go by event time.

    The session's state store must be the one in ``PROVIDER``.
    """
    timed = requests.withWatermark("asked_at", delay)
    return timed.groupBy("cache_key").transformWithStateInPandas(statefulProcessor=Attempts(), outputStructType=OUT, outputMode="append", timeMode="eventTime")
