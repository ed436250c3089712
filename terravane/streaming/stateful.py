"""Streams that remember: alerts that are not repeated for a while, an inbox that knows what it has, lookups with an age.

The streams keep one small value for each key in Spark's state store, and let
it go when the stream's time has passed what it is needed for.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terravane.sources.shared import forget, stored
from terravane.streaming.log import THROTTLE_S

_ALERT = "alert_type string, detail string, alert_ts timestamp"


def throttled(alerts: DataFrame, seconds: int = THROTTLE_S, delay: str = "1 hour") -> DataFrame:
    """A stream of alerts (alert_type, detail, alert_ts) with at most one of a type in any ``seconds``; later ones pass.

    Of alerts that come together the first by time, then by detail, passes.
    Those that come more than ``delay`` late are dropped. A type is forgotten
    when the stream's time has passed what it is held back for.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        # a type's alerts of one batch; of those of earlier batches the state has the last that passed
        batch = pd.concat(list(frames)).sort_values(["alert_ts", "detail"], kind="stable")
        passed = []
        for at, detail in zip(batch.alert_ts, batch.detail, strict=True):
            micros = at.value // 1000
            if last is None or micros - last >= seconds * 1_000_000:
                passed.append((key[0], detail, at))
                last = micros
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if passed:
            yield pd.DataFrame(passed, columns=["alert_type", "detail", "alert_ts"])

    known = alerts.select("alert_type", "detail", "alert_ts").withWatermark("alert_ts", delay)
    return known.groupBy("alert_type").applyInPandasWithState(run, _ALERT, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def inbox(alerts: DataFrame, at: str, hours: float = 24.0, delay: str = "1 hour") -> DataFrame:
    """A stream of alerts with each ``event_id`` once, as long as it comes again within ``hours`` of the stream's time, that of the column ``at``.

    Of rows that come together the first passes.
    """
    names = alerts.columns

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = next(iter(frames)).head(1)
        for _ in frames:
            pass
        if not state.exists:
            state.update((1,))
            state.setTimeoutTimestamp(max(int(first[at].iloc[0].value // 1_000_000), state.getCurrentWatermarkMs()) + int(hours * 3_600_000))
            yield first[names]

    return alerts.withWatermark(at, delay).groupBy("event_id").applyInPandasWithState(run, alerts.schema, "seen int", "append", GroupStateTimeout.EventTimeTimeout)


class Lookup:
    """A dimension table that is read anew when it is ``seconds`` old: what a stream's batches look values up in."""

    def __init__(self, read: Callable[[], DataFrame], seconds: float = 10.0, clock: Callable[[], float] | None = None) -> None:
        self.read, self.seconds, self.clock = read, seconds, clock or time.monotonic
        self._at: float | None = None
        self._table: DataFrame | None = None

    def __call__(self) -> DataFrame:
        now = self.clock()
        if self._at is None or now - self._at >= self.seconds:
            old, self._table, self._at = self._table, stored(self.read(), "lookup"), now
            if old is not None:
                forget(old)
        return self._table
