"""What stretches of time a live stream of trades covers: spans that open, go on and close, with timers."""

from __future__ import annotations

import sys
from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Spark starts the processor once in a process of its own, which need not find this package: it goes by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: why a span closes when a poll has no trade in common with what is stored.
NO_OVERLAP = "poll_window_no_trade_id_overlap"

_READ = ("at_ms", "kind", "session", "message", "ids", "times", "reason")
_Message = namedtuple("_Message", _READ)
_OUT = "coverage_id string, start_ms long, end_ms long, state string, gap_reason string"


def _in_order(frames: Iterator[pd.DataFrame]) -> list[_Message]:
    """Messages by time and number, those without a number last. Most keys have few rows, for which sorting a frame costs far more."""
    found = [_Message(*m) for f in frames for m in zip(*[f[c].tolist() for c in _READ], strict=True)]
    return sorted(found, key=lambda m: (m.at_ms, bool(none := pd.isna(m.message)), 0 if none else m.message))


class CoverageSpans(StatefulProcessor):
    """Spans of one key. A poll goes on with the open span if it has a trade seen before, a message if it is of the same session."""

    def __init__(self, key: str, timeout_ms: int, keep_ms: int) -> None:
        self.key, self.timeout_ms, self.keep_ms = key, timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "start_ms long, end_ms long, session string, message long")
        self.seen = handle.getMapState("seen", "id string", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A call of the state store per trade costs more than all else: what is stored is read once, and only what has changed is written.
        span, made = self.span.get() if self.span.exists() else None, []
        stored = {i: t for (i,), (t,) in self.seen.iterator()}
        before, seen = span, dict(stored)
        for m in _in_order(rows):
            times = [int(t) for t in m.times] if m.times is not None else []
            if m.kind == "disconnect":
                if span is not None:
                    made.append(self._row(key, span, "closed", m.reason or "disconnect"))
                span = None
            elif times:
                span = self._extended(key, span, m, times, seen, made)
                seen.update(zip(m.ids, times, strict=True))
        if span is not None:
            made.append(self._row(key, span, "open", None))
            seen = {i: t for i, t in seen.items() if t >= span[1] - self.keep_ms}
        for i, t in seen.items():
            if stored.get(i) != t:
                self.seen.updateValue((i,), (t,))
        for i in stored.keys() - seen.keys():
            self.seen.removeKey((i,))
        if before is not None and (span is None or span[1] != before[1]):
            self.handle.deleteTimer(before[1] + self.timeout_ms)
        if span is None:
            self.span.clear()
        else:
            self.span.update(tuple(span))
            self.handle.registerTimer(span[1] + self.timeout_ms)
        yield self._frame(made)

    def _extended(self, key, span, m, times: list[int], seen: dict[str, int], made: list):
        start, session, number = min(times) + 1, m.session or "", int(m.message)
        goes_on = span is not None and (any(i in seen for i in m.ids) if m.kind == "poll" else span[2] == session)
        if goes_on:
            if m.kind == "message" and number <= span[3]:
                return span  # not after the last message of its session
            return (span[0], max(int(m.at_ms), span[0], span[1]), session, number)
        if span is not None:
            made.append(self._row(key, span, "closed", NO_OVERLAP if m.kind == "poll" else "session_replaced"))
        return (start, max(int(m.at_ms), start), session, number)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        made = []
        if self.span.exists():
            span = self.span.get()
            if span[1] + self.timeout_ms <= expiredTimerInfo.getExpiryTimeInMs():
                made.append(self._row(key, span, "closed", "timeout"))
                self.span.clear()
        yield self._frame(made)

    def _row(self, key, span, state: str, reason: str | None) -> tuple:
        return (key[0], f"trade:{key[0]}:{span[0]}", int(span[0]), int(span[1]), state, reason)

    def _frame(self, made: list) -> pd.DataFrame:
        return pd.DataFrame(made, columns=[self.key, "coverage_id", "start_ms", "end_ms", "state", "gap_reason"])

    def close(self) -> None:
        pass


def coverage_stream(messages: DataFrame, key: str, delay: str, timeout_ms: int, keep_ms: int) -> DataFrame:
    """Every change of the spans of each key: key, coverage_id, start_ms, end_ms, state (open or closed), gap_reason; for a sink in update mode.

    ``messages`` has key, ts (timestamp), kind (poll, message or disconnect),
    session, message (its number), ids and times (of its trades, ms) and reason.
    A span begins a millisecond after its oldest trade, as others of that moment
    may be missing. It closes when a poll has no trade seen before, on
    disconnect, when another session takes over, or ``timeout_ms`` after its end
    once the watermark, ``delay`` behind, has passed that. Ids are kept
    ``keep_ms`` back. Messages of a trigger go by time; later ones than the
    watermark are dropped.

    The session needs the RocksDB state store.
    """
    kind = messages.schema[key].dataType.simpleString()
    timed = messages.withColumn("at_ms", F.unix_millis("ts")).withWatermark("ts", delay)
    columns = [key, "ts", "at_ms", "kind", "session", "message", "ids", "times", "reason"]
    return timed.select(*columns).groupBy(key).transformWithStateInPandas(
        statefulProcessor=CoverageSpans(key, timeout_ms, keep_ms), outputStructType=f"`{key}` {kind}, {_OUT}", outputMode="Update", timeMode="EventTime"
    )


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def last_change(batch: DataFrame) -> DataFrame:
    """Of a batch's rows of one span the last: closed, or of the greatest end."""
    rows = F.struct(*[c for c in batch.columns if c != "coverage_id"])
    return batch.groupBy("coverage_id").agg(F.max_by(rows, F.struct(F.col("state") == "closed", "end_ms")).alias("_row")).select("coverage_id", "_row.*")
