"""Keyed folds on streams: rows wait until the watermark has put them in order, timers meet the deadlines, state ends."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from folio.operators.folds import Fold


#: Parts over which the keys of a stream are dealt. A part's keys share their calls and a timer, so what a call costs falls on many rows.
BUCKETS = 256


class InOrder(StatefulProcessor):
    """Runs a fold of each key over its rows in order of (at, order), whatever order they came in; keys come by buckets.

    Rows wait in list state until the watermark has passed them; rows that come later than it Spark has
    dropped. One timer a bucket stands at the next waiting row or deadline of its folds, whichever comes
    first. A key whose fold has nothing to remember is gone from the state, and so is a bucket without keys and waiting rows.
    """

    def __init__(self, fold: Callable[[], Fold], names: list[str], schema: str, key: str, at: str, order: str, out: list[str]):
        self.fold, self.names, self.schema, self.key, self.at, self.order, self.out = fold, names, schema, key, at, order, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.state = handle.getValueState("folds", "state string")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = [r for r in (tuple(r[c] for c in self.names) for r in rows) if r[self.names.index(self.key)] is not None]
        if new:  # a row without a key only moves the watermark
            self.waiting.appendList(new)
            self._arm(min(r[self.names.index(self.at)] for r in new))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        rows = [dict(zip(self.names, r)) for r in self.waiting.get()]
        due = sorted((r for r in rows if r[self.at] <= now), key=lambda r: (r[self.at], r[self.order]))
        rest = [r for r in rows if r[self.at] > now]
        folds: dict[Any, Fold] = {}
        for of, state in json.loads(self.state.get()[0]) if self.state.exists() else ():
            folds[of] = self.fold()
            folds[of].load(state)
        out = []
        for r in due:
            if (fold := folds.get(r[self.key])) is None:
                fold = folds[r[self.key]] = self.fold()
            out += fold.passed(r[self.at]) + fold.step(r)
        left, times = [], [r[self.at] for r in rest]
        for of, fold in folds.items():
            out += fold.passed(now, also_at=True)
            if (state := fold.dump()) is not None:
                left.append((of, state))
                times += [] if (deadline := fold.deadline()) is None else [deadline]
        if not rest:
            self.waiting.clear()
        elif due:
            self.waiting.put([tuple(r[c] for c in self.names) for r in rest])
        if left:
            self.state.update((json.dumps(left),))
        else:
            self.state.clear()
        if times:
            self._arm(min(times))
        return iter([Row(**{c: r[c] for c in self.out}) for r in out])

    def _arm(self, micros: int) -> None:
        """Let the bucket's timer stand at this time if it stands at none or a later one."""
        before = self.timer.get()[0] if self.timer.exists() else None
        if before is None or micros < before:
            if before is not None:
                self.handle.deleteTimer(_millis(before))
            self.handle.registerTimer(_millis(micros))
            self.timer.update((micros,))

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """The first millisecond at or after a time."""
    return -(-micros // 1000)


def folded(rows: DataFrame, key: str, at: str, order: str, schema: str, fold: Callable[[], Fold], delay: str) -> DataFrame:
    """The stream twin of operators.folds.folded: rows(key, at in microseconds, order, ...) through a fold for each key.

    Rows may come up to `delay` late. A row with a null key belongs to no fold and only moves time on.
    Keys are whole numbers or strings. They are dealt over BUCKETS, which are the groups of the stream.
    """
    names = rows.columns
    timed = rows.withColumns({"_time": F.timestamp_micros(at), "_bucket": F.pmod(F.xxhash64(key), F.lit(BUCKETS))}).withWatermark("_time", delay)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = [c.split()[0].strip("`") for c in schema.split(", ")]
    return timed.groupBy("_bucket").transformWithState(InOrder(fold, names, kept, key, at, order, out), schema, "Append", "EventTime")
