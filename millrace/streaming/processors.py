"""Keyed processors with state and timers (transformWithState), and how to run them.

Times are milliseconds; event-time timers need a watermark on the stream, processing-time timers none.
Spark gives a processor all rows of a key of one micro-batch, so rows are taken in order of `ts`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def keyed(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str = "append", time: str = "none") -> DataFrame:
    """time: "none", "eventtime" or "processingtime" timers."""
    return df.groupBy(*keys).transformWithState(processor, schema, mode, time)


def in_order(rows: Iterator[Row], by: str = "ts") -> list[Row]:
    return sorted(rows, key=lambda r: r[by])


class Processor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def close(self) -> None: ...


class JumpAlarm(Processor):
    """Value state: a row whose vc differs from the one before it by more than `limit`. Gives id, before, vc, ts."""

    SCHEMA = "id string, before int, vc int, ts bigint"

    def __init__(self, limit: int = 10):
        self.limit = limit

    def init(self, handle):
        self.last = handle.getValueState("last", "vc int")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        for r in in_order(rows):
            if last is not None and abs(r.vc - last) > self.limit:
                yield Row(id=key[0], before=last, vc=r.vc, ts=r.ts)
            last = r.vc
        self.last.update((last,))


class TopValues(Processor):
    """List state: after each row, the n greatest vc of the key so far. Gives id, ts, top."""

    SCHEMA = "id string, ts bigint, top array<int>"

    def __init__(self, n: int = 3):
        self.n = n

    def init(self, handle):
        self.top = handle.getListState("top", "vc int")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        top = [x[0] for x in self.top.get()] if self.top.exists() else []
        for r in in_order(rows):
            top = sorted([*top, r.vc], reverse=True)[: self.n]
            yield Row(id=key[0], ts=r.ts, top=top)
        self.top.put([(x,) for x in top])


class DistinctValues(Processor):
    """Map state: each vc of the key once. Gives id, vc, ts of its first row."""

    SCHEMA = "id string, vc int, ts bigint"

    def init(self, handle):
        self.seen = handle.getMapState("seen", "vc int", "ts bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for r in in_order(rows):
            if not self.seen.containsKey((r.vc,)):
                self.seen.updateValue((r.vc,), (r.ts,))
                yield Row(id=key[0], vc=r.vc, ts=r.ts)


class RunningAggregate(Processor):
    """Reducing and aggregating state: after each row the key's sum, count and mean so far."""

    SCHEMA = "id string, ts bigint, total bigint, n bigint, mean double"

    def init(self, handle):
        self.sums = handle.getValueState("sums", "total bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        total, n = self.sums.get() if self.sums.exists() else (0, 0)
        for r in in_order(rows):
            total, n = total + r.vc, n + 1
            yield Row(id=key[0], ts=r.ts, total=total, n=n, mean=total / n)
        self.sums.update((total, n))


class CountWindow(Processor):
    """Sum of vc over each run of `size` rows of a key. Gives id, window_no, total."""

    SCHEMA = "id string, window_no bigint, total bigint"

    def __init__(self, size: int = 3):
        self.size = size

    def init(self, handle):
        self.state = handle.getValueState("open", "window_no bigint, n int, total bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        no, n, total = self.state.get() if self.state.exists() else (0, 0, 0)
        for r in in_order(rows):
            n, total = n + 1, total + r.vc
            if n == self.size:
                yield Row(id=key[0], window_no=no, total=total)
                no, n, total = no + 1, 0, 0
        self.state.update((no, n, total))


class ExpiringTotal(Processor):
    """State with a time to live: the key's total, forgotten if the key is silent for `ttl` milliseconds of
    processing time. Reading writes the value back, so both reading and writing renew it."""

    SCHEMA = "id string, ts bigint, total bigint"

    def __init__(self, ttl: int = 10_000):
        self.ttl = ttl

    def init(self, handle):
        self.total = handle.getValueState("total", "total bigint", self.ttl)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        total = self.total.get()[0] if self.total.exists() else 0
        for r in in_order(rows):
            total += r.vc
            yield Row(id=key[0], ts=r.ts, total=total)
        self.total.update((total,))


class Reminder(Processor):
    """A timer for each row, `after` milliseconds later; one per key and time. Gives id, at when it fires.

    With time="eventtime" the time counts from the row, with "processingtime" from the clock.
    """

    SCHEMA = "id string, at bigint"

    def __init__(self, after: int = 5000, processing: bool = False):
        self.after, self.processing = after, processing

    def init(self, handle):
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for r in rows:
            at = (timerValues.getCurrentProcessingTimeInMs() if self.processing else r.ts) + self.after
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield Row(id=key[0], at=expiredTimerInfo.getExpiryTimeInMs())


class BillCheck(Processor):
    """Two streams as one (side "app" or "third"): an order whose sides both come within `wait` milliseconds
    is matched and its timer deleted; else an alarm when the wait is over. Gives order_id, result, ts."""

    SCHEMA = "order_id string, result string, ts bigint"

    def __init__(self, wait: int = 5000):
        self.wait = wait

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "side string, ts bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for r in in_order(rows):
            other = self.waiting.get() if self.waiting.exists() else None
            if other is None:
                self.waiting.update((r.side, r.ts))
                self.handle.registerTimer(r.ts + self.wait)
            elif other[0] != r.side and abs(r.ts - other[1]) <= self.wait:
                self.handle.deleteTimer(other[1] + self.wait)
                self.waiting.clear()
                yield Row(order_id=key[0], result="matched", ts=r.ts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.waiting.exists():
            side, ts = self.waiting.get()
            self.waiting.clear()
            yield Row(order_id=key[0], result="third missing" if side == "app" else "app missing", ts=ts)
