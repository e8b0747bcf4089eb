"""Two stateful processors: rows of a key in event-time order, and rows of a key once it has settled.

Both keep rows in the state store and are woken by event-time timers, so what comes late but within the watermark is treated as if it
had come in time, and repeated rows count once. State is dropped by a timer too, when nothing that may still come can need it. They
need the RocksDB state store (:func:`use_state_store`).

Every call of a processor costs some round trips to the state store, so keys that have few rows share one: the state is grouped by
``BUCKETS`` hashes of the keys, and a processor tells its keys apart itself. Rows that come are appended unread; one timer a bucket,
the earliest of its keys, reads them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: A row of the state, as a tuple in the order of the columns.
Row = tuple
#: State keys that all keys of a stream share; a stream that is resumed must keep them.
BUCKETS = 4_096
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Set the state store that these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Packed:
    """A list state whose rows are kept many to a value: what comes in one call is one value, so the store converts no row by itself."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.state = handle.getListState(name, "packed binary")

    def get(self) -> Iterator[Row]:
        for (packed,) in self.state.get():
            yield from pickle.loads(bytes(packed))

    def appendList(self, rows: list[Row]) -> None:
        self.state.appendList([(pickle.dumps(rows),)])

    def put(self, rows: list[Row]) -> None:
        self.state.put([(pickle.dumps(rows),)])

    def clear(self) -> None:
        self.state.clear()


class _Keyed(StatefulProcessor):
    """Reads rows as tuples; ``keys`` are the columns of a key, ``at`` is that of the event time in milliseconds, ``names`` the columns of the result."""

    def __init__(self, keys: list[str], columns: list[str], schema: str, at: str, names: list[str]):
        self.columns, self.schema, self.at, self.names = columns, schema, columns.index(at), names
        self.key = [columns.index(c) for c in keys]

    def _by_key(self, rows: Iterable[Row]) -> dict[Row, list[Row]]:
        """Rows of each key, in their order."""
        out: dict[Row, list[Row]] = {}
        for row in map(tuple, rows):
            out.setdefault(tuple(row[k] for k in self.key), []).append(row)
        return out

    def _sorted(self, rows: list[Row]) -> list[Row]:
        """Different rows in time order."""
        return sorted(set(rows), key=lambda r: (r[self.at], repr(r))) if len(rows) > 1 else rows

    def _fresh(self, frames: Iterator[pd.DataFrame], now: int) -> list[Row]:
        """Rows that are not older than the watermark."""
        out = []
        for frame in frames:
            for values in frame[self.columns].itertuples(index=False, name=None):
                out.append(tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in values))
        return [r for r in out if r[self.at] >= now]

    def _wake(self, at_ms: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at_ms is not None:
            self.handle.registerTimer(at_ms)

    def _wake_by(self, at_ms: int) -> None:
        """Be woken at this time, or before."""
        timers = list(self.handle.listTimers())
        if not timers or min(timers) > at_ms:
            self._wake(at_ms)

    @staticmethod
    def _put(state, rows: list[Row]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def _framed(self, rows: list[Row]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(rows, columns=self.names)

    def close(self) -> None:
        pass


class InOrder(_Keyed):
    """Rows wait until the watermark has passed them; then ``step(held, ready)`` sees those of a key in time order and returns results and the rows to hold on to.

    Held rows go ``hold_ms`` after the last of them.
    """

    def __init__(self, keys: list[str], columns: list[str], schema: str, at: str, names: list[str], step: Callable[[list[Row], list[Row]], tuple[list[Row], list[Row]]], hold_ms: int):
        super().__init__(keys, columns, schema, at, names)
        self.step, self.hold_ms = step, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.held = Packed(handle, "waiting"), Packed(handle, "held")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        fresh = self._fresh(rows, now)
        if fresh:
            self.waiting.appendList(fresh)
            self._wake_by(max(min(r[self.at] for r in fresh), now + 1))
        yield from self._framed([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting, held = self._by_key(self.waiting.get()), self._by_key(self.held.get())
        out, rest, kept, wake = [], [], [], []
        for one in waiting | held:
            mine, before = self._sorted(waiting.get(one, [])), held.get(one, [])
            ready = [r for r in mine if r[self.at] <= now]
            later = mine[len(ready) :]
            if ready:
                found, before = self.step(before, ready)
                out += found
            if before and before[-1][self.at] + self.hold_ms <= now:
                before = []
            rest += later
            kept += before
            if later or before:
                wake.append(later[0][self.at] if later else before[-1][self.at] + self.hold_ms)
        self._put(self.waiting, rest)
        self._put(self.held, kept)
        self._wake(max(min(wake), now + 1) if wake else None)
        yield from self._framed(out)


class Settled(_Keyed):
    """All rows of a key at once, when the watermark is ``settle_ms`` past the last of them: ``reduce(rows)`` returns its results, once.

    That the key is done is remembered for ``keep_ms`` more, by the last of its rows, so what comes too late makes no second result.
    """

    def __init__(self, keys: list[str], columns: list[str], schema: str, at: str, names: list[str], reduce: Callable[[list[Row]], list[Row]], settle_ms: int, keep_ms: int):
        super().__init__(keys, columns, schema, at, names)
        self.reduce, self.settle_ms, self.keep_ms = reduce, settle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows, self.done = Packed(handle, "rows"), Packed(handle, "done")

    def _done(self) -> dict[Row, int]:
        return {tuple(r)[:-1]: tuple(r)[-1] for r in self.done.get()}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        done = self._done()
        fresh = {one: mine for one, mine in self._by_key(self._fresh(rows, now)).items() if one not in done}
        if fresh:
            self.rows.appendList([r for mine in fresh.values() for r in mine])
            self._wake_by(max(min(max(r[self.at] for r in mine) for mine in fresh.values()) + self.settle_ms, now + 1))
        yield from self._framed([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        done = {one: at for one, at in self._done().items() if at + self.settle_ms + self.keep_ms > now}
        out, rest, wake = [], [], []
        for one, mine in self._by_key(self.rows.get()).items():
            last = max(r[self.at] for r in mine)
            if last + self.settle_ms <= now:
                out += self.reduce(self._sorted(mine))
                done[one] = last
            else:
                rest += mine
                wake.append(last + self.settle_ms)
        wake += [at + self.settle_ms + self.keep_ms for at in done.values()]
        self._put(self.rows, rest)
        self._put(self.done, [(*one, at) for one, at in done.items()])
        self._wake(max(min(wake), now + 1) if wake else None)
        yield from self._framed(out)


def keyed(rows: DataFrame, processor: _Keyed, result: str) -> DataFrame:
    """Run a processor over a stream with a watermark, by event time."""
    bucket = F.pmod(F.xxhash64(*[processor.columns[k] for k in processor.key]), F.lit(BUCKETS)).cast("int")
    return rows.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(processor, result, "append", "EventTime")
