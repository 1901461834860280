"""Streams that take each key's rows in event-time order, whatever the order they arrive in.

Needs the RocksDB state store provider.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MILLI = dt.timedelta(milliseconds=1)


class Ordered(StatefulProcessor):
    """Puts a key's rows aside until the watermark passes them, then takes them in order.

    Subclasses say what a row does to the key's state (`take`), when the state changes by itself
    (`due`) and what happens then (`fire`). A state is a tuple or None; what is returned beside it
    are output rows without the key. A change that is due at the time of a row comes first. One
    timer per key is set, for the earliest waiting row or due change. So the outcome does not
    depend on how the stream was cut into batches.
    """

    #: Columns of the state.
    state = "none string"

    def __init__(self, keys: Sequence[str], waiting: dict[str, str], columns: Sequence[str]):
        self.keys, self.waiting, self.columns = list(keys), waiting, list(columns)
        self.names = list(waiting)

    def take(self, state: tuple | None, row: Row) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def due(self, state: tuple | None) -> int | None:
        return None

    def fire(self, state: tuple) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.later = handle.getListState("later", ", ".join(f"{n} {kind}" for n, kind in self.waiting.items()))
        self.now = handle.getValueState("now", self.state)
        self.timer = handle.getValueState("timer", "at bigint")
        self.made = Row(*self.keys, *self.columns)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[n] for n in self.names) for r in rows]
        if new:
            self.later.appendList(new)
            self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.timer.clear()
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        row = Row(*self.names)
        every = sorted(self.later.get(), key=lambda r: tuple(r)[:2]) if self.later.exists() else []
        ready = [row(*r) for r in every if r[0] <= upto]
        state = tuple(self.now.get()) if self.now.exists() else None
        for r in ready:
            state, out = self._settle(state, r[0])
            yield from (self.made(*key, *o) for o in out)
            state, out = self.take(state, r)
            yield from (self.made(*key, *o) for o in out)
        state, out = self._settle(state, upto)
        yield from (self.made(*key, *o) for o in out)
        waiting = every[len(ready):]
        if waiting:
            self.later.put([tuple(r) for r in waiting])
        elif self.later.exists():
            self.later.clear()
        if state is not None:
            self.now.update(state)
        elif self.now.exists():
            self.now.clear()
        times = [t for t in (self.due(state), *[r[0] for r in waiting[:1]]) if t is not None]
        if times:
            self._wake(min(times))

    def _settle(self, state: tuple | None, upto: int) -> tuple[tuple | None, list[tuple]]:
        out: list[tuple] = []
        while (at := self.due(state)) is not None and at <= upto:
            state, more = self.fire(state)
            out += more
        return state, out

    def _wake(self, micros: int) -> None:
        millis = -(-micros // 1000)
        current = self.timer.get() if self.timer.exists() else None
        if current is not None:
            if current[0] <= millis:
                return
            self.handle.deleteTimer(current[0])
        self.timer.update((millis,))
        self.handle.registerTimer(millis)


def in_order(
    df: DataFrame,
    processor: type[Ordered],
    keys: Sequence[str],
    order: Sequence[str],
    fields: dict[str, Column],
    out: dict[str, str],
    *args,
    lateness: dt.timedelta,
) -> DataFrame:
    """Runs an `Ordered` processor over `fields` of the rows by `order` (a time, then a number).

    `out` has the names and kinds of the columns that it gives beside the keys.

    In the processor the order is `at` (microseconds) and `seq`. Rows without a time are left out; a
    missing number comes first. Rows that are `lateness` behind the newest time, or more, are dropped
    by the watermark. A key's rows of a micro-batch are handled by one task.
    """
    ts, seq = order
    number = F.coalesce(F.col(seq).cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    rows = (
        df.withWatermark(ts, f"{lateness // MILLI} milliseconds")
        .filter(F.col(ts).isNotNull())
        .select(*keys, ts, F.unix_micros(ts).alias("at"), number.alias("seq"), *[c.alias(n) for n, c in fields.items()])
    )
    kinds = dict(rows.dtypes)
    waiting = {n: kinds[n] for n in ("at", "seq", *fields)}
    made = T.StructType([*rows.select(*keys).schema, *[T.StructField(n, T._parse_datatype_string(k)) for n, k in out.items()]])
    return rows.groupBy(*keys).transformWithState(
        processor(keys, waiting, list(out), *args),
        made,
        "Append",
        "EventTime",
    )
