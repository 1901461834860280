"""Replay of a notification action stream, with live timers.

Needs the RocksDB state store provider.
"""

from __future__ import annotations

import datetime as dt
import json
import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siteops.functions import as_flag, truthy
from siteops.operators.state import REMOVE_DELAY, STORE_LIMIT

#: Groups of stores that share one state.
BUCKETS = 1024
#: Times in keys that are arrays or structs are kept whole.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Actions or stores in one value of the state.
CHUNK = 1 << 13


class _Stores(StatefulProcessor):
    """The notification stores of a bucket: actions that wait for the watermark, and at most k rows a store.

    Actions are put aside until the watermark passes them and are then taken in event-time order, so
    the outcome does not depend on how the stream was cut into batches. One timer per bucket is set
    for the earliest waiting action or due removal. Each call to a state goes to the JVM and back, so
    actions and stores are kept in chunks. A store's keys, and what an action says, are JSON texts.
    """

    def __init__(self, k: int, delay: int, fields: Sequence[str]):
        self.k, self.delay, self.fields = k, delay, list(fields)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "chunk binary")
        self.stored = handle.getListState("stored", "chunk binary")
        self.timer = handle.getValueState("timer", "at bigint")

    def close(self) -> None:
        pass

    def _wake_at(self, micros: int) -> None:
        millis = -(-micros // 1000)
        current = self.timer.get() if self.timer.exists() else None
        if current is not None:
            if current[0] <= millis:
                return
            self.handle.deleteTimer(current[0])
        self.timer.update((millis,))
        self.handle.registerTimer(millis)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            at = part["at"].tolist()
            self.waiting.appendList(_chunks(list(zip(part["store"].tolist(), at, part["action"].tolist()))))
            first = min(at) if first is None else min(first, *at)
        if first is not None:
            self._wake_at(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        stores = dict(_items(self.stored))
        ready: dict[str, list[tuple]] = defaultdict(list)
        waiting = []
        for store, at, action in _items(self.waiting):
            if at <= upto:
                ready[store].append((at, json.loads(action)))
                stores.setdefault(store, [])
            else:
                waiting.append((store, at, action))
        kept, dues, gone = [], [], []
        for store, rows in stores.items():
            out: list[tuple] = []
            for at, a in sorted(ready.get(store, ()), key=_place):
                rows = self._expire(rows, at, out)
                rows = self._apply(rows, at, a.get("kind"), a.get("id"), a.get("patch", {}), out)
            rows = self._expire(rows, upto, out)
            if rows:
                kept.append((store, rows))
                dues += [r[2] for r in rows if r[2] is not None]
            gone += [(store, *row) for row in out]
        self._keep(self.waiting, waiting)
        self._keep(self.stored, kept)
        dues += [at for _, at, _ in waiting]
        if dues:
            self._wake_at(min(dues))
        if gone:
            yield pd.DataFrame(gone, columns=["_store", "id", "added", "removed", "cause", "open", *self.fields])

    @staticmethod
    def _keep(state, items: list[tuple]) -> None:
        if items:
            state.put(_chunks(items))
        elif state.exists():
            state.clear()

    def _gone(self, row: list, at: int, cause: str) -> tuple:
        rid, added, _, is_open, fields = row
        return rid, added, at, cause, is_open, *[fields.get(f) for f in self.fields]

    def _expire(self, stored: list, upto: int, out: list) -> list:
        due = sorted((r for r in stored if r[2] is not None and r[2] <= upto), key=lambda r: r[2])
        out += [self._gone(r, r[2], "expiry") for r in due]
        return [r for r in stored if r[2] is None or r[2] > upto]

    def _apply(self, stored: list, at: int, kind: str, rid, patch: dict, out: list) -> list:
        hit = [r for r in stored if rid is None or r[0] == rid]
        if kind == "ADD":
            kept = {f: patch[f] for f in self.fields if f in patch}
            stored = [[rid, at, None, True, kept], *stored]
            out += [self._gone(r, at, "evict") for r in stored[self.k:]]
            return stored[: self.k]
        if kind == "REMOVE":
            out += [self._gone(r, at, "remove") for r in hit]
            return [r for r in stored if r not in hit]
        for row in hit:
            if kind == "DISMISS":
                row[3] = False
                row[2] = at + self.delay if row[2] is None else row[2]
            elif rid is not None:
                if "open" in patch:
                    row[3] = None if patch["open"] is None else patch["open"] == "true"
                named = {f: patch[f] for f in self.fields if f in patch}
                row[4] = {**row[4], **named}
        return stored


def _place(action: tuple[int, dict]) -> tuple:
    """Its place among a store's actions; at the same time a missing number comes first."""
    seq = action[1].get("seq")
    return action[0], seq is not None, seq or 0


def _as_text(key: Column, kind: str) -> Column:
    """A key as a text that stands for no other key."""
    if kind.startswith(("array", "struct")):
        return F.to_json(key, JSON)
    return F.base64(key) if kind == "binary" else key.cast("string")


def _from_text(text: Column, kind: str) -> Column:
    if kind.startswith(("array", "struct")):
        return F.from_json(text, kind, JSON)
    return F.unbase64(text) if kind == "binary" else text.cast(kind)


def _chunks(items: list) -> list[tuple[bytes]]:
    return [(pickle.dumps(items[i : i + CHUNK]),) for i in range(0, len(items), CHUNK)]


def _items(state) -> Iterable[tuple]:
    """What the chunks of a list state hold."""
    if state.exists():
        for (chunk,) in state.get():
            yield from pickle.loads(chunk)


def replay_stream(
    actions: DataFrame,
    keys: Sequence[str] = ("store_key",),
    k: int = STORE_LIMIT,
    delay: dt.timedelta = REMOVE_DELAY,
    fields: Sequence[str] = (),
    *,
    lateness: dt.timedelta,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Fate of every row once it leaves its store, as a stream; same rows as `replay`.

    Each row is emitted once, when the watermark passes its removal; rows still stored are not
    emitted. Actions that are `lateness` behind, or more, are dropped by the watermark. Per store the state
    is its k rows and the actions of the last `lateness`. Stores are dealt to `buckets` by a hash; a task
    holds the actions of one bucket that wait, so give more buckets where that is too much. Their number
    has to stay while a stream's state is kept. One task handles a store's actions of a micro-batch;
    where a store may get a large share of the actions, use `ReplayBatches`. Actions without a time are
    left out.
    """
    named = truthy(F.col("id")).isNotNull()
    to_all = F.col("id").isNull() & F.col("kind").isin("DISMISS", "REMOVE")
    kept = F.map_filter("patch", lambda name, _: name.isin("open", *fields))
    flag = lambda name, v: F.when(name == "open", as_flag(v).cast("string")).otherwise(v)
    kept = F.transform_values(kept, flag)
    kinds = {f.name: f.dataType.simpleString() for f in actions.schema}
    texts = [_as_text(F.col(f"`{c}`"), kinds[c]).alias(f"k{i}") for i, c in enumerate(keys)]
    action = F.struct(F.col("seq").cast("bigint").alias("seq"), "kind", "id", kept.alias("patch"))
    rows = (
        actions.withWatermark("ts", f"{lateness // dt.timedelta(milliseconds=1)} milliseconds")
        .filter((named | to_all) & F.col("ts").isNotNull())
        .select(
            "ts", F.unix_micros("ts").alias("at"), F.to_json(F.struct(*texts)).alias("store"),
            F.to_json(action).alias("action"),
        )
        .withColumn("bucket", F.pmod(F.xxhash64("store"), F.lit(buckets)))
    )
    schema = ", ".join(
        ["_store string, id string, added bigint, removed bigint, cause string, open boolean"]
        + [f"`{f}` string" for f in fields]
    )
    micros = delay // dt.timedelta(microseconds=1)
    fates = rows.groupBy("bucket").transformWithStateInPandas(
        _Stores(k, micros, fields), schema, "Append", "EventTime"
    )
    found = F.from_json("_store", ", ".join(f"k{i} string" for i in range(len(texts))))
    return fates.withColumn("_store", found).select(
        *[_from_text(F.col(f"_store.k{i}"), kinds[c]).alias(c) for i, c in enumerate(keys)],
        "id", F.timestamp_micros("added").alias("added_at"),
        F.timestamp_micros("removed").alias("removed_at"), "cause", "open", *fields,
    )
