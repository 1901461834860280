"""Streaming forms of sessions, menus, changes, toggles, time-limited values and the not-found report."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siteops.operators.interaction import CLOSE_DELAY, STATE_TTL
from siteops.operators.routing import CATCH_ALL
from siteops.streaming.ordered import Ordered, in_order

MICRO = dt.timedelta(microseconds=1)


def sessions_stream(
    df: DataFrame, key: Sequence[str], ts: str, gap: dt.timedelta, lateness: dt.timedelta
) -> DataFrame:
    """Closed sessions: key, session_start, session_end, n_events. Append mode.

    Session windows merge neighbours exactly one gap apart, while a distance of `gap` has to split.
    The window therefore uses a gap shorter by one microsecond, the resolution of the times, so the
    rule is that of the batch form. Sessions still open at the last watermark are not emitted.
    """
    window = F.session_window(ts, f"{(gap - MICRO) // MICRO} microseconds")
    return (
        df.withWatermark(ts, f"{lateness // dt.timedelta(milliseconds=1)} milliseconds")
        .groupBy(*key, window)
        .agg(
            F.min(ts).alias("session_start"),
            F.max(ts).alias("session_end"),
            F.count("*").alias("n_events"),
        )
        .select(*key, "session_start", "session_end", "n_events")
    )


class _Menu(Ordered):
    """The menu of a key: (label, when it opened, when it will close)."""

    state = "label string, opened bigint, closes bigint"

    def __init__(self, keys, waiting, columns, delay: int):
        super().__init__(keys, waiting, columns)
        self.delay = delay

    def due(self, state):
        return None if state is None else state[2]

    def fire(self, state):
        return None, [state]

    def take(self, state, row):
        if row.kind == "enter":
            if state is None:
                return (row.label, row.at, None), []
            if state[0] == row.label:
                return (*state[:2], None), []
            return (row.label, row.at, None), [(*state[:2], row.at)]
        if state is None or state[2] is not None:
            return state, []
        return (*state[:2], row.at + self.delay), []


def hover_stream(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    delay: dt.timedelta = CLOSE_DELAY,
    *,
    lateness: dt.timedelta,
) -> DataFrame:
    """Closed menu intervals from enter/leave events: key, label, opened_at, closed_at. Append mode.

    The rules are those of `hover_intervals`. A pending close is a timer, which an enter before it
    cancels. An interval is emitted when the watermark passes its close; menus still open are not.
    """
    rows = df.filter((F.col("kind") == "leave") | ((F.col("kind") == "enter") & F.col("has_mega")))
    out = in_order(
        rows, _Menu, key, order, {"kind": F.col("kind"), "label": F.col("label")},
        {"label": "string", "opened": "bigint", "closed": "bigint"}, delay // MICRO, lateness=lateness,
    )
    return out.select(
        *key, "label", F.timestamp_micros("opened").alias("opened_at"),
        F.timestamp_micros("closed").alias("closed_at"),
    )


class _Changes(Ordered):
    """The last value of a key."""

    def __init__(self, keys, waiting, columns, kind: str):
        super().__init__(keys, waiting, columns)
        self.state = f"value {kind}"

    def take(self, state, row):
        differs = state is not None and state[0] != row.value
        return (row.value,), [(row.at, row.seq, row.value)] if differs else []


def changes_stream(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    expr: Column,
    name: str = "changed_to",
    *,
    lateness: dt.timedelta,
) -> DataFrame:
    """Rows where `expr` differs from the key's previous row: key, order, and the value as `name`. Append mode.

    The rules are those of `changes_only`: null counts as a value, and a key's first row is left out.
    A row is emitted when the watermark passes it. The number of `order` is read as a bigint.
    """
    kind = df.select(expr.alias("value")).schema["value"].dataType.simpleString()
    out = in_order(
        df, _Changes, keys, order, {"value": expr}, {"at": "bigint", "seq": "bigint", "value": kind}, kind,
        lateness=lateness,
    )
    return _with_order(out, keys, order, F.col("value").alias(name))


class _Toggle(Ordered):
    """The flag of a key."""

    state = "flag boolean"

    def take(self, state, row):
        flag = bool(row.value) if row.kind == "set" else (row.initial if state is None else state[0])
        if row.kind == "toggle" and flag is not None:
            flag = not flag
        return (flag,), [(row.at, row.seq, flag)]


def toggle_stream(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    initial: Column | bool = True,
    name: str = "is_open",
    *,
    lateness: dt.timedelta,
) -> DataFrame:
    """State after each event: key, order, and the flag as `name`. Append mode.

    The rules are those of `toggle_state`: the last explicit set, flipped once per toggle since; a set
    without a value is false. `initial` may be an expression on the key. A state is emitted when the
    watermark passes its event. The number of `order` is read as a bigint.
    """
    initial = initial if isinstance(initial, Column) else F.lit(initial)
    out = in_order(
        df, _Toggle, key, order,
        {"kind": F.col("kind"), "value": F.col("value"), "initial": initial.cast("boolean")},
        {"at": "bigint", "seq": "bigint", "flag": "boolean"}, lateness=lateness,
    )
    return _with_order(out, key, order, F.col("flag").alias(name))


def _with_order(df: DataFrame, key: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    ts, seq = order
    number = F.nullif(F.col("seq"), F.lit(-(1 << 63)).cast("bigint"))
    return df.select(*key, F.timestamp_micros("at").alias(ts), number.alias(seq), value)


class _Latest(StatefulProcessor):
    """Latest write of a key, and a timer for when it expires."""

    def __init__(self, keys: Sequence[str], ttl: int):
        self.keys, self.ttl = list(keys), ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at bigint, seq bigint, value string")

    def close(self) -> None:
        pass

    def _expiry(self, at: int) -> int:
        return -(-(at + self.ttl) // 1000)

    def _rows(self, key, changes: list[tuple]) -> Iterator[Row]:
        made = Row(*self.keys, "value", "written", "expires", "live")
        for at, value, live in changes:
            yield made(*key, value, at, at + self.ttl, live)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.latest.get() if self.latest.exists() else None
        new = sorted(((r["at"], r["seq"], r["value"]) for r in rows), key=lambda w: w[:2])
        if before is not None:
            new = [w for w in new if w[:2] > (before[0], before[1])]
        if not new:
            return
        writes = new if before is None else [tuple(before), *new]
        changes = [(w[0], w[2], False) for w, following in zip(writes, writes[1:]) if following[0] >= w[0] + self.ttl]
        changes.append((new[-1][0], new[-1][2], True))
        if before is not None:
            self.handle.deleteTimer(self._expiry(before[0]))
        self.latest.update(new[-1])
        self.handle.registerTimer(self._expiry(new[-1][0]))
        yield from self._rows(key, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, _, value = self.latest.get()
        self.latest.clear()
        yield from self._rows(key, [(at, value, False)])


def ttl_stream(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    value: Column,
    ttl: dt.timedelta = STATE_TTL,
    *,
    lateness: dt.timedelta,
) -> DataFrame:
    """Latest value per key as a stream of changes: value, written_at, expires_at, live.

    The newest write of a batch emits a live row and renews the lifetime. A value that expires, when
    the watermark passes its expiry or a later write comes after it, is emitted with `live` false.
    Lifetimes are in event time. Writes that are `lateness` behind, or more, are dropped. Update mode.
    """
    ts, seq = order
    rows = df.withWatermark(ts, f"{lateness // dt.timedelta(milliseconds=1)} milliseconds").select(
        *key, ts, F.unix_micros(ts).alias("at"), F.col(seq).cast("bigint").alias("seq"),
        value.cast("string").alias("value"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in key)
    out = rows.groupBy(*key).transformWithState(
        _Latest(key, ttl // MICRO),
        f"{schema}, value string, written bigint, expires bigint, live boolean",
        "Update",
        "EventTime",
    )
    return out.select(
        *key, "value", F.timestamp_micros("written").alias("written_at"),
        F.timestamp_micros("expires").alias("expires_at"), "live",
    )


def not_found_stream(paths: DataFrame, routes: DataFrame) -> DataFrame:
    """Running count of accesses per path that no exact route serves. Update or complete mode.

    `routes` is a static table. Counts are partial before the shuffle.
    """
    known = routes.filter(F.col("path") != CATCH_ALL).select("path")
    unrouted = paths.join(known, "path", "left_anti")
    return unrouted.groupBy("path").agg(F.count("*").alias("n_accesses"))


def _unrouted(paths: DataFrame, routes: DataFrame, ts: str, width: dt.timedelta, lateness: dt.timedelta):
    known = routes.filter(F.col("path") != CATCH_ALL).select("path")
    late = paths.withWatermark(ts, f"{lateness // dt.timedelta(milliseconds=1)} milliseconds")
    window = F.window(ts, f"{width // MICRO} microseconds").alias("window")
    bounds = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]
    return late.join(known, "path", "left_anti"), window, bounds


def not_found_windows(
    paths: DataFrame, routes: DataFrame, ts: str, width: dt.timedelta, *, lateness: dt.timedelta
) -> DataFrame:
    """Accesses per window of time and path that no exact route serves. Append mode.

    window_start, window_end, path, n_accesses. A window is emitted once, when the watermark passes its
    end, and its state goes; so the state holds the paths of open windows only, not all paths ever seen.
    """
    unrouted, window, bounds = _unrouted(paths, routes, ts, width, lateness)
    return unrouted.groupBy(window, "path").agg(F.count("*").alias("n_accesses")).select(*bounds, "path", "n_accesses")


def not_found_sketches(
    paths: DataFrame, routes: DataFrame, ts: str, width: dt.timedelta, tracked: int = 10_000, *, lateness: dt.timedelta
) -> DataFrame:
    """A sketch per window of the paths most often asked for that no exact route serves. Append mode.

    window_start, window_end, n_accesses, sketch. The state of a window is one sketch of `tracked` paths,
    however many different paths come. `top_not_found` reads sketches, also those of several windows
    together.
    """
    unrouted, window, bounds = _unrouted(paths, routes, ts, width, lateness)
    sketch = F.expr(f"approx_top_k_accumulate(path, {int(tracked)})").alias("sketch")
    return unrouted.groupBy(window).agg(F.count("*").alias("n_accesses"), sketch).select(*bounds, "n_accesses", "sketch")


def top_not_found(sketches: DataFrame, k: int, by: Sequence[str] = (), tracked: int = 10_000) -> DataFrame:
    """The `k` paths most often asked for, from merged sketches: the `by` columns, path, n_accesses.

    Counts are exact where no more different paths came than the sketches track; else they may be too
    large by about the accesses divided by `tracked`.
    """
    # Without a group, partitions without rows would have sketches of no type, which Spark can't merge.
    groups = list(by) or [F.lit(0).alias("_all")]
    merged = sketches.groupBy(*groups).agg(F.expr(f"approx_top_k_combine(sketch, {int(tracked)})").alias("sketch"))
    top = F.explode(F.expr(f"approx_top_k_estimate(sketch, {int(k)})")).alias("top")
    return merged.select(*by, top).select(*by, F.col("top.item").alias("path"), F.col("top.count").alias("n_accesses"))
