"""Sessions, change points, toggle state and time-limited values from interaction events."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from siteops.operators.timeline import CHUNK, Timeline, settle

# Fixed values of the observed behaviour.
CLOSE_DELAY = dt.timedelta(milliseconds=150)
STATE_TTL = dt.timedelta(days=7)


def sessions(
    df: DataFrame, key: Sequence[str], ts: str, gap: dt.timedelta, cuts="auto", **options
) -> DataFrame:
    """Runs of a key's events with less than `gap` between neighbours: key, start, end, n_events.

    Two events exactly one gap apart belong to different sessions. Rows are shuffled once. For a cut
    key, sessions are first formed inside each chunk; only the first and last of each chunk can
    continue across a border, so only those are merged in a second, small step.
    """
    line = Timeline.of(df.select(*key, ts), key, [ts], cuts, **options)
    spans = _islands(line.df, line.parts, F.col(ts), F.col(ts), F.lit(1), gap)
    if line.cuts is None:
        return spans
    chunk = Window.partitionBy(*line.parts)
    at_edge = (
        (F.col("session_start") == F.min("session_start").over(chunk))
        | (F.col("session_start") == F.max("session_start").over(chunk))
    ) & (F.col(CHUNK) >= 0)
    spans = settle(spans.withColumn("at_edge", at_edge), line.cuts)
    columns = [*key, "session_start", "session_end", "n_events"]
    edges = spans.filter("at_edge").select(*columns)
    merged = _islands(
        edges, key, F.col("session_start"), F.col("session_end"), F.col("n_events"), gap
    )
    return spans.filter(~F.col("at_edge")).select(*columns).unionByName(merged)


def _islands(
    df: DataFrame, parts: Sequence[str], start: Column, end: Column, count: Column, gap: dt.timedelta
) -> DataFrame:
    order = Window.partitionBy(*parts).orderBy("_start")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lag("_end").over(order)
    opens = F.when(before.isNull() | (F.col("_start") >= before + F.lit(gap)), F.col("_start"))
    return (
        df.select(*parts, start.alias("_start"), end.alias("_end"), count.alias("_n"))
        .withColumn("_opens", opens)
        .withColumn("session_start", F.last("_opens", ignorenulls=True).over(upto))
        .groupBy(*parts, "session_start")
        .agg(F.max("_end").alias("session_end"), F.sum("_n").alias("n_events"))
    )


def hover_intervals(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    delay: dt.timedelta = CLOSE_DELAY,
    cuts="auto",
    **options,
) -> DataFrame:
    """Menu intervals from enter/leave events: key, label, opened_at, closed_at.

    Input has `kind` ('enter' or 'leave'), `label` and `has_mega`. An enter of an item with a menu
    opens it at once and cancels a pending close; a leave closes `delay` later unless an enter comes
    first; a second leave does not move a pending close. Entering another label switches at once.
    An enter of an item without a menu is ignored, its leave is not. A menu still open has a null
    `closed_at`. A close due exactly when the next enter arrives happens first.
    """
    ts = order[0]
    rows = df.filter((F.col("kind") == "leave") | ((F.col("kind") == "enter") & F.col("has_mega")))
    line = Timeline.of(rows, key, order, cuts, **options)
    enter = F.when(F.col("kind") == "enter", F.struct(*order, "label"))
    visits = (
        line.add(last={"visit": enter})
        .df.filter(F.col("visit").isNotNull())
        .groupBy(*key, "visit")
        .agg(F.min(F.when(F.col("kind") == "leave", F.col(ts))).alias("left_at"))
        .select(*key, *[F.col(f"visit.{c}").alias(c) for c in order], "visit.label", "left_at")
    )
    due = F.col("left_at") + F.lit(delay)
    line = Timeline(visits, key, order, line.cuts).settled().add(
        previous={"prior": F.struct("label", due.alias("due"))}, following={"next": F.col(ts)}
    )
    next_at = F.col("next.v")
    prior = F.col("prior.v")
    same = prior["label"].eqNullSafe(F.col("label"))
    still_open = prior["due"].isNull() | (prior["due"] > F.col(ts))
    continues = F.coalesce(F.col("prior").isNotNull() & same & still_open, F.lit(False))
    timed_out = due.isNotNull() & (next_at.isNull() | (next_at >= due))
    visits = line.df.withColumn("ends", F.when(timed_out, due).otherwise(next_at))
    opens = F.when(~continues, F.struct(*order))
    return (
        Timeline(visits, key, order, line.cuts)
        .add(last={"opened": opens})
        .df.groupBy(*key, "opened")
        .agg(
            F.max_by("label", F.struct(*order)).alias("label"),
            F.max_by("ends", F.struct(*order)).alias("closed_at"),
        )
        .select(*key, "label", F.col(f"opened.{ts}").alias("opened_at"), "closed_at")
    )


def changes_only(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    expr: Column,
    name: str = "changed_to",
    cuts="auto",
    **options,
) -> DataFrame:
    """Rows where `expr` differs from the key's previous row; null counts as a value.

    A key's first row has nothing to differ from and is left out. The new value is added as `name`.
    """
    line = Timeline.of(df.withColumn(name, expr), keys, order, cuts, **options)
    line = line.add(previous={"_prior": F.col(name)})
    changed = F.col("_prior").isNotNull() & ~F.col("_prior.v").eqNullSafe(F.col(name))
    return line.result().filter(changed).drop("_prior")


def toggle_state(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    initial: Column | bool = True,
    name: str = "is_open",
    cuts="auto",
    **options,
) -> DataFrame:
    """State after each event: the last explicit set, flipped once per toggle since.

    Input has `kind` ('toggle' or 'set') and a boolean `value` for sets; a set without a value is
    false. Give the device in `key` to keep separate flags, and `initial` as an expression on it.
    """
    initial = initial if isinstance(initial, Column) else F.lit(initial)
    line = Timeline.of(df, key, order, cuts, **options)
    line = line.add(total={"_flips": (F.col("kind") == "toggle").cast("bigint")})
    base = F.struct(
        F.coalesce(F.col("value"), F.lit(False)).alias("value"), F.col("_flips").alias("flips")
    )
    line = line.add(last={"_base": F.when(F.col("kind") == "set", base)})
    since = F.col("_flips") - F.coalesce("_base.flips", F.lit(0))
    state = F.coalesce("_base.value", initial) != (since % 2 == 1)
    return line.result().withColumn(name, state).drop("_flips", "_base")


def ttl_latest(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    value: Column,
    as_of: Column,
    ttl: dt.timedelta = STATE_TTL,
) -> DataFrame:
    """Latest value per key that has not expired by `as_of`: key, value, written_at, expires_at.

    Every write renews the lifetime. Writes after `as_of` are not seen. Aggregation is partial
    before the shuffle, so a heavy key sends one row per task.
    """
    ts = order[0]
    return (
        df.filter(F.col(ts) <= as_of)
        .groupBy(*key)
        .agg(F.max_by(value, F.struct(*order)).alias("value"), F.max(ts).alias("written_at"))
        .withColumn("expires_at", F.col("written_at") + F.lit(ttl))
        .filter(F.col("expires_at") > as_of)
    )
