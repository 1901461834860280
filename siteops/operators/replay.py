"""Replay of a notification action log into the fate of every row it added.

An action has a store key, an order (`ts`, `seq`), a `kind` (ADD, UPDATE, DISMISS, REMOVE), an `id`
and a `patch` map. DISMISS and REMOVE without an id mean all rows of the store. Ids are unique
within a store; an action on an id that is not in the store does nothing, and neither does an empty
id. The first dismissal of a row arms a timer that removes it `delay` later; an update may reopen the
row but does not stop the timer. A store keeps its `k` newest rows.

Output, one row per ADD: the store key, id, added_at, removed_at, cause ('expiry', 'remove' or
'evict', in this order when they coincide), `open`, and the merged `fields`, both as they were when
the row was removed, or as they are now. `removed_at` is null for rows still stored.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from siteops.functions import as_flag, truthy
from siteops.operators.joins import join_same
from siteops.operators.state import REMOVE_DELAY, STORE_LIMIT
from siteops.operators.storage import shared_folder
from siteops.operators.timeline import CHUNK, Timeline, settle

TIMER_SEQ = -(1 << 63)  # a timer due at the time of an action fires before it
END_OF_TIME = "9999-12-31 00:00:00"
FOREVER = (float("inf"), 0)


def replay(
    actions: DataFrame,
    keys: Sequence[str] = ("store_key",),
    k: int = STORE_LIMIT,
    delay: dt.timedelta = REMOVE_DELAY,
    fields: Sequence[str] = (),
    cuts="auto",
    **options,
) -> DataFrame:
    """Fate of every added row. With k = 1 this is windows only; see `_replay_many` for larger k."""
    fates = replay_with_timers(actions, keys, k, delay, fields, cuts, **options)
    return fates.drop("added_seq", "dismissed_at")


def replay_with_timers(
    actions: DataFrame,
    keys: Sequence[str],
    k: int,
    delay: dt.timedelta,
    fields: Sequence[str],
    cuts="auto",
    **options,
) -> DataFrame:
    """The same with `added_seq` and `dismissed_at`, the first dismissal of rows still stored."""
    keys = list(keys)
    named = truthy(F.col("id")).isNotNull()
    to_all = F.col("id").isNull() & F.col("kind").isin("DISMISS", "REMOVE")
    actions = actions.withColumn("seq", F.col("seq").cast("bigint"))
    line = Timeline.of(actions.filter(named | to_all), keys, ["ts", "seq"], cuts, **options)
    if k == 1:
        return _replay_one(line, delay, fields)
    return _replay_many(line, k, delay, fields)


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def _open_value() -> Column:
    return F.when(_is("UPDATE"), as_flag(F.col("patch")["open"])).otherwise(_is("ADD"))


def _sets_open() -> Column:
    return F.col("kind").isin("ADD", "DISMISS") | (
        _is("UPDATE") & F.coalesce(F.map_contains_key("patch", "open"), F.lit(False))
    )


def _with_cause(df: DataFrame, evicted_at: Column, delay: dt.timedelta) -> DataFrame:
    expires_at = F.col("dismissed_at") + F.lit(delay)
    removed_at = F.least(expires_at, "cleared_at", evicted_at)
    cause = (
        F.when(expires_at <= removed_at, "expiry")
        .when(F.col("cleared_at") <= removed_at, "remove")
        .when(evicted_at <= removed_at, "evict")
    )
    return df.withColumns({"removed_at": removed_at, "cause": cause})


def _replay_one(line: Timeline, delay: dt.timedelta, fields: Sequence[str]) -> DataFrame:
    """k = 1. Each ADD opens a segment of its store's log that ends at the next ADD.

    Only the row added last can be stored, so everything it undergoes is inside its segment, and
    whether an action still finds it there follows from earlier actions of the segment.
    """
    keys, order = line.keys, line.order
    # Whole stores find the next ADD among the few added rows below; for cut ones that would be a
    # second round of chunk summaries, so they look it up in the same round.
    cut, next_add = line.cuts is not None, F.when(_is("ADD"), F.col("ts"))
    line = line.add(
        last={"seg": F.when(_is("ADD"), F.struct(*order, "id"))},
        coming={"next_at": next_add} if cut else None,
    )
    hits = line.df.filter(
        F.col("seg").isNotNull() & (F.col("id").isNull() | (F.col("id") == F.col("seg.id")))
    )
    dismissed = F.when(_is("DISMISS"), F.col("ts"))
    cleared = F.when(_is("REMOVE"), F.col("ts"))
    before = (  # the chunk last, so that the rows are in order for the grouping below
        Window.partitionBy(*keys, "seg", *line.parts[len(keys):])
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = hits.withColumns(
        {
            "dismissed_before": F.min(dismissed).over(before),
            "cleared_before": F.min(cleared).over(before),
        }
    )
    if cut:
        rows = _carry_segments(hits, rows, line, dismissed, cleared)
    expired = F.coalesce(F.col("ts") >= F.col("dismissed_before") + F.lit(delay), F.lit(False))
    live = F.col("cleared_before").isNull() & ~expired
    place = F.struct(*order)
    carried = {f: F.map_contains_key("patch", f) & F.col("kind").isin("ADD", "UPDATE") for f in fields}
    fates = (
        rows.groupBy(*keys, "seg")
        .agg(
            F.min(dismissed).alias("dismissed_at"),
            F.min(cleared).alias("cleared_at"),
            F.max_by(_open_value(), F.when(live & _sets_open(), place)).alias("open"),
            *[F.max_by(F.col("patch")[f], F.when(live & c, place)).alias(f) for f, c in carried.items()],
            *([F.max("next_at").alias("next_at")] if cut else []),
        )
        .select("*", *[F.col(f"seg.{c}").alias(c) for c in order], "seg.id")
    )
    if not cut:
        fates = Timeline(fates, keys, order, None).add(following={"next": F.col("ts")}).df
    fates = _with_cause(fates, F.col("next_at") if cut else F.col("next.v"), delay)
    return fates.select(
        *keys, "id", F.col("ts").alias("added_at"), F.col("seq").alias("added_seq"), "dismissed_at",
        "removed_at", "cause", "open", *fields,
    )


def _carry_segments(
    hits: DataFrame, rows: DataFrame, line: Timeline, dismissed: Column, cleared: Column
) -> DataFrame:
    """Completes the running times of segments that continue from an earlier chunk.

    Only the first and last segment of a chunk can cross its borders: at most two rows per chunk.
    """
    chunk = Window.partitionBy(*line.parts)
    edge = (F.col("seg") == F.min("seg").over(chunk)) | (F.col("seg") == F.max("seg").over(chunk))
    earlier = (
        Window.partitionBy(*line.keys, "seg").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    match = [*line.parts, "seg"]
    pieces = (
        hits.filter(F.col(CHUNK) >= 0)
        .groupBy(*match)
        .agg(F.min(dismissed).alias("_d"), F.min(cleared).alias("_c"))
        .withColumn("_edge", edge)
        .filter("_edge")
        .select(*match, F.min("_d").over(earlier).alias("_d"), F.min("_c").over(earlier).alias("_c"))
        .filter("_d IS NOT NULL OR _c IS NOT NULL")
    )
    return (
        join_same(rows, F.broadcast(pieces), match)
        .withColumns(
            {
                "dismissed_before": F.least("dismissed_before", "_d"),
                "cleared_before": F.least("cleared_before", "_c"),
            }
        )
        .select(*rows.columns)
    )


def _at(ts: Column, seq: Column) -> Column:
    return F.struct(ts.alias("ts"), seq.alias("seq"))


def _replay_many(line: Timeline, k: int, delay: dt.timedelta, fields: Sequence[str]) -> DataFrame:
    """k > 1. A row is evicted by the first ADD that finds k newer rows stored, itself included.

    Newer rows are never evicted before older ones, so a row's other removals are settled first, and
    evictions follow from one ordered pass over the ADDs that remembers at most k rows per store.
    """
    keys, order = line.keys, line.order
    log, place, to_all = line.result(), F.struct(*order), F.col("id").isNull()
    adds = (
        line.add(
            coming={
                "dismiss_all": F.when(_is("DISMISS") & to_all, F.col("ts")),
                "clear_all": F.when(_is("REMOVE") & to_all, place),
            }
        )
        .result()
        .filter(_is("ADD"))
        .withColumns({f: F.col("patch")[f] for f in fields})
        .select(*keys, "id", *order, *fields, "dismiss_all", "clear_all")
    )
    one = [*keys, "id"]
    by_id = log.filter(~to_all & ~_is("ADD"))
    named = (
        join_same(by_id, adds.select(*one, place.alias("added")), one, "inner")
        .filter(place > F.col("added"))
        .groupBy(*keys, "id")
        .agg(
            F.min(F.when(_is("DISMISS"), F.col("ts"))).alias("dismiss_id"),
            F.min(F.when(_is("REMOVE"), place)).alias("clear_id"),
        )
    )
    adds = join_same(adds, named, one).withColumns(
        {
            "dismissed_at": F.least("dismiss_all", "dismiss_id"),
            "cleared": F.least("clear_all", "clear_id"),
        }
    )
    timer = _at(F.col("dismissed_at") + F.lit(delay), F.lit(TIMER_SEQ))
    goes = F.least(F.when(F.col("dismissed_at").isNotNull(), timer), "cleared")
    adds = adds.withColumns(
        {"cleared_at": F.col("cleared.ts"), "goes_ts": goes["ts"], "goes_seq": goes["seq"]}
    ).drop("dismiss_all", "dismiss_id", "clear_all", "clear_id", "cleared")
    fates = _evictions(Timeline(adds, keys, order, line.cuts).settled(), k)
    evicted = F.col("evict_ts").isNotNull()  # only of rows that nothing else removed before
    natural = {c: F.when(~evicted, F.col(c)) for c in ("dismissed_at", "cleared_at")}
    fates = _with_cause(fates.withColumns(natural), F.col("evict_ts"), delay)
    never = F.lit(END_OF_TIME).cast(log.schema["ts"].dataType)
    gone = (
        F.when(F.col("cause") == "evict", _at(F.col("evict_ts"), F.col("evict_seq")))
        .when(F.col("cause").isNotNull(), _at(F.col("goes_ts"), F.col("goes_seq")))
        .otherwise(_at(never, F.lit(0).cast("bigint")))
    )
    fates = fates.select(
        *keys, "id", place.alias("added"), gone.alias("gone"), "dismissed_at", "removed_at", "cause",
        *fields,
    )
    # Stored, as the rows are needed twice and the ordered pass should run once.
    shared_folder(fates.sparkSession)
    return _final_fields(fates.checkpoint(), log, line, fields)


def _final_fields(
    fates: DataFrame, log: DataFrame, line: Timeline, fields: Sequence[str]
) -> DataFrame:
    """Adds `open` and the merged fields as of each row's removal."""
    keys, place = line.keys, F.struct(*line.order)
    every = log.filter(_is("DISMISS") & F.col("id").isNull()).select(*keys, *line.order)
    probes = fates.select("*", *[F.col(f"gone.{c}").alias(c) for c in line.order])
    both = probes.withColumn("probe", F.lit(True)).unionByName(every, allowMissingColumns=True)
    probes = (
        Timeline(both, keys, line.order, line.cuts)
        .add(last={"last_all": F.when(F.col("probe").isNull(), place)})
        .result()
        .filter("probe")
        .drop("probe", *line.order)
    )
    one = [*keys, "id"]
    changes = log.filter(F.col("id").isNotNull() & F.col("kind").isin("DISMISS", "UPDATE"))
    live = join_same(changes, fates.select(*one, "added", "gone"), one, "inner").filter(
        (place > F.col("added")) & (place < F.col("gone"))
    )
    carries = {f: _is("UPDATE") & F.map_contains_key("patch", f) for f in fields}
    named = live.groupBy(*keys, "id").agg(
        F.max(F.when(_sets_open(), place)).alias("open_at"),
        F.max_by(_open_value(), F.when(_sets_open(), place)).alias("open_as"),
        *[
            F.max_by(F.struct(F.col("patch")[f].alias("v")), F.when(c, place)).alias(f"_p_{f}")
            for f, c in carries.items()
        ],
    )
    closed_at = F.when(F.col("last_all") > F.col("added"), F.col("last_all"))
    is_open = (
        F.when(closed_at.isNotNull() & F.coalesce(closed_at > F.col("open_at"), F.lit(True)), False)
        .when(F.col("open_at").isNotNull(), F.col("open_as"))
        .otherwise(True)
    )
    merged = [
        F.when(F.col(f"_p_{f}").isNotNull(), F.col(f"_p_{f}.v")).otherwise(F.col(f)).alias(f)
        for f in fields
    ]
    return join_same(probes, named, one).select(
        *keys, "id", F.col("added.ts").alias("added_at"), F.col("added.seq").alias("added_seq"),
        "dismissed_at", "removed_at", "cause", is_open.alias("open"), *merged,
    )


def _evictions(line: Timeline, k: int) -> DataFrame:
    """Adds `evict_ts` and `evict_seq`, the place of the ADD that pushes each row out."""
    ts_type = line.df.schema["ts"].dataType
    added = [
        T.StructField("level", T.IntegerType()), T.StructField("evict_ts", ts_type),
        T.StructField("evict_seq", T.LongType()), T.StructField("stays", T.BooleanType()),
    ]
    schema = T.StructType([*line.df.schema, *added])
    parts = line.parts

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Remembers the rows still stored. `level` n marks the ADD at which a part first stores n rows."""
        held = None  # rows still stored at the end of a batch, oldest first
        reached = 0

        def finished(batch, rows, evicted, stays):
            by = pa.array(evicted, pa.int64())
            done = batch.append_column("evict_ts", batch.column("ts").take(by)).append_column(
                "evict_seq", batch.column("seq").take(by)
            )
            return done.append_column("stays", pa.array(stays)).take(pa.array(rows, pa.int64()))

        for batch in batches:
            n = batch.num_rows
            batch = batch.append_column("level", pa.nulls(n, pa.int32()))
            first = 0
            if held is not None:
                first = held.num_rows
                batch = pa.concat_batches([held, batch])
            levels = batch.column("level").to_pylist()
            groups = list(zip(*[batch.column(c).to_pylist() for c in parts]))
            places = _places(batch, "ts", "seq")
            goes = _places(batch, "goes_ts", "goes_seq")
            evicted: list[int | None] = [None] * batch.num_rows
            stays = [False] * batch.num_rows
            stored = list(range(first - 1, -1, -1))  # newest first
            for i in range(first, batch.num_rows):
                if i and groups[i - 1] != groups[i]:
                    for s in stored:
                        stays[s] = True
                    stored, reached = [], 0
                stored = [i, *[s for s in stored if goes[s] > places[i]]]
                if len(stored) > reached:
                    reached = levels[i] = len(stored)
                if len(stored) > k:
                    evicted[stored.pop()] = i
            batch = batch.set_column(
                batch.schema.get_field_index("level"), "level", pa.array(levels, pa.int32())
            )
            keep = sorted(stored)
            held = batch.take(pa.array(keep, pa.int64())) if keep else None
            yield finished(batch, np.setdiff1d(np.arange(batch.num_rows), keep), evicted, stays)
        if held is not None:
            n = held.num_rows
            yield finished(held, np.arange(n), [None] * n, [True] * n)

    ordered = line.df.repartition(*parts).sortWithinPartitions(*parts, *line.order)
    out = settle(ordered.mapInArrow(walk, schema), line.cuts)
    if line.cuts is None:
        return out.drop("level", "stays")
    late = _late_evictions(out, line, k)
    return (
        join_same(out, F.broadcast(late), [*line.keys, "id"])  # at most k rows per chunk
        .withColumns(
            {
                "evict_ts": F.coalesce("evict_ts", "late_ts"),
                "evict_seq": F.coalesce("evict_seq", "late_seq"),
            }
        )
        .select(*[c for c in out.columns if c not in (CHUNK, "level", "stays")])
    )


def _places(batch: pa.RecordBatch, ts: str, seq: str) -> list[tuple]:
    """Comparable (microseconds, seq) pairs; rows without a time come last."""
    micros = batch.column(ts).cast(pa.timestamp("us")).cast(pa.int64()).to_pylist()
    return [(m, s) if m is not None else FOREVER for m, s in zip(micros, batch.column(seq).to_pylist())]


def _late_evictions(out: DataFrame, line: Timeline, k: int) -> DataFrame:
    """Evictions by ADDs of a later chunk than the row's own.

    A chunk acts on older rows only through the first ADDs at which 1, 2, … k of its own rows are
    stored, and hands on at most k rows itself. A second step per key goes through these few rows.
    """
    keys, parts = line.keys, line.parts
    kinds = {f.name: f.dataType.simpleString() for f in line.df.schema}
    key_schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    ts_type = kinds["ts"]
    columns = [*parts, "id", "ts", "seq", "goes_ts", "goes_seq"]

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([CHUNK, "ts", "seq"], ignore_index=True)
        places, goes = _pandas_places(rows, "ts", "seq"), _pandas_places(rows, "goes_ts", "goes_seq")
        out: dict[int, int] = {}
        older: list[int] = []  # newest first
        for _, part in rows.groupby(CHUNK, sort=True):
            reached = {level: i for i, level in part["level"].items() if level}
            staying = []
            for n, row in enumerate(older):
                lasting = sorted((goes[r] for r in older[:n]), reverse=True)
                pushes = [
                    reached[k - m]
                    for m in range(min(n, k - 1) + 1)
                    if k - m in reached
                    and places[reached[k - m]] < goes[row]
                    and (m == 0 or places[reached[k - m]] < lasting[m - 1])
                ]
                if pushes:
                    out[row] = min(pushes, key=lambda i: places[i])
                else:
                    staying.append(row)
            own = [i for i, level in part["level"].items() if not level]
            newest = max(places[i] for i in part.index)
            older = own[::-1] + [r for r in staying if goes[r] > newest]
        found, by = list(out), list(out.values())
        late = rows.loc[found, [*keys, "id"]].reset_index(drop=True)
        late["late_ts"] = rows.loc[by, "ts"].to_numpy()
        late["late_seq"] = rows.loc[by, "seq"].to_numpy()
        return late

    # Whole numbers with nulls would reach pandas as floats; the time alone says if a row goes.
    goes_seq = F.coalesce("goes_seq", F.lit(0))
    # Rows still stored at the end of a chunk count as level 0, beside the level that they reached.
    levels = F.array_compact(F.array(F.when(F.col("level") <= k, F.col("level")), F.when(F.col("stays"), 0)))
    heavy = out.filter(F.col(CHUNK) >= 0).withColumn("goes_seq", goes_seq)
    few = heavy.select(*columns, F.explode(levels).alias("level"))  # at most 2 * k rows per chunk
    return few.groupBy(*keys).applyInPandas(
        across, f"{key_schema}, id string, late_ts {ts_type}, late_seq bigint"
    )


def _pandas_places(rows: pd.DataFrame, ts: str, seq: str) -> list[tuple]:
    known = rows[ts].notna()
    micros = rows[ts].to_numpy("datetime64[us]").astype("int64").tolist()
    seqs = rows[seq].tolist()
    return [(m, s) if ok else FOREVER for m, s, ok in zip(micros, seqs, known)]
