"""Ordered per-key windows that stay balanced when one key holds a large share of the rows.

`Window.partitionBy(key)` puts every row of a key into one task. A `Timeline` cuts the time range of
each heavy key into chunks, runs the window inside `(key, chunk)`, and completes it with a value
carried over from the key's other chunks. The carried values come from one small aggregate per
chunk, so they are broadcast and the rows themselves are shuffled once. Any cut gives the exact
result; which keys are cut only decides how the work is spread.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from siteops.operators.joins import join_same
from siteops.operators.storage import shared_folder

CHUNK = "_chunk"
UNCUT = -1

# A chunk has at least this many rows, and at least a quarter of a task's fair share of all rows, so
# the table of borders grows with the number of shuffle tasks, not with the data.
MIN_CHUNK_ROWS = 2_000_000
# Heavy keys are sought in this many groups of keys, so that no single task merges all sketches.
SKETCHES = 32
# Borders of a key are looked through in two steps, this many at a time.
STEP = 32


@dataclass(frozen=True)
class Cuts:
    """Where heavy keys are cut: for each key hash `_h` the sorted places at which chunks begin.

    A place is a time and, inside a time that many rows share, a value of the next order column; or,
    where `whole` is set, the values of all order columns.
    """

    borders: DataFrame
    then: str | None
    whole: bool = False


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def _place(ts: Column, then: Column) -> Column:
    return F.struct(ts.alias("at"), then.cast("bigint").alias("then"))


def _chunk_of(borders: Column, place: Column) -> Column:
    """How many borders are at or before `place`, null without borders. Places without a time come first."""
    some = F.filter(borders, lambda b, i: (i % STEP == 0) & (b <= place))
    skipped = F.greatest((F.size(some) - 1) * STEP, F.lit(0))
    rest = F.filter(F.slice(borders, skipped + 1, STEP), lambda b: b <= place)
    return F.when(borders.isNotNull(), skipped + F.size(rest)).cast("bigint")


def _quantiles(rows: DataFrame, by: Sequence[str], value: str, parts: str, most: int) -> DataFrame:
    """(by, cut): for each group the values that split its rows into `parts` parts of equal size."""
    shares = F.lit([i / most for i in range(1, most)])
    all_cuts = F.percentile_approx(value, shares, F.lit(max(10_000, 16 * most)))
    found = rows.groupBy(*by, parts).agg(all_cuts.alias("all"))
    own = F.transform(
        F.sequence(F.lit(1), F.col(parts) - 1),
        lambda i: F.get(F.col("all"), (F.round(i * most / F.col(parts)) - 1).cast("int")),
    )
    return found.select(*by, F.when(F.col(parts) > 1, own).alias("cuts"))


def find_cuts(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    chunk_rows: int | None = None,
    then: str | None = None,
) -> Cuts | None:
    """Finds heavy keys with one sketch pass; returns None when no key needs cutting.

    A key is heavy when it has more than two tasks' fair share of the rows, or more than `chunk_rows`
    when that is given. Each heavy key is cut at quantiles of its own times, and times at which it has
    more rows than a chunk at quantiles of `then`, a whole number that orders rows of the same time. The
    passes read the key and order columns only. They run when called, so give a table rather than a
    long lineage, and reuse the result for operators over the same rows. A key that the sketches miss
    is left whole, which costs balance and nothing else. The table of borders has one for each
    `chunk_rows` rows of heavy keys and is broadcast; a small number is for tests.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tracked = min(100_000, max(1024, tasks // 4))
    found = (
        df.select(_key_hash(keys).alias("h"))
        .groupBy(F.col("h") % SKETCHES)
        .agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h, {tracked // 2}, {tracked})").alias("top"))
        .collect()  # one row per sketch
    )
    total = sum(r["n"] for r in found)
    limit = chunk_rows
    if chunk_rows is None:
        chunk_rows = max(MIN_CHUNK_ROWS, math.ceil(total / (4 * tasks)))
        limit = max(chunk_rows, 2 * total / tasks)
    heavy = [(t["item"], math.ceil(t["count"] / chunk_rows)) for r in found for t in r["top"] if t["count"] > limit]
    if not heavy:
        return None
    parts = spark.createDataFrame(heavy, "_h bigint, _parts int")
    named = [F.col(then).cast("bigint").alias("_then")] if then is not None else []
    rows = df.select(_key_hash(keys).alias("_h"), F.col(ts).alias("_ts"), *named)
    rows = rows.join(F.broadcast(parts), "_h")  # one row per heavy key
    cuts = _quantiles(rows, ["_h"], "_ts", "_parts", max(n for _, n in heavy))
    each = cuts.select("_h", F.explode("cuts").alias("at")).where("at IS NOT NULL")
    times = each.groupBy("_h", "at").agg(F.count("*").cast("int").alias("n"))
    shared_folder(spark)
    times = times.checkpoint()  # a few rows for each task
    most = times.agg(F.max("n")).first()[0] or 0
    places = times.select("_h", "at", F.lit(None).cast("bigint").alias("then"))
    if most > 1 and then is not None:
        # A time that came out several times has that many chunks' rows.
        shared = times.where("n > 1").select("_h", F.col("at").alias("_ts"), (F.col("n") + 1).alias("_parts"))
        own = rows.drop("_parts").join(F.broadcast(shared), ["_h", "_ts"])
        inside = _quantiles(own, ["_h", "_ts"], "_then", "_parts", most + 1)
        inner = inside.select("_h", F.col("_ts").alias("at"), F.explode("cuts").alias("then"))
        places = places.unionByName(inner.distinct()).checkpoint()
    borders = F.sort_array(F.collect_set(_place(F.col("at"), F.col("then"))))
    return Cuts(places.groupBy("_h").agg(borders.alias("_borders")), then)


def range_cuts(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> Cuts | None:
    """Cuts keys where `parts` equal ranges of all rows by key and order begin; None if no key needs it.

    Nothing is estimated from sketches of keys: whatever the skew, no chunk has more rows than one of
    the ranges, which Spark makes equal from a sample of the rows. The order columns may be of any type
    that can be sorted. The pass sorts the key and order columns into the ranges and keeps one row of
    each, so there are fewer borders than ranges (four for each shuffle partition, if not given). It
    runs when called, like that of `find_cuts`, and shuffles more.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(c) for c in dict.fromkeys([*keys, *order])]
    ranges = df.select(*columns).repartitionByRange(parts or 4 * tasks, *columns)
    place = F.struct(F.struct(*keys).alias("key"), F.struct(*order).alias("place"))
    ends = ranges.groupBy(F.spark_partition_id().alias("part")).agg(F.min(place).alias("low"), F.max(place).alias("high"))
    before = F.lag("high.key").over(Window.orderBy("part"))  # one row for each range
    begins = ends.withColumn("before", before).where(F.col("before").eqNullSafe(F.col("low.key")))
    shared_folder(df.sparkSession)
    places = begins.select(_key_hash([f"low.key.{k}" for k in keys]).alias("_h"), "low.place").checkpoint()
    if places.isEmpty():
        return None
    borders = F.sort_array(F.collect_set("place"))
    return Cuts(places.groupBy("_h").agg(borders.alias("_borders")), None, whole=True)


def settle(df: DataFrame, cuts: Cuts | None) -> DataFrame:
    """Stores the rows so far when keys are cut, so that later chunk summaries do not redo them."""
    if cuts is None:
        return df
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Timeline:
    """A frame with its key and order columns, and running values that cross chunk borders.

    `order` starts with the time column and must decide the place of every row within its key.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: Cuts | None):
        self.keys, self.order, self.cuts = list(keys), list(order), cuts
        if cuts is not None and CHUNK not in df.columns:
            then = F.col(self.order[1]) if cuts.then is not None and len(self.order) > 1 else F.lit(None)
            place = F.struct(*self.order) if cuts.whole else _place(F.col(self.order[0]), then)
            chunk = _chunk_of(F.col("_borders"), place)
            df = (
                df.withColumn("_h", _key_hash(self.keys))
                .join(F.broadcast(cuts.borders), "_h", "left")
                .withColumn(CHUNK, F.coalesce(chunk, F.lit(UNCUT)))
                .drop("_h", "_borders")
            )
        self.df = df

    @classmethod
    def of(
        cls,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        cuts: Cuts | None | str = "auto",
        chunk_rows: int | None = None,
    ) -> Timeline:
        if cuts == "ranges":
            cuts = range_cuts(df, keys, order, chunk_rows and -(-df.count() // chunk_rows))
        elif cuts == "auto":
            whole = len(order) > 1 and isinstance(df.schema[order[1]].dataType, T.IntegralType)
            cuts = find_cuts(df, keys, order[0], chunk_rows, order[1] if whole else None)
        return cls(df, keys, order, cuts)

    @property
    def parts(self) -> list[str]:
        """Columns that the windows and the shuffle partition by."""
        return self.keys + ([CHUNK] if self.cuts is not None else [])

    def window(self):
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def with_df(self, df: DataFrame) -> Timeline:
        return Timeline(df, self.keys, self.order, self.cuts)

    def result(self) -> DataFrame:
        return self.df.drop(CHUNK)

    def settled(self) -> Timeline:
        return self.with_df(settle(self.df, self.cuts))

    def add(
        self,
        last: dict[str, Column] | None = None,
        coming: dict[str, Column] | None = None,
        previous: dict[str, Column] | None = None,
        following: dict[str, Column] | None = None,
        total: dict[str, Column] | None = None,
    ) -> Timeline:
        """Adds running columns; all that are named in one call share one chunk summary.

        last: last non-null value at or before the row. coming: first non-null value after it.
        total: sum at or before the row.
        previous, following: value of the neighbouring row as a struct with field `v`, null where
        the key has no such row.
        """
        ordered = self.window()
        upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        chunks = Window.partitionBy(*self.keys).orderBy(CHUNK)
        before = chunks.rowsBetween(Window.unboundedPreceding, -1)
        place = F.struct(*self.order)
        boxed = lambda value: F.struct(value.alias("v"))
        rules = []  # name, value inside the chunk, chunk summary, value from other chunks
        for n, v in (last or {}).items():
            rules.append((
                n,
                F.last(v, ignorenulls=True).over(upto),
                F.max_by(v, F.when(v.isNotNull(), place)),
                F.last(f"_s_{n}", ignorenulls=True).over(before),
            ))
        backwards = Window.partitionBy(*self.parts).orderBy(*[F.col(c).desc() for c in self.order])
        after = backwards.rowsBetween(Window.unboundedPreceding, -1)
        later_chunks = Window.partitionBy(*self.keys).orderBy(F.col(CHUNK).desc())
        for n, v in (coming or {}).items():
            rules.append((
                n,
                F.last(v, ignorenulls=True).over(after),
                F.min_by(v, F.when(v.isNotNull(), place)),
                F.last(f"_s_{n}", ignorenulls=True).over(
                    later_chunks.rowsBetween(Window.unboundedPreceding, -1)
                ),
            ))
        for n, v in (previous or {}).items():
            rules.append((
                n,
                F.lag(boxed(v)).over(ordered),
                F.max_by(boxed(v), place),
                F.lag(f"_s_{n}").over(chunks),
            ))
        for n, v in (following or {}).items():
            rules.append((
                n,
                F.lead(boxed(v)).over(ordered),
                F.min_by(boxed(v), place),
                F.lead(f"_s_{n}").over(chunks),
            ))
        for n, v in (total or {}).items():
            rules.append((
                n, F.sum(v).over(upto), F.sum(v), F.sum(f"_s_{n}").over(before)
            ))
        df = self.df.withColumns({n: local for n, local, _, _ in rules})
        if self.cuts is None:
            return self.with_df(df)
        carried = (
            self.df.filter(F.col(CHUNK) >= 0)
            .groupBy(*self.parts)
            .agg(*[summary.alias(f"_s_{n}") for n, _, summary, _ in rules])
            .select(*self.parts, *[other.alias(f"_c_{n}") for n, _, _, other in rules])
        )
        df = join_same(df, F.broadcast(carried), self.parts)  # one row per chunk
        sums = set(total or {})
        merged = {
            n: F.col(n) + F.coalesce(f"_c_{n}", F.lit(0)) if n in sums else F.coalesce(n, f"_c_{n}")
            for n, _, _, _ in rules
        }
        return self.with_df(df.withColumns(merged).select(*self.df.columns, *merged))
