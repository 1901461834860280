"""Pieces of the keyed notification store: newest rows, patches, dismissals, removals, expiry, ids."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from siteops.functions import next_id, truthy
from siteops.operators.joins import join_same
from siteops.operators.storage import shared_folder
from siteops.operators.timeline import Timeline

# Fixed values of the observed behaviour.
STORE_LIMIT = 1
REMOVE_DELAY = dt.timedelta(milliseconds=1_000_000)


def latest_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int = STORE_LIMIT, pos: str = "pos"
) -> DataFrame:
    """The k newest rows per key, newest first, numbered from 1 in `pos`.

    Spark keeps only k rows per key and task before the shuffle, so heavy keys do not travel.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn(pos, F.row_number().over(newest)).filter(F.col(pos) <= k)


def apply_patches(
    base: DataFrame,
    patches: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    patch: str = "patch",
) -> DataFrame:
    """Merges map-typed patches into `base` in order; a patch for an unknown key does nothing.

    A field absent from a patch is kept, a field present with null overwrites with null. Patches are
    reduced to one row per key, partially before the shuffle, and then joined.
    """
    place = F.struct(*order)
    newest = [
        F.max_by(
            F.struct(F.col(patch)[f].alias("v")), F.when(F.map_contains_key(patch, f), place)
        ).alias(f"_p_{f}")
        for f in fields
    ]
    merged = patches.groupBy(*key).agg(*newest)
    out = join_same(base, merged, list(key))
    kinds = {f.name: f.dataType for f in base.schema}
    values = {
        f: F.when(F.col(f"_p_{f}").isNotNull(), F.col(f"_p_{f}.v").cast(kinds[f])).otherwise(F.col(f))
        for f in fields
    }
    return out.withColumns(values).select(*base.columns)


def running_fields(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: dict[str, Column],
    cuts="auto",
    **options,
) -> DataFrame:
    """The merged fields as they stood after each row: last non-null value per field."""
    return Timeline.of(df, keys, order, cuts, **options).add(last=fields).result()


def _last_hit(
    state: DataFrame, hits: DataFrame, keys: Sequence[str], id_col: str, order: Sequence[str]
) -> tuple[DataFrame, Column]:
    """Joins each stored row to the last action that names it or names all, and tests it comes later.

    Actions are reduced per id and per key before the joins, so each stored row meets at most one of
    each kind. An empty id names nothing.
    """
    place = F.struct(*order)
    one = (
        hits.filter(truthy(F.col(id_col)).isNotNull())
        .groupBy(*keys, id_col)
        .agg(F.max(place).alias("_one"))
    )
    every = hits.filter(F.col(id_col).isNull()).groupBy(*keys).agg(F.max(place).alias("_all"))
    out = join_same(join_same(state, one, [*keys, id_col]), every, keys)
    later = F.greatest("_one", "_all") > place
    return out, F.coalesce(later, F.lit(False))


def dismiss(
    state: DataFrame,
    actions: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    id_col: str = "id",
    flag: str = "open",
) -> DataFrame:
    """Sets `flag` to false on rows that a later DISMISS names; a null id names all of the key."""
    hits = actions.filter(F.col("kind") == "DISMISS")
    out, hit = _last_hit(state, hits, keys, id_col, order)
    return out.withColumn(flag, F.when(hit, F.lit(False)).otherwise(F.col(flag))).select(*state.columns)


def remove(
    state: DataFrame,
    actions: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    id_col: str = "id",
) -> DataFrame:
    """Drops rows that a later REMOVE names; a null id clears the key."""
    hits = actions.filter(F.col("kind") == "REMOVE")
    out, hit = _last_hit(state, hits, keys, id_col, order)
    return out.filter(~hit).select(*state.columns)


def expire_after(
    dismissals: DataFrame, keys: Sequence[str], ts: str, delay: dt.timedelta = REMOVE_DELAY
) -> DataFrame:
    """Expiry time per key: the first dismissal arms the timer and later ones do not move it."""
    return (
        dismissals.groupBy(*keys)
        .agg(F.min(ts).alias("dismissed_at"))
        .withColumn("expires_at", F.col("dismissed_at") + F.lit(delay))
    )


def assign_ids(df: DataFrame, order: Sequence[str], name: str = "id", after: int = 0) -> DataFrame:
    """Dense text ids 1, 2, 3, … over the whole frame in `order`; with `after`, those that follow so many.

    Rows are range-partitioned by `order` (no single-task sort) and checkpointed, so the places that
    the counts are taken from are the places that get the ids, also after a lost executor. Only one
    count per partition is gathered.
    """
    shared_folder(df.sparkSession)
    sorted_rows = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # one row per partition
        sorted_rows.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    place = F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + after
    return (
        sorted_rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, next_id(place))
        .drop("_part", "_at", "_offset")
    )
