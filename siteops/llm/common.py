"""What the operators of this subpackage share."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteops.operators.storage import shared_folder

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}
#: White space of the contracts: space and the characters 9 to 13.
BLANK = r"\x20\x09-\x0D"
ASIDE = "set aside"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name in the cluster's shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of `df`, written once to the shared folder. Lost executors don't touch them."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def held_out(doc_id: Column) -> Column:
    """True for a quarter of the ids, which no model learns from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def others(df: DataFrame, *added: str) -> list[str]:
    """The columns of `df` without those that are to be added, whatever their case."""
    names = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in names]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of `df` has."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def beside(df: DataFrame, source: str, keep: list[str] | None, added: dict[str, Column]):
    """For functions that add columns to batches: their input, the kept columns, the schema and a place.

    The input has the columns to keep (all, if `keep` is null), less those that are added anew, and
    `source`, at the place that comes last in the result.
    """
    kept = [c for c in others(df, *added) if keep is None or c in keep]
    columns = [F.col(f"`{c}`") for c in kept]
    schema = df.select(*columns).withColumns(added).schema
    if source in kept:
        return df.select(*columns), kept, schema, kept.index(source)
    name = fresh(df, "source")[0]
    return df.select(*columns, F.col(f"`{source}`").alias(name)), kept, schema, len(kept)


def set_aside(docs: DataFrame, *used: str) -> DataFrame:
    """The columns of `docs` that an operator uses, and all others as one, so that no name can clash."""
    rest = [F.col(f"`{c}`") for c in others(docs, *used)]
    return docs.select(*used, F.struct(F.lit(0).alias("none"), *rest).alias(ASIDE))


def brought_back(df: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of `docs`, from rows that `set_aside` made: those used as they are now, the others as before."""
    names = {u.lower(): u for u in used}
    return df.select(
        *(F.col(names[c.lower()]) if c.lower() in names else F.col(ASIDE).getField(c) for c in docs.columns)
    ).toDF(*docs.columns)


def slices(sizes, most: int):
    """Consecutive ranges (start, end) of items whose sizes add up to `most`, or of one item."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def placed(df: DataFrame, group: list[str], order: list[str | Column], *, facts: DataFrame | None = None) -> DataFrame:
    """`df` with `place` (from 0) and `total`: where each row stands in its group, and the group's rows.

    Rows are range-partitioned by group and order and stored, so that no task sorts a group. Equal rows
    are dealt out by where they were stored. A place is the row's own in its partition plus the rows of
    the group in earlier partitions; those numbers are one row for each partition and group in it. What
    `facts` says of each group (its columns beside `group`) is joined to these few rows, not to `df`.
    Groups may be null. `df` should be stored, as it is read twice.
    """
    part, row, tie, start, n, before = fresh(df, "part", "row", "tie", "start", "n", "before")
    by = [F.col(f"`{c}`") for c in group] + [F.col(f"`{o}`") if isinstance(o, str) else o for o in order]
    tied = df.withColumn(tie, F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*by, F.col(tie)).sortWithinPartitions(*by, F.col(tie)).drop(tie)
    at = F.monotonically_increasing_id()
    rows = stored(
        dealt.withColumns({part: F.shiftright(at, 33).cast("int"), row: at.bitwiseAND(F.lit((1 << 33) - 1))})
    )
    spans = rows.groupBy(part, *group).agg(F.min(row).alias(start), F.count("*").alias(n))
    # A group has a span for each partition it reaches into; without a group there is one for each partition.
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    spans = spans.withColumns(
        {before: F.sum(n).over(whole.orderBy(part)) - F.col(n), "total": F.sum(n).over(whole)}
    ).drop(n)
    if facts is not None:
        spans = spans.join(facts.withColumnsRenamed({c: f"{c} of" for c in group}), _same(group, " of")).drop(
            *[f"{c} of" for c in group]
        )
    spans = spans.withColumnsRenamed({c: f"{c} of" for c in [part, *group]})
    return (
        rows.join(spans, _same([part, *group], " of"))
        .withColumn("place", F.col(row) - F.col(start) + F.col(before))
        .drop(part, row, start, before, *[f"{c} of" for c in [part, *group]])
    )


def _same(columns: list[str], suffix: str) -> Column:
    """Each column equals that with the suffix; null equals null."""
    tests = [F.col(f"`{c}`").eqNullSafe(F.col(f"`{c}{suffix}`")) for c in columns]
    return functools.reduce(lambda a, b: a & b, tests)
