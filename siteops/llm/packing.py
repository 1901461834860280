"""Packing by length: buckets with the least padding, and batches of a token budget inside each.

The lengths of all documents are counted by Spark. Dynamic programming over that histogram picks the
bucket bounds. Long lengths share a bin with those within 1/128 of them, which keeps the histogram at a
few thousand bins for any corpus; a bin pads to the longest length in it, and that padding is counted.

Inside a bucket documents come in the order of a hash of their id. Their positions are the number of
documents in earlier shards of that order plus the place in their own shard, so no task sorts a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteops.llm.common import ASIDE, BLANK, stored, table

BUCKETS = 8
BUDGET = 1 << 15
#: Lengths up to this one have bins of their own; above, a power of two has as many bins.
EXACT = 256
SHARDS = 4096


def word_count(text: Column) -> Column:
    """Length of a text in words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def length_bin(n: Column) -> Column:
    """The largest length that shares a bin with `n`."""
    digits = F.length(F.bin(n - 1))  # in base 2
    width = F.pow(F.lit(2.0), F.greatest(digits - 8, F.lit(0))).cast("long")
    return F.when(n <= EXACT, n).otherwise(F.ceil(n / width) * width).cast("long")


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The upper bounds of at most `buckets` buckets with the least padding over all documents.

    `lengths` are the different lengths in order, `counts` their numbers of documents. Among equal
    solutions each bucket, from the last, starts as low as possible.
    """
    d = len(lengths)
    k = min(buckets, d)
    if not k:
        return []
    many = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    # Padded tokens of bins h+1..i are lengths[i] * (many[i] - many[h]); the tokens themselves don't matter.
    best = np.full(d + 1, np.iinfo(np.int64).max // 2, np.int64)
    best[0] = 0
    choice = np.zeros((k + 1, d + 1), np.int64)
    for j in range(1, k + 1):
        after = np.full_like(best, np.iinfo(np.int64).max // 2)
        for i in range(j, d + 1):
            cost = best[j - 1 : i] + lengths[i - 1] * (many[i] - many[j - 1 : i])
            h = int(cost.argmin())
            after[i], choice[j, i] = cost[h], h + j - 1
        best = after
    bounds, i = [], d
    for j in range(k, 0, -1):
        bounds.append(int(lengths[i - 1]))
        i = choice[j, i]
    return bounds[::-1]


def pack(
    df: DataFrame,
    length: Column,
    budget: int = BUDGET,
    buckets: int = BUCKETS,
    doc_id: str = "doc_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded, batch, slot) of each row: where it goes; then the columns to keep.

    A column to keep with the name of one of these is left out.

    A bucket pads to its bound, and a batch holds as many rows as the budget has room for, at least one:
    a row longer than the budget has a batch of its own. Rows of length 0 stand in a bucket like others.
    Batches are numbered within a bucket from 0, rows in a batch from 0. A null id comes first in its
    shard; rows with the same id and length have places of their own. An empty table has no rows.
    """
    id_ = F.col(f"`{doc_id}`")
    made = ["doc_id", "n_tokens", "bucket", "padded", "batch", "slot"]
    kept = [c for c in keep if c.lower() not in made]
    aside = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in kept]).alias(ASIDE)
    tokens = F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens")
    rows = stored(df.select(id_.alias("doc_id"), tokens, *[aside] * bool(kept)))
    binned = rows.withColumn("bin", length_bin(F.col("n_tokens")))
    shape = binned.groupBy("bin").agg(F.max("n_tokens").alias("most"), F.count("*").alias("n"))
    found = sorted((r.most, r.n) for r in shape.collect())  # a few thousand bins
    lengths, counts = np.array(found, np.int64).reshape(-1, 2).T
    bounds = bucket_bounds(lengths, counts, buckets)
    limits = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array().cast("array<long>")
    bucket = F.size(F.filter(limits, lambda b: b < F.col("n_tokens"))).cast("int")
    shard = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 3), 16, 10)
    placed = rows.withColumns({"bucket": bucket, "shard": shard.cast("int")})
    sizes = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")
    starts = sizes.select("bucket", "shard", before.alias("start"))  # SHARDS rows for each bucket at most
    inside = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")) - 1
    numbered = placed.withColumn("inside", inside).join(F.broadcast(starts), ["bucket", "shard"])
    place = F.col("start") + F.col("inside")
    room = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("padded"), F.lit(1))), F.lit(1)).cast("long")
    out = numbered.withColumn("padded", F.get(limits, F.col("bucket")))
    return out.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "padded",
        F.floor(place / room).cast("long").alias("batch"),
        (place % room).cast("long").alias("slot"),
        *[F.col(ASIDE).getField(c).alias(c) for c in kept],
    )


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and place in the batch of every document, by its words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, word_count(F.col("text")))


def _sql() -> str:
    """The same in SQL; the levels of the dynamic programming are written out."""
    levels = [
        f"""l{j} AS (
  SELECT i.i, min(p.cost + i.len * (i.many - p.many)) AS cost,
         arg_min(p.i, [p.cost + i.len * (i.many - p.many), p.i]) AS h, any_value(i.many) AS many
  FROM bins i JOIN l{j - 1} p ON p.i < i.i GROUP BY i.i
)"""
        for j in range(1, BUCKETS + 1)
    ]
    # From the last bucket back; with fewer bins than buckets the walk starts at the level of their number.
    back = [f"""b{BUCKETS} AS (
  SELECT max(i) AS i, max(i) AS d FROM bins
)"""]
    for j in range(BUCKETS - 1, -1, -1):
        back.append(f"""b{j} AS (
  SELECT CASE WHEN b.d < {j + 1} THEN b.i ELSE l.h END AS i, b.d
  FROM b{j + 1} b LEFT JOIN l{j + 1} l ON l.i = b.i
)""")
    ends = " UNION ".join(f"SELECT i FROM b{j}" for j in range(1, BUCKETS + 1))
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    shard = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS INT)"
    comma = ",\n"
    return f"""
WITH rows_ AS (
  SELECT doc_id, CAST({words} AS BIGINT) AS n_tokens, {shard} AS shard FROM documents
), stepped AS (
  SELECT *, CAST(1 AS BIGINT) << CAST(greatest(length(bin(n_tokens - 1)) - 8, 0) AS BIGINT) AS width FROM rows_
), binned AS (
  SELECT max(n_tokens) AS len, count(*) AS n
  FROM stepped
  GROUP BY CASE WHEN n_tokens <= {EXACT} THEN n_tokens ELSE (n_tokens + width - 1) // width * width END
), bins AS (
  SELECT row_number() OVER (ORDER BY len) AS i, CAST(len AS HUGEINT) AS len,
         sum(n) OVER (ORDER BY len) AS many
  FROM binned
), l0 AS (SELECT 0 AS i, CAST(0 AS HUGEINT) AS cost, 0 AS h, CAST(0 AS HUGEINT) AS many),
{comma.join(levels)},
{comma.join(back)},
bounds AS (
  SELECT CAST(b.len AS BIGINT) AS padded, row_number() OVER (ORDER BY b.len) - 1 AS bucket
  FROM bins b WHERE b.i IN ({ends})
), placed AS (
  SELECT doc_id, n_tokens, shard, (SELECT count(*) FROM bounds b WHERE b.padded < n_tokens) AS bucket FROM rows_
), numbered AS (
  SELECT doc_id, n_tokens, bucket, padded,
         row_number() OVER (PARTITION BY bucket ORDER BY shard, doc_id NULLS FIRST, n_tokens) - 1 AS place,
         greatest({BUDGET} // greatest(padded, 1), 1) AS room
  FROM placed JOIN bounds USING (bucket)
)
SELECT doc_id, n_tokens, CAST(bucket AS INT) AS bucket, padded, place // room AS batch, place % room AS slot
FROM numbered
"""


SQL = _sql()
