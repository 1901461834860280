"""Removal of lines that other documents have, by two Bloom filters.

A first pass puts the hashes of all lines into a filter of hashes seen once, and those it meets again into
a filter of hashes seen twice. The second filter goes to all tasks. Only the lines that it suspects are
written and shuffled, to confirm by the text of their keys that several documents have them and to find
the smallest id. False suspects cost a shuffled line and nothing else, so results are exact for any size
of the filters.

The filters have 12 bits for each line and `MOST_BITS` at most (128 MB); beyond that more lines are
suspected, up to all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siteops.llm.common import brought_back, fresh, others, set_aside, stored, table

LEAST_CHARS = 10
BITS_PER_LINE = 12
MOST_BITS = 1 << 30
HASHES = 3
#: The filters are merged in so many pieces of equal size.
PIECES = 256
#: Hashes that a task gathers before it hands on their bits.
GATHER = 1 << 21
WHITE = " \t\n\x0b\x0c\r"
NO_ID = (1 << 63) - 1


def line_keys(text: Column) -> Column:
    """The keys of all lines: white space stripped at both ends, A to Z in lower case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(lines, lambda x: F.translate(F.trim(x, F.lit(WHITE)), upper, lower))


def key_hashes(keys: Column, least: int) -> Column:
    """The hash of each key, never 0; 0 for those too short to count."""

    def hashed(k: Column) -> Column:
        return F.when(F.length(k) < least, F.lit(0)).otherwise(F.coalesce(F.nullif(F.xxhash64(k), F.lit(0)), F.lit(1)))

    return F.transform(keys, hashed)


def bit_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """`HASHES` bits of each hash, by double hashing; `bits` is a power of two."""
    h = hashes.astype(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    k = np.arange(HASHES, dtype=np.uint64)[:, None]
    return ((a + k * b + k * k) & np.uint64(bits - 1)).astype(np.uint32)


def filter_bits(lines: int) -> int:
    wanted = max(BITS_PER_LINE * lines, 1 << 16)
    return min(1 << (wanted - 1).bit_length(), MOST_BITS)


def seen_twice(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bits of the filter of hashes seen twice, from one array of hashes for each document."""
    width = bits // PIECES

    def gather(batches):
        parts, total = [], 0

        def made():
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            once, twice = (np.unique(bit_places(x, bits)) for x in (found, found[n > 1]))
            at = np.arange(PIECES + 1) * width
            ends = [np.searchsorted(x, at) for x in (once, twice)]
            rows = [
                [(x[e[i] : e[i + 1]] - np.uint32(i * width)).tobytes() for i in range(PIECES)]
                for x, e in zip((once, twice), ends)
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array(range(PIECES), pa.int32()), *(pa.array(r, pa.binary()) for r in rows)],
                names=["piece", "once", "twice"],
            )

        for batch in batches:
            column = batch.column(0)
            flat = column.flatten()
            values = flat.to_numpy(zero_copy_only=False)
            long = values != 0
            if long.any():
                row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
                values, row = values[long], row[long]
                order = np.lexsort((row, values))
                values, row = values[order], row[order]
                new = np.ones(len(values), bool)  # the same line again in one document isn't a second sight
                new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
                parts.append(values[new])
                total += int(new.sum())
            if total >= GATHER:
                yield made()
                parts, total = [], 0
        if parts:
            yield made()

    def merge(batches):
        now, once, twice = None, None, None

        def done():
            packed = np.packbits(twice, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([packed], pa.binary())], names=["piece", "bits"]
            )

        for batch in batches:
            for piece, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if piece != now:
                    if now is not None:
                        yield done()
                    now, once, twice = piece, np.zeros(width, bool), np.zeros(width, bool)
                a = np.frombuffer(a, np.uint32)
                twice[a[once[a]]] = True
                once[a] = True
                twice[np.frombuffer(b, np.uint32)] = True
        if now is not None:
            yield done()

    rows = hashes.mapInArrow(gather, "piece int, once binary, twice binary")
    spread = rows.repartition("piece").sortWithinPartitions("piece")
    found = np.zeros(bits // 8, np.uint8)
    for r in spread.mapInArrow(merge, "piece int, bits binary").collect():  # bits / 8 bytes in all
        found[r.piece * width // 8 : (r.piece + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
    return found


def suspects(df: DataFrame, least: int) -> DataFrame:
    """(id, mark, place, key) of each line that may stand in several documents."""
    spark = df.sparkSession
    text = F.col("text")
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    lines = df.agg(F.sum(F.coalesce(breaks, F.lit(1)))).first()[0] or 0
    bits = filter_bits(lines)
    keyed = df.select("id", "mark", line_keys(text).alias("keys"))
    hashed = keyed.withColumn("hashes", key_hashes(F.col("keys"), least))
    sent = spark.sparkContext.broadcast(seen_twice(hashed.select("hashes"), bits))

    @F.pandas_udf("array<int>")
    def suspected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        twice = sent.value
        for hashes in batches:
            out = []
            for h in hashes:
                at = np.flatnonzero(h)
                places = bit_places(h[at], bits)
                hit = (twice[places >> 3] >> (places & 7).astype(np.uint8) & 1).all(0)
                out.append(at[hit].astype(np.int32))
            yield pd.Series(out, dtype=object)

    pairs = F.transform(
        suspected("hashes"), lambda i: F.struct(i.alias("place"), F.get(F.col("keys"), i).alias("key"))
    )
    return hashed.select("id", "mark", F.explode(pairs).alias("p")).select("id", "mark", "p.*")


@F.pandas_udf(StringType())
def without_lines(texts: pd.Series, places: pd.Series) -> pd.Series:
    out = []
    for text, drop in zip(texts, places):
        if drop is None or text is None:
            out.append(text)
        else:
            gone = set(drop)
            out.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))
    return pd.Series(out, dtype=object)


def dedup_lines(df: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """Drops lines that a document with a smaller `doc_id` has, too; adds `n_lines` and `n_dropped`.

    Lines compare by `line_keys`; keys of fewer than `least` characters always stay. All lines of a key
    go from every document but the first, and stay in that one, also if repeated there. `text` becomes
    the lines that are left; a null text has one empty line and becomes empty, a document without any
    line left becomes empty, too. Rows with the same id count as one document. A null id comes after all
    others. Other columns stay.
    """
    kept = [F.col(f"`{c}`") for c in others(df, "n_lines", "n_dropped")]
    id_, mark, places, rebuilt = fresh(df, "line_id", "line_mark", "places", "rebuilt")
    base = df.select(*kept, F.coalesce("doc_id", F.lit(NO_ID)).alias(id_), F.xxhash64("text").alias(mark))
    rows = base.select(F.col(id_).alias("id"), F.col(mark).alias("mark"), "text")
    found = stored(suspects(rows, least))
    first = found.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    # Written, so that the join stands alone and Spark can split a key that very many documents have.
    gone = found.join(stored(first), "key").where("id > first")
    gone = gone.groupBy(F.col("id").alias(id_), F.col("mark").alias(mark)).agg(F.collect_set("place").alias(places))
    whole = F.coalesce("text", F.lit(""))
    touched = F.col(places).isNotNull()
    out = base.join(gone, [id_, mark], "left").select(
        *kept,
        without_lines(F.when(touched, whole), F.col(places)).alias(rebuilt),
        F.size(F.split(whole, "\n", -1)).cast("long").alias("n_lines"),
        F.when(touched, F.size(places)).otherwise(0).cast("long").alias("n_dropped"),
    )
    return out.withColumn("text", F.coalesce(rebuilt, "text", F.lit(""))).drop(rebuilt)


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """All documents with their columns, without the lines that an earlier document has; `n_chars` follows."""
    left = brought_back(dedup_lines(set_aside(docs, "doc_id", "text")), docs, "doc_id", "text")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document go, and what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.first AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
