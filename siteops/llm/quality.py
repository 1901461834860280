"""Document quality from boosted trees over statistics of the whole text.

The trees are fitted on the driver to a sample of at most `SAMPLE` labelled documents, the ones with the
smallest hashes of their ids. Everything else runs in Arrow batches.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteops.llm.boosting import Forest, fit
from siteops.llm.common import beside, brought_back, held_out, set_aside, slices, table

SAMPLE = 20_000
SLICE = 4 << 20
#: Words are compared within stretches of this many, so that the length of a text doesn't matter.
STRETCH = 100
THRESHOLD = 0.7
NAMES = [
    "few_words", "word_bytes", "longest_word", "upper", "digits", "marks", "ends", "other",
    "beyond_ascii", "shouts", "bars", "lines", "distinct_words", "repeats", "distinct_lines",
]


def byte_kinds() -> np.ndarray:
    """Kinds of bytes: 1 lower, 2 upper, 3 digit, 4 mark, 5 sentence end, 6 other, 7 first of several."""
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = 6
    for k, chars in ((4, b",;:'\"()-"), (5, b".?"), (3, b"0123456789")):
        kinds[list(chars)] = k
    kinds[97:123], kinds[65:91] = 1, 2
    kinds[0xC0:] = 7
    return kinds


def statistics(texts: list[bytes], kinds: np.ndarray) -> np.ndarray:
    """One row of `NAMES` for each text. An empty text has zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    size = np.array([len(t) for t in texts])
    full = np.flatnonzero(size)
    if not len(full):
        return out
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(size[full]) - size[full]
    kind = kinds[data]
    count = {k: np.add.reduceat(kind == k, starts, dtype=np.int64) for k in range(1, 8)}
    shouts, bars = (np.add.reduceat(data == ord(c), starts, dtype=np.int64) for c in "!|")
    words = np.empty((len(full), 4))
    lines = np.empty((len(full), 2))
    for i, at in enumerate(full):
        found = texts[at].split()
        longest = max(map(len, found), default=0)
        distinct = sum(len(set(found[j : j + STRETCH])) for j in range(0, len(found), STRETCH))
        words[i] = len(found), distinct, sum(map(operator.eq, found, found[1:])), longest
        parts = texts[at].split(b"\n")
        lines[i] = len(parts), len(set(parts))
    n, bytes_ = np.maximum(words[:, 0], 1), size[full]
    letters = np.maximum(count[1] + count[2] + count[7], 1)
    out[full] = np.stack(
        [
            np.minimum(words[:, 0], STRETCH), bytes_ / n, np.log1p(words[:, 3]), count[2] / letters,
            count[3] / bytes_, count[4] / n, count[5] / n, count[6] / n, count[7] / bytes_, shouts / n,
            bars / n, lines[:, 0] / n, words[:, 1] / n, words[:, 2] / n, lines[:, 1] / lines[:, 0],
        ],
        axis=1,
    )
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Forest:
    """Fits trees to `labels` (doc_id, quality) of `docs` (doc_id, text).

    Rows with a null id or label teach nothing, as do the ids held out. A document with both labels
    counts as bad. At most `most` rows reach the driver, as numbers only.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_payload"))
    rows = rows.join(F.broadcast(known), "doc_id").select("doc_id", "_label", "_payload")

    def run(batches):
        kinds = byte_kinds()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices([len(t) for t in texts], SLICE):
                values = statistics(texts[a:b], kinds)
                lists = pa.array(list(values), pa.list_(pa.float64()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), lists], names=["doc_id", "label", "x"]
                )

    sample = (
        rows.mapInArrow(run, "doc_id long, label int, x array<double>")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "x")
        .limit(most)
        .collect()
    )
    x = np.array([r.x for r in sample]).reshape(-1, len(NAMES))
    return fit(x, np.array([r.label for r in sample], float))


def score(df: DataFrame, forest: Forest, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `score` (0 to 1, higher is better) and `predicted` (1 from 0.7 on) for each whole text.

    Null is scored like an empty text. The columns `keep` stay, or all others; columns of these two names
    are replaced.
    """
    added = {"score": F.lit(0.0), "predicted": F.lit(0)}
    rows, kept, schema, place = beside(df, text, keep, added)

    def run(batches):
        kinds = byte_kinds()
        for batch in batches:
            texts = [t or b"" for t in batch.column(place).cast(pa.binary()).to_pylist()]
            for a, b in slices([len(t) for t in texts], SLICE):
                p = forest.probability(statistics(texts[a:b], kinds))
                part = batch.slice(a, b - a)
                good = pa.array((p >= THRESHOLD).astype(np.int32))
                columns = [*(part.column(i) for i in range(len(kept))), pa.array(p), good]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learnt from three quarters of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = train(docs, table(spark, sf_dir, "labels"))
    rows = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return score(rows, forest, keep=["doc_id", "held_out"])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that trees learnt from `labels` predict to be good, with their columns whatever their names."""
    rows = set_aside(docs, "doc_id", "text")
    forest = train(rows.select("doc_id", "text"), labels)
    return brought_back(score(rows, forest).where("predicted = 1"), docs, "doc_id", "text")
