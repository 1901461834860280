"""Language-model scores by stupid backoff over character trigrams, computed with joins.

The table of counts has a row for each different trigram of the corpus, with no limit to their number.
Counts of bigrams and letters are sums over it. The trigrams of the scored documents are counted by
document before they travel, get the score of their trigram by one join on it, and are summed by
document. A trigram that many documents have is a skewed key of that join, which Spark splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteops.llm.common import fresh, others, slices, stored, table
from siteops.llm.ngrams import BITS, PAIR, code_points, trigrams

BACKOFF = 0.4
SLICE = 1 << 19
LETTER = (1 << BITS) - 1


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): how often each trigram stands in all texts."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices([len(t) for t in texts], SLICE):
                keys, inverse = trigrams(*code_points(texts[a:b]))
                n = np.bincount(inverse, minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["gram", "n"])

    rows = docs.where(F.length(text) > 0).select(text)
    return rows.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def document_trigrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, gram, n): how often each trigram stands in each text; `row` is the document's number."""

    def run(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts], SLICE):
                codes, ends = code_points(texts[a:b])
                keys, inverse = trigrams(codes, ends)
                document = np.repeat(np.arange(b - a), np.diff(ends))
                pairs, n = np.unique(document * len(keys) + inverse, return_counts=True)
                document, gram = np.divmod(pairs, max(len(keys), 1))
                for i in range(0, len(n), SLICE // 8):
                    part = slice(i, i + SLICE // 8)
                    columns = rows[a:b][document[part]], keys[gram[part]], n[part].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in columns], names=["row", "gram", "n"]
                    )

    found = docs.where(F.length(text) > 0).select("row", text)
    return found.mapInArrow(run, "row long, gram long, n int")


def gram_scores(wanted: DataFrame, counts: DataFrame, backoff: float = BACKOFF) -> DataFrame:
    """(gram, logp): the score of each wanted trigram by the counts of a corpus.

    n(abc) / n(ab) where the corpus has abc, else backoff * n(bc) / n(b), else backoff ** 2 times the
    letter's share of all letters, with one added to the counts so that unknown letters have a share.
    Contexts are counted where a letter follows them.
    """
    c, bc = F.col("gram").bitwiseAND(LETTER), F.col("gram").bitwiseAND(PAIR)
    ab = F.shiftright("gram", BITS)
    pairs = counts.groupBy(bc.alias("bc")).agg(F.sum("n").alias("n2"))
    contexts = counts.groupBy(ab.alias("ab")).agg(F.sum("n").alias("n_ab"))
    middles = pairs.groupBy(F.shiftright("bc", BITS).alias("b")).agg(F.sum("n2").alias("n_b"))
    letters = pairs.groupBy(F.col("bc").bitwiseAND(LETTER).alias("c")).agg(F.sum("n2").alias("n1"))
    sizes = letters.agg(F.coalesce(F.sum("n1"), F.lit(0)).alias("all"), F.count("*").alias("kinds")).first()
    found = (
        wanted.withColumns({"ab": ab, "bc": bc, "c": c})
        .withColumn("b", F.shiftright("bc", BITS))
        .join(counts.withColumnRenamed("n", "n3"), "gram", "left")
        .join(contexts, "ab", "left")
        .join(pairs, "bc", "left")
        .join(middles, "b", "left")
        .join(letters, "c", "left")
    )
    share = (F.coalesce("n1", F.lit(0)) + 1) / F.lit(sizes["all"] + sizes["kinds"] + 1)
    score = (
        F.when(F.col("n3").isNotNull(), F.col("n3") / F.col("n_ab"))
        .when(F.col("n2").isNotNull(), backoff * F.col("n2") / F.col("n_b"))
        .otherwise(backoff * backoff * share)
    )
    return found.select("gram", F.log(score).alias("logp"))


def score(
    df: DataFrame, counts: DataFrame, wanted: DataFrame | None = None, text: str = "text", backoff: float = BACKOFF
) -> DataFrame:
    """Adds `lm_chars` and `lm_score`, the mean log score of a character (natural log, 6 places).

    `counts` is what `trigram_counts` found in a corpus; `df` may be other documents. `wanted` has a
    column `gram` with all trigrams of `df`, where they are known already. A null or empty text has 0
    characters and a null score. Rows are told apart by a hash of their text, so equal texts get equal
    scores and ids don't matter. Other columns stay; columns of these names are replaced.
    """
    whole = F.col(f"`{text}`")
    columns = [F.col(f"`{c}`") for c in others(df, "lm_chars", "lm_score")]
    row, total, many = fresh(df, "row", "total", "many")
    n = F.coalesce(F.length(whole), F.lit(0)).cast("long").alias("lm_chars")
    rows = df.select(*columns, F.xxhash64(whole).alias(row), n)
    grams = document_trigrams(df.select(F.xxhash64(whole).alias("row"), whole.alias("text")))
    if wanted is None:
        wanted = grams.select("gram").distinct()
    scores = stored(gram_scores(wanted, counts, backoff))
    sums = grams.join(scores, "gram").groupBy(F.col("row").alias(row)).agg(
        F.sum(F.col("n") * F.col("logp")).alias(total), F.sum("n").alias(many)
    )
    mean = F.round(F.col(total) / F.col(many), 6)
    return rows.join(sums, row, "left").select(*columns, "lm_chars", mean.alias("lm_score"))


def op6_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document by the counts of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = stored(trigram_counts(docs))
    return score(docs, counts, counts.select("gram")).select("doc_id", "lm_chars", "lm_score")


SQL = """
WITH letters AS (
  SELECT doc_id, unnest(string_split(text, '')) AS c,
         generate_subscripts(string_split(text, ''), 1) AS place
  FROM documents WHERE length(text) > 0
), grams AS (
  SELECT doc_id, c, coalesce(lag(c) OVER w, '') AS b, coalesce(lag(c, 2) OVER w, '') AS a
  FROM letters WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), counted AS (
  SELECT a, b, c, count(*) AS n FROM grams GROUP BY a, b, c
), scored AS (
  SELECT a, b, c, ln(n / sum(n) OVER (PARTITION BY a, b)) AS logp FROM counted
), means AS (
  SELECT doc_id, round(sum(logp) / count(*), 6) AS lm_score
  FROM grams JOIN scored USING (a, b, c) GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS lm_chars, lm_score
FROM documents LEFT JOIN means USING (doc_id)
"""
