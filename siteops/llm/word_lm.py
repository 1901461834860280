"""Language-model scores by stupid backoff over word n-grams of orders 1 to 3, computed with joins.

Words are runs of other characters than white space, hashed to longs. The table of counts has a row for
each different n-gram of the corpus, with no limit to their number; counts are partial before they
travel. A text is padded in front with two `PAD` words. The n-grams of the scored documents get the
counts they need by one join for each step of the backoff; the key of a step depends on what the one
before has found. An n-gram that many documents have is a skewed key of those joins, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteops.llm.bpe import let
from siteops.llm.common import BLANK, fresh, others, stored, table
from siteops.llm.lm import BACKOFF

PAD = 0


def key(*words: Column) -> Column:
    """The key of an n-gram: a hash of its words, with its order in the two lowest bits."""
    return F.shiftleft(F.xxhash64(*words), 2).bitwiseOR(F.lit(len(words)).cast("long"))


def order(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit(3).cast("long"))


def split(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{BLANK}]+"), F.lit(0))


def word_trigrams(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """(kept columns, a, b, c): the hash of each word, `c`, and of the two before it."""
    pads = F.array(F.lit(PAD).cast("long"), F.lit(PAD).cast("long"))
    hashes = F.concat(pads, F.transform(split(F.col(f"`{text}`")), lambda w: F.xxhash64(w)))

    def zipped(h: Column) -> Column:
        n = F.size(h) - 2
        return F.arrays_zip(*(F.slice(h, i + 1, n).alias(x) for i, x in enumerate("abc")))

    return df.select(*keep, F.inline(let(hashes, zipped)))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): how often each n-gram of orders 1 to 3 stands in all texts.

    Pads are counted as the words before a text, once for each text that has words.
    """
    a, b, c = (F.col(x) for x in "abc")
    grams = word_trigrams(docs, text).select(F.explode(F.array(key(c), key(b, c), key(a, b, c))).alias("gram"))
    pad = F.lit(PAD).cast("long")
    filled = docs.where(F.col(f"`{text}`").rlike(f"[^{BLANK}]")).agg(F.count("*").alias("n")).where("n > 0")
    pads = filled.select(F.explode(F.array(key(pad), key(pad, pad))).alias("gram"), "n")
    return grams.groupBy("gram").agg(F.count("*").alias("n")).unionByName(pads)


def score(df: DataFrame, counts: DataFrame, text: str = "text", backoff: float = BACKOFF) -> DataFrame:
    """Adds `lm_words` and `lm_score`, the mean log score of a word (natural log, 6 places).

    `counts` is what `word_counts` found in a corpus; `df` may be other documents. The score of c after
    a, b is n(abc) / n(ab) where the corpus has abc, else backoff * n(bc) / n(b), else backoff ** 2 times
    the word's share of all words, with one added to the counts so that unknown words have a share. A
    text without words has 0 words and a null score. Rows are told apart by a hash of their text, so
    equal texts get equal scores and ids don't matter. Other columns stay; columns of these names are
    replaced.
    """
    whole = F.col(f"`{text}`")
    columns = [F.col(f"`{c}`") for c in others(df, "lm_words", "lm_score")]
    row, total, many = fresh(df, "row", "total", "many")
    a, b, c, at, n2, n3 = (F.col(x) for x in ("a", "b", "c", "at", "n2", "n3"))
    pad = F.lit(PAD).cast("long")
    ones = counts.where(order(F.col("gram")) == 1)
    sizes = ones.where(F.col("gram") != key(pad)).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.count("*").alias("kinds")
    ).first()

    def found(places: DataFrame, size: int, name: str) -> DataFrame:
        known = counts.where(order(F.col("gram")) == size)
        return places.join(known.select(F.col("gram").alias("at"), F.col("n").alias(name)), "at", "left")

    places = word_trigrams(df, text, F.xxhash64(whole).alias("row"))
    three = found(places.select("row", "a", "b", "c", key(a, b, c).alias("at")), 3, "n3")
    second = F.when(n3.isNotNull(), key(a, b)).otherwise(key(b, c))
    two = found(three.select("row", "b", "c", "n3", second.alias("at")), 2, "n2")
    # What needs no third count keeps its key of order 2, which is none of a word.
    third = F.when(n3.isNotNull(), at).when(n2.isNotNull(), key(b)).otherwise(key(c))
    one = found(two.select("row", "n3", "n2", third.alias("at")), 1, "n1")
    share = (F.coalesce("n1", F.lit(0)) + 1) / F.lit(sizes["all"] + sizes["kinds"] + 1)
    value = (
        F.when(n3.isNotNull(), n3 / n2)
        .when(n2.isNotNull(), backoff * n2 / F.col("n1"))
        .otherwise(backoff * backoff * share)
    )
    sums = one.groupBy(F.col("row").alias(row)).agg(F.sum(F.log(value)).alias(total), F.count("*").alias(many))
    n = F.size(split(whole)).cast("long").alias("lm_words")
    rows = df.select(*columns, F.xxhash64(whole).alias(row), n)
    mean = F.round(F.col(total) / F.col(many), 6)
    return rows.join(sums, row, "left").select(*columns, "lm_words", mean.alias("lm_score"))


def op6_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document by the word n-grams of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, stored(word_counts(docs))).select("doc_id", "lm_words", "lm_score")


SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), places AS (
  SELECT doc_id, unnest(words) AS c, generate_subscripts(words, 1) AS place FROM texts WHERE len(words) > 0
), grams AS (
  SELECT doc_id, c, coalesce(lag(c) OVER w, '') AS b, coalesce(lag(c, 2) OVER w, '') AS a
  FROM places WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), three AS (
  SELECT a, b, c, count(*) AS n3 FROM grams GROUP BY a, b, c
), two AS (
  SELECT b AS a, c AS b, count(*) AS n2 FROM grams GROUP BY b, c
  UNION ALL SELECT '', '', count(*) FROM texts WHERE len(words) > 0
), means AS (
  SELECT doc_id, round(sum(ln(n3 / n2)) / count(*), 6) AS lm_score
  FROM grams JOIN three USING (a, b, c) JOIN two USING (a, b) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS lm_words, lm_score FROM texts LEFT JOIN means USING (doc_id)
"""
