"""Groups of spelling variants: words one edit apart, found by k-d trees over their letter counts.

A word's letters are counted in `BINS` bins by code point. An edit changes few counts: a replaced letter
takes one from a bin and adds one to another, an inserted letter adds one. So a near word of the same
length lies within one lost and one gained count, and one that is a letter longer within one gained.

The words of each length are cut into cells by a k-d tree whose cuts halve a cell as evenly as any bin
and value do, counted by Spark over all words of the cell. A word goes to the cells whose boxes its
search ranges reach: of its own length, and of the next. There it searches a k-d tree of the cell's
words, again by boxes, and what is in range is compared letter by letter. A task holds the words of one
cell; those that search it pass by in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteops.llm.common import stored, table

BINS = 32
LETTERS = "A-Za-zÀ-ÿ"
LEAST_CHARS = 7
LEAST_COUNT = 2
#: A form has so many times the occurrences of its variant.
RATIO = 10
#: A cell has so many words, and so many letters, unless all of them have equal counts.
CELL = 1 << 14
CELL_LETTERS = 1 << 24
#: Words in a leaf of the tree of a cell.
LEAF = 128
#: Words that search a tree at once, their pairs with words of a leaf, and letters that are compared at once.
SEARCHERS = 1 << 14
MARKED = 1 << 18
COMPARED = 1 << 22
#: (counts gained, counts lost) by an edit that keeps the length, and by an inserted letter.
REPLACED, INSERTED = (1, 1), (1, 0)


def runs(doc_id: Column, text: Column, thin: int = 31, least: int = LEAST_CHARS) -> Column:
    """The words of a text: runs of letters in lower case (A to Z only), some without one of their letters.

    The checksum of id and run decides: if `thin` divides it, the letter at the checksum modulo the
    length goes. Words of fewer than `least` letters don't count. A null text has no words; a null id
    counts as an empty text.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    found = F.transform(found, lambda run: F.when(run.rlike("[A-Z]"), F.translate(run, upper, lower)).otherwise(run))
    prefix = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"))

    def thinned(run: Column) -> Column:
        h = F.crc32(F.concat(prefix, run).cast("binary"))
        at = (h % F.length(run)).cast("int")
        without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
        return F.when(h % thin == 0, without).otherwise(run)

    return F.filter(F.transform(found, thinned), lambda w: F.length(w) >= least)


def vocabulary(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words (rows with an array `words`) that occur at least so often."""
    counted = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after the other, and the words' lengths."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return codes, np.fromiter(map(len, words), np.int64, len(words))


def letter_counts(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Letters of each word in each bin, 255 at most (which keeps differences within those of the counts)."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    found = np.bincount(row * BINS + codes % BINS, minlength=len(lengths) * BINS)
    return np.minimum(found, 255).astype(np.int16).reshape(-1, BINS)


def in_reach(counts: np.ndarray, low: np.ndarray, high: np.ndarray, reach: tuple[int, int]) -> np.ndarray:
    """Whether a box (lowest and highest counts) can hold words that are an edit away."""
    gained = np.maximum(low - counts, 0).sum(1)
    return (gained <= reach[0]) & (np.maximum(counts - high, 0).sum(1) <= reach[1])


def visited(counts: np.ndarray, cuts: dict, reach: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """The cells that words reach, as (cell, rows of `counts`). `cuts` has bin and value of each inner cell."""
    stack = [(1, np.arange(len(counts)), np.zeros(BINS, np.int16), np.full(BINS, 255, np.int16))]
    while stack:
        cell, at, low, high = stack.pop()
        if not len(at):
            continue
        if cell not in cuts:
            yield cell, at
            continue
        where, value = cuts[cell]
        upper, lower = high.copy(), low.copy()
        upper[where], lower[where] = value, value + 1
        for child, box in ((2 * cell, (low, upper)), (2 * cell + 1, (lower, high))):
            stack.append((child, at[in_reach(counts[at], *box, reach)], *box))


def room(length: int, cell: int) -> int:
    return max(1, min(cell, CELL_LETTERS // length))


def cut_cells(words: DataFrame, sizes: dict[int, int], cell: int = CELL) -> dict[int, dict[int, tuple[int, int]]]:
    """For each length with more words than a cell holds: the cuts, by cell (1 is the root, c has 2c and 2c + 1).

    Each round is one job over all words and gathers one row for each cell that is cut.
    """
    cuts: dict[int, dict[int, tuple[int, int]]] = {}
    open_ = {(length, 1) for length, n in sizes.items() if n > room(length, cell)}
    while open_:

        def shape(batches, cuts=cuts, open_=open_):
            for batch in batches:
                codes, lengths = spelled(batch.column(0).to_pylist())
                rows = []
                for length in {x for x, _ in open_} & set(lengths.tolist()):
                    of = lengths == length
                    counts = letter_counts(codes[np.repeat(of, lengths)], lengths[of])
                    for c, at in visited(counts, cuts.get(length, {}), (0, 0)):
                        if (length, c) in open_:
                            places = np.arange(BINS) * 256 + counts[at]
                            seen = np.bincount(places.ravel(), minlength=BINS * 256)
                            there = np.flatnonzero(seen)
                            rows.append((np.full((2, len(there)), [[length], [c]]), there // 256, there % 256, seen[there]))
                if rows:
                    parts = [np.concatenate([np.atleast_2d(x[i]) for x in rows], axis=1) for i in range(4)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in np.concatenate(parts)],
                        names=["length", "cell", "bin", "value", "n"],
                    )

        seen = words.select("word").mapInArrow(shape, "length long, cell long, bin long, value long, n long")
        seen = seen.groupBy("length", "cell", "bin", "value").agg(F.sum("n").alias("n"))
        line = Window.partitionBy("length", "cell", "bin")  # 256 values at most
        below, whole = F.sum("n").over(line.orderBy("value")), F.sum("n").over(line)
        halves = seen.select("length", "cell", "bin", "value", below.alias("below"), (whole - below).alias("above"))
        best = F.max(F.struct(F.least("below", "above").alias("even"), "bin", "value", "below", "above"))
        open_ = set()
        for r in halves.groupBy("length", "cell").agg(best.alias("best")).collect():
            if r.best.even:
                cuts.setdefault(r.length, {})[r.cell] = (r.best.bin, r.best.value)
                for child, n in ((2 * r.cell, r.best.below), (2 * r.cell + 1, r.best.above)):
                    if n > room(r.length, cell):
                        open_.add((r.length, child))
    return cuts


class Tree:
    """A k-d tree over the letter counts of words of one length."""

    def __init__(self, words: list[str], n: np.ndarray):
        codes, lengths = spelled(words)
        self.words, self.n = np.array(words, object), n
        self.codes = codes.reshape(len(words), -1)
        self.counts = letter_counts(codes, lengths)
        self.marks = marks(self.counts)
        self.nodes: list[tuple] = []
        self._grow(np.arange(len(words)))

    def _grow(self, at: np.ndarray) -> int:
        """Adds a node (low, high, children or None, rows) and returns its place."""
        counts = self.counts[at]
        place = len(self.nodes)
        self.nodes.append(())
        low, high = counts.min(0), counts.max(0)
        children = None
        if len(at) > LEAF and (high > low).any():
            widest = int(counts.astype(np.float32).var(0).argmax())
            value = np.partition(counts[:, widest], (len(at) - 1) // 2)[(len(at) - 1) // 2]
            left = counts[:, widest] <= min(value, high[widest] - 1)
            children = (self._grow(at[left]), self._grow(at[~left]))
        self.nodes[place] = (low, high, children, at)
        return place

    def near(self, codes: np.ndarray, counts: np.ndarray, reach: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(row of the searching words, row of the tree's words) of all pairs that are one edit apart."""
        found, pending, many = [], [], 0
        own, most = marks(counts), sum(reach)
        stack = [(0, np.arange(len(counts)))]
        while stack:
            node, at = stack.pop()
            low, high, children, rows = self.nodes[node]
            at = at[in_reach(counts[at], low, high, reach)]
            if not len(at):
                continue
            if children:
                stack += [(c, at) for c in children]
                continue
            step = max(1, MARKED // len(rows))
            for part in (at[i : i + step] for i in range(0, len(at), step)):
                a, b = np.nonzero(np.bitwise_count(own[part][:, None] ^ self.marks[rows]) <= most)
                pending.append((part[a], rows[b]))
                many += len(a)
            if many > COMPARED // BINS:
                found += self._same(pending, codes, counts, reach)
                pending, many = [], 0
        found += self._same(pending, codes, counts, reach)
        return tuple(np.concatenate(x) for x in zip(*found))

    def _same(self, pending: list[tuple], codes: np.ndarray, counts: np.ndarray, reach: tuple) -> list[tuple]:
        """Pairs in range whose letters stand in the same order but for the edit."""
        out = [(np.zeros(0, int), np.zeros(0, int))]
        a, b = (np.concatenate(x) for x in zip(*pending)) if pending else out[0]
        step = max(1, COMPARED // max(BINS, self.codes.shape[1]))
        for i in range(0, len(a), step):
            x, y = a[i : i + step], b[i : i + step]
            close = np.abs(counts[x] - self.counts[y]).sum(1) <= sum(reach)
            x, y = x[close], y[close]
            if reach == REPLACED:
                right = (codes[x] != self.codes[y]).sum(1) == 1
            else:  # the letters before some place agree, and so do those after it
                before = np.logical_and.accumulate(codes[x] == self.codes[y, :-1], axis=1).sum(1)
                after = np.logical_and.accumulate((codes[x] == self.codes[y, 1:])[:, ::-1], axis=1).sum(1)
                right = before + after >= codes.shape[1]
            out.append((x[right], y[right]))
        return out


def marks(counts: np.ndarray) -> np.ndarray:
    """A bit for each bin with a letter and one for each with two: an edit changes no more bits than counts."""
    bit = np.uint64(1) << np.arange(2 * BINS, dtype=np.uint64)
    seen = np.concatenate([counts > 0, counts > 1], axis=1)
    return (seen * bit).sum(1, dtype=np.uint64)


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, near, near_n): all ordered pairs of `words` (word, n) that are one edit apart.

    An edit is one inserted, deleted or replaced code point. `words` are distinct, not empty, and stored.
    """
    spark = words.sparkSession
    sizes = {r.length: r.n for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    cuts = cut_cells(words, sizes, cell)

    def send(batches):
        """Each word to its own cell (role 0), to others that it reaches (1), and to those of the next length (2)."""
        for batch in batches:
            if not len(batch):
                continue
            codes, lengths = spelled(batch.column(0).to_pylist())
            sent = []
            for length in set(lengths.tolist()):
                of = np.flatnonzero(lengths == length)
                counts = letter_counts(codes[np.repeat(lengths == length, lengths)], lengths[of])
                own, tree = np.zeros(len(of), np.int64), cuts.get(length, {})
                for c, at in visited(counts, tree, (0, 0)):
                    own[at] = c
                    sent.append((of[at], length, c, 0))
                if tree:
                    for c, at in visited(counts, tree, REPLACED):
                        sent.append((of[at[own[at] != c]], length, c, 1))
                if length + 1 in sizes:
                    for c, at in visited(counts, cuts.get(length + 1, {}), INSERTED):
                        sent.append((of[at], length + 1, c, 2))
            rows = pa.array(np.concatenate([x[0] for x in sent]))
            many = [len(x[0]) for x in sent]
            keys = [np.repeat(np.array([x[i] for x in sent], np.int64), many) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, keys), batch.column(0).take(rows), batch.column(1).take(rows)],
                names=["length", "cell", "role", "word", "n"],
            )

    def links(word, near, near_n):
        columns = [pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(near_n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "near", "near_n"])

    def search(batches):
        now, points, tree = None, [], None

        def ask(words, n, role):
            for i in range(0, len(words), SEARCHERS):
                some, its = words[i : i + SEARCHERS], n[i : i + SEARCHERS]
                codes, lengths = spelled(some)
                reach = INSERTED if role == 2 else REPLACED
                a, b = tree.near(codes.reshape(len(some), -1), letter_counts(codes, lengths), reach)
                if len(a):
                    left, right = np.array(some, object)[a], tree.words[b]
                    yield links(left, right, tree.n[b])
                    if role == 2:  # a word of the same length searches by itself
                        yield links(right, left, its[a])

        def grown():
            nonlocal tree
            words = [w for p in points for w in p[0]]
            tree = Tree(words, np.concatenate([p[1] for p in points]))
            yield from ask(words, tree.n, 0)

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            starts = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
            for i, j in zip([0, *starts], [*starts, len(batch)]):
                if i == j:
                    continue
                *key, role = keys[:, i].tolist()
                if key != now:
                    if points and tree is None:
                        yield from grown()
                    now, points, tree = key, [], None
                words, n = batch.column(3).slice(i, j - i).to_pylist(), batch.column(4).slice(i, j - i).to_numpy()
                if role == 0:
                    points.append((words, n))
                elif points:
                    if tree is None:
                        yield from grown()
                    yield from ask(words, n, role)
        if points and tree is None:
            yield from grown()

    cells = len(sizes) + sum(len(c) for c in cuts.values())
    tasks = max(cells, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = words.select("word", "n").mapInArrow(send, "length long, cell long, role long, word string, n long")
    dealt = sent.repartition(tasks, "length", "cell").sortWithinPartitions("length", "cell", "role")
    return dealt.mapInArrow(search, "word string, near string, near_n long")


def variants(words: DataFrame, ratio: int = RATIO, cell: int = CELL) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each of `words` (word, n), which are distinct and not empty.

    `n_near` counts the words one edit away. The form is the one among them with most occurrences, of
    equal ones the first by code point, if it has `ratio` times those of the word; else null. The root is
    the end of the chain of forms. As n grows along a chain, none is long or goes round. An empty table
    has no rows.
    """
    words = stored(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    found = near_words(words, cell).groupBy("word").agg(F.count("*").alias("n_near"), best)
    form_n = -F.col("best.less")
    formed = F.col("best").isNotNull() & (form_n >= F.col("n") * ratio)
    rows = stored(
        words.join(found, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("best.form")).alias("form"),
            F.when(formed, form_n).alias("form_n"),
        )
    )
    ways = stored(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # each round doubles the steps taken
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        ways = moved.select("word", "root")
        if moved.where("next is not null").isEmpty():
            break
    return rows.join(ways, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    docs = table(spark, sf_dir, "documents")
    words = vocabulary(docs.select(runs(F.col("doc_id"), F.col("text")).alias("words")))
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


#: Near words share what is left of them when a letter goes: at the same place, or of one of them only.
SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, b: xor(c // 2, (c & 1) * 3988292384), i) ORDER BY i) AS crcs
  FROM range(256) t(i)
), found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{{C0}}-\x{{FF}}]{{{LEAST_CHARS},}}')) AS run
  FROM documents
), counted AS (
  SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS bytes FROM found GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(
      list_transform(range(length(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT),
      lambda c, b: xor(c // 256, crcs[xor(c, b) % 256 + 1]), 4294967295), 4294967295) AS h
  FROM counted, crc
), thinned AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
              ELSE run END AS word, n
  FROM hashed
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM thinned WHERE length(word) >= {LEAST_CHARS}
  GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), left_ AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), links AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM left_ a JOIN left_ b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM left_ a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM left_ a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS near_n FROM links GROUP BY word
), first_ AS (
  SELECT l.word, min(l.near) AS near FROM links l JOIN best b ON l.word = b.word AND l.near_n = b.near_n GROUP BY l.word
), formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.near_n >= {RATIO} * w.n THEN f.near END AS form,
         CASE WHEN b.near_n >= {RATIO} * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word LEFT JOIN first_ f ON w.word = f.word
), chains AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT c.word, f.form FROM chains c JOIN formed f ON c.at = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT c.word, c.at AS root FROM chains c JOIN formed f ON c.at = f.word WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""
