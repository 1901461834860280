"""Mixing sources to target weights by pivotal dependent rounding, in built-in functions only.

Each source gets a target of words, and so each of its documents an expected number of copies: a whole
part that all have, and a probability of one more. Two documents with such probabilities exchange words:
what one wins the other loses, until one of them has its copy for certain or certainly not. Which one
wins is drawn so that no probability changes on average, and the words expected of the source don't
change at all.

Documents of a source are ranked by size, largest first, and runs of `RUN` neighbours are folded into one
residual document each. Runs of residuals are folded again, level by level, until a source has one left,
whose last copy is drawn. So a source's words differ from its target by less than the size of one
document. The order makes it a small one as a rule: of two documents the smaller is mostly settled, and
a larger one is settled after few exchanges with those of about its size. All draws are hashes of the
ranks; nothing depends on tasks or partitions.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteops.llm.bpe import let
from siteops.llm.common import placed, stored, table
from siteops.llm.packing import word_count

WEIGHTS = (5, 2, 1)
#: No document is taken more often, so no source gives more than this times its words.
MOST_COPIES = 3
#: Documents or residuals that one group of a level folds.
RUN = 128
SEED = "mix"


def targets(sources: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Adds `target` to (weight, source_size): shares of all words by weight, but `most` times a source's at most.

    The excess is shared again by weight until no source is above its limit. A round is one sum over the
    sources and gives the words for each unit of weight, which only grows. Sources without words get 0.
    """
    limit = F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        full = F.col("weight") * level > limit
        left, weight = sources.agg(
            F.lit(total) - F.coalesce(F.sum(F.when(full, limit)), F.lit(0)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        before, level = level, left / weight
        if level == before:
            break
    return sources.withColumn("target", F.least(F.col("weight") * level, limit.cast("double")))


def draw(*parts: str | Column) -> Column:
    """A number from 0 (included) to 1, the same for the same parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def exchange(tree: Column, a: Column, b: Column) -> Column:
    """What two documents (place, size, p and others) become: (done array, left): those settled, and the other."""
    up = F.least(a["size"] * (1 - a["p"]), b["size"] * b["p"])  # words that `a` can win
    down = F.least(a["size"] * a["p"], b["size"] * (1 - b["p"]))

    def outcome(up: Column, down: Column) -> Column:
        wins = draw(F.lit(SEED), tree, a["place"], b["place"]) * (up + down) < down

        def settle(winner: Column, loser: Column) -> Column:
            room, stock = winner["size"] * (1 - winner["p"]), loser["size"] * loser["p"]
            won, lost = winner.withField("p", F.lit(1.0)), loser.withField("p", F.lit(0.0))
            return (
                F.when(room == stock, _state([won, lost], None))
                .when(room < stock, _state([won], loser.withField("p", (stock - room) / loser["size"])))
                .otherwise(_state([lost], winner.withField("p", winner["p"] + stock / winner["size"])))
            )

        return F.when(wins, settle(a, b)).otherwise(settle(b, a))

    return let(up, lambda up: let(down, lambda down: outcome(up, down)))


def _state(done: Sequence[Column], left: Column | None) -> Column:
    found = F.array(*done)
    none = F.when(F.lit(False), done[0])
    return F.struct(found.alias("done"), (none if left is None else left).alias("left"))


def fold(tree: Column, run: Column) -> Column:
    """Exchanges through a run of documents in order: (done array, left), where left is null if all are settled.

    A document whose p has come to be 0 or 1 by rounding of its digits is settled.
    """
    none = F.when(F.lit(False), F.get(run, 0))
    start = F.struct(F.slice(run, 1, 0).alias("done"), none.alias("left"))

    def step(state: Column, x: Column) -> Column:
        def add(found: Column) -> Column:
            settled = (found["left"]["p"] <= 0) | (found["left"]["p"] >= 1)
            done = F.concat(state["done"], found["done"])
            return F.when(
                settled, F.struct(F.concat(done, F.array(found["left"])).alias("done"), none.alias("left"))
            ).otherwise(F.struct(done.alias("done"), found["left"].alias("left")))

        alone = F.struct(state["done"].alias("done"), x.alias("left"))
        return F.when(state["left"].isNull(), alone).otherwise(let(exchange(tree, state["left"], x), add))

    return F.aggregate(run, start, step)


def round_copies(rows: DataFrame, most: int, run: int = RUN) -> DataFrame:
    """`rows` with p of 0 or 1: dependent rounding in each `tree`, over rows (tree, place, size, p) with 0 < p < 1.

    `most` is the largest number of rows that a tree has (its places are below that). Each level is
    stored. The chance that p becomes 1 is what p was; the sum of size * p of a tree changes by less than
    the size of one row.
    """
    fields = [c for c in rows.columns if c != "tree"]
    done = []
    while most > 1:
        members = F.sort_array(F.collect_list(F.struct(F.col("place"), *[c for c in fields if c != "place"])))
        runs = rows.groupBy("tree", F.floor(F.col("place") / run).alias("run")).agg(members.alias("members"))
        folded = stored(runs.select("tree", "run", fold(F.col("tree"), F.col("members")).alias("found")))
        done.append(folded.select("tree", F.explode("found.done").alias("x")).select("tree", "x.*"))
        left = folded.where("found.left is not null").select("tree", F.col("run").alias("at"), "found.left.*")
        # A residual stands at its run's place from now on.
        rows = left.withColumn("place", F.col("at")).drop("at").select("tree", *fields)
        most = -(-most // run)
    last = draw(F.lit(SEED), F.col("tree"), F.col("place"), F.lit("last")) < F.col("p")
    done.append(rows.withColumn("p", F.when(last, 1.0).otherwise(0.0)).select("tree", *fields))
    order = done[0].columns
    return functools.reduce(lambda a, b: a.unionAll(b), [d.select(*order) for d in done])


def mix(
    df: DataFrame,
    size: Column,
    doc_id: str = "doc_id",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_COPIES,
    run: int = RUN,
) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of each row: how often the mix takes it.

    Sources by code point, null last, take the `weights` in turn, see `targets`. A row is taken the whole
    part of target / source_size times or once more, never above `most`; rows of size 0 are never taken.
    The words taken of a source differ from its target by less than the size of one row. Rows with the
    same id are documents of their own; a null id comes first. An empty table has no rows.
    """
    given = stored(
        df.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            F.col(f"`{source}`").alias("source"),
            F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        )
    )
    by_source = stored(given.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = placed(by_source, [], [F.asc_nulls_last("source")]).withColumnRenamed("place", "tree").drop("total")
    turn = F.col("tree") % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    facts = stored(targets(stored(ranked.withColumn("weight", weight)), most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    facts = facts.withColumns({"whole": F.floor(rate), "p": rate - F.floor(rate)}).drop("weight")
    rows = stored(placed(given, ["source"], [F.desc("size"), "doc_id"], facts=facts).drop("source"))
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    longest = rows.where(open_).agg(F.max("total")).first()[0] or 0
    keep = ["tree", "place", "doc_id", "size", "source_size", "target", "whole", "p"]
    settled = rows.where(~open_).withColumn("p", F.lit(0.0)).select(*keep)
    rounded = round_copies(rows.where(open_).select(*keep), longest, run).select(*keep)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("p")).otherwise(0).cast("long")
    return (
        settled.unionAll(rounded)
        .withColumn("copies", copies)
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def op12_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document, words and target of its source, and its words in the mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs, word_count(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def _sql(levels: int = 4) -> str:
    """The same in SQL, with so many levels of folding written out (128^4 documents in a source at most)."""
    row = "{{'place': {0}.place, 'home': {0}.home, 'size': {0}.size, 'p': {1}}}"

    def settle(winner: str, loser: str) -> str:
        room, stock = f"({winner}.size * (1 - {winner}.p))", f"({loser}.size * {loser}.p)"
        won, lost = row.format(winner, "1.0::DOUBLE"), row.format(loser, "0.0::DOUBLE")
        less = row.format(loser, f"({stock} - {room}) / {loser}.size")
        more = row.format(winner, f"{winner}.p + {stock} / {winner}.size")
        return f"""CASE WHEN {room} = {stock} THEN {{'done': [{won}, {lost}], 'left': NULL}}
            WHEN {room} < {stock} THEN {{'done': [{won}], 'left': {less}}}
            ELSE {{'done': [{lost}], 'left': {more}}} END"""

    def drawn(*parts: str) -> str:
        return f"(('0x' || substr(md5(concat_ws(':', '{SEED}', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"

    up = "least(a.left.size * (1 - a.left.p), x.size * x.p)"
    down = "least(a.left.size * a.left.p, x.size * (1 - x.p))"
    settles = "f.left.p <= 0 OR f.left.p >= 1"
    found = f"""CASE WHEN {drawn("tree", "a.left.place", "x.place")} * ({up} + {down}) < {down}
            THEN {settle("a.left", "x")} ELSE {settle("x", "a.left")} END"""
    step = f"""CASE WHEN a.left IS NULL THEN {{'done': a.done, 'left': x}}
          ELSE list_transform([{found}], lambda f: {{
            'done': list_concat(a.done, f.done, CASE WHEN {settles} THEN [f.left] ELSE [] END),
            'left': CASE WHEN {settles} THEN NULL ELSE f.left END}})[1] END"""
    kind = "STRUCT(place BIGINT, home BIGINT, size DOUBLE, p DOUBLE)"
    start = f"{{'done': []::{kind}[], 'left': NULL::{kind}}}::STRUCT(done {kind}[], \"left\" {kind})"
    parts = [
        f"""f{i} AS (
  SELECT tree, run, list_reduce(members, lambda a, x: ({step})::STRUCT(done {kind}[], "left" {kind}), {start}) AS found
  FROM (SELECT tree, place // {RUN} AS run,
               list({{'place': place, 'home': home, 'size': size, 'p': p}}::{kind} ORDER BY place) AS members
        FROM l{i} GROUP BY ALL)
), l{i + 1} AS (
  SELECT tree, run AS place, found.left.home AS home, found.left.size AS size, found.left.p AS p
  FROM f{i} WHERE found.left IS NOT NULL
)"""
        for i in range(levels)
    ]
    done = "\n  UNION ALL ".join(
        f"SELECT tree, d.home AS home, d.p AS p FROM (SELECT tree, unnest(found.done) AS d FROM f{i})" for i in range(levels)
    )
    turns = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    comma = ",\n"
    return rf"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS tree
  FROM docs GROUP BY source
), weighed AS (
  SELECT *, {MOST_COPIES} * source_size AS cap, CASE tree % {len(WEIGHTS)} {turns} END AS weight FROM sources
), levels AS (
  SELECT *, ((sum(source_size) OVER () - (sum(cap) OVER up - cap))::DOUBLE / (sum(weight) OVER down)::DOUBLE) AS level
  FROM weighed
  WINDOW up AS (ORDER BY cap / weight, tree ROWS UNBOUNDED PRECEDING),
         down AS (ORDER BY cap / weight, tree ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), aimed AS (
  SELECT tree, source, source_size, least(weight * coalesce((
    SELECT level FROM levels WHERE weight * level <= cap ORDER BY cap / weight, tree LIMIT 1), 0), cap::DOUBLE) AS target
  FROM weighed
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM aimed
), rows_ AS (
  SELECT d.doc_id, d.size, r.tree, r.source_size, r.target, floor(rate)::BIGINT AS whole, rate - floor(rate) AS p,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id NULLS FIRST) - 1 AS place
  FROM docs d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
), l0 AS (
  SELECT tree, place, place AS home, size::DOUBLE AS size, p FROM rows_ WHERE size > 0 AND p > 0
),
{comma.join(parts)},
done AS (
  {done}
  UNION ALL SELECT tree, home, CASE WHEN {drawn("tree", "place", "'last'")} < p THEN 1 ELSE 0 END FROM l{levels}
)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN size > 0 THEN coalesce(done.p, 0) ELSE 0 END)::BIGINT AS taken
FROM rows_ LEFT JOIN done ON rows_.tree = done.tree AND rows_.place = done.home
"""


SQL = _sql()
