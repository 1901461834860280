"""Language identification by interpolated Kneser-Ney character models, one for each language.

Counts cover all training texts and are made by Spark; so are the continuation counts. The models of all
languages are kept as sorted arrays of trigram numbers with one row of log probabilities for each, so
that a batch of texts looks up each of its different trigrams once. Where the languages have more than
`MODEL` trigrams, the arrays hold the most frequent ones, with their values in every language. The whole
models then are tables as well, and all other trigrams of the texts get their values by joins with them.

Texts are lower-cased, and what isn't a letter separates words. The language with the lowest
length-normalised cross-entropy wins. A text is rejected where its cross-entropy is far above that of the
training texts of the same language, both in itself and for a text of its length.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteops.llm.common import beside, brought_back, fresh, held_out, set_aside, slices, stored, table
from siteops.llm.ngrams import BITS, PAIR, code_points, letters_only, trigrams

#: Rows (language, trigram) that are kept in arrays.
MODEL = 1 << 20
DISCOUNT = 0.75
SLICE = 1 << 20
#: How fast the confidence grows with the distance of two languages.
SHARP = 8.0
#: A rejected text is beyond this quantile of training texts and this share above their mean.
QUANTILE, ABOVE = 0.999, 0.3
UNKNOWN = "und"


@dataclass
class Tables:
    """Logs by language of all trigrams, contexts and bigrams; null in a language without the key."""

    trigram: DataFrame
    context: DataFrame
    bigram: DataFrame


@dataclass
class Models:
    """Rows belong to the sorted keys, columns to the languages.

    If the models are `cut`, `trigram` has the most frequent ones only, `context` and `bigram` nothing, and
    `tables` everything.
    """

    languages: list[str]
    trigram: np.ndarray
    trigram_log: np.ndarray
    context: np.ndarray
    context_log: np.ndarray
    bigram: np.ndarray
    bigram_log: np.ndarray
    middle: np.ndarray
    middle_log: np.ndarray
    letter: np.ndarray
    letter_log: np.ndarray
    unseen_log: np.ndarray
    cut: bool = False
    tables: Tables | None = None

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Of the last character of each trigram after the first two, in each language; 0 if it was cut off."""
        out, known = find(self.trigram, self.trigram_log, keys, 0.0)
        if self.cut:
            return out
        rest = np.flatnonzero(~known)
        if len(rest):
            weight, _ = find(self.context, self.context_log, keys[rest] >> BITS, 0.0)
            out[rest] = weight + bigram_log(self, keys[rest] & PAIR)
        return out


def find(keys: np.ndarray, rows: np.ndarray, wanted: np.ndarray, other) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the wanted keys, `other` where a key is not there, and which are there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    known = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
    out = np.broadcast_to(other, (len(wanted), rows.shape[1])).copy()
    out[known] = rows[at[known]]
    return out, known


def bigram_log(model: Models, pairs: np.ndarray) -> np.ndarray:
    """Log of the Kneser-Ney probability of the second letter after the first."""
    letters, _ = find(model.letter, model.letter_log, pairs & ((1 << BITS) - 1), model.unseen_log)
    weight, _ = find(model.middle, model.middle_log, pairs >> BITS, 0.0)
    out, known = find(model.bigram, model.bigram_log, pairs, 0.0)
    return np.where(known[:, None], out, weight + letters)


def counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n): how often each trigram stands in the texts of a language."""

    def run(batches):
        for batch in batches:
            langs, texts = (batch.column(i).to_pylist() for i in range(2))
            for a, b in slices([len(t) for t in texts], SLICE):
                for name in sorted(set(langs[a:b])):
                    own = [t.lower() for t, x in zip(texts[a:b], langs[a:b]) if x == name]
                    keys, inverse = trigrams(*letters_only(*code_points(own)))
                    n = np.bincount(inverse, minlength=len(keys))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n)],
                        names=["lang", "gram", "n"],
                    )

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    found = rows.mapInArrow(run, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = MODEL) -> Models:
    """Models of every language of `docs`, in arrays of at most `most` trigrams, and in tables if there are more.

    Letters, and what is known of one letter before another, are always arrays: their rows are bounded by the
    alphabets. There are no more bigrams and contexts than trigrams.
    """
    tri = stored(counts(docs, lang, text))
    pair, last, first = F.col("gram").bitwiseAND(PAIR), (1 << BITS) - 1, F.shiftright("gram", BITS)
    after = tri.groupBy("lang", first.alias("ab")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    bi = tri.groupBy("lang", pair.alias("bc")).agg(F.count("*").alias("before"))
    middle = bi.groupBy("lang", F.shiftright("bc", BITS).alias("b")).agg(
        F.sum("before").alias("total"), F.count("*").alias("kinds")
    )
    letter = bi.groupBy("lang", F.col("bc").bitwiseAND(last).alias("c")).agg(F.count("*").alias("before"))

    letters = letter.collect()
    langs = sorted({r.lang for r in letters})
    column = {x: i for i, x in enumerate(langs)}

    def matrix(rows, key: str, *values: str):
        keys = np.unique(np.array([r[key] for r in rows], np.int64))
        out = np.zeros((len(values), len(keys), len(langs)))
        if len(rows):
            at = np.searchsorted(keys, [r[key] for r in rows]), [column[r.lang] for r in rows]
            for v, name in zip(out, values):
                v[at] = [r[name] for r in rows]
        return keys, *out

    def known(keys, rows, wanted):
        return find(keys, rows, wanted, 0.0)[0]

    c_keys, c_n = matrix(letters, "c", "before")
    kinds = c_n.sum(0)
    floor = 1 / (len(c_keys) + 1)
    unseen = DISCOUNT * (c_n > 0).sum(0) / np.maximum(kinds, 1) * floor
    p1 = np.maximum(c_n - DISCOUNT, 0) / np.maximum(kinds, 1) + unseen
    b_keys, b_total, b_kinds = matrix(middle.collect(), "b", "total", "kinds")
    b_weight = np.where(b_total > 0, DISCOUNT * b_kinds / np.maximum(b_total, 1), 1)

    def lower(pairs: np.ndarray) -> np.ndarray:
        """What a bigram that was never seen gets."""
        return find(b_keys, b_weight, pairs >> BITS, 1.0)[0] * find(c_keys, p1, pairs & last, unseen)[0]

    if tri.count() > most:
        logs = (np.log(np.maximum(p, 1e-12)) for p in (b_weight, p1, unseen))
        of_language = [(x, float(kinds[i]), float(unseen[i])) for x, i in column.items()]
        of_language = tri.sparkSession.createDataFrame(of_language, "lang string, all double, unseen double")
        return cut_models(langs, tri, after, bi, middle, letter, of_language, b_keys, c_keys, *logs, most=most)
    bc_keys, bc_n = matrix(bi.collect(), "bc", "before")
    p2 = np.maximum(bc_n - DISCOUNT, 0) / np.maximum(known(b_keys, b_total, bc_keys >> BITS), 1) + lower(bc_keys)
    ab_keys, ab_total, ab_kinds = matrix(after.collect(), "ab", "total", "kinds")
    weight = np.where(ab_total > 0, DISCOUNT * ab_kinds / np.maximum(ab_total, 1), 1)
    keys, n = matrix(tri.collect(), "gram", "n")
    back = find(ab_keys, weight, keys >> BITS, 1.0)[0]
    pairs, there = find(bc_keys, p2, keys & PAIR, 0.0)
    second = np.where(there[:, None], pairs, lower(keys & PAIR))
    p3 = np.maximum(n - DISCOUNT, 0) / np.maximum(known(ab_keys, ab_total, keys >> BITS), 1) + back * second
    tables = (np.log(np.maximum(p, 1e-12)).astype(np.float32) for p in (p3, weight, p2, b_weight, p1))
    l3, lab, l2, lb, l1 = tables
    floor_log = np.log(np.maximum(unseen, 1e-12))
    return Models(langs, keys, l3, ab_keys, lab, bc_keys, l2, b_keys, lb, c_keys, l1, floor_log)


def cut_models(
    langs: list[str],
    tri: DataFrame,
    after: DataFrame,
    bi: DataFrame,
    middle: DataFrame,
    letter: DataFrame,
    of_language: DataFrame,
    b_keys: np.ndarray,
    c_keys: np.ndarray,
    b_log: np.ndarray,
    c_log: np.ndarray,
    unseen_log: np.ndarray,
    *,
    most: int,
) -> Models:
    """The models as tables, made by joins, with the most frequent trigrams as arrays."""

    def discounted(n: str, total: str):
        return F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) / F.col(total)

    def by_language(df: DataFrame, key: str, p: str) -> DataFrame:
        log = F.log(F.greatest(F.col(p), F.lit(1e-12)))
        cells = [F.max(F.when(F.col("lang") == x, log)) for x in langs]
        return stored(df.groupBy(key).agg(F.array(*cells).alias("logs")))

    last, back = (1 << BITS) - 1, DISCOUNT * F.col("kinds") / F.col("total")
    p1 = letter.join(F.broadcast(of_language), "lang").select(  # one row for each language
        "lang", "c", (discounted("before", "all") + F.col("unseen")).alias("p1")
    )
    parts = bi.withColumns({"b": F.shiftright("bc", BITS), "c": F.col("bc").bitwiseAND(last)})
    p2 = parts.join(middle, ["lang", "b"]).join(p1, ["lang", "c"])
    p2 = stored(p2.select("lang", "bc", (discounted("before", "total") + back * F.col("p1")).alias("p2")))
    parts = tri.withColumns({"ab": F.shiftright("gram", BITS), "bc": F.col("gram").bitwiseAND(PAIR)})
    p3 = parts.join(after, ["lang", "ab"]).join(p2, ["lang", "bc"])
    p3 = p3.select("lang", "gram", (discounted("n", "total") + back * F.col("p2")).alias("p3"))
    tables = Tables(
        by_language(p3, "gram", "p3"),
        by_language(after.withColumn("weight", back), "ab", "weight"),
        by_language(p2, "bc", "p2"),
    )
    no_keys, no_rows = np.zeros(0, np.int64), np.zeros((0, len(langs)), np.float32)
    nothing = (no_keys, no_rows) * 3
    model = Models(langs, *nothing, b_keys, b_log, c_keys, c_log, unseen_log, True, tables)
    frequent = tri.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(most // len(langs))
    found = sorted(looked_up(frequent.select("gram"), model).collect())
    if not found:
        return model
    logs = np.array([r.logs for r in found], np.float32)
    return replace(model, trigram=np.array([r.gram for r in found], np.int64), trigram_log=logs)


def looked_up(grams: DataFrame, model: Models) -> DataFrame:
    """(gram, logs): the logs by language of trigrams, from the tables of cut models."""
    tables, model = model.tables, replace(model, tables=None)
    found = (
        grams.withColumns({"ab": F.shiftright("gram", BITS), "bc": F.col("gram").bitwiseAND(PAIR)})
        .join(tables.trigram.withColumnRenamed("logs", "three"), "gram", "left")
        .join(tables.context.withColumnRenamed("logs", "weight"), "ab", "left")
        .join(tables.bigram.withColumnRenamed("logs", "two"), "bc", "left")
        .select("gram", "three", "weight", "two")
    )

    def cells(column: pa.Array) -> np.ndarray:
        out = np.full((len(column), len(model.languages)), np.nan)
        there = column.is_valid().to_numpy(zero_copy_only=False)
        out[there] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(model.languages))
        return out

    def run(batches):
        for batch in batches:
            three, weight, two = (cells(batch.column(i)) for i in (1, 2, 3))
            low = bigram_log(model, batch.column(0).to_numpy() & PAIR)  # has no bigrams, so it backs off
            back = np.nan_to_num(weight) + np.where(np.isnan(two), low, two)
            logs = np.where(np.isnan(three), back, three)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(logs), pa.list_(pa.float64()))], ["gram", "logs"])

    return found.mapInArrow(run, "gram long, logs array<double>")


def with_rest(rows: DataFrame, text: str, model: Models) -> DataFrame:
    """Adds, as the last column, the sums by language of the logs of those trigrams that cut models left out."""
    row, rest = fresh(rows, "row", "rest")
    numbered = stored(rows.withColumn(row, F.monotonically_increasing_id()))
    frequent = model.trigram

    def run(batches):
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], SLICE):
                codes, ends = letters_only(*code_points([t.lower() for t in texts[a:b]]))
                keys, inverse = trigrams(codes, ends)
                left = np.flatnonzero(~np.isin(keys, frequent)[inverse])
                owner = np.repeat(np.arange(a, b), np.diff(ends))[left]
                each, n = np.unique(owner * max(len(keys), 1) + inverse[left], return_counts=True)
                owner, gram = np.divmod(each, max(len(keys), 1))
                made = numbers[owner], keys[gram], n
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()) for m in made], ["row", "gram", "n"])

    found = stored(numbered.select(row, F.col(f"`{text}`")).mapInArrow(run, "row long, gram long, n long"))
    logs = looked_up(found.select("gram").distinct(), model)
    sums = [F.sum(F.col("n") * F.col("logs")[i]) for i in range(len(model.languages))]
    sums = found.join(logs, "gram").groupBy(F.col("row").alias(row)).agg(F.array(*sums).alias(rest))
    return numbered.join(sums, row, "left").select(*(F.col(f"`{c}`") for c in (*rows.columns, rest)))


def entropies(texts: list[str], model: Models, rest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy by character of each text in each language, and the number of characters.

    Cut models need the sums of the logs of the trigrams that they left out, see `with_rest`.
    """
    if model.cut and rest is None:
        raise ValueError("the models are cut: score texts by `predict`")
    codes, ends = letters_only(*code_points([t.lower() for t in texts]))
    n = np.diff(ends)
    out = np.zeros((len(texts), len(model.languages)))
    full = np.flatnonzero(n)
    if len(full):
        keys, inverse = trigrams(codes, ends)
        logs = model.log_probabilities(keys)
        for i in range(len(model.languages)):
            sums = np.add.reduceat(logs[:, i][inverse], ends[:-1][full], dtype=np.float64)
            out[full, i] = -(sums if rest is None else sums + rest[full, i]) / n[full]
    return out, n


def predict(
    df: DataFrame,
    model: Models,
    text: str = "text",
    bounds: dict[str, tuple] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds `lang_pred`, `score` (0 to 1), `entropy`, `letters` and `rejected`.

    Null texts and those without a letter are `und`, with score 0, and rejected; so is every text if no
    language was learnt. Equal entropies go to the first language by name. Without `bounds` nothing else
    is rejected. The columns `keep` stay, or all others; columns of these names are replaced.
    """
    numbers = {"score": F.lit(0.0), "entropy": F.lit(0.0), "letters": F.lit(0).cast("long")}
    added = {"lang_pred": F.lit("")} | numbers | {"rejected": F.lit(False)}
    rows, kept, schema, place = beside(df, text, keep, added)
    limits = np.array([(bounds or {}).get(x, (np.inf, 0.0)) for x in model.languages]).reshape(-1, 2)
    names = np.array([*model.languages, UNKNOWN], object)
    if model.cut:
        rows = with_rest(rows, rows.columns[place], model)
        model = replace(model, tables=None)
    nothing = [0.0] * len(model.languages)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            rest = np.array([r or nothing for r in batch.column(-1).to_pylist()]) if model.cut else None
            for a, b in slices([len(t) for t in texts], SLICE):
                h, n = entropies(texts[a:b], model, rest[a:b] if model.cut else None)
                best = np.full(b - a, len(model.languages))
                score, low = np.zeros(b - a), np.zeros(b - a)
                far = np.ones(b - a, bool)
                full = np.flatnonzero(n) if model.languages else []
                if len(full):
                    best[full] = h[full].argmin(1)
                    low[full] = h[full].min(1)
                    score[full] = 1 / np.exp(-SHARP * (h[full] - low[full][:, None])).sum(1)
                    least, spread = limits[best[full]].T
                    far[full] = low[full] > least + spread / np.sqrt(n[full])
                part = batch.slice(a, b - a)
                columns = [part.column(i) for i in range(len(kept))]
                made = [pa.array(names[best], pa.string()), *map(pa.array, (score, low, n, far))]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def calibrate(docs: DataFrame, model: Models, lang: str = "lang", text: str = "text") -> dict[str, tuple]:
    """By language, (a, b): texts of n characters with an entropy above a + b / sqrt(n) are rejected.

    From all training texts whose language is predicted: their mean entropy by character, the spread of
    single characters around it, and the quantile `QUANTILE` of deviations counted in that spread.
    """
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("_known"), text)
    found = predict(rows, model, text, keep=["_known"]).where("lang_pred = _known")
    own = stored(found.select("lang_pred", "entropy", "letters"))
    means = own.groupBy("lang_pred").agg(
        (F.sum(F.col("entropy") * F.col("letters")) / F.sum("letters")).alias("mean")
    )
    parted = own.join(F.broadcast(means), "lang_pred")  # one row for each language
    deviation = (F.col("entropy") - F.col("mean")) * F.sqrt("letters")
    found = parted.groupBy("lang_pred").agg(
        F.first("mean").alias("mean"), F.percentile_approx(deviation, QUANTILE, 10_000).alias("far")
    )
    return {r.lang_pred: (r["mean"] * (1 + ABOVE), max(r["far"], 0.0)) for r in found.collect()}


def training_part(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three quarters of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = training_part(docs)
    model = fit(known)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model, bounds=calibrate(known, model), keep=["doc_id", "held_out"])


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents in a language that the models accept, with their columns whatever their names."""
    rows = set_aside(docs, "doc_id", "text", "lang")
    known = training_part(rows.select("doc_id", "text", "lang"))
    model = fit(known)
    found = predict(rows, model, bounds=calibrate(known, model))
    return brought_back(found.where("NOT rejected"), docs, "doc_id", "text", "lang")
