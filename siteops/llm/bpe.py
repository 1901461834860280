"""Byte-level BPE with Spark's higher-order functions.

A text is split into words by the tokenizer's pattern. A word's bytes are written as characters of the
same number, so that pieces of bytes are strings. Folding merges, step by step, the neighbours whose
joined piece has the lowest rank. The ranks are a literal hash table: an array of slots in which each
piece stands at one of two places given by its hash.

The most frequent words of the corpus, `FREQUENT` at most, are counted over all texts and folded once.
All other words are merged by a function in Python that gives the same ids: folding them where they stand
took several times the limit of processor time, as each step of a fold is interpreted, and for a long
word a number of steps that grows with its square. Words get their ids in Arrow, each different word once
for all its places in a batch of texts; searching a literal at every place was interpreted as well. The new
words of a batch are merged together in numpy, a step of all words of a length at once.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteops.llm.common import others, slices, stored, table

FREQUENT = 1 << 16
#: Words of more bytes are neither counted as frequent ones, nor remembered, nor merged without a heap.
SHORT = 64
#: Places of words that get their ids at once, beyond a single text.
PLACES = 1 << 18
#: Different words that are looked up at once.
LOOKED = 1 << 16
#: Words that a task has merged and remembers.
REMEMBERED = 1 << 18
#: Fewer new words than these are merged one by one.
TOGETHER = 1 << 10
NONE = 2**31 - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for each row or element."""
    return F.get(F.transform(F.array(value), body), 0)


def hash_table(keys: list[str]) -> list[int | None]:
    """Slots for the places of `keys`, a power of two of them; each key is at one of its two slots."""
    size = 1 << max(4, (3 * len(keys)).bit_length())
    while True:
        slots: list[int | None] = [None] * size
        homes = [(h & size - 1, h >> 32 & size - 1) for h in (xxhash.xxh64_intdigest(k.encode(), 42) for k in keys)]
        for i, (at, _) in enumerate(homes):
            for _ in range(64):
                i, slots[at] = slots[at], i
                if i is None:
                    break
                a, b = homes[i]
                at = b if at == a else a
            else:
                break
        else:
            return slots
        size *= 2


class Literal:
    """A literal array of slots {k: key, v: value}, built from one JSON text."""

    def __init__(self, found: dict[str, object], kind: str):
        keys = list(found)
        slots = hash_table(keys)
        rows = [None if i is None else {"k": keys[i], "v": found[keys[i]]} for i in slots]
        self.mask = len(slots) - 1
        self.column = F.from_json(F.lit(json.dumps(rows)), f"array<struct<k:string,v:{kind}>>")

    def find(self, slots: Column, key: Column) -> Column:
        """The value of `key`, null if it isn't there; `slots` is this literal, bound to a variable."""
        h = F.xxhash64(key)
        one = F.get(slots, h.bitwiseAND(self.mask).cast("int"))
        two = F.get(slots, F.shiftrightunsigned(h, 32).bitwiseAND(self.mask).cast("int"))
        return F.when(one["k"] == key, one["v"]).when(two["k"] == key, two["v"])


class Pairs:
    """Ranks of the pieces that two pieces make, by the ranks of both: a hash table with linear probing."""

    FREE = np.uint64(2**64 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        made = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
                if a is not None and b is not None:
                    made[a << 32 | b] = rank
        bits = max(4, (2 * len(made)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, self.FREE)
        self.found = np.full(1 << bits, NONE, np.int32)
        keys, found = np.array(list(made), np.uint64), np.array(list(made.values()), np.int32)
        at = self.home(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == self.FREE)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[first]], self.found[at[first]] = keys[first], found[first]
            keys, found, at = (np.delete(x, first) for x in (keys, found, at + 1 & self.mask))

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each piece a + b, `NONE` if there is none."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = self.home(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.found[at], NONE)
        left = np.flatnonzero((there != keys) & (there != self.FREE))
        keys, at = keys[left], at[left]
        while len(left):
            at = at + 1 & self.mask
            there = self.keys[at]
            out[left] = np.where(there == keys, self.found[at], NONE)
            on = (there != keys) & (there != self.FREE)
            left, keys, at = left[on], keys[on], at[on]
        return out


class Tokenizer:
    """Ranks of pieces from a file of lines "base64 rank", and the pattern that splits texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pairs = Pairs(self.ranks)
        self.pattern = pattern
        self.table = Literal({p.decode("latin-1"): r for p, r in self.ranks.items()}, "int")
        pieces = [""] * (max(self.ranks.values()) + 1)
        for p, r in self.ranks.items():
            pieces[r] = p.decode("latin-1")
        self.pieces = F.from_json(F.lit(json.dumps(pieces)), "array<string>")

    def words(self, text: Column) -> Column:
        """Matches of the pattern. White space is what Unicode calls so."""
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + self.pattern), F.lit(0))

    def word_ids(self, slots: Column, word: Column) -> Column:
        """The ids of one word, by folding its merges."""

        def rank(piece: Column) -> Column:
            return self.table.find(slots, piece)

        def known(a: Column, b: Column) -> Column:
            return F.coalesce(rank(F.concat(a, b)), F.lit(NONE))

        def merge(s: Column, i: Column) -> Column:
            p, r = s["p"], s["r"]

            def joined(new: Column) -> Column:
                left = F.when(i > 1, F.array(known(F.get(p, i - 2), new))).otherwise(none)
                right = F.when(i < F.size(r), F.array(known(new, F.get(p, i + 1)))).otherwise(none)
                before, after = F.slice(r, 1, F.greatest(i - 2, F.lit(0))), F.slice(r, i + 2, F.size(r))
                return F.struct(
                    F.concat(F.slice(p, 1, i - 1), F.array(new), F.slice(p, i + 2, F.size(p))).alias("p"),
                    F.concat(before, left, right, after).alias("r"),
                )

            return let(F.concat(F.get(p, i - 1), F.get(p, i)), joined)

        none = F.array().cast("array<int>")

        def step(s: Column, _: Column) -> Column:
            least = F.array_min(s["r"])
            place = F.array_position(s["r"], least).cast("int")
            return F.when(least < NONE, let(place, lambda i: merge(s, i))).otherwise(s)

        def fold(bytes_: Column) -> Column:
            rest = F.slice(bytes_, 2, F.size(bytes_))
            pairs = F.transform(rest, lambda b, i: known(F.get(bytes_, i), b))
            start = F.struct(bytes_.alias("p"), pairs.alias("r"))
            return F.aggregate(rest, start, step, lambda s: F.transform(s["p"], rank))

        def whole(latin: Column) -> Column:
            one = let(rank(latin), lambda r: F.when(r.isNotNull(), F.array(r)))
            return F.coalesce(one, let(F.split(latin, ""), fold))

        return let(F.decode(word.cast("binary"), "ISO-8859-1"), whole)

    def ids_of_words(self, frequent: dict[str, list[int]]) -> Callable[[pa.ListArray], pa.ListArray]:
        """A function of arrays of words that gives the ids of each array's words, one after the other.

        A word is looked up once for all its places in the arrays. Those that are not frequent are merged, and
        up to `REMEMBERED` of them kept for later calls.
        """
        ranks, pairs = self.ranks, self.pairs
        common = {w.encode(): np.array(i, np.int32).tobytes() for w, i in frequent.items()}
        rare: dict[bytes, bytes] = {}

        def find(words: list[bytes]) -> list[bytes]:
            found = [common.get(w) or rare.get(w) for w in words]
            new = [w for w, ids in zip(words, found) if ids is None]
            many = [w for w in new if len(w) <= SHORT and w not in ranks]
            fresh = dict(zip(many, merged_together(many, ranks, pairs))) if len(many) >= TOGETHER else {}
            for w in new:
                if w not in fresh:
                    fresh[w] = np.array(merged(w, ranks), np.int32).tobytes()
                if len(w) <= SHORT:
                    if len(rare) >= REMEMBERED:
                        rare.clear()
                    rare[w] = fresh[w]
            return [fresh[w] if ids is None else ids for w, ids in zip(words, found)]

        def ids_of(words: pa.Array) -> pa.ListArray:
            sizes, flat = [np.zeros(1, np.int32)], [np.zeros(0, np.int32)]
            for start in range(0, len(words), LOOKED):
                found = find(list_of_bytes(words.slice(start, LOOKED)))
                sizes.append(np.fromiter(map(len, found), np.int32, len(found)) // 4)
                flat.append(np.frombuffer(b"".join(found), np.int32))
            ends = np.cumsum(np.concatenate(sizes), dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))

        def ids(words: pa.ListArray) -> pa.ListArray:
            places = words.flatten().dictionary_encode()
            each = ids_of(places.dictionary)
            sizes = np.diff(each.offsets.to_numpy())
            bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
            at = places.indices.to_numpy()
            ranges = list(slices(np.diff(bounds), PLACES))
            # A word's bytes are at least as many as its ids, so 32 bits are enough for these as well.
            flat = np.empty(sum(int(sizes[at[bounds[a] : bounds[b]]].sum()) for a, b in ranges), np.int32)
            ends = np.zeros(len(words) + 1, np.int32)
            for a, b in ranges:
                total = np.concatenate([[0], np.cumsum(sizes[at[bounds[a] : bounds[b]]])])
                ends[a + 1 : b + 1] = ends[a] + total[bounds[a + 1 : b + 1] - bounds[a]]
                found = each.take(places.indices.slice(bounds[a], bounds[b] - bounds[a]))
                flat[ends[a] : ends[b]] = found.flatten().to_numpy()
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

        return ids


def list_of_bytes(words: pa.Array) -> list[bytes]:
    """The bytes of each word; words are not null."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return []
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1]
    whole = memoryview(data)[ends[0] : ends[-1]].tobytes() if data else b""
    ends = (ends - ends[0]).tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word; of the merges with the lowest rank the leftmost comes first."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SHORT:
        return merged_by_heap(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(a + b, NONE) for a, b in zip(parts, parts[1:])]
    while pairs and (least := min(pairs)) < NONE:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NONE)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], NONE)
    return [ranks[p] for p in parts]


def merged_together(words: list[bytes], ranks: dict[bytes, int], pairs: Pairs) -> list[bytes]:
    """The same for words that are no pieces themselves, all of a length at once; ids as bytes of 32-bit numbers."""
    single = np.array([ranks.get(bytes([b]), NONE) for b in range(256)], np.int32)
    sizes = np.array([len(w) for w in words])
    out = [b""] * len(words)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        flat = single[np.frombuffer(b"".join([words[i] for i in rows]), np.uint8)]
        if (flat == NONE).any():
            raise KeyError("a byte has no rank")
        parts = flat.reshape(len(rows), size)
        joins = pairs.find(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(rows), size - 1)
        while len(rows):
            each = np.arange(len(rows))
            at = joins.argmin(1) if joins.shape[1] else np.zeros(len(rows), int)
            least = joins[each, at] if joins.shape[1] else np.full(len(rows), NONE)
            ended = least == NONE
            if ended.any():
                ids, width = parts[ended].tobytes(), 4 * parts.shape[1]
                for k, i in enumerate(rows[ended]):
                    out[i] = ids[k * width : (k + 1) * width]
                rows, parts, joins, at, least = (x[~ended] for x in (rows, parts, joins, at, least))
                each = np.arange(len(rows))
            if not len(rows):
                break
            parts[each, at] = least
            kept = np.ones(parts.shape, bool)
            kept[each, at + 1] = False
            parts = parts[kept].reshape(len(rows), -1)
            joins = joins[kept[:, 1:]].reshape(len(rows), -1)
            for i, a in ((each[at > 0], at[at > 0] - 1), (each[at < joins.shape[1]], at[at < joins.shape[1]])):
                joins[i, a] = pairs.find(parts[i, a], parts[i, a + 1])
    return out


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in a time that hardly grows faster than the word."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n and (r := ranks.get(word[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[end[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if middle < 0 or middle >= n or end[middle] != stop:
            continue  # one of the two pieces has changed
        end[i], end[middle] = stop, -1
        if stop < n:
            before[stop] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def frequent_words(df: DataFrame, tokenizer: Tokenizer, text: str = "text", most: int = FREQUENT) -> dict[str, list[int]]:
    """The most frequent words of all texts, and their ids: those at least as frequent as a level.

    Levels are eighths of a power of two; it is the lowest one that `most` words reach at most.
    """
    each = df.select(F.explode(tokenizer.words(F.col(f"`{text}`"))).alias("word"))
    counted = each.groupBy("word").count().where(f"count > 1 AND octet_length(word) <= {SHORT}")
    counted = stored(counted.withColumn("level", F.floor(F.log2("count") * 8).cast("int")))
    levels = counted.groupBy("level").count().orderBy(F.desc("level")).collect()
    least, total = None, 0
    for r in levels:
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    if least is None:
        return {}
    ids = let(tokenizer.table.column, lambda slots: tokenizer.word_ids(slots, F.col("word")))
    return {r.word: r.ids for r in counted.where(F.col("level") >= least).select("word", ids.alias("ids")).collect()}


def encode(
    df: DataFrame,
    tokenizer: Tokenizer,
    frequent: dict[str, list[int]] | None = None,
    text: str = "text",
    out: str = "ids",
) -> DataFrame:
    """Adds the ids of each whole text as an array; null is encoded like an empty text, without ids.

    `frequent` is what `frequent_words` found; it saves work and changes nothing. Other columns stay; a
    column named `out` is replaced.
    """
    kept = [F.col(f"`{c}`") for c in others(df, out)]
    find = tokenizer.ids_of_words(frequent or {})

    @F.arrow_udf("array<int>")
    def ids(words: pa.Array) -> pa.Array:
        return find(words)

    return df.select(*kept, ids(tokenizer.words(F.col(f"`{text}`"))).alias(out))


def decode(df: DataFrame, tokenizer: Tokenizer, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Adds the bytes that arrays of ids stand for; null for a null array. Unknown ids stand for nothing."""
    kept = [F.col(f"`{c}`") for c in others(df, out)]
    pieces = let(tokenizer.pieces, lambda p: F.transform(F.col(f"`{ids}`"), lambda i: F.get(p, i)))
    joined = F.encode(F.array_join(pieces, ""), "ISO-8859-1")
    return df.select(*kept, joined.alias(out))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and what they decode to."""
    import public_tokenizers

    tokenizer = Tokenizer(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    frequent = frequent_words(docs, tokenizer)
    rows = decode(encode(docs, tokenizer, frequent), tokenizer)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
