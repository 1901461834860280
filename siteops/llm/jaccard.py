"""Documents whose sets of word shingles have a Jaccard similarity of at least a bound, exactly.

1. Sets of equal shingles are one: their documents link to the smallest id.
2. Sizes are cut into bands whose ends differ by the similarity, so that linked sets are in the same band
   or in neighbouring ones, which make a tile. Sets of a tile that link differ in at most d shingles.
   Each set is dealt by a hash into more than d parts, so at least one part is the same in both, and it
   has shingles if one of the sets has more than d parts with shingles. The few sets with fewer such
   parts have each shingle as a part, too. Sets that share a part (tile, number, contents) may link; no
   other pair can. A part has several shingles, so it is rarely shared by chance.
3. Where few sets share a part, each pair of them is compared by bitmaps of hashed shingles: each bit that
   only one set has is a shingle that the other lacks, which bounds the overlap from above. Where more
   share one, the sets that such parts connect are a cluster, and bitmaps are compared in the tiles of
   a cluster, cut into blocks of bounded size. Sets that may still link, directly or over others, are
   clusters of their own, and most sets are in none.
4. In those each set is compared with the one of the smallest id, and those that don't link to it with
   all others, in blocks. What sizes and bitmaps leave open is decided by intersecting the sorted sets.

Links come out as trees, never as all pairs of a group. Shingles are told apart by 64-bit hashes, equal
sets by 128 bits and their size.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteops.llm.common import fresh, slices, stored, table
from siteops.llm.components import components

SLICE = 1 << 20
#: Keys of parts that a task sorts together, and documents of a block.
KEYS, BLOCK = 1 << 21, 1024
#: Bitmaps of a block.
BITMAPS = 2048
#: Up to so many sets with a part in common are compared as pairs.
SMALL = 16
LEAST_GROUPS = 64
WORDS = 8  # of a bitmap, 64 bits each
GOLD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted hashes of the different shingles of each text.

    Words are what white space (space, 9 to 13) separates, A to Z in lower case. A text with fewer words
    than a shingle has all of them as its only one; a text without words has none.
    """
    split = [t.lower().split() for t in texts]
    ends = np.cumsum([0, *map(len, split)])
    h = np.fromiter((xxhash.xxh64_intdigest(w) for ws in split for w in ws), np.uint64, int(ends[-1]))
    factors = [np.uint64((2 * k + 3) * GOLD & MASK | 1) for k in range(words)]
    rolled = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for k, f in enumerate(factors):
        rolled += h[k : k + len(rolled)] * f
    rolled = mix(rolled)
    out = []
    for a, b in zip(ends.tolist(), ends[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            short = np.array([sum(int(x) * int(f) for x, f in zip(h[a:b], factors)) + (b - a) & MASK], np.uint64)
            out.append(mix(short ^ np.uint64(GOLD)))
        else:
            out.append(rolled[:0])
    return out


def payload(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("payload"))


def signatures(df: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, h1, h2, band, bits): the size of each set, two numbers that only equal sets share, its band, a bitmap."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts], SLICE):
                sets = shingle_sets(texts[a:b], words)
                starts = band_starts(max(map(len, sets)), percent)
                h1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                h2 = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(GOLD))) for s in sets], np.uint64)
                band = [max(bisect.bisect_right(starts, len(s)) - 1, 0) for s in sets]
                # Two bits or more for each shingle of the band, so that they are of use for long texts, too.
                width = [max(WORDS, 1 << (starts[x + 1] // 32).bit_length()) for x in band]
                bits = [bitmap(s, w).view(np.int64) for s, w in zip(sets, width)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(h1),
                        pa.array(h2.view(np.int64)),
                        pa.array(band, pa.int32()),
                        pa.array(bits, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "h1", "h2", "band", "bits"],
                )

    return payload(df).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, band int, bits array<long>")


def band_starts(most: int, percent: int) -> list[int]:
    """The smallest size of each band up to the size `most`, and of two more."""
    starts = [1]
    while starts[-1] <= most or len(starts) < 3:
        starts.append(starts[-1] * 100 // percent + 1)
    return [*starts, starts[-1] * 100 // percent + 1]


def tile_parts(tile: int, starts: list[int], percent: int) -> tuple[int, int]:
    """In how many shingles linked sets of a tile differ at most, and into how many parts its sets are dealt.

    The smaller set of a link is in the tile's lower band. The more parts there are beyond d + 1, the fewer
    sets have only d parts with shingles.
    """
    d = (100 - percent) * (starts[tile + 1] - 1) // percent
    return d, d + 1 + (d + 1) // 8 + (d > 0)


def part_keys(s: np.ndarray, mixed: np.ndarray, tile: int, d: int, parts: int) -> np.ndarray:
    """The keys of the parts of one set that have shingles; if these are d parts at most, of each shingle as well.

    Of the parts at most d differ between linked sets. If one of them has more than d with shingles, then
    fewer than all that are the same are empty; if neither has, they share a shingle.
    """
    salt = np.uint64((tile + 1) * GOLD & MASK)
    number = ((mixed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.argsort(number, kind="stable")
    number = number[order]
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    single = mix(s + np.uint64(GOLD))
    sums = np.add.reduceat(single[order], first)
    number = number[first]
    if len(first) <= d:  # one number more than parts have
        sums, number = np.concatenate([sums, single]), np.concatenate([number, np.full(len(s), parts, np.uint64)])
    return mix(mix(sums ^ salt) + number * np.uint64(GOLD))


def shared_parts(df: DataFrame, words: int, percent: int, sizes: DataFrame, starts: list[int]) -> DataFrame:
    """(few, a, b): documents with a part in common. Where few share one, all pairs, else trees that connect them."""
    expected = 2 * (sizes.agg(F.sum("n")).first()[0] or 0) * (100 - percent) // percent
    groups = max(LEAST_GROUPS, -(-expected // KEYS))

    def gather(batches):
        dealt = [tile_parts(j, starts, percent) for j in range(len(starts) - 1)]
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts], SLICE):
                keys, owner, seen = [], [], set()
                # Of equal sets in a slice the smallest id stands for all.
                for doc, s in sorted(zip(ids[a:b].tolist(), shingle_sets(texts[a:b], words)), key=lambda x: x[0]):
                    whole = xxhash.xxh128_digest(s)
                    if not len(s) or whole in seen:
                        continue
                    seen.add(whole)
                    mixed = mix(s)
                    band = bisect.bisect_right(starts, len(s)) - 1
                    for tile in {band, max(band - 1, 0)}:
                        keys.append(part_keys(s, mixed, tile, *dealt[tile]))
                        owner.append(np.full(len(keys[-1]), doc))
                if keys:
                    yield packed(np.concatenate(keys).view(np.int64), np.concatenate(owner), groups)

    def meet(found: pa.Table) -> pa.Table:
        keys, docs = (found.column(x).combine_chunks().flatten().to_numpy() for x in ("keys", "docs"))
        few, a, b = met(keys, docs)
        return pa.table({"few": few, "a": a, "b": b})

    rows = payload(df.where("doc_id IS NOT NULL")).mapInArrow(gather, "part int, keys array<long>, docs array<long>")
    return rows.groupBy("part").applyInArrow(meet, "few boolean, a long, b long")


def met(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(few, a, b) with a < b: all pairs of the documents of a key that few have, else its first beside each other one."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    again = (keys[1:] == keys[:-1]) & (docs[1:] == docs[:-1])  # rows that repeat an id, or equal parts
    once = np.concatenate([np.ones(min(len(keys), 1), bool), ~again])
    keys, docs = keys[once], docs[once]
    at = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    many = np.diff(np.append(at, len(keys)))
    pairs = [np.zeros((0, 2), np.int64)]
    for size in range(2, SMALL + 1):
        rows = docs[at[many == size][:, None] + np.arange(size)]
        i, j = np.triu_indices(size, 1)
        pairs.append(np.stack([rows[:, i].ravel(), rows[:, j].ravel()], 1))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    large = np.repeat(many > SMALL, many)
    trees = np.stack([np.repeat(docs[at], many)[large], docs[large]], 1)
    trees = np.unique(trees[trees[:, 0] != trees[:, 1]], axis=0)
    both = np.concatenate([pairs, trees])
    return np.arange(len(both)) < len(pairs), both[:, 0], both[:, 1]


def packed(keys: np.ndarray, docs: np.ndarray, groups: int) -> pa.RecordBatch:
    """(part, keys, docs): the keys of a slice of documents, one row for each group of keys."""
    part = (keys.view(np.uint64) % np.uint64(groups)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, keys, docs = part[order], keys[order], docs[order]
    here, at = np.unique(part, return_index=True)
    offsets = pa.array([*at, len(part)], pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(here), pa.ListArray.from_arrays(offsets, keys), pa.ListArray.from_arrays(offsets, docs)],
        names=["part", "keys", "docs"],
    )


def bitmap(s: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Which of 64 * words bits, a power of two, the hashes hit."""
    bits = np.zeros(words * 64, bool)
    bits[s & np.uint64(words * 64 - 1)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of more words, a power of two, as those of so many."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def may_link(n, bits, others, other_bits, percent: int) -> np.ndarray:
    """Which of the other sets can overlap enough, by sizes and by the bits that only one side has."""
    alone = np.bitwise_count(bits & ~other_bits).sum(-1, dtype=np.int64)
    lacking = np.bitwise_count(other_bits & ~bits).sum(-1, dtype=np.int64)
    most = np.minimum(n - alone, others - lacking)
    # 100 * overlap >= percent * union, where the union is both sizes less the overlap.
    return (100 + percent) * most >= percent * (n + others)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return (100 + percent) * both >= percent * (len(a) + len(b))


def candidate_sets(df: DataFrame, clusters: DataFrame, words: int) -> DataFrame:
    """(cluster, doc_id, shingles, bits) of the documents of clusters, (doc_id, cluster)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices([len(t) for t in texts], SLICE):
                sets = shingle_sets(texts[a:b], words)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                        pa.array([bitmap(s).view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["cluster", "doc_id", "shingles", "bits"],
                )

    # By shuffle at every size: the clusters grow with the data, and so does what travels.
    rows = payload(df).join(clusters.hint("merge"), "doc_id").select("cluster", "doc_id", "payload")
    return rows.mapInArrow(run, "cluster long, doc_id long, shingles array<long>, bits array<long>")


def arrays(column) -> list[np.ndarray]:
    """The lists of a column of whole numbers."""
    ends = column.offsets.to_numpy()
    flat = column.flatten().to_numpy().view(np.uint64)
    ends = ends - ends[0]
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def paired(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs whose sizes and bitmaps allow a link. Pairs without a sketch on either side go."""
    for side in ("a", "b"):
        own = sketches.select(
            F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")
        )
        pairs = pairs.join(own, side)

    def run(batches):
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 4))
            s, t = (arrays(batch.column(i)) for i in (3, 5))
            near = np.zeros(batch.num_rows, bool)
            shapes = np.array([[len(x), len(y)] for x, y in zip(s, t)]).reshape(-1, 2)
            for shape in np.unique(shapes, axis=0):
                at = np.flatnonzero((shapes == shape).all(1))
                x, y = (folded(np.array([z[i] for i in at]), int(shape.min())) for z in (s, t))
                near[at] = may_link(n[at], x, m[at], y, percent)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(run, "a long, b long")


def narrowed(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b): trees of the sets of a cluster whose sizes and bitmaps allow links, from (doc_id, cluster)."""
    band = F.col("band")
    tile = F.explode(F.array_distinct(F.array(band, F.greatest(band - 1, F.lit(0)))))
    rows = stored(members.join(sketches, "doc_id").select("cluster", "doc_id", tile.alias("tile"), "n", "bits"))
    counts = rows.groupBy("cluster", "tile").agg(F.ceil(F.count("*") / BITMAPS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda i: F.struct(F.least(i, own).alias("x"), F.greatest(i, own).alias("y")),
    )
    rows = rows.join(counts, ["cluster", "tile"]).withColumn("cell", F.explode(cells))

    def meet(found: pa.Table) -> pa.Table:
        ids, n = found.column("doc_id").to_numpy(), found.column("n").to_numpy()
        bits = arrays(found.column("bits").combine_chunks())
        least = min(map(len, bits))  # that of the tile's lower band, if it has sets
        bits = np.array([folded(x, least) for x in bits])
        left = np.arange(len(ids))  # not reached yet
        out = []
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                i = todo.pop()
                near = may_link(n[i], bits[i], n[left], bits[left], percent)
                out += [(ids[i], ids[j]) for j in left[near]]
                todo += list(left[near])
                left = left[~near]
        edges = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    rows = rows.select("cluster", "tile", "cell", "doc_id", "n", "bits")
    return rows.groupBy("cluster", "tile", "cell").applyInArrow(meet, "a long, b long")


def with_roots(found: DataFrame) -> DataFrame:
    """(doc_id, cluster) of the nodes of components, their roots included."""
    roots = found.select(F.col("root").alias("node"), "root").distinct()
    return found.unionAll(roots).select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"))


def against_leader(sets: DataFrame, percent: int) -> DataFrame:
    """(cluster, doc_id, leader, linked) of every set but the leader, the one with the smallest id."""
    leaders = sets.groupBy("cluster").agg(F.min("doc_id").alias("leader"))
    first = sets.join(leaders.select(F.col("cluster"), F.col("leader").alias("doc_id")), ["cluster", "doc_id"])
    first = first.dropDuplicates(["cluster"]).select(
        "cluster", F.col("doc_id").alias("leader"), F.col("shingles").alias("s"), F.col("bits").alias("t")
    )
    # Written, so that the join stands alone and Spark can split a large cluster.
    both = sets.join(stored(first), "cluster").where("doc_id <> leader")

    def run(batches):
        for batch in batches:
            s, bits, t, other = (arrays(batch.column(i)) for i in (3, 4, 5, 6))
            sizes = np.array([[len(x), len(y)] for x, y in zip(s, t)]).reshape(-1, 2)
            near = may_link(sizes[:, 0], np.array(bits), sizes[:, 1], np.array(other), percent)
            found = [bool(ok) and links(x, y, percent) for ok, x, y in zip(near, s, t)]
            columns = [batch.column(i) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], names=["cluster", "doc_id", "leader", "linked"])

    rows = both.select("cluster", "doc_id", "leader", "shingles", "bits", "s", "t")
    return rows.mapInArrow(run, "cluster long, doc_id long, leader long, linked boolean")


def in_blocks(sets: DataFrame, compared: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between the sets that don't link to their leader, and from them to all others.

    Every tile holds a block of those left, beside another block of those left or of the others.
    """
    counts = compared.groupBy("cluster").agg(
        F.count(F.when(~F.col("linked"), 1)).alias("left"), F.count(F.when(F.col("linked"), 1)).alias("others")
    )
    counts = counts.where("left > 0 AND left + others > 1").select(
        "cluster",
        F.ceil(F.col("left") / BLOCK).cast("int").alias("l"),
        F.ceil(F.col("others") / BLOCK).cast("int").alias("o"),
    )
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("linked"), F.col("o")).otherwise(F.col("l"))).cast("int")
    none = F.array().cast("array<struct<x:int,y:int>>")

    def span(n: str):
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    def cell(x, y):
        return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))

    # Blocks of those left are 0..l-1, blocks of the others l..l+o-1.
    beside = F.transform(span("l"), lambda i: cell(F.least(i, F.col("own")), F.greatest(i, F.col("own"))))
    before = F.transform(span("o"), lambda i: cell(F.col("own"), F.col("l") + i))
    inside = F.transform(span("l"), lambda i: cell(i, F.col("l") + F.col("own")))
    cells = F.when(F.col("linked"), inside).otherwise(F.concat(none, beside, before))
    places = compared.join(counts, "cluster").withColumn("own", own)
    places = places.select("cluster", "doc_id", "linked", F.explode(cells).alias("tile"))
    rows = sets.join(places, ["cluster", "doc_id"]).select("cluster", "tile", "doc_id", "linked", "shingles", "bits")

    def compare(found: pa.Table) -> pa.Table:
        found = found.combine_chunks()
        ids, linked = found.column("doc_id").to_numpy(), found.column("linked").to_numpy(zero_copy_only=False)
        s, bits = (arrays(found.column(c).combine_chunks()) for c in ("shingles", "bits"))
        bits = np.array(bits)
        sizes = np.array([len(x) for x in s])
        group = np.where(linked, -1, np.arange(len(s)))  # all that link to the leader are connected
        out = []
        for i in np.flatnonzero(~linked):
            near = may_link(sizes[i], bits[i], sizes, bits, percent)
            for j in np.flatnonzero(near & (group != group[i])):
                if group[i] != group[j] and links(s[i], s[j], percent):
                    out.append((ids[i], ids[j]))
                    group[group == group[i]] = group[j]
        edges = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    return rows.groupBy("cluster", "tile").applyInArrow(compare, "a long, b long")


def similar_groups(df: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of `df` (doc_id, text).

    Two documents link where 100 * intersection >= percent * union of their sets of shingles; a component
    is what links reach, and its id the smallest `doc_id` in it. Sets without shingles link with
    nothing. Rows with the same id are one document with the links of each. A null id stays null and
    links with nothing. Columns other than these two don't matter.
    """
    content = F.xxhash64(F.coalesce("text", F.lit("")))
    ids = df.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(content).alias("x"), F.max(content).alias("y"))
    if ids.where("x <> y").isEmpty():
        return groups_of_texts(df, words, percent)
    # Some id has several texts: each text is compared by a number of its own.
    node = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", content))
    found = stored(groups_of_texts(df.select(node.alias("doc_id"), "text"), words, percent))
    nameless = found.where("doc_id IS NULL")
    by_node = found.where("doc_id IS NOT NULL").distinct().withColumnRenamed("doc_id", "node")
    rows = df.where("doc_id IS NOT NULL").select("doc_id", node.alias("node"))
    rows = stored(rows.join(by_node, "node").drop("node"))
    first = rows.groupBy("component_id").agg(F.min("doc_id").alias("a"))
    roots = components(rows.join(first, "component_id").select("a", F.col("doc_id").alias("b")))
    out = rows.drop("component_id").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    return out.unionByName(nameless)


def groups_of_texts(df: DataFrame, words: int, percent: int) -> DataFrame:
    """The same where all rows with an id have one text."""
    sizes = stored(signatures(df, words, percent))
    known = sizes.where("n > 0 AND doc_id IS NOT NULL")
    same = known.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    same = stored(same.where("first < last"))
    copies = known.join(same, ["n", "h1", "h2"]).where("doc_id <> first")
    copies = stored(copies.select(F.col("first").alias("a"), F.col("doc_id").alias("b")))
    starts = band_starts(sizes.agg(F.max("n")).first()[0] or 0, percent)
    shared = stored(shared_parts(df, words, percent, sizes, starts))
    pairs = stored(shared.where("few").select("a", "b").distinct())
    members = stored(with_roots(components(shared.where("NOT few").select("a", "b"))))
    # Copies are linked already; the first of them stands for all.
    firsts = known.join(copies.select(F.col("b").alias("doc_id")), "doc_id", "left_anti")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionAll(members.select("doc_id"))
    sketches = firsts.select("doc_id", "n", "band", "bits").join(ends, "doc_id", "left_semi")
    sketches = stored(sketches.dropDuplicates(["doc_id"]))
    near = stored(paired(pairs, sketches, percent).unionAll(narrowed(members, sketches, percent)))
    clusters = with_roots(components(near))
    sets = stored(candidate_sets(df, clusters, words).where("size(shingles) > 0"))
    compared = stored(against_leader(sets, percent))
    near = compared.where("linked").select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
    found = components(copies.unionAll(near).unionAll(in_blocks(sets, compared, percent)))
    out = sizes.select("doc_id", F.col("n").alias("n_shingles")).join(
        found.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    )
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each document's set of three-word shingles, and its group at a similarity of 0.9."""
    return similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=90)


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, with its columns."""
    groups = similar_groups(docs.select("doc_id", "text"))
    id_ = fresh(docs, "later")[0]
    later = groups.where("component_id < doc_id").select(F.col("doc_id").alias(id_)).distinct()
    return docs.join(later, F.col("doc_id") == F.col(id_), "left_anti")
