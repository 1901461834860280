"""Merkle manifest of a dataset: a root over all rows, and proofs that fold a row back to it.

A node is the SHA-256 of its children's digests as hexadecimal text, three at most. A digest in that text
is exactly one block of the hash, so the state of a parent's hash before each child slot is a full state
of eight words, and can be kept, stored, sent to other tasks and resumed there. A row is folded with the
states that its parents kept: the digest that replaces it and the siblings to its right go in, and never
those to its left. The hash itself runs in numpy over all nodes of a level at once.

A tree is built in runs of 3 ** `HEIGHT` consecutive nodes, one group each, whose top nodes are the
leaves of the next storey. Rows are folded to the top of their run in the same group; the steps from
there to the root are one short record for each run and are joined to the rows once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteops.llm.common import placed, stored, table

#: Levels of one run; 3 ** 8 nodes are 6561.
HEIGHT = 8
WAYS = 3
PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, math.isqrt(p) + 1))]
#: Of the standard: fractions of the roots of primes.
START = np.array([math.isqrt(p << 64) % (1 << 32) for p in PRIMES[:8]], np.uint32)[:, None]
ROUNDS = [np.uint32(int(p ** (1 / 3) * (1 << 32)) % (1 << 32)) for p in PRIMES]
#: Four hexadecimal digits as one word of text.
HEX = np.frombuffer("".join(f"{i:04x}" for i in range(1 << 16)).encode(), ">u4").astype(np.uint32)
#: One level of a row's way up: the parent's state before the row's slot, its siblings, slot, and children.
STEP = np.dtype([("state", ">u4", 8), ("first", ">u4", 8), ("second", ">u4", 8), ("slot", "u1"), ("size", "u1")])


def turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> n) | (x << (32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8 x n) after one more block (16 x n) each."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        low = turned(x, 7) ^ turned(x, 18) ^ (x >> 3)
        high = turned(y, 17) ^ turned(y, 19) ^ (y >> 10)
        w.append(w[t - 16] + low + w[t - 7] + high)
    a, b, c, d, e, f, g, h = state
    for k, word in zip(ROUNDS, w):
        x = h + (turned(e, 6) ^ turned(e, 11) ^ turned(e, 25)) + (g ^ (e & (f ^ g))) + k + word
        y = (turned(a, 2) ^ turned(a, 13) ^ turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = x + y, a, b, c, d + x, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def text_block(digests: np.ndarray) -> np.ndarray:
    """Digests (8 x n) as hexadecimal text: one block each."""
    out = np.empty((16, digests.shape[1]), np.uint32)
    out[0::2], out[1::2] = HEX[digests >> 16], HEX[digests & 0xFFFF]
    return out


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages that end after so many whole blocks."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0], last[15] = 1 << 31, blocks.astype(np.uint32) * 512
    last[14] = blocks.astype(np.uint64) * 512 >> 32
    return compress(state, last)


def begun(n: int) -> np.ndarray:
    return np.repeat(START, n, axis=1)


def levels_of(total: int, height: int) -> int:
    """Levels that a run of a tree with so many nodes has."""
    levels = 0
    while total > 1 and levels < height:
        total, levels = -(-total // WAYS), levels + 1
    return levels


def grow(nodes: np.ndarray, levels: int) -> tuple[list[tuple], np.ndarray]:
    """(nodes, states kept before each slot, children) of the parents of each level, and the top node."""
    kept = []
    for _ in range(levels):
        n = nodes.shape[1]
        blocks, state = text_block(nodes), begun(-(-n // WAYS))
        states = np.empty((WAYS, *state.shape), np.uint32)
        sizes = np.minimum(n - WAYS * np.arange(state.shape[1]), WAYS)
        for slot in range(WAYS):
            states[slot] = state
            having = len(range(slot, n, WAYS))
            state = state.copy()
            state[:, :having] = compress(state[:, :having], blocks[:, slot::WAYS])
        kept.append((nodes, states, sizes))
        nodes = finish(state, sizes)
    return kept, nodes


def steps(level: tuple, at: np.ndarray) -> np.ndarray:
    """The `STEP`s of the nodes at these places of a level."""
    nodes, states, sizes = level
    parent, slot = at // WAYS, at % WAYS
    out = np.zeros(len(at), STEP)
    out["state"], out["slot"], out["size"] = states[slot, :, parent], slot, sizes[parent]
    for name, other in (("first", np.where(slot == 0, 1, 0)), ("second", np.where(slot == 2, 1, 2))):
        place = parent * WAYS + other
        there = place < nodes.shape[1]
        out[name][there] = nodes[:, place[there]].T
    return out


def climb(now: np.ndarray, proof: np.ndarray, taken: np.ndarray, step: np.ndarray) -> tuple:
    """One level up: the parents' digests with `now` in its slot, and the proof's hash with the siblings.

    Resumes the state before the slot. `taken` counts the siblings that the proof has.
    """
    words = {k: step[k].T.astype(np.uint32) for k in ("state", "first", "second")}
    slot, size = step["slot"], step["size"].astype(np.int64)
    state, proof = compress(words["state"], text_block(now)), proof.copy()
    for name, right, some in (("first", (slot == 0) & (size > 1), size > 1), ("second", (slot < 2) & (size > 2), size > 2)):
        block = text_block(words[name])
        if right.any():
            state[:, right] = compress(state[:, right], block[:, right])
        if some.any():
            proof[:, some] = compress(proof[:, some], block[:, some])
    return finish(state, size), proof, taken + size - 1


def read(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Digests or states (8 x n) from a column of 32 bytes each."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, 8).T.astype(np.uint32)


def written(words: np.ndarray) -> pa.Array:
    data = pa.py_buffer(np.ascontiguousarray(words.T).astype(">u4").tobytes())
    return pa.Array.from_buffers(pa.binary(32), words.shape[1], [None, data]).cast(pa.binary())


def ascend(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(tree, place, path, top) of nodes (tree, place, total, digest): the steps to the tree's root, and the root.

    Places count from 0 in each tree of `total` nodes. The states that parents keep before their slots
    are in the steps. One shuffle for each storey, of which there are log(total) / log(3 ** height).
    """

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        total, place = table["total"][0].as_py(), table["place"].to_numpy()
        levels, top = grow(read(table["digest"]), levels_of(total, height))
        at = np.arange(len(place))
        ways = np.empty((len(at), len(levels)), STEP)
        for i, level in enumerate(levels):
            ways[:, i] = steps(level, at // WAYS**i)
        return pa.table(
            {
                "tree": table["tree"],
                "place": table["place"],
                "run": table["run"],
                "total": table["total"],
                "path": pa.array([way.tobytes() for way in ways], pa.binary()),
                "top": pa.array([written(top)[0].as_py()] * len(at), pa.binary()),
            }
        )

    width = WAYS**height
    runs = nodes.select("tree", "place", "total", "digest", F.floor(F.col("place") / width).alias("run"))
    now = stored(
        runs.groupBy("tree", "run").applyInArrow(
            build, "tree bigint, place bigint, run bigint, total bigint, path binary, top binary"
        )
    )
    if now.where(F.col("total") > width).isEmpty():
        return now.select("tree", "place", "path", "top")
    tops = now.select("tree", F.col("run").alias("place"), F.ceil(F.col("total") / width).alias("total"), "top")
    above = ascend(tops.withColumnRenamed("top", "digest").distinct(), height)
    above = above.select("tree", F.col("place").alias("run"), F.col("path").alias("rest"), "top")
    return now.drop("top").join(above, ["tree", "run"]).select("tree", "place", F.concat("path", "rest").alias("path"), "top")


def manifest(
    df: DataFrame, doc_id: str, source: str, leaf: Column, replacement: Column | None = None, height: int = HEIGHT
) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, all digests as text.

    `leaf` is the digest of a row, as hexadecimal text; `leaf_of` makes one. Each source has a tree over its
    rows by id, nulls first, and the roots of the sources, nulls first and then by code point, are the
    leaves of the tree to `root`. `folded_root` is what the row's `replacement` (the leaf, where that is
    null) gives with the states and siblings of the untouched tree, and `verified` whether it is the root.
    Rows with the same id stand in the order of their leaves; equal rows have leaves and proofs of their
    own. A dataset of one row has that row's leaf as its root, and an empty proof. An empty table has no rows.
    """
    width = WAYS**height
    changed = F.lit(None).cast("string") if replacement is None else replacement
    given = stored(
        df.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            F.col(f"`{source}`").alias("source"),
            F.unhex(leaf).alias("leaf"),
            F.unhex(changed).alias("changed"),
        )
    )
    sources = placed(stored(given.select("source").distinct()), [], ["source"])
    facts = stored(sources.select("source", F.col("place").alias("tree"), F.col("total").alias("trees")))
    rows = placed(given, ["source"], ["doc_id", "leaf"], facts=facts).drop("source")
    runs = rows.withColumn("run", F.floor(F.col("place") / width))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        leaves, n = read(table["leaf"]), len(table)
        levels, top = grow(leaves, levels_of(table["total"][0].as_py(), height))
        now, proof, taken = read(pc.coalesce(table["changed"], table["leaf"])), begun(n), np.zeros(n, np.int64)
        for i, level in enumerate(levels):
            now, proof, taken = climb(now, proof, taken, steps(level, np.arange(n) // WAYS**i))
        return pa.table(
            {c: table[c] for c in ("doc_id", "tree", "trees", "run", "total", "leaf")}
            | {
                "now": written(now),
                "proof": written(proof),
                "taken": pa.array(taken),
                "top": pa.array([written(top)[0].as_py()] * n, pa.binary()),
            }
        )

    kind = dict(given.dtypes)["doc_id"]
    made = "leaf binary, now binary, proof binary, taken bigint, top binary"
    first = stored(
        runs.groupBy("tree", "run").applyInArrow(
            build, f"doc_id {kind}, tree bigint, trees bigint, run bigint, total bigint, {made}"
        )
    )
    tops = first.select(
        "tree", F.col("run").alias("place"), F.ceil(F.col("total") / width).alias("total"), F.col("top").alias("digest")
    )
    inner = stored(ascend(tops.distinct(), height))
    trees = first.select("tree", "trees").distinct().join(inner.select("tree", "top").distinct(), "tree")
    nodes = trees.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("trees").alias("total"), F.col("top").alias("digest")
    )
    outer = ascend(nodes, height).select(F.col("place").alias("tree"), F.col("path").alias("rest"), F.col("top").alias("root"))
    above = inner.join(outer, "tree").select(
        "tree", F.col("place").alias("run"), F.concat("path", "rest").alias("path"), F.col("top").alias("subroot"), "root"
    )
    joined = first.select("tree", "run", "doc_id", "leaf", "now", "proof", "taken").join(stored(above), ["tree", "run"])

    def fold(batches):
        for batch in batches:
            if not len(batch):
                continue
            now, proof, taken = read(batch["now"]), read(batch["proof"]), batch["taken"].to_numpy().copy()
            paths = batch["path"].to_pylist()
            many = np.array([len(p) // STEP.itemsize for p in paths])
            every, start = np.frombuffer(b"".join(paths), STEP), np.cumsum(many) - many
            for i in range(many.max()):
                on = np.flatnonzero(many > i)
                now[:, on], proof[:, on], taken[on] = climb(now[:, on], proof[:, on], taken[on], every[start[on] + i])
            columns = [batch[c] for c in ("doc_id", "leaf", "subroot", "root")]
            yield pa.RecordBatch.from_arrays(
                [*columns, written(finish(proof, taken)), written(now)],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"],
            )

    digests = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    folded = joined.mapInArrow(fold, f"doc_id {kind}, " + ", ".join(f"{c} binary" for c in digests))
    text = [F.lower(F.hex(c)).alias(c) for c in digests]
    return folded.select("doc_id", *text, (F.col("folded_root") == F.col("root")).alias("verified"))


def leaf_of(values: Sequence[Column]) -> Column:
    """SHA-256 over values in order: `-` for null, else the bytes of their text, `:`, and the text."""
    texts = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what its text without line ends folds to, for half of them."""
    docs = table(spark, sf_dir, "documents")
    before = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(tampered, leaf_of([*before, F.replace("text", F.lit("\n"), F.lit(""))]))
    return manifest(docs, "doc_id", "source", leaf_of([*before, F.col("text")]), changed)


def _sql(levels: int = 12) -> str:
    """The same in SQL, with so many levels of each tree written out (3^12 rows a source and 3^12 sources)."""

    def tree(nodes: str, rows: str, name: str) -> list[str]:
        """Levels over `nodes` (tree, place, total, digest), and `rows` (tree, pos, now, proof) folded up them."""
        out = []
        for i in range(1, levels + 1):
            below, docs = (nodes, rows) if i == 1 else (f"{name}{i - 1}", f"{name}_rows{i - 1}")
            out.append(f"""{name}{i} AS MATERIALIZED (
  SELECT tree, place // {WAYS} AS place, (any_value(total) + {WAYS - 1}) // {WAYS} AS total, any_value(total) > 1 AS grows,
         list(digest ORDER BY place) AS kids,
         CASE WHEN any_value(total) > 1 THEN sha256(string_agg(digest, '' ORDER BY place)) ELSE any_value(digest) END AS digest
  FROM {below} GROUP BY tree, place // {WAYS}
), {name}_rows{i} AS MATERIALIZED (
  SELECT r.* EXCLUDE (pos, now, proof), pos // {WAYS} AS pos,
         CASE WHEN grows THEN sha256(array_to_string(list_transform(kids, lambda x, i: CASE WHEN i = pos % {WAYS} + 1 THEN now ELSE x END), ''))
              ELSE now END AS now,
         proof || CASE WHEN grows THEN array_to_string(list_filter(kids, lambda x, i: i <> pos % {WAYS} + 1), '') ELSE '' END AS proof
  FROM {docs} r JOIN {name}{i} k ON r.tree = k.tree AND r.pos // {WAYS} = k.place
)""")
        return out

    def leaf(text: str) -> str:
        parts = [f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END" for x in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    bits = "list_reduce(range(8), lambda c, b: xor(c // 2, (c & 1) * 3988292384), {})"
    comma = ",\n"
    return f"""
WITH crc AS (
  SELECT list({bits.format("i")} ORDER BY i) AS crcs FROM range(256) t(i)
), hashed AS (
  SELECT d.*, coalesce(xor(list_reduce(list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT),
           lambda c, b: xor(c // 256, crcs[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 2 = 0, false) AS tampered
  FROM documents d, crc
), leaves AS (
  SELECT doc_id, source, {leaf("text")} AS leaf,
         CASE WHEN tampered THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS changed
  FROM hashed
), rows_ AS MATERIALIZED (
  SELECT doc_id, leaf, changed, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS total
  FROM leaves
), nodes AS (SELECT tree, place, total, leaf AS digest FROM rows_
), ways AS (SELECT doc_id, leaf, tree, place AS pos, changed AS now, '' AS proof FROM rows_
),
{comma.join(tree("nodes", "ways", "t"))},
subroots AS (
  SELECT 0 AS tree, tree AS place, count(*) OVER () AS total, digest FROM t{levels}
), upper_ways AS (
  SELECT r.doc_id, r.leaf, t.digest AS subroot, 0 AS tree, r.tree AS pos, r.now, r.proof
  FROM t_rows{levels} r JOIN t{levels} t ON r.tree = t.tree
),
{comma.join(tree("subroots", "upper_ways", "u"))}
SELECT r.doc_id, r.leaf, r.subroot, u.digest AS root, sha256(r.proof) AS proof_sha256, r.now AS folded_root,
       r.now = u.digest AS verified
FROM u_rows{levels} r, u{levels} u
"""


SQL = _sql()
