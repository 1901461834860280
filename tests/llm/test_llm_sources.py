"""Spelling variants, mixing and manifests on small inputs, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteops.llm import merkle, mixing, spelling
from siteops.llm.common import placed, stored
from siteops.llm.packing import word_count

DOCS = "doc_id long, text string, source string, size string, place string, TREE string, word string"


def frame(spark, rows):
    """Documents (doc_id, text, source), with more columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS).repartition(3)


def test_places(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3, None])) for _ in range(200)] + [("hot", 7)] * 150
    df = stored(spark.createDataFrame(rows, "part string, n int"))
    found = defaultdict(list)
    for r in placed(df, ["part"], ["n"]).collect():
        found[r.part].append((r.place, r.n, r.total))
    for part, n in Counter(r[0] for r in rows).items():
        got = sorted(found[part])
        assert [x[0] for x in got] == list(range(n)) and {x[2] for x in got} == {n}
        assert [x[1] for x in got] == sorted((r[1] for r in rows if r[0] == part), key=lambda v: (v is not None, v))
    assert placed(df.limit(0), [], ["n"]).count() == 0


# Spelling variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio):
    out = {}
    for w, n in counts.items():
        close = [x for x in counts if near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        formed = best is not None and counts[best] >= ratio * n
        out[w] = (best if formed else None, n, len(close), counts[best] if formed else None)

    def root(w):
        return w if out[w][0] is None else root(out[w][0])

    return {w: (v[0], root(w), *v[1:]) for w, v in out.items()}


@pytest.mark.parametrize("cell", [4, 50, 1 << 14])
def test_variants(spark, monkeypatch, cell):
    rng = random.Random(cell)
    monkeypatch.setattr(spelling, "SEARCHERS", 7)
    counts = {}
    for stem in ["melodious", "aaaaaaaa", "élégance", "zz", "a", "𝒳ordlike"]:
        for _ in range(60):
            w = list(stem)
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "e", "é", "ab"])
            if w:
                counts["".join(w)] = rng.choice([2, 3, 20, 30, 300])
    counts |= {"x" * 3000: 2, "x" * 2999 + "y": 40, "x" * 3001: 500, "abcdefg": 5, "gfedcba": 5, "bacdefg": 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(words, 10, cell).collect()}
    assert got == plain_variants(counts, 10)


def test_variants_of_nothing(spark):
    words = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(words).count() == 0


def plain_words(doc_id, text, thin):
    for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
        run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        if h % thin == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
        if len(run) >= 7:
            yield run


def test_runs(spark):
    long = " ".join("Élégance melodious ABCDEFGH shorter seventh eighths_niNetyy×÷words日本" for _ in range(3000))
    rows = [(1, long, "s"), (2, None, "s"), (3, "", None), (None, "melodious Melodious", "s"), (1, long, "s")]
    got = frame(spark, rows).select("doc_id", "text", spelling.runs(F.col("doc_id"), F.col("text"), 3).alias("words"))
    for r in got.collect():
        assert (r.words or []) == list(plain_words(r.doc_id, r.text, 3))
    n = Counter(w for r in rows for w in plain_words(r[0], r[1], 3))
    words = spelling.vocabulary(got.select("words"))
    assert {r.word: r.n for r in words.collect()} == {w: k for w, k in n.items() if k > 1}


# Mixing


def plain_targets(sizes, weights, most):
    """Words of each source, in order, by sharing again until no source is above its limit."""
    total, full = sum(sizes), set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        level = (total - sum(most * sizes[i] for i in full)) / (sum(weights[i % len(weights)] for i in rest) or 1)
        over = {i for i in rest if weights[i % len(weights)] * level > most * sizes[i]}
        if not over:
            return [most * s if i in full else weights[i % len(weights)] * level for i, s in enumerate(sizes)]
        full |= over


@pytest.mark.parametrize("run", [2, 5, 128])
def test_mix(spark, run):
    rng = random.Random(run)
    rows = [(i, "w " * rng.choice([0, 1, 3, 10, 40, 500]), rng.choice(["a", "b", "ä", "", None, "hot", "hot"])) for i in range(400)]
    rows += [(7, "same again", "hot")] * 60 + [(None, "x y", "b"), (None, None, "b"), (3, "tiny", "zz"), (4, None, "none")]
    df = frame(spark, rows)
    got = mixing.mix(df, word_count(F.col("text")), run=run).collect()
    again = mixing.mix(df.repartition(7), word_count(F.col("text")), run=run).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(order, plain_targets([sizes[s] for s in order], mixing.WEIGHTS, 3)))
    by = defaultdict(list)
    for r in got:
        by[r.source_size, round(r.target, 6)].append(r)
    assert {(sizes[s], round(t, 6)) for s, t in want.items()} == set(by)
    for (size, target), members in by.items():
        assert sum(r.size for r in members) in (size, 2 * size)  # two sources of the same size and target
        largest = max(r.size for r in members)
        if sum(r.size for r in members) == size:
            assert abs(sum(r.taken for r in members) - target) <= largest
        for r in members:
            assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
            assert r.size == 0 or abs(r.copies - target / size) < 1


def test_mix_is_fair(spark):
    """Over many trees, a row's copy is taken as often as its probability says; the sums of words hold."""
    rows = [(t, i, float(s), 0.3) for t in range(600) for i, s in enumerate([50, 20, 7, 7, 3, 1, 1])]
    df = spark.createDataFrame(rows, "tree long, place long, size double, p double").withColumn("id", F.col("place"))
    out = mixing.round_copies(df, 7, run=3).collect()
    taken, words = Counter(), Counter()
    for r in out:
        assert r.p in (0.0, 1.0)
        taken[r.id] += r.p
        words[r.tree] += r.p * r.size
    assert len(out) == len(rows) and all(abs(taken[i] / 600 - 0.3) < 0.08 for i in range(7))
    assert all(abs(w - 0.3 * 89) < 50 for w in words.values())
    assert abs(sum(words.values()) / 600 - 0.3 * 89) < 1.5


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, []), word_count(F.col("text"))).count() == 0
    got = mixing.mix(frame(spark, [(1, "", "a"), (2, None, None)]), word_count(F.col("text"))).collect()
    assert sorted((r.doc_id, r.target, r.taken) for r in got) == [(1, 0.0, 0), (2, 0.0, 0)]


# Manifests


def plain_hash(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    texts = [None if v is None else str(v) for v in values]
    return plain_hash("-" if t is None else f"{len(t.encode())}:{t}" for t in texts)


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([plain_hash(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_manifest(rows):
    """Of rows (doc_id, source, leaf, changed)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    members = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, r[2])) for s in sources}
    trees = {s: plain_tree([r[2] for r in m]) for s, m in members.items()}
    top = plain_tree([trees[s][-1][0] for s in sources])
    for at, s in enumerate(sources):
        for place, (doc_id, _, leaf, changed) in enumerate(members[s]):
            now, proof = changed or leaf, []
            for levels, i in ((trees[s], place), (top, at)):
                for level in levels[:-1]:
                    kids = level[i // 3 * 3 : i // 3 * 3 + 3]
                    proof += [k for j, k in enumerate(kids) if j != i % 3]
                    now, i = plain_hash([now if j == i % 3 else k for j, k in enumerate(kids)]), i // 3
            root = top[-1][0]
            yield doc_id, leaf, trees[s][-1][0], root, plain_hash(proof), now, now == root


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest(spark, height):
    rng = random.Random(height)
    rows = [(rng.choice([None, *range(40)]), rng.choice(["a", "x\ny", "é"]), rng.choice(["s", None, "", "ö", "hot", "hot"])) for _ in range(90)]
    rows += [(5, "copy", "hot")] * 30 + [(6, None, "alone"), (7, "z\n" * 20000, "long")]
    df = frame(spark, rows)
    values = [F.col("doc_id"), F.col("source")]
    leaf = merkle.leaf_of([*values, F.col("text")])
    changed = F.when(F.col("doc_id") % 2 == 0, merkle.leaf_of([*values, F.replace("text", F.lit("\n"), F.lit(""))]))
    got = merkle.manifest(df, "doc_id", "source", leaf, changed, height).collect()
    plain = []
    for i, t, s in rows:
        other = plain_leaf(i, s, t and t.replace("\n", "")) if i is not None and i % 2 == 0 else None
        plain.append((i, s, plain_leaf(i, s, t), other))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_manifest(plain)))
    assert {r.verified for r in got} == {True, False}


def test_small_manifests(spark):
    assert merkle.manifest(frame(spark, []), "doc_id", "source", F.sha2("text", 256)).count() == 0
    one = merkle.manifest(frame(spark, [(1, "t", None)]), "doc_id", "source", F.sha2("text", 256)).first()
    leaf = hashlib.sha256(b"t").hexdigest()
    assert one[1:] == (leaf, leaf, leaf, hashlib.sha256(b"").hexdigest(), leaf, True)


def test_states_resume(spark):
    """A state after whole blocks goes on as that of the standard library."""
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(5)]
    words = np.frombuffer(b"".join(digests), ">u4").reshape(-1, 8).T.astype(np.uint32)
    state = merkle.begun(1)
    for i in range(5):
        state = merkle.compress(state, merkle.text_block(words[:, i : i + 1]))
    got = merkle.written(merkle.finish(state, np.array([5])))[0].as_py()
    assert got == hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()
