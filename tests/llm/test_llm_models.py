"""Quality, language, audio, search and near copies on small inputs."""

import bisect
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteops.llm import boosting, components as graph, jaccard, language, media, ngrams, quality, topk
from siteops.llm.components import components

SF = "/root/testdata/sf0.01"


def test_forest_learns_and_flattens():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > -0.2)).astype(float)
    forest = boosting.fit(x[:2000], y[:2000])
    assert ((forest.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    row, margin = x[2500], forest.base
    for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(row[feature[node]] > cut[node])
        margin += leaf[node - len(feature)]
    assert margin == pytest.approx(forest.margin(row[None])[0])


def test_forest_without_labels():
    empty = boosting.fit(np.zeros((0, 3)), np.zeros(0))
    assert empty.probability(np.ones((2, 3))).tolist() == [0.5, 0.5]
    assert (boosting.fit(np.ones((9, 3)), np.ones(9)).probability(np.ones((1, 3))) > 0.8).all()


def test_quality_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.op3_quality_trees(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert len(found) > 50
    assert sum(r.predicted == r.quality for r in found) >= 0.97 * len(found)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found)
    assert docs.count() == quality.op3_quality_trees(spark, SF).count()


def test_quality_odd_rows(spark):
    forest = quality.train(
        spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    )
    rows = [(1, None), (1, ""), (None, "\n\n"), (2, "word " * 30_000), (2, "word " * 30_000), (3, "é日"), (4, " ")]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, SCORE string, source string")
    out = quality.score(df, forest).collect()
    assert len(out) == 7 and all(0 <= r["score"] <= 1 and r.predicted == (r["score"] >= 0.7) for r in out)
    same = {r["score"] for r in out if r.doc_id == 2}
    assert len(same) == 1
    assert out[0]["score"] == out[1]["score"]
    none = spark.createDataFrame([], "doc_id long, text string, quality int")
    assert quality.keep_good(none.select("doc_id", "text"), none.select("doc_id", "quality")).count() == 0


def test_statistics_do_not_depend_on_neighbours():
    texts = [b"One two. Two!", b"", b"\n", "Ünï 12 ###\nÜnï 12 ###".encode(), b"a " * 500]
    kinds = quality.byte_kinds()
    together = quality.statistics(texts, kinds)
    assert np.allclose(together, np.concatenate([quality.statistics([t], kinds) for t in texts]))
    named = dict(zip(quality.NAMES, together[3]))
    assert named["distinct_lines"] == 0.5 and named["repeats"] == 0 and named["digits"] > 0


def test_language_held_out_and_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    known = language.training_part(docs)
    model = language.fit(known)
    bounds = language.calibrate(known, model)
    found = language.predict(docs, model, bounds=bounds)
    held = found.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert found.where("rejected AND letters > 0").count() <= 2
    rng = random.Random(2)
    noise = "".join(rng.choices("qxzjkvwbpfg", k=3000))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, noise), (None, "the thing of the"), (5, "日本語" * 9)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, LETTERS string")
    out = {r.doc_id: r for r in language.predict(df, model, bounds=bounds).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[3]["score"] == 0
    assert all(out[i].rejected for i in (1, 2, 3, 4, 5)) and out[4].lang_pred != "und"
    assert out[None].lang_pred == "en" and not out[None].rejected


def test_language_without_training(spark):
    df = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    model = language.fit(df)
    r = language.predict(df, model, bounds=language.calibrate(df, model)).first()
    assert (r.lang_pred, r["score"], r.rejected) == ("und", 0.0, True)
    assert language.keep_known(df.limit(0)).count() == 0


def plain_kneser_ney(texts):
    """P(c | a, b) of an interpolated model of one language, over the padded letters of its texts."""
    tri = Counter()
    for t in texts:
        letters = re.sub(r"[^a-z]+", " ", t.lower()).lstrip()
        padded = "##" + letters
        tri.update(padded[i : i + 3] for i in range(len(letters)))
    two = Counter(g[1:] for g in tri)
    one = Counter(g[1:] for g in two)
    d, kinds = language.DISCOUNT, sum(one.values())
    unseen = d * len(one) / kinds / (len(one) + 1)
    total, many, after, sorts = Counter(), Counter(), Counter(), Counter()
    for g, n in tri.items():
        total[g[:2]] += n
        many[g[:2]] += 1
    for g, n in two.items():
        after[g[0]] += n
        sorts[g[0]] += 1

    def p(g):
        p1 = (max(one[g[2]] - d, 0) / kinds if g[2] in one else 0) + unseen
        b = g[1]
        p2 = max(two[g[1:]] - d, 0) / after[b] + d * sorts[b] / after[b] * p1 if after[b] else p1
        ab = g[:2]
        return max(tri[g] - d, 0) / total[ab] + d * many[ab] / total[ab] * p2 if total[ab] else p2

    return p


def test_kneser_ney_equals_plain(spark):
    texts = ["the cat sat on the mat", "a cat, a hat! The end", "banana bandana"]
    df = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    p = plain_kneser_ney(texts)
    tests = ["the cat", "zebra hat", "bananas and qqq"]
    h, n = language.entropies(tests, language.fit(df))
    for t, got, count in zip(tests, h[:, 0], n):
        padded = "##" + t
        # "a" twice in a row isn't in the texts, so all levels of backing off are used.
        seen = [p(padded[i : i + 3]) for i in range(len(t))]
        assert count == len(t)
        assert got == pytest.approx(-sum(map(math.log, seen)) / len(t), rel=1e-3)


@pytest.mark.parametrize("most", [0, 7, 40])
def test_cut_language_models_give_the_same(spark, most):
    """Trigrams beyond the arrays are scored as exactly as those in them."""
    texts = [
        ("xx", "the cat sat on the mat"), ("xx", "a cat, a hat! The end"), ("yy", "el gato y la casa"),
        ("yy", "banana bandana ñandú"), ("zz", "der Hund und die Katze"), ("zz", "the end"),
    ]
    rows = [(i, t, x) for i, (x, t) in enumerate(texts)]
    rows += [(10, "zebra hat qqq", None), (11, None, None), (12, "1 2", None), (13, "日本 the", None), (10, "la la", None)]
    df = spark.createDataFrame(rows, "row long, text string, `a lang` string").repartition(3)
    known = df.where("`a lang` IS NOT NULL").withColumnRenamed("a lang", "lang")
    whole, cut = language.fit(known), language.fit(known, most=most)
    assert not whole.cut and cut.cut and len(cut.trigram) == most // 3
    bounds = [language.calibrate(known, m) for m in (whole, cut)]
    assert bounds[1].keys() == bounds[0].keys()
    for x, found in bounds[0].items():
        assert bounds[1][x] == pytest.approx(found, rel=1e-4)
    want, got = (language.predict(df, m, bounds=b) for m, b in zip((whole, cut), bounds))
    assert got.columns == want.columns
    order = lambda r: (r.row, r.text or "")
    want, got = (sorted(x.collect(), key=order) for x in (want, got))
    assert len(got) == len(rows)
    for g, w in zip(got, want):
        assert (g.row, g.text, g.lang_pred, g.letters, g.rejected) == (w.row, w.text, w.lang_pred, w.letters, w.rejected)
        assert (g.score, g.entropy) == pytest.approx((w.score, w.entropy), rel=1e-4)
    kept = language.predict(df, cut, keep=["row"])
    assert kept.columns[:2] == ["row", "lang_pred"] and kept.count() == len(rows)
    with pytest.raises(ValueError):
        language.entropies(["the"], cut)


def test_letters_only():
    codes, ends = ngrams.letters_only(*ngrams.code_points(["1a, b!", "", "--", "é x", "ab"]))
    text = "".join(map(chr, codes))
    assert [text[a:b] for a, b in zip(ends, ends[1:])] == ["a b ", "", "", "é x", "ab"]


def slow_ima(block):
    sample = int.from_bytes(block[:2], "little", signed=True)
    index = min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = media.STEPS[index]
            size = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                size += part if code & bit else 0
            sample = max(-32768, min(32767, sample - size if code & 8 else sample + size))
            index = max(0, min(88, index + media.MOVES[code & 7]))
            out.append(sample)
    return out


def test_ima_blocks_equal_plain():
    rng = np.random.default_rng(3)
    blocks = rng.integers(0, 256, (7, 36), np.uint8)
    got = media.ima_blocks(blocks, media.ima_tables())
    assert got.tolist() == [slow_ima(b.tobytes()) for b in blocks]


def test_laws():
    mu, a = media.mu_law_table(), media.a_law_table()
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def test_to_pcm(spark):
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 1000, np.uint8).tobytes()
    files = [
        media.wav(media.MU_LAW, data), media.wav(media.A_LAW, data), media.wav(media.IMA, data[:72], block=36),
        media.wav(media.PCM, data, 16000, 2, 16), media.wav(media.MU_LAW, b""), b"RIFF", None, b"",
        media.wav(media.MU_LAW, data),
    ]
    df = spark.createDataFrame([(i, f, 5) for i, f in enumerate(files)], "id long, media binary, PCM int")
    out = media.to_pcm(df)
    assert out.columns == ["id", "media", "pcm"]
    got = {r.id: None if r.pcm is None else bytes(r.pcm) for r in out.collect()}
    law = media.mu_law_table()[np.frombuffer(data, np.uint8)]
    kind, rate, _, pcm = media.parse_wav(got[0])
    pcm = np.frombuffer(pcm, "<i2")
    assert (kind, rate, len(pcm)) == (media.PCM, 16000, 2000) and (pcm[::2] == law).all()
    middle = (law[:-1].astype(int) + law[1:]) // 2
    assert (pcm[1:-1:2] == middle).all() and pcm[-1] == law[-1]
    assert len(media.parse_wav(got[2])[3]) == 2 * 2 * 65 * 2
    assert media.parse_wav(got[3])[3] == data and media.parse_wav(got[4])[3] == b""
    assert [got[i] for i in (5, 6, 7)] == [None] * 3 and got[8] == got[0]
    assert media.to_pcm(df.limit(0)).count() == 0


def test_audio_round_trip(spark):
    texts = ["", None, "short", "é" * 96, "x" * 200_000, "short"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    stored = media.store_texts(df)
    rows = {r.doc_id: r for r in stored.collect()}
    found = {r.doc_id: r for r in media.features(stored).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = media.parse_wav(bytes(rows[i].media))[3]
        assert payload.rstrip(b" ") == raw.rstrip(b" ") and len(payload) % 192 == 0 < len(payload)
        assert len(payload) - len(raw) < 192 or not raw
        assert (found[i].n_bytes, found[i].payload_bytes) == (len(raw), len(payload))
        assert found[i].tail_crc32 == zlib.crc32(payload[-16:])
    assert found[2].feature == found[5].feature and found[0].media_sha256 == found[1].media_sha256


def plain_top(rows, k):
    known, most = [], 2**63
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            known.append((i, [math.floor(64 * x) for x in v]))
    for n, (q, own) in enumerate(known):
        if q % 20 == 0:
            scores = [(sum(a * b for a, b in zip(own, z)), i) for m, (i, z) in enumerate(known) if m != n]
            pairs = [(-min(max(s, -most), most - 1), i) for s, i in scores]
            for rank, (score, i) in enumerate(sorted(pairs)[:k], 1):
                yield q, rank, i, -score


@pytest.mark.parametrize("k", [3, 20])
def test_top_k_equals_plain(spark, k, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(150)]
    rows += [(i, [0.5, 0.5, 0.0, 0.0, 0.0]) for i in range(200, 260)]  # many copies, three of them queries
    rows += [(i, [0.0] * 5) for i in range(300, 330)] + [(400, [1e9, -1e9, 0.0, 1.0, 2.0]), (401, [-1e9, 1e9, 1.0, 0.0, 0.0])]
    rows += [(500, None), (520, [1.0, None, 0.0, 0.0, 0.0]), (540, [float("nan")] * 5), (560, [float("inf")] * 5)]
    rows += [(None, [1.0] * 5), (40, [0.1] * 5), (40, [0.1] * 5), (580, [1.0, 1.0]), (600, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    out = topk.top_k(df, F.col("vec_id") % 20 == 0, k)
    got = sorted((r.query_id, r["rank"], r.vec_id, r["score"]) for r in out.collect())
    assert got == sorted(plain_top(rounded, k))


def test_top_k_of_large_vectors(spark):
    """Scores near and beyond the limits of a long, also where large parts cancel each other."""
    big = [[2e7, 2e7], [2.1e7, 2.1e7], [2.2e7, 2.2e7], [3e7, 1e7], [3e8, 3e8], [3e8, -3e8], [-3e8, 3e8], [3e8, -3e8 + 64]]
    rows = [(20, [2e7, 2e7]), (40, [3e8, 3e8]), (60, [3e8, -3e8]), *enumerate(big, 1), (9, [0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.top_k(df, F.col("vec_id") % 20 == 0)
    assert sorted((r.query_id, r["rank"], r.vec_id, r["score"]) for r in out.collect()) == sorted(plain_top(rows, 20))


def test_top_k_moves_no_vector_for_a_block_of_queries(spark, monkeypatch):
    """Vectors were joined to every block of queries, and a task held as many of them as there are."""
    plans = []
    plain = topk.stored
    monkeypatch.setattr(
        topk, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df)
    )
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "ROUND", 1000, raising=False)  # several rounds
    rng = random.Random(11)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.top_k(df, F.col("vec_id") % 20 == 0, 5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r["score"]) for r in out.collect()) == sorted(plain_top(rows, 5))
    searched = [p for p in plans if "MapInArrow" in p]
    assert searched and not any("Join" in p or "Exchange" in p for p in searched)


def test_top_k_small(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    out = topk.top_k(df, F.col("vec_id") % 20 == 0)
    assert [tuple(r) for r in out.collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def plain_groups(rows, words, percent):
    sets = {}
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", low) if x]
        few = {tuple(w)} if w else set()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else few
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words, percent, block", [(3, 90, 1024), (3, 90, 4), (5, 80, 4), (2, 50, 5)])
def test_groups_equal_plain(spark, words, percent, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BITMAPS", 2 * block)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 4, 9, 30, 80, 200]))
        for _ in range(rng.choice([1, 2, 14])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, rows[0][1].upper()), (n + 4, "one"), (n + 5, "One  "), (n + 6, "x y " * 9000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, cluster int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(df, words, percent).collect()}
    assert got == plain_groups(rows, words, percent)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linked_sets_share_a_part(percent):
    """Also sets with few parts that have shingles, and those at the border of two bands."""
    rng = np.random.default_rng(8)
    starts = jaccard.band_starts(400, percent)
    alone = 0
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        most = n * (100 - percent) // percent  # shingles that the larger set may have more
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a, rng.integers(0, 1 << 63, int(rng.integers(0, most + 1))).astype(np.uint64)]))
        assert jaccard.links(a, b, percent)
        tile = bisect.bisect_right(starts, len(a)) - 1  # its lower band has the smaller set
        assert bisect.bisect_right(starts, len(b)) - 1 in (tile, tile + 1)
        d, parts = jaccard.tile_parts(tile, starts, percent)
        x, y = (jaccard.part_keys(s, jaccard.mix(s), tile, d, parts) for s in (a, b))
        assert len(np.intersect1d(x, y))
        alone += len(x) > len(a)  # each shingle is a part of its own, too
    assert alone or percent == 90  # sets of these sizes have more parts with shingles there


def test_unrelated_sets_share_no_part(spark):
    """Parts without shingles connected a large share of all documents, which were compared with each other."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randint(25, 60)))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = spark.createDataFrame([(i, len(t.split()) - 4) for i, t in rows], "doc_id long, n long")
    assert jaccard.shared_parts(df, 5, 80, sizes, jaccard.band_starts(60, 80)).count() == 0


def test_groups_of_many_that_share_a_part(spark, monkeypatch):
    """Sets that share a part are pairs where they are few, and clusters else."""
    monkeypatch.setattr(jaccard, "SMALL", 3)
    monkeypatch.setattr(jaccard, "BITMAPS", 4)
    rng = random.Random(10)
    rows = []
    for n in (2, 3, 4, 9, 12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([8, 60, 150]))]
        for _ in range(n):
            own = list(base)
            for _ in range(rng.randint(0, len(own) // 30)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(300)}"
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(df).collect()}
    assert got == plain_groups(rows, 5, 80)


def test_groups_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (7, text), (None, text), (None, None), (9, "other words are here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.similar_groups(df).collect()), key=repr)
    assert got == sorted([(5, 36, 5), (5, 36, 5), (7, 36, 5), (None, 36, None), (None, 0, None), (9, 1, 9)], key=repr)
    assert sorted(repr(r.doc_id) for r in jaccard.keep_first(df).collect()) == ["5", "5", "9", "None", "None"]
    assert jaccard.similar_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_groups_of_ids_with_several_texts(spark, seed):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (4, c), (4, d), (5, c + " more"), (6, d + " more")]
    rows += [(7, None), (7, "one two"), (8, ""), (None, a), (None, None)]
    if seed:
        rng = random.Random(seed)
        rows = [(rng.randrange(40), rng.choice([a, b, c, d]) + f" {rng.choice('xyz')}" * rng.randint(0, 9)) for _ in range(30)]
        rows += [(rng.randrange(40), " ".join(rng.choices("pqrstuvw", k=30))) for _ in range(20)]
    texts = dict(enumerate(rows))
    groups = plain_groups([(k, t) for k, (i, t) in texts.items() if i is not None], 5, 80)
    edges = {(texts[k][0], texts[root][0]) for k, (_, root) in groups.items()}
    root = {i: i for i, _ in rows if i is not None}
    for _ in root:
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    sizes = plain_groups(list((k, t) for k, (_, t) in texts.items()), 5, 80)
    want = [(i, sizes[k][0], root.get(i)) for k, (i, _) in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in jaccard.similar_groups(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (None, 3), (3, 9), (9, 3)]
    edges += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root) if find(x) != x}


def test_blocks_list_the_same_order_in_every_slice(spark):
    """Places in a block are compared between slices, whatever order rows arrive in."""
    rows = spark.range(3000).repartition(16).select(
        F.col("id").alias("object"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: i * F.col("id")).alias("v")
    )
    for r in topk.packed(rows, 500, 2, 4, "block", "vectors").collect():
        ids = [x.object for x in r.vectors]
        assert ids == sorted(ids) and all(x.part == [x.object * (2 * r.slice + j) for j in (1, 2)] for x in r.vectors)


def test_components_with_a_hub(spark):
    """A node with very many neighbours, as the smallest and as the largest of its component."""
    n = 100_000
    hub = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    top = spark.range(n, 2 * n).select(F.col("id").alias("a"), F.lit(3 * n).cast("long").alias("b"))
    found = graph.components(hub.unionAll(top))
    got = {r.root: (r.n, r.low, r.high) for r in found.groupBy("root").agg(
        F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")
    ).collect()}
    assert got == {0: (n - 1, 1, n - 1), n: (n, n + 1, 3 * n)}


def test_joins_at_a_hub_can_be_split(spark, monkeypatch):
    """Both sides of each join on a node are sorted right above their exchanges, as Spark needs to split skew."""
    plans = []
    plain = graph.stored
    monkeypatch.setattr(
        graph, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df)
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(1, 50).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
        graph.components(edges)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = 0
    for plan in plans:
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "SortMergeJoin" in line:
                joins += 1
                depth = line.index("SortMergeJoin")
                below = [x.strip(" :+-*()0123456789") for x in lines[i + 1:]]
                assert below[0].startswith("Sort ") and below[1].startswith("Exchange hashpartitioning"), plan
                other = next(j for j in range(i + 2, len(lines)) if lines[j].lstrip(" :").startswith("+-") and lines[j].index("+-") <= depth)
                assert "Sort " in lines[other] and "Exchange hashpartitioning" in lines[other + 1], plan
    assert joins >= 2
