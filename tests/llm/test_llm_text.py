"""Tokens, lines, language-model scores and packing on small inputs, against plain Python."""

import base64
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from siteops.llm import bpe, lines, lm, ngrams, packing, tokenfiles, word_lm
from siteops.llm.common import scratch

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "", None, " ", "  \n\n x", "a b c　d\x1ce\x85f", "日本語テキスト" * 30, "é" * 150, "x" * 5000,
    "!!!???///" * 100, "🙂🙃 it's we'll 123\x00\x01", "\r\n\t  \n", "same same", "same same", "I'LL don't 12a34",
]


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Tokenizer(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def truth():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark, tokenizer, truth):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices("abcdefé ", k=k)) for k in (3, 40, 70, 300, 3000)]
    texts.append("".join(rng.choices("abcdefgh", k=4000)))
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, IDS string").repartition(3)
    frequent = bpe.frequent_words(df, tokenizer, most=40)
    assert 0 < len(frequent) <= 40
    assert all(ids == truth.encode_ordinary(w) for w, ids in frequent.items())
    for known in ({}, frequent):
        out = bpe.decode(bpe.encode(df, tokenizer, known), tokenizer)
        assert out.columns == ["doc_id", "text", "words", "ids", "bytes"]
        for r in out.collect():
            assert r.ids == truth.encode_ordinary(r.text or "")
            assert bytes(r.bytes) == (r.text or "").encode()


def test_bpe_fold_equals_python(spark, tokenizer):
    rng = random.Random(2)
    words = ["".join(rng.choices("theraiounésß12!", k=rng.randint(1, 20))) for _ in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    ids = bpe.let(tokenizer.table.column, lambda slots: tokenizer.word_ids(slots, F.col("word")))
    for r in df.select("word", ids.alias("ids")).collect():
        word = r.word.encode()
        assert r.ids == bpe.merged(word, tokenizer.ranks)
        if word not in tokenizer.ranks:
            assert r.ids == bpe.merged_by_heap(word, tokenizer.ranks)


def test_bpe_merges_a_rare_word_once(tokenizer, truth, monkeypatch):
    """However often and in however many slices it stands."""
    merges = Counter()
    plain = bpe.merged
    monkeypatch.setattr(bpe, "merged", lambda word, ranks: merges.update([word]) or plain(word, ranks))
    monkeypatch.setattr(bpe, "PLACES", 1000)
    words = [f" q{i}x" for i in range(700)] + ["é" * 40, " the"]
    rows = [words, [], words[::-1], words[5:9] * 50]
    find = tokenizer.ids_of_words({" the": truth.encode_ordinary(" the")})
    for arrays in (rows, rows[1:], [[]], []):
        got = find(pa.array(arrays, pa.list_(pa.string()))).to_pylist()
        assert got == [[i for w in row for i in truth.encode_ordinary(w)] for row in arrays]
    assert merges == {w.encode(): merges[w.encode()] if len(w) == 40 else 1 for w in words[:-1]}
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    assert tokenizer.ids_of_words({})(pa.array([words])).to_pylist() == [truth.encode_ordinary("".join(words))]


def test_bpe_merges_many_words_together(spark, tokenizer, truth, monkeypatch):
    """With the ids of the library; only long words and pieces are merged one by one."""
    rng = random.Random(3)
    kinds = ["abcdefgh", " theraioun", "éèßñ日本🙂", "0123!?\n\t", "aé1 \x00"]
    words = sorted({"".join(rng.choices(kinds[i % 5], k=rng.randint(1, 40))) for i in range(5000)})
    words += ["é" * 32, "é" * 40, "x" * 64, "x" * 65, " the", "a"]
    single = []
    plain = bpe.merged
    monkeypatch.setattr(bpe, "merged", lambda word, ranks: single.append(word) or plain(word, ranks))
    rows = [words[:50], [], words[50:], words[::-1]]
    got = tokenizer.ids_of_words({})(pa.array(rows, pa.list_(pa.string()))).to_pylist()
    assert got == [[i for w in row for i in truth._encode_single_piece(w)] for row in rows]
    assert single and all(len(w) > bpe.SHORT or w in tokenizer.ranks for w in single)


def test_bpe_pairs_find_all(spark, tokenizer):
    pieces = list(tokenizer.ranks)
    rng = random.Random(4)
    cuts = [(p[:i], p[i:]) for p in pieces for i in range(1, len(p))]
    cuts = [c for c in cuts if c[0] in tokenizer.ranks and c[1] in tokenizer.ranks]
    cuts += [(rng.choice(pieces), rng.choice(pieces)) for _ in range(20000)]
    a, b = (np.array([tokenizer.ranks[c[i]] for c in cuts], np.int32) for i in range(2))
    assert tokenizer.pairs.find(a, b).tolist() == [tokenizer.ranks.get(x + y, bpe.NONE) for x, y in cuts]


def test_bpe_of_nothing(spark, tokenizer):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.frequent_words(df, tokenizer) == {}
    assert bpe.encode(df, tokenizer, {}).count() == 0


def test_hash_table_finds_all():
    keys = [f"k{i}" for i in range(1000)]
    slots = bpe.hash_table(keys)
    assert sorted(i for i in slots if i is not None) == list(range(1000))


def plain_lines(rows, least):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    ids = [lines.NO_ID if i is None else i for i, _ in rows]
    for i, (_, text) in zip(ids, rows):
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, (doc_id, text) in zip(ids, rows):
        own = (text or "").split("\n")
        gone = [len(key(x)) >= least and len(holders[key(x)]) > 1 and min(holders[key(x)]) != i for x in own]
        out.append((doc_id, len(own), sum(gone), "\n".join(x for x, g in zip(own, gone) if not g)))
    return out


@pytest.mark.parametrize("bits", [None, 1 << 16])
def test_lines_equal_plain(spark, bits, monkeypatch):
    if bits:  # filters so full that most lines are suspected
        monkeypatch.setattr(lines, "filter_bits", lambda n: 2048)
    rng = random.Random(3)
    pool = [" The same LINE ", "the same line", "short", "ÄÖÜ äöü ß 12", "", "\ttabbed line one\r", "x" * 3000]
    pool += [f"line number {i} of the pool" for i in range(600)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (7, rows[7][1]), (None, pool[0] + "\n" + "only here it is"), (None, None)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, places string, key string")
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "places", "key", "n_lines", "n_dropped"]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(plain_lines(rows, lines.LEAST_CHARS), key=repr)


def test_lines_of_nothing(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_scores(corpus, texts, backoff=lm.BACKOFF):
    tri, context = Counter(), Counter()
    for t in corpus:
        padded = "\0\0" + (t or "")
        tri.update(padded[i : i + 3] for i in range(len(t or "")))
    for g, n in tri.items():
        context[g[:2]] += n
    two, middle, one = Counter(), Counter(), Counter()
    for g, n in tri.items():
        two[g[1:]] += n
    for g, n in two.items():
        middle[g[0]] += n
        one[g[1]] += n
    total = sum(one.values()) + len(one) + 1
    for t in texts:
        padded, score = "\0\0" + (t or ""), 0.0
        for i in range(len(t or "")):
            g = padded[i : i + 3]
            if g in tri:
                p = tri[g] / context[g[:2]]
            elif g[1:] in two:
                p = backoff * two[g[1:]] / middle[g[1]]
            else:
                p = backoff**2 * (one[g[2]] + 1) / total
            score += math.log(p)
        yield round(score / len(t), 6) if t else None


def test_backoff_scores_equal_plain(spark):
    corpus = ["the cat sat", "the mat", None, "", "ééé the", "the cat sat"]
    texts = ["the cat", "xyz", "cat sat on the mat 日本", None, "", "cat xat", "cat xat", "a" * 4000]
    known = spark.createDataFrame([(t,) for t in corpus], "text string")
    rows = [(i, t, "own") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    out = lm.score(df, lm.trigram_counts(known))
    assert out.columns == ["doc_id", "text", "row", "lm_chars", "lm_score"]
    got = {r.doc_id: (r.lm_chars, r.lm_score) for r in out.collect()}
    for i, (t, want) in enumerate(zip(texts, plain_scores(corpus, texts))):
        assert got[i][0] == len(t or "")
        assert got[i][1] == pytest.approx(want, abs=2e-6) if want is not None else got[i][1] is None
    assert lm.score(df.limit(0), lm.trigram_counts(known.limit(0))).count() == 0
    assert lm.score(df, lm.trigram_counts(known.limit(0))).where("lm_score IS NOT NULL").count() == 6


def plain_word_scores(corpus, texts, backoff=lm.BACKOFF):
    grams = Counter()
    for t in corpus:
        padded = ["", "", *(t or "").split()]
        if len(padded) > 2:
            grams.update([("",), ("", "")])
        for i in range(2, len(padded)):
            grams.update(tuple(padded[i - k : i + 1]) for k in range(3))
    ones = [n for g, n in grams.items() if len(g) == 1 and g != ("",)]
    for t in texts:
        padded, score = ["", "", *(t or "").split()], 0.0
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            if (a, b, c) in grams:
                p = grams[a, b, c] / grams[a, b]
            elif (b, c) in grams:
                p = backoff * grams[b, c] / grams[b,]
            else:
                p = backoff**2 * (grams[c,] + 1) / (sum(ones) + len(ones) + 1)
            score += math.log(p)
        yield round(score / (len(padded) - 2), 6) if len(padded) > 2 else None


def test_word_backoff_equals_plain(spark):
    corpus = ["the cat sat on the mat", "the mat", None, "", " \n ", "the cat sat", "on the cat"]
    texts = ["the cat sat", "xyz", "mat sat on the cat", "on the mat sat", None, "", " ", "the  cat", "the  cat", "w " * 900]
    known = spark.createDataFrame([(t,) for t in corpus], "text string")
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    counts = word_lm.word_counts(known)
    assert counts.count() == counts.select("gram").distinct().count()
    for wanted in (corpus, []):
        out = word_lm.score(df, word_lm.word_counts(known if wanted else known.limit(0)))
        assert out.columns == ["doc_id", "text", "row", "lm_words", "lm_score"]
        got = {r.doc_id: (r.lm_words, r.lm_score) for r in out.collect()}
        for i, (t, want) in enumerate(zip(texts, plain_word_scores(wanted, texts))):
            assert got[i][0] == len((t or "").split())
            assert got[i][1] == pytest.approx(want, abs=2e-6) if want is not None else got[i][1] is None
    assert word_lm.score(df.limit(0), counts).count() == 0


@pytest.mark.parametrize("texts", [["abc", "", "ab"], ["x" * 70, "日本" * 50], ["".join(map(chr, range(40, 900)))]])
def test_trigrams(texts):
    keys, inverse = ngrams.trigrams(*ngrams.code_points(texts))
    want = []
    for t in texts:
        c = [ngrams.PAD, ngrams.PAD, *map(ord, t)]
        want += [c[i] << 42 | c[i + 1] << 21 | c[i + 2] for i in range(len(t))]
    assert keys[inverse].tolist() == want and np.all(np.diff(keys) > 0)


def least_padding(lengths, counts, buckets):
    d = len(lengths)
    best = math.inf
    for cuts in itertools.combinations(range(1, d), min(buckets, d) - 1):
        ends = [*cuts, d]
        cost, a = 0, 0
        for b in ends:
            cost += lengths[b - 1] * sum(counts[a:b])
            a = b
        best = min(best, cost)
    return best


def test_bucket_bounds_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(30):
        d = int(rng.integers(1, 11))
        lengths = np.sort(rng.choice(60, d, replace=False))
        counts = rng.integers(1, 20, d)
        k = int(rng.integers(1, 6))
        bounds = packing.bucket_bounds(lengths, counts, k)
        assert len(bounds) == min(k, d) and bounds[-1] == lengths[-1]
        cost = sum(int(n) * next(b for b in bounds if b >= x) for x, n in zip(lengths, counts))
        assert cost == least_padding(lengths.tolist(), counts.tolist(), k)
    assert packing.bucket_bounds(np.array([], np.int64), np.array([], np.int64)) == []


def test_bins_lose_little_padding(spark):
    rng = np.random.default_rng(8)
    lengths = np.sort(rng.choice(np.arange(200, 9000), 300, replace=False))
    counts = rng.integers(1, 50, 300)
    rows = spark.createDataFrame([(int(n),) for n in lengths], "n long")
    bins = {r.n: r.bin for r in rows.select("n", packing.length_bin(F.col("n")).alias("bin")).collect()}
    binned = Counter()
    for n, m in zip(lengths.tolist(), counts.tolist()):
        binned[bins[n]] += m
    tops = sorted(binned)

    def padded(bounds):
        places = np.searchsorted(bounds, lengths)
        return int((np.array(bounds)[places] * counts).sum())

    best = padded(packing.bucket_bounds(lengths, counts))
    got = padded(packing.bucket_bounds(np.array(tops), np.array([binned[t] for t in tops])))
    assert best <= got <= best * 129 / 128


def test_pack(spark):
    rows = [(i, n) for i, n in enumerate([0, 0, 5, 5, 5, 300, 301, 9, 100_000, None])] + [(3, 5), (None, 2)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, size long, bucket int")
    out = packing.pack(df, F.col("size"), budget=600, buckets=4).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in out if r.doc_id is not None) == sorted(
        (i, n or 0) for i, n in rows if i is not None
    )
    batches = defaultdict(list)
    for r in out:
        assert r.n_tokens <= r.padded
        batches[r.bucket, r.batch].append(r)
    for own in batches.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0].padded <= 600
    assert packing.pack(df.limit(0), F.col("size")).count() == 0


@pytest.mark.parametrize("block", [2, 6, 1 << 20])
def test_separator_scan(spark, block):
    rng = random.Random(5)
    rows = [(i, [rng.randint(1, 9) for _ in range(rng.choice([0, 0, 1, 3, 50]))], "a") for i in range(40)]
    rows += [(40, None, "b"), (40, [1, 2], "b"), (None, [7] * 1000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<int>, document string").repartition(3)
    written = tokenfiles.write(df, "tokens", scratch(spark))
    found = tokenfiles.scan(written.select("file"), block=block)
    got = [(r.doc_id, r.n_tokens, r.ended) for r in written.join(found, ["file", "document"]).collect()]
    assert sorted(got, key=repr) == sorted(((i, len(t or []), True) for i, t, _ in rows), key=repr)
    none = tokenfiles.write(df.limit(0), "tokens", scratch(spark))
    assert tokenfiles.scan(none.select("file")).count() == 0


def test_separator_scan_open_end(spark, tmp_path):
    cases = {"open": [5, 0, 6, 7], "ends": [0, 0], "one": [9], "empty": []}
    for name, ids in cases.items():
        np.array(ids, "<u2").tofile(tmp_path / name)
    files = spark.createDataFrame([(str(tmp_path / n),) for n in cases], "file string")
    got = {}
    for r in tokenfiles.scan(files, block=2).orderBy("document").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.start, r.n_tokens, r.ended))
    assert got == {
        "open": [(0, 1, True), (2, 2, False)],
        "ends": [(0, 0, True), (1, 0, True)],
        "one": [(0, 1, False)],
    }


def test_token_that_ends_documents_is_refused(spark):
    df = spark.createDataFrame([([1, 0],)], "tokens array<int>")
    with pytest.raises(Exception, match="end-of-document"):
        tokenfiles.write(df, "tokens", scratch(spark))


def test_wide_tokens(spark):
    top = (1 << 32) - 1
    rows = [(1, [70_000, 1, 65_536]), (2, []), (3, None), (4, [top] * 50), (5, [256, 65_535])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<long>").repartition(2)
    written = tokenfiles.write(df, "tokens", scratch(spark), width=4)
    for block in (4, 12, 1 << 20):
        found = tokenfiles.scan(written.select("file"), block=block, width=4)
        got = sorted((r.doc_id, r.n_tokens) for r in written.join(found, ["file", "document"]).collect())
        assert got == [(i, len(t or [])) for i, t in rows]
    for bad in ([top + 1], [1, None]):
        one = spark.createDataFrame([(bad,)], "tokens array<long>")
        with pytest.raises(Exception, match="more than 32 bits"):
            tokenfiles.write(one, "tokens", scratch(spark), width=4)
    with pytest.raises(ValueError, match="whole tokens"):
        tokenfiles.scan(written.select("file"), block=6, width=4)
    with pytest.raises(ValueError, match="2 or 4"):
        tokenfiles.scan(written.select("file"), width=3, block=3)


def test_bpe_scan_counts_tokens(spark, truth):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = sorted((r.doc_id, r.n_tokens, r.ended) for r in tokenfiles.op2_bpe_scan(spark, folder).collect())
    assert got == sorted((r.doc_id, len(truth.encode_ordinary(r.text or "")), True) for r in docs)
