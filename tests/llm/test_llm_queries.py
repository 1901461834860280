"""The registered queries against their SQL, and what they return."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siteops.llm import registry
from test_llm_models import plain_groups
from test_llm_text import plain_lines

FOLDER = os.environ.get("SITEOPS_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    df = registry.QUERIES[name](spark, FOLDER)
    cursor = con.execute(registry.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(cursor.fetchall(), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert len(got) == len(want) and [x for x in zip(got, want) if x[0] != x[1]][:3] == []


CONTRACTS = {
    "op3_quality_trees": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_telephony_audio": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, "
    "tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op10_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_columns(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    kinds = dict(df.dtypes)
    assert all(kinds[c] == kind for c, kind in (x.split(" ") for x in CONTRACTS[name].split(", ")))
    assert df.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns
        before, rows = rows, {r.doc_id: r for r in docs.collect()}
        texts = [(i, r.text) for i, r in before.items()]
        if name == "language":
            assert len(rows) >= 0.99 * len(before)
        if name == "quality":
            right = [(i in rows) == labels[i] for i in before if i in labels]
            assert sum(right) >= 0.97 * len(right)
        if name == "line_dedup":
            assert {i: r.text for i, r in rows.items()} == {x[0]: x[3] for x in plain_lines(texts, 10)}
            assert all(r.n_chars == len(r.text) for r in rows.values())
        if name == "near_copies":
            assert set(rows) == {i for i, (_, root) in plain_groups(texts, 5, 80).items() if root == i}
        if name != "line_dedup":
            assert all(r == before[i] for i, r in rows.items())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert sorted(r.doc_id for r in out.collect()) == sorted(rows)


#: Names that the stages use for columns of their own, and one with a dot.
CLASHES = [
    "score", "predicted", "lang_pred", "rejected", "letters", "entropy", "n_lines", "n_dropped", "later", "component_id",
    "row", "id", "mark", "key", "node", "root", "n_tokens", "bucket", "batch", "slot", "place", "total", "a.b", "Held_Out",
]


def test_pipeline_keeps_clashing_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(120)
    more = {n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in CLASHES}
    docs = docs.select("source", *[v.alias(n) for n, v in more.items()], "text", "doc_id", "lang", "n_chars").cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) >= 60
        for r in rows:
            assert [r[n] for n in CLASHES] == [f"{n} of {r.doc_id}" for n in CLASHES], name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in out.collect()} == texts


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
