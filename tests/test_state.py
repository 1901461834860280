"""Store pieces on small logs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siteops.operators import state

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_latest_k(spark):
    rows = [(k, at(t), t) for k in (1, None) for t in range(5)]
    df = spark.createDataFrame(rows, "k bigint, ts timestamp_ntz, seq bigint")
    got = state.latest_k(df, ["k"], ["ts", "seq"], 2).collect()
    assert sorted(((r.k or 0), r.seq, r.pos) for r in got) == [(0, 3, 2), (0, 4, 1), (1, 3, 2), (1, 4, 1)]
    plan = state.latest_k(df, ["k"], ["ts", "seq"], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_patches(spark):
    base = spark.createDataFrame(
        [("a", "t", 1), ("b", None, 2), ("c", "keep", 3)], "id string, title string, size int"
    )
    patches = spark.createDataFrame(
        [
            ("a", 1, {"title": "x"}), ("a", 2, {"size": "9"}), ("a", 3, {"title": "y"}),
            ("b", 1, {"title": "z", "size": "5"}), ("b", 2, {"size": None}), ("c", 1, {}),
            ("unknown", 1, {"title": "no"}),
        ],
        "id string, seq int, patch map<string,string>",
    )
    got = state.apply_patches(base, patches, ["id"], ["seq"], ["title", "size"]).collect()
    assert sorted(map(tuple, got)) == [("a", "y", 9), ("b", "z", None), ("c", "keep", 3)]


ACTIONS = "k bigint, ts timestamp_ntz, seq bigint, kind string, id string"
ROWS = "k bigint, id string, ts timestamp_ntz, seq bigint, open boolean"


def stored(spark):
    rows = [(1, "a", at(0), 0, True), (1, "b", at(5), 1, True), (2, "c", at(0), 2, True),
            (3, "d", at(1), 3, True)]
    return spark.createDataFrame(rows, ROWS)


def test_dismiss(spark):
    log = [
        (1, at(4), 5, "DISMISS", None),  # before b was added
        (2, at(6), 6, "DISMISS", "zzz"), (2, at(7), 7, "DISMISS", ""), (3, at(8), 8, "DISMISS", "d"),
        (3, at(9), 9, "DISMISS", "d"), (9, at(9), 10, "DISMISS", None),
    ]
    out = state.dismiss(stored(spark), spark.createDataFrame(log, ACTIONS), ["k"], ["ts", "seq"])
    assert {r.id: r.open for r in out.collect()} == {"a": False, "b": True, "c": True, "d": False}


def test_remove(spark):
    log = [
        (1, at(4), 5, "REMOVE", None), (2, at(6), 6, "REMOVE", "zzz"), (2, at(7), 7, "REMOVE", ""),
        (3, at(8), 8, "REMOVE", "d"), (2, at(8), 9, "DISMISS", None),
    ]
    out = state.remove(stored(spark), spark.createDataFrame(log, ACTIONS), ["k"], ["ts", "seq"])
    assert sorted(r.id for r in out.collect()) == ["b", "c"]


def test_first_dismissal_arms(spark):
    df = spark.createDataFrame([("a", at(5)), ("a", at(1)), ("b", at(2))], "id string, ts timestamp_ntz")
    got = state.expire_after(df, ["id"], "ts").collect()
    assert {r.id: r.expires_at for r in got} == {"a": at(1001), "b": at(1002)}


@pytest.mark.parametrize("mode", [{"cuts": None}, {"chunk_rows": 20}, {"cuts": "ranges", "chunk_rows": 20}])
def test_running_fields(spark, mode):
    rng = random.Random(6)
    rows = [
        (k, at(t), rng.choice([None, "x", "y", str(t)])) for k, n in ((1, 300), (2, 20)) for t in range(n)
    ]
    df = spark.createDataFrame(rows, "k bigint, ts timestamp_ntz, v string")
    got = state.running_fields(df, ["k"], ["ts"], {"now": F.col("v")}, **mode).collect()
    last, want = {}, []
    for k, t, v in rows:
        last[k] = v if v is not None else last.get(k)
        want.append((k, t, v, last[k]))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_assign_ids(spark):
    rng = random.Random(7)
    rows = [(at(rng.choice([1, 1, 1, 2, 9])), n) for n in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "ts timestamp_ntz, seq bigint").repartition(6)
    got = state.assign_ids(df, ["ts", "seq"]).collect()
    want = {seq: str(n) for n, (_, seq) in enumerate(sorted(rows), 1)}
    assert {r.seq: r.id for r in got} == want


def test_patches_of_a_null_key(spark):
    base = spark.createDataFrame([(None, "old"), (1, "old")], "k bigint, note string")
    patches = spark.createDataFrame([(None, 1, {"note": "new"})], "k bigint, seq bigint, patch map<string,string>")
    got = state.apply_patches(base, patches, ["k"], ["seq"], ["note"]).collect()
    assert {r.k: r.note for r in got} == {None: "new", 1: "old"}
