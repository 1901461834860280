"""Replay against the plain loop, over random logs that include every special case."""

import datetime as dt
import random

import pytest
from store_model import run

from siteops.operators.replay import replay

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "store_key bigint, ts timestamp_ntz, seq bigint, kind string, id string, patch map<string,string>"
FIELDS = ("title", "body")
DELAY = dt.timedelta(seconds=40)


def random_log(seed, sizes, add_share=0.3):
    rng = random.Random(seed)
    rows = []
    for key, n in sizes.items():
        ids, t = [], 0
        for seq in range(n):
            t += rng.choice([0, 1, 3, 10, 40])
            kind = "ADD" if rng.random() < add_share else rng.choice(
                ["UPDATE", "UPDATE", "DISMISS", "DISMISS", "REMOVE"]
            )
            patch = None
            if kind == "ADD":
                ids.append(f"{key}-{seq}")
                rid, patch = ids[-1], {"title": f"t{seq}"}
            else:
                known = ids[-5:] or ["none"]
                rid = rng.choice([*known, known[-1], known[-1], "unknown", "", None])
                if kind == "REMOVE" and rid is None and rng.random() < 0.5:
                    rid = known[-1]
            if kind == "UPDATE":
                patch = rng.choice([
                    {"title": f"u{seq}"}, {"title": None}, {"body": f"b{seq}"},
                    {"open": "true"}, {"open": "false", "body": None}, {},
                ])
            rows.append((key, T0 + dt.timedelta(seconds=t), seq, kind, rid, patch))
    rng.shuffle(rows)
    return rows


def expected(rows, k, delay):
    out = []
    for key in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == key]
        for rid, f in run(own, k, delay, FIELDS).items():
            out.append((key, rid, f["added_at"], f["removed_at"], f["cause"], f["open"],
                        *[f[c] for c in FIELDS]))
    return sorted(out, key=lambda r: r[1])


MODES = [{"cuts": None}, {"chunk_rows": 20}, {"cuts": "ranges", "chunk_rows": 20}]


@pytest.mark.parametrize("mode", MODES, ids=["whole", "cut", "ranges"])
@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_random_logs(spark, k, mode):
    for seed, adds in ((1, 0.3), (2, 0.6), (3, 0.1)):
        rows = random_log(seed * 10 + k, {1: 600, 2: 80, 3: 7, 4: 1, None: 60}, adds)
        df = spark.createDataFrame(rows, SCHEMA)
        got = replay(df, k=k, delay=DELAY, fields=FIELDS, **mode).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows, k, DELAY)


@pytest.mark.parametrize("mode", MODES, ids=["whole", "cut", "ranges"])
def test_one_row_updated_throughout(spark, mode):
    """One row of one store gets nearly all actions, so its segment spans many chunks."""
    rng = random.Random(9)
    rows = [(1, T0, 0, "ADD", "a", None)]
    for i in range(1, 400):
        kind = "DISMISS" if i == 150 else "UPDATE"
        patch = {"title": f"u{i}"} if rng.random() < 0.5 else {"open": "true"}
        rows.append((1, T0 + dt.timedelta(seconds=i), i, kind, "a", patch if i != 150 else None))
    df = spark.createDataFrame(rows, SCHEMA)
    for k in (1, 3):
        got = replay(df, k=k, delay=DELAY, fields=FIELDS, **mode).collect()
        assert list(map(tuple, got)) == expected(rows, k, DELAY)


def test_coinciding_causes(spark):
    s = dt.timedelta(seconds=1)
    rows = [
        (1, T0, 0, "ADD", "a", None), (1, T0, 1, "DISMISS", "a", None),
        (1, T0 + DELAY, 2, "REMOVE", "a", None), (1, T0 + DELAY, 3, "ADD", "b", None),
        (1, T0 + DELAY + s, 4, "REMOVE", None, None), (1, T0 + DELAY + s, 5, "ADD", "c", None),
        (1, T0 + DELAY + s, 6, "ADD", "d", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: (r.removed_at, r.cause) for r in replay(df, delay=DELAY, cuts=None).collect()}
    assert got == {
        "a": (T0 + DELAY, "expiry"), "b": (T0 + DELAY + s, "remove"),
        "c": (T0 + DELAY + s, "evict"), "d": (None, None),
    }
