"""Interaction operators against plain-Python models, with keys left whole and with every key cut."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siteops.functions import is_mobile
from siteops.operators import timeline
from siteops.operators.interaction import (
    changes_only,
    hover_intervals,
    sessions,
    toggle_state,
    ttl_latest,
)
from siteops.operators.timeline import find_cuts, range_cuts

T0 = dt.datetime(2024, 1, 1)
SEC = dt.timedelta(seconds=1)
# Left whole, and cut into chunks of about 20 rows at quantiles or at the borders of equal ranges.
MODES = [{"cuts": None}, {"chunk_rows": 20}, {"cuts": "ranges", "chunk_rows": 20}]


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def times(rng, n, hot=False):
    return sorted(rng.sample(range(n * 6), n))


def model_sessions(rows, gap):
    out = []
    for key in {k for k, _ in rows}:
        run = None
        for t in sorted(t for k, t in rows if k == key):
            if run and t - run[1] < gap:
                run = [run[0], t, run[2] + 1]
            else:
                if run:
                    out.append((key, *run))
                run = [t, t, 1]
        out.append((key, *run))
    return sorted(out, key=repr)


@pytest.mark.parametrize("mode", MODES)
def test_sessions(spark, mode):
    rng = random.Random(1)
    rows = [(k, at(t)) for k, n in ((1, 400), (2, 60), (3, 1), (None, 80)) for t in times(rng, n)]
    df = spark.createDataFrame(rows, "k bigint, ts timestamp_ntz")
    for gap in (4 * SEC, 9 * SEC, 100 * SEC):
        got = sorted(map(tuple, sessions(df, ["k"], "ts", gap, **mode).collect()), key=repr)
        assert got == model_sessions(rows, gap)


def test_session_tie_splits(spark):
    rows = [(1, T0 + dt.timedelta(milliseconds=m)) for m in (0, 149, 299, 500)]
    df = spark.createDataFrame(rows, "k bigint, ts timestamp")
    got = sessions(df, ["k"], "ts", dt.timedelta(milliseconds=150), cuts=None).collect()
    assert sorted(r.n_events for r in got) == [1, 1, 2]


def model_hover(rows, delay):
    out, active, opened, pending = [], None, None, None
    for t, kind, label, mega in rows:
        if pending is not None and pending <= t:
            if active is not None:
                out.append((active, opened, pending))
            active, pending = None, None
        if kind == "enter" and mega:
            pending = None
            if active != label:
                if active is not None:
                    out.append((active, opened, t))
                active, opened = label, t
        elif kind == "leave" and active is not None and pending is None:
            pending = t + delay
    if active is not None:
        out.append((active, opened, pending))
    return out


@pytest.mark.parametrize("mode", MODES)
def test_hover_intervals(spark, mode):
    rng = random.Random(2)
    rows, want = [], []
    for key, n in ((1, 300), (2, 40), (3, 5)):
        own = []
        for i, t in enumerate(times(rng, n)):
            label = rng.choice("ABC")
            own.append((at(t), rng.choice(["enter", "leave"]), label, label != "C"))
        rows += [(key, t, i, label, kind, mega) for i, (t, kind, label, mega) in enumerate(own)]
        want += [(key, *r) for r in model_hover(own, 5 * SEC)]
    df = spark.createDataFrame(
        rows, "k bigint, ts timestamp_ntz, seq bigint, label string, kind string, has_mega boolean"
    )
    got = hover_intervals(df, ["k"], ["ts", "seq"], 5 * SEC, **mode).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("mode", MODES)
def test_changes_only(spark, mode):
    rng = random.Random(3)
    rows = [
        (k, at(t), rng.choice([500, 767, 768, 1200, None]))
        for k, n in ((1, 300), (2, 9))
        for t in times(rng, n)
    ]
    df = spark.createDataFrame(rows, "k bigint, ts timestamp_ntz, width int")
    want = []
    for key in (1, 2):
        own = [(t, w is not None and w < 768) for k, t, w in rows if k == key]
        want += [(key, b[0], b[1]) for a, b in zip(own, own[1:]) if a[1] != b[1]]
    got = changes_only(df, ["k"], ["ts"], is_mobile(F.col("width")), **mode)
    assert sorted(map(tuple, got.select("k", "ts", "changed_to").collect())) == sorted(want)
    nulls = changes_only(df, ["k"], ["ts"], F.col("width"), **mode)
    want = []
    for key in (1, 2):
        own = [(t, w) for k, t, w in rows if k == key]
        want += [(key, *b) for a, b in zip(own, own[1:]) if a[1] != b[1]]
    got = nulls.select("k", "ts", "changed_to").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("mode", MODES)
def test_toggle_state(spark, mode):
    rng = random.Random(4)
    rows, want = [], []
    for key, n in ((1, 300), (2, 30)):
        state = {"desktop": True, "mobile": False}
        for t in times(rng, n):
            device, kind = rng.choice(["desktop", "mobile"]), rng.choice(["toggle"] * 4 + ["set"])
            value = rng.choice([True, False, None]) if kind == "set" else None
            state[device] = not state[device] if kind == "toggle" else bool(value)
            rows.append((key, at(t), device, kind, value))
            want.append((key, at(t), state[device]))
    df = spark.createDataFrame(
        rows, "k bigint, ts timestamp_ntz, device string, kind string, value boolean"
    )
    got = toggle_state(df, ["k", "device"], ["ts"], F.col("device") == "desktop", **mode)
    assert sorted(map(tuple, got.select("k", "ts", "is_open").collect())) == sorted(want)


def test_ttl_latest(spark):
    rows = [(1, at(0), "a"), (1, at(5), None), (2, at(1), "b"), (3, at(9), "c"), (4, at(2), "d")]
    df = spark.createDataFrame(rows, "k bigint, ts timestamp_ntz, v string")
    as_of = F.lit(at(8)).cast("timestamp_ntz")
    got = ttl_latest(df, ["k"], ["ts"], F.col("v"), as_of, 6 * SEC).collect()
    assert sorted((r.k, r.value, r.expires_at) for r in got) == [(1, None, at(11))]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_cuts_do_not_depend_on_the_session_zone(spark, kind):
    rng = random.Random(8)
    start = dt.datetime(2024, 11, 2, 12)  # the clock goes back in New York the next night
    rows = [(k, start + dt.timedelta(seconds=60 * t)) for k in (1, 2) for t in times(rng, 300)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame(rows, f"k bigint, ts {kind}")
        whole = sessions(df, ["k"], "ts", 300 * SEC, cuts=None).collect()
        cut = sessions(df, ["k"], "ts", 300 * SEC, chunk_rows=20).collect()
        assert len(chunk_sizes(df, ["ts"], find_cuts(df, ["k"], "ts", 20))) > 20
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(map(tuple, cut)) == sorted(map(tuple, whole))


def test_a_third_of_the_rows_is_heavy(spark, monkeypatch):
    monkeypatch.setattr(timeline, "MIN_CHUNK_ROWS", 10)
    rows = [(k, at(t)) for t in range(900) for k in (0 if t % 3 == 0 else t,)]
    df = spark.createDataFrame(rows, "k bigint, ts timestamp_ntz")
    cuts = find_cuts(df, ["k"], "ts")
    assert cuts.borders.count() == 1
    sizes = chunk_sizes(df, ["ts"], cuts)
    assert sum(sizes) == 300 and max(sizes) <= 900 / 32 + 10


def test_cuts_follow_the_heavy_key(spark):
    rng = random.Random(5)
    rows = [(1, at(t)) for t in times(rng, 900)] + [(k, at(k)) for k in range(2, 600)]
    df = spark.createDataFrame(rows, "k bigint, ts timestamp")
    assert find_cuts(df, ["k"], "ts") is None
    cuts = find_cuts(df, ["k"], "ts", chunk_rows=50)
    assert cuts.borders.count() == 1
    assert len(chunk_sizes(df, ["ts"], cuts)) >= 15


def chunk_sizes(df, order, cuts):
    cut = timeline.Timeline(df, ["k"], order, cuts).df.filter("_chunk >= 0")
    return [r["count"] for r in cut.groupBy("k", "_chunk").count().collect()]


def in_one_hour(n):
    return [(1, at(0) + i * dt.timedelta(milliseconds=150), i) for i in range(n)]


HEAVY = {
    "one hour of a year": in_one_hour(4000) + [(9, at(0) + i * dt.timedelta(hours=80), i) for i in range(100)],
    "outliers": in_one_hour(4000)
    + [(1, dt.datetime(1970, 1, 1), 0), (1, dt.datetime(9999, 12, 31), 1), (2, dt.datetime(9999, 12, 31), 0)],
    "one time": [(1, at(0), i) for i in range(4000)],
    "one time among others": in_one_hour(2000) + [(1, at(100), 5000 + i) for i in range(3000)],
    "no time": [(1, None if i % 2 else at(i), i) for i in range(1000)],
}


@pytest.mark.parametrize("case", HEAVY)
def test_heavy_keys_are_cut_by_their_own_times(spark, case):
    df = spark.createDataFrame(HEAVY[case], "k bigint, ts timestamp_ntz, seq bigint")
    cuts = find_cuts(df, ["k"], "ts", chunk_rows=100, then="seq")
    if case != "no time":  # rows without a time stay in one chunk
        assert max(chunk_sizes(df, ["ts", "seq"], cuts)) <= 200
    ordered = df.withColumn("value", F.col("seq") % 7)
    whole, cut = (
        changes_only(ordered, ["k"], ["ts", "seq"], F.col("value") < 3, "low", cuts=c) for c in (None, cuts)
    )
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, whole.collect()))


@pytest.mark.parametrize("shape", ["one key", "one time", "texts", "many keys", "all alike but one"])
def test_ranges_are_even_for_any_skew(spark, shape):
    """Chunks and uncut keys stay within twice the mean of the ranges, whatever the rows look like."""
    n, parts = 40_000, 8
    i = F.col("id")
    key, ts, then = {
        "one key": (F.lit(1), i, i),
        "one time": (F.when(i % 10 == 0, i), F.lit(5), i),
        "texts": (F.when(i % 3 > 0, "hot").otherwise(i.cast("string")), F.lit(5), F.md5(i.cast("string"))),
        "many keys": (i % 5000, i, i),
        "all alike but one": (F.when(i == 7, 2), F.lit(None).cast("long"), F.sha2(i.cast("string"), 256)),
    }[shape]
    df = spark.range(n, numPartitions=6).select(
        key.alias("k"), F.timestamp_seconds(ts).cast("timestamp_ntz").alias("ts"), then.alias("seq"), (i % 7).alias("value")
    )
    cuts = range_cuts(df, ["k"], ["ts", "seq"], parts)
    cut = timeline.Timeline(df, ["k"], ["ts", "seq"], cuts)
    sizes = [r["count"] for r in cut.df.groupBy(*cut.parts).count().collect()]
    assert max(sizes) <= 2 * n / parts and sum(sizes) == n
    whole, parted = (
        changes_only(df, ["k"], ["ts", "seq"], F.col("value") < 3, "low", cuts=c) for c in (None, cuts)
    )
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, parted.collect()))
