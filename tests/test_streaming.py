"""Streams against their batch forms."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_replay import DELAY, FIELDS, SCHEMA, random_log

from siteops.operators.interaction import changes_only, hover_intervals, sessions, toggle_state
from siteops.operators.replay import replay
from siteops.operators.routing import not_found
from siteops.plans import activity
from siteops.streaming import (
    FanOut,
    NumberedBatches,
    ReplayBatches,
    Snapshots,
    changes_stream,
    fan_out,
    hover_stream,
    not_found_sketches,
    not_found_stream,
    not_found_windows,
    parquet_sink,
    replay_stream,
    run_to_parquet,
    sessions_stream,
    toggle_stream,
    top_not_found,
    ttl_stream,
)
from siteops.streaming import replay as streaming_replay

STREAM_SCHEMA = SCHEMA.replace("timestamp_ntz", "timestamp")


def write_files(spark, rows, schema, folder, files):
    """Splits rows into consecutive files; their modification times give the order of arrival."""
    target, seen = f"{folder}/in", set()
    step = -(-len(rows) // files)
    for n in range(files):
        part = spark.createDataFrame(rows[n * step:(n + 1) * step], schema).coalesce(1)
        part.write.mode("append").parquet(target)
        for name in set(os.listdir(target)) - seen:
            seen.add(name)
            os.utime(f"{target}/{name}", (1_000_000_000 + n * 10,) * 2)
    return target


def read_stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_replay_stream_equals_batch(spark, tmp_path):
    rng = random.Random(11)
    rows = sorted(random_log(21, {1: 250, 2: 60, 3: 9}), key=lambda r: r[1])
    last = max(r[1] for r in rows)
    # Disorder within 30 seconds, which the stream is told to expect.
    jitter = {id(r): r[1] + dt.timedelta(seconds=rng.uniform(0, 29)) for r in rows}
    arrived = sorted(rows, key=lambda r: jitter[id(r)])
    path = write_files(spark, arrived, STREAM_SCHEMA, str(tmp_path), 4)
    for k in (1, 3):
        stream = replay_stream(
            read_stream(spark, path, STREAM_SCHEMA), k=k, delay=DELAY, fields=FIELDS,
            lateness=dt.timedelta(seconds=30),
        )
        got = run_to_parquet(stream).drop("batch_id").collect()
        batch = replay(
            spark.createDataFrame(rows, STREAM_SCHEMA), k=k, delay=DELAY, fields=FIELDS, cuts=None
        )
        upto = last - dt.timedelta(seconds=30)
        want = batch.filter(F.col("removed_at") <= F.lit(upto)).collect()
        assert len(want) > 30
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("k", [1, 3])
def test_replay_by_batches_equals_batch(spark, tmp_path, k):
    rng = random.Random(14)
    late = dt.timedelta(seconds=30)
    rows = sorted(random_log(23, {1: 250, 2: 60, 3: 9, None: 20}), key=lambda r: r[1])
    jitter = {id(r): r[1] + dt.timedelta(seconds=rng.uniform(0, 29)) for r in rows}
    arrived = sorted(rows, key=lambda r: jitter[id(r)])
    path = write_files(spark, arrived, STREAM_SCHEMA, str(tmp_path), 4)
    replays = ReplayBatches(
        f"{tmp_path}/slots", parquet_sink(f"{tmp_path}/out"), k=k, delay=DELAY, fields=FIELDS,
        lateness=late, chunk_rows=20,
    )

    def twice(batch, batch_id):
        """A batch may be delivered again after a failure."""
        replays(batch, batch_id)
        if batch_id == 2:
            replays(batch, batch_id)

    stream = read_stream(spark, path, STREAM_SCHEMA)
    fan_out(stream, {"replay": twice}, f"{tmp_path}/state", availableNow=True).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch_id").collect()
    batch = replay(spark.createDataFrame(rows, STREAM_SCHEMA), k=k, delay=DELAY, fields=FIELDS, cuts=None)
    want = batch.filter(F.col("removed_at") <= F.lit(rows[-1][1] - late)).collect()
    assert len(want) > 30
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_replay_stream_survives_a_restart(spark, tmp_path):
    rows = sorted(random_log(22, {1: 120, 2: 40}), key=lambda r: r[1])
    half, out = len(rows) // 2, f"{tmp_path}/out"
    for n, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, STREAM_SCHEMA).coalesce(1).write.mode("append").parquet(
            f"{tmp_path}/in"
        )
        stream = replay_stream(
            read_stream(spark, f"{tmp_path}/in", STREAM_SCHEMA), delay=DELAY, fields=FIELDS,
            lateness=dt.timedelta(0),
        )
        fan_out(
            stream, {"out": parquet_sink(out)}, f"{tmp_path}/state", availableNow=True
        ).awaitTermination()
    got = spark.read.parquet(out).drop("batch_id").collect()
    batch = replay(spark.createDataFrame(rows, STREAM_SCHEMA), delay=DELAY, fields=FIELDS, cuts=None)
    want = batch.filter(F.col("removed_at") <= F.lit(rows[-1][1])).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_replay_stream_of_few_buckets(spark, tmp_path):
    """Stores that share a bucket stay apart, and keys keep their kinds and nulls."""
    schema = STREAM_SCHEMA.replace("store_key bigint", "store_key bigint, `at` timestamp, raw binary, s struct<a: double>")
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0, 123456)
    stores = [
        (1 << 60, t0, b"\xff\x00", (0.1,)), ((1 << 60) + 1, t0, b"\xff", (None,)), (None, t0, b"", (1e300,)),
        (None, None, b"", (1e300,)), (3, t0 + dt.timedelta(microseconds=1), b"x", None),
    ]
    rows = [(*s, *r[1:]) for i, s in enumerate(stores) for r in random_log(40 + i, {1: 60})]
    rows = sorted(rows, key=lambda r: r[4])
    path = write_files(spark, rows, schema, str(tmp_path), 3)
    keys = ["store_key", "at", "raw", "s"]
    stream = replay_stream(
        read_stream(spark, path, schema), keys, 3, DELAY, FIELDS, lateness=dt.timedelta(0), buckets=2
    )
    got = run_to_parquet(stream).drop("batch_id")
    batch = replay(spark.createDataFrame(rows, schema), keys, 3, DELAY, FIELDS, cuts=None)
    want = batch.filter(F.col("removed_at") <= F.lit(rows[-1][4]))
    assert got.dtypes == want.dtypes
    got, want = got.collect(), want.collect()
    assert len({r.raw for r in want}) == 4
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


class _Handle:
    """States of one bucket, which count the calls to them."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, set()

    def getListState(self, name, _):
        return _State(self, name)

    getValueState = getListState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return 10_000


class _State:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def _set(self, value):
        self.handle.calls += 1
        self.handle.values[self.name] = value

    def get(self):
        self.handle.calls += 1
        return self.handle.values[self.name]

    def exists(self):
        self.handle.calls += 1
        return self.name in self.handle.values

    def appendList(self, items):
        self._set(self.handle.values.get(self.name, []) + items)

    put = update = _set

    def clear(self):
        self.handle.calls += 1
        del self.handle.values[self.name]


def test_replay_stream_calls_states_once_a_bucket():
    """The calls do not grow with the stores."""
    handle = _Handle()
    stores = streaming_replay._Stores(k=1, delay=1_000_000, fields=[])
    stores.init(handle)
    n = 2000
    rows = [(f"s{i % n}", t, f'{{"seq":{t},"kind":"ADD","id":"{i}"}}') for t, i in enumerate(range(2 * n))]
    parts = [pd.DataFrame(rows[a:a + 500], columns=["store", "at", "action"]) for a in range(0, 2 * n, 500)]
    assert list(stores.handleInputRows(("b",), iter(parts), handle)) == []
    out = pd.concat(stores.handleExpiredTimer(("b",), handle, None))
    assert len(out) == n and set(out["cause"]) == {"evict"}
    assert handle.calls < 40


def test_arriving_steps_are_written_by_several_tasks(spark, monkeypatch):
    """Each batch has all rows of a step, whatever its size."""
    monkeypatch.setattr(activity, "FILE_ROWS", 50)
    t0 = dt.datetime(2024, 1, 4)  # a week begins
    rows = [(i, t0 + dt.timedelta(minutes=i)) for i in range(3 * 7 * 24 * 60)] + [(-1, t0 + dt.timedelta(days=30))]
    df = spark.createDataFrame(rows, "n bigint, ts timestamp").repartition(6)
    stream = activity._arriving(df, "ts", dt.timedelta(days=7))
    batches = run_to_parquet(stream.withColumn("file", F.input_file_name()))
    got = batches.groupBy("batch_id").agg(
        F.count("*").alias("rows"), F.countDistinct("file").alias("files"), F.min("n").alias("least")
    )
    week = 7 * 24 * 60
    found = [tuple(r)[1:] for r in got.orderBy("batch_id").collect()]
    assert [(r, least) for r, _, least in found] == [(week, 0), (week, week), (week, 2 * week), (1, -1)]
    assert all(files > 1 for _, files, _ in found[:3])
    assert run_to_parquet(activity._arriving(df.limit(0), "ts", dt.timedelta(days=7))).count() == 0


def test_sessions_stream_equals_batch(spark, tmp_path):
    rng = random.Random(12)
    t0 = dt.datetime(2024, 1, 1)
    rows = sorted(
        ((k, t0 + dt.timedelta(seconds=s)) for k in (1, 2, 3) for s in rng.sample(range(900), 120)),
        key=lambda r: r[1],
    )
    path = write_files(spark, rows, "k bigint, ts timestamp", str(tmp_path), 3)
    gap = dt.timedelta(seconds=10)
    stream = sessions_stream(
        read_stream(spark, path, "k bigint, ts timestamp"), ["k"], "ts", gap, dt.timedelta(0)
    )
    got = run_to_parquet(stream).drop("batch_id").collect()
    batch = sessions(
        spark.createDataFrame(rows, "k bigint, ts timestamp"), ["k"], "ts", gap, cuts=None
    )
    closed = batch.filter(F.col("session_end") + F.lit(gap) <= F.lit(rows[-1][1])).collect()
    assert len(closed) > 50
    assert sorted(map(tuple, got)) == sorted(map(tuple, closed))


def test_ttl_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    s = dt.timedelta(seconds=1)
    rows = [
        (1, t0, 0, "a"), (2, t0 + s, 1, "b"), (1, t0 + 4 * s, 2, "c"),
        (2, t0 + 7 * s, 3, None), (3, t0 + 20 * s, 4, "z"),
    ]
    schema = "k bigint, ts timestamp, seq bigint, v string"
    path = write_files(spark, rows, schema, str(tmp_path), 5)
    stream = ttl_stream(
        read_stream(spark, path, schema), ["k"], ["ts", "seq"], F.col("v"), 5 * s, lateness=0 * s
    )
    got = run_to_parquet(stream, "update")
    got = [(r.k, r.value, r.written_at, r.live) for r in got.orderBy("batch_id").collect()]
    assert sorted(got, key=repr) == sorted([
        (1, "a", t0, True), (2, "b", t0 + s, True), (1, "c", t0 + 4 * s, True),
        (2, None, t0 + 7 * s, True), (3, "z", t0 + 20 * s, True),
        (2, "b", t0 + s, False), (1, "c", t0 + 4 * s, False), (2, None, t0 + 7 * s, False),
    ], key=repr)


def test_not_found_stream(spark, tmp_path):
    rng = random.Random(13)
    rows = [(rng.choice(["/", "/a", "/b", "/gone"]),) for _ in range(200)]
    routes = spark.createDataFrame([(0, "/"), (1, "/a"), (2, "*")], "priority int, path string")
    path = write_files(spark, rows, "path string", str(tmp_path), 3)
    stream = not_found_stream(read_stream(spark, path, "path string"), routes)
    got = run_to_parquet(stream, "complete")
    last = got.filter(F.col("batch_id") == got.agg(F.max("batch_id")).first()[0]).drop("batch_id")
    want = not_found(spark.createDataFrame(rows, "path string"), routes)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_fan_out_delivers_the_same_batches(spark, tmp_path):
    rows = [(i,) for i in range(90)]
    path = write_files(spark, rows, "n bigint", str(tmp_path), 3)
    seen = []
    out = FanOut()
    out.subscribe("a", parquet_sink(f"{tmp_path}/a"))
    out.subscribe("note", lambda batch, n: (seen.append(n), out.unsubscribe("b") if n == 1 else None))
    out.subscribe("b", parquet_sink(f"{tmp_path}/b"))
    fan_out(
        read_stream(spark, path, "n bigint"), out, f"{tmp_path}/state", availableNow=True
    ).awaitTermination()
    a, b = (spark.read.parquet(f"{tmp_path}/{s}") for s in "ab")
    assert seen == [0, 1, 2]
    assert sorted(r.n for r in a.collect()) == list(range(90))
    assert sorted(r.n for r in b.collect()) == sorted(
        r.n for r in a.filter("batch_id < 2").collect()
    )


def test_redelivered_batch_replaces_itself(spark, tmp_path):
    sink = parquet_sink(f"{tmp_path}/out")
    for n in (0, 1, 1):
        sink(spark.range(n * 10, n * 10 + 10), n)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(20))


def batches_of(spark, tmp_path, batches, **options):
    replays = ReplayBatches(
        f"{tmp_path}/slots", parquet_sink(f"{tmp_path}/out"), k=1, delay=DELAY, lateness=dt.timedelta(0),
        cuts=None, **options,
    )
    for i, rows in enumerate(batches):
        replays(spark.createDataFrame(rows, STREAM_SCHEMA), i)
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    return sorted((r.id, r.removed_at, r.cause) for r in found)


def test_actions_at_the_mark_are_kept(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    add = lambda s, seq, name: (1, at(s), seq, "ADD", name, {})
    got = batches_of(
        spark, tmp_path, [[add(0, 1, "a"), add(5, 2, "b")], [add(5, 3, "c"), add(10, 4, "d")], [add(20, 5, "e")]]
    )
    assert got == [("a", at(5), "evict"), ("b", at(5), "evict"), ("c", at(10), "evict")]


def test_large_sequence_numbers(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    big = 1 << 62
    rows = [(1, at(i), big + i, "ADD", f"r{i}", {}) for i in range(3)]
    assert batches_of(spark, tmp_path, [rows[:2], rows[2:], [(1, at(9), big, "ADD", "x", {})]]) == [
        ("r0", at(1), "evict"), ("r1", at(2), "evict"),
    ]


def test_one_rule_for_open(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows, want = [], {}
    for i, (text, flag) in enumerate([("true", True), ("TRUE", True), ("1", True), ("maybe", None), (None, None), ("no", False)]):
        rows += [
            (i, at(0), 1, "ADD", "a", {}), (i, at(1), 2, "UPDATE", "a", {"open": text}), (i, at(2), 3, "REMOVE", "a", {}),
        ]
        want[i] = flag
    df = spark.createDataFrame(rows, STREAM_SCHEMA)
    for k in (1, 2):
        assert {r.store_key: r.open for r in replay(df, k=k, delay=DELAY, cuts=None).collect()} == want
    late = [(99, at(60), 9, "ADD", "z", {})]
    path = write_files(spark, rows + late, STREAM_SCHEMA, str(tmp_path), 2)
    stream = replay_stream(
        read_stream(spark, path, STREAM_SCHEMA), k=1, delay=DELAY, lateness=dt.timedelta(seconds=30)
    )
    assert {r.store_key: r.open for r in run_to_parquet(stream).collect()} == want


def hover_log(rng, n):
    """(user_id, ts, seq, kind, label, has_mega, value), with equal times, in order."""
    at, rows = dt.datetime(2024, 1, 1), []
    for seq in range(n):
        at += dt.timedelta(milliseconds=rng.choice([0, 1, 50, 149, 150, 151, 400]))
        rows.append((
            rng.choice([1, 1, 1, 2, None]), at, seq, rng.choice(["enter", "leave", "toggle", "set"]),
            rng.choice(["a", "b", None]), rng.choice([True, True, False, None]), rng.choice([True, False, None]),
        ))
    return rows


HOVER = "user_id long, ts timestamp, seq long, kind string, label string, has_mega boolean, value boolean"
KEY, BY = ["user_id"], ["ts", "seq"]


def ordered_forms(df, streamed):
    """Each operator over the same log, as a stream or in batch: (rows, the column that tells when)."""
    clicks = df.filter(F.col("kind").isin("toggle", "set"))
    late = {"lateness": dt.timedelta(seconds=2)}
    first = F.col("user_id") == 1
    if streamed:
        return [
            hover_stream(df, KEY, BY, **late),
            changes_stream(df, KEY, BY, F.col("label"), **late),
            toggle_stream(clicks, KEY, BY, first, **late),
        ]
    return [
        (hover_intervals(df, KEY, BY), "closed_at"),
        (changes_only(df, KEY, BY, F.col("label")).select(*KEY, *BY, "changed_to"), "ts"),
        (toggle_state(clicks, KEY, BY, first).select(*KEY, *BY, "is_open"), "ts"),
    ]


@pytest.mark.parametrize("form", [0, 1, 2])
def test_ordered_streams_equal_batch(spark, tmp_path, form):
    """Rows that arrive out of order and too late, in files before and after a restart."""
    rng = random.Random(form)
    rows = hover_log(rng, 400)
    jitter = {r[2]: r[1] + dt.timedelta(milliseconds=rng.uniform(0, 1900)) for r in rows}
    arrived = sorted(rows, key=lambda r: jitter[r[2]])
    end = dt.datetime(2024, 1, 2)
    # The last two rows move the watermark past all others, and one comes an hour too late.
    flush = [(9, end, 900, "toggle", "z", True, None), (1, end - dt.timedelta(hours=1), 901, "enter", "late", True, None)]
    done = spark.createDataFrame([*rows, flush[0]], HOVER)
    want, when = ordered_forms(done, False)[form]
    want = want.filter(F.col(when) < end)
    base = str(tmp_path)
    path = write_files(spark, [*arrived[:250]], HOVER, base, 3)
    for extra in (None, arrived[250:], flush[:1], flush[1:]):  # each is a new run of the query
        if extra:
            seen = set(os.listdir(path))
            spark.createDataFrame(extra, HOVER).coalesce(1).write.mode("append").parquet(path)
            for name in set(os.listdir(path)) - seen:
                os.utime(f"{path}/{name}", (1_500_000_000 + extra[0][2],) * 2)
        stream = ordered_forms(read_stream(spark, path, HOVER), True)[form]
        query = fan_out(stream, {"out": parquet_sink(f"{base}/out")}, f"{base}/state", availableNow=True)
        query.awaitTermination()
    got = spark.read.parquet(f"{base}/out").filter(F.col(when) < end).select(*want.columns)
    got, want = [sorted(map(repr, map(tuple, x.collect()))) for x in (got, want)]
    assert len(want) > 30 and got == want


def test_ordered_streams_of_nothing(spark, tmp_path):
    path = write_files(spark, [(1, None, 1, "enter", "a", True, True)], HOVER, str(tmp_path), 1)
    for stream in ordered_forms(read_stream(spark, path, HOVER), True):
        assert run_to_parquet(stream).count() == 0


def test_ids_go_on_over_batches(spark, tmp_path):
    rows = [(n, f"t{n}") for n in random.Random(3).sample(range(1000), 60)]
    parts = [sorted(rows)[:25], [], sorted(rows)[25:26], sorted(rows)[26:]]
    sink = NumberedBatches(f"{tmp_path}/ledger", parquet_sink(f"{tmp_path}/out"), ["n"])
    for batch_id in (0, 0, 1, 2, 2, 3, 1):  # some are delivered again, one after later ones
        sink(spark.createDataFrame(parts[batch_id], "n long, t string").repartition(3), batch_id)
    got = {r.n: r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {n: str(i) for i, (n, _) in enumerate(sorted(rows), 1)}
    # A new checkpoint counts batches anew; a gap finds the last line.
    sink(spark.createDataFrame([(2000, "x")], "n long, t string"), 9)
    assert spark.read.parquet(f"{tmp_path}/out/batch_id=9").first().id == "61"


def test_readers_see_whole_batches(spark, tmp_path):
    fail = []

    def odd(batch):
        if fail:
            raise RuntimeError("the sink is away")
        return batch.filter("n % 2 = 1")

    both = Snapshots(f"{tmp_path}/s", {"all": lambda b: b, "odd": odd})
    read = lambda name, upto=None: sorted(r.n for r in both.read(spark, name, "n long", upto).collect())
    assert read("all") == [] and both.newest(spark) is None
    batches = [spark.range(i * 4, i * 4 + 4).toDF("n") for i in range(3)]
    both(batches[0], 0)
    fail.append(1)
    with pytest.raises(RuntimeError):
        both(batches[1], 1)
    assert read("all") == [0, 1, 2, 3] and read("odd") == [1, 3] and both.newest(spark) == 0
    fail.clear()
    both(batches[1], 1)
    both(batches[2], 1)  # delivered again: what counts stays as it was read
    both(batches[2], 2)
    assert read("all") == list(range(12)) and read("odd") == [1, 3, 5, 7, 9, 11]
    assert read("all", 1) == list(range(8)) and both.newest(spark) == 2


def test_not_found_windows_and_sketches(spark, tmp_path):
    rng = random.Random(6)
    t0, hour = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    rows = [(t0 + hour * rng.uniform(0, 5), rng.choice(["/hot", "/hot", "/a", "/b", "/known", None])) for _ in range(600)]
    rows = sorted(rows, key=lambda r: r[0]) + [(t0 + 10 * hour, "/end")]
    path = write_files(spark, rows, "ts timestamp, path string", str(tmp_path), 4)
    routes = spark.createDataFrame([("*",), ("/known",)], "path string")
    read = lambda: read_stream(spark, path, "ts timestamp, path string")
    got = run_to_parquet(not_found_windows(read(), routes, "ts", hour, lateness=hour)).collect()
    want = {}
    for ts, p in rows[:-1]:
        if p != "/known":
            want[ts.hour, p] = want.get((ts.hour, p), 0) + 1
    assert {(r.window_start.hour, r.path): r.n_accesses for r in got} == want and len(got) == len(want)
    sketches = run_to_parquet(not_found_sketches(read(), routes, "ts", hour, 100, lateness=hour))
    assert sum(r.n_accesses for r in sketches.collect()) == sum(want.values())
    top = top_not_found(sketches, 1, ["window_start"], 100).collect()
    assert {(r.window_start.hour, r.path): r.n_accesses for r in top} == {k: n for k, n in want.items() if k[1] == "/hot"}
    top = {r.path: r.n_accesses for r in top_not_found(sketches, 3, tracked=100).collect() if r.path}
    assert {p: n for p, n in top.items()} == {
        p: sum(n for (_, x), n in want.items() if x == p) for p in top
    } and "/hot" in top


def test_sketches_stay_small(spark, tmp_path):
    """However many different paths come, a window is one sketch that still finds the frequent one."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(seconds=i % 3000), "/hot" if i % 4 == 0 else f"/random/{i}") for i in range(6000)]
    rows.append((t0 + dt.timedelta(hours=9), "/end"))
    path = write_files(spark, rows, "ts timestamp, path string", str(tmp_path), 3)
    routes = spark.createDataFrame([("*",)], "path string")
    stream = not_found_sketches(
        read_stream(spark, path, "ts timestamp, path string"), routes, "ts", dt.timedelta(hours=1), 64,
        lateness=dt.timedelta(hours=8),
    )
    sketches = run_to_parquet(stream)
    assert sketches.count() == 1 and sketches.first().n_accesses == 6000
    best = top_not_found(sketches, 1, tracked=64).first()
    assert best.path == "/hot" and abs(best.n_accesses - 1500) <= 6000 / 64 * 4


def test_state_written_follows_the_batch(spark, tmp_path):
    """A batch writes the buckets of its own stores and of those that come due, and no others."""
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    add = lambda store, s, seq: (store, at(s), seq, "ADD", f"r{seq}", {})
    stores = range(100)
    batches = [
        [add(n, 0, n) for n in stores] + [(5, at(1), 900, "DISMISS", None, None)] + [add(0, 2, 901)],
        [add(7, 3, 902)],  # the first batch's last action no longer waits, either
        [add(7, 4, 903)],
        [add(8, 4 + DELAY.total_seconds(), 904)],  # now the dismissed row of store 5 goes
    ]
    replays = ReplayBatches(
        f"{tmp_path}/state", parquet_sink(f"{tmp_path}/out"), k=1, delay=DELAY, lateness=dt.timedelta(0),
        buckets=4096, cuts=None,
    )
    written, before = [], set()
    for i, rows in enumerate(batches):
        for _ in range(2):  # each is delivered again
            replays(spark.createDataFrame(rows, STREAM_SCHEMA), i)
        files = {
            f"{folder}/{name}" for folder, _, names in os.walk(f"{tmp_path}/state/state")
            for name in names if name.endswith(".parquet")
        }
        written.append(len({f.split("/bucket=")[1].split("/")[0] for f in files - before}))
        before = files
    assert written[0] > 90 and all(n <= 6 for n in written[1:])
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.store_key, r.id, r.cause) for r in got) == [
        (0, "r0", "evict"), (5, "r5", "expiry"), (7, "r7", "evict"), (7, "r902", "evict"),
    ]
