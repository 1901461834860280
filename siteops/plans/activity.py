"""The event table read as notification actions, hovers and toggles, and the jobs over them."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siteops import functions as fx
from siteops.operators import interaction, state
from siteops.operators.replay import replay
from siteops.operators.storage import shared_folder
from siteops.operators.timeline import Timeline, find_cuts
from siteops.sources import prepare_streams, read_table, stream_table, with_utc_time
from siteops.streaming import (
    FanOut,
    NumberedBatches,
    ReplayBatches,
    Snapshots,
    changes_stream,
    fan_out,
    hover_stream,
    not_found_windows,
    parquet_sink,
    replay_stream,
    run_to_parquet,
    sessions_stream,
    toggle_stream,
    ttl_stream,
)

USER = ["user_id"]
ORDER = ["ts", "seq"]
DAY = dt.timedelta(days=1)
HOUR = dt.timedelta(hours=1)
# Rows per chunk in the `_cut` jobs, small enough that the cutting itself is exercised.
CUT_ROWS = 20

KINDS = {
    "signup": "ADD", "view": "UPDATE", "click": "DISMISS", "error": "DISMISS", "purchase": "REMOVE"
}


def events(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").withColumnRenamed("event_id", "seq")


def _kind() -> Column:
    return F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]


def _is(event_type: str) -> Column:
    return F.col("event_type") == event_type


def _patch() -> Column:
    """New rows get a note; a view replaces it, with null when its value is small, or reopens."""
    view = F.create_map(F.lit("note"), F.when(F.col("value") >= 5, F.col("props")))
    reopen = F.create_map(F.lit("open"), F.lit("true"))
    return (
        F.when(_is("signup"), F.create_map(F.lit("note"), F.lit("new")))
        .when(_is("view") & (F.col("value") > 30), reopen)
        .when(_is("view"), view)
    )


def actions(df: DataFrame, cuts) -> DataFrame:
    """Events as actions of the user's store. Actions by id concern the row that was added last."""
    line = Timeline(df, USER, ORDER, cuts).add(last={"newest": F.when(_is("signup"), F.col("seq"))})
    one = F.coalesce(F.col("newest").cast("string"), F.lit("none"))
    # The chunk stays with the rows, so that a replay finds them in place.
    return line.df.select(
        *line.parts, "ts", "seq", _kind().alias("kind"),
        F.when(_is("error"), F.lit(None)).otherwise(one).alias("id"), _patch().alias("patch"),
    )


def _replay(spark: SparkSession, folder: str, k: int, **cutting) -> DataFrame:
    df = events(spark, folder)
    cuts = find_cuts(df, USER, "ts", then="seq", **cutting)
    return replay(actions(df, cuts), USER, k, DAY, ["note"], cuts)


def replay_limit_1(spark, folder):
    return _replay(spark, folder, 1)


def replay_limit_1_cut(spark, folder):
    return _replay(spark, folder, 1, chunk_rows=CUT_ROWS)


def replay_limit_3(spark, folder):
    return _replay(spark, folder, 3)


def replay_limit_3_cut(spark, folder):
    return _replay(spark, folder, 3, chunk_rows=CUT_ROWS)


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    prepare_streams(spark)
    stream = stream_table(spark, f"{folder}/event*.parquet", "events", times=("ts",))
    return stream.withColumnRenamed("event_id", "seq")


def _action_stream(spark: SparkSession, folder: str) -> DataFrame:
    """At one row per store, acting on the newest row and acting on all rows are the same."""
    own = F.when(_is("signup") | _is("view"), F.col("seq").cast("string"))
    return _event_stream(spark, folder).select(
        "user_id", "ts", "seq", _kind().alias("kind"), own.alias("id"), _patch().alias("patch")
    )


def _fate_stream(spark: SparkSession, folder: str) -> DataFrame:
    return replay_stream(_action_stream(spark, folder), USER, 1, DAY, lateness=dt.timedelta(0))


def _plain_times(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def replay_as_stream(spark, folder):
    out = run_to_parquet(_fate_stream(spark, folder)).select(
        "user_id", "id", "added_at", "removed_at", "cause"
    )
    return _plain_times(out, "added_at", "removed_at")


WEEK = dt.timedelta(days=7)


# Rows for which another task helps to write a step.
FILE_ROWS = 100_000


def _arriving(df: DataFrame, ts: str, step: dt.timedelta) -> DataFrame:
    """The rows as a stream, one batch for each step of their times that has any, in order.

    All tasks share in writing a large step. Every step has the same number of files, empty ones where
    it has fewer rows or tasks, as a batch is a number of files.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    width = step // dt.timedelta(microseconds=1)
    rows = df.withColumn("_step", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / width))
    # Computed once, whatever the number of steps.
    rows.filter("_step IS NOT NULL").write.parquet(f"{folder}-rows")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}-rows")
    steps = rows.groupBy("_step").count().orderBy("_step").collect()
    largest = max((r["count"] for r in steps), default=0)
    files = min(spark.sparkContext.defaultParallelism, 1 + largest // FILE_ROWS)
    empty = df.limit(0)
    for n in range(0 if steps else files):
        empty.write.parquet(f"{folder}/empty-{n}")
    for r in steps:
        target = f"{folder}/{r['_step'] + (1 << 62)}"
        rows.filter(F.col("_step") == r["_step"]).drop("_step").coalesce(files).write.parquet(target)
        for n in range(len(spark.read.schema(df.schema).parquet(target).inputFiles()), files):
            empty.write.parquet(f"{target}-{n}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/*")


def replay_limit_3_as_stream(spark, folder):
    """Three rows per store, with fields, actions by id and several batches of late actions."""
    prepare_streams(spark)
    df = events(spark, folder)
    log = actions(df, find_cuts(df, USER, "ts", then="seq"))
    log = log.select("user_id", "ts", "seq", "kind", "id", "patch")
    stream = with_utc_time(_arriving(log, "ts", WEEK), "ts")
    fates = replay_stream(stream, USER, 3, DAY, ["note"], lateness=WEEK + DAY)
    return _plain_times(run_to_parquet(fates).drop("batch_id"), "added_at", "removed_at")


def replay_in_batches(spark, folder):
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    replays = ReplayBatches(f"{base}/slots", parquet_sink(f"{base}/out"), USER, 1, DAY, lateness=dt.timedelta(0))
    stream = _action_stream(spark, folder)
    fan_out(stream, {"replay": replays}, f"{base}/state", availableNow=True).awaitTermination()
    out = spark.read.parquet(f"{base}/out").select("user_id", "id", "added_at", "removed_at", "cause")
    return _plain_times(out, "added_at", "removed_at")


def fan_out_twice(spark, folder):
    """Two sinks of one stream: every removal once in each, counted by sink and cause."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    sinks = FanOut({"first": parquet_sink(f"{base}/first"), "second": parquet_sink(f"{base}/second")})
    stream = _fate_stream(spark, folder)
    fan_out(stream, sinks, f"{base}/state", availableNow=True).awaitTermination()
    both = [
        spark.read.parquet(f"{base}/{s}").withColumn("sink", F.lit(s)) for s in ("first", "second")
    ]
    return both[0].unionByName(both[1]).groupBy("sink", "cause").agg(
        F.count("*").alias("n_rows"), F.countDistinct("user_id", "id").alias("n_ids")
    )


def latest_event(spark, folder):
    return state.latest_k(events(spark, folder), USER, ORDER).drop("pos")


def latest_three(spark, folder):
    return state.latest_k(events(spark, folder), USER, ORDER, 3)


def running_value(spark, folder):
    value = {"last_viewed": F.when(_is("view"), F.col("value"))}
    out = state.running_fields(events(spark, folder), USER, ORDER, value)
    return out.select("user_id", "ts", "seq", "last_viewed")


def merged_profiles(spark, folder):
    """Users who signed up, with fields patched by their views and purchases."""
    df = events(spark, folder)
    base = (
        df.filter(_is("signup"))
        .groupBy("user_id")
        .agg(F.min("ts").alias("since"))
        .select("user_id", "since", F.lit("new").alias("note"), F.lit(-1.0).alias("spent"))
    )
    patch = F.when(
        _is("view"), F.create_map(F.lit("note"), F.when(F.col("value") >= 5, F.col("props")))
    ).when(_is("purchase"), F.create_map(F.lit("spent"), F.col("value").cast("string")))
    patches = df.filter(F.col("event_type").isin("view", "purchase")).withColumn("patch", patch)
    return state.apply_patches(base, patches, USER, ORDER, ["note", "spent"])


def _added(df: DataFrame) -> DataFrame:
    return df.filter(_is("signup")).select(
        "user_id", F.col("seq").cast("string").alias("id"), "ts", "seq", F.lit(True).alias("open")
    )


def dismissed_rows(spark, folder):
    df = events(spark, folder)
    return state.dismiss(_added(df), actions(df, find_cuts(df, USER, "ts", then="seq")), USER, ORDER)


def remaining_rows(spark, folder):
    """Purchases remove the newest row, errors clear the store."""
    df = events(spark, folder)
    log = actions(df, find_cuts(df, USER, "ts", then="seq"))
    clears = log.withColumn("kind", F.when(F.col("id").isNull(), "REMOVE").otherwise(F.col("kind")))
    return state.remove(_added(df), clears, USER, ORDER)


def expiry_times(spark, folder):
    clicks = events(spark, folder).filter(_is("click"))
    return state.expire_after(clicks, USER, "ts")


def numbered_events(spark, folder):
    out = state.assign_ids(events(spark, folder).select("ts", "seq", "user_id"), ORDER)
    return out.select("seq", "id")


def numbered_as_stream(spark, folder):
    """Ids over arriving batches, a week of events each; the first batch is delivered twice."""
    prepare_streams(spark)
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    df = events(spark, folder).select("ts", "seq", "user_id")
    numbered = NumberedBatches(f"{base}/ledger", parquet_sink(f"{base}/out"), ORDER)

    def deliver(batch: DataFrame, batch_id: int) -> None:
        for _ in range(2 if batch_id == 0 else 1):
            numbered(batch, batch_id)

    fan_out(_arriving(df, "ts", WEEK), deliver, f"{base}/state", availableNow=True).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("seq", "id")


def snapshots_of_removals(spark, folder):
    """Two outputs of one stream as readers see them: removals by id, and counts by cause of each batch."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    both = Snapshots(
        base,
        {
            "rows": lambda b: b.select("user_id", "id", "cause"),
            "causes": lambda b: b.groupBy("cause").agg(F.count("*").alias("n")),
        },
    )
    fan_out(_fate_stream(spark, folder), both, f"{base}/state", availableNow=True).awaitTermination()
    last = both.newest(spark)
    rows = both.read(spark, "rows", "user_id bigint, id string, cause string", last)
    causes = both.read(spark, "causes", "cause string, n bigint", last)
    return rows.groupBy("cause").agg(F.count("*").alias("n_rows")).join(
        causes.groupBy("cause").agg(F.sum("n").alias("n_counted")), "cause"
    )


def _accesses(df: DataFrame) -> DataFrame:
    """Events as accesses to paths, which views and clicks of some users have routes for."""
    return df.select("ts", F.concat_ws("/", F.lit(""), "event_type", F.col("user_id") % 20).alias("path"))


def unrouted_windows_as_stream(spark, folder):
    """Accesses without a route by day, from arriving events."""
    routes = _accesses(events(spark, folder).filter(_is("view") | (_is("click") & (F.col("user_id") % 20 < 9))))
    stream = _accesses(_event_stream(spark, folder))
    counts = not_found_windows(stream, routes.select("path").distinct(), "ts", DAY, lateness=dt.timedelta(0))
    return _plain_times(run_to_parquet(counts).drop("batch_id"), "window_start", "window_end")


def hourly_sessions(spark, folder):
    return interaction.sessions(events(spark, folder), USER, "ts", HOUR)


def hourly_sessions_cut(spark, folder):
    return interaction.sessions(events(spark, folder), USER, "ts", HOUR, chunk_rows=CUT_ROWS)


def sessions_as_stream(spark, folder):
    stream = sessions_stream(
        _event_stream(spark, folder), USER, "ts", 6 * HOUR, dt.timedelta(0)
    )
    out = run_to_parquet(stream).drop("batch_id")
    return _plain_times(out, "session_start", "session_end")


def _hovers(df: DataFrame) -> DataFrame:
    """Signups, views and purchases enter an item, purchases one without a menu; the rest leave."""
    enters = F.col("event_type").isin("signup", "view", "purchase")
    return df.select(
        "user_id", "ts", "seq", F.when(enters, "enter").otherwise("leave").alias("kind"),
        F.col("event_type").alias("label"), F.when(~_is("purchase"), True).alias("has_mega"),
    )


def menu_intervals(spark, folder):
    hovers = _hovers(events(spark, folder))
    return interaction.hover_intervals(hovers, USER, ORDER, 6 * HOUR)


def menu_intervals_cut(spark, folder):
    hovers = _hovers(events(spark, folder))
    return interaction.hover_intervals(hovers, USER, ORDER, 6 * HOUR, chunk_rows=CUT_ROWS)


def menu_intervals_as_stream(spark, folder):
    stream = hover_stream(
        _hovers(_event_stream(spark, folder)), USER, ORDER, 6 * HOUR, lateness=dt.timedelta(0)
    )
    return _plain_times(run_to_parquet(stream).drop("batch_id"), "opened_at", "closed_at")


def threshold_changes(spark, folder):
    out = interaction.changes_only(
        events(spark, folder), USER, ORDER, F.col("value") < 76.8, "is_low"
    )
    return out.select("user_id", "ts", "seq", "is_low")


def threshold_changes_cut(spark, folder):
    out = interaction.changes_only(
        events(spark, folder), USER, ORDER, F.col("value") < 76.8, "is_low",
        chunk_rows=CUT_ROWS,
    )
    return out.select("user_id", "ts", "seq", "is_low")


def threshold_changes_as_stream(spark, folder):
    stream = changes_stream(
        _event_stream(spark, folder), USER, ORDER, F.col("value") < 76.8, "is_low",
        lateness=dt.timedelta(0),
    )
    return _plain_times(run_to_parquet(stream).drop("batch_id"), "ts")


def _toggles(df: DataFrame) -> DataFrame:
    """Clicks toggle and errors set; large values come from the desktop."""
    return df.filter(F.col("event_type").isin("click", "error")).select(
        "user_id", "ts", "seq",
        F.when(F.col("value") >= 12, "desktop").otherwise("mobile").alias("device"),
        F.when(_is("click"), "toggle").otherwise("set").alias("kind"),
        F.when(_is("error"), F.col("value") > 20).alias("value"),
    )


def _toggle_state(spark, folder, **options):
    return interaction.toggle_state(
        _toggles(events(spark, folder)), ["user_id", "device"], ORDER, F.col("device") == "desktop",
        **options,
    ).select("user_id", "device", "ts", "seq", "is_open")


def panel_state(spark, folder):
    return _toggle_state(spark, folder)


def panel_state_cut(spark, folder):
    return _toggle_state(spark, folder, chunk_rows=CUT_ROWS)


def panel_state_as_stream(spark, folder):
    stream = toggle_stream(
        _toggles(_event_stream(spark, folder)), ["user_id", "device"], ORDER,
        F.col("device") == "desktop", lateness=dt.timedelta(0),
    )
    return _plain_times(run_to_parquet(stream).drop("batch_id"), "ts")


def _newest_time(spark: SparkSession, folder: str) -> Column:
    return events(spark, folder).select(F.max("ts")).scalar()


def panel_cookies(spark, folder):
    """The stored panel state of each user: desktop writes only, kept for seven days."""
    panels = _toggle_state(spark, folder).filter(F.col("device") == "desktop")
    as_of = _newest_time(spark, folder)
    latest = interaction.ttl_latest(panels, USER, ORDER, F.col("is_open"), as_of)
    return latest.select(
        "user_id", fx.cookie_text("panel", F.col("value"), 604800).alias("cookie"), "expires_at"
    )


def unexpired_values(spark, folder):
    as_of = _newest_time(spark, folder)
    return interaction.ttl_latest(
        events(spark, folder), ["user_id", "event_type"], ORDER, F.col("value"), as_of
    )


def values_with_ttl_as_stream(spark, folder):
    stream = ttl_stream(
        _event_stream(spark, folder), ["user_id", "event_type"], ORDER, F.col("props"), 2 * DAY,
        lateness=dt.timedelta(0),
    )
    out = run_to_parquet(stream, "update").drop("batch_id")
    return _plain_times(out, "written_at", "expires_at")
