"""Replay of an action stream batch by batch, for stores that get a large share of the actions.

`replay_stream` handles a store's actions of one micro-batch in one task. Here each micro-batch runs
the batch replay instead, which cuts heavy stores into chunks. What a store has to remember is
written down as a short action log (the rows still stored, added, dismissed and updated again) and is
put in front of the next batch.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from siteops.operators.replay import replay_with_timers
from siteops.operators.state import REMOVE_DELAY, STORE_LIMIT
from siteops.sources.tables import read_if_there
from siteops.streaming.fanout import Sink


class ReplayBatches:
    """Sink for a stream of actions that passes on the fate of every row that left its store.

    The watermark is the largest time seen minus `lateness`; actions before it are dropped. Those at the
    watermark wait, as more of the same time may follow.

    `folder` keeps the state of stores in `buckets` groups by a hash of their keys. A batch reads and
    writes the buckets of stores that have new actions, and those where a waiting action or a timer has
    come due; the others are left alone, so with many buckets the work follows the batch and not the
    number of stores. A bucket has two slots that are written in turn, and so has the manifest, which says
    for each bucket which slot counts and when it is next due. So a batch that is delivered again finds
    what it read before.
    """

    def __init__(
        self,
        folder: str,
        sink: Sink,
        keys: Sequence[str] = ("store_key",),
        k: int = STORE_LIMIT,
        delay: dt.timedelta = REMOVE_DELAY,
        fields: Sequence[str] = (),
        *,
        lateness: dt.timedelta,
        buckets: int = 256,
        **options,
    ):
        self.folder, self.sink, self.keys, self.k, self.buckets = folder, sink, list(keys), k, buckets
        self.delay, self.fields, self.lateness, self.options = delay, list(fields), lateness, options

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")
        columns = [*self.keys, "ts", "seq", "kind", "id", "patch"]
        log = batch.withColumn("seq", F.col("seq").cast("bigint")).select(*columns)
        before, known = self._manifest(spark, batch_id - 1)
        newest = batch.agg(F.max("ts")).first()[0]
        mark = max((m for m in (before, newest and newest - self.lateness) if m), default=None)
        if mark is None:
            return
        time = log.schema["ts"].dataType
        if before is not None:
            log = log.filter(F.col("ts") >= F.lit(before).cast(time))
        reached = {r["bucket"] for r in log.select(bucket).distinct().collect()}
        reached |= {b for b, (_, wakes) in known.items() if wakes is not None and wakes <= mark}
        log = self._stored(spark, log, {b: known[b][0] for b in reached if b in known})
        upto = F.lit(mark).cast(time)
        fates = replay_with_timers(
            log.filter(F.col("ts") < upto), self.keys, self.k, self.delay, self.fields, **self.options
        )
        fates.persist()
        try:
            gone = F.coalesce(F.col("removed_at") <= upto, F.lit(False))
            self.sink(fates.filter(gone).drop("added_seq", "dismissed_at"), batch_id)
            left, waiting = fates.filter(~gone), log.filter(F.col("ts") >= upto)
            state = self._restated(left).select(*columns).unionByName(waiting)
            other = {b: 1 - known[b][0] for b in reached if b in known}
            slots = F.from_json(F.lit(json.dumps(other)), "map<string,int>")
            (
                state.select("*", bucket).withColumn(
                    "slot", F.coalesce(F.try_element_at(slots, F.col("bucket").cast("string")), F.lit(0))
                ).repartition("bucket")
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("bucket", "slot").parquet(f"{self.folder}/state")
            )
            wakes = left.select(bucket, (F.col("dismissed_at") + F.lit(self.delay)).alias("wakes")).unionByName(
                waiting.select(bucket, F.col("ts").alias("wakes"))
            )
            now = {r["bucket"]: r["wakes"] for r in wakes.groupBy("bucket").agg(F.min("wakes").alias("wakes")).collect()}
        finally:
            fates.unpersist()
        kept = {b: line for b, line in known.items() if b not in reached}
        kept |= {b: (1 - known[b][0] if b in known else 0, at) for b, at in now.items()}
        rows = [(b, slot, at, None) for b, (slot, at) in kept.items()] + [(None, None, None, mark)]
        lines = spark.createDataFrame(rows, "bucket int, slot int, wakes timestamp, mark timestamp")
        lines.coalesce(1).write.mode("overwrite").parquet(self._lines(batch_id))

    def _lines(self, batch_id: int) -> str:
        return f"{self.folder}/manifest/slot={batch_id % 2}"

    def _manifest(self, spark, batch_id: int) -> tuple[dt.datetime | None, dict[int, tuple]]:
        """The watermark after batch `batch_id`, and the slot and next due time of each bucket that has rows."""
        lines = read_if_there(spark, self._lines(batch_id), "bucket int, slot int, wakes timestamp, mark timestamp")
        if lines is None:
            return None, {}
        rows = lines.collect()  # one for each bucket
        mark = max((r["mark"] for r in rows if r["mark"] is not None), default=None)
        return mark, {r["bucket"]: (r["slot"], r["wakes"]) for r in rows if r["bucket"] is not None}

    def _stored(self, spark, log: DataFrame, slots: dict[int, int]) -> DataFrame:
        """The state of some buckets, followed by the new actions."""
        if not slots:
            return log
        paths = [f"{self.folder}/state/bucket={b}/slot={s}" for b, s in sorted(slots.items())]
        return spark.read.schema(log.schema).parquet(*paths).unionByName(log)

    def _restated(self, stored: DataFrame) -> DataFrame:
        """Stored rows as actions: added with their fields, dismissed, and reopened or closed.

        The places after an ADD may coincide with those of other rows' actions, which don't touch it.
        """
        pairs = [x for f in self.fields for x in (F.lit(f), F.col(f))]
        none = F.lit(None).cast("map<string,string>")
        fields = F.create_map(*pairs) if pairs else none
        is_dismissed = F.col("dismissed_at").isNotNull()
        flag = F.create_map(F.lit("open"), F.col("open").cast("string"))
        steps = [  # kind, time, place, patch, when
            ("ADD", F.col("added_at"), 0, fields, F.lit(True)),
            ("DISMISS", F.col("dismissed_at"), 1, none, is_dismissed),
            (
                "UPDATE", F.coalesce("dismissed_at", "added_at"), 2, flag,
                ~F.col("open").eqNullSafe(~is_dismissed),
            ),
        ]
        actions = F.array(*[
            F.when(
                needed,
                F.struct(
                    ts.alias("ts"), (F.col("added_seq") + place).alias("seq"),
                    F.lit(kind).alias("kind"), patch.alias("patch"),
                ),
            )
            for kind, ts, place, patch, needed in steps
        ])
        return stored.select(*self.keys, "id", F.explode(F.array_compact(actions)).alias("a")).select(
            *self.keys, "a.ts", "a.seq", "a.kind", "id", "a.patch"
        )
