"""Delivery of each micro-batch to several sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from siteops.operators.storage import shared_folder
from siteops.sources.tables import read_if_there

Sink = Callable[[DataFrame, int], None]


class FanOut:
    """Sinks in the order they subscribed. Each batch reaches all of them, computed once."""

    def __init__(self, sinks: Mapping[str, Sink] | None = None):
        self._sinks: dict[str, Sink] = dict(sinks or {})

    def subscribe(self, name: str, sink: Sink) -> None:
        self._sinks[name] = sink

    def unsubscribe(self, name: str) -> None:
        """Takes effect with the next batch; an unknown name is ignored."""
        self._sinks.pop(name, None)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in list(self._sinks.values()):
                sink(batch, batch_id)
        finally:
            batch.unpersist()


def parquet_sink(folder: str) -> Sink:
    """Writes each batch to its own subfolder, so a batch that is delivered again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return write


class Snapshots:
    """Parquet outputs of one stream that readers see in the same state: all of a batch, or none of it.

    Each output is a name and what to make of a batch, in the order they subscribed. A batch is first
    written for all of them; then one line in `folder` says that it counts. `read` leaves out batches
    without a line. A batch that already counts is not written again, so what was read stays.
    """

    LINES = "n bigint, batch_id bigint"

    def __init__(self, folder: str, outputs: Mapping[str, Callable[[DataFrame], DataFrame]]):
        self.folder, self.outputs = folder, dict(outputs)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        line = f"{self.folder}/_counts/batch_id={batch_id}"
        if read_if_there(spark, line, "n bigint") is not None:
            return
        batch.persist()
        try:
            for name, made in self.outputs.items():
                parquet_sink(f"{self.folder}/{name}")(made(batch), batch_id)
        finally:
            batch.unpersist()
        # The output committer moves the file of this one row into place as a whole.
        spark.createDataFrame([(len(self.outputs),)], "n bigint").coalesce(1).write.mode("overwrite").parquet(line)

    def read(self, spark: SparkSession, name: str, schema: str, upto: int | None = None) -> DataFrame:
        """The rows of an output, with `batch_id`, of all batches that count, up to one if it is given.

        Give `upto` the same `newest` to read several outputs in the same state.
        """
        counts = read_if_there(spark, f"{self.folder}/_counts", self.LINES)
        rows = read_if_there(spark, f"{self.folder}/{name}", f"{schema}, batch_id bigint")
        if counts is None or rows is None:
            return spark.createDataFrame([], f"{schema}, batch_id bigint")
        if upto is not None:
            counts = counts.filter(F.col("batch_id") <= upto)
        return rows.join(counts.select("batch_id"), "batch_id", "left_semi").select(*rows.columns)

    def newest(self, spark: SparkSession) -> int | None:
        """The last batch that counts."""
        counts = read_if_there(spark, f"{self.folder}/_counts", self.LINES)
        return None if counts is None else counts.agg(F.max("batch_id")).first()[0]


def fan_out(
    stream: DataFrame,
    sinks: Sink | Mapping[str, Sink],
    checkpoint: str,
    output_mode: str = "append",
    **trigger,
) -> StreamingQuery:
    """Starts delivering `stream` to the sinks; `trigger` is passed on, e.g. availableNow=True."""
    deliver = FanOut(sinks) if isinstance(sinks, Mapping) else sinks
    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.foreachBatch(deliver).start()


def run_to_parquet(stream: DataFrame, output_mode: str = "append") -> DataFrame:
    """Runs a stream over the data available now and returns what it wrote, with its batch ids."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    # An empty batch, so that there is a result to read when the source has no data.
    parquet_sink(f"{folder}/out")(spark.createDataFrame([], stream.schema), -1)
    query = fan_out(
        stream, {"out": parquet_sink(f"{folder}/out")}, f"{folder}/state", output_mode, availableNow=True
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(f"{folder}/out")
