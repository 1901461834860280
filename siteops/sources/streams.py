"""Streaming reader over a folder (or glob) of parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteops.sources.tables import SCHEMAS, with_utc_time


def stream_table(
    spark: SparkSession,
    path: str,
    name: str,
    times: tuple[str, ...] = (),
    max_files: int | None = None,
    max_bytes: str | None = None,
) -> DataFrame:
    """Streams table `name` from `path`; `times` are the zone-less columns to read as instants.

    `max_files` and `max_bytes` bound a micro-batch, and with it the rows that one key can bring to
    a stateful operator at once.
    """
    reader = spark.readStream.schema(SCHEMAS[name])
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return with_utc_time(reader.parquet(path), *times)
