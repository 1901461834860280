"""Sequential ids that go on from batch to batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from siteops.operators.state import assign_ids
from siteops.sources.tables import read_if_there
from siteops.streaming.fanout import Sink


class NumberedBatches:
    """Sink that numbers the rows of all batches 1, 2, 3, … and passes them on; see `assign_ids`.

    `folder` keeps a ledger: for each batch how many ids all batches before it have taken. A batch that
    is delivered again finds its own line and takes the same ids. Within a batch rows are numbered in
    `order`, which must decide the place of every row. Of the ledger only the line of the batch and of
    the one before it are read; where the latter is missing, as after a change of checkpoint, all are.
    """

    def __init__(self, folder: str, sink: Sink, order: Sequence[str], name: str = "id"):
        self.folder, self.sink, self.order, self.name = folder, sink, list(order), name

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            after = self._taken(batch, batch_id)
            self.sink(assign_ids(batch, self.order, self.name, after), batch_id)
        finally:
            batch.unpersist()

    def _line(self, batch_id: int) -> str:
        return f"{self.folder}/batch_id={batch_id}"

    def _taken(self, batch: DataFrame, batch_id: int) -> int:
        """Ids taken before this batch; writes the batch's line if it has none."""
        spark, schema = batch.sparkSession, "before bigint, n bigint"
        own = read_if_there(spark, self._line(batch_id), schema)
        if own is not None:
            return own.first()["before"]
        last = read_if_there(spark, self._line(batch_id - 1), schema)
        if last is None and (every := read_if_there(spark, self.folder, schema + ", batch_id bigint")) is not None:
            last = every.filter(F.col("batch_id") < batch_id).orderBy(F.desc("batch_id"))
        line = None if last is None else last.first()
        before = line["before"] + line["n"] if line is not None else 0
        spark.createDataFrame([(before, batch.count())], schema).coalesce(1).write.parquet(self._line(batch_id))
        return before
