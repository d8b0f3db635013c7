"""Upsert streams: micro-batches merged into a table, each once, however often it is delivered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sessions import latest
from ..workspace import Workspace, written

#: Batches that a read has to merge, before they are compacted.
MERGES = 16


class UpsertTable:
    """The last row of each key, as a folder for each micro-batch and, now and then, for all before.

    A batch is written to the folder of its number and so replaces what an
    earlier delivery of it wrote; folders count once their writing has ended. A
    reader takes the last compacted folder and the batches after it. The last
    row of a key is the one with the greatest ``order``, and of these that of
    the latest batch; a null order comes before all others. Nulls in keys are
    a key. A table without batches has no schema and cannot be read.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], order: str, merges: int = MERGES):
        self.spark, self.root, self.keys, self.order, self.merges = spark, root.rstrip("/"), list(keys), order, merges

    def _told(self, kind: str) -> list[int]:
        return [int(x.rpartition("=")[2]) for x in written(self.spark, f"{self.root}/{kind}")]

    def _held(self, upto: int | None = None) -> tuple[DataFrame | None, int]:
        """(rows with ``_batch``, number of folders) of the table, up to a batch."""
        bases = [k for k in self._told("base") if upto is None or k <= upto]
        base = bases[-1] if bases else -1
        folders = [f"{self.root}/base/batch={base:09}"] * bool(bases)
        folders += [f"{self.root}/rows/batch={k:09}" for k in self._told("rows") if k > base and (upto is None or k <= upto)]
        return (self.spark.read.parquet(*folders) if folders else None), len(folders)

    def merge(self, rows: DataFrame, batch_id: int) -> None:
        """Takes in a micro-batch; the function for ``foreachBatch``."""
        own = rows.withColumn("_batch", F.lit(batch_id).cast("long"))
        self._last(own).write.mode("overwrite").parquet(f"{self.root}/rows/batch={batch_id:09}")
        if self._held(batch_id)[1] > self.merges:
            self.compact(batch_id)

    def compact(self, upto: int) -> None:
        """Writes what the batches up to one come to; they are not read again."""
        held, _ = self._held(upto)
        self._last(held).write.mode("overwrite").parquet(f"{self.root}/base/batch={upto:09}")

    def _last(self, rows: DataFrame) -> DataFrame:
        return latest(rows, self.keys, F.struct(self.order, "_batch"))

    def read(self) -> DataFrame:
        held, _ = self._held()
        if held is None:
            raise ValueError(f"{self.root} holds no batch")
        return self._last(held).drop("_batch")


def upsert_stream(rows: DataFrame, table: UpsertTable, checkpoint: str, at: str | None = None, ids: Sequence[str] = (), late: str = "2 days") -> StreamingQuery:
    """A query that merges all there is of a stream into ``table``; with ``at`` and ``ids``, rows with ids met within the watermark are left out before."""
    if at is not None:
        rows = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(list(ids))
    return rows.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_to_files(stream: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Runs a stream of appended rows over all that is there, into files in the workspace."""
    path = f"{work.path}/{name}"
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
