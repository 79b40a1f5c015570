"""Incremental intake as a stream: each micro-batch keeps only messages whose keys were never seen, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators.ingest import known_keys, new_messages
from tracewell.sources.paths import Folder

#: Parts of keys that are joined into one when so many have come.
COMPACT = 32


class Intake:
    """Messages and their keys as parquet folders, one part per micro-batch.

    The horizon of de-duplication is unbounded and reaches over all sources, so keys are a table, not state of a
    stream. A part is named after its batch and written again when the batch is repeated: repeating changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, order: str = "row_id") -> None:
        self.spark, self.folder, self.order = spark, Folder(spark, folder), order

    def _parts(self, name: str, before: int | None = None) -> list[str]:
        """The parts of a table that were written to their end: those of batches, and ``upto`` for many at once."""
        whole = [p for p in self.folder.names(name) if "=" in p and not p.endswith(".new") and self.folder.exists(f"{name}/{p}/_SUCCESS")]
        number = {p: int(p.split("=")[1]) for p in whole}
        joined = [p for p in whole if p.startswith("upto=") and (before is None or number[p] < before)]
        last = max(joined, key=number.get, default=None)
        kept = [p for p in whole if p.startswith("batch=") and (last is None or number[p] > number[last]) and (before is None or number[p] < before)]
        return [self.folder.at(f"{name}/{p}") for p in [*([last] if last else []), *kept]]

    def table(self, name: str, schema, before: int | None = None) -> DataFrame:
        parts = self._parts(name, before)
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def batch(self, incoming: DataFrame, number: int) -> None:
        """Takes in one micro-batch; every ``COMPACT`` batches the keys so far become one part."""
        known = self.table("keys", "key string", before=number)
        fresh = new_messages(incoming, known, self.order).drop("key", "ckey")
        at = self.folder.at(f"messages/batch={number:08d}")
        fresh.write.mode("overwrite").parquet(at)
        known_keys(self.spark.read.schema(fresh.schema).parquet(at)).write.mode("overwrite").parquet(self.folder.at(f"keys/batch={number:08d}"))
        if number % COMPACT == COMPACT - 1:
            self.table("keys", "key string", before=number + 1).write.mode("overwrite").parquet(self.folder.at(f"keys/upto={number:08d}.new"))
            self._settle(number)

    def _settle(self, number: int) -> None:
        """The joined part takes its name when it is whole, so a reader sees all of it or none."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        new, name = (jvm.Path(self.folder.at(f"keys/upto={number:08d}{x}")) for x in (".new", ""))
        fs = new.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if fs.exists(name):
            fs.delete(new, True)
        else:
            fs.rename(new, name)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs the intake over a stream until all that is available is taken in."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
