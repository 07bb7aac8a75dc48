"""Run a streaming query to completion, and keep what its batches write.

Sinks are ``foreachBatch`` writers keyed by batch id: a retried batch
overwrites its own folder, so a lost executor or a restarted query never
duplicates rows. Checkpoints and outputs live below the shared folder
(``spark.checkpoint.dir``), never on a machine-local path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from milepost.session import scratch_path
from milepost.storage import Folder

BATCH = "batch"


def run_query(
    spark: SparkSession,
    sdf: DataFrame,
    name: str,
    output_mode: str,
    sink: Callable[[str], Callable[[DataFrame, int], None]],
    state_partitions: int | None = None,
) -> str:
    """Run ``sdf`` with ``trigger(availableNow=True)``, each micro-batch through
    the writer that ``sink`` makes for the query's folder; return the folder.

    ``state_partitions`` sets the number of state-store partitions of a new
    query (fixed in its checkpoint afterwards); a stream keyed by a handful
    of providers needs far fewer than a table-sized shuffle. The query runs
    on a clone of the session taken at ``start``, so the setting is put back
    right after.
    """
    base = scratch_path(spark, name)
    previous = spark.conf.get("spark.sql.shuffle.partitions")
    if state_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        q = (
            sdf.writeStream.outputMode(output_mode)
            .foreachBatch(sink(f"{base}/out"))
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", previous)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return f"{base}/out"


class CompactedLog:
    """A table kept as what each batch adds, and now and then merged into one.

    ``merge`` turns parts (any number, in any order) into one table of the same
    schema, and may be applied again to its own result. Every ``every``-th batch
    writes the merge of all so far, and the parts it covers are deleted one
    compaction later. So a read opens one merged table and less than ``every``
    (right after a failure, twice as many) parts. Merges are named by batch id, so a
    retried batch writes the same again.
    """

    def __init__(
        self, spark: SparkSession, base: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame], every: int = 8
    ):
        self.spark, self.base, self.schema, self.merge, self.every = spark, base, schema, merge, every
        self.files = Folder(spark, base)

    def _ids(self, kind: str, key: str, upto: int | None) -> list[int]:
        ids = [int(n.split("=")[1]) for n in self.files.names(kind) if n.startswith(f"{key}=")]
        # A folder counts once its write is complete.
        whole = [i for i in sorted(ids) if upto is None or i <= upto]
        return [i for i in whole if "_SUCCESS" in self.files.names(f"{kind}/{key}={i}")]

    def parts(self, upto: int | None = None) -> list[str]:
        """The folders that hold the table as of batch ``upto``."""
        merged = self._ids("merged", "upto", upto)[-1:]
        newer = [i for i in self._ids("parts", BATCH, upto) if not merged or i > merged[-1]]
        return [f"merged/upto={i}" for i in merged] + [f"parts/{BATCH}={i}" for i in newer]

    def read(self, upto: int | None = None) -> DataFrame:
        """All parts as of batch ``upto``, merged."""
        paths = [f"{self.base}/{p}" for p in self.parts(upto)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.merge(self.spark.read.schema(self.schema).parquet(*paths))

    def append(self, part: DataFrame, batch_id: int) -> None:
        part.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.base}/parts/{BATCH}={batch_id}")
        if (batch_id + 1) % self.every == 0:
            self.read(batch_id).write.mode("overwrite").parquet(f"{self.base}/merged/upto={batch_id}")
            before = batch_id - self.every
            for i in self._ids("parts", BATCH, before):
                self.files.delete(f"parts/{BATCH}={i}")
            for i in self._ids("merged", "upto", before - 1):
                self.files.delete(f"merged/upto={i}")
