"""Micro-batches that are written once, and the state of a search that goes on over them.

A batch's rows go to a folder of their own, `batch=<id>`, which is written over if the batch comes again; then its entry - rows and
the position reached - is committed to `ledger`. Only committed batches are read back. A batch that is run again after its
entry was committed (a stream restarted before it had noted that batch) is left as it is, so that each batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

ENTRY = "batch long, documents long, found long, position long"


class Ledger:
    """Batches below a folder of the shared storage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def committed(self) -> list[int]:
        """The ids of the committed batches, in order."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ledger/*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(int(f.getPath().getParent().getName()) for f in found)

    def entries(self) -> DataFrame:
        """(batch, documents, found, position) of the committed batches."""
        done = self.committed()
        if not done:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).json([f"{self.folder}/ledger/{b}" for b in done])

    def position(self) -> int:
        """Documents read by committed batches."""
        return self.entries().agg(F.coalesce(F.max("position"), F.lit(0))).first()[0]

    def found(self, schema: str | T.StructType) -> DataFrame:
        """The rows of the committed batches."""
        done = self.committed()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/batch={b}" for b in done])

    def commit(self, batch: int, read: DataFrame, search: Callable[[DataFrame], DataFrame]) -> bool:
        """Writes search(read) as the batch, unless it is committed; whether it was written."""
        if self._exists(f"ledger/{batch}/_SUCCESS"):
            return False
        before = self.position()
        seen = Observation(f"batch-{batch}")
        search(read).observe(seen, F.count(F.lit(1)).alias("found")).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        documents = read.count()
        entry = self.spark.createDataFrame([(batch, documents, seen.get["found"], before + documents)], ENTRY)
        entry.coalesce(1).write.mode("overwrite").json(f"{self.folder}/ledger/{batch}")
        return True


def search_stream(docs: DataFrame, search: Callable[[DataFrame], DataFrame], ledger: Ledger, checkpoint: str) -> StreamingQuery:
    """Runs search on each micro-batch of a stream of documents, into the ledger; resumes at its checkpoint."""
    return docs.writeStream.foreachBatch(lambda new, batch: ledger.commit(batch, new, search)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
