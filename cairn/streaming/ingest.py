"""Files that arrive, taken in batch by batch (beyond what was asked for: the operators are the same)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.lifecycle import upload
from cairn.schema import CHUNK_SIZE
from cairn.sources.store import ParquetStore


def ingest(files: DataFrame, store: ParquetStore, checkpoint: str, size: int = CHUNK_SIZE):
    """Starts a query that uploads a stream of files (name, timestamp, data) and stops when it has caught up.

    One batch may bring several payloads of a name; the latest is taken, by timestamp.
    """

    def take(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("name").agg(F.max_by(F.struct("timestamp", "data"), "timestamp").alias("r")).select("name", "r.*")
        store.commit(upload(store.load(), latest, size))

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
