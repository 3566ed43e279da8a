"""Micro-batch ingest of edges and nodes into a saved store, and its last-write-wins snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.model import Clock, stamped


def ingest_edges(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, clock: Clock | None = None) -> StreamingQuery:
    """Appends a stream of src, label, weight, dst, props (and ts) to a store's edge log. A batch is written under its own
    number and replaces itself when it is run again, so each row is there once. Rows without stamps get the batch's, which
    is later than that of all batches before it. No row is late: the snapshot is by stamp, without a watermark."""
    return _ingest(stream, f"{path}/edges", ["src", "label", F.col("weight").cast("double").alias("weight"), "dst", _or_null(stream, "props")], checkpoint, trigger, clock)


def ingest_nodes(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, clock: Clock | None = None) -> StreamingQuery:
    """Appends a stream of uuid and payload (and ts) to a store's node log."""
    return _ingest(stream, f"{path}/nodes", ["uuid", "payload"], checkpoint, trigger, clock)


def _or_null(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("string").alias(name)


def _ingest(stream: DataFrame, path: str, columns: list, checkpoint: str, trigger: dict | None, clock: Clock | None) -> StreamingQuery:
    clock = clock or Clock()

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(*columns, *[c for c in ("ts",) if c in batch.columns])
        writer = stamped(rows, clock).write.mode("overwrite")
        (writer.partitionBy("label") if "label" in rows.columns else writer).parquet(f"{path}/batch=stream-{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
