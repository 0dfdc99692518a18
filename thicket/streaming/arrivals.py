"""Files that arrive in a folder, ingested as they come.

The file source reports new files only; changed and deleted ones are found by the batch ingestion, which every
micro-batch runs over the whole folder. It hashes all files there, unless it was given a ``seen`` table: then files of the
same length and time are listed, but not opened.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from thicket.plans.ingestion import Ingestion


def watch(spark: SparkSession, folder: str, ingestion: Ingestion, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts the query; without ``every`` it takes what is there and stops."""
    arrived = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")

    def batch(df, _epoch) -> None:
        if not df.isEmpty():
            ingestion.run(folder)

    w = arrived.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
