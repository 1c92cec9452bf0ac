"""Streaming ingestion of documents: an extension beyond the batch engine.

New files become chunks once per DOI: duplicates within the watermark are
dropped by state, older ones by an anti join with the table, so a restarted
stream appends nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import chunks
from ..sources.writers import append_new


def documents(spark: SparkSession, path: str, schema, late: str = "1 day") -> DataFrame:
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["doi"])


def ingest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Run what is there now and stop; each micro-batch appends the chunks of new DOIs."""

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.select("doi", F.posexplode(chunks(F.col("text"))).alias("n", "content"))
        append_new(rows.select(F.concat("doi", F.lit("#"), F.col("n") + 1).alias("chunk_id"), "doi", (F.col("n") + 1).alias("order"), "content"), table, "chunk_id")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
