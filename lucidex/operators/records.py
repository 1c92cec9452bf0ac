"""Benchmark records of files, from texts that were extracted before wherever the file hasn't changed since.

The texts are a table keyed by path and change time.  An update lists the
files (names, times and sizes only), reads the content of those that the table
doesn't hold in their present state, and adds their texts; a second update
over the same files opens none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import Extractors, file_states
from ..sources.tables import Tables

TEXTS = "path string, modificationTime timestamp, text string, pages int, error string"
CACHED, PARSED, FAILED, MISSING = "success (cached)", "success", "error", "missing"


class TextCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.tables = spark, Tables(spark, path)

    def texts(self, state: dict | None = None) -> DataFrame:
        own = self.tables.read("texts", state)
        return own if own is not None else self.spark.createDataFrame([], TEXTS)

    def stale(self, files: DataFrame, state: dict | None = None) -> DataFrame:
        """Files without a text of their present state."""
        return files.join(self.texts(state).select("path", "modificationTime"), ["path", "modificationTime"], "left_anti")

    def update(self, folder: str, extractors: Extractors, kind: str = "plain") -> DataFrame:
        """(path, text, pages, status, error) of all files; new and changed ones are read, the others come from the table."""
        state = self.tables.state()
        files = file_states(self.spark, folder)
        # Names of new files only: the driver lists files anyway to plan a scan of them.
        todo = [r["path"] for r in self.stale(files, state).select("path").collect()]
        if todo:
            content = self.spark.read.format("binaryFile").load(todo)
            made = extractors.apply(content.select(F.col("path").alias("name"), "content"), kind)
            rows = made.join(files.withColumnRenamed("path", "name"), "name").select(F.col("name").alias("path"), "modificationTime", "text", "pages", "error")
            after = state["tables"].get("texts")
            state = self.tables.commit(state, {"texts": self.tables.write("texts", rows, after=after)})
        fresh = self.spark.createDataFrame([(p, True) for p in todo], "path string, now boolean")
        held = files.join(self.texts(state), ["path", "modificationTime"], "left").join(fresh, "path", "left")
        status = F.when(F.col("error").isNotNull(), FAILED).when(F.col("text").isNull(), MISSING).when(F.col("now"), PARSED).otherwise(CACHED)
        return held.select("path", F.coalesce("text", F.lit("")).alias("text"), "pages", status.alias("status"), "error")


def with_missing(rows: DataFrame, every: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """A row for each of every: those without a text have the status MISSING and the defaults, none is left out."""
    joined = every.join(rows, on, "left")
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}
    return joined.withColumns(filled | {"status": F.coalesce("status", F.lit(MISSING))})
