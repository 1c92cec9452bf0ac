"""Extracted texts as they are handed on: headings, then without ghost blocks, then footnotes at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import text as T


def render(texts: DataFrame, blocks: DataFrame, notes: DataFrame | None = None, key: str = "doc_id", text: str = "text", markdown: bool = True, counters: Observation | None = None) -> DataFrame:
    """texts (key, text) in the order headings, ghost blocks, labelled footnotes, with considered and dropped blocks.

    blocks (key, text, keep) are the decisions on the layout's blocks; lines
    that are the text of a dropped one go.  counters, if given, holds the sums
    of considered and dropped blocks after the action that reads the result:
    they are counted in the pass that uses them.  notes (key, notes) are
    arrays of labelled footnotes.
    """
    seen = blocks if counters is None else blocks.observe(counters, F.count("*").alias("considered"), F.coalesce(F.sum((~F.col("keep")).cast("long")), F.lit(0)).alias("dropped"))
    gone = T.trim(F.when(~F.col("keep"), F.col("text")))
    of_block = seen.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("considered"), F.count_if(~F.col("keep")).alias("dropped"), F.collect_set(gone).alias("_gone"))
    c = F.col(text)
    rows = texts.withColumn(text, T.headings_to_level_one(c)) if markdown else texts
    rows = rows.join(of_block, F.col(key) == F.col("_key"), "left").withColumn(text, F.when(F.size("_gone") > 0, T.without_snippets(c, F.col("_gone"))).otherwise(c))
    rows = rows.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("considered", "dropped")}).drop("_key", "_gone")
    if notes is None:
        return rows
    marked = notes.select(F.col(key).alias("_key"), F.col("notes").alias("_notes"))
    move = folds.udf(lambda t, n: folds.move_labelled_footnotes(t, n, markdown), "string")
    rows = rows.join(marked, F.col(key) == F.col("_key"), "left")
    return rows.withColumn(text, F.when(F.size("_notes") > 0, move(c, F.coalesce("_notes", F.array().cast("array<string>")))).otherwise(c)).drop("_key", "_notes")
