"""Seeding, duplicate guards, run states and other catalogue operators.

There are no constraints in a table store: uniqueness is kept by anti joins
before an append, and cascades by anti joins of the child tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim

STAGES = ("acquire", "store", "parse", "chunk", "done")


def seed_plan(rows: DataFrame, doi: str = "doi", url: str = "pdf_url", order: str = "row_number") -> DataFrame:
    """First row of each non-blank DOI in file order, blank addresses as null."""
    clean = rows.select(F.col(order), F.nullif(trim(F.col(doi)), F.lit("")).alias("doi"), F.nullif(trim(F.col(url)), F.lit("")).alias("pdf_url"))
    return clean.where("doi is not null").groupBy("doi").agg(F.min(F.struct(order, "pdf_url")).alias("first")).select("doi", F.col("first.pdf_url").alias("pdf_url"), F.col(f"first.{order}").alias(order))


def missing_doi_rows(rows: DataFrame, doi: str = "doi", order: str = "row_number") -> DataFrame:
    """Rows that a seed skips for want of a DOI."""
    return rows.where(F.coalesce(trim(F.col(doi)), F.lit("")) == "").select(order)


def new_dois(candidates: DataFrame, catalogue: DataFrame, doi: str = "doi") -> DataFrame:
    """Candidates that the catalogue doesn't hold; blank DOIs never match."""
    known = catalogue.where(F.col(doi) != "").select(F.col(doi).alias("_known"))
    return candidates.join(known, F.col(doi) == F.col("_known"), "left_anti")


def duplicates(rows: DataFrame, doi: str, key: str) -> DataFrame:
    """Rows whose DOI another, earlier row has: those a partial unique index would refuse."""
    nth = F.row_number().over(Window.partitionBy(doi).orderBy(key))
    return rows.where(F.coalesce(F.col(doi), F.lit("")) != "").withColumn("nth", nth).where("nth > 1").drop("nth")


def latest_state(events: DataFrame, run: str, at: str, *columns: str) -> DataFrame:
    """Last state of each run from an append-only log."""
    return events.groupBy(run).agg(F.max_by(F.struct(*columns), at).alias("s")).select(run, "s.*")


def success_kind(stage: Column, has_pdf: Column) -> Column:
    return F.when(stage == "done", F.when(has_pdf, "full").otherwise("metadata_only"))


def outcome_counts(rows: DataFrame, outcome: str) -> DataFrame:
    return rows.groupBy(outcome).agg(F.count("*").alias("n"))


def cascade(children: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children whose parent is still there; those without one stay."""
    kept = parents.select(F.col(key).alias("_key"))
    return children.where(F.col(foreign).isNull()).unionByName(children.join(kept, F.col(foreign) == F.col("_key"), "left_semi"))


def resolve_authors(entries: DataFrame, authors: DataFrame) -> DataFrame:
    """entries (pos, name, orcid) with the id of a known author: by ORCID if there is one, else by name (smallest id).

    Entries without a name are dropped; without a match the id is null.
    """
    named = entries.where(F.coalesce(trim(F.col("name")), F.lit("")) != "")
    by_orcid = authors.where("orcid is not null").groupBy("orcid").agg(F.min("id").alias("orcid_id"))
    by_name = authors.groupBy("full_name").agg(F.min("id").alias("name_id"))
    joined = named.join(by_orcid, "orcid", "left").join(by_name, F.col("name") == F.col("full_name"), "left")
    return joined.select("pos", "name", "orcid", F.when(F.col("orcid").isNotNull(), F.col("orcid_id")).otherwise(F.col("name_id")).alias("author_id"))


def first_valid(candidates: DataFrame, key: str, priority: str, content: str, magic: str = "%PDF") -> DataFrame:
    """The content of the best-placed candidate that starts like a PDF."""
    return candidates.where(F.col(content).startswith(magic)).groupBy(key).agg(F.min_by(content, priority).alias(content))


def larger_wins(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """A new content replaces a stored one only if it is strictly longer."""
    both = old.select(key, content, F.lit(0).alias("age")).unionByName(new.select(key, content, F.lit(1).alias("age")))
    return both.groupBy(key).agg(F.max_by(content, F.struct(F.length(content), -F.col("age"))).alias(content))


def merge_longest(values: DataFrame, key: str = "doi") -> DataFrame:
    """One value per field from values (key, field, kind, value, size, priority) of several providers.

    Providers come in order of priority.  The first value of a field sets its
    kind; a later one replaces it only if of the same kind (list or string)
    and strictly longer, so of the longest the earliest counts.  Booleans and
    other kinds aren't replaced.
    """
    own = Window.partitionBy(key, "field")
    first = F.min_by("kind", "priority").over(own)
    rows = values.where("value is not null").withColumn("first_kind", first)
    size = F.when(F.col("kind").isin("list", "string"), F.col("size")).otherwise(0)
    same = rows.where(F.col("kind") == F.col("first_kind"))
    return same.groupBy(key, "field").agg(F.max_by("value", F.struct(size, -F.col("priority"))).alias("value"))


def sources(values: DataFrame, key: str = "doi") -> DataFrame:
    """Providers that found the key, in order of priority."""
    return values.groupBy(key).agg(F.transform(F.array_sort(F.collect_set(F.struct("priority", "provider"))), lambda s: s["provider"]).alias("sources"))
