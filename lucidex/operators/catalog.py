"""Artifacts of documents put into the catalogue: documents, authors, their links and parsed artifacts.

An artifact row brings a document's title, keywords and authors and the result
of its parse.  Title, keywords and the list of authors replace the document's
own; authors are found by ORCID if the entry has one, else by exact name, and
created where there is none.  All four tables change under one commit marker,
so a failure on the way leaves the old state, and the same rows put in again
change nothing.

Only what changes moves: new ids are offsets of partition counts, not a global
numbering in one task, and tables are joined on the ids and names of the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trim
from ..sources.tables import Tables

SCHEMAS = {
    "documents": "document_id long, doi string, title string, keywords array<string>",
    "authors": "author_id long, full_name string, orcid string",
    "document_authors": "document_id long, pos int, author_id long",
    "artifacts": "document_id long, postprocessed_text string, parser_config string",
}
ARTIFACT = "doi string, title string, keywords array<string>, authors array<struct<name:string,orcid:string>>, postprocessed_text string, parser_config string"


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim(c), F.lit(""))


def tables_of(store: Tables, state: dict) -> dict[str, DataFrame]:
    out = {}
    for name, schema in SCHEMAS.items():
        own = store.read(name, state)
        out[name] = own if own is not None else store.spark.createDataFrame([], schema)
    return out


def numbered(rows: DataFrame, first: int, out: str) -> DataFrame:
    """rows with consecutive ids from first on, in no particular order.

    rows must be stored: their partitions are counted once and numbered in
    place, by the counts of the partitions before.
    """
    placed = rows.withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33))
    counts = placed.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_m") - F.shiftleft(F.col("_part"), 33)
    return placed.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_offset") + inside + first).drop("_m", "_part", "_offset")


def entries_of(artifacts: DataFrame) -> DataFrame:
    """(doi, pos, name, orcid) of the authors with a name, in their order."""
    each = artifacts.select("doi", F.posexplode("authors").alias("pos", "a"))
    return each.select("doi", "pos", F.col("a.name").alias("name"), blank_to_null(F.col("a.orcid")).alias("orcid")).where(blank_to_null(F.col("name")).isNotNull())


def known_authors(entries: DataFrame, authors: DataFrame) -> DataFrame:
    """entries with author_id: by ORCID where the entry has one, else by name (smallest id); null without a match."""
    by_orcid = authors.where("orcid is not null").groupBy("orcid").agg(F.min("author_id").alias("of_orcid"))
    by_name = authors.groupBy(F.col("full_name").alias("name")).agg(F.min("author_id").alias("of_name"))
    joined = entries.join(by_orcid, "orcid", "left").join(by_name, "name", "left")
    return joined.select(*entries.columns, F.when(F.col("orcid").isNotNull(), F.col("of_orcid")).otherwise(F.col("of_name")).alias("author_id"))


def missing_authors(entries: DataFrame, authors: DataFrame) -> DataFrame:
    """(full_name, orcid) to create: one for each unknown ORCID (with the first name it comes with), then one for each name that no author has, old or new."""
    unknown = known_authors(entries, authors).where("author_id is null")
    place = F.struct("doi", "pos", "name")
    with_orcid = unknown.where("orcid is not null").groupBy("orcid").agg(F.min_by("name", place).alias("full_name")).select("full_name", "orcid")
    names = unknown.where("orcid is null").select(F.col("name").alias("full_name")).distinct().join(with_orcid.select("full_name"), "full_name", "left_anti")
    return with_orcid.unionByName(names.withColumn("orcid", F.lit(None).cast("string")))


def same(column: str) -> Column:
    return F.col(f"old.{column}").eqNullSafe(F.col(f"new.{column}"))


class Catalogue:
    def __init__(self, spark: SparkSession, path: str):
        self.store = Tables(spark, path)

    def read(self, name: str, state: dict | None = None) -> DataFrame:
        return tables_of(self.store, state or self.store.state())[name]

    def put(self, artifacts: DataFrame) -> dict:
        """Insert or replace the artifacts' documents; the state after it.

        Artifacts without a DOI are left out; of several with one DOI the
        largest row counts.  A batch that changes nothing commits nothing.
        """
        state = self.store.state()
        old = tables_of(self.store, state)
        batch = self._stored("batch", one_per_doi(artifacts))
        # Into an empty catalogue all is new: nothing to compare, and the texts needn't move.
        changed = self._stored("changed", self._changed(batch, old)) if "documents" in state["tables"] else batch
        if changed.isEmpty():
            return state
        entries = entries_of(changed)
        new_authors = self._stored("new_authors", missing_authors(entries, old["authors"]))
        new_documents = self._stored("new_documents", changed.select("doi").join(old["documents"], "doi", "left_anti"))
        next_id = lambda table, key: (table.agg(F.max(key)).first()[0] or 0) + 1
        added = self.store.write("authors", numbered(new_authors, next_id(old["authors"], "author_id"), "author_id").select("author_id", "full_name", "orcid"), after=state["tables"].get("authors"))
        authors = self.store.read("authors", {"tables": {"authors": added}})
        fresh = self._stored("fresh", numbered(new_documents, next_id(old["documents"], "document_id"), "document_id").select("document_id", "doi"))
        own = fresh.unionByName(old["documents"].select("document_id", "doi"))
        ids = changed.select("doi").join(own, "doi")
        touched = self._stored("touched", ids)

        def replaced(name: str, rows: DataFrame) -> dict:
            kept = old[name].join(touched.select("document_id"), "document_id", "left_anti")
            return self.store.write(name, kept.select(*rows.columns).unionByName(rows))

        mine = changed.join(touched, "doi")
        links = known_authors(entries, authors).join(touched, "doi")
        # The same author twice in one list counts once, at the first place.
        links = links.groupBy("document_id", "author_id").agg(F.min("pos").cast("int").alias("pos"))
        return self.store.commit(state, {
            "authors": added,
            "documents": replaced("documents", mine.select("document_id", "doi", "title", "keywords")),
            "document_authors": replaced("document_authors", links.select("document_id", "pos", "author_id")),
            "artifacts": replaced("artifacts", mine.select("document_id", "postprocessed_text", "parser_config")),
        })

    def _stored(self, name: str, df: DataFrame) -> DataFrame:
        """df written once below the tables' folder, so that what is read from it is always the same."""
        return self.store.read(name, {"tables": {name: self.store.write(f"_{name}", df)}})

    def _changed(self, batch: DataFrame, old: dict[str, DataFrame]) -> DataFrame:
        """Rows of the batch whose document, authors or artifact aren't stored as they are."""
        lists = old["document_authors"].groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("pos", "author_id"))).alias("links"))
        there = old["documents"].join(old["artifacts"], "document_id", "left").join(lists, "document_id", "left")
        first = known_authors(entries_of(batch), old["authors"]).groupBy("doi", "author_id").agg(F.min("pos").cast("int").alias("pos"))
        wanted = first.groupBy("doi").agg(F.sort_array(F.collect_list(F.struct("pos", "author_id"))).alias("links"))
        both = batch.join(wanted, "doi", "left").alias("new").join(there.alias("old"), F.col("new.doi") == F.col("old.doi"), "left")
        equal = F.col("old.doi").isNotNull()
        for column in ("title", "keywords", "postprocessed_text", "parser_config", "links"):
            equal &= same(column)
        return both.where(~equal).select(*[F.col(f"new.{c}").alias(c) for c in batch.columns])


def one_per_doi(artifacts: DataFrame) -> DataFrame:
    """A row for each non-blank DOI; a null title is blank, null keywords are none."""
    rows = artifacts.where(blank_to_null(F.col("doi")).isNotNull()).select("doi", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), "authors", "postprocessed_text", "parser_config")
    if not rows.groupBy("doi").count().where("count > 1").take(1):
        return rows  # the usual case; texts aren't shuffled
    rest = [c for c in rows.columns if c != "doi"]
    return rows.groupBy("doi").agg(F.max(F.struct(*rest)).alias("r")).select("doi", *[F.col(f"r.{c}").alias(c) for c in rest])
