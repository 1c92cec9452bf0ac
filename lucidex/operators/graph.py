"""The graph of a search context: chunks, documents, journals, authors, keywords.

Input is one row per ranked chunk (position, type, document_id) and one per
document (document_id, title, journal, date, keywords, authors), where authors
is an array of struct(id, name).  Node ids are chunk_<position>, the document
id, journal_<name>, author_<id> and keyword_<word>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relevant(chunks: DataFrame, rows: DataFrame, key: str = "document_id") -> DataFrame:
    """The rows of the documents that the chunks name; do this before anything is joined to or grouped by documents."""
    return rows.join(chunks.select(F.col("document_id").alias("named")).distinct(), F.col(key) == F.col("named"), "left_semi")


def joined(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each chunk with its document: what nodes() and edges() read."""
    return chunks.join(documents, "document_id").withColumn("document", F.col("document_id").cast("string")).withColumn("chunk", F.concat(F.lit("chunk_"), F.col("position")))


def nodes(rows: DataFrame) -> DataFrame:
    """One row per node of joined() rows; of nodes with an id the first, in chunk order, counts."""
    text, words = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    names = F.array_compact(F.transform("authors", lambda a: a["name"]))

    def node(key: Column, label: Column, kind: str, chunk_type: Column = text, own: bool = False) -> Column:
        facts = {"keywords": F.col("keywords"), "author_names": names, "journal": F.col("journal"), "date": F.col("date"), "document": F.col("document")} if own else {"keywords": words, "author_names": words, "journal": text, "date": text, "document": text}
        return F.struct(key.alias("id"), label.alias("label"), F.lit(kind).alias("kind"), chunk_type.alias("chunk_type"), *[c.alias(n) for n, c in facts.items()])

    journal = F.when(F.coalesce("journal", F.lit("")) != "", F.array(node(F.concat(F.lit("journal_"), "journal"), F.col("journal"), "journal")))
    author = F.transform("authors", lambda a: node(F.concat(F.lit("author_"), a["id"]), F.coalesce(a["name"], F.concat(F.lit("author_"), a["id"])), "author"))
    keyword = F.transform("keywords", lambda k: node(F.concat(F.lit("keyword_"), k), k, "keyword"))
    fixed = F.array(node(F.col("chunk"), F.col("chunk"), "chunk", F.col("type"), True), node(F.col("document"), F.coalesce("title", "document"), "document", text, True))
    empty = F.filter(fixed, lambda x: F.lit(False))
    every = F.concat(fixed, *[F.coalesce(x, empty) for x in (journal, author, keyword)])
    return rows.select("position", F.explode(every).alias("node")).groupBy(F.col("node.id").alias("id")).agg(F.min_by("node", "position").alias("first")).select("first.*")


def edges(rows: DataFrame) -> DataFrame:
    """(source, target) of joined() rows, as often as a document's chunks repeat them."""
    edge = lambda a, b: F.struct(a.alias("source"), b.alias("target"))
    document = F.col("document")
    fixed = F.array(edge(F.col("chunk"), document))
    empty = F.filter(fixed, lambda x: F.lit(False))
    journal = F.when(F.coalesce("journal", F.lit("")) != "", F.array(edge(document, F.concat(F.lit("journal_"), "journal"))))
    author = F.transform("authors", lambda a: edge(document, F.concat(F.lit("author_"), a["id"])))
    keyword = F.transform("keywords", lambda k: edge(document, F.concat(F.lit("keyword_"), k)))
    return rows.select(F.explode(F.concat(fixed, *[F.coalesce(x, empty) for x in (journal, author, keyword)])).alias("e")).select("e.*")


def _within(kinds: tuple[str, ...], condition: Column) -> Column:
    """Nodes of other kinds pass."""
    return ~F.col("kind").isin(*kinds) | F.coalesce(condition, F.lit(False))


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def facet(kinds=(), chunk_types=(), keywords=(), documents=(), journals=(), authors=(), dates: tuple[str, str] | None = None) -> Column:
    """The condition a node has to meet; an empty choice is no filter.

    A chunk or document without a date, journal or keyword fails the filter
    on it.
    """
    out: Column = F.lit(True)
    if kinds:
        out = out & F.col("kind").isin(*kinds)
    if chunk_types:
        out = out & _within(("chunk",), F.col("chunk_type").isin(*chunk_types))
    if keywords:
        out = out & _within(("chunk", "document", "keyword"), F.when(F.col("kind") == "keyword", F.col("label").isin(*keywords)).otherwise(F.arrays_overlap("keywords", _array(keywords))))
    if dates:
        out = out & _within(("chunk", "document"), F.col("date").between(*dates))
    if documents:
        out = out & _within(("chunk", "document"), F.col("document").isin(*documents))
    if journals:
        out = out & _within(("chunk", "document", "journal"), F.when(F.col("kind") == "journal", F.col("label").isin(*journals)).otherwise(F.col("journal").isin(*journals)))
    if authors:
        out = out & _within(("chunk", "document", "author"), F.when(F.col("kind") == "author", F.col("label").isin(*authors)).otherwise(F.arrays_overlap("author_names", _array(authors))))
    return out


def pruned_edges(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes; repeated edges stay repeated."""
    ids = node_rows.select("id")
    return edge_rows.join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_semi")


def connected(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Nodes that an edge touches."""
    ends = edge_rows.select(F.col("source").alias("end")).union(edge_rows.select("target"))
    return node_rows.join(ends, F.col("id") == F.col("end"), "left_semi")


def filtered(node_rows: DataFrame, edge_rows: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Filter nodes, then edges by nodes, then nodes without an edge."""
    some = node_rows.where(condition)
    left = pruned_edges(edge_rows, some)
    return connected(some, left), left


def facet_options(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: sorted distinct values of each facet, first and last date."""
    rows = joined(chunks, documents)
    # Values are made single before they come together, so no row holds every chunk's lists.
    each = lambda kind, c: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("value")))
    names = F.transform("authors", lambda a: F.coalesce(a["name"], F.concat(F.lit("author_"), a["id"])))
    lists = {"chunk_types": F.array("type"), "documents": F.array("document"), "journals": F.array("journal"), "keywords": F.col("keywords"), "authors": names, "dates": F.array("date")}
    found = rows.select(F.explode(F.flatten(F.array_compact(F.array(*[each(k, c) for k, c in lists.items()])))).alias("x")).select("x.*").where("value is not null").distinct()
    values = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))).alias(kind)
    date = F.when(F.col("kind") == "dates", F.col("value"))
    return found.agg(*[values(k) for k in lists if k != "dates"], F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def metadata_text(entries: Column, hidden: tuple[str, ...] = ("timeStamp",)) -> Column:
    """`- Key : __value__` lines of a map, in key order."""
    shown = F.filter(F.array_sort(F.map_entries(entries)), lambda e: ~e["key"].isin(*hidden))
    return F.array_join(F.transform(shown, lambda e: F.concat(F.lit("- "), F.initcap(e["key"]), F.lit(" : __"), e["value"], F.lit("__"))), "\n")
