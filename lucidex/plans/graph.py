"""Graph queries over the ten nearest chunks; a chunk's document is its label, and documents get journals, dates, keywords and authors by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import query, table
from .retrieval import _TOP, nearest

_CHUNKS = f"SELECT row_number() OVER (ORDER BY d, vec_id) - 1 AS position, 'text' AS type, label AS document_id FROM ({_TOP})"
_DOCS = """SELECT doc_id AS document_id, 'Title ' || doc_id AS title, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'Journal ' || (doc_id % 2) END AS journal,
  '20' || lpad((10 + doc_id % 10)::VARCHAR, 2, '0') || '-01' AS date, ['kw' || (doc_id % 3), lang] AS keywords FROM documents"""
_DOC_AUTHORS = "SELECT doc_id AS document_id, a, s_name FROM (SELECT doc_id, doc_id % 3 + 1 AS a FROM documents UNION ALL SELECT doc_id, doc_id % 2 + 200000 FROM documents) LEFT JOIN supplier ON s_suppkey = a"
_J = f"(SELECT c.*, d.* EXCLUDE (document_id) FROM ({_CHUNKS}) c JOIN ({_DOCS}) d USING (document_id))"
_NAMES = f"(SELECT document_id, list(s_name) FILTER (WHERE s_name IS NOT NULL) AS names FROM ({_DOC_AUTHORS}) GROUP BY document_id)"
_NODES = f"""
SELECT DISTINCT 'chunk_' || position AS id, 'chunk_' || position AS label, 'chunk' AS kind, type AS chunk_type, keywords, names, journal, date, document_id::VARCHAR AS document FROM {_J} JOIN {_NAMES} USING (document_id)
UNION ALL SELECT DISTINCT document_id::VARCHAR, title, 'document', NULL, keywords, names, journal, date, document_id::VARCHAR FROM {_J} JOIN {_NAMES} USING (document_id)
UNION ALL SELECT DISTINCT 'journal_' || journal, journal, 'journal', NULL, NULL, NULL, NULL, NULL, NULL FROM {_J} WHERE journal <> ''
UNION ALL SELECT DISTINCT 'author_' || a, coalesce(s_name, 'author_' || a), 'author', NULL, NULL, NULL, NULL, NULL, NULL FROM {_J} JOIN ({_DOC_AUTHORS}) USING (document_id)
UNION ALL SELECT DISTINCT 'keyword_' || k, k, 'keyword', NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT unnest(keywords) AS k FROM {_J})"""
_EDGES = f"""
SELECT 'chunk_' || position AS source, document_id::VARCHAR AS target FROM {_J}
UNION ALL SELECT document_id::VARCHAR, 'journal_' || journal FROM {_J} WHERE journal <> ''
UNION ALL SELECT document_id::VARCHAR, 'author_' || a FROM {_J} JOIN ({_DOC_AUTHORS}) USING (document_id)
UNION ALL SELECT document_id::VARCHAR, 'keyword_' || k FROM (SELECT document_id, unnest(keywords) AS k FROM {_J})"""
_KW = "(kind NOT IN ('chunk','document','keyword') OR (kind = 'keyword' AND label = 'kw1') OR coalesce(list_contains(keywords, 'kw1'), false))"
_DATE = "(kind NOT IN ('chunk','document') OR coalesce(date BETWEEN '2011' AND '2013-12', false))"
_JN = "(kind NOT IN ('chunk','document','journal') OR (kind = 'journal' AND label = 'Journal 1') OR coalesce(kind <> 'journal' AND journal = 'Journal 1', false))"
_AU = "(kind NOT IN ('chunk','document','author') OR (kind = 'author' AND label = 'Supplier#2') OR coalesce(list_contains(names, 'Supplier#2'), false))"
_ALL = f"{_KW} AND {_DATE} AND {_JN}"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import retrieval as R

    top = nearest(spark, sf_dir).withColumnRenamed("label", "document_id").withColumn("content", F.lit(""))
    return R.context_chunks(top, "document_id", "content").select("position", "type", "document_id")


def documents(spark: SparkSession, sf_dir: str, named: DataFrame) -> DataFrame:
    """The documents of the named chunks; only their rows meet the authors."""
    rows = G.relevant(named, table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select(
        F.col("doc_id").alias("document_id"), F.concat(F.lit("Title "), "doc_id").alias("title"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("Journal "), F.col("doc_id") % 2)).alias("journal"),
        F.concat(F.lit("20"), F.lpad((10 + F.col("doc_id") % 10).cast("string"), 2, "0"), F.lit("-01")).alias("date"), F.array(F.concat(F.lit("kw"), F.col("doc_id") % 3), F.col("lang")).alias("keywords"),
        F.explode(F.array(F.col("doc_id") % 3 + 1, F.col("doc_id") % 2 + 200000)).alias("a"),
    )
    authors = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    joined = rows.join(authors, F.col("a") == F.col("s_suppkey"), "left")
    return joined.groupBy("document_id", "title", "journal", "date", "keywords").agg(F.array_sort(F.collect_list(F.struct(F.col("a").cast("string").alias("id"), F.col("s_name").alias("name")))).alias("authors"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = chunks(spark, sf_dir)
    rows = G.joined(c, documents(spark, sf_dir, c))
    return G.nodes(rows), G.edges(rows)


def _ids(condition):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _graph(spark, sf_dir)[0].where(condition()).select("id", "label", "kind")

    return run


@query(f"SELECT id, label, kind FROM ({_NODES})")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0].select("id", "label", "kind")


@query(_EDGES)
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


for _name, _sql, _condition in (
    ("graph_filter_type", "kind IN ('chunk','document')", lambda: G.facet(kinds=["chunk", "document"])),
    ("graph_filter_chunk_type", "kind <> 'chunk' OR chunk_type = 'table'", lambda: G.facet(chunk_types=["table"])),
    ("graph_filter_keyword", _KW, lambda: G.facet(keywords=["kw1"])),
    ("graph_filter_date", _DATE, lambda: G.facet(dates=("2011", "2013-12"))),
    ("graph_filter_document", "kind NOT IN ('chunk','document') OR document IN ('1','2')", lambda: G.facet(documents=["1", "2"])),
    ("graph_filter_journal", _JN, lambda: G.facet(journals=["Journal 1"])),
    ("graph_filter_author", _AU, lambda: G.facet(authors=["Supplier#2"])),
):
    _f = _ids(_condition)
    _f.__name__ = _name
    query(f"SELECT id, label, kind FROM ({_NODES}) WHERE {_sql}")(_f)


@query(f"WITH n AS (SELECT id FROM ({_NODES}) WHERE {_ALL}) SELECT source, target FROM ({_EDGES}) WHERE source IN (FROM n) AND target IN (FROM n)")
def graph_edges_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    return G.pruned_edges(e, n.where(G.facet(keywords=["kw1"], dates=("2011", "2013-12"), journals=["Journal 1"])))


@query(f"WITH n AS (SELECT id, label, kind FROM ({_NODES}) WHERE {_ALL}), e AS (SELECT * FROM ({_EDGES}) WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)) SELECT * FROM n WHERE id IN (SELECT source FROM e UNION SELECT target FROM e)")
def graph_nodes_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    return G.filtered(n, e, G.facet(keywords=["kw1"], dates=("2011", "2013-12"), journals=["Journal 1"]))[0].select("id", "label", "kind")


@query(f"WITH n AS (SELECT id, label FROM ({_NODES}) WHERE kind <> 'author'), e AS (SELECT * FROM ({_EDGES}) WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)) SELECT row_number() OVER (ORDER BY id) AS n, id, label FROM n WHERE id IN (SELECT source FROM e UNION SELECT target FROM e)")
def graph_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list beside the graph: nodes in the order of their ids as strings."""
    from pyspark.sql import Window

    n, e = _graph(spark, sf_dir)
    left = G.filtered(n, e, G.facet(kinds=["chunk", "document", "journal", "keyword"]))[0]
    return left.select(F.row_number().over(Window.orderBy("id")).cast("long").alias("n"), "id", "label")


@query(f"""SELECT array_to_string(list_sort(list(DISTINCT type)), ',') AS chunk_types, array_to_string(list_sort(list(DISTINCT document_id::VARCHAR)), ',') AS documents, array_to_string(list_sort(list(DISTINCT journal) FILTER (WHERE journal IS NOT NULL)), ',') AS journals,
  (SELECT array_to_string(list_sort(list(DISTINCT k)), ',') FROM (SELECT unnest(keywords) AS k FROM {_J})) AS keywords, min(date) AS first_date, max(date) AS last_date FROM {_J}""")
def facet_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    rows = G.facet_options(c, documents(spark, sf_dir, c))
    return rows.select(*[F.array_join(c, ",").alias(c) for c in ("chunk_types", "documents", "journals", "keywords")], "first_date", "last_date")


@query("SELECT page_id, '- Id : __' || page_id || '__' || chr(10) || '- Url : __' || url || '__' AS shown FROM pages")
def node_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", G.metadata_text(F.create_map(F.lit("id"), F.col("page_id").cast("string"), F.lit("url"), F.col("url"), F.lit("timeStamp"), F.lit("1"))).alias("shown"))
