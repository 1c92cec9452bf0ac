"""Retrieval queries: the chunks are `embeddings`, their documents `documents` with the same number.

The query vector is that of chunk 0.  Authors of document d are the suppliers
d % 97 + 1 and d % 89 + 1.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector
from ..operators import retrieval as R
from ..operators.dense import top_k_many
from ..operators.fulltext import Index
from ..sources.readers import file_signature
from ..sources.tables import shared_folder
from .registry import query, table

KEYWORDS = "the|und|que"
K = 10

_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_COS = f"SELECT vec_id, label, greatest(0.0, list_cosine_distance(embedding::DOUBLE[], q)) AS d FROM embeddings, {_Q} WHERE embedding IS NOT NULL"
_L2 = f"SELECT vec_id, label, list_distance(embedding::DOUBLE[], q) AS d FROM embeddings, {_Q} WHERE embedding IS NOT NULL"
_TOP = f"SELECT * FROM ({_COS}) ORDER BY d, vec_id LIMIT {K}"
_TERMS = "['the','und','que']"
_SPARSE = f"SELECT doc_id, round(0.1::DOUBLE * len(list_filter(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]+)', 1), lambda x: list_contains({_TERMS}, x))), 6) AS similarity FROM documents"


def query_vector(spark: SparkSession, sf_dir: str):
    """One row with the vector of chunk 0, as a literal."""
    return R.vector_literal(table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


def nearest(spark: SparkSession, sf_dir: str, k: int = K, metric: str = "cosine") -> DataFrame:
    return R.top_k(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), k, metric)


@query("SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL")
def embedded_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull()).select("vec_id", "label")


@query(f"SELECT vec_id, round(d, 9) AS distance FROM ({_COS})")
def chunk_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull())
    return rows.select("vec_id", F.round(vector.cosine_distance(F.col("embedding"), query_vector(spark, sf_dir)), 9).alias("distance"))


@query(f"SELECT vec_id, label, round(d, 9) AS distance FROM ({_TOP})")
def search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, sf_dir).select("vec_id", "label", F.round("distance", 9).alias("distance"))


@query(f"SELECT vec_id, label, round(d, 9) AS distance FROM ({_TOP})")
def dense_search_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, sf_dir, metric="cosine").select("vec_id", "label", F.round("distance", 9).alias("distance"))


@query(f"SELECT vec_id, label, round(d, 9) AS distance FROM ({_L2}) ORDER BY d, vec_id LIMIT {K}")
def dense_search_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, sf_dir, metric="euclidean").select("vec_id", "label", F.round("distance", 9).alias("distance"))


@query(f"SELECT vec_id, round(d, 9) AS distance, rank() OVER (ORDER BY d) AS rank FROM ({_TOP})")
def dense_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(nearest(spark, sf_dir), "distance").select("vec_id", F.round("distance", 9).alias("distance"), F.col("rank").cast("long").alias("rank"))


def text_index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of the documents, built where there is none of these very files."""
    source = f"{sf_dir}/documents.parquet"
    name = hashlib.sha256(source.encode()).hexdigest()[:16]
    return Index(spark, f"{shared_folder(spark)}/fulltext-{name}").fresh(table(spark, sf_dir, "documents").where("doc_id is not null"), file_signature(spark, source))


def sparse(spark: SparkSession, sf_dir: str, terms: str, n: int | None = None) -> DataFrame:
    index = text_index(spark, sf_dir)
    return (index.search(terms) if n is None else index.top(terms, n)).withColumnRenamed("doc", "doc_id")


@query(f"SELECT doc_id, similarity FROM ({_SPARSE}) WHERE similarity > 0")
def sparse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse(spark, sf_dir, KEYWORDS)


@query(f"SELECT doc_id, similarity, rank() OVER (ORDER BY similarity DESC) AS rank FROM (SELECT * FROM ({_SPARSE}) WHERE similarity > 0 ORDER BY similarity DESC, doc_id LIMIT 20)")
def sparse_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(sparse(spark, sf_dir, KEYWORDS, 20), "similarity", False).select("doc_id", "similarity", F.col("rank").cast("long").alias("rank"))


ALL_OF, PHRASE = ("the", "and", "of"), ("of", "the")
_HITS = r"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM (SELECT doc_id, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS w FROM (SELECT doc_id, regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1) AS t FROM documents))"
_LAST = ", ".join(f"max(i) FILTER (WHERE w = '{t}') OVER (PARTITION BY doc_id ORDER BY pos) AS l{k}" for k, t in enumerate(ALL_OF))


@query(f"""
WITH h AS ({_HITS} WHERE w IN {ALL_OF}), l AS (SELECT *, {_LAST} FROM h),
c AS (SELECT doc_id, pos, i, least(l0, l1, l2) AS first FROM l WHERE l0 IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL),
k AS (SELECT *, coalesce(lag(first) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS before FROM c)
SELECT k.doc_id, round(sum(0.1::DOUBLE / (1 + (k.pos - h.pos) - (k.i - first))), 6) AS similarity FROM k JOIN h ON h.doc_id = k.doc_id AND h.i = k.first WHERE first > before GROUP BY k.doc_id""")
def sparse_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all terms, ranked by their covers."""
    return sparse(spark, sf_dir, " & ".join(ALL_OF))


@query(f"WITH h AS ({_HITS}) SELECT a.doc_id, round(0.1::DOUBLE * count(*), 6) AS similarity FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 AND a.w = '{PHRASE[0]}' AND b.w = '{PHRASE[1]}' GROUP BY a.doc_id")
def sparse_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the terms one after the other."""
    return sparse(spark, sf_dir, " <-> ".join(PHRASE))


@query(r"SELECT w AS term, doc_id AS doc, count(*) AS n, min(pos) AS first FROM (SELECT doc_id, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS w FROM (SELECT doc_id, regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1) AS t FROM documents)) GROUP BY ALL")
def sparse_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole index: each term's documents."""
    rows = text_index(spark, sf_dir).tables.read("postings")
    return rows.select("term", "doc", F.col("n").cast("long").alias("n"), F.col("positions")[0].cast("long").alias("first"))


@query(f"""
WITH dense AS (SELECT vec_id AS doc_id, rank() OVER (ORDER BY d) AS rank FROM (SELECT * FROM ({_COS}) ORDER BY d, vec_id LIMIT 20)),
sparse AS (SELECT doc_id, rank() OVER (ORDER BY similarity DESC) AS rank FROM (SELECT * FROM ({_SPARSE}) WHERE similarity > 0 ORDER BY similarity DESC, doc_id LIMIT 20))
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM dense UNION ALL SELECT * FROM sparse) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = R.ranked(nearest(spark, sf_dir, 20), "distance").withColumnRenamed("vec_id", "doc_id")
    return R.fuse([dense, R.ranked(sparse(spark, sf_dir, KEYWORDS, 20), "similarity", False)], "doc_id", 10)


@query(f"SELECT vec_id, d.doc_id, d.lang, round(d, 9) AS distance FROM ({_TOP}) t JOIN documents d ON d.doc_id = t.vec_id")
def search_with_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    top = nearest(spark, sf_dir)
    return documents.join(top, F.col("doc_id") == F.col("vec_id")).select("vec_id", "doc_id", "lang", F.round("distance", 9).alias("distance"))


_AUTHORS = "SELECT doc_id, list(s_name ORDER BY pos) FILTER (WHERE s_name IS NOT NULL) AS names FROM (SELECT doc_id, 0 AS pos, doc_id % 97 + 1 AS a FROM documents UNION ALL SELECT doc_id, 1, doc_id % 89 + 1 FROM documents) LEFT JOIN supplier ON s_suppkey = a GROUP BY doc_id"


def author_links(spark: SparkSession, sf_dir: str, documents: DataFrame) -> DataFrame:
    """(doc_id, pos, a) author numbers of documents."""
    return documents.select("doc_id", F.posexplode(F.array(F.col("doc_id") % 97 + 1, F.col("doc_id") % 89 + 1)).alias("pos", "a"))


@query(f"SELECT vec_id, coalesce(array_to_string(names, ', '), '') AS authors FROM ({_TOP}) t LEFT JOIN ({_AUTHORS}) n ON n.doc_id = t.vec_id")
def search_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = nearest(spark, sf_dir).select("vec_id")
    links = author_links(spark, sf_dir, top.withColumnRenamed("vec_id", "doc_id"))
    authors = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    names = links.join(authors, F.col("a") == F.col("s_suppkey"), "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("s_name").isNotNull(), F.struct("pos", "s_name")))).alias("n"))
    return names.select(F.col("doc_id").alias("vec_id"), F.array_join(F.transform("n", lambda x: x["s_name"]), ", ").alias("authors"))


@query(f"SELECT row_number() OVER (ORDER BY d, vec_id) - 1 AS position, 'text' AS type, text AS content, round(d, 9) AS score, doc_id AS document_id, -1 AS page FROM ({_TOP}) t JOIN documents ON doc_id = vec_id")
def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    top = nearest(spark, sf_dir).join(documents, F.col("doc_id") == F.col("vec_id"))
    return R.context_chunks(top, "doc_id", "content").withColumn("position", F.col("position").cast("long"))


@query(f"SELECT label AS document_id, min(pos) AS first_position, count(*) AS n_chunks FROM (SELECT label, row_number() OVER (ORDER BY d, vec_id) - 1 AS pos FROM ({_TOP})) GROUP BY label")
def context_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = nearest(spark, sf_dir).select("vec_id", "label", "distance")
    rows = R.context_chunks(top.withColumn("content", F.lit("")), "label", "content")
    return rows.groupBy("document_id").agg(F.min("position").cast("long").alias("first_position"), F.count("*").alias("n_chunks"))


@query("SELECT vec_id, vec_id // 100 AS batch FROM embeddings")
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 100).alias("batch"))


@query("SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND trim(text) <> ''")
def embeddable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.embeddable(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id")


@query()
def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return R.embed_passages(rows, R.HashingEmbedder).select("doc_id", "embedding")


def _each(prompts: str, metric: str, name: str) -> str:
    """The K nearest rows of each prompt (id, q)."""
    d = "greatest(0.0, list_cosine_distance(e.embedding::DOUBLE[], p.q))" if metric == "cosine" else "list_distance(e.embedding::DOUBLE[], p.q)"
    return f"SELECT {name}, vec_id, d AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY {name} ORDER BY d, vec_id) AS rank FROM (SELECT p.id AS {name}, e.vec_id, round({d}, 9) AS d FROM embeddings e, ({prompts}) p WHERE e.embedding IS NOT NULL)) WHERE rank <= {K}"


def _long_rank(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


@query(_each("SELECT label AS id, arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings GROUP BY label", "cosine", "topic"))
def search_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest chunks of every prompt; a topic's prompt has the vector of its first chunk."""
    rows = table(spark, sf_dir, "embeddings")
    prompts = rows.groupBy(F.col("label").alias("topic")).agg(F.min_by("embedding", "vec_id").alias("query"))
    return _long_rank(top_k_many(rows, prompts, K, query="topic"))


_EVERY_20TH = "SELECT vec_id AS id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL"


def search_many(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return _long_rank(top_k_many(rows, asked, K, metric))


@query(_each(_EVERY_20TH, "cosine", "query_id"))
def search_many_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of every row whose id is divisible by 20, among all rows."""
    return search_many(spark, sf_dir, "cosine")


@query(_each(_EVERY_20TH, "euclidean", "query_id"))
def search_many_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_many(spark, sf_dir, "euclidean")
