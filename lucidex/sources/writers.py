"""Sinks: results as tables, files and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Chunks of one answer at most.
ANSWER_ROWS = 10_000


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table doesn't hold."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df.dropDuplicates([key]).write.mode("append").parquet(path)


def chunk_table(df: DataFrame, path: str, document: str = "document_id", buckets: int = 256) -> None:
    """Chunks in folders of documents, so that one document's rewrite touches one folder."""
    df.withColumn("bucket", F.pmod(F.xxhash64(document), F.lit(buckets))).write.mode("append").partitionBy("bucket").parquet(path)


def report_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """A summary as one CSV file with a fixed list of columns; absent ones are blank."""
    columns = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields]
    df.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def per_document_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def snapshots(df: DataFrame, path: str, raw: str, processed: str, config: str) -> None:
    """Raw and processed text side by side, a folder per configuration."""
    df.select("filename", config, F.col(processed).alias("text"), F.col(raw).alias("raw"), F.col(processed).alias("processed")).write.mode("overwrite").partitionBy(config).parquet(path)


def answer(narrative: str, chunks: DataFrame, documents: DataFrame, authors: DataFrame) -> DataFrame:
    """One JSON string {status, narrative, chunks, documents, authors}; chunks in rank order.

    An answer is for a page: more than ANSWER_ROWS chunks are an error.
    """
    if chunks.limit(ANSWER_ROWS + 1).count() > ANSWER_ROWS:
        raise ValueError(f"more than {ANSWER_ROWS} chunks in an answer")
    ranked = chunks.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "type", "content", "score", F.struct("document_id", "page").alias("metadata")))), lambda c: c.dropFields("position")).alias("chunks"))
    docs = documents.agg(F.map_from_entries(F.collect_list(F.struct(F.col("document_id").cast("string"), F.struct(*[c for c in documents.columns])))).alias("documents"))
    people = authors.agg(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), F.struct("name", "orcid")))).alias("authors"))
    one = ranked.withColumn("k", F.lit(1)).join(docs.withColumn("k", F.lit(1)), "k").join(people.withColumn("k", F.lit(1)), "k")  # one row each
    return one.select(F.to_json(F.struct(F.lit("success").alias("status"), F.lit(narrative).alias("narrative"), "chunks", "documents", "authors")).alias("answer"))


def unknown_narrative(keyword: str, known: list[str]) -> dict:
    return {"status": "error", "message": f"unknown narrative: {keyword}", "available": sorted(known)}


def contribution(authors: Column, **fields: Column) -> Column:
    """JSON of a contribution; author rows with a name or a surname stay."""
    kept = F.filter(authors, lambda a: (F.coalesce(a["name"], F.lit("")) != "") | (F.coalesce(a["surname"], F.lit("")) != ""))
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()], kept.alias("authors")))


def sparse_vector(text: Column) -> Column:
    """term -> 1-based positions, the stored form for full-text search."""
    from ..operators.retrieval import tokens

    own = tokens(text)
    terms = F.array_distinct(own)
    return F.map_from_arrays(terms, F.transform(terms, lambda t: F.filter(F.transform(own, lambda w, i: F.when(w == t, i + 1)), lambda p: p.isNotNull())))


def per_format(df: DataFrame, path: str, key: str, formats: dict[str, str]) -> None:
    """Each document in several formats: a folder a format, a text row a document; formats maps names to columns."""
    for name, column in formats.items():
        df.select(F.col(key), F.col(column).alias("value")).write.mode("overwrite").parquet(f"{path}/{name}")
