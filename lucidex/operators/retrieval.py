"""Dense, sparse and fused top-k retrieval, and the context of its results."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector
from .dense import top_k_many

RRF_ALPHA = 60
#: Weight of one hit in cover-density rank for a query of alternatives.
HIT_WEIGHT = 0.1
MODEL_BATCH = 32


def vector_literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def top_k(chunks: DataFrame, query: Column, k: int = 10, metric: str = "cosine", key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest rows with distance, null vectors left out, ties by key.

    One pass; each task keeps k rows (TakeOrderedAndProject), so nothing but
    k rows a task moves.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    rows = chunks.where(F.col(embedding).isNotNull()).withColumn("distance", vector.distance(metric, F.col(embedding), query))
    return rows.orderBy(F.col("distance").asc_nulls_last(), F.col(key)).limit(k)


def ranked(rows: DataFrame, score: str, ascending: bool = True, name: str = "rank") -> DataFrame:
    """rank() over a result that has already been cut to its top; a single small partition."""
    return rows.withColumn(name, F.rank().over(Window.orderBy(F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last())))


def tokens(text: Column) -> Column:
    """Lower-case words in order, the sparse vector of a text (word positions are list positions)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def query_terms(query: str) -> list[str]:
    """Alternatives between bars or spaces, lower case, each once."""
    return list(dict.fromkeys(t.strip().lower() for t in query.replace("|", " ").split()))


def sparse_scores(texts: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rows that hold any term, with similarity: a weight for each occurrence."""
    terms = F.array(*[F.lit(t) for t in query_terms(query)])
    hits = F.size(F.filter(tokens(F.col(text)), lambda t: F.array_contains(terms, t)))
    return texts.withColumn("_hits", hits).where("_hits > 0").withColumn("similarity", F.round(HIT_WEIGHT * F.col("_hits"), 6)).drop("_hits")


def sparse_top(texts: DataFrame, query: str, n: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    return sparse_scores(texts, query, text).orderBy(F.desc("similarity"), F.col(key)).limit(n)


def fuse(lists: list[DataFrame], key: str, n: int = 5, alpha: int = RRF_ALPHA, content: str | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists; the first list that has a row gives its content."""
    parts = [x.select(F.col(key), (F.lit(1.0) / (alpha + F.col("rank"))).alias("part"), F.lit(i).alias("source"), *([F.col(content)] if content else [])) for i, x in enumerate(lists)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    first = [F.min_by(content, "source").alias(content)] if content else []
    return union.groupBy(key).agg(F.round(F.sum("part"), 9).alias("score"), *first).orderBy(F.desc("score"), key).limit(n)


class HashingEmbedder:
    """Deterministic stand-in for a sentence model: signed word hashes, unit length.

    The prefixes keep queries and passages apart as the model would see them.
    """

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for text in texts:
            v = [0.0] * self.dimension
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.dimension] += 1.0 if h >> 31 else -1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm if norm else 0.0 for x in v])
        return out


def embed_query(text: str, model) -> list[float]:
    if not text.strip():
        raise ValueError("the query is empty")
    return model.embed([f"query: {text.strip()}"])[0]


def embed_passages(rows: DataFrame, model: Callable, text: str = "content", out: str = "embedding", kind: str = "passage") -> DataFrame:
    """rows with the vectors of non-blank texts, trimmed queries or passages; model() is made once per worker."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = model()
        for part in parts:
            own = [x.strip() if x and kind == "query" else x for x in part]
            own = [x if x and x.strip() else None for x in own]
            todo = [f"{kind}: {x}" for x in own if x]
            vectors = iter([v for i in range(0, len(todo), MODEL_BATCH) for v in made.embed(todo[i : i + MODEL_BATCH])])
            yield pd.Series([next(vectors) if x else None for x in own])

    return rows.withColumn(out, run(F.col(text)))


def narrative_prompts(prompts: DataFrame, wanted: list[str], keyword: str = "keyword") -> DataFrame:
    """The prompts of the wanted narratives; unknown ones are an error that names what there is."""
    known = sorted(r[0] for r in prompts.select(keyword).distinct().collect())  # narratives are few, kept by hand
    if missing := [w for w in wanted if w not in known]:
        raise ValueError(f"unknown narrative: {', '.join(missing)}; there are {', '.join(known)}")
    return prompts.where(F.col(keyword).isin(wanted))


def search_prompts(chunks: DataFrame, prompts: DataFrame, model: Callable, k: int = 10, keyword: str = "keyword", prompt: str = "prompt") -> DataFrame:
    """(keyword, vec_id, distance, rank): the nearest chunks of each prompt's text, for any number of prompts."""
    asked = embed_passages(prompts, model, prompt, "query", "query")
    return top_k_many(chunks, asked, k, query=keyword)


def embeddable(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Stored rows with a text that isn't blank."""
    return rows.where(F.col(key).isNotNull() & (F.regexp_replace(text, r"(?U)\s+", "") != ""))


def context_chunks(top: DataFrame, document: str, content: str) -> DataFrame:
    """Rank order, and the chunk as callers see it: the score is the distance, the page is unknown."""
    order = Window.orderBy(F.col("distance").asc_nulls_last(), F.col("vec_id"))
    return top.select((F.row_number().over(order) - 1).alias("position"), F.lit("text").alias("type"), F.col(content).alias("content"), F.round("distance", 9).alias("score"), F.col(document).alias("document_id"), F.lit(-1).alias("page"))


# Functions travel inside the tasks, so workers need not import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
