"""Nearest rows of many query vectors at once, exactly, block by block.

The rows never move: the queries go to the tasks in blocks of BLOCK_BYTES at
most, one pass over the rows for each block, and a task measures its batches
of rows against the block (for cosine by one matrix product) and keeps k rows
for each query.  The tasks' partial
results, k rows a query and task, are merged by a ranking.  So memory follows
the block and the batch, whatever the numbers of queries and rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of query vectors that are sent to the tasks at once.
BLOCK_BYTES = 32 << 20
#: Queries and rows of one product.
QUERIES, ROWS = 256, 8192
#: Distances are rounded to so many digits before they are compared, so that equal vectors tie whatever the blocks.
DIGITS = 9
METRICS = ("cosine", "euclidean")


def matrix(vectors, dimension: int | None = None):
    """Rows x dimension matrix of an Arrow list array; null vectors and elements are NaN.

    Without a dimension the vectors have that of the first.
    """
    import numpy as np
    import pyarrow as pa

    vectors = vectors.cast(pa.list_(pa.float64()))
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    there = sizes >= 0
    if dimension is None:
        dimension = int(sizes[there][0]) if there.any() else 0
    if (sizes[there] != dimension).any():
        raise ValueError("vectors of different dimensions")
    out = np.full((len(sizes), dimension), np.nan)
    out[there] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(int(there.sum()), dimension)
    return out


def distances(metric: str, queries, rows):
    """Matrix of rounded distances; infinite where they aren't defined."""
    import numpy as np

    with np.errstate(all="ignore"):
        if metric == "cosine":
            out = np.maximum(1 - queries @ rows.T / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None]), 0)
        else:  # squares of products would lose the digits of small distances
            out = np.array([np.linalg.norm(rows - q, axis=1) for q in queries]).reshape(len(queries), len(rows))
    return np.where(np.isnan(out), np.inf, np.round(out, DIGITS))


def nearest(dist, keys, k: int) -> list:
    """For each row of dist the places of its k least, ties by key."""
    import numpy as np

    k = min(k, dist.shape[1])
    bound = np.partition(dist, k - 1, axis=1)[:, k - 1]
    out = []
    for row, b in zip(dist, bound, strict=True):
        at = np.flatnonzero(row <= b)
        out.append(at[np.lexsort((keys[at], row[at]))[:k]])
    return out


def _block(rows: DataFrame, key: str, vector: str):
    """Ids (Arrow) and matrix of one block of queries, of bounded size."""
    own = rows.select(key, vector).toArrow()
    ids, vectors = own[key].combine_chunks(), own[vector].combine_chunks()
    return ids, matrix(vectors)


def top_k_many(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", key: str = "vec_id", embedding: str = "embedding", query: str = "query_id", vector: str = "query", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query, key, distance, rank): the k nearest rows of each query, ties by key.

    Null vectors, of rows or queries, are left out; rows without a distance (a
    zero vector under cosine) come last with null.  Keys and query ids must be
    unique.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if metric not in METRICS:
        raise NotImplementedError(f"unknown distance: {metric}")
    own = rows.where(F.col(embedding).isNotNull()).select(F.col(key).alias("k"), F.col(embedding).alias("e"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    blocks = max(1, -(-size["n"] * size["d"] * 8 // block_bytes))
    schema = T.StructType([T.StructField("q", asked.schema["q"].dataType), T.StructField("k", own.schema["k"].dataType), T.StructField("distance", T.DoubleType())])
    number = F.pmod(F.xxhash64("q"), F.lit(blocks))
    parts = [_partial(own, asked if blocks == 1 else asked.where(number == b), k, metric, schema) for b in range(blocks)]
    order = Window.partitionBy("q").orderBy(F.col("distance").asc_nulls_last(), "k")
    merged = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.select(F.col("q").alias(query), F.col("k").alias(key), "distance", "rank")


def _partial(own: DataFrame, block: DataFrame, k: int, metric: str, schema: T.StructType) -> DataFrame:
    """The k nearest rows of each of the block's queries in each task."""
    ids, asked = _block(block, "q", "v")
    sent = own.sparkSession.sparkContext.broadcast(cloudpickle.dumps((ids, asked)))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ids, asked = cloudpickle.loads(sent.value)
        best = None
        for whole in batches:
            for at in range(0, whole.num_rows if len(asked) else 0, ROWS):
                batch = whole.slice(at, ROWS)
                data, keys = matrix(batch["e"], asked.shape[1]), batch["k"].to_numpy(zero_copy_only=False)
                new = []
                for i in range(0, len(asked), QUERIES):
                    part = distances(metric, asked[i : i + QUERIES], data)
                    for j, places in enumerate(nearest(part, keys, k)):
                        d, x = part[j, places], keys[places]
                        if best is not None:
                            d, x = np.concatenate([best[i + j][0], d]), np.concatenate([best[i + j][1], x])
                            order = np.lexsort((x, d))[:k]
                            d, x = d[order], x[order]
                        new.append((d, x))
                best = new
        if best:
            sizes = [len(d) for d, _ in best]
            d = np.concatenate([d for d, _ in best])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(best)), sizes))), pa.array(np.concatenate([x for _, x in best])), pa.array(d, mask=np.isinf(d))], names=["q", "k", "distance"])

    return own.mapInArrow(run, schema)


# Functions travel inside the tasks, so workers need not import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
