"""Managed tables, bucketed and sorted by the key that they are joined on.

Tables with the same number of buckets on their join keys are joined without
an exchange: the work of dealing rows by key is done once, when they are
written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def create(df: DataFrame, name: str, key: str, buckets: int = BUCKETS, replace: bool = False) -> None:
    """df as the managed table name; an existing one is an error unless it is to be replaced."""
    # Rows of a bucket meet in one task first, so that a bucket is one file.
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).mode("overwrite" if replace else "errorifexists").saveAsTable(name)


def append(df: DataFrame, name: str, key: str, buckets: int = BUCKETS) -> None:
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).mode("append").saveAsTable(name)


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def query(spark: SparkSession, sql: str, **values) -> DataFrame:
    """A SQL statement over the tables; values fill its named parameters."""
    return spark.sql(sql, args=values)
