"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bounds of one Arrow batch sent to a Python worker, so that long texts don't pile up.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir() + "/checkpoints"  # one machine, as in tests
    return f"{base.rstrip('/')}/lucidex/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Cuts the lineage without depending on any single executor, and gives the
    optimizer real sizes for the steps that follow.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    # The shuffles behind df are of no more use; their files go when the driver's JVM notices.
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def repeated_ids(df: DataFrame, key: str) -> bool:
    """Whether two rows share an id; reads the id column only."""
    return bool(df.groupBy(F.col(f"`{key}`").alias("k")).agg(F.count("*").alias("n")).where("n > 1").take(1))


def batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def by_value(module: str) -> None:
    """Ship a module's functions inside the task, so executors need not import this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def share(spark: SparkSession, value):
    """Broadcast a value of proven size together with its code."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(broadcast):
    return cloudpickle.loads(broadcast.value)


def text_bytes(array) -> list:
    """The UTF-8 bytes of an Arrow string array; None stays None."""
    import pyarrow as pa

    return array.cast(pa.large_binary()).to_pylist()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until df has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def first_of_groups(docs: DataFrame, rooted: DataFrame, key: str, text: str) -> DataFrame:
    """One row of docs for each root of rooted (doc, mark, root): that with the smallest id, then text hash; null ids come last.

    mark is xxhash64 of the text.  Rows that repeat both id and text are one row.
    """
    best = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "mark")).alias("best")
    kept = rooted.groupBy("root").agg(best).select(F.struct("best.doc", "best.mark").alias("place"))
    (place,) = fresh(docs, "place")
    # A struct is never null, so a null id is matched like any other.
    own = docs.withColumn(place, F.struct(F.col(f"`{key}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("mark")))
    rows = own.join(kept.withColumnRenamed("place", "kept"), F.col(f"`{place}`") == F.col("kept"), "left_semi")
    if repeated_ids(docs, key):
        rows = rows.dropDuplicates([place])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


by_value(__name__)
