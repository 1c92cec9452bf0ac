"""The pipeline's stages one after another against their operators' brute force."""

from __future__ import annotations

import brute
import corpus_pipeline
from pyspark.sql import functions as F
from test_near_copies import survivors

from lucidex.llm import hash_tree


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert rows.items() <= before.items(), name
        gone = set(before) - set(rows)
        if name == "quality_rules":
            assert {d for d, t in before.items() if brute.quality_counts(t)[-1]} <= gone
        if name == "near_duplicates":
            assert set(rows) == survivors(before.items())
        if name == "decontamination":
            assert gone == {r[0] for r in brute.contamination(before.items(), items) if r[5]}
        if name == "mixing":
            toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
            assert len(gone & toxic) >= 0.5 * len(set(before) & toxic)
        if name == "sharding":
            assert docs.columns == [*columns, "shard"] and not gone
            want = docs.select("shard", hash_tree.descend(hash_tree.key_text(F.col("doc_id")), hash_tree.balanced(8)).alias("s"))
            assert want.where("shard <> s").count() == 0
        else:
            assert docs.columns == columns
        before = rows


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.collect() == []


def test_stages_on_nulls(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 0), (None, "word " * 30, None, "a", 5)], schema)
    for name, stage in corpus_pipeline.STAGES:
        own = stage(spark, docs, sf)
        assert own.count() <= 3, name
