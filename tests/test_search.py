"""Stored full-text index, block search and table versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidex.operators import dense, fulltext, retrieval
from lucidex.sources import readers, tables


@pytest.fixture
def index(spark, tmp_path):
    return fulltext.Index(spark, str(tmp_path / "index"))


def texts(spark, rows):
    return spark.createDataFrame(list(rows.items()) if isinstance(rows, dict) else rows, "doc_id long, text string")


def ranks(df):
    return {r["doc"]: r["similarity"] for r in df.collect()}


DOCS = {1: "a b b", 2: "a x b y a", 3: "b a a b", 4: "", 5: None, 6: "A-b. a", 7: "c c c"}


def test_ranks(spark, index):
    index.add(texts(spark, DOCS))
    assert ranks(index.search("a|b")) == {1: 0.3, 2: 0.3, 3: 0.4, 6: 0.3}
    assert ranks(index.search("a b c")) == {1: 0.3, 2: 0.3, 3: 0.4, 6: 0.3, 7: 0.3}
    # Covers: 1 one; 2 two with a word inside; 3 two; 6 two.
    assert ranks(index.search("a & b")) == {1: 0.1, 2: 0.1, 3: 0.2, 6: 0.2}
    assert ranks(index.search("a <-> b")) == {1: 0.1, 3: 0.1, 6: 0.1}
    assert ranks(index.search("a <-> a")) == {3: 0.1}
    assert ranks(index.search("a & a")) == ranks(index.search("a"))
    assert ranks(index.search("a & zz")) == {} and ranks(index.search("zz")) == {}
    assert [tuple(r) for r in index.top("a|b", 2).collect()] == [(3, 0.4), (1, 0.3)]


def plain_covers(words, terms):
    """Shortest runs that hold all terms, by looking at all runs."""
    hits = [(i, w) for i, w in enumerate(words) if w in terms]
    full = [(a, b) for a in range(len(hits)) for b in range(a, len(hits)) if {w for _, w in hits[a : b + 1]} == set(terms)]
    least = [r for r in full if not any(o != r and r[0] <= o[0] and o[1] <= r[1] for o in full)]
    return round(sum(0.1 / (1 + hits[b][0] - hits[a][0] - (b - a)) for a, b in least), 6)


def test_covers_against_all_runs(spark, index):
    rng = random.Random(4)
    rows = {i: " ".join(rng.choice("abcxyz") for _ in range(rng.randrange(0, 25))) for i in range(60)}
    index.add(texts(spark, rows))
    for terms in (["a", "b"], ["c", "a", "b"]):
        want = {i: s for i, t in rows.items() if (s := plain_covers(t.split(), terms))}
        assert ranks(index.search(" & ".join(terms))) == want


@pytest.mark.parametrize("bad", ["", " ", "a &", "& a", "a b & c", "a & b | c", "a <-> b & c"])
def test_bad_queries(bad):
    with pytest.raises(ValueError):
        fulltext.parsed(bad)


def test_index_grows_and_is_not_built_twice(spark, index):
    index.add(texts(spark, {1: "a b", 2: "b"}))
    index.add(texts(spark, {2: "a a a a", 3: "a"}))  # 2 is there already
    assert ranks(index.search("a")) == {1: 0.1, 3: 0.1}
    before = index.tables.state()["version"]
    index.fresh(texts(spark, {9: "a"}), "one").fresh(texts(spark, {8: "a"}), "one")
    assert index.tables.state()["version"] == before + 1 and ranks(index.search("a")) == {9: 0.1}
    index.add(texts(spark, []))
    assert ranks(index.search("a")) == {9: 0.1}


def test_search_opens_only_its_buckets(spark, index):
    index.add(texts(spark, {i: " ".join(f"w{j}" for j in range(i, i + 40)) for i in range(50)}))
    plan = index.of_terms(["w7"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and f"bucket#" in plan and "In(term" in plan.replace("EqualTo(term,w7)", "In(term")
    files = {r[0] for r in index.of_terms(["w7"]).select(F.input_file_name()).collect()}
    assert len(files) == 1 and f"/bucket={fulltext.bucket_of('w7')}/" in files.pop()


# Versions


def test_versions(spark, tmp_path):
    store = tables.Tables(spark, str(tmp_path / "set"))
    start = store.state()
    one = {"x": store.write("x", spark.range(3)), "y": store.write("y", spark.range(2))}
    first = store.commit(start, one, {"k": 1})
    assert store.read("x").count() == 3 and store.read("z") is None
    # Two writers from one version: the second fails and nothing of it is seen.
    late = {"x": store.write("x", spark.range(9), after=first["tables"]["x"])}
    store.commit(first, {"y": store.write("y", spark.range(7))})
    with pytest.raises(tables.ConcurrentCommit):
        store.commit(first, late)
    assert store.read("x").count() == 3 and store.read("y").count() == 7 and store.state()["notes"] == {"k": 1}
    assert store.read("y", first).count() == 2  # an older version can still be read
    for _ in range(tables.KEPT_MARKERS + 3):
        store.commit(store.state(), {})
    assert len(store._markers()) == tables.KEPT_MARKERS and store.read("x").count() == 3


def test_signature(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    one = readers.file_signature(spark, str(tmp_path / "t"))
    assert one == readers.file_signature(spark, str(tmp_path / "t"))
    spark.range(5).write.mode("append").parquet(str(tmp_path / "t"))
    assert one != readers.file_signature(spark, str(tmp_path / "t"))


# Many queries


def plain_nearest(rows, q, k, metric):
    def d(v):
        a, b = np.array(q, float), np.array(v, float)
        if metric == "euclidean":
            return round(float(np.linalg.norm(a - b)), 9)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(max(0.0, 1 - float(a @ b) / n), 9) if n else float("inf")

    found = sorted((d(v), i) for i, v in rows if v is not None)[:k]
    return [(i, None if x == float("inf") else x, r + 1) for r, (x, i) in enumerate(found)]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("block", [60, 1 << 20])
def test_many_queries(spark, monkeypatch, metric, block):
    monkeypatch.setattr(dense, "QUERIES", 3)
    monkeypatch.setattr(dense, "ROWS", 7)
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.0, 1.0, 2.5]) for _ in range(3)] if i % 11 else None) for i in range(90)] + [(90, [0.0, 0.0, 0.0])]
    asked = [(f"q{i}", v) for i, v in rows[::9]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame(asked, "query_id string, query array<float>")
    found = {}
    for r in dense.top_k_many(df, queries, 4, metric, block_bytes=block).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["distance"], r["rank"]))
    assert found == {q: plain_nearest(rows, v, 4, metric) for q, v in asked if v is not None}


def test_many_queries_odd_cases(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "vec_id long, embedding array<float>")
    none = spark.createDataFrame([], "query_id long, query array<float>")
    assert dense.top_k_many(df, none).collect() == [] and dense.top_k_many(df.limit(0), df.toDF("query_id", "query")).collect() == []
    with pytest.raises(ValueError):
        dense.top_k_many(df, df.toDF("query_id", "query"), 0)
    with pytest.raises(NotImplementedError):
        dense.top_k_many(df, df.toDF("query_id", "query"), metric="manhattan")
    with pytest.raises(Exception, match="dimensions"):
        dense.top_k_many(df, spark.createDataFrame([(1, [1.0])], "query_id long, query array<float>")).collect()


def test_prompts(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["vaccines and autism", "air and water", "autism studies"])], "vec_id long, content string")
    chunks = retrieval.embed_passages(rows, retrieval.HashingEmbedder)
    prompts = spark.createDataFrame([("autism", " autism studies "), ("air", "air"), ("blank", " ")], "keyword string, prompt string")
    found = retrieval.search_prompts(chunks, retrieval.narrative_prompts(prompts, ["autism", "blank"]), retrieval.HashingEmbedder, 1).collect()
    assert [(r["keyword"], r["vec_id"]) for r in found] == [("autism", 2)]
    with pytest.raises(ValueError, match="unknown narrative: x; there are air, autism, blank"):
        retrieval.narrative_prompts(prompts, ["x"])


def test_postings_without_a_shuffle(spark):
    """Words are grouped in their row; repeated keys, empty and null texts and wide letters are as in a grouping of all."""
    from lucidex.operators import fulltext

    texts = [(1, "b a b É_1 😀 b"), (2, ""), (3, None), (4, "a"), (5, "... --")]
    plain = lambda rows: sorted((t, d, [i + 1 for i, w in enumerate(x.lower().split()) if w == t]) for d, x in rows for t in set(x.lower().split()))
    own = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    found = fulltext.postings(own)
    assert "Exchange" not in found.select("term")._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    want = plain([(1, "b a b é_1 - b"), (4, "a")])
    # The emoji is no word, so what follows it moves up.
    want = sorted((t, d, [p - (d == 1 and p > 5) for p in ps]) for t, d, ps in want if t != "-")
    assert sorted((r["term"], r["doc"], r["positions"]) for r in found.collect()) == want
    twice = fulltext.postings(spark.createDataFrame([(1, "a b"), (1, "c a")], "doc_id long, text string").repartition(2))
    assert sorted((r["term"], r["doc"], r["positions"]) for r in twice.collect()) == [("a", 1, [1, 2]), ("b", 1, [2]), ("c", 1, [1])]
