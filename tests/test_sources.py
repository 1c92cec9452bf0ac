"""Text cache, provider source, managed tables, rendering and small reports."""

from __future__ import annotations

import asyncio
import json
import logging
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lucidex.functions import tracking
from lucidex.operators import contributions, layout, records, rendering, reports
from lucidex.sources import managed, providers, providers_source, readers, writers


def test_second_update_reads_no_content(spark, tmp_path, monkeypatch):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    (folder / "b.txt").write_text("two")
    cache, opened = records.TextCache(spark, str(tmp_path / "cache")), []
    apply = readers.Extractors.apply

    def counted(self, files, kind):
        opened.append(sorted(os.path.basename(r["name"]) for r in files.select("name").collect()))
        return apply(self, files, kind)

    monkeypatch.setattr(readers.Extractors, "apply", counted)
    found = lambda df: {os.path.basename(r["path"]): (r["text"], r["status"]) for r in df.collect()}
    update = lambda: found(cache.update(str(folder), readers.Extractors()))
    assert update() == {"a.txt": ("one", "success"), "b.txt": ("two", "success")}
    version = cache.tables.state()["version"]
    assert update() == {"a.txt": ("one", "success (cached)"), "b.txt": ("two", "success (cached)")}
    assert opened == [["a.txt", "b.txt"]] and cache.tables.state()["version"] == version
    # A changed file and a new one are read; the others aren't.
    (folder / "a.txt").write_text("changed")
    os.utime(folder / "a.txt", (2_000_000_000, 2_000_000_000))
    (folder / "c.txt").write_text("three")
    assert update() == {"a.txt": ("changed", "success"), "b.txt": ("two", "success (cached)"), "c.txt": ("three", "success")}
    assert opened[1:] == [["a.txt", "c.txt"]]


def test_failures_and_missing_rows(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_text("x")
    made = readers.Extractors()

    def broken(content):
        raise ValueError("no pages")

    made.register("broken", broken)
    row = records.TextCache(spark, str(tmp_path / "cache")).update(str(tmp_path / "files"), made, "broken").first()
    assert row["status"] == "error" and "no pages" in row["error"] and "in broken" in row["error"]
    rows = spark.createDataFrame([("a", 0.5, "success")], "name string, score double, status string")
    every = spark.createDataFrame([("a",), ("b",)], "name string")
    assert sorted(map(tuple, records.with_missing(rows, every, ["name"], {"score": 0.0}).collect())) == [("a", 0.5, "success"), ("b", 0.0, "missing")]


HAL = json.dumps({"title_s": ["A title"], "authFullName_s": ["Ann"], "docType_s": "ART"})


@pytest.fixture
def server():
    asked, failing = [], {"10.1/flaky": 2}

    class Answers(BaseHTTPRequestHandler):
        def do_GET(self):
            provider, doi = unquote(self.path).strip("/").split("/", 1)
            asked.append((provider, doi))
            code = 404 if "none" in doi else 400 if "bad" in doi else 200
            if failing.get(doi, 0):
                failing[doi] -= 1
                code = 503
            self.send_response(code)
            self.end_headers()
            self.wfile.write(HAL.encode() if code == 200 else b"")

        def log_message(self, *args):
            pass

    own = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}/{{provider}}/{{doi}}", asked
    own.shutdown()


def ask(spark, endpoint, dois, **options):
    providers_source.register(spark)
    return spark.read.format("lucidex_providers").options(endpoint=endpoint, dois=json.dumps(dois), pause="0.01", **options).load()


def test_provider_source(spark, server):
    endpoint, asked = server
    dois = ["10.1/a", "10.1/flaky", "10.1/none", "10.1/bad", " 10.1/a ", ""]
    df = ask(spark, endpoint, dois, providers="hal", batch="2")
    assert df.rdd.getNumPartitions() == 2
    rows = {r["doi"]: (r["body"], r["error"]) for r in df.collect()}
    assert rows == {"10.1/a": (HAL, None), "10.1/flaky": (HAL, None), "10.1/none": (None, None), "10.1/bad": (None, "HTTP 400")}
    # The same record as from landed answers.
    landed = spark.createDataFrame([("10.1/a", "hal", HAL)], "doi string, provider string, body string")
    live = ask(spark, endpoint, ["10.1/a"], providers="hal").select("doi", "provider", "body")
    assert providers.merged(live).collect() == providers.merged(landed).collect()


def test_only_chosen_providers_are_asked(spark, server):
    endpoint, asked = server
    rows = ask(spark, endpoint, ["10.1/a"], providers="arxiv, hal").collect()
    assert sorted(r["provider"] for r in rows) == ["arxiv", "hal"] and {p for p, _ in asked} == {"arxiv", "hal"}


def test_provider_source_over_files(spark, tmp_path):
    (tmp_path / "hal").mkdir()
    (tmp_path / "hal" / "10.1%2Fa.json").write_text(HAL)
    (tmp_path / "dois.txt").write_text("10.1/a\n\n10.1/b\n")
    providers_source.register(spark)
    df = spark.read.format("lucidex_providers").options(endpoint=f"file://{tmp_path}/{{provider}}/{{doi}}.json".replace("%", "%25"), dois_path=f"file://{tmp_path}/dois.txt", providers="hal", retries="0").load()
    rows = {r["doi"]: (r["body"], r["error"]) for r in df.collect()}
    assert set(rows) == {"10.1/a", "10.1/b"} and rows["10.1/b"] == (None, None)
    for bad in ({"endpoint": "x"}, {"endpoint": "x", "dois": "[]", "providers": "nobody"}):
        with pytest.raises(Exception, match="needed|unknown providers"):
            spark.read.format("lucidex_providers").options(**bad).load().collect()


def test_managed_tables_join_without_exchange(spark, sf):
    chunks = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("document_id", F.col("vec_id"))
    documents = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("doc_id", "document_id")
    for name, df in (("t_chunks", chunks), ("t_documents", documents)):
        managed.drop(spark, name)
        managed.create(df, name, "document_id", 4)
    with pytest.raises(Exception, match="already exists"):
        managed.create(chunks, "t_chunks", "document_id", 4)
    joined = managed.query(spark, "SELECT /*+ MERGE(d) */ c.vec_id, d.lang FROM t_chunks c JOIN t_documents d USING (document_id) WHERE d.lang <> :lang", lang="xx")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    want = chunks.join(documents, "document_id").count()
    assert joined.count() == want
    managed.append(chunks.limit(5), "t_chunks", "document_id", 4)
    assert spark.table("t_chunks").count() == chunks.count() + 5
    managed.create(chunks.limit(1), "t_chunks", "document_id", 4, replace=True)
    assert spark.table("t_chunks").count() == 1
    for name in ("t_chunks", "t_documents"):
        managed.drop(spark, name)


def test_rendering_order_and_counters(spark):
    texts = spark.createDataFrame([(1, "## Head\nghost\nkeep\nnote 1\n\n\n\nx"), (2, "### Two\nghost"), (3, None)], "doc_id long, text string")
    blocks = spark.createDataFrame([(1, " ghost ", False), (1, "keep", True), (1, "x", False), (2, "ghost", True), (9, "gone", False)], "doc_id long, text string, keep boolean")
    notes = spark.createDataFrame([(1, ["note 1"]), (2, [])], "doc_id long, notes array<string>")
    counters = Observation("ghosts")
    rows = {r["doc_id"]: (r["text"], r["considered"], r["dropped"]) for r in rendering.render(texts, blocks, notes, counters=counters).collect()}
    # x is one character long: such lines always stay.
    assert rows == {1: ("# Head\nkeep\n\nx\n\n# Footnotes\n\nnote 1", 3, 2), 2: ("# Two\nghost", 1, 0), 3: (None, 0, 0)}
    assert counters.get == {"considered": 5, "dropped": 3}
    plain = rendering.render(texts, blocks, markdown=False).where("doc_id = 2").first()
    assert plain["text"] == "### Two\nghost"


def test_circles_in_section_trees_end(spark):
    tree = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 4, "c"), (4, 3, "d")], "id long, parent long, title string")
    found = {r["id"]: r["path"] for r in layout.section_paths(tree).collect()}
    assert found == {1: "a", 2: "a / b", 3: "d / c", 4: "c / d"}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lucidex_sections")]


def test_timings(spark):
    rows = spark.createDataFrame([("a", 10.0), ("b", 300.0), ("c", None), ("d", 250.0)], "name string, total_ms double")
    assert [r["name"] for r in reports.slowest(rows, "total_ms", 2, "name").collect()] == ["b", "d"]
    assert sorted(r["name"] for r in reports.slow(rows, "total_ms").collect()) == ["b", "d"]
    assert reports.timing_summary(rows, ["total_ms"]).first()[0] == 186.7
    dated = spark.createDataFrame([(1, 5), (2, 9)], "id long, created_at long")
    assert [r["id"] for r in reports.in_default_order(dated, "documents", "id").collect()] == [2, 1]


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "m", "h")], "id long, md string, html string")
    writers.per_format(df, str(tmp_path / "out"), "id", {"md": "md", "html": "html"})
    assert spark.read.parquet(str(tmp_path / "out" / "html")).first()["value"] == "h"


def test_contributions(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "report", " rct "), (3, "poster", "rct"), (4, "thesis", "hearsay"), (5, "poster", "hearsay")], "id int, category string, study_type string")
    good, bad = contributions.validated(rows)
    assert sorted(map(tuple, good.collect())) == [(1, "scientific_article", None), (2, "report", "rct")]
    assert {r["id"]: r["faults"] for r in bad.collect()} == {3: ["category: poster"], 4: ["study_type: hearsay"], 5: ["category: poster", "study_type: hearsay"]}
    assert contributions.vocabularies(spark).where("field = 'study_type'").count() == 8
    names = spark.createDataFrame([("A_b", "x"), ("Aab", "y"), (None, "x")], "name string, kind string")
    assert [r["name"] for r in contributions.listed(names, "a_B", ("name",), kind="x").collect()] == ["A_b"] and contributions.listed(names).count() == 3
    assert spark.range(1).select(contributions.names_in_order(F.lit("b"), F.lit(None).cast("string"), F.lit("a"), F.lit("b"), F.lit(""))).first()[0] == ["b", "a"]


def test_stored_answer_or_live(spark, tmp_path):
    live = lambda: spark.createDataFrame([("live",)], "status string")
    (tmp_path / "one.json").write_text('{"status": "stored", "narrative": "n"}')
    assert readers.search_answers(spark, live).first()["status"] == "live"
    assert readers.search_answers(spark, live, str(tmp_path / "one.json")).first()["status"] == "stored"


def test_tracked_calls(spark, caplog):
    log = logging.getLogger("tracked")
    plain = tracking.tracked(lambda x: x + 1, log=log)

    @tracking.tracked(log=log, inputs=True, outputs=True, announced=True)
    def add(a, b=0):
        return a + b

    @tracking.tracked(log=log, outputs=True)
    async def later():
        return 7

    with caplog.at_level(logging.INFO, "tracked"):
        assert plain(1) == 2 and add(1, b=2) == 3 and asyncio.run(later()) == 7
    said = [r.getMessage() for r in caplog.records]
    assert [m.split(" ")[0] for m in said] == ["tracker", "start", "tracker", "tracker"]
    assert "'args_b': 2" in said[2] and "'args_0': 1" in said[2] and "'return_': 3" in said[2] and "'duration_'" in said[2] and "'return_': 7" in said[3] and add.__name__ == "add"
    df, seen = tracking.counted(spark.range(10), "pass", even=F.col("id") % 2 == 0)
    df.collect()
    assert seen.get == {"rows": 10, "even": 5}
