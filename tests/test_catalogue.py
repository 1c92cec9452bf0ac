"""Artifact upserts and run states, in tables and streams."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lucidex.operators import catalog, runs
from lucidex.sources.tables import ConcurrentCommit
from lucidex.streaming import runs as live


@pytest.fixture
def own(spark, tmp_path):
    return catalog.Catalogue(spark, str(tmp_path / "catalogue"))


def batch(spark, *rows):
    """(doi, title, [(name, orcid)...], text)"""
    return spark.createDataFrame([(d, t, ["k"], a, x, "{}") for d, t, a, x in rows], catalog.ARTIFACT)


def authors(own):
    rows = own.read("documents").join(own.read("document_authors"), "document_id").join(own.read("authors"), "author_id")
    out = {}
    for r in rows.orderBy("doi", "pos").collect():
        out.setdefault(r["doi"], []).append((r["full_name"], r["orcid"]))
    return out


def test_put(spark, own):
    state = own.put(batch(spark, ("a", "A", [("Ann", "1"), ("Bob", None), ("", None), (None, "9")], "x"), ("b", None, [("Bob", None), ("Ann", None)], "y"), ("", "no doi", [], ""), (None, "", None, None)))
    assert authors(own) == {"a": [("Ann", "1"), ("Bob", None)], "b": [("Bob", None), ("Ann", "1")]}
    assert own.read("authors").count() == 2 and own.read("documents").count() == 2
    # The same again, in another order and twice, changes nothing.
    again = own.put(batch(spark, ("b", "", [("Bob", None), ("Ann", None)], "y"), ("a", "A", [("Ann", "1"), ("Bob", None)], "x"), ("a", "A", [("Ann", "1"), ("Bob", None)], "x")))
    assert again["version"] == state["version"]
    # Authors are replaced in their order; known ones are found, one is new; others stay.
    own.put(batch(spark, ("a", "A2", [("Cy", "3"), ("Bob", None)], "x2"), ("c", "C", None, None)))
    assert authors(own) == {"a": [("Cy", "3"), ("Bob", None)], "b": [("Bob", None), ("Ann", "1")]}
    titles = {r["doi"]: (r["title"], r["postprocessed_text"]) for r in own.read("documents").join(own.read("artifacts"), "document_id").collect()}
    assert titles == {"a": ("A2", "x2"), "b": ("", "y"), "c": ("C", None)}
    ids = [r[0] for r in own.read("authors").select("author_id").collect()] + [r[0] for r in own.read("documents").select("document_id").collect()]
    assert sorted(ids) == [1, 1, 2, 2, 3, 3]


def test_same_author_twice(spark, own):
    own.put(batch(spark, ("a", "A", [("Ann", "1"), ("Ann", None), ("Other Ann", "1")], "x")))
    assert authors(own) == {"a": [("Ann", "1")]} and own.read("authors").count() == 1


def test_failure_between_tables_leaves_the_old_state(spark, own, monkeypatch):
    own.put(batch(spark, ("a", "A", [("Ann", None)], "x")))
    before, write = authors(own), own.store.write

    def broken(name, *args, **options):
        if name == "document_authors":
            raise OSError("disk full")
        return write(name, *args, **options)

    monkeypatch.setattr(own.store, "write", broken)
    with pytest.raises(OSError):
        own.put(batch(spark, ("a", "A2", [("Zoe", None)], "y")))
    monkeypatch.undo()
    assert authors(own) == before and own.read("authors").count() == 1 and own.read("documents").first()["title"] == "A"
    own.put(batch(spark, ("a", "A2", [("Zoe", None)], "y")))
    assert authors(own) == {"a": [("Zoe", None)]}


def test_two_writers(spark, own, monkeypatch):
    own.put(batch(spark, ("a", "A", [("Ann", None)], "x")))
    other, state = catalog.Catalogue(spark, own.store.path), own.store.state()
    own.put(batch(spark, ("b", "B", [("Bob", None)], "y")))
    monkeypatch.setattr(other.store, "state", lambda: state)
    with pytest.raises(ConcurrentCommit):
        other.put(batch(spark, ("c", "C", [("Cy", None)], "z")))
    assert set(authors(own)) == {"a", "b"}


def test_numbers_have_no_gaps(spark, tmp_path):
    spark.range(0, 500, 1, 7).where("id % 7 <> 3").write.parquet(str(tmp_path / "rows"))
    found = catalog.numbered(spark.read.parquet(str(tmp_path / "rows")), 11, "n").select("n", "id").collect()
    assert sorted(r["n"] for r in found) == list(range(11, 11 + len(found))) and len({r["id"] for r in found}) == len(found)


# Runs

START = datetime(2024, 1, 1)


def log(seed, n, n_runs=6):
    rng = random.Random(seed)
    stages = [*runs.STAGES, runs.FAILED, "acquire", "store", None, "nonsense"]
    return [(rng.choice([*range(n_runs), None]) if rng.random() < 0.1 else rng.randrange(n_runs), START + timedelta(minutes=rng.randrange(0, 6000)), i, rng.choice(stages), f"m{i}") for i in range(n)]


def plain(events):
    out = {}
    for run, _, _, stage, message in sorted((e for e in events if e[0] is not None and e[1] is not None), key=lambda e: (e[0], e[1], e[2])):
        out[run] = live.applied(out.get(run, live.NEW), stage or "", message)
    return {k: v[:-1] for k, v in out.items()}


def states(df):
    return {r[0]: tuple(r)[1:8] for r in df.collect()}


EVENTS = "run long, at timestamp, event_id long, stage string, message string"


def test_run_states_by_hand(spark):
    def after(*stages):
        rows = [(1, START + timedelta(hours=9 * i), i, s, f"m{i}") for i, s in enumerate(stages)]
        return states(runs.run_states(spark.createDataFrame(rows, EVENTS)))[1]

    assert after("acquire", "store", "parse", "chunk", "done") == ("success", "done", None, None, "full", 1, 0)
    assert after("acquire", "done") == ("success", "done", None, None, "metadata_only", 1, 0)
    assert after("acquire", "store", "parse", "failed", "store") == ("failed", "parse", "parse", "m3", None, 1, 1)
    assert after("acquire", "store", "failed", "acquire", "parse") == ("running", "acquire", None, None, None, 2, 1)
    assert after("store", "failed") == ("new", None, None, None, None, 0, 2)
    assert after("acquire", "store", "done") == ("running", "store", None, None, None, 1, 1)


def test_days_compose(spark):
    events = log(1, 900)
    found = states(runs.run_states(spark.createDataFrame(events, EVENTS).repartition(7)))
    assert found == plain(events)
    assert runs.run_states(spark.createDataFrame([], EVENTS)).count() == 0


def test_stream_equals_table_after_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STORE)
    events = log(3, 240)
    # Arrival is by time, but up to 20 hours late; a last event far ahead lets the watermark pass all others.
    rng = random.Random(9)
    arriving = sorted((e for e in events), key=lambda e: e[1] + timedelta(minutes=rng.randrange(0, 1200)))
    parts = [arriving[:80], arriving[80:150], arriving[150:], [(99, START + timedelta(days=30), 10**6, "acquire", "end")], [(99, START + timedelta(days=60), 10**6 + 1, "store", "end")]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")).withColumnRenamed("event_id", "tie")
        live.keep(live.follow(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(300)
    updates = spark.read.parquet(str(tmp_path / "out"))
    found = states(live.latest(updates))
    found.pop(99, None)
    assert found == plain(events)
    assert found == {k: v for k, v in states(runs.run_states(spark.createDataFrame(events, EVENTS))).items()}


def test_single_dois_are_not_shuffled(spark):
    from lucidex.operators import catalog

    row = lambda doi, title: (doi, title, None, None, "text", "{}")
    made = lambda *rows: catalog.one_per_doi(spark.createDataFrame(list(rows), catalog.ARTIFACT))
    single = made(row("a", None), row("b", "B"), row(" ", "C"), row(None, "D"))
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["doi"], r["title"]) for r in single.collect()) == [("a", ""), ("b", "B")]
    assert sorted((r["doi"], r["title"]) for r in made(row("a", "x"), row("a", "y"), row("b", None)).collect()) == [("a", "y"), ("b", "")]
