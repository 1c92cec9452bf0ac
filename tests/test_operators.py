"""Operators on written inputs: expected values, ties, nulls and empty tables."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lucidex.functions import metadata as M
from lucidex.functions import vector
from lucidex.operators import matching
from lucidex.operators import graph as G
from lucidex.operators import layout as L
from lucidex.operators import lineage as N
from lucidex.operators import quality as Q
from lucidex.operators import reports as P
from lucidex.operators import retrieval as R
from lucidex.sources import providers, readers, writers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_distances(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "vec_id int, embedding array<float>")
    found = R.top_k(df, R.vector_literal([1.0, 0.0]), 10).collect()
    assert [r["vec_id"] for r in found] == [1, 2, 3, 5]
    assert found[0]["distance"] == 0.0 and abs(found[1]["distance"] - 5.1e-5) < 1e-6 and abs(found[2]["distance"] - 1.0) < 1e-9 and found[3]["distance"] is None
    assert len(R.top_k(df, R.vector_literal([1.0, 0.0]), 2).collect()) == 2
    with pytest.raises(ValueError):
        R.top_k(df, R.vector_literal([1.0, 0.0]), 0)
    with pytest.raises(NotImplementedError):
        vector.distance("other", F.col("a"), F.col("b"))


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "id int, rank int")
    b = spark.createDataFrame([(2, 1), (9, 2)], "id int, rank int")
    found = R.fuse([a, b], "id", 3).collect()
    assert [r["id"] for r in found] == [2, 1, 3] and found[0]["score"] == round(1 / 62 + 1 / 61, 9)


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b"), (2, " "), (3, None), (4, "b a")], "id int, content string")
    found = {r["id"]: r["embedding"] for r in R.embed_passages(df, R.HashingEmbedder).collect()}
    assert found[2] is None and found[3] is None and found[1] == found[4] and abs(sum(x * x for x in found[1]) - 1) < 1e-5
    with pytest.raises(ValueError):
        R.embed_query("  ", R.HashingEmbedder())
    assert rows(R.embeddable(df, "id", "content").select("id")) == [(1,), (4,)]


def test_sparse_vector(spark):
    found = spark.createDataFrame([("A b a",)], "t string").select(writers.sparse_vector(F.col("t")).alias("v")).first()["v"]
    assert found == {"a": [1, 3], "b": [2]}


@pytest.fixture(scope="module")
def graph(spark):
    chunks = spark.createDataFrame([(0, "text", 1), (1, "table", 1), (2, "text", 2)], "position int, type string, document_id long")
    documents = spark.createDataFrame(
        [(1, "One", "J", "2020-01", ["k1", "k2"], [("7", "Ann"), ("8", None)]), (2, None, None, None, ["k2"], [("7", "Ann")]), (3, "Unseen", "J", "2020", ["k9"], [])],
        "document_id long, title string, journal string, date string, keywords array<string>, authors array<struct<id:string,name:string>>",
    )
    rows = G.joined(chunks, documents)
    return G.nodes(rows), G.edges(rows)


def test_graph(graph):
    nodes, edges = graph
    label = {r["id"]: r["label"] for r in nodes.collect()}
    assert label == {"chunk_0": "chunk_0", "chunk_1": "chunk_1", "chunk_2": "chunk_2", "1": "One", "2": "2", "journal_J": "J", "author_7": "Ann", "author_8": "author_8", "keyword_k1": "k1", "keyword_k2": "k2"}
    e = rows(edges)
    assert len(e) == 15 and e.count(("1", "journal_J")) == 2 and e.count(("2", "author_7")) == 1


def test_graph_filters(graph):
    nodes, edges = graph
    left = lambda **f: {r["id"] for r in G.filtered(nodes, edges, G.facet(**f))[0].collect()}
    assert left(kinds=["chunk", "document"]) == {"chunk_0", "chunk_1", "chunk_2", "1", "2"}
    assert left(kinds=["author"]) == set()
    assert left(chunk_types=["table"]) == {"chunk_1", "1", "2", "journal_J", "author_7", "author_8", "keyword_k1", "keyword_k2"}
    assert left(keywords=["k1"]) == {"chunk_0", "chunk_1", "1", "journal_J", "author_7", "author_8", "keyword_k1"}
    assert left(dates=("2019", "2021")) == left(documents=["1"])
    assert left(journals=["J"]) == left(documents=["1"])
    assert "author_8" not in left(authors=["Ann"]) and "chunk_2" in left(authors=["Ann"])
    assert len(left()) == 10


def test_seed(spark):
    df = spark.createDataFrame([(2, " 10.1/a ", "u"), (3, "", "x"), (4, None, "x"), (5, "10.1/a", "v"), (6, "10.1/b", " ")], "row_number int, doi string, pdf_url string")
    assert rows(N.seed_plan(df)) == [("10.1/a", "u", 2), ("10.1/b", None, 6)]
    assert rows(N.missing_doi_rows(df)) == [(3,), (4,)]
    catalogue = spark.createDataFrame([("10.1/a",), ("",)], "doi string")
    assert rows(N.new_dois(N.seed_plan(df), catalogue).select("doi")) == [("10.1/b",)]


def test_lineage(spark):
    rows_ = spark.createDataFrame([(1, ""), (2, ""), (3, "d"), (4, "d"), (5, None)], "id int, doi string")
    assert rows(N.duplicates(rows_, "doi", "id").select("id")) == [(4,)]
    parents, children = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(10, 1), (11, 2), (12, None)], "c int, id int")
    assert rows(N.cascade(children, parents, "id", "id").select("c")) == [(10,), (12,)]
    old, new = spark.createDataFrame([("a", "xx"), ("b", "yy")], "k string, v string"), spark.createDataFrame([("a", "zzz"), ("b", "ww"), ("c", "q")], "k string, v string")
    assert rows(N.larger_wins(old, new, "k", "v")) == [("a", "zzz"), ("b", "yy"), ("c", "q")]
    entries = spark.createDataFrame([(0, "Ann", None), (1, "Bo", "o2"), (2, " ", "o2"), (3, "New", None), (4, "Ann", "ox")], "pos int, name string, orcid string")
    authors = spark.createDataFrame([(7, "Ann", None), (5, "Ann", "o9"), (6, "Other", "o2")], "id long, full_name string, orcid string")
    assert {r["pos"]: r["author_id"] for r in N.resolve_authors(entries, authors).collect()} == {0: 5, 1: 6, 3: None, 4: None}


def test_hash(spark):
    df = spark.createDataFrame([("10.1/a-b",)], "d string").select(M.doi_to_id(F.col("d")).alias("i"), M.hash_doi(F.col("d")).alias("h")).first()
    import hashlib

    assert df["i"] == "10_1_a_b" and df["h"] == hashlib.sha256(b"10.1/a-b").hexdigest()


def test_text_metadata(spark):
    text = "ISSN 1234\nJournal of Odd Things\nA title of five words\nreceived: x\nAbstract: This is the abstract of the work at hand.\nIntroduction more\n2019-03-01 https://dx.doi.org/10.1234/abc.9). see http://a.io/x and https://www.bmj.com/y"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(M.summary(F.col("t")).alias("m")).collect()
    m = df[0]["m"]
    assert (m["doi"], m["title"], m["abstract"], m["journal"], m["year"], m["link"]) == ("10.1234/abc.9", "A title of five words", "This is the abstract of the work at hand.", "Odd Things", "2019", "https://doi.org/10.1234/abc.9")
    assert all(v is None for v in df[1]["m"]) and all(v is None for v in df[2]["m"])
    link = spark.createDataFrame([(text,)], "t string").select(M.link(F.col("t"), F.lit(None).cast("string")).alias("x")).first()["x"]
    assert link == "https://www.bmj.com/y"


def test_scores(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    none = F.lit(None).cast("double")
    values = {"title": F.lit(1.0), "authors": F.lit(0.5), "doi": none, "date": F.lit(0.0), "source": none, "abstract": none, "keywords": none}
    assert one(Q.metadata_accuracy(values)) == 60.0
    assert one(Q.metadata_accuracy(dict.fromkeys(values, none))) == 0.0
    assert one(Q.structural_quality(F.lit(0.0), F.lit(1.0), F.lit(0.0))) == 100.0
    assert one(Q.structural_quality(F.lit(0.4), none, F.lit(0.0))) == 28.6
    assert one(Q.concordance(F.array(*map(F.lit, [1, 3, 2])))) == pytest.approx(2 / 3)
    assert one(Q.concordance(F.array(F.lit(1)))) is None
    text = F.lit("# Intro\ntext\n## Methods used\n# Results\n")
    assert one(Q.section_order(text, F.array(*map(F.lit, ["Methods", "Intro", "Results"])))) == 0.6667
    assert one(Q.section_order(F.lit("no heads"), F.array(F.lit("a"), F.lit("b")))) is None


def test_reports(spark):
    df = spark.createDataFrame([("f1", "a", 0.5, 1), ("f1", "b", 0.5, 2), ("f2", "b", 0.9, 1), ("f3", "c", None, 1)], "f string, c string, m double, n int")
    assert rows(P.wins(df, "f", "c", "m", "n")) == [("a", 1), ("b", 1), ("c", 0)]
    assert rows(P.profile(df, ["c"], ["m"])) == [("a", 0.5), ("b", 0.7), ("c", None)]
    assert P.backfilled(df, "new", "m").columns[-1] == "new" and P.backfilled(df, "m", "x") is df
    files = spark.createDataFrame([("s", ".txt"), ("s", ".md"), ("t", ".txt"), ("u", ".pdf")], "stem string, ext string")
    assert rows(P.preferred(files, "stem", "ext")) == [("s", ".md"), ("t", ".txt")]


def test_boxes(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    r = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)])
    assert one(L.overlap_ratio(r(0, 0, 10, 10), r(5, 0, 20, 10))) == 0.5
    assert one(L.overlap_ratio(r(0, 0, 0, 10), r(0, 0, 9, 9))) == 0.0
    box = one(L.rect(*[F.lit(float(x)) for x in (1, 90, 5, 80)], F.lit(None).cast("string"), F.lit(100.0)))
    assert tuple(box) == (1.0, 10.0, 5.0, 20.0)


CROSSREF = {"message": {"title": ["T"], "author": [{"given": "A", "family": "B"}, {"given": ""}], "publisher": "Pub", "published": {"date-parts": [[2020, 3]]}, "resource": {"primary": {"URL": "u"}}, "reference": [{"DOI": "d1"}, {"unstructured": "u1"}, {"article-title": "t", "author": "x", "year": "1999"}, {"year": "1"}], "DOI": "10.1/x", "type": "article", "link": [{"URL": "p", "content-type": "application/pdf"}]}}
OPENALEX = {"title": "Longer title", "authorships": [{"raw_author_name": "A B"}, {"raw_author_name": "C D"}], "doi": "https://doi.org/10.1/x", "is_retracted": True, "open_access": {"is_oa": True, "oa_url": "o"}, "mesh": [{"descriptor_name": "m"}, {"descriptor_name": "m"}], "locations": [{"pdf_url": "l"}, {"pdf_url": "b"}], "best_oa_location": {"pdf_url": "b"}}


def test_providers(spark):
    df = spark.createDataFrame([("10.1/x", "crossref", json.dumps(CROSSREF)), ("10.1/x", "openalex", json.dumps(OPENALEX)), ("10.1/y", "crossref", None), ("10.1/y", "pubmed", json.dumps({"title": "P", "pubtype": ["Retracted Publication"], "articleids": [{"idtype": "doi", "value": "10.1/y"}]}))], "doi string, provider string, body string")
    c = df.where("provider = 'crossref' and body is not null").select(providers.crossref(F.col("body")).alias("r"), providers.crossref_pdf(F.col("body")).alias("pdf")).first()
    assert c["r"]["cited_articles"] == ["d1", "u1", "t x (1999)"] and c["r"]["publish_date"] == "2020-3" and [a["name"] for a in c["r"]["authors"]] == ["A B"] and c["pdf"] == ["p"]
    o = df.where("provider = 'openalex'").select(providers.openalex(F.col("body")).alias("r"), providers.openalex_pdf(F.col("body")).alias("pdf")).first()
    assert o["r"]["keywords"] == ["m"] and o["r"]["doi"] == "10.1/x" and o["pdf"] == ["b", "l", "o"]
    merged = {r["doi"]: r for r in providers.merged(df).collect()}
    assert merged["10.1/x"]["title"] == "Longer title" and merged["10.1/x"]["status"] == "published" and merged["10.1/x"]["sources"] == ["crossref", "openalex"]
    assert merged["10.1/y"]["status"] == "retracted" and merged["10.1/y"]["sources"] == ["pubmed"]
    ids = spark.createDataFrame([("d", [str(i) for i in range(250)])], "doi string, ids array<string>")
    assert [len(r["items"]) for r in providers.batches(ids, "doi", "ids").orderBy("batch").collect()] == [100, 100, 50]
    q = spark.createDataFrame([("10.48550/arXiv.2101.1",), ("10.1/x",)], "d string").select(providers.arxiv_query(F.col("d")).alias("q")).collect()
    assert [r["q"] for r in q] == ["id:2101.1", "doi:10.1/x"]


def test_readers(spark, tmp_path):
    (tmp_path / "seed.csv").write_text("doi,pdf_url\n10.1/a,u\n,\n10.1/b,\n")
    assert [tuple(r) for r in readers.doi_csv(spark, str(tmp_path / "seed.csv")).select("row_number", "doi").collect()] == [(2, "10.1/a"), (3, None), (4, "10.1/b")]
    (tmp_path / "bad.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        readers.doi_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "truth.json").write_text(json.dumps({"documents": {"a.pdf": {"doc_type": "paper", "title": "T"}, "b.pdf": {"doc_type": "policy"}}}))
    truth = readers.ground_truth(spark, str(tmp_path / "truth.json"))
    assert rows(readers.filenames_of(truth, "paper")) == [("a.pdf",)]
    with pytest.raises(ValueError):
        readers.filenames_of(truth, "none")
    folder = tmp_path / "out" / "raw" / "conf"
    folder.mkdir(parents=True)
    (folder / "doc.txt").write_text("hello\nthere")
    (folder / "doc.PDF").write_bytes(b"%PDF-1")
    got = readers.extracted_texts(spark, str(tmp_path / "out")).where("ext = '.txt'").first()
    assert (got["variant"], got["config"], got["stem"], got["text"]) == ("raw", "conf", "doc", "hello\nthere")
    files = readers.binaries(spark, str(tmp_path / "out"))
    assert rows(files.select("name")) == [("doc.PDF",)]
    made = readers.Extractors()
    made.register("fails", lambda b: 1 / 0)
    assert made.apply(files, "plain").first()["text"] == "%PDF-1"
    failed = made.apply(files, "fails").first()
    assert failed["pages"] == 1 and failed["text"] is None and "zero" in failed["error"]
    with pytest.raises(ValueError):
        made.apply(files, "none")
    assert readers.resolve_configs({"full": ["a", "b"], "fast": ["a"]}, "full", "b, a,b") == ["b", "a"]
    with pytest.raises(ValueError):
        readers.resolve_configs({"full": ["a"]}, "full", "z")
    with pytest.raises(ValueError):
        readers.object_path("b", "")


def test_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.append_new(spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), path, "k")
    writers.append_new(spark.createDataFrame([(1, "c"), (2, "d")], "k int, v string"), path, "k")
    assert spark.read.parquet(path).count() == 2
    chunks = spark.createDataFrame([(1, "text", "b", 0.2, 5, -1), (0, "text", "a", 0.1, 5, -1)], "position int, type string, content string, score double, document_id long, page int")
    answer = json.loads(writers.answer("n", chunks, spark.createDataFrame([(5, "T")], "document_id long, title string"), spark.createDataFrame([(9, "A", None)], "id long, name string, orcid string")).first()["answer"])
    assert [c["content"] for c in answer["chunks"]] == ["a", "b"] and answer["documents"]["5"]["title"] == "T"
    people = F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("surname")) for a, b in (("A", ""), ("", ""))])
    own = json.loads(spark.range(1).select(writers.contribution(people, doi=F.lit("d")).alias("j")).first()["j"])
    assert own == {"doi": "d", "authors": [{"name": "A", "surname": ""}]}


def test_stream(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType, TimestampType

    from lucidex.streaming.ingest import documents, ingest

    schema = StructType([StructField("doi", StringType()), StructField("text", StringType()), StructField("arrived", TimestampType())])
    source = str(tmp_path / "in")
    spark.sql("select '10.1/a' doi, 'one' text, timestamp'2024-01-01' arrived union all select '10.1/a', 'one', timestamp'2024-01-01' union all select '10.1/b', 'two', timestamp'2024-01-01'").write.parquet(source)
    for _ in range(2):
        ingest(documents(spark, source, schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("chunk_id", "content")) == [("10.1/a#1", "one"), ("10.1/b#1", "two")]


def test_plans(spark, sf):
    """Filters and columns reach the scan; the top-k has no exchange of the table; semi joins prune edges."""
    from lucidex.plans import queries

    def plan(name):
        return queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()

    assert "TakeOrderedAndProject" in plan("search_chunks")
    assert "IsNotNull(embedding)" in plan("embedded_only")
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan("doc_type_filter") and "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in plan("doc_type_filter")
    assert "Exchange" not in plan("remove_repeated_lines") and "Python" not in plan("remove_repeated_lines")
    assert "Exchange" not in plan("isolated_lines")


def test_fuzzy_scores_against_plain_python(spark):
    """Matches, weighted shares and order by the standard library's ratio over all pairs."""
    from difflib import SequenceMatcher

    rng = random.Random(5)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(8)) for _ in range(12)]
    edit = lambda s: s.replace("a", "e", rng.randrange(4))
    rows = [(0, [edit(s) for s in base[:9]], base), (1, base[::-1], base), (2, [], base), (3, base, []), (4, [edit(base[3]), base[1], base[2], base[0]], base[:5])]
    got = {r["i"]: r for r in matching.fuzzy_scores(spark.createDataFrame(rows, "i int, e array<string>, r array<string>"), "i", "e", "r").collect()}

    def best(needle, sentences):
        if needle in sentences:
            return 1.0, sentences.index(needle)
        found = (0.0, -1)
        for k, s in enumerate(sentences):
            if abs(len(needle) - len(s)) <= 0.5 * len(needle) and (x := SequenceMatcher(None, needle, s).ratio()) > found[0]:
                found = (x, k)
                if x >= 0.95:
                    break
        return found

    for i, e, r in rows:
        mine, back = [best(x, e) for x in r], [best(x, r) for x in e]
        share = lambda m, empty: round(sum(x for x, _ in m if x >= 0.8) / len(m), 4) if m else empty
        assert (got[i]["recall"], got[i]["precision"]) == (share(mine, 1.0), share(back, 0.0))
        at = [p for x, p in mine if x >= 0.8]
        rising = sum(a < b for k, a in enumerate(at) for b in at[k + 1 :])
        want = round(rising / (len(at) * (len(at) - 1) / 2) * len(at) / len(r), 4) if len(at) >= 3 else None
        assert got[i]["order"] == want


def test_pairs_that_are_compared(spark):
    """No match is lost, and most pairs are never compared."""
    from difflib import SequenceMatcher

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäö ") for _ in range(rng.randrange(1, 12)))
    base = [" ".join(word() for _ in range(rng.randrange(2, 30))) for _ in range(60)]
    other = [s if rng.random() < 0.2 else "".join(c for c in s if rng.random() > 0.15) if rng.random() < 0.5 else s + word() * rng.randrange(4) for s in base]
    df = spark.createDataFrame([(0, base, other), (1, base[:5], None), (2, None, other[:5])], "i int, e array<string>, r array<string>")
    own, others = (matching.sentences_of(df, "i", c).where("s <> ''") for c in ("r", "e"))
    compared = {(r["n"], r["place"]) for r in matching.pairs(own, others).where("doc = 0").collect()}
    like = {(n, p) for n, s in enumerate(other) for p, t in enumerate(base) if s and t and abs(len(s) - len(t)) <= 0.5 * len(s) and SequenceMatcher(None, s, t).ratio() >= 0.8}
    assert like <= compared and len(compared) < len(base) * len(other) / 10
    assert matching.fuzzy_scores(df, "i", "e", "r").where("i > 0").orderBy("i").select("recall", "precision", "order").collect() == [(1.0, 0.0, None), (0.0, 0.0, None)]


def test_presence(spark):
    df = spark.createDataFrame([("A Study of Tea\nAnn Lee\n10.1/x\nWe drank a lot of tea.\nReferences",)], "t string")
    text, array = F.col("t"), lambda *xs: F.array(*[F.lit(x) for x in xs])
    row = lambda c: df.select(c.alias("x")).first()["x"]
    assert tuple(row(Q.presence(text, F.lit("a study of TEA")))) == ("found", 1.0)
    assert tuple(row(Q.presence(text, F.lit("A Study of Ted")))) == ("found", 0.929)
    assert row(Q.presence(text, F.lit("Coffee for nobody at all")))["status"] == "not_found" and tuple(row(Q.presence(text, F.lit(None).cast("string")))) == ("n/a", 0.0)
    whole = lambda *xs: tuple(row(Q.content_presence(text, *xs)))
    assert whole(F.lit("A Study"), array("Zzz Qwv", "Anne Lee"), F.lit("10.1/x"), F.lit("We drank a lot of tee."), F.lit("lot of tea")) == ("found",) * 6 + (6,)
    null = F.lit(None).cast("string")
    assert whole(F.lit("Q" * 30), array("Zzz Qwv"), null, null, null) == ("not_found", "not_found", "n/a", "n/a", "found", "n/a", 1)


def test_expected_names_and_passages(spark):
    df = spark.createDataFrame([("Ann Lee and Bo Chu wrote this text on tea",)], "t string")
    row = lambda c: df.select(c.alias("x")).first()["x"]
    array = lambda *xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    assert tuple(row(Q.author_accuracy(F.col("t"), array("ann lee", "Bo Chu")))) == (1.0, 1.0)
    assert row(Q.author_accuracy(F.col("t"), array("ann lee", "Qwvkj Zzz")))["recall"] == 0.5
    assert tuple(row(Q.author_accuracy(F.col("t"), array()))) == (0.0, 0.0) and row(Q.keyword_accuracy(F.col("t"), array())) is None
    assert tuple(row(Q.continuity(F.col("t"), array("wrote this", "wrote thus text")))) [:2] == (2, 2)
    assert tuple(row(Q.continuity(F.col("t"), F.lit(None).cast("array<string>")))) == (0, 0, 0.0)


def test_fuzzy_scores_in_the_row(spark):
    """Nothing is shuffled; odd rows; bounds in blocks hold, also where bins have more than their bits tell."""
    from difflib import SequenceMatcher

    a = ["a" * 40 + "b", "", None, "one two three four", "x"]
    b = ["a" * 36, "", None, "one two three fou", None]
    df = spark.createDataFrame([(0, a, b), (1, None, None), (2, [], []), (3, [None], ["y"])], "i int, e array<string>, r array<string>")
    got = matching.fuzzy_scores(df, "i", "e", "r")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    r = [SequenceMatcher(None, b[k], a[k]).ratio() for k in (0, 3)]
    p = [SequenceMatcher(None, a[k], b[k]).ratio() for k in (0, 3)]
    want = [(round((sum(r) + 1) / 5, 4), round((sum(p) + 1) / 5, 4), 0.6), (1.0, 0.0, None), (1.0, 0.0, None), (0.0, 0.0, None)]
    assert [tuple(x) for x in got.orderBy("i").select("recall", "precision", "order").collect()] == want
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    edited = ["".join(c for c in s if rng.random() > 0.12) for s in base]
    seen = {(i, p): x for i, places, bounds in matching.near(base, edited) for p, x in zip(places.tolist(), bounds.tolist(), strict=True)}
    for i, s in enumerate(base):
        for p in (i, rng.randrange(300), rng.randrange(300)):
            ratio = SequenceMatcher(None, s, edited[p]).ratio() if edited[p] and abs(len(s) - len(edited[p])) <= 0.5 * len(s) else 0
            assert ratio < matching.MATCH or seen[i, p] >= ratio - 1e-9


def test_sentences_of_many_documents_at_once():
    """Documents are bounded together, in both directions, with the results of each alone; equal sentences stand for their first."""
    from difflib import SequenceMatcher
    from unittest import mock

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8)))
    base = [[" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(12))] for _ in range(40)]
    edit = lambda s: "".join(c for c in s if rng.random() > 0.04)
    docs = [([*map(edit, d), *d[:2], ""], [*d, *d[-2:], None]) for d in base] + [([], []), ([None], ["x"])]
    first = [(matching.first_places(e), matching.first_places(r)) for e, r in docs]
    both = [(r, e) for e, r in first] + first
    with mock.patch.object(matching, "bitmaps", wraps=matching.bitmaps) as made, mock.patch.object(matching, "PAIRS", 50):
        found = matching.best_of(both)
    assert made.call_count == 1
    pairs = [([s], [s.replace("a", "e", 1)]) for d in base for s in d if 40 < len(s) < 190 and "a" in s]
    halves = [(matching.first_places(e), matching.first_places(r)) for r, e in pairs]
    with mock.patch.object(matching.folds, "gestalt_both", wraps=matching.folds.gestalt_both) as made:
        matching.best_of([(r, e) for e, r in halves] + halves)
    assert len(pairs) <= made.call_count < 1.5 * len(pairs)
    for (needles, sentences), got in zip(both, found, strict=True):
        assert got == matching.best_of([(needles, sentences)])[0]
        for s in needles:
            rated = [(1.0 if s == t else SequenceMatcher(None, s, t).ratio(), t) for t in sentences if s and t and abs(len(s) - len(t)) <= 0.5 * len(s)]
            top = max((r for r, _ in rated), default=0.0)
            if s in sentences or top < matching.MATCH:
                assert got.get(s) == ((1.0, sentences[s]) if s in sentences else None)
                continue
            ratio = next((r for r, _ in rated if r >= matching.EARLY), top)
            assert got[s] == (ratio, sentences[next(t for r, t in rated if r == top)])
