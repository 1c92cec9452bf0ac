"""Training-data operators against brute force on small tables, and the odd cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucidex.llm import common, components, decontaminate, hash_tree, html_text, language_id, licenses, mixing, quality, repeats, simhash, token_rollup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "\n\n", "a", "ab cd", "the quick brown fox " * 30, "x" * 5000, "é ü ß — “q”", "w#% " * 60, "line one\nline one\nline one\nother", "1 2 3 4 5 6 7 8 9 10 11 12"]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'.' * (rng.random() < 0.1)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    passage = words(rng, 60)
    out = []
    for i in range(160):
        text = words(rng, rng.randrange(0, 160))
        if i % 4 == 0:
            text = f"{text[: len(text) // 2]} {passage} {text[len(text) // 2 :]}"
        if i % 7 == 3:
            text = out[i - 3][1]
        if i % 9 == 5 and out[i - 5][1]:
            text = out[i - 5][1][:-2] + " zz"
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), 0))
    out += [(200 + i, t, "en", "a", 0) for i, t in enumerate(ODD)]
    out += [(300, None, "en", "a", None), (301, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(spark, docs):
    """Extra columns named like the operators' own."""
    names = ["fp", "key", "text_crc32", "size", "shard", "row", "doc", "lang_pred", "score", "h", "bucket", "count"]
    return docs.withColumns({n: F.lit("clash") for n in names})


def texts(rows):
    return [(r[0], r[1]) for r in rows]


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_quality(docs, rows, clashing, empty):
    found = {r[0]: r for r in got(quality.verdicts(docs))}
    assert {d: r[1:7] for d, r in found.items()} == {d: brute.quality_counts(t) for d, t in texts(rows)}
    assert all(not (r[6] and r[7]) for r in found.values())
    assert got(quality.verdicts(clashing)) == sorted(found.values())
    assert got(quality.verdicts(empty)) == []
    left = got(quality.filter_documents(docs).select("doc_id"))
    assert left == sorted((d,) for d, r in found.items() if r[7])
    assert quality.filter_documents(clashing).columns == clashing.columns
    # With too many thresholds for a broadcast the rows are the same.
    assert got(quality.filter_documents(docs, broadcast_groups=0).select("doc_id")) == left


def test_quality_adapts(spark):
    """A source where symbols are usual keeps them; one document with many in a plain source goes."""
    rng = random.Random(4)
    plain = [(i, words(rng, 60), "en", "plain", 0) for i in range(250)]
    marked = [(1000 + i, " ".join(w + "##" for w in words(rng, 60).split()), "en", "marked", 0) for i in range(250)]
    odd = [(5000, " ".join(w + "##" for w in words(rng, 60).split()), "en", "plain", 0)]
    kept = {r["doc_id"]: r["kept"] for r in quality.verdicts(spark.createDataFrame(plain + marked + odd, DOCS)).collect()}
    assert all(kept[i] for i, *_ in plain + marked) and not kept[5000]


def test_sketch_buckets(spark):
    xs = [*range(200), 1000, 65535, 10**9]
    df = spark.createDataFrame([(x,) for x in xs], "x long").withColumn("b", quality.bucket(F.col("x"))).withColumn("f", quality.bucket_floor(F.col("b")))
    rows = sorted(df.collect())
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)
    assert all(r["f"] <= r["x"] and r["x"] - r["f"] <= r["x"] / 64 for r in rows)


def test_thresholds_follow_the_groups(spark):
    """On the given documents limits differ by language and source, and good ones are left alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    measured = common.materialize(quality.with_measures(docs.select("lang", "source", "text"), F.col("text")).drop("text"), "measures")
    limits = quality.thresholds(quality.sketches(measured)).collect()
    assert len({r["hi_word_length"] for r in limits}) > 3 and len({r["hi_repeats"] for r in limits}) > 3 and len({r["lo_word_length"] for r in limits}) > 3
    found = quality.verdicts(docs).join(labels, "doc_id").where("not base_failed")
    good, poor = found.where("quality = 1"), found.where("quality = 0")
    assert good.where("kept").count() >= 0.98 * good.count() and poor.where("not kept").count() >= 0.9 * poor.count()


def test_symbol_limits_come_from_documents_with_symbols(spark):
    """Most documents have none: the limit follows the others, group by group, and parts few symbols from many."""
    rng = random.Random(11)

    def text(per_mille):
        own = words(rng, 120)
        return own + " " + "#" * round(len(own) * per_mille / 1000)

    rows = [(i, text(0), "en", "tight", 0) for i in range(900)] + [(1000 + i, text(rng.randrange(80, 160)), "en", "tight", 0) for i in range(60)]
    rows += [(3000 + i, text(0), "en", "mixed", 0) for i in range(800)] + [(4000 + i, text(rng.randrange(2, 5)), "en", "mixed", 0) for i in range(70)] + [(5000 + i, text(rng.randrange(200, 300)), "en", "mixed", 0) for i in range(70)]
    rows += [(7000 + i, text(rng.randrange(10, 30)), "en", "usual", 0) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    limits = {r["source"]: r["hi_symbols"] for r in quality.thresholds(quality.sketches(quality.with_measures(docs.select("lang", "source", "text"), F.col("text")))).collect()}
    assert len(set(limits.values())) == 3 and quality.FLOOR["symbols"] not in limits.values()
    gone = {r["doc_id"] // 1000 for r in quality.verdicts(docs).where("not kept and not base_failed").collect()}
    assert gone == {1, 5}  # many where few have any, many where some have few; never few, never the usual


def test_shards(docs, rows, clashing, empty):
    found = hash_tree.shard_table(docs).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in found} == {(d, len((t or "").encode()) + 1, brute.crc(t)) for d, t in texts(rows)}
    by = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert set(by) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert got(hash_tree.shard_table(clashing)) == got(hash_tree.shard_table(docs))
    assert got(hash_tree.shard_table(empty)) == []


def test_shards_null_and_repeated(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, None), (2, "b")], "doc_id long, text string")
    found = hash_tree.shard_table(df).collect()
    assert len(found) == 5 and len({(r["shard"], r["slot"]) for r in found}) == 5


def test_growth_by_one(spark):
    """From every shard count that a layout has grown to, keys go into the new shard only, as the table of the lesser count foretells."""
    key = hash_tree.key_text(F.col("k"))
    for base in (1, 3, 8, 11):
        counts = range(base, base + 7)
        rows = spark.range(3000).select(F.col("id").alias("k")).select(*[hash_tree.descend(key, hash_tree.sized(n, base)).alias(f"s{n}") for n in counts]).collect()
        for i, n in enumerate(counts[:-1]):
            moved = [(r[i], r[i + 1]) for r in rows if r[i] != r[i + 1]]
            assert moved and {b for _, b in moved} == {n}
    df = spark.createDataFrame([(i, "x") for i in range(200)] + [(None, "x")] * 50, "doc_id long, text string")
    now, then = (hash_tree.shard_table(df, shards=n).collect() for n in (8, 9))
    assert {(r["doc_id"], r["grown_shard"]) for r in now} == {(r["doc_id"], r["shard"]) for r in then}
    assert len(now) == 250 and len({(r["shard"], r["slot"]) for r in now}) == 250


def test_movement_is_confined(spark):
    """A heavier shard takes keys only into its own subtree; shares follow weights."""
    keys = spark.range(20000).select(F.col("id").alias("k"))
    leaves = hash_tree.balanced(8)
    heavier = [hash_tree.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in leaves]
    both = keys.select(hash_tree.descend(hash_tree.key_text(F.col("k")), leaves).alias("a"), hash_tree.descend(hash_tree.key_text(F.col("k")), heavier).alias("b")).collect()
    moved = [(r["a"], r["b"]) for r in both if r["a"] != r["b"]]
    assert all(b in (4, 5, 6, 7) for _, b in moved if _ < 4)
    assert not any(a >= 4 and b < 4 for a, b in moved) and not any(a in (4, 5) and b in (6, 7) for a, b in moved)
    share = sum(r["b"] == 5 for r in both) / 20000
    assert abs(share - 0.3) < 0.02


def plain_descent(key, leaves):
    """The way down and the number of draws it took."""
    tree, node, drawn = hash_tree.nodes(leaves), 0, 0
    while tree[node]["children"]:
        u = lambda c: (int(hashlib.md5(f"{key}{c['path']}".encode()).hexdigest()[:13], 16) + 1) / 2**52
        drawn += len(tree[node]["children"])
        node = min(tree[node]["children"], key=lambda c: (-math.log(u(c)) / c["weight"], c["node"]))["node"]
    return tree[node]["shard"], drawn


def test_descent_draws_for_children_only(spark):
    leaves = hash_tree.balanced(64, racks=4, per_rack=4)
    rows = spark.range(500).select(F.col("id"), hash_tree.descend(hash_tree.key_text(F.col("id")), leaves).alias("s")).collect()
    for r in rows:
        shard, drawn = plain_descent(f"k{r['id']}", leaves)
        assert r["s"] == shard and drawn == 12  # 4 regions, 4 racks, 4 shards, not 64
    assert len({r["s"] for r in rows}) == 64
    for bad in ([hash_tree.Leaf("r", "a", 0, 0.0)], [hash_tree.Leaf("r", "a", 0), hash_tree.Leaf("r", "a", 0)]):
        with pytest.raises(ValueError):
            hash_tree.nodes(bad)


def test_many_equal_rows_are_numbered_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(hash_tree, "RANGE", 7)
    df = spark.createDataFrame([(5, "same")] * 50 + [(i, "x") for i in range(20)], "doc_id long, text string")
    found = hash_tree.shard_table(df).collect()
    by = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(found) == 70 and all(sorted(s) == list(range(len(s))) for s in by.values())


ITEMS = [(0, "alpha beta gamma"), (1, None), (2, ""), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (3, "other text of the same item id and some more words here"), (None, "omega"), (12, "w7 w8 w9 w10 w11 w12 w13 w14 w15 w16")]


def test_decontamination(spark, docs, rows, clashing, empty, monkeypatch):
    rng = random.Random(9)
    items = [*ITEMS, (40, " ".join(rows[0][1].split()[3:25]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = [(900, "Alpha, BETA; gamma! and omega", "en", "a", 0), (901, "say w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 end", "en", "a", 0)]
    own = docs.union(spark.createDataFrame(extra, DOCS))
    want = sorted(brute.contamination(texts(rows + extra), items))
    assert got(decontaminate.flag_table(own, bench)) == want
    assert any(r[5] for r in want)
    # In several blocks the result is the same.
    assert got(decontaminate.flag_table(own, bench, block_bytes=40)) == want
    assert got(decontaminate.flag_table(empty, bench)) == []
    assert not any(r[5] for r in got(decontaminate.flag_table(own, bench.where("false"))))
    named = own.withColumns({c: F.lit("x") for c in decontaminate.NAMES})
    assert decontaminate.remove(named, bench).where("_spans = 'x' and _items = 'x'").count() == decontaminate.remove(own, bench).count()
    clean = decontaminate.remove(clashing, bench)
    assert clean.columns == clashing.columns
    hit = {r[0] for r in want if r[5]}
    assert {r["doc_id"] for r in decontaminate.remove(own, bench).collect()} == {d for d, _ in texts(rows + extra)} - hit
    cut = decontaminate.remove(own, bench, what="spans")
    assert {r["doc_id"]: r["text"] for r in cut.where("doc_id >= 900").collect()} == {900: "! and ", 901: "say  end"} or not any(r[5] for r in got(decontaminate.flag_table(cut.where("doc_id < 300"), bench.where("item_id = 40"))))
    with pytest.raises(ValueError):
        decontaminate.remove(own, bench, what="x")
    assert rng


def test_simhash(docs, rows, clashing, empty, monkeypatch):
    want = sorted((d, f, c) for d, (f, c) in brute.near_groups(texts(rows)).items())

    def table(df):
        return sorted((r["doc"], f"{r['fp'] % 2**64:016x}", r["component"]) for r in simhash.groups(df).collect())

    assert table(docs) == want
    assert table(clashing) == want
    assert table(empty) == []
    kept = sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect())
    assert kept == sorted({c for _, _, c in want})
    # Crowded keys go the other way, to the same end.
    monkeypatch.setattr(simhash, "CROWD", 1)
    assert table(docs) == want


def test_simhash_links(spark, monkeypatch):
    """Planted fingerprints: chains of one and two bits, and far ones."""
    rng = random.Random(5)
    prints = {0}
    for _ in range(60):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(rng.randrange(6)):
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    want = {}
    for p in prints:
        want.setdefault(root(p), set()).add(p)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    for crowd in (64, 1):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        found = {p: {p} for p in prints}
        for r in components.components(simhash.links(df)).collect():
            found.setdefault(("root", r["root"]), set()).add(r["node"] % 2**64)
        grouped = {frozenset(v) for k, v in found.items() if isinstance(k, tuple)}
        assert grouped == {frozenset(v) for v in want.values() if len(v) > 1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5)]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {n for n, r in found.items() if r == 0} == set(range(101))
    assert {n for n, r in found.items() if r == 200} == {200, 201, 202}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_repeats(spark, docs, rows, clashing, empty, monkeypatch):
    own = [r for r in rows if r[1] is not None or r[0] == 300]
    want = sorted(brute.repeats(texts(own)))
    assert any(r[2] for r in want)
    df = docs.where("doc_id <> 301")
    assert got(repeats.digest_table(df)) == want
    monkeypatch.setattr(repeats, "CROWD", 1)
    assert got(repeats.digest_table(df)) == want
    assert got(repeats.digest_table(empty)) == []
    assert repeats.remove(clashing).columns == clashing.columns


def test_repeats_inside_long_and_periodic_texts(spark, monkeypatch):
    rng = random.Random(8)
    base = words(rng, 400)
    cases = [(1, base), (2, base[500:1500] + "é" * 300), (3, "ab" * 700), (4, "é" * 200), (5, base[:99]), (6, base[:100]), (7, "x" + base[100:900] + "y" + base[100:900])]
    df = spark.createDataFrame(cases, "doc_id long, text string").repartition(3)
    want = sorted(brute.repeats(cases))
    assert got(repeats.digest_table(df)) == want
    # Small blocks cut long texts into pieces.
    monkeypatch.setattr(repeats, "BLOCK", 1 << 9)
    assert got(repeats.digest_table(df)) == want


def test_repeated_rows_are_one_document(spark):
    text = words(random.Random(2), 100)
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    found = sorted(((r["doc_id"] is None, r["doc_id"], r["n_removed"]) for r in repeats.digest_table(df).collect()), key=str)
    n = len(text.encode())
    assert found == [(False, 1, 0), (False, 1, 0), (False, 2, n), (True, None, n)]


def test_longest_previous_factors():
    """LPF arrays against all pairs of positions."""
    import numpy as np

    rng = random.Random(2)
    texts = [b"abracadabra abracadabra", b"a" * 60, b"ab" * 40, bytes(rng.choice(b"ab") for _ in range(150)), bytes(rng.choice(b"abcdef") for _ in range(150)), b"abc"]
    for data in texts:
        for length in (3, 8, 9, 11, 40):
            n = len(data) - length + 1
            ranks = repeats.suffix_ranks(np.frombuffer(data, np.uint8), length)
            if n > 0:
                pieces = [data[i : i + length] for i in range(n)]
                assert [pieces[i] for i in np.argsort(ranks[length], kind="stable")] == sorted(pieces)
            starts = np.array([i for i in range(max(n, 0)) if i % 7 != 3], np.int64)
            found = repeats.longest_previous_factors(np.frombuffer(data, np.uint8), starts, length)
            common = lambda i, j: next((k for k in range(length) if data[i + k] != data[j + k]), length)  # noqa: E731,B023
            assert found.tolist() == [max((common(i, j) for j in starts if j < i), default=0) for i in starts]


def test_language_model():
    """Code lengths are the sums of the escape costs, for seen and unseen grams and across blocks."""
    import math

    tree = language_id.Tree.of([b"abcabd", b"abx"])

    def cost(context, symbol):
        rest = 0.0
        for k in range(language_id.ORDER, -1, -1):
            own = context[len(context) - k :] if k else b""
            counts = {}
            for t in (b"abcabd", b"abx"):
                whole = b"\n" * language_id.ORDER + t
                for i in range(language_id.ORDER, len(whole)):
                    if whole[i - k : i] == own:
                        counts[whole[i]] = counts.get(whole[i], 0) + 1
            if not counts:
                continue
            total = sum(counts.values()) + len(counts)
            if symbol in counts:
                return -math.log2(counts[symbol] / total) + rest
            rest += -math.log2(len(counts) / total)
        return rest + 8

    import numpy as np

    for gram in (b"\n\n\na", b"abca"[:4], b"cabd", b"zzzz", b"abcz", b"\nabq"):
        g = np.array([int.from_bytes(gram[-4:].rjust(4, b"\n"), "big")], np.uint32)
        assert abs(tree.cost(g)[0] - cost(gram[-4:-1], gram[-1])) < 1e-9
    model = language_id.Model.of({"a": [b"abcabd" * 50], "b": [b"xyzxyw" * 50]})
    text = b"abcxyzabd" * 30
    whole = model.code_lengths(text)
    assert np.allclose(model.many([b"q", text, b""])[1], whole)
    old = language_id.BLOCK
    language_id.BLOCK = 50
    assert np.allclose(model.code_lengths(text), whole)
    language_id.BLOCK = old


def test_language(spark, clashing, empty):
    rng = random.Random(6)
    syllables = {"aa": ["ka", "mo", "ti", "ru"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["ción", "que", "los", "ñas"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(syllables))
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(30)), lang if i % 10 else None, "s", 0))
    rows += [(1000, None, "aa", "s", 0), (1001, "123 ... 456", "aa", "s", 0), (1002, "", "bb", "s", 0)]
    truth = {r[0]: r[2] for r in rows}
    found = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in found.items())
    assert all(r["lang_pred"] == truth[d] and r["score"] > 0.9 for d, r in found.items() if d < 1000 and truth[d])
    assert all(found[d]["lang_pred"] == "und" and found[d]["score"] == 0 for d in (1000, 1001, 1002))
    assert language_id.identify(empty).collect() == []
    assert language_id.identify(clashing).columns == ["doc_id", "held_out", "lang_pred", "score"]
    none = language_id.identify(spark.createDataFrame(rows, DOCS).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_language_of_one_hot_id_and_a_small_table(spark, monkeypatch):
    """Rows that share an id, long texts and a table too small for all grams change nothing but the time."""
    rng = random.Random(6)
    text = lambda own, n=30: " ".join("".join(rng.choice(own) for _ in range(3)) for _ in range(n))
    known = {"aa": ["ka", "mo", "ti", "ru"], "bb": ["sch", "ung", "ein", "ver"]}
    hot = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(hot, text(known[k]), k, "s", 0) for k in known for _ in range(300)] + [(None, text(known["aa"], 40000), "aa", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    found = language_id.identify(docs)
    truth = docs.groupBy("lang").count().collect()
    assert sorted((r["lang_pred"], r["count"]) for r in found.groupBy("lang_pred").count().collect()) == sorted(map(tuple, truth))
    before = sorted(map(tuple, found.select("lang_pred", F.round("score", 4)).collect()))
    monkeypatch.setattr(language_id, "TABLE_ENTRIES", 20)
    assert sorted(map(tuple, language_id.identify(docs).select("lang_pred", F.round("score", 4)).collect())) == before
    sample = language_id.sample(docs, "doc_id", "text", "lang")
    assert max(len(r["text"]) for r in sample.collect()) == language_id.TEXT_CHARS


def test_language_on_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    both = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in both) >= 0.95 * len(both)


def test_licenses(spark, docs, empty):
    cases = {
        "The MIT faculty renewed the library license for another year.": "", "The MIT board met, and a fishing license was sold.": "", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL",
        "Licensed under the Apache License, Version 2.0.": "Apache", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "This work is licensed under the GNU General Public License, version 3.": "GPL", "All rights reserved.": "", "Wir fahren mit dem Zug.": "", "A driving license is needed.": "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "MIT",
    }
    rows = [(i, f"Some text first.\n{p}\nAnd more.") for i, p in enumerate(cases)] + [(90, None), (91, ""), (92, "word " * 20000 + "Released under the MIT License.")]
    found = {r["doc_id"]: r for r in licenses.document_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i]["families"] for i in range(len(cases))] == list(cases.values())
    assert found[90]["n_paragraphs"] == found[91]["n_paragraphs"] == 0 and found[92]["families"] == "MIT"
    m = licenses.model()
    for p, family in cases.items():
        predicted, confirmed = m.predict(p)
        assert (predicted if confirmed else "") == family
    each = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in each} == {(i, 1, f) for i, f in enumerate(cases.values()) if f} | {(92, 0, "MIT")}
    assert licenses.document_table(empty).collect() == []
    assert licenses.document_table(docs.union(docs)).count() == 2 * docs.count()
    named = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "found", "paragraph", "family")})
    assert {r["doc_id"]: r for r in licenses.document_table(named).collect()} == found
    parts = {t: zlib.crc32(t.encode()) % 5 for _, t in licenses.examples()}
    assert 0 < sum(p == 0 for p in parts.values()) < len(parts)


def test_license_scores_match_plain_python(spark):
    m = licenses.model()
    lines = [t for _, t in licenses.examples()][::7]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", licenses.score(F.col("line")).alias("s")).orderBy("i").collect()
    for x, r in zip(lines, rows, strict=True):
        p = m.posterior(licenses.grams(licenses.words(x)))
        assert abs(r["s"]["posterior"] - max(p)) < 1e-9
        assert (r["s"]["family"], r["s"]["confirmed"]) == m.predict(x) or not r["s"]["confirmed"] and not m.predict(x)[1]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<div class="ad">Buy</div><{tag}><h1>Head &amp; more</h1><p><b>One  two
three<br><p>Second &eacute; &#x41;</p><aside>Side</aside><div class="share-buttons social">Share</div><section id="comments"><p>A comment</p></section></{tag}><form><input>Go</form><footer>&copy; site</footer></body></html>"""


@pytest.mark.parametrize("tag", ["article", "main", 'div id="content"'])
def test_main_text(spark, tag):
    page = PAGE.replace("</{tag}>", f"</{tag.split()[0]}>").replace("{tag}", tag)
    rows = [(i, f"http://h.org/{i}", page.replace("Second", f"Page {i}")) for i in range(8)]
    rows += [(90, None, None), (91, "http://h.org/x", ""), (92, "not a url", "plain text &lt; no markup"), (93, "http://one.org/", page), (0, "http://h.org/0", page.replace("Second", "Page 0"))]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))).collect()
    text = {r["page_id"]: r["text"] for r in found}
    assert len(found) == 13
    assert text[3] == "Head & more\n\nOne two three\n\nPage 3 é A"
    assert text[90] == text[91] == "" and text[92] == "plain text < no markup"
    assert text[93] == "Head & more\n\nOne two three\n\nSecond é A"
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_main_text_unclosed():
    assert html_text.main_text("<html><body><article><p>One<p>Two <b>bold", {"/html/body/article"}) == "One\n\nTwo bold"
    assert html_text.main_text("<p>a</p><!-- never closed", set()) == "a"
    assert html_text.main_text("<div hidden>no</div><div>yes</div>", set()) == "yes"


def test_template_classes(spark):
    rows = [("h.org", i, PAGE.replace("</{tag}>", "</article>").replace("{tag}", "article") + str(i)) for i in range(6)]
    found = html_text.equivalence_classes(spark.createDataFrame(rows, "host string, page long, html string")).collect()
    assert {r["token"] for r in found} >= {"/html", "/html/body", "/html/body/article"}
    assert html_text.main_slots(spark.createDataFrame(rows, "host string, page long, html string")).collect()[0]["slot"] == "/html/body/article"


def test_rollup(spark, docs, rows, empty, tmp_path):
    count = token_rollup.counter(*token_rollup.vocabulary())
    want = brute_counts(rows, count)
    found = {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"], r["n_bytes"]] for r in token_rollup.replay(docs, str(tmp_path / "r")).collect()}
    assert found == want
    assert token_rollup.replay(empty, str(tmp_path / "e")).collect() == []


def brute_counts(rows, count):
    """{(source, lang): [docs, tokens, bytes]} of the texts that white-space normalisation leaves."""
    out = {}
    for _, text, lang, source, *_ in rows:
        t = b" ".join((text or "").encode().split())
        if t:
            own = out.setdefault((source, lang), [0, 0, 0])
            own[0] += 1
            own[1] += count(t)
            own[2] += len(t)
    return out


def test_rollup_odd_cases(spark, clashing, rows, tmp_path):
    count = token_rollup.counter(*token_rollup.vocabulary())
    extra = clashing.withColumns({n: F.lit("clash") for n in ("old", "new", "op", "tokenizer", "old_tokens", "n_docs", "changed")})
    long = spark.createDataFrame([(9000, "z" * 200_000, "en", "a", 0), (9001, "two words " * 30_000, "en", "a", 0)], DOCS)
    more = [*rows, (9000, "z" * 200_000, "en", "a", 0), (9001, "two words " * 30_000, "en", "a", 0)]
    df = extra.select(*[c for c in long.columns]).unionByName(long)
    for n in ("old", "op", "n_docs"):
        df = df.withColumn(n, F.lit("clash"))
    found = {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"], r["n_bytes"]] for r in token_rollup.replay(df, str(tmp_path / "o")).collect()}
    assert found == brute_counts(more, count)


def test_interleaved_compaction(spark, tmp_path):
    """Two compactors that listed different batches: the second to finish changes nothing, and nothing counts twice."""
    rollup = token_rollup.Rollup(spark, str(tmp_path / "i"))
    batch = lambda n: token_rollup.signed_deltas(spark.createDataFrame([("s", "en", "t", "insert", 0, 0, n, n)], CHANGES))
    rollup.commit("b1", batch(10))
    rollup.commit("b2", batch(20))
    early = rollup.listed()
    rollup.commit("b3", batch(30))
    late = rollup.listed()
    want = [("s", "en", "t", 3, 60, 60)]
    assert rollup.compact(early) and got(rollup.totals()) == want
    assert not rollup.compact(late) and got(rollup.totals()) == want
    assert rollup.compact() and got(rollup.totals()) == want
    assert not rollup.compact() and not rollup.compact(early)
    rollup.vacuum()
    assert got(rollup.totals()) == want and [n for n in rollup._names() if n[0] == "b"] == ["base-0000000002"]
    assert not any(rollup.commit(b, batch(1)) for b in ("b1", "b2", "b3"))
    assert rollup.commit("b4", batch(1)) and got(rollup.totals()) == [("s", "en", "t", 4, 61, 61)]


CHANGES = "source string, lang string, tokenizer string, op string, old_tokens long, old_bytes long, new_tokens long, new_bytes long"


def test_rollup_commits(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, str(tmp_path / "c"))
    batch = lambda *rows: token_rollup.signed_deltas(spark.createDataFrame(list(rows), CHANGES))
    assert rollup.totals().collect() == []
    first = batch(("s", "en", "t", "insert", None, None, 10, 50), ("s", None, "t", "insert", None, None, 3, 9), ("s", "en", "u", "insert", 0, 0, 11, 50))
    second = batch(("s", "en", "t", "revise", 10, 50, 7, 40), ("s", None, "t", "delete", 3, 9, None, None))
    assert rollup.commit("one", first) and not rollup.commit("one", second)
    assert rollup.commit("two", second)
    want = [("s", "en", "t", 1, 7, 40), ("s", "en", "u", 1, 11, 50)]
    assert got(rollup.totals()) == want
    # A commit that was cut short has no marker: it doesn't count, and the retry does.
    broken = tmp_path / "c" / rollup._folder("three").rpartition("/")[2]
    broken.mkdir()
    assert got(rollup.totals()) == want
    assert rollup.commit("three", batch(("s", "de", "t", "insert", 0, 0, 1, 1)))
    rollup.compact()
    assert got(rollup.totals()) == [("s", "de", "t", 1, 1, 1), *want]
    assert not rollup.commit("one", first) and not rollup.commit("three", first)
    rollup.commit("four", batch(("s", "de", "t", "delete", 1, 1, 0, 0)))
    rollup.compact()
    assert got(rollup.totals()) == want and not rollup.commit("two", second)


def test_revisions_move_groups(spark, tmp_path):
    """A revision takes the old counts out of the group that the document leaves; another change is an error; of two writers one wins."""
    rollup = token_rollup.Rollup(spark, str(tmp_path / "m"))
    moved = spark.createDataFrame([("s", "fr", "t", "revise", 10, 50, 7, 40, "en"), ("s", "de", "t", "delete", 2, 3, None, None, None)], f"{CHANGES}, old_lang string")
    first = spark.createDataFrame([("s", "en", "t", "insert", 0, 0, 10, 50), ("s", "de", "t", "insert", 0, 0, 2, 3)], CHANGES)
    assert rollup.commit("one", token_rollup.signed_deltas(first)) and rollup.commit("two", token_rollup.signed_deltas(moved))
    assert got(rollup.totals()) == [("s", "fr", "t", 1, 7, 40)]
    for op in ("rename", None):
        with pytest.raises(Exception, match="no such change"):
            token_rollup.signed_deltas(spark.createDataFrame([("s", "en", "t", op, 0, 0, 1, 1)], CHANGES)).collect()
    draft = str(tmp_path / "m" / ".draft-x")
    token_rollup.signed_deltas(first).write.parquet(draft)
    assert not rollup._move(draft, rollup._folder("one")) and got(rollup.totals()) == [("s", "fr", "t", 1, 7, 40)]


def test_mixing(spark, empty):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        kind = rng.choices([0, 1, 2], [6, 2, 2])[0]
        own = words(rng, 40).split()
        if kind == 1:
            own = [w + "##" for w in own]
        if kind == 2:
            own[5] = rng.choice(["idiot", "moron"])
        rows.append((i, " ".join(own), "en", "a", 0))
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 2)))
    rows += [(2000, None, "en", "a", 0), (2001, "", "en", "a", 0)]
    labels += [(3, None, None), (None, 1, 0), (99999, 1, 0)]
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in mixing.rates(docs, table).collect()}
    bad = {r[0] for r in rows if r[1] and ("idiot" in r[1] or "moron" in r[1])}
    assert len(found) == len(rows) and all(r["rate"] >= 0 for r in found.values())
    assert all(abs(r["p_clean"] + r["p_low"] + r["p_toxic"] - 1) < 1e-9 for r in found.values())
    marked = {r[0] for r in rows if r[1] and "##" in r[1]}
    left = {r["doc_id"] for r in mixing.mix(docs, table).collect()}
    assert len(left & bad) <= 0.05 * len(bad) and len(set(found) - bad - marked - left) <= 0.02 * len(found)
    targets = {"clean": 1.0, "low": 2.0, "toxic": 0.5}
    scored = mixing.with_posteriors(docs.select("doc_id", "text"), mixing.train(docs, table))
    _, info = mixing.fit_rates(scored, targets)
    for d, x in info["wanted"].items():
        assert abs(info["after"][d] - x) <= 0.02 * sum(info["wanted"].values())
    # What leaves has the totals that were wanted; extra columns named like the operator's own and repeated rows stay.
    extra = docs.withColumns({c: F.lit("x") for c in ("_p", "_tokens", "tokens", "copy", "y", "mark", "key")})
    mixed = mixing.mix(extra, table, targets)
    assert mixed.columns == extra.columns and mixed.where("_p <> 'x' or copy <> 'x'").count() == 0
    again = mixing.with_posteriors(mixed.select("text"), mixing.train(docs, table)).select("_tokens", *[(F.col("_tokens") * F.element_at("_p", j + 1)).alias(d) for j, d in enumerate(mixing.DOMAINS)])
    totals = again.agg(*[F.sum(d).alias(d) for d in mixing.DOMAINS]).first()
    for d, x in info["wanted"].items():
        assert abs(totals[d] - x) <= 0.03 * sum(info["wanted"].values())
    twice = mixing.rates(docs.union(docs.where("doc_id < 100")), table)
    assert twice.count() == len(rows) + 100 and twice.where("doc_id < 100").groupBy("doc_id").agg(F.count_distinct("rate").alias("n")).where("n > 1").count() == 0
    assert mixing.rates(empty, table).collect() == []
    assert {r["rate"] for r in mixing.rates(docs, table.where("false")).collect()} != set()


def test_training_leaves_the_driver_alone(spark):
    """The sample's features stay in the tasks; the driver holds the weights, some times over while they are read, and nothing that grows with the sample."""
    import tracemalloc

    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(200_000)))))
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), text.alias("text"))
    table = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    tracemalloc.start()
    try:
        model = mixing.train(docs, table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (model.weights != 0).any(1).sum() > 50_000 and 0 < model.gradient <= mixing.TOLERANCE
    assert peak < 5 * model.weights.nbytes


def test_projected_gradient_against_plain_numpy(spark):
    """The same steps in numpy, and a target that needs the projection."""
    import numpy as np

    rng = np.random.default_rng(1)
    p = np.array([mixing.on_grid(x) for x in rng.dirichlet([0.3, 0.3, 0.3], 200)])
    t = rng.integers(1, 100, 200)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p, strict=True)], T.StructType([T.StructField("_tokens", T.LongType()), T.StructField("_p", T.ArrayType(T.DoubleType()))]))
    targets = {"clean": 1.0, "low": 1.0, "toxic": 0.0}
    gradients, info = mixing.fit_rates(df, targets)
    r = np.ones(200)
    wanted = (p * t[:, None]).sum(0) * np.array([1, 1, 0])
    for _ in range(len(gradients)):
        scale = np.linalg.pinv((p * (t * (r > 0))[:, None]).T @ p)  # of the rates that can still move
        r = np.maximum(0, r - p @ (scale @ ((p * (t * r)[:, None]).sum(0) - wanted)))
    assert len(gradients) > 2 and info["off"] <= mixing.CLOSE
    # Targets that nonnegative rates can't reach are reported.
    alone = df.limit(1).withColumn("_p", F.array(F.lit(0.5), F.lit(0.0), F.lit(0.5)))
    _, missed = mixing.fit_rates(alone, {"clean": 0.0, "low": 0.0, "toxic": 1.0})
    assert 0.01 < missed["off"] < 1
    assert np.allclose(list(info["after"].values()), (p * (t * r)[:, None]).sum(0), rtol=1e-6)
