"""The pipeline's near-duplicates against brute-force Jaccard."""

from __future__ import annotations

import itertools
import random

import brute
import corpus_pipeline
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lucidex.llm import common, near_copies, simhash


def shingle_set(text, n=5):
    w = brute.words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([" ".join(w)] if w else [])


def survivors(rows):
    """Smallest ids of the components of all pairs with Jaccard >= 0.8."""
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if 10 * both >= 8 * every:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {root(d) for d in sets}


def stage(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}


def made():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for length in (60, 100, 300, 1000):
        for _ in range(10):
            text = [word() for _ in range(length)]
            rows.append(" ".join(text))
            for changes in (1, 2, length // 40, length // 15):
                other = list(text)
                for _ in range(changes):
                    other[rng.randrange(length)] = word()
                rows.append(" ".join(other))
    # A crowd with a common passage but different rests, and a chain of edits whose ends differ.
    rows += [" ".join([*passage, *[word() for _ in range(rng.choice((15, 40)))]]) for _ in range(60)]
    text = [word() for _ in range(120)]
    for _ in range(40):
        text = list(text)
        text[rng.randrange(120)] = word()
        rows.append(" ".join(text))
    rows += ["", " ", None, "a b", "A  b", "a c"]
    return list(enumerate(rows))


def test_stage_is_brute_force_jaccard(spark):
    rows = made()
    assert stage(spark, rows) == survivors(rows)


def test_one_changed_word_is_a_near_copy(spark):
    rng = random.Random(5)
    text = [f"w{rng.randrange(5000)}" for _ in range(100)]
    edited = [*text[:50], "changed", *text[51:]]
    assert stage(spark, [(1, " ".join(text)), (2, " ".join(edited))]) == {1}


def test_given_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert stage(spark, rows) == survivors(rows)


def test_similarity_at_the_limit():
    assert near_copies.MIN_JACCARD == 0.8


def test_no_text_is_lost(spark):
    """Null and repeated ids with different texts, repeated rows, and columns with the operators' own names."""
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(40))
    texts = [text() for _ in range(8)]
    rows = [(None, t) for t in texts[:5]] + [(7, texts[5]), (7, texts[6]), (8, texts[7])]
    rows += [(None, texts[0]), (7, texts[5]), (9, texts[1]), (7, texts[5])]
    schema = "doc_id long, text string, _id string, place string, mark string, root string, node string, fp string, `a.b` string"
    docs = spark.createDataFrame([(d, t, *["x"] * 7) for d, t in rows], schema).repartition(3)
    for own in (simhash, near_copies):
        kept = own.deduplicate(docs)
        assert kept.columns == docs.columns
        got = [(r["doc_id"], r["text"]) for r in kept.collect()]
        # One row of each text; a text with an id keeps the smallest one.
        want = {texts[0]: None, texts[1]: 9, **dict.fromkeys(texts[2:5]), texts[5]: 7, texts[6]: 7, texts[7]: 8}
        assert len(got) == 8 and {t: d for d, t in got} == want
        assert own.deduplicate(docs.where("false")).collect() == []


def test_crowd_bound_is_exact(spark):
    """A crowd of edited copies at all distances from its origin against brute force."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        own = list(base)
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(120)] = f"x{rng.randrange(40)}" if rng.random() < 0.3 else f"y{rng.random()}"
        rows.append((i, " ".join(own)))
    assert stage(spark, rows) == survivors(rows)


def test_operator_six_links_without_any_key(spark):
    """Pairs within two bits come from reference distances alone, in crowds too, and are verified like those of keys."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for length in (60, 400, 1500):
        for _ in range(12):
            text = [word() for _ in range(length)]
            rows += [" ".join(text), " ".join([*text[:-1], "changed"])]
    long = [word() for _ in range(2500)]
    rows += [" ".join([*long[:i], "x", *long[i + 1 :]]) for i in range(0, 2500, 25)]  # a crowd of one fingerprint or a few
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    nodes = near_copies.prints(docs).groupBy("node").agg(F.min("mark").alias("mark"), *[F.first(c).alias(c) for c in ("n", "fp", "keys")])
    bare = common.materialize(nodes.withColumn("keys", F.expr("array()").cast("array<long>")), "bare-nodes")
    fp, size = {r["node"]: r["fp"] for r in bare.collect()}, bare.count()
    apart = lambda a, b: bin((fp[a] ^ fp[b]) & (1 << 64) - 1).count("1")
    sets = [near_copies.shingles(t.encode()) for t in rows]
    node = [simhash.signed(xxh64_intdigest(t.tobytes(), 42)) for t in sets]
    near = {tuple(sorted((node[i], node[j]))) for i, j in itertools.combinations(range(72), 2) if apart(node[i], node[j]) <= 2 and 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))}
    found = [(r["a"], r["b"]) for r in near_copies.links(bare, docs).collect()]
    assert size == len(rows) and near and near <= set(found) and len(found) == len(set(found))
    crowd = set(node[72:])
    assert len([1 for a, b in found if a in crowd and b in crowd]) >= 60
    proposed = {(r["a"], r["b"]) for r in near_copies.near_prints(bare).collect()}
    assert near <= proposed and all(a < b and apart(a, b) <= 2 for a, b in proposed)
