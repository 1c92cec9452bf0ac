"""Merkle fingerprints, filter audit and fill-in-middle against plain versions, and the odd cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lucidex.llm import fill_in_middle as rope
from lucidex.llm import filter_audit as audit
from lucidex.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n", "\n\n\n\n", "a", "a\n", "\na", "é ü ß\n— “q”", "x" * 9000, "no stop " * 2000, "Ab. Cd! Ef?\n\n# Head\nMore words here.", "has <S> inside\nand a line", "ends<\n>S", "SHOUT NOW #1\n" * 12, "word " * 120]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(90):
        words = [rng.choice(["alpha", "Beta", "gamma.", "DELTA", "e1!", "über", f"w{rng.randrange(300)}"]) + rng.choice([" ", " ", " ", "\n", "\n\n"]) for _ in range(rng.randrange(0, 220))]
        out.append((i * 3, "".join(words) if i % 5 else (out[i - 3][1] if i > 3 else "same"), rng.choice(["en", "de", "", None]), "a", 0))
    return out + [(1000 + i, t, "en", None, 0) for i, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def repeated(spark, rows):
    """Repeated rows, one id with many texts, null ids."""
    return spark.createDataFrame([*rows[:20], rows[3], rows[3], *[(7000, f"text {i}\nand more", "de", "a", 0) for i in range(30)], *[(None, t, None, None, 0) for t in ("", "x y z", "x y z", None)]], DOCS)


def clash(docs, *names):
    return docs.withColumns({n: F.lit("clash") for n in names})


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, x) for x in r))


# Fill-in-middle


def plain_fim(key, text):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return key, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return key, n, form, len(p), len(m), sha(out), sha(text)


def test_fill_in_middle(docs, rows, repeated):
    assert got(rope.digest_table(docs)) == sorted(plain_fim(r[0], r[1]) for r in rows)
    want = [plain_fim(r[0], r[1]) for r in repeated.collect()]
    assert got(rope.digest_table(repeated)) == sorted(want, key=lambda r: tuple((x is None, x) for x in r))
    assert got(rope.digest_table(docs.limit(0))) == []


def test_fill_in_middle_keeps_columns(docs, rows):
    odd = clash(docs, "form", "output", "_draws", "n_units", "restored")
    out = rope.transform(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and len(set(out.columns)) == len(out.columns) == len(odd.columns) + 5
    added = out.columns[-5:]
    back = rope.restore(out, added[4], added[1])
    found = back.select("doc_id", "text", back.columns[-1], "form").collect()
    assert len(found) == len(rows) and all((r[1] or "") == r[2] and r[3] == "clash" for r in found)


def test_fill_in_middle_rates(docs):
    forms = {r[0] for r in rope.transform(docs, fim_rate=0).select("form").collect()}
    assert forms == {"plain"}
    assert {r[0] for r in rope.transform(docs, spm_rate=100).select("form").collect()} == {"plain", "spm"}


def depth_holds(node):
    if node is None or node.left is None:
        return True
    return abs(node.left.height - node.right.height) <= 1 and node.units == node.left.units + node.right.units and depth_holds(node.left) and depth_holds(node.right)


def test_ropes_stay_balanced(monkeypatch):
    rng = random.Random(2)
    for _ in range(400):
        monkeypatch.setattr(rope, "LEAF", rng.choice([1, 2, 5]))
        text = "".join(rng.choice("ab\né") for _ in range(rng.randrange(0, 120)))
        tree, units = rope.rope(text), re.findall(r"[^\n]*\n|[^\n]+", text)
        k, c = rng.randrange(len(units) + 1), rng.randrange(len(text) + 1)
        a, b = rope.split_units(tree, k)
        assert str(a or "") == "".join(units[:k]) and str(b or "") == "".join(units[k:])
        assert (a.units if a else 0) == k and depth_holds(a) and depth_holds(b)
        x, y = rope.split_chars(rope.concat(b, a), c)
        both = "".join(units[k:]) + "".join(units[:k])
        assert str(x or "") == both[:c] and str(y or "") == both[c:] and depth_holds(x) and depth_holds(y)


# Filter audit


def plain_audit(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, *_ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    out, removed_by = [], Counter()
    parts = {}
    for d, text, lang, *_ in docs:
        text = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and least[text] < d}
        parts.setdefault(lang or "", []).append((d, {k for k, v in fails.items() if v}))
    for part, own in parts.items():
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                gone = set(order[:k])
                now = [d for d, x in own if f in x and not x & gone]
                removed_by[part, f] += len(now)
                out.append([part, order, k + 1, sum(1 for _, x in own if not x & (gone | {f})), len(now), sum(1 for _, x in own if f in x and x & gone), sum(1 for _, x in own if x == {f}), sum(d in good for d in now), sum(d in toxic for d in now)])
    return sorted((*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(0, 1010, 2)] + [(6, 0, 1), (None, 1, 1), (9, None, None), (7000, 1, 0)], "doc_id long, quality int, toxic int")


def test_filter_audit(docs, rows, labels, repeated):
    own = [tuple(r) for r in labels.collect()]
    found = got(audit.audit(docs, labels))
    assert found == plain_audit(rows, own) and len(found) == 600 * 3
    assert got(audit.audit(repeated, labels)) == plain_audit([tuple(r) for r in repeated.collect()], own)
    assert got(audit.audit(clash(docs, "mask", "digest", "part", "n", "good", "toxic"), clash(labels, "good", "toxic_"))) == found
    assert got(audit.audit(docs.limit(0), labels)) == []
    assert all(r[8] == 0 for r in audit.audit(docs, labels.limit(0)).collect())


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
@pytest.mark.parametrize("collide", [False, True])
def test_scan_of_buffers(monkeypatch, block, collide):
    monkeypatch.setattr(audit, "BLOCK", block)
    rng = random.Random(block)
    tables = audit.Tables()
    if collide:  # words of one length have one hash
        tables.value[:] = 1
    texts = [None if rng.random() < 0.1 else "".join(rng.choice("abA \n#é|\t") for _ in range(rng.randrange(0, 90))) for _ in range(200)] + ["y" * 3000]
    found = audit.measured(pa.array(["before", *texts, "after"])[1:-1], tables)
    for i, text in enumerate(t or "" for t in texts):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        assert [int(x[i]) for x in found] == [len(w), len(set(w)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]
    assert [len(x) for x in audit.measured(pa.array([], pa.string()), tables)] == [0] * 5
    assert isinstance(found[0], np.ndarray)


# Merkle fingerprints


def plain_tree(text):
    sha = lambda level, x: hashlib.sha256((level + x).encode()).hexdigest()
    nodes, tops = Counter(), []
    weight = {}

    def add(h, size):
        nodes[h] += 1
        weight[h] = size
        return h

    for section in text.split("\n\n"):
        parts = []
        for p in section.split("\n"):
            leaves = [add(sha("l", x)[:32], len(x)) for x in re.findall(merkle.LEAF, p)]
            assert "".join(re.findall(merkle.LEAF, p)) == p
            parts.append(add(sha("p", "".join(leaves))[:32], 1))
        tops.append(add(sha("s", "".join(parts))[:32], 1))
    root = add(sha("d", "".join(tops)), 1)
    return root, nodes, weight


def plain_near(a, b):
    common = sum(min(n, b[1][h]) * a[2][h] for h, n in a[1].items())
    total = lambda t: sum(n * t[2][h] for h, n in t[1].items())
    return 2.0 * common / (total(a) + total(b))


def plain_edits(rows):
    by = {}
    for d, text, *_ in rows:
        by[d] = min(by.get(d, text or ""), text or "", key=lambda t: t.encode())
    ids = sorted(by, key=lambda d: (d is None, -(d or 0)))
    follow = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    out = []
    for d, text, *_ in rows:
        text, nxt = text or "", by[follow[d]]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        a, b, c = map(plain_tree, (text, edited, nxt))
        out.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), a[0], b[0], round(plain_near(a, b), 12), round(plain_near(a, c), 12)))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def edits(docs):
    return got(merkle.edit_table(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.round("near_edited", 12), F.round("near_next", 12)))


def test_merkle(docs, rows, repeated):
    found = edits(docs)
    assert found == plain_edits(rows)
    assert all((r[3] == r[4]) == (r[5] == 1.0) and 0 <= r[6] <= 1 for r in found)
    assert edits(repeated) == plain_edits([tuple(r) for r in repeated.collect()])
    assert edits(clash(docs, "doc", "part", "root", "next_text")) == found
    assert edits(docs.limit(0)) == []
    one = docs.where("doc_id = 3")
    assert len(edits(one)) == 1


def test_next_ids_do_not_depend_on_ranges(spark, docs, rows):
    ids = sorted({r[0] for r in rows}, reverse=True)
    want = sorted(zip(ids, [*ids[1:], ids[0]], strict=True))
    for parts in (1, 7, 300):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert sorted(map(tuple, merkle.next_ids(docs.select(F.col("doc_id").alias("doc"))).collect())) == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_branches_locate_edits(spark):
    pairs = [("a b.\nc d.\n\ne f.\ng h.", "a b.\nc d.\n\ne f.\ng X."), ("a", "a"), ("a\nb", "a\nb\nc"), ("a", "a\n\nb"), ("", "x")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    trees = df.select("i", merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b"))
    found = {r[0]: r[1] and tuple(r[1]) for r in trees.select("i", merkle.first_change(F.col("a"), F.col("b"))).collect()}
    assert found == {0: (1, 1), 1: None, 2: (0, 2), 3: (1, 0), 4: (0, 0)}
    named = merkle.fingerprints(df.withColumnRenamed("a", "text").drop("b")).collect()
    assert named[0]["fingerprint"] == plain_tree(pairs[0][0])[0]
