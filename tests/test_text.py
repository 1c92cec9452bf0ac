"""Text functions against plain Python, on written and on random inputs."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lucidex.functions import folds, policy
from lucidex.functions import text as T


def run(spark, f, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return [r["r"] for r in spark.createDataFrame(rows, "i int, t string").select("i", f(F.col("t")).alias("r")).orderBy("i").collect()]


def randoms(tokens, n=400, seed=5, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(tokens) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_hyphens(spark):
    def plain(t):
        def join(m):
            return f"{m[1]}-{m[2]}" if m[1].lower() in T.KEEP_HYPHEN else m[1] + m[2]

        t = re.sub(r"(\w+)-\s*\n\s*([a-z]\w*)", join, t)
        t = re.sub(r"(\w+) - ([a-z]\w*)", join, t)
        return re.sub(r"(\w+) -\s*\n\s*([a-z]\w*)", join, t)

    texts = ["misinforma-\ntion", "self-\nmade", "well - known", "a -\nb", "A-\nB", *randoms(["self", "mis", "é", "x", "-\n", " - ", " -\n", " ", "-", "A", "b1", "\n", "_", "co"])]
    assert run(spark, T.rejoin_hyphens, texts) == [plain(t) for t in texts]


def test_repeated_lines(spark):
    def plain(t):
        rows = t.splitlines()
        norm = [re.sub(r"\d+", "#", re.sub(r"\s+", " ", x).strip().lower()) for x in rows]
        return "\n".join(x for x, n in zip(rows, norm, strict=True) if not n or norm.count(n) < 3)

    texts = ["Page 1\na\nPage 2\nb\nPage 3", "\n\n\n", "", *randoms(["p 1", "P 2", "x", "\n", "\n", "\r\n", " ", "\x0c", " "])]
    assert run(spark, T.drop_repeated_lines, texts) == [plain(t) for t in texts]


def plain_chunks(text, size, overlap):
    parts = [re.sub(r"\s+", " ", p).strip() for p in re.split(r"\n\s*\n", text.replace("\r\n", "\n").replace("\r", "\n"))]
    out, current = [], ""
    for p in (p for p in parts if re.search("[A-Za-z0-9]", p)):
        if len(p) > size:
            out += [current] * bool(current)
            out += [x for i in range(0, len(p), size - overlap) if (x := p[i : i + size].strip())]
            current = ""
        elif len(joined := f"{current}\n\n{p}" if current else p) <= size:
            current = joined
        else:
            out.append(current)
            current = p
    return out + [current] * bool(current)


def test_chunks(spark):
    texts = ["one\n\ntwo", "x" * 50, "---\n\n***", "", *randoms(["ab", "c d", " ", "\n\n", "\n \n", "\r\n\r\n", "-", "word"], most=40)]
    assert run(spark, lambda c: T.chunks(c, 20, 5), texts) == [plain_chunks(t, 20, 5) for t in texts]
    with pytest.raises(ValueError):
        T.chunks(F.col("t"), 5, 5)


def test_tail_window_repeats(spark):
    text = "a" * 1150
    assert [len(x) for x in run(spark, T.fixed_windows, [text])[0]] == [1150, 150]


def test_sentences(spark):
    texts = ["A sentence that has thirty characters or so. Short. Another sentence of thirty characters!  And more words here, enough of them?"]
    assert run(spark, T.sentences, texts)[0] == [s.strip() for s in re.split(r"(?<=[.!?])\s+", texts[0]) if len(s.strip()) >= 30]


def test_similarity_form(spark):
    assert run(spark, T.similarity_form, ["## Head\n[Figure 2: x] A, b¹–c  D"]) == ["head a bc d"]


def test_headings(spark):
    assert run(spark, T.headings_to_level_one, ["### Part\nAbstract\nbody\n####### no"]) == ["# Part\n# Abstract\nbody\n####### no"]


def test_indexing_cleanup(spark):
    lines = ["•", "ab", "12", "# ab", "@name tag", "mail a@b.org @x", "a_b", "Привет all", "plain line", "ends. @x"]
    assert run(spark, T.indexing_cleanup, ["\n".join(lines)]) == ["12\n# ab\nmail a@b.org @x\nplain line\nends. @x"]


def test_legal_lines(spark):
    assert run(spark, T.strip_legal, ["keep\n* Correspondence: x\n© The Author(s) 2020 etc\nReceived: a / Accepted: b\n\n\n\nend"]) == ["keep\n\nend"]


def test_fragmentation(spark):
    assert run(spark, T.fragmentation, ["", "A line that is long enough to be no orphan at all.\nbroken wor-\nds", "# Head\n- item\n1. x"]) == [0.0, 0.3333, 0.0]


def test_fragmentation_as_its_sql(spark, tmp_path):
    """Shares that are ties by a hair, texts without lines, and marks that are white space, line ends or digits in Unicode only."""
    import duckdb
    from lucidex.plans import queries, sql

    long = "a line that is long enough to be no orphan at all"
    ties = ["\n".join(["orphan"] * k + [long] * (800 - k)) for k in range(0, 800, 100)] + ["\n".join(["orphan"] * k + [long] * (800 - k)) for k in (57, 69, 113, 631)]
    odd = randoms(["ab", "wor-", "-", "*", "1", "\u0663", ")", ". ", "\n", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", " ", "\t", "#", long])
    rows = list(enumerate([None, "", "\n", " ", "a\r\nbcd", "\n\n", *ties, *odd]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries()["fragmentation"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(sql()["fragmentation"]).fetchall())


def test_sentences_keep_their_digits(spark):
    """Sentences are trimmed of white space, not of the digits of their own number."""
    assert run(spark, lambda c: T.sentences(c, 1), ["0 zero. 1 one1. 2\xa0"]) == [["0 zero.", "1 one1.", "2"]]


def test_rounded(spark):
    """Ties as in SQL: 57 / 800 is just under one."""
    got = spark.range(1).select(T.rounded(F.lit(57) / F.lit(800), 4), T.rounded(F.lit(27) / F.lit(32), 4), T.rounded(F.lit(1) / F.lit(3), 4)).first()
    assert tuple(got) == (0.0712, 0.8438, 0.3333)


def test_stitch():
    long = "word " * 11 + "this discomfort is"
    rest = "associated with " + "word " * 12 + "end."
    assert folds.stitch_paragraphs(f"{long}\n\n# Head\n\n<!-- image -->\n\n{rest}") == f"{long} {rest}\n\n# Head\n\n<!-- image -->"
    other = "Capital " + rest
    assert folds.stitch_paragraphs(f"{long}\n\n{other}\n\n{rest}") == f"{long}\n\n{other}\n\n{rest}"
    assert folds.stitch_paragraphs("") == ""


def one(spark, c, text):
    return spark.createDataFrame([(text,)], "text string").select(c(F.col("text")).alias("x")).first()["x"]


def test_footnotes(spark):
    text = "Intro text\n\nBody two\n\n3 See: Regulation of 2019\n\nTail\n\n4 Other https://x.org 2020"
    assert one(spark, policy.clean_policy, text) == "Intro text\n\nTail\n\n# Footnotes\n\n3 See: Regulation of 2019\n\n4 Other https://x.org 2020"
    # A citation and the next numbered text in one line; a labelled section; one citation twice.
    text = "ACME-7 EU GROUP\nBody one is long enough\n5 Law of 2018 (see). 6 Next text goes on\n\nEU by us\n\n# Footnotes\n\n7 Old one\n\n5 Law of 2018 (see)."
    assert one(spark, policy.clean_policy, text) == "Body one is long enough\n6 Next text goes on\n\n# Footnotes\n\n7 Old one\n\n5 Law of 2018 (see)."
    assert one(spark, policy.clean_policy, "") == "" and one(spark, policy.clean_policy, None) is None
    assert folds.move_labelled_footnotes("a\n\nnote \\_x\n\nb", ["note _x", "absent"]) == "a\n\nb\n\n# Footnotes\n\nnote _x"


def test_fuzzy():
    assert folds.fuzzy_ratio("Hello World", "WORLD") == 1.0
    assert folds.fuzzy_ratio("abc", "longer than it") == 0.0
    assert 0.8 < folds.fuzzy_ratio("the quick brown fox jumps", "quick brawn fox") < 1


def test_authors(spark):
    found = one(spark, policy.authors, "A Title\nAnn Lee1, Bo Chu* and Carl May\n*Correspondence: Bo Chu bo@x.org")
    assert [tuple(r) for r in found] == [("Ann", "Lee", ""), ("Bo", "Chu", "bo@x.org"), ("Carl", "May", "")]
    assert one(spark, policy.authors, "University of X, Y\nshort, a") == [] and one(spark, policy.authors, None) is None


def test_references_heading_behind_the_line_break(spark):
    """The share of the text may end inside the heading's line or right before it: such a line doesn't start in the rest."""
    heading = "\nReferences\n1. A."
    texts = ["The shor." + heading, "That*** atly.###" + heading, "A body of some length" + heading]
    assert run(spark, T.strip_references_heading, texts) == [texts[0], "That*** atly.###", "A body of some length"]


def test_gestalt_is_the_library_ratio():
    from difflib import SequenceMatcher

    rng = random.Random(3)
    for letters, most in (("ab", 12), ("abc ", 40), ("abcdefghijklm nopq", 260), ("aé§😀", 30)):
        for _ in range(300):
            a = "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
            b = a if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
            b = "".join(c for c in b if rng.random() > 0.1)
            assert folds.gestalt(a, b) == SequenceMatcher(None, a, b).ratio()


def test_gestalt_of_edited_and_long_texts():
    """Blocks between edits and around rare letters; a ratio under the least may come out higher, after fewer blocks; many are the same both ways."""
    from difflib import SequenceMatcher
    from unittest import mock

    rng = random.Random(8)
    unlike, both_ways = [], []
    for letters in ("ab", "abc ", "etaoinshrdlu .,", "abcdefghijklmnopqrstuvwxyzäöü .,eeeennnn"):
        for size in (3, 30, 120, 199, 200, 260, 700):
            for rate in (0.0, 0.01, 0.05, 0.4, 1.0):
                a = "".join(rng.choice(letters) for _ in range(size))
                b = "".join(rng.choice(["", letters[0], c + rng.choice(letters)]) if rng.random() < rate else c for c in a)
                for x, y in ((a, b), (b, a)):
                    ratio = SequenceMatcher(None, x, y).ratio()
                    back = SequenceMatcher(None, y, x).ratio()
                    with mock.patch.object(folds, "SequenceMatcher", side_effect=AssertionError):
                        assert folds.gestalt(x, y) == ratio
                        both_ways.append(folds.gestalt_both(x, y)[1])
                        assert not both_ways[-1] or back == ratio
                        for least in (0.8, 0.95, ratio):
                            got = folds.gestalt(x, y, least)
                            assert got == ratio or ratio <= got < least
                    if ratio < 0.7 and 100 < size < 200:
                        unlike.append((x, y))
    with mock.patch.object(folds, "longest_block", wraps=folds.longest_block) as made:
        calls = []
        for least in (0.0, 0.8):
            for x, y in unlike:
                folds.gestalt(x, y, least)
            calls.append(made.call_count)
    assert unlike and 2 * (calls[1] - calls[0]) < calls[0]
    assert 0 < sum(both_ways) < len(both_ways)
    assert folds.gestalt_both("a" * 30, "bc" * 100) == (0.0, False)


def test_fuzzy_ratio_of_long_texts():
    """The windows' ratios in their order, with few of them made."""
    from difflib import SequenceMatcher
    from unittest import mock

    def plain(hay, own):
        best = 0.0
        for i in range(0, len(hay) - len(own) + 1, max(1, len(own) // 4)):
            best = max(best, SequenceMatcher(None, own, hay[i : i + len(own)]).ratio())
            if best >= folds.EARLY:
                break
        return 1.0 if own in hay else round(best, 3)

    rng = random.Random(4)
    letters = "etaoinshrdlu "
    for _ in range(60):
        hay = "".join(rng.choice(letters) for _ in range(rng.randint(1, 600)))
        at = rng.randrange(len(hay))
        own = "".join(c if rng.random() > 0.15 else rng.choice("§x") for c in hay[at : at + rng.randint(1, 60)]) + "§" * rng.randint(0, 3)
        for text in (hay, hay * 2):
            assert folds.fuzzy_ratio(text, own) == plain(text, own)
    hay = "".join(rng.choice(letters) for _ in range(50_000))
    with mock.patch.object(folds, "gestalt", wraps=folds.gestalt) as made:
        assert folds.fuzzy_ratio(hay, hay[:30] + "§" * 10) == 0.75
    assert made.call_count <= 20


def test_lines_are_trimmed_and_judged_cheaply(spark):
    """Trimming is no pattern; the cheap conditions before the line patterns change no verdict."""
    white = [chr(i) for i in range(0x3001) if re.match(r"[\s\x85]", chr(i)) and not 0x1C <= i <= 0x1F]
    assert sorted(white) == sorted(T.WHITE_SPACE)
    texts = ["", None, *("".join(x) for x in zip(white, "ab" * 20, reversed(white))), *randoms([*white, "a", "é", "\x1c"])]
    assert "regexp" not in str(T.trim(F.col("t")))
    assert run(spark, T.trim, texts) == run(spark, lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+\z", ""), texts)
    rows = randoms(["http://", "HTTPS://", "DOI.org", "arXiv:", "10.1234/", "..", ".", "|", " 12", "3", "٣", "(2001)", ",", "Part ", "[1] ", "- ", "\t"], 600)
    rows = [r.strip() for r in rows]
    toc = r"(?U)^\s*(?:[-*]\s*)?(?:\d+(?:\.\d+)*\s+)?[^\n]{2,140}?\s+\d{1,4}\s*\z"
    pipes = lambda s: s.startswith("|") & (F.length(s) - F.length(F.replace(s, F.lit("|"))) >= 2)
    assert run(spark, T.toc_like, rows) == run(spark, lambda s: (s != "") & (s.rlike(r"\.{2,}") | pipes(s) | s.rlike(r"(?U)^\|?\s*\d{1,3}\s*\|") | s.rlike(toc)), rows)
    assert run(spark, T.citation_like, rows) == run(spark, lambda s: s.rlike(r"(?iU)(https?://|doi\.org|arxiv:|^10\.\d{4,}/)"), rows)


def test_abstract_ends_early(spark):
    """The first 500 characters of the squeezed abstract, as a search up to its end gives them."""
    from lucidex.functions import metadata as M

    def plain(t):
        m = re.search(r"(?is)(?:abstract|summary)\s*[:]*\s*(.+?)(?=(?:introduction|keywords|1\.\s|methods|methodology|related work|background)|\Z)", t)
        own = " ".join(m[1].split())[:500] if m else ""
        return own if len(own) > 20 else None

    texts = randoms(["Abstract:", "summary ", "some words here ", "  \n\t ", "Introduction", "1. ", "1.", "x", "a longer run of words with  gaps " * 12, "Background"], 300)
    assert run(spark, M.abstract, texts) == [plain(t) for t in texts]
    assert "502" in str(M.abstract(F.col("t")))
