"""Steps of body preparation on small texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lucidex.functions import body as B

LINE = "Text that goes on and on without a number at its end, as body text does"
BODY = [LINE] * 30


def run(spark, step, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in df.orderBy("i").select(step(F.col("text"))).collect()]


def lines(*parts):
    return "\n".join(x for p in parts for x in ([p] if isinstance(p, str) else p))


def test_contents(spark):
    rows = ["1 Intro .... 3", "", "2 More 7"]
    cases = [
        (lines("Contents", rows, "Abstract", BODY), lines("Abstract", BODY)),
        (lines("## Table of contents", rows, LINE, "3 Rest 9", LINE, LINE, BODY), lines(LINE, BODY)),  # one line of patience, then two
        (lines("toc", "x" * 181, BODY), lines("x" * 181, BODY)),
        (lines(BODY, "Contents", rows), lines(BODY, "Contents", rows)),  # too late
        (lines(BODY), lines(BODY)), ("", ""), (None, None),
    ]
    assert run(spark, B.strip_contents, [c[0] for c in cases]) == [c[1] for c in cases]
    # Without a heading the first frame with most rows starts the table; five lines in a row end it.
    many = [f"{i} Part .... {i}" for i in range(12)]
    assert run(spark, B.strip_contents, [lines("Head", many, BODY)]) == [lines("Head", BODY[4:])]


def test_contents_end_after_so_many_lines(spark):
    rows = [f"{i} Part .... {i}" for i in range(400)]
    assert run(spark, B.strip_contents, [lines("Contents", rows, BODY * 30)]) == [lines(rows[249:], BODY * 30)]


def entries(n):
    return [f"[{i}] Author, A. Title of a work (2001)." for i in range(n)]


def test_references(spark):
    cases = [
        (lines(BODY, "# References", entries(3)), lines(BODY)),
        (lines("References", BODY), lines("References", BODY)),  # too early
        (lines(BODY, entries(30)), lines(BODY)),
        (lines(BODY, entries(9)), lines(BODY, entries(9))),  # under 40 lines
        (lines(BODY * 3, entries(7)), lines(BODY * 3, entries(7))),  # too few
        (lines(BODY * 10, entries(10)), lines(BODY * 10, entries(10))),  # too thin
        ("", ""), (None, None),
    ]
    assert run(spark, B.strip_references, [c[0] for c in cases]) == [c[1] for c in cases]


def test_citation_tail(spark):
    links = [f"10.1000/x{i}" for i in range(12)]
    cases = [
        (lines(BODY, links[:8]), lines(BODY[:28])),  # the first frame of six with four links
        (lines(BODY, links), lines(BODY, links)),  # the same frame, but not late enough
        (lines(BODY[:10], links), lines(BODY[:10], links)),  # under 30 lines
        (lines(BODY[:15], links * 2), lines(BODY[:15], links * 2)),  # starts before the cut may
        (lines(BODY, links[:3]), lines(BODY, links[:3])),
        ("", ""), (None, None),
    ]
    assert run(spark, B.strip_citation_tail, [c[0] for c in cases]) == [c[1] for c in cases]


@pytest.mark.parametrize("fast", [False, True])
def test_prepare(spark, fast):
    df = spark.createDataFrame([(1, lines("Contents", "1 Intro .... 3", "Introduction", BODY, "## Notes", "1 note")), (2, None), (3, "")], "id int, text string")
    found = dict(map(tuple, B.prepare(df, fast=fast).collect()))
    body = " ".join(BODY).lower().replace(",", "")
    assert found == {1: ("contents 1 intro .... 3 introduction " if fast else "introduction ") + body, 2: None, 3: ""}
