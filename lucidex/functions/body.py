"""The body of an extracted text: without contents, references, footnotes, boilerplate and citation tail.

Every step is a column expression over the lines and flags of the lines: what
the steps ask of runs and frames of lines is counted from the flags, so a
text is cut in the JVM, in the row.  Null text gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# Headings of contents and of what follows them; shares of the lines, frames, hits and patience of each step.
CONTENTS_HEADING = r"(?iU)^\s*(?:#{1,6}\s*)?(?:table of contents|contents|toc)\s*\z"
BODY_HEADING = r"(?iU)^\s*(?:#{1,6}\s*)?(?:abstract|introduction|executive summary|summary|background|review)\b"
CONTENTS_SHARE, CONTENTS_FRAME, CONTENTS_HITS, CONTENTS_LINES, NARRATIVE = 0.40, 10, 6, 250, 180
PATIENCE_UNDER_HEADING, PATIENCE = 2, 5
REFERENCES_SHARE, REFERENCES_LINES, REFERENCES_HITS, REFERENCES_RATIO = 0.40, 40, 8, 0.12
TAIL_SHARE, TAIL_LINES, TAIL_REST, TAIL_FRAME, TAIL_HITS, TAIL_CUT = 0.60, 30, 12, 6, 4, 0.70

_NO_INTS = "array<int>"


def _places(first: Column, last: Column) -> Column:
    """Whole numbers from first to last, none where last is smaller."""
    return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast(_NO_INTS))


def _joined(ls: Column) -> Column:
    return T.trim(F.array_join(ls, "\n"))


def first_dense(ls: Column, hit, width: int, least: int, share: float) -> Column:
    """1-based place, after share of the lines, of the first full frame of width lines with so many hits."""

    def first(flags: Column) -> Column:
        n = F.size(flags)
        dense = F.filter(_places(F.floor(n * share) + 1, n - width + 1), lambda i: F.aggregate(F.slice(flags, i, width), F.lit(0), lambda a, b: a + b) >= least)
        return F.try_element_at(dense, F.lit(1))

    return T.let(F.transform(ls, lambda x: F.when(hit(x), 1).otherwise(0)), first)


def strip_contents(c: Column) -> Column:
    """Without an early table of contents.

    It starts at its heading or, without one, at the frame of lines with the
    most rows of a table of contents, if they are enough.  It goes on to the
    first heading of body text, the first long line, or the line that makes
    too many lines in a row (blank ones aside) that aren't rows of it.
    """

    def marked(line: Column) -> Column:
        return T.let(T.trim(line), lambda s: F.struct(line.alias("line"), s.alias("s"), T.toc_like(s).alias("row")))

    def start_of(rows: Column) -> Column:
        reach = F.greatest(F.lit(1), F.floor(F.size(rows) * CONTENTS_SHARE).cast("int"))
        heads = F.transform(F.slice(rows, 1, reach), lambda x: F.when(x["s"].rlike(CONTENTS_HEADING), 1).otherwise(0))
        frames = F.transform(_places(F.lit(1), reach - CONTENTS_FRAME), lambda i: F.size(F.filter(F.slice(rows, i, CONTENTS_FRAME), lambda x: x["row"])))
        densest = T.let(frames, lambda f: F.when(F.array_max(f) >= CONTENTS_HITS, F.array_position(f, F.array_max(f))))
        return T.let(F.array_position(heads, F.lit(1)), lambda h: F.struct(F.when(h > 0, h).otherwise(densest).cast("int").alias("start"), F.when(h > 0, PATIENCE_UNDER_HEADING).otherwise(PATIENCE).alias("patience")))

    def end_of(rows: Column, at: Column) -> Column:
        """Place of the first line that isn't in the table any more."""
        last = F.least(F.size(rows), at["start"] + CONTENTS_LINES - 1)
        filled = F.filter(F.transform(_places(at["start"] + 1, last), lambda i: F.struct(i.alias("i"), rows[i - 1]["s"].alias("s"), rows[i - 1]["row"].alias("row"))), lambda x: x["s"] != "")

        def first_break(xs: Column) -> Column:
            stops = lambda x: ~x["row"] & (x["s"].rlike(BODY_HEADING) | (F.length(x["s"]) > NARRATIVE))
            tired = lambda k: (k >= at["patience"]) & ~F.exists(F.slice(xs, F.greatest(k - at["patience"] + 1, F.lit(1)), at["patience"]), lambda x: x["row"])
            breaks = F.filter(_places(F.lit(1), F.size(xs)), lambda k: stops(xs[k - 1]) | tired(k))
            return F.coalesce(F.get(xs, F.try_element_at(breaks, F.lit(1)) - 1)["i"], last + 1)

        return T.let(filled, first_break)

    def cut(rows: Column) -> Column:
        line = lambda part: F.transform(part, lambda x: x["line"])
        kept = lambda at: F.concat(line(F.slice(rows, 1, at["start"] - 1)), line(F.slice(rows, end_of(rows, at), F.greatest(F.size(rows), F.lit(1)))))
        return T.let(start_of(rows), lambda at: F.when(at["start"].isNull(), c).otherwise(_joined(kept(at))))

    return F.when(c != "", T.let(F.transform(T.lines(c), marked), cut)).otherwise(c)


def strip_implicit_references(c: Column) -> Column:
    """Without lines that read as references behind a share of the lines, where they are many."""

    def cut(ls: Column) -> Column:
        start = F.floor(F.size(ls) * REFERENCES_SHARE).cast("int")
        tail = F.slice(ls, start + 1, F.greatest(F.size(ls), F.lit(1)))
        body = F.filter(tail, lambda x: T.let(T.trim(x), lambda s: ~T.reference_like(s)))

        def judged(b: Column) -> Column:
            hits = F.size(tail) - F.size(b)
            heavy = (F.size(ls) >= REFERENCES_LINES) & (hits >= REFERENCES_HITS) & (hits / F.size(tail) >= REFERENCES_RATIO)
            return F.when(heavy, T.trim(T.squeeze_blank(F.array_join(F.concat(F.slice(ls, 1, start), b), "\n")))).otherwise(c)

        return T.let(body, judged)

    return T.let(T.lines(c), cut)


def strip_references(c: Column) -> Column:
    """Text before a heading of the references; without one, the text without what reads as references."""
    return T.let(T.section_place(c, T.REFERENCES, REFERENCES_SHARE), lambda at: F.when(at > 0, T.trim(F.substring(c, F.lit(1), at - 1))).otherwise(strip_implicit_references(c)))


def strip_citation_tail(c: Column) -> Column:
    """Text before the first frame of citation lines at its end."""

    def cut(ls: Column) -> Column:
        n = F.size(ls)
        first = first_dense(ls, lambda x: T.citation_like(T.trim(x)), TAIL_FRAME, TAIL_HITS, TAIL_SHARE)
        long = (n >= TAIL_LINES) & (n - F.floor(n * TAIL_SHARE) >= TAIL_REST)
        return T.let(first, lambda i: F.when(long & (i - 1 > F.floor(n * TAIL_CUT)), _joined(F.slice(ls, 1, i - 1))).otherwise(c))

    return T.let(T.lines(c), cut)


#: The steps of the body in their fixed order, and those of the fast form.
STEPS = (strip_contents, strip_references, T.strip_footnotes_heading, T.strip_legal, strip_citation_tail, T.similarity_form)
FAST_STEPS = (strip_references, T.strip_footnotes_heading, T.similarity_form)


def prepare(df: DataFrame, text: str = "text", fast: bool = False) -> DataFrame:
    """df with the text in column text as it is compared: steps in their fixed order, each once."""
    for step in FAST_STEPS if fast else STEPS:
        df = df.withColumn(text, step(F.col(f"`{text}`")))
    return df
