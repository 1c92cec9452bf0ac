"""Clean-up of policy papers and author lines as column expressions over a text's lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, lines, trim

# Cues of citations, in blocks and in lines; words that rule out an author line; marks beside names.
BLOCK_CUES = ("available at:", "http://", "https://", "doi.org", "see:", "publication", "law", "regulation", "article ", "directive")
LINE_CUES = ("http://", "https://", "doi.org", "available at:", "regulation", "directive", "law ", "commission", "beuc", "ministry", "proposal")
AUTHOR_STOP = ("abstract", "keywords", "introduction", "figure", "table", "doi", "http", "university", "institute", "open access", "copyright", "license", "received")
MARKS = r"[\d*†‡§]+"
CORRESPONDENCE = r"\*Correspondence[:\s]+([A-Z][a-z]+(?:[\s\-][A-Za-z\-]+)+)\s+([\w.\-]+@[\w.\-]+\.\w+)"

#: Blocks at the start of a paper that are never taken for footnotes, of all.
SPARED = 0.20
MAX_AUTHORS, AUTHOR_LINES = 10, 50


def has(c: Column, cues: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(x) for x in cues])


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def shouted(s: Column) -> Column:
    """A short line in capitals or like a code, as logos leave them."""
    form = s.rlike(r"\A(?:[A-Z][A-Z0-9\-\s]{7,27}|[A-Z0-9\-]{3,}\s+[A-Z0-9\-]{2,})\z")
    return form & (F.length(s) <= 28) & (count(s, r"\S+") <= 3) & ~s.rlike("[.,;:!?]")


def fragment(s: Column) -> Column:
    """A short line without digits, half of whose words have two or three letters."""
    words, short = count(s, "[A-Za-z]{2,}"), count(s, "(?<![A-Za-z])[A-Za-z]{2,3}(?![A-Za-z])")
    return (F.length(s) <= 32) & words.between(1, 6) & (2 * short >= words) & ~s.rlike(r"\A\(|(?U)\d")


def without_logos(rows: Column) -> Column:
    """Lines but for logo rests: shouted ones, and fragments between blank lines."""
    blank = lambda at: F.coalesce(trim(F.get(rows, at)) == "", F.lit(True))
    kept = lambda row, i: let(trim(row), lambda s: (s == "") | s.rlike(r"\A[#\-]") | ~(shouted(s) | (fragment(s) & blank(i - 1) & blank(i + 1))))
    return F.filter(rows, kept)


def blocks(c: Column) -> Column:
    """Non-blank parts between blank lines, trimmed."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), trim), lambda b: b != "")


def citation_line(s: Column) -> Column:
    return s.rlike(r"\A\d{1,3}\s") & has(F.lower(s), LINE_CUES) & s.rlike(r"\b(?:19|20)\d{2}\b")


def citation_block(b: Column) -> Column:
    return b.rlike(r"\A\d{1,3}[^\S\n]") & has(F.lower(b), BLOCK_CUES) & b.rlike(r"\b(?:19|20)\d{2}\b")


def footnotes_last(c: Column) -> Column:
    """Numbered citations, those in lines and those in blocks, under one heading at the end, each once.

    A line that goes on with the next numbered text after its citation is cut there.
    """

    def parted(s: Column) -> Column:
        cut = F.split(s, r"(?<=\)\.)\s+(?=\d{1,3}\s+[A-Z])", 2)
        return F.when(citation_line(s), F.struct(F.get(cut, F.lit(0)).alias("note"), F.get(cut, F.lit(1)).alias("rest"))).otherwise(F.struct(F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("rest")))

    def whole(halves: Column) -> Column:
        body = F.transform(lines(trim(F.get(halves, F.lit(0)))), lambda row: let(parted(trim(row)), lambda x: F.struct(x["note"].alias("note"), F.when(x["note"].isNull(), row).otherwise(x["rest"]).alias("row"))))
        labelled = F.when(F.size(halves) > 1, blocks(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        left = lambda x: blocks(F.array_join(F.filter(x["row"], lambda row: row.isNotNull()), "\n"))
        return let(body, lambda x: let(left(x), lambda own: joined(own, F.concat(labelled, F.filter(x["note"], lambda n: n.isNotNull())))))

    def joined(own: Column, notes: Column) -> Column:
        late = lambda b, i: (i >= F.floor(F.size(own) * SPARED)) & citation_block(b)
        every = F.array_distinct(F.concat(notes, F.filter(own, late)))
        section = lambda x: F.when(F.size(x) > 0, F.concat(F.array(F.lit("# Footnotes")), x)).otherwise(x)
        return trim(F.array_join(F.concat(F.filter(own, lambda b, i: ~late(b, i)), let(every, section)), "\n\n"))

    return let(F.split(c, r"(?im)^\s*#\s*footnotes\s*$", 2), whole)


def clean_policy(c: Column) -> Column:
    """A policy paper without logo rests, its footnotes at the end."""
    left = let(lines(c), lambda rows: F.array_join(without_logos(rows), "\n"))
    return footnotes_last(F.regexp_replace(left, r"\n{3,}", "\n\n"))


def author_line(s: Column) -> Column:
    """Whether names stand in a line: length, a capital first, commas or "and", no stop word, four words in five capitalised."""
    bare = trim(F.regexp_replace(s, MARKS, ""))
    words, named = count(bare, r"[^\s,]+"), count(bare, r"(?<![^\s,])(?:[A-Z][^\s,]*|(?i:and))(?![^\s,])")
    return F.length(s).between(5, 150) & s.rlike(r"\A[A-Z]") & s.rlike(r"\band\b|,") & ~has(F.lower(s), AUTHOR_STOP) & (words > 0) & (5 * named >= 4 * words)


def authors(c: Column) -> Column:
    """array<struct<name, surname, email>>: up to MAX_AUTHORS names from author lines; the corresponding one has its address."""

    def person(part: Column) -> Column:
        clean = trim(F.regexp_replace(F.regexp_replace(part, MARKS, ""), r"(?U)\s+", " "))
        return F.struct(F.regexp_extract(clean, r"\A(.+) \S+\z", 1).alias("name"), F.regexp_extract(clean, r"\A.+ (\S+)\z", 1).alias("surname"))

    rows = F.filter(F.transform(F.slice(F.split(c, "\n"), 1, AUTHOR_LINES), trim), author_line)
    people = F.filter(F.transform(F.flatten(F.transform(rows, lambda s: F.split(s, r",\s*|\s+and\s+"))), person), lambda p: p["surname"] != "")
    part = lambda group: F.when(F.contains(c, F.lit("*Correspondence")), F.regexp_extract(c, CORRESPONDENCE, group)).otherwise("")
    corresponding = F.struct(part(2).alias("address"), trim(F.regexp_replace(part(1), MARKS, "")).alias("named"))

    def with_address(p: Column, x: Column) -> Column:
        full = F.concat_ws(" ", p["name"], p["surname"])
        own = (x["address"] != "") & (F.contains(full, x["named"]) | F.contains(x["named"], full))
        return F.struct(p["name"].alias("name"), p["surname"].alias("surname"), F.when(own, x["address"]).otherwise(F.lit("")).alias("email"))

    # The address is looked for once a text, not once a name.
    return let(corresponding, lambda x: F.slice(F.transform(people, lambda p: with_address(p, x)), 1, MAX_AUTHORS))
