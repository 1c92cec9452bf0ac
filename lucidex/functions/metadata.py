"""Bibliographic metadata read from text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Words that rule a line out as a title; trusted article hosts; words of journal lines; patterns of journal names, months and links. The patterns in the functions below (DOI, abstract, year, flags) are fixed values too.
NOT_TITLE = ("journal", "doi:", "http", "vol.", "issn", "received:", "accepted:", "copyright")
TRUSTED = ("sciencedirect", "springer", "wiley", "nature.com", "thelancet", "bmj", "frontiersin", "plos", "pubmed.ncbi.nlm.nih.gov", "who.int", "cdc.gov", "acpjournals", "nejm.org", "jama.jamanetwork.com")
JOURNAL_WORDS = ("Journal", "Review", "Nature", "Science", "Lancet", "Medicine")
JOURNAL_PATTERNS = (
    r"Published in\s*[:]?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)",
    r"Journal of\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)",
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\s+Journal)",
    r"Source\s*[:]?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)",
)
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
LINK = r"(https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-z]{2,6}\b(?:[-a-zA-Z0-9@:%_\+.~#?&//=]*))"


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def doi_to_id(doi: Column) -> Column:
    return F.translate(doi, "/.-", "___")


def hash_doi(doi: Column) -> Column:
    return F.sha2(doi, 256)


def doi(c: Column) -> Column:
    """A DOI behind doi.org/, else one anywhere, without closing punctuation."""
    url = _found(c, r"(?i)(?:doi[:\s]+)?(?:https?://)?(?:dx\.)?doi\.org/(10\.\S+)")
    return F.regexp_replace(F.coalesce(url, _found(c, r"(10\.\d{4,}/\S+)")), r"[.,;)]+\z", "")


def title(c: Column) -> Column:
    """The first of ten non-blank lines of 3 to 40 words, under 450 characters, without a ruled-out word."""
    own = F.slice(F.filter(F.transform(F.split(c, "\n"), T.trim), lambda x: x != ""), 1, 10)

    def fits(x: Column) -> Column:
        words = F.size(F.split(x, r"(?U)\s+"))
        bad = F.lit(False)
        for w in NOT_TITLE:
            bad = bad | F.lower(x).contains(w)
        return ~bad & words.between(3, 40) & (F.length(x) < 450)

    return F.try_element_at(F.filter(own, fits), F.lit(1))


def abstract(c: Column) -> Column:
    """Up to 500 characters after abstract or summary, before the next section; null under 21."""
    # A run of white space and any other character are one of the squeezed text, so what lies beyond 502 of them doesn't count.
    unit, stop = r"(?:\s++|\S)", r"(?=(?:introduction|keywords|1\.\s|methods|methodology|related work|background)|\z)"
    cue = rf"(?isU)(?:abstract|summary)\s*[:]*\s*((?:{unit}{{1,502}}?{stop}|{unit}{{502}}))"
    own = F.substring(T.squeeze(F.regexp_extract(c, cue, 1)), 1, 500)
    return F.when(F.length(own) > 20, own)


def year(c: Column) -> Column:
    """The year of an ISO-like date, else after a month's name, else any of 1900 to 2099."""
    return F.coalesce(
        _found(c, r"\b((?:19|20)\d{2})[-/.](?:0[1-9]|1[012])[-/.](?:0[1-9]|[12][0-9]|3[01])\b"),
        _found(c, rf"(?i)\b(?:{MONTHS})\s+((?:19|20)\d{{2}})\b"),
        _found(c, r"\b(19\d{2}|20\d{2})\b"),
    )


def journal(c: Column) -> Column:
    """A name by one of four patterns, else a short line of the first 15 with a journal word."""

    def fits(x: Column) -> Column:
        any_word = F.lit(False)
        for w in JOURNAL_WORDS:
            any_word = any_word | x.contains(w)
        return any_word & (F.size(F.split(x, r"(?U)\s+")) < 10)

    line = F.try_element_at(F.filter(F.transform(F.slice(F.split(c, "\n"), 1, 15), T.trim), fits), F.lit(1))
    return F.coalesce(*[F.trim(_found(c, p)) for p in JOURNAL_PATTERNS], line)


def link(c: Column, known_doi: Column) -> Column:
    """The DOI's address, else the first link on a trusted host, else the first link."""
    links = F.regexp_extract_all(c, F.lit(LINK), F.lit(1))

    def trusted(x: Column) -> Column:
        out = F.lit(False)
        for host in TRUSTED:
            out = out | x.contains(host)
        return out

    first = F.coalesce(F.try_element_at(F.filter(links, trusted), F.lit(1)), F.try_element_at(links, F.lit(1)))
    return F.when(F.coalesce(known_doi, F.lit("")) != "", F.concat(F.lit("https://doi.org/"), known_doi)).otherwise(first)


def summary(c: Column) -> Column:
    """All of it in one struct; nothing raises."""
    from .policy import authors

    own = doi(c)
    return F.struct(F.when(c != "", authors(c)).alias("authors"), own.alias("doi"), title(c).alias("title"), abstract(c).alias("abstract"), journal(c).alias("journal"), year(c).alias("year"), link(c, own).alias("link"))


def _flag(condition: Column) -> Column:
    return F.when(condition, "found").otherwise("not_found")


def detect(c: Column) -> dict[str, Column]:
    """Which of five kinds of metadata show, as found or not_found."""
    first = F.slice(T.lines(T.trim(c)), 1, 10)
    start = F.substring(c, 1, 2000)
    return {
        "has_doi": _flag(c.rlike(r"10\.\d{4,}/\S+")),
        "has_abstract": _flag(c.rlike(r"(?iU)\babstract\b")),
        "has_references": _flag(c.rlike(r"(?iU)\breferences\b")),
        "has_title": _flag(F.exists(first, lambda x: F.length(T.trim(x)).between(11, 299))),
        "has_authors": _flag(start.rlike(r"(?U)[A-Z][a-z]+\s+[A-Z][a-z]+|(?:authors?|by)\s*:|[A-Z]\.\s*[A-Z][a-z]+")),
    }


def detected(flags: list[Column]) -> Column:
    """How many are found."""
    return sum((F.when(f == "found", 1).otherwise(0) for f in flags), F.lit(0))


def decoded_upload(c: Column) -> Column:
    """Bytes of a `header,payload` upload in base 64; null if it can't be read."""
    return F.try_to_binary(F.split_part(c, F.lit(","), F.lit(2)), F.lit("base64"))


def pdf_url_candidates(best: Column, locations: Column, open_url: Column) -> Column:
    """Addresses in order of preference, each once, without null and blank ones."""
    return F.filter(F.array_distinct(F.array_compact(F.concat(F.array(best), locations, F.array(open_url)))), lambda u: u != "")


def keyword_set(c: Column) -> Column:
    """Distinct lower-case parts between commas, bars and semicolons."""
    return F.array_distinct(F.filter(F.transform(F.split(c, "[,|;]"), lambda x: F.lower(T.trim(x))), lambda x: x != ""))
