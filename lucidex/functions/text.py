"""Text functions as column expressions; all stay in the JVM.

Patterns use Unicode classes ((?U)) and line feeds as the only line end ((?d)).
Those that tell headings, references, contents rows and layout rests apart are
fixed values, as are the lists below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes that keep their hyphen when a line break splits a word.
KEEP_HYPHEN = ("self", "co", "re", "pre", "non", "anti", "counter", "cross", "over", "under", "inter", "intra", "multi", "post", "meta", "socio", "well", "long", "short", "high", "low")

# Line patterns of open-access boilerplate.
LEGAL_LINES = (
    r"^\s*open access this article is licensed under a creative commons.*$",
    r"^\s*to view a copy of this licence visit .*creativecommons\.org.*$",
    r"^\s*if material is not included in the article.?s creative commons licence.*$",
    r"^\s*the creative commons public domain dedication waiver.*$",
    r"^\s*received:\s*.+?/+\s*accepted:\s*.+$",
    r"^\s*\*?\s*correspondence:\s*.*$",
    r"^\s*©\s*the author\(s\)\s*\d{4}.*$",
)

# Front-matter labels that become headings.
FRONT_MATTER = ("review", "abstract", "addresses", "keywords")

#: What is white space in Unicode.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What is white space in plain texts.
PLAIN_SPACE = "\t\n\x0c\r "

# How an item of a list begins, and how in plain texts.
ITEM = r"(?U)^[-*•]\s|^\d+[.)]\s"
PLAIN_ITEM = r"^[-*•][\t\n\f\r ]|^[0-9]+[.)][\t\n\f\r ]"

MAX_CHUNK, OVERLAP = 1200, 200
MIN_SENTENCE = 30
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return trim(F.regexp_replace(c, f"[{WHITE_SPACE}]+", " "))


def trim(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def rounded(c: Column, digits: int) -> Column:
    """c, times a power of ten, rounded and divided again, as SQL engines round doubles; F.round() takes ties from c's shortest decimal form."""
    return F.round(c * 10**digits) / 10**digits


def lines(c: Column, end: str = LINE_END) -> Column:
    """Lines at any line end; no empty last one."""
    return let(F.split(c, end), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def normal_line(c: Column) -> Column:
    """One form for lines that differ in case, white space and numbers."""
    return F.regexp_replace(F.lower(squeeze(c)), r"(?U)\d+", "#")


def squeeze_blank(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def strip_legal(c: Column) -> Column:
    """Without boilerplate lines."""
    for pattern in LEGAL_LINES:
        c = F.regexp_replace(c, "(?imUd)" + pattern, "")
    return trim(squeeze_blank(c))


def letter_artifacts(c: Column) -> Column:
    """The infinity sign beside a letter is an a."""
    return F.regexp_replace(F.regexp_replace(c, "(?<=[a-zA-Z])∞", "a"), "∞(?=[a-zA-Z])", "a")


def named_entities(c: Column) -> Column:
    """Decode the five named entities in one pass each, the ampersand last."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def rejoin_hyphens(c: Column) -> Column:
    """Join words split by a hyphen at a line end or by a spaced hyphen."""
    keep = "|".join(KEEP_HYPHEN)
    # The hyphen comes first in each pattern, so the engine looks behind only at hyphens; group 1 is
    # there only behind a prefix; \\G keeps a word just joined on from being half of another join.
    for pre, gap in (("", r"\s*\n\s*"), (" ", " "), (" ", r"\s*\n\s*")):
        hyphen = rf"(?:(-)(?<=(?<!\w)(?i:{keep}){pre}-)|-(?<=\w{pre}-))"
        c = F.regexp_replace(c, rf"(?U)(?!\G){pre}{hyphen}{gap}([a-z]\w*)", "$1$2")
    return c


def strip_comments(c: Column) -> Column:
    """Without lines that hold only an HTML comment."""
    return F.regexp_replace(c, r"(?imUd)^\s*<!--.*?-->\s*$", "")


def drop_repeated_lines(c: Column, least: int = 3) -> Column:
    """Without lines whose normal form occurs at least so often in the text; blank ones stay.

    Counting is by sorted runs, so a text costs n log n.
    """
    pairs = F.transform(lines(c), lambda x: F.struct(x.alias("line"), normal_line(x).alias("norm")))

    def often(norms: Column) -> Column:
        # In sorted order a form that occurs often enough equals the one least - 1 places on.
        later = F.slice(norms, least, F.greatest(F.size(norms), F.lit(1)))
        return F.array_distinct(F.filter(F.zip_with(norms, later, lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull() & (x != "")))

    def kept(ps: Column) -> Column:
        gone = often(F.array_sort(F.transform(ps, lambda p: p["norm"])))
        return let(gone, lambda g: F.transform(F.filter(ps, lambda p: ~F.array_contains(g, p["norm"])), lambda p: p["line"]))

    return F.array_join(let(pairs, kept), "\n")


def low_signal(s: Column) -> Column:
    """Whether a trimmed, non-blank line says nothing for retrieval."""
    short = (F.length(s) <= 3) & s.rlike(r"^[A-Za-z0-9]+\z") & ~s.rlike(r"(?U)^\d+\z")
    marked = s.startswith("#") | s.startswith("-")
    scripts = (F.length(s) <= 48) & s.rlike("[A-Za-z]") & s.rlike(r"[Ѐ-ӿ]")
    handle = s.rlike(r"(?U)(^|[\s>])@\w+") | s.contains("_") | s.contains("•") | s.contains(">")
    email = s.rlike(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b")
    tag = handle & ~email & ~s.rlike("[.!?;:]") & (F.length(s) <= 120) & (F.size(F.split(s, r"(?U)\s+")) <= 20)
    return s.isin("•", "Q") | short | (~marked & (scripts | tag))


def indexing_cleanup(c: Column) -> Column:
    """Without low-signal lines."""
    kept = F.filter(lines(c), lambda x: let(trim(x), lambda s: (s == "") | ~low_signal(s)))
    return trim(squeeze_blank(F.array_join(kept, "\n")))


def paragraphs(c: Column) -> Column:
    """Paragraphs at blank lines, squeezed, those with an ASCII letter or digit."""
    unix = F.regexp_replace(c, r"\r\n?", "\n")
    return F.filter(F.transform(F.split(unix, r"(?U)\n\s*\n"), squeeze), lambda p: p.rlike("[A-Za-z0-9]"))


def fixed_windows(c: Column, size: int = MAX_CHUNK, overlap: int = OVERLAP) -> Column:
    """Pieces of size characters at every size - overlap, trimmed, non-empty."""
    if size <= overlap:
        raise ValueError("size must be larger than overlap")

    def pieces(t: Column) -> Column:
        starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(starts, lambda i: trim(F.substring(t, i + 1, F.lit(size)))), lambda x: x != "")

    return let(c, pieces)


def chunks(c: Column, size: int = MAX_CHUNK, overlap: int = OVERLAP) -> Column:
    """Paragraphs packed with a blank line between while they fit; longer ones in fixed windows."""
    if size <= overlap:
        raise ValueError("size must be larger than overlap")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def closed(s: Column) -> Column:
        return F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"]))

    def step(s: Column, p: Column) -> Column:
        joined = F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit("\n\n"), p))
        long = F.struct(F.concat(closed(s), fixed_windows(p, size, overlap)).alias("done"), F.lit("").alias("open"))
        fits = F.struct(s["done"].alias("done"), joined.alias("open"))
        flush = F.struct(F.array_append(s["done"], s["open"]).alias("done"), p.alias("open"))
        return F.when(F.length(p) > size, long).when(F.length(joined) <= size, fits).otherwise(flush)

    return F.aggregate(paragraphs(c), start, step, closed)


def headings_to_level_one(c: Column) -> Column:
    """Every heading at level 1, and front-matter labels as headings."""
    def line(x: Column) -> Column:
        head = F.regexp_extract(trim(x), r"(?Ud)^#{1,6}\s+(.+)\z", 1)
        return F.when(head != "", F.concat(F.lit("# "), trim(head))).when(F.lower(trim(x)).isin(*FRONT_MATTER), F.concat(F.lit("# "), trim(x))).otherwise(x)

    return F.array_join(F.transform(lines(c), line), "\n")


def similarity_form(c: Column) -> Column:
    """Lower case without figure marks, heading marks, superscripts, commas and en dashes."""
    c = F.when(c.contains("[Figure"), F.regexp_replace(c, r"(?U)\[Figure\s+\d+[^\]]*\]", "")).otherwise(c)
    c = F.regexp_replace(c, r"(?mUd)^#{1,4}\s+", "")
    c = F.regexp_replace(c, "[¹²³⁴⁵⁶⁷⁸⁹⁰]+", "")
    c = F.regexp_replace(c, "[⁰-⁹–,]+", "")
    return F.lower(squeeze(c))


def sentences(c: Column, least: int = MIN_SENTENCE) -> Column:
    """Pieces after . ! or ? and white space, of at least so many characters."""
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), trim), lambda s: F.length(s) >= least)


def overlap_tokens(c: Column) -> Column:
    """Distinct lower-case ASCII words of two or more characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]{2,})"), F.lit(1)))


def preview(c: Column, n: int = 80) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def duplicate_ratio(c: Column, least: int = 50) -> Column:
    """Share of paragraphs (of at least so many characters) that repeat another."""
    own = F.filter(F.transform(F.split(c, r"(?U)\n\s*\n"), trim), lambda p: F.length(p) >= least)
    share = lambda norms: rounded((F.size(norms) - F.size(F.array_distinct(norms))) / F.greatest(F.size(norms), F.lit(1)), 4)
    return let(F.transform(own, normal_line), lambda norms: F.when(F.size(norms) < 2, 0.0).otherwise(share(norms)))


def fragmentation(c: Column, plain: bool = False) -> Column:
    """Share of non-blank lines that end in a broken word or are orphans.

    In plain texts a line feed alone ends a line, and white space and digits are those of ASCII.
    """
    end, space, item = ("\n", PLAIN_SPACE, PLAIN_ITEM) if plain else (LINE_END, WHITE_SPACE, ITEM)

    def share(ls: Column) -> Column:
        following = F.slice(ls, 2, F.greatest(F.size(ls), F.lit(1)))
        bad = F.filter(F.zip_with(ls, following, lambda s, n: broken_line(s, n, item)), lambda b: b)
        return rounded(F.size(bad) / F.greatest(F.size(F.filter(ls, lambda s: s != "")), F.lit(1)), 4)

    return let(F.transform(lines(c, end), lambda x: F.btrim(x, F.lit(space))), share)


def broken_line(s: Column, following: Column, item: str = ITEM) -> Column:
    """Whether a trimmed line is a fragment, given the trimmed line after it (null: none)."""
    broken = s.endswith("-") & (F.length(s) > 5) & F.coalesce(following.rlike(r"(?U)^\p{Ll}"), F.lit(False))
    orphan = (F.length(s) < 40) & (F.length(s) >= 3) & ~s.startswith("#") & ~s.rlike(item)
    return (s != "") & (broken | orphan)


# Names of sections that end a body.
REFERENCES, FOOTNOTES = "references|bibliography|literature cited", "footnotes|endnotes|notes"


def section_place(c: Column, names: str, share: float, broken: bool = False) -> Column:
    """1-based place of a heading line of the given names in the part after share of the text; 0 without one.

    The part's own start counts as the start of a line, unless the line break
    before the heading must lie in the part too (broken).
    """
    cut = F.floor(F.length(c) * share).cast("int")
    start = r"(?!\A)^" if broken else "^"
    at = F.regexp_instr(F.substring(c, cut + 1, F.length(c)), F.lit(rf"(?imUd){start}\s*(?:#{{1,6}}\s*)?(?:{names})\s*$"))
    return F.when(at > 0, cut + at).otherwise(0)


def strip_explicit_section(c: Column, names: str, share: float, broken: bool = False) -> Column:
    """Text before such a heading line."""
    return let(section_place(c, names, share, broken), lambda at: F.when(at > 0, trim(F.substring(c, F.lit(1), at - 1))).otherwise(c))


def strip_references_heading(c: Column) -> Column:
    return strip_explicit_section(c, REFERENCES, 0.40, broken=True)


def strip_footnotes_heading(c: Column) -> Column:
    return strip_explicit_section(c, FOOTNOTES, 0.50)


def without_snippets(c: Column, snippets: Column) -> Column:
    """Without lines that are one of the snippets (of two or more characters), blank runs squeezed."""
    kept = F.filter(F.split(c, "\n"), lambda x: (F.length(trim(x)) < 2) | ~F.array_contains(snippets, trim(x)))
    return trim(squeeze_blank(F.array_join(kept, "\n")))


def _may_cite(s: Column) -> Column:
    """Whether a line holds what an address has in any case; cheaper than the patterns, which decide."""
    return s.contains(":") | F.lower(s).contains(".org")


def reference_like(s: Column) -> Column:
    """Whether a trimmed line reads as an entry of a bibliography."""
    numbered = s.rlike(r"(?U)^\s*(?:\[\d{1,3}\]|\d{1,3}[.)])\s+") & (s.rlike(r"(?U)\b(19|20)\d{2}\b") | (s.contains(",") & (F.length(s) > 45)))
    return (F.length(s) >= 20) & ((_may_cite(s) & s.rlike(r"(?i)(https?://|doi\.org|arxiv:)")) | numbered | (s.contains(",") & s.rlike(r"(?U)\(\d{4}\)\.?\z")))


def toc_like(s: Column) -> Column:
    """Whether a trimmed line reads as a row of a table of contents."""
    pipes = s.startswith("|") & (F.length(s) - F.length(F.replace(s, F.lit("|"))) >= 2)
    numbered = F.right(s, F.lit(1)).rlike(r"(?U)\d") & s.rlike(r"(?U)^\s*(?:[-*]\s*)?(?:\d+(?:\.\d+)*\s+)?[^\n]{2,140}?\s+\d{1,4}\s*\z")
    return (s != "") & (s.contains("..") | pipes | (s.contains("|") & s.rlike(r"(?U)^\|?\s*\d{1,3}\s*\|")) | numbered)


def citation_like(s: Column) -> Column:
    return (_may_cite(s) | s.startswith("10.")) & s.rlike(r"(?iU)(https?://|doi\.org|arxiv:|^10\.\d{4,}/)")
