"""Body preparation of texts that have contents in front and references behind, by rule from doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import body as B
from ..functions import text as T
from .registry import query
from .text import _TOC, _TRIM, docs

_ENTRY = "'[' || i || '] Author, A. Title of a work number ' || i || ' (2001).'"
_ENTRIES = f"array_to_string(list_transform(range(1, 41), lambda i: {_ENTRY}), chr(10))"
_ROWS = "array_to_string(list_transform(range(1, 13), lambda i: i || ' Part .... ' || i * 3), chr(10))"
_LINKS = "array_to_string(list_transform(range(1, 31), lambda i: '10.1000/x' || i), chr(10))"

#: Contents with or without a heading, then the text, then references under a heading, without one, as bare links, or notes.
_FRAMED = f"""SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN CASE doc_id % 4 WHEN 0 THEN '# Contents' || chr(10) ELSE '' END || {_ROWS} || chr(10) || chr(10) || 'Introduction' || chr(10) ELSE '' END || text
 || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'References' || chr(10) || {_ENTRIES} WHEN 1 THEN chr(10) || {_ENTRIES} WHEN 2 THEN chr(10) || {_LINKS} ELSE chr(10) || '## Notes' || chr(10) || '1 a note' END AS text FROM documents"""


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts as _FRAMED."""
    kind = F.col("doc_id") % 4
    listed = lambda n, f: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), f), "\n")
    entries = listed(40, lambda i: F.concat(F.lit("["), i, F.lit("] Author, A. Title of a work number "), i, F.lit(" (2001).")))
    rows, links = listed(12, lambda i: F.concat(i, F.lit(" Part .... "), i * 3)), listed(30, lambda i: F.concat(F.lit("10.1000/x"), i))
    front = F.when(kind < 2, F.concat(F.when(kind == 0, "# Contents\n").otherwise(""), rows, F.lit("\n\nIntroduction\n"))).otherwise("")
    back = F.when(kind == 0, F.concat(F.lit("\nReferences\n"), entries)).when(kind == 1, F.concat(F.lit("\n"), entries)).when(kind == 2, F.concat(F.lit("\n"), links)).otherwise("\n## Notes\n1 a note")
    return docs(spark, sf_dir).withColumn("text", F.concat(front, F.col("text"), back))


def _trimmed(c: str) -> str:
    return _TRIM.format(c)


def _lines(rows: str) -> str:
    """doc_id, text, lines l and their trimmed forms s."""
    ls = "CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN list_slice(string_split(text, chr(10)), 1, len(string_split(text, chr(10))) - 1) ELSE string_split(text, chr(10)) END"
    return f"SELECT *, list_transform(l, lambda x: {_trimmed('x')}) AS s FROM (SELECT doc_id, text, {ls} AS l FROM ({rows}))"


def _share(n: str, share: float) -> str:
    return f"floor({n} * {share}::DOUBLE)::BIGINT"


def _plain(pattern: str) -> str:
    """A pattern in the form that the other engine knows."""
    return pattern.replace("(?iU)", "(?i)").replace(r"\z", "$")


def _contents(rows: str) -> str:
    row = f"list_transform(s, lambda s: {_TOC})"
    heading = f"list_filter(range(1, reach + 1), lambda i: regexp_matches(s[i], '{_plain(B.CONTENTS_HEADING)}'))[1]"
    hits = f"list_transform(range(1, greatest(0, reach - {B.CONTENTS_FRAME}) + 1), lambda i: len(list_filter(r[i:i + {B.CONTENTS_FRAME - 1}], lambda x: x)))"
    stop = f"NOT r[nb[k]] AND (regexp_matches(s[nb[k]], '{_plain(B.BODY_HEADING)}') OR length(s[nb[k]]) > {B.NARRATIVE})"
    tired = "k >= patience AND len(list_filter(nb[k - patience + 1:k], lambda j: r[j])) = 0"
    end = f"coalesce(nb[list_filter(range(1, len(nb) + 1), lambda k: ({stop}) OR ({tired}))[1]], last + 1)"
    return f"""SELECT doc_id, CASE WHEN start IS NULL THEN text ELSE {_trimmed(f"array_to_string(list_concat(l[1:start - 1], l[{end}:len(l)]), chr(10))")} END AS text FROM (
SELECT *, list_filter(range(start + 1, last + 1), lambda i: s[i] <> '') AS nb FROM (SELECT *, least(len(l), start + {B.CONTENTS_LINES - 1}) AS last FROM (
SELECT *, coalesce(head, CASE WHEN list_max(hits) >= {B.CONTENTS_HITS} THEN list_position(hits, list_max(hits)) END) AS start, CASE WHEN head IS NULL THEN {B.PATIENCE} ELSE {B.PATIENCE_UNDER_HEADING} END AS patience FROM (
SELECT *, {heading} AS head, {hits} AS hits FROM (SELECT *, {row} AS r, greatest(1, {_share('len(l)', B.CONTENTS_SHARE)}) AS reach FROM ({_lines(rows)}))))))"""


def _section(rows: str, names: str, share: float, otherwise: str = "text") -> str:
    cut = _share("length(text)", share)
    heading = rf"(?im)^\s*(?:#{{1,6}}\s*)?(?:{names})\s*$"
    before = f"string_split(regexp_replace(substr(text, {cut} + 1), '{heading}', chr(1)), chr(1))[1]"
    return f"SELECT doc_id, CASE WHEN regexp_matches(substr(text, {cut} + 1), '{heading}') THEN {_trimmed(f'left(text, {cut}) || {before}')} ELSE {otherwise} END AS text FROM ({rows})"


_REFERENCE = r"(length(s) >= 20 AND (regexp_matches(s, '(?i)(https?://|doi\.org|arxiv:)') OR (regexp_matches(s, '^\s*(?:\[\d{1,3}\]|\d{1,3}[.)])\s+') AND (regexp_matches(s, '\b(19|20)\d{2}\b') OR (contains(s, ',') AND length(s) > 45))) OR (regexp_matches(s, '\(\d{4}\)\.?$') AND contains(s, ','))))"


def _squeezed(c: str) -> str:
    return rf"regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g')"


def _references(rows: str) -> str:
    heavy = f"len(l) >= {B.REFERENCES_LINES} AND len(l) - start - len(kept) >= {B.REFERENCES_HITS} AND (len(l) - start - len(kept))::DOUBLE / (len(l) - start) >= {B.REFERENCES_RATIO}::DOUBLE"
    bare = _trimmed(_squeezed("array_to_string(list_concat(l[1:start], kept), chr(10))"))
    implicit = f"""SELECT doc_id, text, CASE WHEN {heavy} THEN {bare} ELSE text END AS bare FROM (SELECT *, list_transform(list_filter(range(start + 1, len(l) + 1), lambda i: NOT hits[i]), lambda i: l[i]) AS kept FROM (
SELECT *, {_share('len(l)', B.REFERENCES_SHARE)} AS start, list_transform(s, lambda s: {_REFERENCE}) AS hits FROM ({_lines(rows)})))"""
    return _section(implicit, T.REFERENCES, B.REFERENCES_SHARE, "bare")


def _tail(rows: str) -> str:
    first = f"list_filter(range({_share('len(l)', B.TAIL_SHARE)} + 1, len(l) - {B.TAIL_FRAME} + 2), lambda i: len(list_filter(hits[i:i + {B.TAIL_FRAME - 1}], lambda x: x)) >= {B.TAIL_HITS})[1]"
    long = f"len(l) >= {B.TAIL_LINES} AND len(l) - {_share('len(l)', B.TAIL_SHARE)} >= {B.TAIL_REST} AND first - 1 > {_share('len(l)', B.TAIL_CUT)}"
    hits = r"list_transform(s, lambda x: regexp_matches(x, '(?i)(https?://|doi\.org|arxiv:|^10\.\d{4,}/)'))"
    return f"SELECT doc_id, CASE WHEN {long} THEN {_trimmed('array_to_string(l[1:first - 1], chr(10))')} ELSE text END AS text FROM (SELECT *, {first} AS first FROM (SELECT *, {hits} AS hits FROM ({_lines(rows)})))"


def _legal(rows: str) -> str:
    c = "text"
    for pattern in T.LEGAL_LINES:
        c = f"regexp_replace({c}, '(?im){pattern}', '', 'g')"
    return f"SELECT doc_id, {_trimmed(_squeezed(c))} AS text FROM ({rows})"


def _form(rows: str) -> str:
    c = "text"
    for pattern in (r"\[Figure\s+\d+[^\]]*\]", r"(?m)^#{1,4}\s+", "[¹²³⁴⁵⁶⁷⁸⁹⁰]+", "[⁰-⁹–,]+"):
        c = f"regexp_replace({c}, '{pattern}', '', 'g')"
    return rf"SELECT doc_id, lower(trim(regexp_replace({c}, '\s+', ' ', 'g'))) AS text FROM ({rows})"


def _notes(rows: str) -> str:
    return _section(rows, T.FOOTNOTES, 0.50)


def _result(rows: str) -> str:
    return f"SELECT doc_id, text AS result FROM ({rows})"


def _stepped(step: Column, rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", step.alias("result"))


@query(_result(_contents(_FRAMED)))
def strip_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stepped(B.strip_contents(F.col("text")), framed(spark, sf_dir))


@query(_result(_references(_FRAMED)))
def strip_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References under a heading and, where they are many, without one."""
    return _stepped(B.strip_references(F.col("text")), framed(spark, sf_dir))


@query(_result(_tail(_FRAMED)))
def strip_citation_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stepped(B.strip_citation_tail(F.col("text")), framed(spark, sf_dir))


@query(_result(_form(_tail(_legal(_notes(_references(_contents(_FRAMED))))))))
def prepare_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of the body in their order."""
    return B.prepare(framed(spark, sf_dir)).select("doc_id", F.col("text").alias("result"))


@query(_result(_form(_notes(_references(_FRAMED)))))
def prepare_body_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without contents, boilerplate and tail."""
    return B.prepare(framed(spark, sf_dir), fast=True).select("doc_id", F.col("text").alias("result"))


@query(_result(_notes("SELECT doc_id, text || chr(10) || '# Footnotes' || chr(10) || '1 note' AS text FROM documents")))
def strip_footnotes_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stepped(T.strip_footnotes_heading(F.concat("text", F.lit("\n# Footnotes\n1 note"))), docs(spark, sf_dir))
