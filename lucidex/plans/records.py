"""Metadata, lineage, quality, report and layout queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import folds, policy
from ..functions import metadata as M
from ..functions import text as T
from ..operators import layout as L
from ..operators.contributions import leaves, listed, validated
from ..operators import lineage as N
from ..operators import matching
from ..operators import quality as Q
from ..operators import reports as P
from ..operators.rendering import render
from .registry import query, table

_DOI = "'10.' || (1000 + doc_id % 9000) || '/d.' || doc_id"


def doi_of():
    return F.concat(F.lit("10."), 1000 + F.col("doc_id") % 9000, F.lit("/d."), F.col("doc_id"))


def docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


# Metadata


@query(f"SELECT doc_id, translate({_DOI}, '/.-', '___') AS id, sha256({_DOI}) AS hash FROM documents")
def hash_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", M.doi_to_id(doi_of()).alias("id"), M.hash_doi(doi_of()).alias("hash"))


@query(f"SELECT doc_id, translate({_DOI}, '/.-', '___') AS id FROM documents")
def doi_to_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", M.doi_to_id(doi_of()).alias("id"))


def _front(c="text"):
    """A text with a DOI line, a date and a link in front, by rule."""
    return F.concat(F.lit("Published 12 March "), 1990 + F.col("doc_id") % 40, F.lit(" doi: https://doi.org/"), doi_of(), F.lit(").\n"), F.col(c))


_FRONT = f"'Published 12 March ' || (1990 + doc_id % 40) || ' doi: https://doi.org/' || {_DOI} || ').' || chr(10) || text"


@query(rf"SELECT doc_id, rtrim(coalesce(nullif(regexp_extract(t, '(?i)(?:doi[:\s]+)?(?:https?://)?(?:dx\.)?doi\.org/(10\.\S+)', 1), ''), nullif(regexp_extract(t, '(10\.\d{{4,}}/\S+)', 1), '')), '.,;)') AS doi FROM (SELECT doc_id, {_FRONT} AS t FROM documents)")
def extract_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", M.doi(_front()).alias("doi"))


@query(rf"SELECT doc_id, coalesce(nullif(regexp_extract(t, '(?i)\b(?:{M.MONTHS})\s+((?:19|20)\d{{2}})\b', 1), ''), nullif(regexp_extract(t, '\b(19\d{{2}}|20\d{{2}})\b', 1), '')) AS year FROM (SELECT doc_id, {_FRONT} AS t FROM documents)")
def extract_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", M.year(_front()).alias("year"))


_BAD = " OR ".join(f"contains(lower(x), '{w}')" for w in M.NOT_TITLE)


@query(rf"SELECT doc_id, list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:10], lambda x: NOT ({_BAD}) AND len(regexp_split_to_array(x, '\s+')) BETWEEN 3 AND 40 AND length(x) < 450)[1] AS title FROM documents")
def extract_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", M.title(F.col("text")).alias("title"))


_ABSTRACT = r"""left(trim(regexp_replace(regexp_extract(regexp_extract('Abstract: ' || text || ' Introduction more', '(?is)(?:abstract|summary)\s*:*\s*(.+)$', 1), '(?is)^(.+?)(?:introduction|keywords|1\.\s|methods|methodology|related work|background|$)', 1), '\s+', ' ', 'g')), 500)"""


@query(f"SELECT doc_id, CASE WHEN length(a) > 20 THEN a END AS abstract FROM (SELECT doc_id, {_ABSTRACT} AS a FROM documents)")
def extract_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", M.abstract(F.concat(F.lit("Abstract: "), F.col("text"), F.lit(" Introduction more"))).alias("abstract"))


_TIDY = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _authors_sql(text: str) -> str:
    """Authors from the lines that look like theirs, and the address of the corresponding one, as JSON."""
    bare = _TIDY.format(f"regexp_replace(s, '{policy.MARKS}', '', 'g')")
    tokens = f"regexp_extract_all({bare}, '[^\\s,]+')"
    stop = " OR ".join(f"contains(lower(s), '{w}')" for w in policy.AUTHOR_STOP)
    line = f"length(s) BETWEEN 5 AND 150 AND regexp_matches(s, '^[A-Z]') AND regexp_matches(s, '\\band\\b|,') AND NOT ({stop}) AND len({tokens}) > 0 AND 5 * len(list_filter({tokens}, lambda w: regexp_matches(w, '^[A-Z]|^(?i:and)$'))) >= 4 * len({tokens})"
    clean = _TIDY.format(f"regexp_replace(regexp_replace(x, '{policy.MARKS}', '', 'g'), '\\s+', ' ', 'g')")
    address = f"regexp_extract(t, '{policy.CORRESPONDENCE}', 2)"
    named = _TIDY.format(f"regexp_replace(regexp_extract(t, '{policy.CORRESPONDENCE}', 1), '{policy.MARKS}', '', 'g')")
    full = "concat_ws(' ', regexp_extract(c, '^(.+) \\S+$', 1), regexp_extract(c, '^.+ (\\S+)$', 1))"
    return f"""
SELECT doc_id, to_json(list_transform(list_filter(people, lambda c: regexp_matches(c, '^.+ \\S+$'))[1:{policy.MAX_AUTHORS}], lambda c: struct_pack(
    name := regexp_extract(c, '^(.+) \\S+$', 1), surname := regexp_extract(c, '^.+ (\\S+)$', 1), email := CASE WHEN address <> '' AND (contains({full}, named) OR contains(named, {full})) THEN address ELSE '' END)))::VARCHAR AS authors
FROM (SELECT doc_id, {address} AS address, {named} AS named, list_transform(flatten(list_transform(list_filter(list_transform(string_split(t, chr(10))[1:{policy.AUTHOR_LINES}], lambda y: {_TIDY.format("y")}), lambda s: {line}), lambda s: string_split_regex(s, ',\\s*|\\s+and\\s+'))), lambda x: {clean}) AS people
  FROM (SELECT doc_id, {text} AS t FROM documents))"""


@query(_authors_sql("'Ann Lee, Bo Chu and Carl May' || chr(10) || text"))
def extract_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", F.to_json(policy.authors(F.concat(F.lit("Ann Lee, Bo Chu and Carl May\n"), "text"))).alias("authors"))


_HEAD = "A Report on Things\nAnn-Marie Lee1, Bo Chu2* and Carl van May†\nUniversity of X, Y\n", "\n*Correspondence: Bo Chu bo.chu@x.org\n"


@query(_authors_sql(f"'{_HEAD[0]}' || regexp_replace(text, ' (the|a) ', ', Dan Roe and ', 'g') || '{_HEAD[1]}'"))
def extract_authors_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors with marks, an address at the end, and lines that look like names only in part."""
    text = F.concat(F.lit(_HEAD[0]), F.regexp_replace("text", " (the|a) ", ", Dan Roe and "), F.lit(_HEAD[1]))
    return docs(spark, sf_dir, "text").select("doc_id", F.to_json(policy.authors(text)).alias("authors"))


@query(r"SELECT doc_id, nullif(regexp_extract(text, '([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\s+Journal)', 1), '') AS journal FROM (SELECT doc_id, 'A Small Town Journal' || chr(10) || text AS text FROM documents)")
def extract_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", M.journal(F.concat(F.lit("A Small Town Journal\n"), F.col("text"))).alias("journal"))


@query("SELECT page_id, coalesce(list_filter(l, lambda x: contains(x, 'bmj') OR contains(x, 'plos') OR contains(x, 'springer') OR contains(x, 'wiley'))[1], l[1]) AS link FROM (SELECT page_id, regexp_extract_all('see ' || url || ' or https://www.bmj.com/' || page_id, '" + M.LINK.replace("&//=", "&/=") + "', 1) AS l FROM pages)")
def extract_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("see "), "url", F.lit(" or https://www.bmj.com/"), "page_id")
    return table(spark, sf_dir, "pages").select("page_id", M.link(text, F.lit(None).cast("string")).alias("link"))


def _summary_sql(text: str) -> str:
    """All metadata of a text as one JSON object without nulls."""
    found = lambda pattern: f"nullif(regexp_extract(t, '{pattern}', 1), '')"
    words = r"len(regexp_split_to_array(x, '\s+'))"
    rows = f"list_transform(string_split(t, chr(10)), lambda x: {_TIDY.format('x')})"
    journal_word = " OR ".join(f"contains(x, '{w}')" for w in M.JOURNAL_WORDS)
    cut = r"(?is)^(.+?)(?:introduction|keywords|1\.\s|methods|methodology|related work|background|$)"
    squeezed = rf"left(trim(regexp_replace(regexp_extract(regexp_extract(t, '(?is)(?:abstract|summary)\s*:*\s*(.+)$', 1), '{cut}', 1), '\s+', ' ', 'g')), 500)"
    own = {
        "doi": rf"regexp_replace(coalesce({found(r'(?i)(?:doi[:\s]+)?(?:https?://)?(?:dx\.)?doi\.org/(10\.\S+)')}, {found(r'(10\.\d{4,}/\S+)')}), '[.,;)]+$', '')",
        "title": f"list_filter(list_filter({rows}, lambda x: x <> '')[1:10], lambda x: NOT ({_BAD}) AND {words} BETWEEN 3 AND 40 AND length(x) < 450)[1]",
        "abstract": f"CASE WHEN length({squeezed}) > 20 THEN {squeezed} END",
        "journal": f"coalesce({', '.join(f'trim({found(x)})' for x in M.JOURNAL_PATTERNS)}, list_filter({rows}[1:15], lambda x: ({journal_word}) AND {words} < 10)[1])",
        "year": f"coalesce({found(r'\b((?:19|20)\d{2})[-/.](?:0[1-9]|1[012])[-/.](?:0[1-9]|[12][0-9]|3[01])\b')}, {found(rf'(?i)\b(?:{M.MONTHS})\s+((?:19|20)\d{{2}})\b')}, {found(r'\b(19\d{2}|20\d{2})\b')})",
    }
    fields = ", ".join(f"""'"{k}":' || to_json({k})::VARCHAR""" for k in own)
    each = ", ".join(f"{v} AS {k}" for k, v in own.items())
    return f"""
SELECT doc_id, '{{' || array_to_string(list_filter(['"authors":' || authors, {fields}, '"link":' || to_json('https://doi.org/' || doi)::VARCHAR], lambda x: x IS NOT NULL), ',') || '}}' AS metadata
FROM (SELECT doc_id, {each} FROM (SELECT doc_id, {text} AS t FROM documents)) JOIN ({_authors_sql(text)}) USING (doc_id)"""


@query(_summary_sql(_FRONT))
def pdf_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", F.to_json(M.summary(_front())).alias("metadata"))


_PAPER = "Annals of Small Towns Journal\nHow People Travel in Small Towns\nAnn-Marie Lee1, Bo Chu2*\nReceived 2019-04-30\nAbstract: "


@query(_summary_sql(f"'{_PAPER}' || text || ' Introduction ' || {_FRONT}"))
def pdf_metadata_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of texts that begin as papers do, with a DOI and another date further on."""
    text = F.concat(F.lit(_PAPER), F.col("text"), F.lit(" Introduction "), _front())
    return docs(spark, sf_dir, "text").select("doc_id", F.to_json(M.summary(text)).alias("metadata"))


_F = "CASE WHEN {0} THEN 'found' ELSE 'not_found' END"
_DETECT = {
    "has_doi": _F.format(r"regexp_matches(t, '10\.\d{4,}/\S+')"), "has_abstract": _F.format(r"regexp_matches(t, '(?i)\babstract\b')"), "has_references": _F.format(r"regexp_matches(t, '(?i)\breferences\b')"),
    "has_title": _F.format("len(list_filter(string_split(t, chr(10))[1:10], lambda x: length(trim(x)) BETWEEN 11 AND 299)) > 0"),
    "has_authors": _F.format(r"regexp_matches(left(t, 2000), '[A-Z][a-z]+\s+[A-Z][a-z]+|(?:authors?|by)\s*:|[A-Z]\.\s*[A-Z][a-z]+')"),
}


@query(f"SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _DETECT.items())} FROM (SELECT doc_id, {_FRONT} AS t FROM documents)")
def detect_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", *[v.alias(k) for k, v in M.detect(_front()).items()])


@query(f"SELECT doc_id, {' + '.join(f'CASE WHEN {v} = {chr(39)}found{chr(39)} THEN 1 ELSE 0 END' for v in _DETECT.values())} AS score FROM (SELECT doc_id, {_FRONT} AS t FROM documents)")
def metadata_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", M.detected(list(M.detect(_front()).values())).alias("score"))


@query("SELECT doc_id, text AS content FROM documents")
def decode_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    upload = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8")))
    return docs(spark, sf_dir, "text").select("doc_id", F.decode(M.decoded_upload(upload), "UTF-8").alias("content"))


@query("SELECT page_id, array_to_string(list_filter([url || '.pdf', url || '/a.pdf', CASE WHEN page_id % 2 = 0 THEN 'http://oa/' || page_id END], lambda x: x IS NOT NULL), '|') AS urls FROM pages")
def pdf_url_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    best, places, free = F.concat(u, F.lit(".pdf")), F.array(F.concat(u, F.lit(".pdf")), F.lit(None).cast("string"), F.concat(u, F.lit("/a.pdf"))), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("http://oa/"), "page_id"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(M.pdf_url_candidates(best, places, free), "|").alias("urls"))


@query("SELECT event_id, coalesce(v3, v2, v1) AS title, CASE WHEN v3 IS NOT NULL THEN 'p3' WHEN v2 IS NOT NULL THEN 'p2' ELSE 'p1' END AS provider FROM (SELECT event_id, event_type AS v1, CASE WHEN user_id % 2 = 0 THEN event_type || 'x' END AS v2, CASE WHEN user_id % 3 = 0 THEN event_type || 'yy' END AS v3 FROM events)")
def merge_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of up to three providers per event: the strictly longest, else the first."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doi"), "user_id", "event_type")
    found = F.array(F.struct(F.lit(1).alias("priority"), F.col("event_type").alias("v")), F.struct(F.lit(2).alias("priority"), F.when(F.col("user_id") % 2 == 0, F.concat("event_type", F.lit("x"))).alias("v")), F.struct(F.lit(3).alias("priority"), F.when(F.col("user_id") % 3 == 0, F.concat("event_type", F.lit("yy"))).alias("v")))
    long = e.select("doi", F.explode(found).alias("f")).select("doi", F.lit("title").alias("field"), F.lit("string").alias("kind"), F.struct("f.v", "f.priority").alias("value"), F.length("f.v").alias("size"), F.col("f.priority").alias("priority")).where("value.v is not null")
    return N.merge_longest(long).select(F.col("doi").alias("event_id"), F.col("value.v").alias("title"), F.concat(F.lit("p"), "value.priority").alias("provider"))


# Lineage


@query("SELECT 'k' || o_custkey AS doi, min(o_orderkey) AS row_number, arg_min(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END, ''), o_orderkey) FILTER (WHERE true) AS x FROM orders GROUP BY 1".replace("arg_min(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END, ''), o_orderkey) FILTER (WHERE true) AS x", "CASE WHEN min(o_orderkey) % 3 = 0 THEN NULL ELSE arg_min(o_orderstatus, o_orderkey) END AS pdf_url"))
def seed_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_number"), F.concat(F.lit(" k"), "o_custkey", F.lit(" ")).alias("doi"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderstatus")).alias("pdf_url"))
    return N.seed_plan(rows)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def new_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("doi"))
    return N.new_dois(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("doi")), known).select("c_custkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n > 1")
def duplicate_doi_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("doi"))
    return N.duplicates(rows, "doi", "o_orderkey").select("o_orderkey")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS stage, max(event_id) FILTER (WHERE true) IS NOT NULL AS known FROM events GROUP BY user_id")
def latest_run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return N.latest_state(rows, "user_id", "at", "event_type").select("user_id", F.col("event_type").alias("stage"), F.lit(True).alias("known"))


@query("SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY event_type")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.outcome_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("outcome")), "outcome")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def chunks_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.outcome_counts(table(spark, sf_dir, "embeddings").select("label"), "label")


@query("SELECT c_custkey AS pos, CASE WHEN c_custkey % 2 = 0 THEN o.id ELSE n.id END AS author_id FROM customer LEFT JOIN (SELECT 's' || s_suppkey AS orcid, s_suppkey AS id FROM supplier) o ON o.orcid = 's' || (c_custkey % 200) LEFT JOIN (SELECT s_name, min(s_suppkey) AS id FROM supplier GROUP BY s_name) n ON n.s_name = 'Supplier#' || (c_custkey % 150)")
def author_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    entries = table(spark, sf_dir, "customer").select(k.alias("pos"), F.concat(F.lit("Supplier#"), k % 150).alias("name"), F.when(k % 2 == 0, F.concat(F.lit("s"), k % 200)).alias("orcid"))
    authors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("full_name"), F.concat(F.lit("s"), "s_suppkey").alias("orcid"))
    return N.resolve_authors(entries, authors).select("pos", "author_id")


@query("SELECT l_orderkey, arg_min('%PDF-' || l_linenumber, l_linenumber) AS content FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey")
def first_valid_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.when(F.col("l_returnflag") != "N", "%PDF-").otherwise("<html>"), "l_linenumber").alias("content"))
    return N.first_valid(rows, "l_orderkey", "l_linenumber", "content")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "customer").where("c_acctbal >= 0")
    return N.cascade(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), kept, "o_custkey", "c_custkey").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name ILIKE '%er#%' AND c_name ILIKE '%1%'")
def admin_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(table(spark, sf_dir, "customer"), "ER# 1", ("c_name",), c_mktsegment="BUILDING").select("c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'scientific_article' WHEN c_custkey % 3 = 1 THEN 'report' ELSE 'poster' END AS category, c_custkey % 3 <> 2 AND c_custkey % 5 <> 4 AS accepted FROM customer")
def contribution_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories with blank and unknown ones, study types with unknown ones."""
    k = F.col("c_custkey")
    category = F.when(k % 3 == 0, " ").when(k % 3 == 1, "report").otherwise("poster")
    rows = table(spark, sf_dir, "customer").select(k, category.alias("category"), F.when(k % 5 == 4, "hearsay").when(k % 5 == 1, "rct").alias("study_type"))
    good, bad = validated(rows)
    return good.select("c_custkey", "category", F.lit(True).alias("accepted")).unionByName(bad.select("c_custkey", "category", F.lit(False).alias("accepted")))


# Quality


_SENT = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 30)"
_REF = f"SELECT item_id, unnest(range(0, len(l))) AS n, unnest(l) AS sentence FROM (SELECT item_id, {_SENT.format('text')} AS l FROM benchmark)"
_EXT = f"SELECT doc_id, unnest(range(0, len(l))) AS n, unnest(l) AS sentence FROM (SELECT doc_id, {_SENT.format('text')} AS l FROM documents)"


def _sentences(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key), F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))


@query(f"SELECT item_id, count(DISTINCT doc_id) AS n_docs, count(*) AS n_sentences FROM ({_REF}) r JOIN ({_EXT}) e USING (sentence) GROUP BY item_id")
def contains_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark sentence, by equality, before any fuzzy step."""
    e, r = _sentences(table(spark, sf_dir, "documents"), "doc_id"), _sentences(table(spark, sf_dir, "benchmark"), "item_id")
    return r.join(e.select("doc_id", "sentence"), "sentence").groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_sentences"))


@query(f"SELECT r.item_id AS doc_id, round(count(e.sentence)::DOUBLE / count(*), 4) AS recall FROM ({_REF}) r LEFT JOIN (SELECT DISTINCT sentence FROM ({_EXT})) e USING (sentence) GROUP BY 1")
def content_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each benchmark item's sentences that stand in any document."""
    e, r = _sentences(table(spark, sf_dir, "documents"), "doc_id").select("sentence", "n"), _sentences(table(spark, sf_dir, "benchmark"), "item_id")
    first = e.groupBy("sentence").agg(F.min("n").alias("place"))
    return Q.recall(r.join(first, "sentence", "left"), "item_id").withColumnRenamed("item_id", "doc_id")


@query(f"SELECT doc_id, round(count(r.sentence)::DOUBLE / count(*), 4) AS recall FROM ({_EXT}) e LEFT JOIN (SELECT DISTINCT sentence FROM ({_REF})) r USING (sentence) GROUP BY doc_id")
def content_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each document's sentences that stand in the benchmark."""
    e, r = _sentences(table(spark, sf_dir, "documents"), "doc_id"), _sentences(table(spark, sf_dir, "benchmark"), "item_id").select("sentence", "n")
    return Q.recall(e.join(r.groupBy("sentence").agg(F.min("n").alias("place")), "sentence", "left"), "doc_id")


@query(f"""WITH r AS ({_EXT}), f AS (SELECT doc_id, sentence, min(m - n) AS place FROM (SELECT doc_id, n, sentence, max(n) OVER (PARTITION BY doc_id) AS m FROM r) GROUP BY ALL),
m AS (SELECT r.doc_id, r.n, f.place FROM r JOIN f USING (doc_id, sentence)), p AS (SELECT a.doc_id, count(*) AS pairs, count(*) FILTER (WHERE a.place < b.place) AS good FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.n < b.n GROUP BY a.doc_id)
SELECT doc_id, CASE WHEN k >= 3 THEN round(good::DOUBLE / pairs * k / k, 4) END AS order_score FROM (SELECT doc_id, count(*) AS k FROM m GROUP BY doc_id) LEFT JOIN p USING (doc_id)""")
def order_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of each document's sentences in the same document read backwards."""
    own = _sentences(table(spark, sf_dir, "documents"), "doc_id")
    back = own.withColumn("n", F.max("n").over(Window.partitionBy("doc_id")) - F.col("n"))
    return Q.order_score(Q.exact_matches(back, own, "doc_id"), "doc_id")


@query()
def fuzzy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, with a word respelt and one left out, against itself."""
    edited = F.regexp_replace(F.regexp_replace("text", r"\bof\b", "off"), r"\bwas ", "")
    rows = docs(spark, sf_dir, "text").select("doc_id", T.sentences(edited).alias("extracted"), T.sentences(F.col("text")).alias("reference"))
    return matching.fuzzy_scores(rows, "doc_id", "extracted", "reference").select("doc_id", "recall", "precision", "order")


_MARKED = f"SELECT doc_id, n, s, 6 + length(s) % 24 AS k FROM (SELECT doc_id, unnest(range(0, len(l))) AS n, unnest(l) AS s FROM (SELECT doc_id, {_SENT.format('text')} AS l FROM documents))"


@query(f"""WITH s AS ({_MARKED}), f AS (SELECT *, CASE WHEN k <= 26 THEN min(n) OVER (PARTITION BY doc_id, s) END AS place, CASE WHEN k <= 26 THEN (132 - k) / 132.0::DOUBLE END AS ratio FROM s),
p AS (SELECT a.doc_id, count(*) AS pairs, count(*) FILTER (WHERE a.place < b.place) AS good FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.n < b.n AND a.place IS NOT NULL AND b.place IS NOT NULL GROUP BY a.doc_id),
r AS (SELECT doc_id, count(*) AS every, count(place) AS matched, round(coalesce(sum(ratio), 0) / count(*), 4) AS share FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(share, 1.0) AS recall, coalesce(share, 0.0) AS precision, CASE WHEN matched >= 3 THEN round(good::DOUBLE / pairs * matched / every, 4) END AS order_score FROM documents LEFT JOIN r USING (doc_id) LEFT JOIN p USING (doc_id)""")
def fuzzy_scores_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's sentences against those with 6 to 29 signs at the end of 132: the ratio is the rest's share, and some are under the limit."""
    part = lambda x, s: F.base64(F.unhex(F.sha2(F.concat(F.lit(x), s), 256)))
    digest = lambda s: F.concat(part("a", s), part("b", s), part("c", s))
    signs = lambda s: (6 + F.length(s) % 24).cast("int")
    own = docs(spark, sf_dir, "text").select("doc_id", F.coalesce(T.sentences(F.col("text")), F.array().cast("array<string>")).alias("s"))
    marked = F.transform("s", lambda s: F.concat(F.left(digest(s), 132 - signs(s)), F.repeat(F.lit("§"), signs(s))))
    rows = own.select("doc_id", F.transform("s", digest).alias("reference"), marked.alias("extracted"))
    return matching.fuzzy_scores(rows, "doc_id", "extracted", "reference").select("doc_id", "recall", "precision", F.col("order").alias("order_score"))


def _spoilt(start: int, length: int, signs: int):
    """A passage of the text whose last characters are signs that no text has."""
    return F.concat(F.substring("text", start, length - signs), F.lit("§" * signs))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 1.0 WHEN length(text) < 20 OR doc_id % 3 = 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS recall,
 CASE WHEN doc_id % 3 = 2 THEN 1.0 WHEN length(text) < 20 THEN 0.0 WHEN doc_id % 3 = 1 THEN 0.6 ELSE 0.85 END::DOUBLE AS avg_ratio FROM documents WHERE text IS NOT NULL""")
def author_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text's own start, as it is, with three of 20 characters spoilt (ratio 0.85) and with eight (0.6)."""
    expected = F.when(F.col("doc_id") % 3 == 0, _spoilt(1, 20, 3)).when(F.col("doc_id") % 3 == 1, _spoilt(1, 20, 8)).otherwise(F.substring("text", 1, 20))
    return docs(spark, sf_dir, "text").where("text is not null").select("doc_id", Q.author_accuracy(F.col("text"), F.array(expected)).alias("x")).select("doc_id", "x.*")


@query("""SELECT doc_id, CASE WHEN length(text) >= 40 THEN 2 ELSE 1 END AS found, 3 AS total, round((1.0 + CASE WHEN length(text) >= 40 THEN 0.75 + 0.5 ELSE 0.0 END) / 3, 3)::DOUBLE AS avg_ratio FROM documents WHERE text IS NOT NULL""")
def continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage of the text itself and two with a quarter and half of it spoilt (ratios 0.75 and 0.5)."""
    found = Q.continuity(F.col("text"), F.array(F.substring("text", 11, 40), _spoilt(1, 40, 10), _spoilt(1, 40, 20)))
    return docs(spark, sf_dir, "text").where("text is not null").select("doc_id", found.alias("x")).select("doc_id", "x.found", "x.total", "x.avg_ratio")


@query("SELECT doc_id, CASE WHEN w = 0 THEN 0.0 ELSE round(s / w * 100, 1) END AS score FROM (SELECT doc_id, 20 + 20 + CASE WHEN d IS NULL THEN 0 ELSE 15 END + 10 AS w, 20 * t + 20 * a + coalesce(15 * d, 0) + 10 * y AS s FROM (SELECT doc_id, (quality)::DOUBLE AS t, (doc_id % 5) / 4.0::DOUBLE AS a, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE toxic::DOUBLE END AS d, (doc_id % 2)::DOUBLE AS y FROM labels))")
def metadata_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    none = F.lit(None).cast("double")
    values = {"title": F.col("quality").cast("double"), "authors": (k % 5) / 4.0, "doi": F.when(k % 3 != 0, F.col("toxic").cast("double")), "date": (k % 2).cast("double"), "source": none, "abstract": none, "keywords": none}
    return table(spark, sf_dir, "labels").select("doc_id", Q.metadata_accuracy(values).alias("score"))


@query("SELECT doc_id, round(CASE WHEN o IS NULL THEN sf * (0.5::DOUBLE / (0.5::DOUBLE + 0.2::DOUBLE)) + sd * (0.2::DOUBLE / (0.5::DOUBLE + 0.2::DOUBLE)) ELSE sf * 0.5::DOUBLE + o * 100 * 0.3::DOUBLE + sd * 0.2::DOUBLE END, 1) AS score FROM (SELECT doc_id, greatest(0.0, least(100.0, (1 - f / 0.4::DOUBLE) * 100)) AS sf, o, greatest(0.0, least(100.0, (1 - d / 0.2::DOUBLE) * 100)) AS sd FROM (SELECT doc_id, (doc_id % 64) / 64.0::DOUBLE AS f, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id % 8) / 8.0::DOUBLE END AS o, (doc_id % 16) / 64.0::DOUBLE AS d FROM documents))")
def structural_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return docs(spark, sf_dir).select("doc_id", Q.structural_quality((k % 64) / 64.0, F.when(k % 4 != 0, (k % 8) / 8.0), (k % 16) / 64.0).alias("score"))


@query(r"""WITH h AS (SELECT doc_id, list_transform(regexp_extract_all('# Methods' || chr(10) || text || chr(10) || '# Intro' || chr(10) || chr(10) || '## Results' || chr(10), '(?m)^#{1,3}\s+(.+)$', 1), lambda x: lower(trim(x))) AS h FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(['intro', 'methods', 'results'], lambda e: coalesce(list_filter(range(1, len(h) + 1), lambda i: contains(h[i], e) OR contains(e, h[i]))[1], 0)), lambda p: p > 0) AS p FROM h)
SELECT doc_id, CASE WHEN len(p) >= 2 THEN round(list_sum(list_transform(range(1, len(p) + 1), lambda i: len(list_filter(p[i + 1:len(p)], lambda q: q > p[i]))))::DOUBLE / (len(p) * (len(p) - 1) / 2), 4) END AS score FROM p""")
def section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# Methods\n"), F.col("text"), F.lit("\n# Intro\n\n## Results\n"))
    return docs(spark, sf_dir, "text").select("doc_id", Q.section_order(text, F.array(F.lit("Intro"), F.lit("Methods"), F.lit("Results"))).alias("score"))


@query("""SELECT doc_id, CASE WHEN length(text) >= 20 OR text = '' THEN 'found' ELSE 'not_found' END AS title, CASE WHEN length(text) >= 20 AND doc_id % 2 = 0 THEN 'found' ELSE 'not_found' END AS authors, CASE WHEN doc_id % 2 = 0 THEN 'n/a' WHEN contains(text, 'doi') THEN 'found' ELSE 'not_found' END AS doi,
 CASE WHEN doc_id % 3 = 0 THEN 'n/a' ELSE 'found' END AS abstract, CASE WHEN regexp_matches(text, '(?i)\\breferences\\b|\\bbibliography\\b') THEN 'found' ELSE 'not_found' END AS "references", CASE WHEN length(text) >= 40 THEN 'found' ELSE 'not_found' END AS key_passage FROM documents WHERE text IS NOT NULL""".replace(" OR text = ''", ""))
def presence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title with three of 20 characters spoilt, authors with three or eight, an exact abstract, a passage with a quarter spoilt."""
    even = F.col("doc_id") % 2 == 0
    authors = F.array(F.when(even, _spoilt(1, 20, 3)).otherwise(_spoilt(1, 20, 8)))
    found = Q.content_presence(F.col("text"), _spoilt(1, 20, 3), authors, F.when(~even, "doi"), F.when(F.col("doc_id") % 3 != 0, F.substring("text", 5, 30)), _spoilt(1, 40, 10))
    return docs(spark, sf_dir, "text").where("text is not null").select("doc_id", found.alias("x")).select("doc_id", "x.title", "x.authors", "x.doi", "x.abstract", "x.references", "x.key_passage")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(k, '[,|;]'), lambda x: lower(trim(x))), lambda x: x <> ''))), ' ') AS keywords FROM (SELECT doc_id, lang || ', ' || source || ';' || upper(lang) || '|' AS k FROM documents)")
def keyword_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.concat(F.col("lang"), F.lit(", "), F.col("source"), F.lit(";"), F.upper("lang"), F.lit("|"))
    return docs(spark, sf_dir, "lang", "source").select("doc_id", F.array_join(F.array_sort(M.keyword_set(k)), " ").alias("keywords"))


@query()
def fuzzy_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of a slightly changed passage of each document in it."""
    passage = F.translate(F.substring("text", 20, 60), "aeo", "xeo")
    return docs(spark, sf_dir, "text").select("doc_id", folds.udf(folds.fuzzy_ratio, "double")(F.col("text"), passage).alias("ratio"))


@query("SELECT doc_id, CASE WHEN length(text) >= 60 THEN 0.9 ELSE 0.0 END::DOUBLE AS ratio FROM documents WHERE text IS NOT NULL")
def fuzzy_contains_spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of each document's first 60 characters, the last six of them spoilt, in it."""
    rows = docs(spark, sf_dir, "text").where("text is not null")
    return rows.select("doc_id", folds.udf(folds.fuzzy_ratio, "double")(F.col("text"), _spoilt(1, 60, 6)).alias("ratio"))


@query()
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gestalt ratio of each benchmark item and its squeezed, lower-case form."""
    return table(spark, sf_dir, "benchmark").select("item_id", folds.udf(folds.gestalt_ratio, "double")(F.col("text"), T.similarity_form(F.col("text"))).alias("ratio"))


# Reports


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY l_returnflag")
def config_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"])


@query("SELECT l_linestatus, l_returnflag, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount FROM lineitem GROUP BY ALL")
def doctype_config_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile(table(spark, sf_dir, "lineitem"), ["l_linestatus", "l_returnflag"], ["l_quantity", "l_discount"])


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_total, median(l_quantity) AS median_total, median(l_discount) AS median_per_page FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_returnflag")
def runtime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.runtime(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_discount")


@query("SELECT l_orderkey, l_linenumber, metric, score FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (score FOR metric IN (l_quantity, l_discount, l_tax))")
def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.long_form(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("SELECT l_returnflag, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 6) AS O, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 6) AS F FROM lineitem GROUP BY l_returnflag")
def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pivot(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"], "l_quantity")


@query("SELECT m AS l_returnflag, count(b) AS wins FROM (SELECT DISTINCT l_returnflag AS m FROM lineitem) LEFT JOIN (SELECT l_returnflag AS b FROM (SELECT l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_returnflag DESC) AS n FROM lineitem) WHERE n = 1) ON b = m GROUP BY m")
def parser_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.wins(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity", "l_linenumber")


@query("SELECT o_orderpriority, min(o_totalprice) AS low, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS q2, quantile_cont(o_totalprice, 0.75) AS q3, max(o_totalprice) AS high FROM orders GROUP BY 1".replace("quantile_cont(o_totalprice, 0.25)", "round(quantile_cont(o_totalprice, 0.25), 4)").replace("quantile_cont(o_totalprice, 0.5)", "round(quantile_cont(o_totalprice, 0.5), 4)").replace("quantile_cont(o_totalprice, 0.75)", "round(quantile_cont(o_totalprice, 0.75), 4)"))
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.quartiles(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice").withColumns({c: F.round(c, 4) for c in ("q1", "q2", "q3")})


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def quality_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return table(spark, sf_dir, "customer").select("c_custkey").join(right, "c_custkey", "left")


@query("SELECT n_nationkey AS k, n_name AS name, r_name AS name_right FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
def suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    right = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return P.left_with_suffix(left, right, ["k"], "_right")


@query("SELECT doc_id, c AS config FROM documents, (SELECT unnest(['full', 'fast', 'plain']) AS c)")
def doc_config_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every configuration; configurations are a literal list, so nothing is joined."""
    return docs(spark, sf_dir).select("doc_id", F.explode(F.array(F.lit("full"), F.lit("fast"), F.lit("plain"))).alias("config"))


@query("SELECT doc_id, coalesce(toxic, -1) AS toxic, coalesce(quality, 0) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def missing_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.with_defaults(table(spark, sf_dir, "labels"), docs(spark, sf_dir), ["doc_id"], {"toxic": -1, "quality": 0})


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE) AS value FROM events")
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"))
    return P.coerced(rows, ["value", "absent"])


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN value / 100 ELSE value END AS value FROM events")
def meta_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", P.percent_to_share(F.col("event_type"), F.col("value"), ["click", "view"]).alias("value"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_size, p_partkey LIMIT 10")
def rank_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fast_rank(table(spark, sf_dir, "part"), "p_retailprice", "p_size", "p_partkey", 10).select("p_partkey", "p_retailprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_quantity DESC, l_discount DESC, l_tax DESC, coalesce(CASE WHEN l_linenumber > 1 THEN l_extendedprice END, -1) DESC, l_orderkey * 10 + l_linenumber LIMIT 10")
def rank_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("similarity"), F.col("l_discount").alias("precision"), F.col("l_tax").alias("recall"), F.when(F.col("l_linenumber") > 1, F.col("l_extendedprice")).alias("order_score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"))
    return P.full_rank(rows, "key", 10).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id, source FROM documents WHERE lang = 'de'")
def doc_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "lang", "source").where("lang = 'de'").select("doc_id", "source")


@query("SELECT l_orderkey, CASE WHEN bool_or(l_linenumber % 2 = 0) THEN '.md' ELSE '.txt' END AS ext FROM lineitem GROUP BY l_orderkey")
def prefer_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, ".md").otherwise(".txt").alias("ext"))
    return P.preferred(rows, "l_orderkey", "ext")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_per_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.latest_per(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("SELECT doc_id, array_to_string(list_filter([lang, source, 'fast'], lambda x: x NOT IN ('en', 'fast')), ',') AS unknown FROM documents")
def config_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "lang", "source").select("doc_id", F.array_join(F.array_except(F.array("lang", "source", F.lit("fast")), F.array(F.lit("en"), F.lit("fast"))), ",").alias("unknown"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'en,' || source ELSE lang || ',' || source || ',en' END AS names FROM documents")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "lang", "source").select("doc_id", F.array_join(F.array_distinct(F.array("lang", "source", F.lit("en"), "lang")), ",").alias("names"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct([lang, source, 'en'])), ',') AS names FROM documents")
def snippet_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "lang", "source").select("doc_id", F.array_join(F.array_sort(F.array_union(F.array("lang", "source"), F.array(F.lit("en")))), ",").alias("names"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def pages_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered parts of a document as one text, a line each."""
    own = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return own.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


@query("SELECT l_linestatus, round(avg(l_quantity), 1) AS avg_l_quantity, round(avg(l_extendedprice), 1) AS avg_l_extendedprice FROM lineitem GROUP BY l_linestatus")
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.timing_summary(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_linestatus"])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def slowest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.slowest(table(spark, sf_dir, "lineitem"), "l_extendedprice", 10, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT event_id, value FROM events WHERE value >= 25")
def slow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.slow(table(spark, sf_dir, "events"), "value", 25.0).select("event_id", "value")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR lang = 'de'")
def metadata_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir, "lang").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "2020").alias("publication_date"), F.when(F.col("lang") == "de", F.col("lang")).alias("source"))
    return P.metadata_ready(rows).select("doc_id")


_DROPPED = "doc_id % 2 = 0 AND i % 5 = 2"


@query(f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: {_DROPPED}) AS gone FROM l),
s AS (SELECT doc_id, len(l) AS considered, len(gone) AS dropped, l, list_transform(gone, lambda i: regexp_replace(l[i], '^\\s+|\\s+$', '', 'g')) AS g FROM b),
r AS (SELECT *, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS ls FROM s),
h AS (SELECT *, list_transform(ls, lambda x: CASE WHEN regexp_extract(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^#{{1,6}}\\s+(.+)$', 1) <> '' THEN '# ' || trim(regexp_extract(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^#{{1,6}}\\s+(.+)$', 1)) WHEN lower(trim(x)) IN ('review', 'abstract', 'addresses', 'keywords') THEN '# ' || trim(x) ELSE x END) AS hs FROM r)
SELECT doc_id, considered, dropped, CASE WHEN len(g) = 0 THEN array_to_string(hs, chr(10)) ELSE regexp_replace(regexp_replace(array_to_string(list_filter(hs, lambda x: length(trim(x)) < 2 OR NOT list_contains(g, regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') END AS text FROM h""")
def render_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a block; in every other document each fifth one is a ghost."""
    own = docs(spark, sf_dir, "text")
    blocks = own.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("doc_id", "text", ((F.col("doc_id") % 2 != 0) | (F.pmod(F.col("i") + 1, F.lit(5)) != 2)).alias("keep"))
    return render(own, blocks)


# Layout


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    x, y = (k % 97) * 4.0, (k % 89) * 6.0
    q = L.rect(x, y + 12.0, x + 40.0, y, F.when(k % 2 == 0, "TOPLEFT"), F.lit(800.0))
    return table(spark, sf_dir, "lineitem").select(k.alias("box_id"), F.col("l_orderkey").alias("page"), F.when(k % 5 == 0, "caption").otherwise("text").alias("label"), q.alias("q"))


_BOX = "SELECT k AS box_id, l_orderkey AS page, CASE WHEN k % 5 = 0 THEN 'caption' ELSE 'text' END AS label, x AS x0, x + 40 AS x1, CASE WHEN k % 2 = 0 THEN y ELSE 800 - y - 12 END AS y0, CASE WHEN k % 2 = 0 THEN y + 12 ELSE 800 - y END AS y1 FROM (SELECT *, (k % 97) * 4.0::DOUBLE AS x, (k % 89) * 6.0::DOUBLE AS y FROM (SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS k FROM lineitem))"
_PIC = "SELECT o_orderkey AS page, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, (100 + o_orderkey % 300)::DOUBLE AS x1, (200 + o_orderkey % 400)::DOUBLE AS y1 FROM orders"


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("page"), F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (100 + k % 300).cast("double").alias("x1"), (200 + k % 400).cast("double").alias("y1")).alias("q"))


_INSIDE = f"SELECT b.box_id, b.page, b.label, b.x0, b.y0, b.label <> 'caption' AND coalesce(greatest(0, least(b.x1, p.x1) - greatest(b.x0, p.x0)) * greatest(0, least(b.y1, p.y1) - greatest(b.y0, p.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.6, false) AS inside FROM ({_BOX}) b LEFT JOIN ({_PIC}) p USING (page)"


@query(f"SELECT box_id, inside FROM ({_INSIDE})")
def bbox_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.inside_pictures(_boxes(spark, sf_dir), _pictures(spark, sf_dir)).select("box_id", "inside")


@query(f"SELECT b.box_id, array_to_string(list_sort(list(DISTINCT 'w' || w.box_id)), ' ') AS tokens FROM ({_BOX}) b JOIN ({_BOX}) w ON b.page = w.page AND (w.x0 + w.x1) / 2 BETWEEN b.x0 AND b.x1 AND (w.y0 + w.y1) / 2 BETWEEN b.y0 AND b.y1 GROUP BY b.box_id")
def bbox_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    words = boxes.select("page", F.concat(F.lit("w"), "box_id").alias("word"), "q.*")
    return L.words_inside(boxes, words).select("box_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"""WITH p AS (SELECT box_id // 10 AS block_id, box_id % 10 AS n, label, inside, NOT inside AND box_id % 3 = 0 AS supports FROM ({_INSIDE})),
s AS (SELECT * FROM (SELECT *, coalesce(max(supports::INT) OVER (PARTITION BY block_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stop FROM p) WHERE stop = 0)
SELECT block_id, bool_or(supports) AND NOT (max(label) <> 'caption' AND avg(inside::INT) >= 0.5) AS keep, round(avg(inside::INT), 6) AS picture_share FROM s GROUP BY block_id""")
def ghost_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = L.inside_pictures(_boxes(spark, sf_dir), _pictures(spark, sf_dir))
    provs = marked.select(F.col("page").alias("block_id"), (F.col("box_id") % 10).alias("n"), "label", "inside", (~F.col("inside") & (F.col("box_id") % 3 == 0)).alias("supports"), F.lit(0.001).alias("area_ratio"))
    return L.block_decisions(provs).select("block_id", "keep", F.round("picture_share", 6).alias("picture_share"))


@query(f"SELECT box_id, row_number() OVER (PARTITION BY page ORDER BY round_even(y0 / 20, 0), x0, box_id) AS position FROM ({_BOX})")
def block_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).select("page", F.col("box_id").alias("block_id"), "q.*")
    return L.reading_order(rows, "page").select(F.col("block_id").alias("box_id"), F.col("position").cast("long").alias("position"))


@query("SELECT conv_id AS doc_id, 'text' AS kind, turn AS n, text, lower(role) AS label, turn + 1 AS page_no FROM conversations")
def flatten_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    box = F.struct((F.col("turn") + 1).alias("page_no"), *[F.lit(1.0).alias(c) for c in "ltrb"])
    element = F.struct("text", F.col("role").alias("label"), F.array(box, F.struct(F.lit(None).cast("long").alias("page_no"), *[F.lit(None).cast("double").alias(c) for c in "ltrb"])).alias("prov"))
    grouped = rows.select(F.col("conv_id").alias("doc_id"), F.lit("text").alias("kind"), F.col("turn").alias("at"), F.array(element).alias("elements"))
    flat = L.flatten_elements(grouped.select("doc_id", "kind", "elements"))
    return flat.select("doc_id", "kind", (F.col("page_no") - 1).alias("n"), "text", "label", "page_no")


@query("WITH RECURSIVE up AS (SELECT n_nationkey AS id, (n_nationkey - 1) // 2 AS parent, 0 AS depth, n_name AS path FROM nation UNION ALL SELECT u.id, (t.n_nationkey - 1) // 2, u.depth + 1, t.n_name || ' / ' || u.path FROM up u JOIN nation t ON u.parent = t.n_nationkey WHERE u.depth < 9 AND u.id > 0 AND u.parent >= 0 AND NOT (u.depth > 0 AND u.parent = 0 AND u.path LIKE (SELECT n_name FROM nation WHERE n_nationkey = 0) || ' / %')) SELECT id, arg_max(path, depth) AS path FROM up GROUP BY id")
def section_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    tree = table(spark, sf_dir, "nation").select(k.alias("id"), F.when(k > 0, F.floor((k - 1) / 2)).alias("parent"), F.col("n_name").alias("title"))
    return L.section_paths(tree).select("id", "path")


@query("SELECT conv_id, turn, text FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)")
def leaf_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that no other names as its parent; an element's parent is the turn before."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("turn") - 1).alias("parent"))
    return leaves(rows, ["conv_id", "turn"], ["conv_id", "parent"]).select("conv_id", "turn", "text")


@query("SELECT doc_id, len(list_intersect(a, b)) >= 1 AND len(list_intersect(a, b)) >= 0.2 * len(a) AS agrees FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS a, ['the', 'and', 'of', 'to', 'in', 'die', 'der', 'que', 'de', 'la'] AS b FROM documents)")
def token_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = F.array(*[F.lit(w) for w in ("the", "and", "of", "to", "in", "die", "der", "que", "de", "la")])
    return docs(spark, sf_dir, "text").select("doc_id", L.agrees(T.overlap_tokens(F.col("text")), common).alias("agrees"))
