"""Bibliographic providers: landed raw answers projected to one record form.

Fetching is left to whatever lands the raw JSON; from there each provider is
a projection with a declared schema.  Providers are listed in their order of
priority.  Every projection gives the fields of FIELDS and found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "authors", "journal", "publish_date", "link", "keywords", "cited_articles", "doi", "document_type", "open_access", "status")

CROSSREF = """struct<title:array<string>, author:array<struct<given:string,family:string>>, publisher:string, published:struct<`date-parts`:array<array<int>>>, resource:struct<primary:struct<URL:string>>,
 reference:array<struct<DOI:string,unstructured:string,`article-title`:string,`volume-title`:string,author:string,year:string>>, DOI:string, type:string, `updated-by`:array<struct<type:string,updated:struct<`date-time`:string>>>, link:array<struct<URL:string,`content-type`:string>>>"""
OPENALEX = """title string, authorships array<struct<raw_author_name:string>>, primary_location struct<source:struct<host_organization_name:string>,landing_page_url:string>, mesh array<struct<descriptor_name:string>>, publication_date string, doi string, type string,
 open_access struct<is_oa:boolean,oa_url:string>, is_retracted boolean, referenced_works array<string>, best_oa_location struct<pdf_url:string>, locations array<struct<pdf_url:string>>"""
PUBMED = "title string, authors array<struct<name:string>>, fulljournalname string, pubdate string, articleids array<struct<idtype:string,value:string>>, pubtype array<string>"
HAL = "title_s array<string>, authFullName_s array<string>, journalTitle_s string, publicationDate_s string, uri_s string, mesh_s array<string>, keyword_s array<string>, doiId_s string, docType_s string, openAccess_bool boolean"
ARXIV = "title string, authors array<string>, published string, updated string, links array<struct<href:string,rel:string,title:string>>, journal_ref string, doi string, pdf_url string"



def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _names(xs: Column) -> Column:
    """Authors without an ORCID, blank names left out."""
    return F.transform(F.filter(F.coalesce(xs, F.array().cast("array<string>")), lambda n: _filled(n).isNotNull()), lambda n: F.struct(F.trim(n).alias("name"), _null("string").alias("orcid")))


def _record(found: Column, **fields: Column) -> Column:
    kinds = {"authors": "array<struct<name:string,orcid:string>>", "keywords": "array<string>", "cited_articles": "array<string>", "document_type": "array<string>", "status": "array<string>", "open_access": "boolean"}
    own = F.struct(found.alias("found"), *[fields.get(f, F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in FIELDS])
    return F.when(found, own).otherwise(F.struct(F.lit(False).alias("found"), *[_null(kinds.get(f, "string")).alias(f) for f in FIELDS]))


def crossref(raw: Column) -> Column:
    d = F.from_json(raw, f"message {CROSSREF}")["message"]

    def cited(r: Column) -> Column:
        title = F.coalesce(_filled(r["article-title"]), _filled(r["volume-title"]))
        built = F.when(title.isNotNull(), F.concat_ws(" ", title, _filled(r["author"]), F.when(_filled(r["year"]).isNotNull(), F.concat(F.lit("("), r["year"], F.lit(")")))))
        return F.coalesce(_filled(r["DOI"]), _filled(r["unstructured"]), built)

    updates = F.transform(d["updated-by"], lambda u: F.concat(F.coalesce(u["type"], F.lit("None")), F.lit(" on "), F.substring(F.coalesce(u["updated"]["date-time"], F.lit("")), 1, 10)))
    date = F.array_join(F.transform(F.try_element_at(d["published"]["date-parts"], F.lit(1)), lambda p: p.cast("string")), "-")
    return _record(
        d.isNotNull(), title=F.try_element_at(d["title"], F.lit(1)), authors=_names(F.transform(d["author"], lambda a: F.concat_ws(" ", a["given"], a["family"]))), journal=d["publisher"], publish_date=F.nullif(date, F.lit("")),
        link=d["resource"]["primary"]["URL"], cited_articles=F.array_compact(F.transform(F.coalesce(d["reference"], F.from_json(F.lit("[]"), "array<struct<DOI:string,unstructured:string,`article-title`:string,`volume-title`:string,author:string,year:string>>")), cited)),
        doi=d["DOI"], document_type=F.array_compact(F.array(d["type"])), status=F.when(F.size(d["updated-by"]) > 0, updates).otherwise(F.array(F.lit("published"))),
    )


def openalex(raw: Column) -> Column:
    """The cited list has the ids of works; batches() splits them for the second lookup."""
    d = F.from_json(raw, OPENALEX)
    mesh = F.array_distinct(F.filter(F.transform(d["mesh"], lambda m: m["descriptor_name"]), lambda x: _filled(x).isNotNull()))
    return _record(
        d.isNotNull(), title=d["title"], authors=_names(F.transform(d["authorships"], lambda a: a["raw_author_name"])), journal=d["primary_location"]["source"]["host_organization_name"], publish_date=d["publication_date"], link=d["primary_location"]["landing_page_url"],
        keywords=F.when(F.size(mesh) > 0, mesh), cited_articles=F.transform(d["referenced_works"], lambda u: F.element_at(F.split(u, "/"), -1)), doi=F.nullif(F.regexp_replace(d["doi"], "^https://doi.org/", ""), F.lit("")),
        document_type=F.array_compact(F.array(d["type"])), open_access=d["open_access"]["is_oa"], status=F.array(F.when(d["is_retracted"], "retracted").otherwise("published")),
    )


def pubmed(raw: Column) -> Column:
    d = F.from_json(raw, PUBMED)
    doi = F.try_element_at(F.transform(F.filter(d["articleids"], lambda a: a["idtype"] == "doi"), lambda a: a["value"]), F.lit(1))
    retracted = F.coalesce(F.array_contains(d["pubtype"], "Retracted Publication"), F.lit(False))
    return _record(d.isNotNull(), title=d["title"], authors=_names(F.transform(d["authors"], lambda a: a["name"])), journal=d["fulljournalname"], publish_date=d["pubdate"], doi=doi, document_type=F.when(F.size(d["pubtype"]) > 0, d["pubtype"]), status=F.array(F.when(retracted, "retracted").otherwise("published")))


def hal(raw: Column) -> Column:
    d = F.from_json(raw, HAL)
    kind = F.coalesce(F.create_map(F.lit("ART"), F.lit("article"), F.lit("THESIS"), F.lit("thesis"), F.lit("REPORT"), F.lit("report"))[d["docType_s"]], d["docType_s"])
    words = F.coalesce(F.when(F.size(d["mesh_s"]) > 0, d["mesh_s"]), F.when(F.size(d["keyword_s"]) > 0, d["keyword_s"]))
    return _record(d.isNotNull(), title=F.try_element_at(d["title_s"], F.lit(1)), authors=_names(d["authFullName_s"]), journal=d["journalTitle_s"], publish_date=d["publicationDate_s"], link=d["uri_s"], keywords=words, doi=d["doiId_s"], document_type=F.array_compact(F.array(kind)), open_access=d["openAccess_bool"], status=F.array(F.lit("published")))


def arxiv(raw: Column) -> Column:
    d = F.from_json(raw, ARXIV)
    link = F.try_element_at(F.transform(F.filter(d["links"], lambda x: x["rel"] == "alternate"), lambda x: x["href"]), F.lit(1))
    status = F.when(d["updated"] != d["published"], F.concat(F.lit("updated on "), F.substring(d["updated"], 1, 10))).otherwise("published")
    return _record(d.isNotNull(), title=d["title"], authors=_names(d["authors"]), journal=d["journal_ref"], publish_date=F.substring(d["published"], 1, 10), link=link, doi=d["doi"], open_access=F.lit(True), status=F.array(status))


#: Providers in order of priority.
REGISTRY: dict[str, Callable[[Column], Column]] = {"crossref": crossref, "openalex": openalex, "pubmed": pubmed, "hal": hal, "arxiv": arxiv}


def arxiv_query(doi: Column) -> Column:
    """Search term for a DOI: an id for the archive's own DOIs."""
    prefix = "10.48550/arXiv."
    return F.when(doi.startswith(prefix), F.concat(F.lit("id:"), F.substring(doi, len(prefix) + 1, 200))).otherwise(F.concat(F.lit("doi:"), doi))


def crossref_pdf(raw: Column) -> Column:
    d = F.from_json(raw, f"message {CROSSREF}")["message"]
    links = F.filter(d["link"], lambda x: F.coalesce(x["content-type"], F.lit("")).contains("pdf") & _filled(x["URL"]).isNotNull())
    return F.slice(F.transform(links, lambda x: x["URL"]), 1, 1)


def openalex_pdf(raw: Column) -> Column:
    from ..functions.metadata import pdf_url_candidates

    d = F.from_json(raw, OPENALEX)
    return pdf_url_candidates(d["best_oa_location"]["pdf_url"], F.transform(F.coalesce(d["locations"], F.from_json(F.lit("[]"), "array<struct<pdf_url:string>>")), lambda x: x["pdf_url"]), d["open_access"]["oa_url"])


def hal_pdf(raw: Column) -> Column:
    uri = F.from_json(raw, HAL)["uri_s"]
    return F.when(uri.isNotNull(), F.array(F.concat(uri, F.lit("/document")))).otherwise(F.array().cast("array<string>"))


def arxiv_pdf(raw: Column) -> Column:
    return F.array_compact(F.array(F.from_json(raw, ARXIV)["pdf_url"]))


def batches(ids: DataFrame, by: str, items: str, size: int = 100) -> DataFrame:
    """(by, batch, items) of at most size items, in order."""
    each = F.transform(F.sequence(F.lit(0), F.greatest((F.size(items) - 1).cast("int"), F.lit(0)), F.lit(size)), lambda i: F.slice(items, i + 1, size))
    return ids.where(F.size(items) > 0).select(by, F.posexplode(each).alias("batch", "items"))


def merged(raw: DataFrame) -> DataFrame:
    """One record per DOI from raw (doi, provider, body): of each field the longest value, of equal ones the first provider's.

    doi, sources and one column per field; values are JSON where a field is a
    list.
    """
    from ..operators.lineage import merge_longest, sources

    long = None
    for priority, (name, project) in enumerate(REGISTRY.items()):
        rows = raw.where(F.col("provider") == name).select(F.col("doi").alias("key"), project(F.col("body")).alias("r")).where("r.found")
        lists = [f for f in FIELDS if f in ("authors", "keywords", "cited_articles", "document_type", "status")]
        one = lambda f: F.size(F.col(f"r.{f}")) == 1

        def entry(f: str) -> Column:
            v = F.col(f"r.{f}")
            if f == "open_access":
                return F.struct(F.lit(f).alias("field"), F.lit("boolean").alias("kind"), v.cast("string").alias("value"), F.lit(0).alias("size"))
            if f in ("document_type", "status") and name not in ("pubmed",) and f != "status" or f == "status" and name != "crossref":
                s = F.element_at(F.when(F.size(v) > 0, v), 1)
                return F.struct(F.lit(f).alias("field"), F.lit("string").alias("kind"), s.alias("value"), F.length(s).alias("size"))
            if f == "status":
                s = F.when(one(f) & (F.element_at(F.when(F.size(v) > 0, v), 1) == "published"), F.lit("published"))
                return F.struct(F.lit(f).alias("field"), F.when(s.isNotNull(), "string").otherwise("list").alias("kind"), F.coalesce(s, F.to_json(v)).alias("value"), F.coalesce(F.length(s), F.size(v)).alias("size"))
            if f in lists:
                return F.struct(F.lit(f).alias("field"), F.lit("list").alias("kind"), F.to_json(v).alias("value"), F.size(v).alias("size"))
            return F.struct(F.lit(f).alias("field"), F.lit("string").alias("kind"), v.alias("value"), F.length(v).alias("size"))

        part = rows.select("key", F.lit(name).alias("provider"), F.lit(priority).alias("priority"), F.explode(F.array(*[entry(f) for f in FIELDS])).alias("e")).select("key", "provider", "priority", "e.*")
        long = part if long is None else long.union(part)
    best = merge_longest(long, "key").groupBy("key").pivot("field", list(FIELDS)).agg(F.first("value"))
    return best.withColumnRenamed("doi", "doi_value").join(sources(long, "key"), "key").withColumnRenamed("key", "doi")
