"""Scans: files of every kind the engine takes in, as DataFrames."""

from __future__ import annotations

import traceback
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUND_TRUTH = """documents map<string, struct<doc_type string, publisher string, title string, authors array<string>, doi string, publication_date string, source string, abstract_first_sentence string, keywords string, language string, has_references boolean,
 num_tables int, num_references_approx int, key_passage string, key_passage_page int, sections_in_order array<string>, continuity_passages array<struct<text string, spans string, page int>>>>"""

SEARCH_RESULT = """status string, narrative string, chunks array<struct<type string, content string, score double, metadata struct<document_id long, page int>>>,
 documents map<string, struct<id long, doi string, title string, journal string, date string, link string, keywords array<string>, author_ids array<string>>>, authors map<string, struct<name string, orcid string>>"""


def doi_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a seed file with their number in the file (the header is row 1); needs a doi column."""
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    if "doi" not in df.columns:
        raise ValueError(f"{path} has no doi column")
    if "pdf_url" not in df.columns:
        df = df.withColumn("pdf_url", F.lit(None).cast("string"))
    # Seed files are one small file: the order of its rows is that of the file.
    return df.coalesce(1).withColumn("row_number", F.monotonically_increasing_id() + 2)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(filename, record fields) of an annotation file."""
    df = spark.read.schema(GROUND_TRUTH).option("multiLine", True).json(path)
    return df.select(F.explode_outer("documents").alias("filename", "record")).where("filename is not null").select("filename", "record.*")


def filenames_of(truth: DataFrame, doc_type: str) -> DataFrame:
    """Files of a document type; an unknown type is an error."""
    own = truth.where(F.col("doc_type") == doc_type).select("filename")
    if not own.take(1):
        raise ValueError(f"no document has the type {doc_type}")
    return own


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, ext, text), one row per file."""
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.withColumns({"stem": F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1), "ext": F.regexp_extract("path", r"(\.[^./]*)$", 1)})


def extracted_texts(spark: SparkSession, path: str) -> DataFrame:
    """whole_texts of <variant>/<config>/<stem>.txt with variant and config."""
    df = whole_texts(spark, path)
    return df.withColumns({"variant": F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1), "config": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)})


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """(keyword, prompt) of markdown files, in order of keyword."""
    return whole_texts(spark, path).where("ext = '.md'").select(F.col("stem").alias("keyword"), F.trim("text").alias("prompt")).orderBy("keyword")


def binaries(spark: SparkSession, path: str, suffix: str = ".pdf", allowed: list[str] | None = None) -> DataFrame:
    """(name, content, length) of files with a suffix in any case; order them by name where few are shown."""
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    df = df.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content", "length")
    return df.where(F.col("name").isin(allowed)) if allowed else df


def score_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A score table with a declared schema; unreadable numbers are null."""
    return spark.read.option("header", True).schema(schema).option("mode", "PERMISSIVE").csv(path)


def keyed_records(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, fields...) of a JSON object of objects; value is the struct's DDL."""
    df = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<{value}>>").alias("m"))
    return df.select(F.explode("m").alias("key", "v")).select("key", "v.*")


def search_result(spark: SparkSession, path: str) -> DataFrame:
    """One stored search answer; fields that it lacks are null."""
    return spark.read.schema(SEARCH_RESULT).option("multiLine", True).json(path)


def search_answers(spark: SparkSession, live: Callable[[], DataFrame], stored: str | None = None) -> DataFrame:
    """A stored answer where the configuration names one, else what live() finds."""
    return search_result(spark, stored) if stored else live()


def object_path(bucket: str | None, key: str | None, prefix: str = "ingestion/sources") -> str:
    """Address of a stored source; a missing bucket or key is an error."""
    if not bucket or not key:
        raise ValueError("a bucket and a key are needed")
    return f"s3a://{bucket}/{prefix}/{key}"


class Extractors:
    """Registry of text extractors by configuration type: bytes -> (text, pages)."""

    def __init__(self):
        self._by_type: dict[str, Callable[[bytes], tuple[str, int]]] = {"plain": lambda b: (b.decode("utf-8", "replace"), 1)}

    def register(self, kind: str, extract: Callable[[bytes], tuple[str, int]]) -> None:
        self._by_type[kind] = extract

    def apply(self, files: DataFrame, kind: str) -> DataFrame:
        """(name, text, pages) of files(name, content); a file that fails has one page, no text and its error."""
        if kind not in self._by_type:
            raise ValueError(f"unknown extractor: {kind}")
        extract = self._by_type[kind]

        def run(parts):
            import pandas as pd

            for part in parts:
                out = []
                for name, content in zip(part["name"], part["content"], strict=True):
                    try:
                        out.append((name, *extract(bytes(content)), None))
                    except Exception:  # a row reports its own failure
                        out.append((name, None, 1, traceback.format_exc(limit=-3)))
                yield pd.DataFrame(out, columns=["name", "text", "pages", "error"])

        return files.select("name", "content").mapInPandas(run, "name string, text string, pages int, error string")


def file_states(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length) of the files at or below a path; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")


def file_signature(spark: SparkSession, path: str) -> str:
    """A number that changes with any of the files, their times or their sizes."""
    own = F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")
    return str(tuple(file_states(spark, path).agg(F.count("*"), F.sum(own), F.sum("length")).first()))


def resolve_configs(known: dict[str, list[str]], profile: str, explicit: str | None = None) -> list[str]:
    """Configurations of a comma list, each once and in order, else of a profile; unknown ones are an error."""
    every = list(dict.fromkeys(c for names in known.values() for c in names))
    names = [c.strip() for c in explicit.split(",") if c.strip()] if explicit else known.get(profile)
    if names is None:
        raise ValueError(f"unknown profile: {profile}")
    if bad := [c for c in names if c not in every]:
        raise ValueError(f"unknown configurations: {', '.join(bad)}")
    return list(dict.fromkeys(names))
