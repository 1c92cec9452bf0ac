"""Queries of the catalogue: artifacts put in, run states from events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import Catalogue
from ..operators.runs import run_states
from ..sources.tables import shared_folder
from .registry import query, table

_DOI = "'10.1/' || doc_id"


def artifacts(spark: SparkSession, sf_dir: str, revised: bool) -> DataFrame:
    """An artifact for each document with two authors by rule; revised ones have another title and the authors in the other order."""
    d = F.col("doc_id")
    one = F.struct(F.concat(F.lit("Author "), d % 97).alias("name"), F.when(d % 2 == 0, F.concat(F.lit("o"), d % 97)).alias("orcid"))
    two = F.struct(F.concat(F.lit("Author "), d % 89).alias("name"), F.lit(None).cast("string").alias("orcid"))
    title = F.concat(F.lit("New title " if revised else "Title "), d)
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("10.1/"), d).alias("doi"), title.alias("title"), F.array("lang").alias("keywords"), (F.array(two, one) if revised else F.array(one, two)).alias("authors"), F.col("text").alias("postprocessed_text"), F.lit("{}").alias("parser_config"), "doc_id")


@query(f"""
WITH d AS (SELECT doc_id, (doc_id % 3 = 0)::INT AS v FROM documents), known AS (SELECT DISTINCT doc_id % 97 AS k FROM documents WHERE doc_id % 2 = 0),
l AS (SELECT doc_id, v, v AS pos, doc_id % 97 AS k, doc_id % 2 = 0 AS o FROM d UNION ALL SELECT doc_id, v, 1 - v, doc_id % 89, false FROM d)
SELECT {_DOI} AS doi, CASE v WHEN 1 THEN 'New title ' ELSE 'Title ' END || doc_id AS title, min(pos) AS pos, 'Author ' || k AS full_name, CASE WHEN o OR k IN (SELECT k FROM known) THEN 'o' || k END AS orcid FROM l GROUP BY ALL""")
def artifact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and authors after all artifacts were put in, and then every third again with its authors replaced."""
    own = Catalogue(spark, f"{shared_folder(spark)}/catalogue-{uuid.uuid4().hex}")
    own.put(artifacts(spark, sf_dir, False).drop("doc_id"))
    state = own.put(artifacts(spark, sf_dir, True).where("doc_id % 3 = 0").drop("doc_id"))
    documents, links, authors = (own.read(n, state) for n in ("documents", "document_authors", "authors"))
    return documents.join(links, "document_id").join(authors, "author_id").select("doi", "title", "pos", "full_name", "orcid")


#: Events as those of runs: users are runs, purchases are chunks or ends by the number in their props.
_STAGE = "CASE event_type WHEN 'signup' THEN 'acquire' WHEN 'view' THEN 'store' WHEN 'click' THEN 'parse' WHEN 'purchase' THEN CASE WHEN {k} % 2 = 0 THEN 'chunk' ELSE 'done' END ELSE 'failed' END"
_RUNS = f"""
WITH e AS (SELECT user_id AS run, {_STAGE.format(k="json_extract(props, '$.k')::BIGINT")} AS stage, event_id, row_number() OVER w AS n, count(*) FILTER (WHERE event_type = 'signup') OVER w AS attempt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
a AS (SELECT run, attempt, count(*) AS n_events, min(n) FILTER (WHERE stage = 'failed') AS fail, min(n) FILTER (WHERE stage = 'store') AS s1, min(n) FILTER (WHERE stage = 'done') AS d0 FROM e GROUP BY ALL),
b AS (SELECT a.*, min(n) FILTER (WHERE stage = 'parse' AND n > s1) AS s2 FROM a JOIN e USING (run, attempt) GROUP BY ALL),
c AS (SELECT b.*, min(n) FILTER (WHERE stage = 'chunk' AND n > s2) AS s3 FROM b JOIN e USING (run, attempt) GROUP BY ALL),
d AS (SELECT c.*, min(n) FILTER (WHERE stage = 'done' AND n > s3) AS s4 FROM c JOIN e USING (run, attempt) GROUP BY ALL),
s AS (SELECT *, CASE WHEN d0 < coalesce(s1, d0 + 1) THEN d0 ELSE s4 END AS good, CASE WHEN d0 < coalesce(s1, d0 + 1) THEN 'metadata_only' ELSE 'full' END AS kind FROM d),
o AS (SELECT *, CASE WHEN attempt = 0 THEN 'new' WHEN fail < coalesce(good, fail + 1) THEN 'failed' WHEN good IS NOT NULL THEN 'success' ELSE 'running' END AS status FROM s),
p AS (SELECT *, CASE status WHEN 'failed' THEN fail WHEN 'success' THEN good ELSE 1000000000 END AS stop FROM o),
q AS (SELECT *, CASE WHEN status = 'success' AND kind = 'metadata_only' THEN 0 ELSE (s1 < stop AND s1 IS NOT NULL)::INT + coalesce((s2 < stop)::INT, 0) + coalesce((s3 < stop)::INT, 0) END AS reached FROM p),
r AS (SELECT *, CASE WHEN attempt = 0 THEN n_events ELSE n_events - 1 - reached - (status IN ('failed', 'success'))::INT END AS refused FROM q)
SELECT run, arg_max(status, attempt) AS status, arg_max(CASE status WHEN 'new' THEN '-' WHEN 'success' THEN 'done' ELSE ['acquire', 'store', 'parse', 'chunk'][reached + 1] END, attempt) AS stage,
 arg_max(CASE status WHEN 'failed' THEN ['acquire', 'store', 'parse', 'chunk'][reached + 1] ELSE '-' END, attempt) AS error_stage, arg_max(CASE status WHEN 'failed' THEN (SELECT 'event ' || event_id FROM e WHERE e.run = r.run AND e.n = r.fail) ELSE '-' END, attempt) AS error_message,
 arg_max(CASE status WHEN 'success' THEN kind ELSE '-' END, attempt) AS success_kind, max(attempt) AS attempts, sum(refused)::BIGINT AS refused FROM r GROUP BY run"""


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, at, event_id, stage, message)"""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("ts").alias("at"), "event_id", F.expr(_STAGE.format(k="cast(get_json_object(props, '$.k') AS BIGINT)")).alias("stage"), F.concat(F.lit("event "), "event_id").alias("message"))


@query(_RUNS)
def run_state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each run after all its events."""
    found = run_states(run_events(spark, sf_dir))
    return found.fillna("-", ["stage", "error_stage", "error_message", "success_kind"])
