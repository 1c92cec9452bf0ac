"""The clean-up of extracted text in its fixed order."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import folds, policy
from ..functions import text as T


def _hex_entities(text: str) -> str:
    import html
    import re

    return re.sub(r"&#x[0-9a-fA-F]+;", lambda m: html.unescape(m.group()), text)


def scientific(c: Column) -> Column:
    return T.trim(T.squeeze_blank(T.strip_legal(F.regexp_replace(c, r"(?iU)\bhairspace\b", " "))))


def postprocess(df: DataFrame, text: str = "text", doc_type: str | None = None, indexing: bool = False) -> DataFrame:
    """Artifacts, entities, hyphens, comments, stitching, document type, repeated lines, indexing.

    All but stitching and numeric entities are column expressions.
    """
    hexed = folds.udf(_hex_entities, "string")
    c = T.letter_artifacts(F.col(text))
    df = df.withColumn(text, F.when(c.contains("&#x"), hexed(c)).otherwise(c))
    df = df.withColumn(text, T.strip_comments(T.rejoin_hyphens(T.named_entities(F.col(text)))))
    df = df.withColumn(text, folds.udf(folds.stitch_paragraphs, "string")(F.col(text)))
    if doc_type == "scientific_paper":
        df = df.withColumn(text, scientific(F.col(text)))
    elif doc_type == "policy_advocacy":
        df = df.withColumn(text, policy.clean_policy(F.col(text)))
    df = df.withColumn(text, T.drop_repeated_lines(F.col(text)))
    return df.withColumn(text, T.indexing_cleanup(F.col(text))) if indexing else df


# Functions travel inside the tasks, so workers need not import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
