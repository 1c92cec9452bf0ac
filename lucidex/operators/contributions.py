"""Contributions against their vocabularies, and searches in the catalogue's lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim

# Categories of contributions, the default first, and types of study.
CATEGORIES = ("scientific_article", "report", "thesis", "working_paper", "book_chapter", "other")
STUDY_TYPES = ("meta_analysis", "systematic_review", "evidence_review", "cohort_study", "case_control_study", "cross_sectional_study", "rct", "other")
VOCABULARIES = {"category": CATEGORIES, "study_type": STUDY_TYPES}


def vocabularies(spark: SparkSession) -> DataFrame:
    """(field, value, position) of all vocabularies."""
    return spark.createDataFrame([(f, v, i) for f, own in VOCABULARIES.items() for i, v in enumerate(own)], "field string, value string, position int")


def validated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, refused rows with their faults): a blank category is the default, a study type may be missing."""
    filled = rows.withColumns({"category": F.coalesce(F.nullif(trim("category"), F.lit("")), F.lit(CATEGORIES[0])), "study_type": F.nullif(trim("study_type"), F.lit(""))})
    wrong = lambda f: F.when(~F.coalesce(F.col(f).isin(*VOCABULARIES[f]), F.lit(True)), F.concat(F.lit(f"{f}: "), f))
    judged = filled.withColumn("faults", F.array_compact(F.array(*[wrong(f) for f in VOCABULARIES])))
    return judged.where(F.size("faults") == 0).drop("faults"), judged.where(F.size("faults") > 0)


def _like(term: str) -> str:
    return "%" + "".join(f"\\{c}" if c in "\\%_" else c for c in term) + "%"


def listed(rows: DataFrame, term: str = "", fields: tuple[str, ...] = (), **equal) -> DataFrame:
    """Rows in which each word of the term stands in some field in any case, and whose columns have the given values."""
    conditions: list[Column] = [F.col(c) == v for c, v in equal.items()]
    conditions += [reduce(lambda a, b: a | b, [F.col(f).ilike(_like(w)) for f in fields]) for w in term.split()]
    return rows.where(reduce(lambda a, b: a & b, conditions)) if conditions else rows


def leaves(elements: DataFrame, key: list[str], parent: list[str]) -> DataFrame:
    """Elements that no other names as its parent."""
    named = elements.select(*[F.col(p).alias(k) for k, p in zip(key, parent, strict=True)])
    return elements.join(named, key, "left_anti")


def names_in_order(*columns: Column) -> Column:
    """The columns' values, each once, in order, without null and blank ones."""
    return F.array_distinct(F.filter(F.array(*columns), lambda x: F.coalesce(x, F.lit("")) != ""))
