"""Scores of extracted text against expectations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.text import let, rounded

# Weights of metadata fields, weights and worst cases of structure.
METADATA_WEIGHTS = {"title": 20, "authors": 20, "doi": 15, "date": 10, "source": 10, "abstract": 15, "keywords": 10}
FRAGMENTATION_WEIGHT, ORDER_WEIGHT, DUPLICATE_WEIGHT = 0.50, 0.30, 0.20
WORST_FRAGMENTATION, WORST_DUPLICATE = 0.40, 0.20
METADATA_CHARS = 5000
MATCH = 0.80
FUZZY, CONTENT_FUZZY = 0.70, 0.70
MIN_MATCHED = 3


def metadata_accuracy(values: dict[str, Column]) -> Column:
    """Weighted mean of the fields that have a value, 0 to 100; 0 if none has."""
    weight = sum((F.when(v.isNotNull(), float(METADATA_WEIGHTS[k])).otherwise(0.0) for k, v in values.items()), F.lit(0.0))
    total = sum((F.coalesce(v * METADATA_WEIGHTS[k], F.lit(0.0)) for k, v in values.items()), F.lit(0.0))
    return F.when(weight > 0, F.round(total / F.greatest(weight, F.lit(1.0)) * 100, 1)).otherwise(0.0)


def _scaled(value: Column, worst: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - value / worst) * 100))


def structural_quality(fragmentation: Column, order: Column, duplicates: Column) -> Column:
    """Weighted mean of three parts, 0 to 100; without an order its weight goes to the others."""
    a, b = _scaled(fragmentation, WORST_FRAGMENTATION), _scaled(duplicates, WORST_DUPLICATE)
    rest = FRAGMENTATION_WEIGHT + DUPLICATE_WEIGHT
    full = a * FRAGMENTATION_WEIGHT + order * 100 * ORDER_WEIGHT + b * DUPLICATE_WEIGHT
    return F.round(F.when(order.isNotNull(), full).otherwise(a * (FRAGMENTATION_WEIGHT / rest) + b * (DUPLICATE_WEIGHT / rest)), 1)


def concordance(positions: Column) -> Column:
    """Share of pairs of a list of places that are in rising order; null under two."""
    return folds.udf(folds.rising_share, "double")(positions)


def few_concordance(positions: Column) -> Column:
    """concordance() of a short list, by comparing all its pairs in the row."""
    n = F.size(positions)
    pairs = F.aggregate(F.transform(positions, lambda p, i: F.size(F.filter(F.slice(positions, i + 2, F.greatest(n, F.lit(1))), lambda q: q > p))), F.lit(0), lambda a, b: a + b)
    return F.when(n >= 2, pairs / (n * (n - 1) / 2))


def section_order(text: Column, expected: Column) -> Column:
    """Concordance of the first headings that hold, or are held by, each expected title."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?mUd)^#{1,3}\s+(.+)"), F.lit(1)), lambda h: F.lower(F.trim(h)))

    def score(headings: Column) -> Column:
        place = lambda e: F.array_position(F.transform(headings, lambda h: F.when(h.contains(e) | e.contains(h), 1).otherwise(0)), F.lit(1))
        places = F.filter(F.transform(expected, lambda e: place(F.lower(e))), lambda p: p > 0)
        return F.when((F.size(expected) >= 2) & (F.size(headings) > 0), F.round(let(places, few_concordance), 4))

    return let(found, score)


def exact_matches(extracted: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Per reference sentence the place of the first equal extracted one.

    Both sides: key, n (place), sentence.  Equality is the fast path before
    any fuzzy ratio; unmatched sentences have a null place.
    """
    first = extracted.groupBy(key, "sentence").agg(F.min("n").alias("place"))
    return reference.join(first, [key, "sentence"], "left").select(key, "n", "sentence", "place")


def recall(matches: DataFrame, key: str) -> DataFrame:
    """Sum of the ratios that count over all reference sentences (here 1 for an equal one)."""
    return matches.groupBy(key).agg(rounded(F.count("place") / F.count("*"), 4).alias("recall"))


def order_score(matches: DataFrame, key: str) -> DataFrame:
    """Concordance of matched places times coverage; null under three matches."""
    own = matches.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("n", "place")))), lambda x: x["place"]).alias("p"), F.count("*").alias("n"))
    return own.select(key, F.when(F.size("p") >= MIN_MATCHED, rounded(concordance(F.col("p")) * F.size("p") / F.col("n"), 4)).alias("order_score"))


def ratios(text: Column, wanted: Column) -> Column:
    """The best ratio of each wanted passage in the text; without Python where all are there as they are."""
    wanted = F.coalesce(wanted, F.array().cast("array<string>"))
    there = F.forall(wanted, lambda w: F.contains(F.lower(text), F.lower(w)))
    return F.when(there, F.transform(wanted, lambda w: F.lit(1.0))).otherwise(folds.udf(folds.fuzzy_ratios, "array<double>")(text, wanted))


def _mean(values: Column, digits: int) -> Column:
    return F.round(F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size(values), digits)


def author_accuracy(text: Column, expected: Column) -> Column:
    """struct(recall, avg_ratio) of expected names in the first METADATA_CHARS characters; zeros where none is expected."""
    return let(ratios(F.substring(text, 1, METADATA_CHARS), expected), lambda r: F.when(F.size(r) > 0, F.struct(F.round(F.size(F.filter(r, lambda x: x >= FUZZY)) / F.size(r), 4).alias("recall"), _mean(r, 4).alias("avg_ratio"))).otherwise(F.struct(F.lit(0.0).alias("recall"), F.lit(0.0).alias("avg_ratio"))))


def keyword_accuracy(text: Column, expected: Column) -> Column:
    """struct(recall, avg_ratio) of expected keywords in the text; null where none is expected."""
    return let(ratios(text, F.array_distinct(F.transform(expected, lambda k: F.lower(F.trim(k))))), lambda r: F.when(F.size(r) > 0, F.struct(F.round(F.size(F.filter(r, lambda x: x >= FUZZY)) / F.size(r), 4).alias("recall"), _mean(r, 4).alias("avg_ratio"))))


def continuity(text: Column, passages: Column) -> Column:
    """struct(found, total, avg_ratio) of passages that should stand in one piece; zeros where there are none."""
    return let(ratios(text, passages), lambda r: F.struct(F.size(F.filter(r, lambda x: x >= CONTENT_FUZZY)).alias("found"), F.size(r).alias("total"), F.when(F.size(r) > 0, _mean(r, 3)).otherwise(F.lit(0.0)).alias("avg_ratio")))


def presence(text: Column, passage: Column) -> Column:
    """struct(status, ratio): found where a window of the text is like the passage in any case; n/a without a passage.

    Python runs only where the passage isn't in the text as it is.
    """
    judged = lambda r: F.struct(F.when(r >= CONTENT_FUZZY, "found").otherwise("not_found").alias("status"), r.alias("ratio"))
    return F.when(passage.isNull(), F.struct(F.lit("n/a").alias("status"), F.lit(0.0).alias("ratio"))).otherwise(let(ratios(text, F.array(passage)), lambda r: judged(r[0])))


def authors_present(text: Column, expected: Column) -> Column:
    """struct(status, ratio): found where any of the names is like a window of the first METADATA_CHARS characters."""
    best = lambda r: F.coalesce(F.array_max(r), F.lit(0.0))
    return let(ratios(F.substring(text, 1, METADATA_CHARS), expected), lambda r: F.struct(F.when(best(r) >= CONTENT_FUZZY, "found").otherwise("not_found").alias("status"), best(r).alias("ratio")))


def references_present(text: Column) -> Column:
    return F.when(text.rlike(r"(?iU)\breferences\b|\bbibliography\b"), "found").otherwise("not_found")


def doi_present(text: Column, doi: Column) -> Column:
    return F.when(doi.isNull(), "n/a").when(F.contains(text, doi), "found").otherwise("not_found")


def content_presence(text: Column, title: Column, authors: Column, doi: Column, abstract: Column, passage: Column) -> Column:
    """struct of the status of the six parts and their count of found ones."""
    parts = {
        "title": presence(text, F.coalesce(title, F.lit("")))["status"], "authors": authors_present(text, authors)["status"], "doi": doi_present(text, doi),
        "abstract": presence(text, abstract)["status"], "references": references_present(text), "key_passage": presence(text, passage)["status"],
    }
    whole = F.struct(*[v.alias(k) for k, v in parts.items()])
    return let(whole, lambda p: p.withField("score", sum(((p[k] == "found").cast("int") for k in parts), F.lit(0))))


def year_found(text: Column, date: Column) -> Column:
    """1 if the date's year is in the first METADATA_CHARS characters, 0 if not, null without a date."""
    return F.when(F.coalesce(date, F.lit("")) != "", F.contains(F.substring(text, 1, METADATA_CHARS), F.substring(date, 1, 4)).cast("double"))


def doi_found(text: Column, doi: Column) -> Column:
    return F.when(doi.isNotNull(), F.contains(text, doi).cast("double"))


def with_defaults(measured: DataFrame, every: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """A row for each of every; fields that weren't measured get their default."""
    joined = every.join(measured, on, "left")
    return joined.select(*on, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])
