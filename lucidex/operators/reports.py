"""Summaries of score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile(scores: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Means per group, nulls skipped, a null group kept."""
    return scores.groupBy(*by).agg(*[F.round(F.avg(m), 6).alias(m) for m in metrics])


def runtime(scores: DataFrame, by: str, total: str, per_page: str) -> DataFrame:
    return scores.where(F.col(total).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(total), 6).alias("mean_total"), F.median(total).alias("median_total"), F.median(per_page).alias("median_per_page"))


def long_form(scores: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return scores.unpivot(ids, metrics, "metric", "score")


def pivot(scores: DataFrame, rows: str, columns: str, values: list, metric: str) -> DataFrame:
    return scores.groupBy(rows).pivot(columns, values).agg(F.round(F.avg(metric), 6))


def wins(scores: DataFrame, unit: str, config: str, metric: str, order: str) -> DataFrame:
    """How often each configuration is a unit's best; ties go to the first row, then to the larger name.

    The best of a unit is an arg-max aggregate with partial sums, not a window.
    """
    best = scores.where(F.col(metric).isNotNull()).groupBy(unit).agg(F.max_by(config, F.struct(F.col(metric), -F.col(order), F.col(config))).alias(config))
    counts = best.groupBy(config).agg(F.count("*").alias("wins"))
    return scores.select(config).distinct().join(counts, config, "left").select(config, F.coalesce("wins", F.lit(0)).alias("wins"))


def quartiles(scores: DataFrame, by: str, metric: str) -> DataFrame:
    q = F.percentile(metric, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return scores.groupBy(by).agg(F.min(metric).alias("low"), q.alias("q"), F.max(metric).alias("high")).select(by, "low", F.element_at("q", 1).alias("q1"), F.element_at("q", 2).alias("q2"), F.element_at("q", 3).alias("q3"), "high")


def left_with_suffix(left: DataFrame, right: DataFrame, on: list[str], suffix: str) -> DataFrame:
    """Left join; columns of the right side that clash get the suffix."""
    clash = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in on}
    return left.join(right.withColumnsRenamed(clash), on, "left")


def coerced(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that are there as numbers, null where they can't be."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in columns if c in df.columns})


def backfilled(df: DataFrame, column: str, legacy: str) -> DataFrame:
    return df if column in df.columns or legacy not in df.columns else df.withColumn(column, F.col(legacy))


def percent_to_share(metric: Column, value: Column, names: list[str]) -> Column:
    return F.when(metric.isin(*names), value / 100).otherwise(value)


def fast_rank(rows: DataFrame, similarity: str, chars: str, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(similarity), F.asc(chars), key).limit(n)


def full_rank(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc("similarity"), F.desc("precision"), F.desc("recall"), F.coalesce("order_score", F.lit(-1.0)).desc(), key).limit(n)


def latest_per(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Last row of each group."""
    return rows.groupBy(by).agg(F.max_by(F.struct(*[c for c in rows.columns if c != by]), order).alias("s")).select(by, "s.*")


def preferred(rows: DataFrame, by: str, ext: str, order: tuple[str, ...] = (".md", ".txt")) -> DataFrame:
    """Of files with one stem, that with the preferred extension."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(ext))
    return rows.where(at > 0).groupBy(by).agg(F.min_by(ext, at).alias(ext))


def ranked_in(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows of each group (WindowGroupLimit cuts before the shuffle)."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")


def timing_summary(rows: DataFrame, parts: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean of each part of the time, to a tenth, over all rows or per group."""
    return rows.groupBy(*(by or [])).agg(*[F.round(F.avg(p), 1).alias(f"avg_{p}") for p in parts])


def slowest(rows: DataFrame, total: str, n: int = 10, *ties: str) -> DataFrame:
    return rows.orderBy(F.col(total).desc_nulls_last(), *ties).limit(n)


def slow(rows: DataFrame, total: str, least: float = 250.0) -> DataFrame:
    """Rows that took at least so many milliseconds."""
    return rows.where(F.col(total) >= least)


def metadata_ready(truth: DataFrame) -> DataFrame:
    """Annotations that metadata can be scored against: with a date or a source."""
    return truth.where("publication_date is not null or source is not null")


#: Default orders of the catalogue's tables.
DEFAULT_ORDERS = {"documents": ("created_at", False), "runs": ("created_at", False), "chunks": ("order", True)}


def in_default_order(rows: DataFrame, table: str, tie: str) -> DataFrame:
    column, rising = DEFAULT_ORDERS[table]
    return rows.orderBy(F.col(column).asc() if rising else F.col(column).desc(), tie)
