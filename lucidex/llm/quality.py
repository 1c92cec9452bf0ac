"""Quality rules with adaptive thresholds (DataFrame functions only).

Every document has fixed base rules and four measures in parts per ten
thousand: symbols per word character, repeated lines per line, words in
repeated 8-word windows per word, and characters per word (in hundredths).
The measures of documents that pass the base rules go into mergeable
log-linear quantile sketches: counters over buckets of a relative width of
1/64, one sketch for each language, source and measure.  Sketches add up: a
group's own is merged with PRIOR documents' worth of its language's and as much
of everything's, so a small group leans on the others and a large one on
itself, without a switch between them.

Thresholds are read from the merged sketch.  What nearly all documents have
much alike (symbols, word length) may lie FENCE quartile distances beyond the
quartiles, on both sides for the word length.  Where at least ZEROS of a
group's documents have no symbols, quartiles are zero and say nothing; then
the sketch of the others sets the limit by its 10 % and 90 % quantiles: half
the lower one where they lie within a factor of APART (all that have symbols
have many), else their geometric mean, which parts those with a few from those
with many.  What few documents have at all (repeated lines and passages) may
lie half as far again from the median as the TAIL quantile.  FLOOR is the
least limit of a share.  Documents are joined with their group's thresholds;
one beyond a threshold is rejected.

One pass over the texts makes the measures, which are written once; sketches
and filtering read that narrow table.

Defined cases: null text counts as empty and fails the base rules; null
language or source is a group of its own; repeated rows each count; an empty
table gives an empty result; extra columns are ignored by verdicts() and kept
by filter_documents().
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Documents' worth of the language's and of all documents' sketch that is merged into each group's.
PRIOR = 100

#: Threshold rows (about 100 bytes each) that are broadcast at most.
BROADCAST_GROUPS = 200_000
#: Measures with a fence around the quartiles, and its quartile distances.
FENCED = ("symbols", "word_length")
FENCE = 6
#: Of the others, the quantile in parts per thousand whose distance from the median counts one and a half times.
TAIL = 995

#: Share of zeros in parts per thousand from which the others decide, and the factor between their outer quantiles.
ZEROS = 800
APART = 16

#: Measure -> least limit, in the measure's unit: one symbol in 400 characters; one line or word in ten repeated.
FLOOR = {"symbols": 25, "dup_lines": 1000, "repeats": 1000, "word_length": 0}

#: Sub-buckets to a power of two, and the weight of one document in a merged sketch.
SUB_BITS = 6
WEIGHT = 1000


def with_measures(df: DataFrame, text: Column) -> DataFrame:
    """df with _words.._repeat columns of text; all in the row, no shuffle."""
    df = df.withColumn("_t", F.coalesce(text, F.lit(""))).withColumn("_w", F.array_remove(F.split("_t", SPACE), "")).withColumn("_n", F.size("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    hashes = F.when(F.col("_n") > WINDOW, F.transform(F.sequence(F.lit(1), F.col("_n") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW))))
    df = df.withColumn("_h", hashes)
    df = df.withColumn("_again", F.coalesce(F.size(F.array_distinct("_h")) < F.size("_h"), F.lit(False)))
    # Only texts in which a window's hash recurs compare the windows themselves, next to each other in sorted order.
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.col("_n") - WINDOW), lambda i: F.struct(F.array_join(F.slice("_w", i + 1, WINDOW), " ").alias("w"), i.alias("p"))))
    df = df.withColumn("_s", F.when(F.col("_again"), windows))
    beside = F.arrays_zip(F.col("_s").alias("s"), F.concat(F.array(F.lit(None).cast("struct<w:string,p:int>")), F.col("_s")).alias("a"), F.slice("_s", 2, F.size("_s")).alias("b"))
    df = df.withColumn("_p", F.when(F.col("_again"), F.sort_array(F.array_compact(F.transform(beside, lambda x: F.when((x["s"]["w"] == x["a"]["w"]) | (x["s"]["w"] == x["b"]["w"]), x["s"]["p"]))))))
    steps = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(0))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    repeats = F.when(F.col("_again") & (F.size("_p") > 0), F.aggregate(steps, F.lit(0), lambda n, x: n + x)).otherwise(0)
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        F.col("_n").cast("long").alias("_words"), F.length(F.array_join("_w", "")).cast("long").alias("_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_dup"), F.size("_lines").cast("long").alias("_nlines"), repeats.cast("long").alias("_repeat"),
    )


def base_failed() -> Column:
    return (F.col("_words") < MIN_WORDS) | (100 * F.col("_repeat") > MAX_REPEAT_PERCENT * F.col("_words"))


def _per(a: str, b: str, unit: int) -> Column:
    """Whole parts of unit; 0 where there is nothing to divide by."""
    return F.when(F.col(b) > 0, F.expr(f"({a} * {unit}) div {b}")).otherwise(F.lit(0)).cast("long")


def measures() -> dict[str, Column]:
    return {"symbols": _per("_symbols", "_chars", 10_000), "dup_lines": _per("_dup", "_nlines", 10_000), "repeats": _per("_repeat", "_words", 10_000), "word_length": _per("_chars", "_words", 100)}


def bucket(x: Column) -> Column:
    """Number of the log-linear bucket of a whole number x >= 0."""
    shift = F.greatest(F.length(F.bin(x)) - (SUB_BITS + 1), F.lit(0))
    return F.when(x < 2**SUB_BITS, x).otherwise(shift.cast("long") * 2**SUB_BITS + F.call_function("shiftright", x, shift)).cast("int")


def bucket_floor(b: Column) -> Column:
    """Smallest x of a bucket."""
    shift = F.when(b < 2 ** (SUB_BITS + 1), F.lit(0)).otherwise(F.floor(b / 2**SUB_BITS) - 1).cast("int")
    return F.call_function("shiftleft", (b - shift * 2**SUB_BITS).cast("long"), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): one mergeable sketch for each language, source and measure."""
    long = measured.where(~base_failed()).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(c).alias("bucket")) for k, c in measures().items()])).alias("x"))
    return long.groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, w): each group's sketch with PRIOR documents of its language's and of everything's, in WEIGHTs."""
    groups = sketch.select("lang", "source", "measure").distinct()

    def prior(by: list[str]) -> DataFrame:
        summed = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
        totals = summed.groupBy(*by, "measure").agg(F.sum("n").alias("docs"))
        names = {c: f"p_{c}" for c in (*by, "measure")}
        same = lambda x, y: functools.reduce(lambda a, b: a & b, [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in (*by, "measure")])
        share = summed.alias("s").join(totals.alias("t"), same("s", "t")).select(*[F.col(f"s.{c}").alias(n) for c, n in names.items()], "bucket", F.expr(f"({PRIOR * WEIGHT} * n) div docs").alias("w"))
        on = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
        return groups.join(share, on).select("lang", "source", "measure", "bucket", "w")

    own = sketch.select("lang", "source", "measure", "bucket", (F.col("n") * WEIGHT).alias("w"))
    return own.union(prior(["lang"])).union(prior([])).groupBy("lang", "source", "measure", "bucket").agg(F.sum("w").alias("w"))


def quantiles(sketch: DataFrame) -> DataFrame:
    """(lang, source, measure, q25, q50, q75, tail, few, many, zeros): upper ends of the buckets that hold these quantiles, the lower end for q25.

    few and many are the lower end of the 10 % quantile and the upper end of
    the 90 % quantile of values above zero; zeros, the parts per thousand of zero.
    """
    group = ["lang", "source", "measure"]
    ranked = sketch.withColumn("upto", F.sum("w").over(Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("w").over(Window.partitionBy(*group)))
    q = lambda p: F.min(F.when(F.col("upto") * 1000 >= F.col("all") * p, F.col("bucket")))
    ranked = ranked.withColumn("none", F.sum(F.when(F.col("bucket") == 0, F.col("w")).otherwise(0)).over(Window.partitionBy(*group)))
    some = lambda p: F.min(F.when((F.col("bucket") > 0) & ((F.col("upto") - F.col("none")) * 1000 >= (F.col("all") - F.col("none")) * p), F.col("bucket")))
    found = ranked.groupBy(*group).agg(q(250).alias("b25"), q(500).alias("b50"), q(750).alias("b75"), q(TAIL).alias("btail"), some(100).alias("bfew"), some(900).alias("bmany"), F.expr("max(none) * 1000 div max(all)").alias("zeros"))
    top = lambda c: bucket_floor(F.col(c) + 1) - 1
    return found.select(*group, bucket_floor(F.col("b25")).alias("q25"), top("b50").alias("q50"), top("b75").alias("q75"), top("btail").alias("tail"), bucket_floor(F.col("bfew")).alias("few"), top("bmany").alias("many"), "zeros")


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, hi_<measure>..., lo_word_length): one row for each language and source."""
    spread = FENCE * (F.col("q75") - F.col("q25"))
    fenced = F.col("measure").isin(*FENCED)
    least = F.create_map(*[x for k, v in FLOOR.items() for x in (F.lit(k), F.lit(v))])
    apart = F.when(F.col("many") <= APART * F.col("few"), F.expr("few div 2")).otherwise(F.floor(F.sqrt((F.col("few") * F.col("many")).cast("double"))))
    rare = (F.col("measure") == "symbols") & (F.col("zeros") >= ZEROS)
    hi = F.when(rare, F.coalesce(apart, F.lit(0))).when(fenced, F.col("q75") + spread).otherwise(F.expr("tail + (tail - q50) div 2"))
    limits = quantiles(merged(sketch)).select("lang", "source", "measure", F.greatest(hi, F.element_at(least, F.col("measure"))).alias("hi"), (F.col("q25") - spread).alias("lo"))
    at = lambda k, c: F.max(F.when(F.col("measure") == k, F.col(c)))
    return limits.groupBy("lang", "source").agg(*[at(k, "hi").alias(f"hi_{k}") for k in FLOOR], at("word_length", "lo").alias("lo_word_length"))


def judged(measured: DataFrame, limit: DataFrame) -> DataFrame:
    """measured joined with the thresholds of its language and source, with _base_failed and _kept."""
    limit = limit.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = measured.join(limit, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    over = F.lit(False)
    for k, c in measures().items():
        over = over | (c > F.col(f"hi_{k}"))
    over = over | (measures()["word_length"] < F.col("lo_word_length"))
    # One sum, not a conjunction: a filter on it can't be split and pushed below, where it would make the measures again.
    against = base_failed().cast("int") + F.coalesce(over, F.lit(False)).cast("int")
    return joined.withColumn("_base_failed", base_failed()).withColumn("_kept", against == 0)


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts, base result and verdict of every document row."""
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    measured = materialize(with_measures(rows, F.col("text")).drop("text"), "measures")
    return judged(measured, thresholds(sketches(measured))).select(
        F.col("key").alias(key), F.col("_words").alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_symbols").alias("n_symbols"), F.col("_dup").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"),
    )


def filter_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """The rows of docs that are kept, unchanged.

    One pass over the texts writes the rows with their measures; the sketches
    read the narrow columns of that table only, and the filter reads the rows.
    While there are at most broadcast_groups thresholds they are broadcast, so
    no text moves.
    """
    if not docs.columns:
        raise ValueError("docs has no columns")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"))
    measured = materialize(with_measures(packed, F.col("row").getField(text)), "measured-rows")
    limit = materialize(thresholds(sketches(measured)), "thresholds")
    return judged(measured, F.broadcast(limit) if limit.count() <= broadcast_groups else limit).where("_kept").select("row.*")
