"""Audit of filters and of their interactions, by scanning Arrow buffers.

Five filters are applied to whole texts: A too few words, B too many repeated
words, C too many capitals, D holds a symbol, E equal to a document with a
smaller id.  For every order of the five and every step the audit counts what
is kept and removed, what a filter would have removed had an earlier one not
done so, what only that filter removes, which good and toxic documents go, and
each filter's share over all orders.

A to D come from the text's UTF-8 buffer as Arrow holds it, without making
Python strings: a table gives each byte its classes, prefix sums over class
flags give each document's words, capitals, symbols and code points by two
look-ups.  Distinct words come from hashes of all words (a polynomial over the
bytes, also by prefix sums), sorted per document; equal neighbours are compared
byte by byte, and a document with two different words of one hash is counted by
its words themselves.  E is by SHA-256 of the text: first equal rows are
counted, then each digest's smallest id is looked for, so a text that a third
of all rows share is a few rows after the first, partial aggregation.

A document is then a mask of five bits.  Masks are counted per part and label,
and the numbers of documents that fail none of a set of filters, for all 32
sets, give all figures of all 120 orders; only counts of masks move.

Defined cases: null text counts as empty; a null language is the part ''; a
null id is neither smaller nor larger than any other, so E never removes such
a row nor counts it; rows that repeat an id aren't removed for each other; a
document has a label if any of its label rows says so, and labels of a null id
count for none; empty tables give no rows; extra columns are ignored, because
inputs are projected first.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value

# Names and limits of the five filters.
FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
SYMBOLS = b"#$%&*|"
SPACE = b" \t\n\x0b\x0c\r"

#: Bytes of text that are scanned at once, unless one word or document has more.
BLOCK = 1 << 20

_FACTOR = 0x9E3779B97F4A7C15


def _set(filters: Iterable[str]) -> int:
    return sum(1 << FILTERS.index(f) for f in filters)


class Tables:
    """Byte classes and hash powers, made once for each worker process."""

    def __init__(self):
        import numpy as np

        of = lambda marked: np.isin(np.arange(256), list(marked))
        self.space, self.symbol = of(SPACE), of(SYMBOLS)
        self.capital, self.start = of(range(0x41, 0x5B)), ~of(range(0x80, 0xC0))
        self.value = np.random.default_rng(1).integers(1, 1 << 62, 256, dtype=np.uint64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def upto(self, n: int):
        """Powers of the odd factor and of its inverse modulo 2**64, n of them at least."""
        import numpy as np

        if len(self.powers) < n:
            n = max(n, BLOCK + 1)
            steps = []
            for x in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
                row = np.full(n, x, np.uint64)
                row[0] = 1
                steps.append(np.multiply.accumulate(row))
            self.powers, self.inverses = steps
        return self.powers, self.inverses


def per_document(flags, offsets):
    """Sums of flags between neighbouring offsets, by prefix sums."""
    import numpy as np

    sums = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, dtype=np.int32, out=sums[1:])
    at = sums[offsets]
    return at[1:] - at[:-1]


def word_hashes(data, starts, ends, tables: Tables):
    """A 64-bit hash of each word data[start:end], in blocks of whole words."""
    import numpy as np

    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        first, last = starts[at], ends[upto - 1]
        powers, inverses = tables.upto(int(last - first))
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(tables.value[data[first:last]] * powers[: last - first], out=sums[1:])
        a, b = starts[at:upto] - first, ends[at:upto] - first
        out[at:upto] = (sums[b] - sums[a]) * inverses[a]
        at = upto
    return out


def unlike(data, starts, ends, left, right):
    """Places of pairs of words whose bytes differ, compared in blocks."""
    import numpy as np

    sizes = ends[left] - starts[left]
    odd = sizes != ends[right] - starts[right]
    bad = [np.flatnonzero(odd)]
    same = np.flatnonzero(~odd)
    upto = np.cumsum(sizes[same])
    at = 0
    while at < len(same):
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + BLOCK, "right")))
        rows, own = same[at:end], sizes[same[at:end]]
        inside = np.arange(own.sum()) - np.repeat(upto[at:end] - own - before, own)
        differ = data[np.repeat(starts[left[rows]], own) + inside] != data[np.repeat(starts[right[rows]], own) + inside]
        if differ.any():
            bad.append(np.unique(np.repeat(rows, own)[differ]))
        at = end
    return np.concatenate(bad)


def distinct_words(data, starts, ends, bounds, tables: Tables):
    """Distinct words of each document; bounds are the documents' places among the words."""
    import numpy as np

    hashes = word_hashes(data, starts, ends, tables)
    out = np.diff(bounds)
    lefts, rights, owners = [], [], []
    for d in np.flatnonzero(out > 1):
        a, b = bounds[d], bounds[d + 1]
        order = np.argsort(hashes[a:b])
        own = hashes[a:b][order]
        equal = np.flatnonzero(own[1:] == own[:-1])
        out[d] -= len(equal)
        lefts.append(order[equal] + a)
        rights.append(order[equal + 1] + a)
        owners.append(np.full(len(equal), d))
    if lefts:
        bad = unlike(data, starts, ends, np.concatenate(lefts), np.concatenate(rights))
        for d in np.unique(np.concatenate(owners)[bad]):
            out[d] = len({data[starts[i] : ends[i]].tobytes() for i in range(bounds[d], bounds[d + 1])})
    return out


def scan(data, offsets, tables: Tables):
    """words, distinct words, capitals, code points and symbols of documents data[offset:next offset]."""
    import numpy as np

    words = ~tables.space[data]
    before = np.empty(len(words), bool)
    before[:1], before[1:] = False, words[:-1]
    before[offsets[:-1][offsets[:-1] < len(words)]] = False  # a document's first byte has nothing before it
    first = words & ~before
    after = np.empty(len(words), bool)
    after[-1:], after[:-1] = False, words[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(first), np.flatnonzero(words & ~after) + 1
    n = per_document(first, offsets)
    bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=bounds[1:])
    return n, distinct_words(data, starts, ends, bounds, tables), *[per_document(of[data], offsets) for of in (tables.capital, tables.start, tables.symbol)]


def measured(array, tables: Tables):
    """scan() of an Arrow string array, in runs of documents of about BLOCK bytes; null counts as empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    array = pc.fill_null(array, "").cast(pa.large_string())
    _, bounds, data = array.buffers()
    offsets = np.frombuffer(bounds, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    out, at = [], 0
    while at < len(array):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        own = offsets[at : end + 1]
        out.append(scan(data[own[0] : own[-1]], own - own[0], tables))
        at = end
    return [np.concatenate(parts).astype(np.int64) for parts in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5


def masks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (all columns but the text) with mask: bits of the filters A to D that the text fails."""
    columns = [c for c in docs.columns if c != text]
    kept = docs.select(*[F.col(f"`{c}`") for c in columns])
    schema = kept.withColumn("mask", F.lit(0)).schema

    def run(batches_: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        tables = Tables()
        for batch in batches_:
            words, distinct, capitals, chars, symbols = measured(batch[text], tables)
            failed = (words < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * words, 100 * capitals > MAX_CAPITAL_PERCENT * chars, symbols > 0)
            mask = sum((f.astype(np.int32) << i for i, f in enumerate(failed)), np.zeros(len(words), np.int32))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(mask, pa.int32())], names=[*columns, "mask"])

    return docs.mapInArrow(run, schema)


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic), a row for each id that has one of the labels."""
    any_of = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    return labels.where("doc_id is not null").groupBy("doc_id").agg(any_of("quality").alias("good"), any_of("toxic").alias("toxic")).where("good = 1 or toxic = 1")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per part, mask of the five filters and labels: (part, mask, good, toxic, n)."""
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.col("text"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    # Equal rows are one row with a count; from here on nothing has a text.
    rows = masks(own).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    rows = rows.join(labelled(labels), "doc_id", "left").fillna(0, ["good", "toxic"])
    # A group's rows of its smallest id; rows of a null id are a group of their own and no copies.
    same = rows.groupBy("digest", F.col("doc_id").isNull().alias("unknown"), "part", "mask", "good", "toxic").agg(F.min("doc_id").alias("least"), F.sum("n").alias("n"), F.min_by("n", "doc_id").alias("firsts"))
    smallest = F.min("least").over(Window.partitionBy("digest"))
    kept = F.when(F.col("unknown"), F.col("n")).otherwise(F.when(F.col("least") == F.col("smallest"), F.col("firsts")).otherwise(F.lit(0)))
    both = same.withColumn("smallest", smallest).withColumn("kept", kept)
    each = F.explode(F.array(F.struct(F.col("mask"), F.col("kept").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))).alias("m")
    return both.select("part", "good", "toxic", each).groupBy("part", F.col("m.mask").alias("mask"), "good", "toxic").agg(F.sum("m.n").alias("n"))


#: A row for each order and step: order, step, the filter as a set, sets of filters before and after it.
STEPS = [
    {"filter_order": "".join(order), "step": i + 1, "f": _set([f]), "a": _set(order[:i]), "b": _set(order[: i + 1])}
    for order in permutations(FILTERS) for i, f in enumerate(order)
]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    counts = mask_counts(docs, labels)
    sets = F.explode(F.filter(F.array(*[F.lit(s) for s in range(32)]), lambda s: F.col("mask").bitwiseAND(s) == 0)).alias("s")
    left = counts.select("part", sets, "n", (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"), F.col("mask"))
    # How many documents fail none of the filters of a set; 32 sets a part.
    passed = left.groupBy("part", "s").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    table = passed.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("s", F.struct("n", "good", "toxic")))).alias("passed"))
    # One literal instead of thousands of expressions.
    steps = F.inline(F.from_json(F.lit(json.dumps(STEPS)), "array<struct<filter_order:string,step:int,f:int,a:int,b:int>>"))
    rows = table.select("part", "passed", steps)
    # A part without a document that passes a set has no entry for it.
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    at = lambda s: F.coalesce(F.try_element_at("passed", s), none)
    rows = rows.select("part", "filter_order", "step", "f", at("a").alias("before"), at("b").alias("after"), at(F.lit(0)).alias("all"), at(F.col("f")).alias("without"), at(F.lit(31)).alias("clean"), at(31 - F.col("f")).alias("only"))
    removed = F.col("before.n") - F.col("after.n")
    rows = rows.select(
        "part", "filter_order", "step", "f", F.col("after.n").alias("kept"), removed.alias("removed"), (F.col("all.n") - F.col("without.n") - removed).alias("redundant"), (F.col("only.n") - F.col("clean.n")).alias("unique_fails"),
        (F.col("before.good") - F.col("after.good")).alias("good_lost"), (F.col("before.toxic") - F.col("after.toxic")).alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "f"))).drop("f")


by_value(__name__)
