"""Full-text search on a stored inverted index.

The index has one row for each term and document, with the term's positions.
Rows lie in folders by the term's bucket, and inside them sorted by term and
document; a very common term's rows are spread over several files, because
rows are dealt by ranges of bucket, term and document.  A search names its
terms' buckets, so other folders aren't opened, and the term itself is pushed
to the Parquet scan.  Texts are tokenised once, when they are added.

Queries are terms with | (any), & (all) or <-> (one after the other) between.
The rank is that of covers: a cover is a shortest run of positions that meets
the query; it counts HIT_WEIGHT, divided by one more than the words inside it
that aren't the query's.  With | every hit is a cover of its own.
"""

from __future__ import annotations

import sys
import zlib
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let
from ..sources.tables import Tables
from .retrieval import HIT_WEIGHT, tokens

BUCKETS = 64
#: Rows of one Arrow batch that goes back to the JVM.
OUT_ROWS = 1 << 16
#: Operators of queries; only one kind in a query.
MODES = {"<->": "phrase", "&": "all", "|": "any"}


def parsed(query: str) -> tuple[str, list[str]]:
    """(mode, lower-case terms in order); spaces mean the same as |."""
    used = [op for op in MODES if op in query]
    if len(used) > 1:
        raise ValueError(f"one kind of operator in a query, not {' and '.join(used)}")
    op = used[0] if used else "|"
    parts = query.replace("|", " ").split() if op == "|" else [p.strip() for p in query.split(op)]
    if not parts or any(not p or len(p.split()) > 1 for p in parts):
        raise ValueError(f"a term is missing, or two have no operator between: {query!r}")
    terms = [p.lower() for p in parts]
    return MODES[op], terms if op == "<->" else list(dict.fromkeys(terms))


def bucket_of(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _inverted(parts):
    """Of batches (doc, words) the rows (term, doc, positions), sorted by term in each."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for part in parts:
        doc, words = part.column("doc"), part.column("words")
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = words.flatten().dictionary_encode()
        owner = np.repeat(np.arange(len(doc)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        row = found.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(doc)) + owner
        order = np.argsort(row, kind="stable")
        first = np.flatnonzero(np.diff(row[order], prepend=-1))
        heads, ends = order[first], np.append(first, len(order))
        positions = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place[order].astype(np.int32)))
        terms = found.dictionary.take(found.indices.take(pa.array(heads)))
        out = pa.RecordBatch.from_arrays([terms, doc.take(pa.array(owner[heads])), positions], names=["term", "doc", "positions"])
        yield from (out.slice(i, OUT_ROWS) for i in range(0, len(out), OUT_ROWS))


def postings(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc, positions) of texts; positions from 1.

    A text's words are grouped in its row, so nothing is shuffled here; only
    where keys repeat are the rows of one key and term put together.
    """
    own = texts.select(F.col(f"`{key}`").alias("doc"), tokens(F.col(f"`{text}`")).alias("words"))
    fields = [T.StructField("term", T.StringType()), T.StructField("doc", own.schema["doc"].dataType), T.StructField("positions", T.ArrayType(T.IntegerType()))]
    rows = own.mapInArrow(_inverted, T.StructType(fields))
    if not texts.groupBy(F.col(f"`{key}`")).count().where("count > 1").take(1):
        return rows
    return rows.groupBy("term", "doc").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


class Index:
    """Postings and the list of indexed documents under one commit marker."""

    def __init__(self, spark: SparkSession, path: str):
        self.tables = Tables(spark, path)

    def add(self, texts: DataFrame, key: str = "doc_id", text: str = "text", notes: dict | None = None, replace: bool = False) -> None:
        """Index the documents that the index doesn't hold (all, with replace, in place of what it held); keys must be unique."""
        state = self.tables.state()
        known = None if replace else self.tables.read("documents", state)
        own = texts.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))
        if known is not None:
            own = own.join(known, "doc", "left_anti")
        after = {} if replace else state["tables"]
        bucket = (F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int")
        # What follows from a row is added behind the shuffle.
        dealt = postings(own, "doc").repartitionByRange(bucket, "term", "doc").select(bucket.alias("bucket"), "term", "doc", F.size("positions").alias("n"), "positions")
        rows = dealt.sortWithinPartitions("bucket", "term", "doc")
        entries = {"postings": self.tables.write("postings", rows, ("bucket",), after.get("postings")), "documents": self.tables.write("documents", own.select("doc"), (), after.get("documents"))}
        self.tables.commit(state, entries, notes)

    def fresh(self, texts: DataFrame, signature: str, key: str = "doc_id", text: str = "text") -> Index:
        """Build the index unless it was built from the source with this signature."""
        if self.tables.state()["notes"].get("signature") != signature:
            self.add(texts, key, text, {"signature": signature}, replace=True)
        return self

    def of_terms(self, terms: list[str]) -> DataFrame:
        """The postings of the terms, from their buckets only."""
        wanted = sorted(set(terms))
        return self.tables.read("postings").where(F.col("bucket").isin(sorted({bucket_of(t) for t in wanted})) & F.col("term").isin(wanted))

    def search(self, query: str) -> DataFrame:
        """(doc, similarity) of the documents that meet the query."""
        mode, terms = parsed(query)
        found = self.of_terms(terms)
        if mode == "any":
            return found.groupBy("doc").agg(F.round(HIT_WEIGHT * F.sum("n"), 6).alias("similarity"))
        wanted = sorted(set(terms))
        number = F.array_position(F.array(*[F.lit(t) for t in wanted]), F.col("term")) - 1
        held = found.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(number.alias("term"), "positions"))).alias("lists")).where(F.size("lists") == len(wanted))
        lists = F.col("lists")
        score = phrase_rank(lists, [wanted.index(t) for t in terms]) if mode == "phrase" else cover_rank(lists, len(wanted))
        return held.select("doc", F.round(score, 6).alias("similarity")).where("similarity > 0")

    def top(self, query: str, n: int = 5) -> DataFrame:
        return self.search(query).orderBy(F.desc("similarity"), "doc").limit(n)


def phrase_rank(lists: Column, order: list[int]) -> Column:
    """HIT_WEIGHT for each place where the terms stand one after the other."""
    moved = lambda term, by: F.transform(lists[term]["positions"], lambda p: p - by)
    return HIT_WEIGHT * F.size(reduce(F.array_intersect, [moved(term, step) for step, term in enumerate(order)]))


def cover_rank(lists: Column, n: int) -> Column:
    """Sum over shortest runs that hold all n terms, in one sweep over the joint sorted positions.

    The sweep keeps each term's last place; the least of these starts the
    shortest run that ends here, which is new if it starts later than the one
    before.
    """
    hits = F.sort_array(F.flatten(F.transform(lists, lambda x: F.transform(x["positions"], lambda p: F.struct(p.alias("pos"), x["term"].cast("int").alias("term"))))))
    place = lambda i, p: F.struct(i.alias("i"), p.alias("pos"))
    start = F.struct(F.array_repeat(place(F.lit(-1), F.lit(0)), n).alias("last"), F.lit(0).alias("i"), F.lit(-1).alias("begin"), F.lit(0.0).alias("score"))

    def step(s: Column, hit: Column) -> Column:
        last = F.transform(s["last"], lambda x, k: F.when(k == hit["term"], place(s["i"], hit["pos"])).otherwise(x))

        def judged(now: Column) -> Column:
            first = F.array_min(now)
            new = (first["i"] >= 0) & (first["i"] > s["begin"])
            others = (hit["pos"] - first["pos"]) - (s["i"] - first["i"])
            return F.struct(now.alias("last"), (s["i"] + 1).alias("i"), F.when(new, first["i"]).otherwise(s["begin"]).alias("begin"), F.when(new, s["score"] + HIT_WEIGHT / (others + 1)).otherwise(s["score"]).alias("score"))

        return let(last, judged)

    return F.aggregate(hits, start, step, lambda s: s["score"])


# Functions travel inside the tasks, so workers need not import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
