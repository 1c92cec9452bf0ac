"""Document fingerprints by Merkle trees over sections and paragraphs (DataFrame functions only).

A text is cut without loss: sections at blank lines ("\\n\\n"), paragraphs at
line feeds, and each paragraph into leaves, runs of at most LEAF_WORDS words
inside a sentence, so that an edit of a one-paragraph text is located too.  A
leaf's hash is made of its characters, an inner node's of its children's
hashes, each with a mark of its level.  The root is the document's
fingerprint: texts are equal where roots are, and from two differing roots the
differing branches lead to the edit.

The likeness of two trees is the weight of the nodes that both have (as often
as both have them) over the mean weight of the two.  A leaf weighs its code
points, an inner node one.  So it is 1 for equal roots only, and paragraphs
that were moved still count.  Nodes of both trees are sorted together in the
row and paired in one pass.

neighbours() finds each document's next one in an order of all ids: distinct
ids are dealt by range and written once; inside a range the next is the row
after, and the end of a range goes on with the first id of the following one.
The texts are exchanged once by id, and once more to their requester.

Defined cases: null text counts as empty (a tree of one section and one empty
paragraph); null ids come last in the order and are one id; rows that share an
id have the same next document, and the least of their texts is the next of
others; with one id only the next document is the document itself; repeated
rows give a row each; empty tables give no rows; extra columns are ignored,
because inputs are projected first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import materialize, repeated_ids

SECTION, PARAGRAPH = "\n\n", "\n"
LEAF_WORDS = 8
#: A run of words with the stops and blanks behind it, or stops or blanks alone.
LEAF = r"(?:[^ .!?]+ *){1,%d}[.!?]* *|[.!?]+ *| +" % LEAF_WORDS
#: Hex digits of a node's hash; the root has all 64.
DIGITS = 32


def _hash(level: str, content: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(level), content), 256), 1, DIGITS)


def _over(children: Column) -> Column:
    return F.array_join(F.transform(children, lambda c: c["hash"]), "")


def leaves(paragraph: Column) -> Column:
    """array<struct<hash, size>> of a paragraph, size in code points."""
    return F.transform(F.regexp_extract_all(paragraph, F.lit(LEAF), F.lit(0)), lambda p: F.struct(_hash("l", p).alias("hash"), F.length(p).alias("size")))


def paragraphs(section: Column) -> Column:
    """array<struct<hash, leaves>> of a section."""
    return F.transform(F.split(section, PARAGRAPH), lambda p: let(leaves(p), lambda x: F.struct(_hash("p", _over(x)).alias("hash"), x.alias("leaves"))))


def sections(text: Column) -> Column:
    """array<struct<hash, paragraphs>> of a text."""
    return F.transform(F.split(text, SECTION), lambda s: let(paragraphs(s), lambda x: F.struct(_hash("s", _over(x)).alias("hash"), x.alias("paragraphs"))))


def tree(text: Column) -> Column:
    """struct<root, sections>: the whole Merkle tree of a text; null counts as empty."""
    return let(sections(F.coalesce(text, F.lit(""))), lambda x: F.struct(F.sha2(F.concat(F.lit("d"), _over(x)), 256).alias("root"), x.alias("sections")))


def nodes(of: Column) -> Column:
    """All nodes of a tree as array<struct<hash, size>>; inner ones have size 1."""
    inner = lambda x: F.array(F.struct(x.alias("hash"), F.lit(1).alias("size")))
    of_section = lambda s: F.concat(inner(s["hash"]), F.flatten(F.transform(s["paragraphs"], lambda p: F.concat(inner(p["hash"]), p["leaves"]))))
    return F.concat(inner(of["root"]), F.flatten(F.transform(of["sections"], of_section)))


def likeness(a: Column, b: Column) -> Column:
    """Weight of the nodes in both lists over the mean of the lists' weights, 0 to 1.

    In the joint sorted list nodes of a stand before equal ones of b; each of b
    uses one of those of a that are still open.
    """
    side = lambda own, n: F.transform(own, lambda x: F.struct(x["hash"].alias("hash"), F.lit(n).alias("side"), x["size"].alias("size")))
    weight = lambda own: F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + x["size"])
    start = F.struct(F.lit("").alias("hash"), F.lit(0).alias("open"), F.lit(0).cast("long").alias("common"))

    def step(s: Column, x: Column) -> Column:
        known = x["hash"] == s["hash"]
        opened = F.struct(x["hash"].alias("hash"), F.when(known, s["open"] + 1).otherwise(1).alias("open"), s["common"].alias("common"))
        used = F.struct(s["hash"].alias("hash"), (s["open"] - 1).alias("open"), (s["common"] + x["size"]).alias("common"))
        return F.when(x["side"] == 0, opened).when(known & (s["open"] > 0), used).otherwise(s)

    common = F.aggregate(F.sort_array(F.concat(side(a, 0), side(b, 1))), start, step, lambda s: s["common"])
    return common * 2.0 / (weight(a) + weight(b))


def first_change(a: Column, b: Column) -> Column:
    """struct<section, paragraph> (from 0) of the first branch that differs, followed down from the roots; null where they are equal."""

    def differing(own: Column, other: Column) -> Column:
        flags = F.transform(own, lambda x, i: F.when(F.coalesce(F.get(other, i)["hash"], F.lit("")) != x["hash"], 1).otherwise(0))
        at = F.array_position(flags, F.lit(1)) - 1
        return F.when(at >= 0, at).otherwise(F.size(own).cast("long"))  # the other list goes on

    def of_section(s: Column) -> Column:
        of = lambda t: F.coalesce(F.get(t["sections"], s.cast("int"))["paragraphs"], F.slice(a["sections"][0]["paragraphs"], 1, 0))
        return F.struct(s.alias("section"), differing(of(a), of(b)).alias("paragraph"))

    return F.when(a["root"] != b["root"], let(differing(a["sections"], b["sections"]), of_section))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the root of each text's tree."""
    return docs.withColumn(out, tree(F.col(f"`{text}`"))["root"])


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc, next): of each distinct doc_id the next smaller one, the largest after the smallest, nulls last."""
    order = F.col("doc").desc_nulls_last()
    ranged = materialize(ids.distinct().repartitionByRange(order).select("doc", F.spark_partition_id().alias("part")), "merkle-ids")
    inside = Window.partitionBy("part").orderBy(order)
    # A struct is never null, so a null id is an id and the end of a range is none.
    rows = ranged.select("part", "doc", F.lead(F.struct("doc")).over(inside).alias("inner"))
    firsts = ranged.groupBy("part").agg(F.min_by(F.struct("doc"), F.struct(F.col("doc").isNull(), -F.col("doc"))).alias("first"))
    # As many rows as ranges.
    over = Window.orderBy("part")
    all_parts = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = firsts.select("part", F.coalesce(F.lead("first").over(over), F.first("first").over(all_parts)).alias("follow"))
    return rows.join(follows, "part").select("doc", F.coalesce("inner", "follow")["doc"].alias("next"))


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text, next_text) per row of docs, null texts as empty ones."""
    own = docs.select(F.col(f"`{key}`").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    wanted = next_ids(own.select("doc")).withColumnsRenamed({"doc": "asks", "next": "wants"})
    there = own.groupBy("doc").agg(F.min("text").alias("text")) if repeated_ids(docs, key) else own
    brought = there.join(wanted, F.col("doc").eqNullSafe(F.col("wants"))).select("asks", F.col("text").alias("next_text"))
    return own.join(brought, F.col("doc").eqNullSafe(F.col("asks"))).select("doc", "text", "next_text")


def edit_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text (see the contract), their likeness and the first change."""
    rows = neighbours(docs, key, text)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    rows = rows.select("doc", "text", "next_text", F.when(half > 0, edited).otherwise(F.col("text")).alias("edited"))
    trees = rows.select("doc", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("a"), tree(F.col("edited")).alias("b"), tree(F.col("next_text")).alias("c"))
    lists = trees.select("doc", "n_chars", "edited_sha256", F.col("a.root").alias("fingerprint"), F.col("b.root").alias("edited_fingerprint"), first_change(F.col("a"), F.col("b")).alias("change"), *[nodes(F.col(x)).alias(x) for x in "abc"])
    return lists.select(F.col("doc").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"), F.col("change.section").alias("changed_section"), F.col("change.paragraph").alias("changed_paragraph"))
