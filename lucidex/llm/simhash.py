"""SimHash near-duplicates through pivot distance tables.

Fingerprints: 64 bits over the XXH64 (seed 42) of word shingles.  The pivot
table holds each distinct fingerprint's Hamming distances to REFERENCES seeded
reference fingerprints, one for each of SEGMENTS runs of bits; a reference's
whole distance is the sum over the runs.  Two fingerprints within LINK bits
differ in at most LINK runs, so in EQUAL = SEGMENTS - LINK runs their distances
to every reference agree: the distances of each choice of EQUAL runs are a join
key.  Of the pairs that share a key, those whose largest difference of whole
distances exceeds LINK are discarded (triangle inequality), and the survivors
are verified by their own Hamming distance.  A key covers about 38 bits, so
chance pairs stay fewer than fingerprints up to some ten billions of them.

A key shared by more than CROWD fingerprints is a dense crowd of nearly equal
ones and isn't joined with itself.  Its fingerprints are linked exactly through
the fingerprints one bit away: two fingerprints within two bits share one of
these (or one is among the other's), and all that share one are within two
bits, so a star to the smallest keeps the components.  This takes at most 65
rows a fingerprint.

Defined cases: null or blank text has fingerprint zero and is linked like any
other; equal texts collapse to one fingerprint before any pairing; repeated
rows are a group; a null document id never names a group unless the group has
no other id; deduplicate() keeps one row of each group, whether ids are null,
repeated or unique; empty tables give empty results; extra columns are ignored
by groups() and kept by deduplicate().
"""

from __future__ import annotations

import itertools
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, by_value, first_of_groups, materialize, text_bytes
from .components import components

SHINGLE = 3
LINK = 2
BITS = 64

#: Seeded reference fingerprints, and the runs of bits whose distances are held apart.
REFERENCES = 24
SEGMENTS = 5
EQUAL = SEGMENTS - LINK

#: A key with more fingerprints than this is linked through one-bit neighbours instead of pairs.
CROWD = 64


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one UTF-8 text, unsigned."""
    import numpy as np
    from xxhash import xxh64_intdigest as h

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([h(b" ".join(words), 42)], dtype="<u8")
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.r_[0, ends[:-shingle]]
        hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
    return majority(hashes)


def majority(hashes) -> int:
    """The bits that are set in over half of the hashes, unsigned."""
    import numpy as np

    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(parts):
        import pyarrow as pa

        for part in parts:
            prints = [fingerprint(t, shingle) for t in text_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("mark"), pa.array([signed(x) for x in prints], pa.int64())], names=["doc", "mark", "fp"])

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc, mark, fp): one row per document row; narrow, mark is a hash of the text."""
    batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), T.StructType([T.StructField("doc", rows.schema["doc"].dataType), T.StructField("mark", T.LongType()), T.StructField("fp", T.LongType())]))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segments() -> list[int]:
    """SEGMENTS masks that together cover all bits once."""
    cuts = [BITS * i // SEGMENTS for i in range(SEGMENTS + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def references(n: int = REFERENCES, seed: int = 6) -> list[int]:
    rng = random.Random(seed)
    return [rng.getrandbits(64) for _ in range(n)]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(prints: DataFrame) -> DataFrame:
    """fp with its distances to all references: parts has them for each run of bits, whole their sums."""
    apart = lambda p, mask: F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p))).bitwiseAND(F.lit(signed(mask)))).cast("byte")
    parts = F.array(*[F.array(*[apart(p, mask) for p in references()]) for mask in segments()])
    whole = F.array(*[distance(F.col("fp"), F.lit(signed(p))).cast("byte") for p in references()])
    return prints.select("fp", parts.alias("parts"), whole.alias("whole"))


def keyed_table(prints: DataFrame) -> DataFrame:
    """(fp, key, whole): one row for each fingerprint and choice of EQUAL runs, with their distances as the key."""
    keys = [F.xxhash64(F.lit(number), *[F.element_at("parts", i + 1) for i in own]) for number, own in enumerate(itertools.combinations(range(SEGMENTS), EQUAL))]
    return pivot_table(prints).select("fp", F.explode(F.array(*keys)).alias("key"), "whole")


def furthest(a: str, b: str) -> Column:
    """Largest difference of two sides' distances to one reference."""
    return F.greatest(*[F.abs(F.element_at(f"{a}.whole", i) - F.element_at(f"{b}.whole", i)) for i in range(1, REFERENCES + 1)])


def candidates(keyed: DataFrame) -> DataFrame:
    """Pairs (a.*, b.*) of different fingerprints that share a key."""
    a, b = keyed.alias("a"), keyed.alias("b")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))


def discarded(prints: DataFrame, link: int = LINK) -> DataFrame:
    """One row: pairs that share a key, those the references' distances leave, and those within link bits."""
    pairs = candidates(keyed_table(prints)).select(furthest("a", "b").alias("far"), distance(F.col("a.fp"), F.col("b.fp")).alias("apart"))
    return pairs.agg(F.count("*").alias("sharing"), F.count_if(F.col("far") <= link).alias("left"), F.count_if(F.col("apart") <= link).alias("linked"))


def links(prints: DataFrame, link: int = LINK) -> DataFrame:
    """(a, b) linked pairs or stars over distinct fp, enough for exact components."""
    if link != LINK:
        raise ValueError("the choices of runs and the neighbour rows are built for two bits")
    keyed = keyed_table(prints)
    sizes = keyed.groupBy("key").count().where("count > 1")
    keyed = materialize(keyed.join(sizes, "key"), "pivot-keys")
    near = candidates(keyed.where(F.col("count") <= CROWD)).where((furthest("a", "b") <= link) & (distance(F.col("a.fp"), F.col("b.fp")) <= link))
    crowd = keyed.where(F.col("count") > CROWD).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(BITS)])
    around = crowd.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("middle"))
    stars = around.join(around.groupBy("middle").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1"), "middle").where("fp <> least")
    return near.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).union(stars.select(F.col("least").alias("a"), F.col("fp").alias("b"))).distinct()


def _rooted(docs: DataFrame, key: str, text: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """One row (doc, mark, fp) for each document row, and (fp, least, root) for each fingerprint."""
    prints = materialize(fingerprints(docs, key, text, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc").alias("least")), "distinct-fingerprints")
    rooted = components(links(distinct.select("fp"))).select(F.col("node").alias("fp"), "root")
    return prints, distinct.join(rooted, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc, fp and component (smallest document id of its group) for every document row."""
    prints, roots = _rooted(docs, key, text, shingle)
    least = roots.groupBy("root").agg(F.min("least").alias("component"))
    return prints.select("doc", "fp").join(roots.join(least, "root").select("fp", "component"), "fp").select("doc", "fp", "component")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each group: that with the smallest id, or the first by text hash where ids are null or repeated."""
    prints, roots = _rooted(docs, key, text, shingle)
    return first_of_groups(docs, prints.join(roots, "fp").select("doc", "mark", "root"), key, text)


by_value(__name__)
