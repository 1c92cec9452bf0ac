"""SimHash near-copies in the wide: texts whose sets of word shingles have a Jaccard similarity of MIN_JACCARD or more.

Texts with equal shingle sets are one node.  Operator 6 links the fingerprints
of these sets: distances to its references, for each choice of runs of bits,
are keys, the largest difference of distances discards, Hamming distances
verify.  Its links between two nodes each, and from every node to the first one
of its fingerprint, are proposed (see near_prints).

Two bits, operator 6's own rule, find about half of the edited copies, and no
key made of fingerprint bits holds at a radius for MIN_JACCARD.  What lies
further apart is proposed by MinHash values (BANDS groups of ROWS): a pair
shares a group's key with probability J ** ROWS, so one of exactly MIN_JACCARD
goes unseen in about 3 of a million cases and closer ones more seldom.

Pairs proposed in either way are discarded by their set sizes, which is exact,
and by more than RADIUS differing fingerprint bits (at MIN_JACCARD about 10 are
expected with a deviation of 3).  Every survivor is verified by the exact
Jaccard similarity of its shingle sets (as 64-bit hashes); the groups are the
connected components of the verified pairs.

Keys don't pair all their nodes at once.  A shingle that at most RARE nodes have
is in few pairs, which are listed and counted; the others of a node's shingles
are common ones, which any pair may share.  First, beside operator 6's pairs,
each node is compared with one head of each of its keys, the node with the least share of rare shingles, as
the origin of edited copies is.  Then, in keys that still hold several
components, nodes of different components are compared, but only where an exact
bound on what they can share allows it.  So in a crowd of edited copies those
near their origin are linked by it, those too far from it are out by their own
edits, and hardly any pairs are made.

Defined cases: null or blank text has no shingles, and all such texts are one
group; texts of fewer words than a shingle have one; repeated rows are a group;
a null document id never names a group unless the group has no other id;
deduplicate() keeps one row of each group whether ids are null, repeated or
unique; empty tables give empty results.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import batches, by_value, first_of_groups, materialize, text_bytes
from .components import components
from .simhash import distance, majority, signed

MIN_JACCARD = 0.8
SHINGLE = 5
BANDS = 24
ROWS = 4
RADIUS = 26

#: A shingle of at most so many nodes counts as shared only in the pairs that do share it.
RARE = 3

#: Shingles whose MinHash values are made at once.
CHUNK = 4096


def shingles(text: bytes | None, shingle: int = SHINGLE):
    """Sorted distinct XXH64 (seed 42) of a UTF-8 text's word shingles."""
    import numpy as np
    from xxhash import xxh64_intdigest as h

    words = (text or b"").lower().split()
    if len(words) <= shingle:
        return np.array([h(b" ".join(words), 42)] if words else [], "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-shingle]]
    return np.unique(np.array([h(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], "<u8"))


def constants(seed: int = 6):
    import numpy as np

    rng = random.Random(seed)
    return [np.array([rng.getrandbits(64) | odd for _ in range(BANDS * ROWS)], np.uint64) for odd in (0, 1)]


def min_hashes(own, masks, factors):
    """BANDS * ROWS MinHash values of a non-empty shingle set."""
    import numpy as np

    least = None
    for i in range(0, len(own), CHUNK):
        mixed = (own[i : i + CHUNK, None] ^ masks) * factors
        mixed ^= mixed >> np.uint64(32)
        part = mixed.min(0)
        least = part if least is None else np.minimum(least, part)
    return least


def _prints(shingle: int):
    def run(parts):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest as h

        masks, factors = constants()
        for part in parts:
            nodes, sizes, prints, keys = [], [], [], []
            for text in text_bytes(part.column("text")):
                own = shingles(text, shingle)
                nodes.append(h(own.tobytes(), 42))
                sizes.append(len(own))
                prints.append(signed(majority(own)))
                values = min_hashes(own, masks, factors) if len(own) else None
                keys.append(np.array([h(values[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64).tolist() if len(own) else [])
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("mark"), pa.array(np.array(nodes, np.uint64).view(np.int64), pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc", "mark", "node", "n", "fp", "keys"])

    return run


def prints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc, mark, node, n, fp, keys): one row per document row; mark is a hash of the text, node one of its shingle set."""
    batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").alias("text"))
    fields = [T.StructField("doc", rows.schema["doc"].dataType), *[T.StructField(c, T.LongType()) for c in ("mark", "node", "n", "fp")], T.StructField("keys", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(_prints(shingle), T.StructType(fields))


def _sets(shingle: int):
    def run(parts):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest as h

        for part in parts:
            own = [shingles(t, shingle) for t in text_bytes(part.column("text"))]
            nodes = np.array([h(x.tobytes(), 42) for x in own], np.uint64).view(np.int64)
            ends = np.r_[0, np.cumsum([len(x) for x in own])].astype(np.int32)
            values = pa.array(np.concatenate([*own, np.zeros(0, "<u8")]).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], names=["node", "shingles"])

    return run


def shingle_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(node, shingles) of the wanted nodes, from one text of each."""
    marks = materialize(nodes.join(wanted, "node", "left_semi").select("mark").distinct(), "marks")
    texts = docs.select(F.xxhash64(F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").alias("text")).join(marks, "mark", "left_semi").select("text")
    sets = materialize(texts.mapInArrow(_sets(shingle), "node long, shingles array<long>"), "sets")
    # Equal texts (and the rare others with an equal mark) come several times; one row of a node counts.
    return materialize(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "shingle-sets")


def _similar(parts):
    import numpy as np
    import pyarrow as pa

    for part in parts:
        close = []
        for x, y in zip(part.column("x"), part.column("y"), strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            close.append(5 * both >= 4 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(close, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes with an exact Jaccard similarity of MIN_JACCARD or more."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long")


def possible(x: str, y: str) -> Column:
    """Whether two sides' set sizes and fingerprints allow MIN_JACCARD."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (distance(F.col(f"{x}.fp"), F.col(f"{y}.fp")) <= RADIUS)


def enough(x: str, y: str, shared: Column) -> Column:
    """Whether so many shared shingles are MIN_JACCARD of two sides' sets."""
    return 5 * shared >= 4 * (F.col(f"{x}.n") + F.col(f"{y}.n") - shared)


def rare_shingles(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, rare): how many of a node's shingles at most RARE nodes have; (a, b, shared): the pairs that share some, and how many."""
    lo, hi, mid = F.col("lo"), F.col("hi"), F.col("all").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
    counted = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor("node").alias("all"))
    owners = F.when(F.col("n") == 1, F.array(lo)).when(F.col("n") == 2, F.array(lo, hi)).otherwise(F.array(lo, mid, hi))
    rare = materialize(counted.where(F.col("n") <= RARE).select("n", owners.alias("owners")), "rare-shingles")
    own = rare.select(F.explode("owners").alias("node")).groupBy("node").agg(F.count("*").alias("rare"))
    pair = lambda i, j: F.struct(F.get("owners", F.lit(i)).alias("a"), F.get("owners", F.lit(j)).alias("b"))
    pairs = rare.where("n > 1").select(F.explode(F.when(F.col("n") == 2, F.array(pair(0, 1))).otherwise(F.array(pair(0, 1), pair(0, 2), pair(1, 2)))).alias("p"))
    return own, pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))


def near_prints(nodes: DataFrame) -> DataFrame:
    """(a, b) pairs of nodes whose fingerprints operator 6 links: first nodes of two linked fingerprints, and each node with the first of its own."""
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "first-nodes")
    x, y = [first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first")) for c in "ab"]
    apart = simhash.links(first.select("fp")).join(x, "a").join(y, "b").select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b"))
    return apart.union(nodes.select("node", "fp").join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")))


def links(nodes: DataFrame, docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(a, b) verified pairs of nodes, enough for exact components of all pairs that share a key, and those of operator 6 among them."""
    near = materialize(near_prints(nodes), "near-prints")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    several = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key")
    crowd = materialize(keyed.join(several, "key"), "band-members")
    inside = crowd.select("node").union(near.select("a")).union(near.select("b")).distinct()
    sets = shingle_sets(inside, nodes, docs, text, shingle)
    rare, shared = rare_shingles(sets)
    rest = materialize(nodes.join(inside, "node", "left_semi").join(rare, "node", "left").select("node", "n", "fp", "keys", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("common")), "band-nodes")
    # The node with the least of its own is nearest to what its key's nodes have in common.
    heads = crowd.join(rest, "node").groupBy("key").agg(F.max_by("node", F.struct(F.col("common") / F.col("n"), "node")).alias("head"))
    members = materialize(crowd.join(heads, "key"), "headed-members")
    first = members.where("node <> head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).union(near).distinct()
    could = first.join(rest.alias("x"), F.col("a") == F.col("x.node")).join(rest.alias("y"), F.col("b") == F.col("y.node")).where(possible("x", "y")).select("a", "b")
    stars = materialize(verified(could, sets), "star-links")
    rooted = materialize(components(stars), "star-roots")
    placed = members.join(rooted, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    frequent = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("key", "main")
    # A node whose common shingles alone aren't enough for any partner goes no further in this way.
    mixed = materialize(placed.join(frequent, "key"), "mixed-keys").join(rest, "node").where(5 * F.col("common") >= 4 * F.col("n"))
    x, y = mixed.where("root <> main").alias("x"), mixed.alias("y")
    # Of two nodes outside the main component the smaller stands on the left.
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    # Of the keys that a pair shares only the first makes a row of it.
    here = F.element_at(F.array_intersect("x.keys", "y.keys"), 1) == F.col("x.key")
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & once & possible("x", "y") & enough("x", "y", F.least("x.common", "y.common")) & here)
    cross = cross.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    listed = shared.join(rest.alias("x"), F.col("a") == F.col("x.node")).join(rest.alias("y"), F.col("b") == F.col("y.node"))
    listed = listed.where(possible("x", "y") & enough("x", "y", F.least("x.common", "y.common") + F.col("shared"))).select("a", "b")
    return stars.union(verified(materialize(cross.union(listed).distinct().join(first, ["a", "b"], "left_anti"), "cross-pairs"), sets))


def _rooted(docs: DataFrame, key: str, text: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """One row (doc, mark, node, ...) for each document row, and (node, least, root) for each node."""
    rows = materialize(prints(docs, key, text, shingle), "prints")
    nodes = materialize(rows.groupBy("node").agg(F.min("doc").alias("least"), F.min("mark").alias("mark"), *[F.first(c).alias(c) for c in ("n", "fp", "keys")]), "nodes")
    rooted = components(links(nodes, docs, text, shingle)).select("node", "root")
    return rows, nodes.select("node", "least").join(rooted, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc and component (smallest document id of its group) for every document row."""
    rows, roots = _rooted(docs, key, text, shingle)
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component")
    return rows.select("doc", "node").join(named, "node").select("doc", "component")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each group: that with the smallest id, or the first by text hash where ids are null or repeated."""
    rows, roots = _rooted(docs, key, text, shingle)
    return first_of_groups(docs, rows.join(roots, "node").select("doc", "mark", "root"), key, text)


by_value(__name__)
