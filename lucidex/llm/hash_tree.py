"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

The tree has the levels region, rack and shard.  A key goes down from the
root: at every node each child draws -ln(u(key, path of the child)) / weight
with the summed weight of its shards, and the child with the least draw wins,
so it wins with the share weight(child) / sum of weights.  A key costs a draw
for each child of the nodes on its way, not one for each shard.

A draw depends on the key, the child's path and its own weight only.  When a
weight changes, the draws of the nodes above that shard change and no others:
keys move between that subtree and the rest, and below nodes whose subtree
hasn't changed no key moves.  A layout is planned for BASE shards; each later
shard stands in a region of its own at the root, so it takes keys from
everywhere into itself and no key moves between the others.  (Were it put
into an old rack, keys that came for its sake could end at its neighbours,
as levels draw independently.)

Defined cases: a null key is a key like any other; a null text has size 1 and
CRC-32 0; repeated rows share a shard and get different slots; an empty table
gives an empty result; extra columns are ignored and never clash, because
inputs are projected first.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

LEVELS = ("region", "rack", "shard")

#: Shards that the layout is planned for; later ones get a region of their own.
BASE = 8

#: Equal rows that one task numbers at a time.
RANGE = 1 << 16

#: Hex digits of the key's hash that name a numbering bucket: 4096 buckets a shard.
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Leaf:
    """One shard: its path (region, rack) and a positive weight."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def balanced(shards: int, racks: int = 2, per_rack: int = 2) -> list[Leaf]:
    """Equal leaves: per_rack shards to a rack, racks racks to a region."""
    return [Leaf(f"region{i // (racks * per_rack)}", f"rack{i // per_rack}", i) for i in range(shards)]


def sized(shards: int, base: int = BASE) -> list[Leaf]:
    """The balanced layout of base shards and each later shard in a region of its own."""
    later = range(base, shards)
    return balanced(min(shards, base)) + [Leaf(f"region-of-{i}", f"rack-of-{i}", i) for i in later]


def nodes(leaves: list[Leaf]) -> list[dict]:
    """The tree as a list of nodes, the root first: {children: [{path, weight, node}], shard}."""
    out: list[dict] = []

    def add(path: str, own: list[Leaf], depth: int) -> int:
        place = len(out)
        out.append({"children": [], "shard": own[0].shard if depth == len(LEVELS) else None})
        if depth < len(LEVELS):
            groups: dict = {}
            for leaf in own:
                groups.setdefault(getattr(leaf, LEVELS[depth]), []).append(leaf)
            for name, group in groups.items():
                below = f"{path}/{name}"
                child = add(below, group, depth + 1)
                out[place]["children"].append({"path": below, "weight": float(sum(x.weight for x in group)), "node": child})
        elif len(own) > 1:
            raise ValueError(f"two shards at {path}")
        return place

    if bad := [x.shard for x in leaves if x.weight <= 0]:
        raise ValueError(f"weight of shard {bad[0]} must be positive")
    add("", leaves, 0)
    return out


def key_text(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))


def draw(key: Column, path: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1] from 52 bits of a hash of key and path."""
    bits = F.conv(F.substring(F.md5(F.concat(key, path).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 1.0) / F.lit(float(2**52))) / weight


def descend(key: Column, leaves: list[Leaf]) -> Column:
    """The shard at the end of the key's way down, a choice among a node's children at each level."""
    tree = F.from_json(F.lit(json.dumps(nodes(leaves))), "array<struct<children:array<struct<path:string,weight:double,node:int>>,shard:int>>")
    node = F.lit(0)
    for _ in LEVELS:
        drawn = F.transform(F.get(tree, node)["children"], lambda c: F.struct(draw(key, c["path"], c["weight"]).alias("draw"), c["node"].alias("node")))
        node = F.array_min(drawn)["node"]
    return F.get(tree, node)["shard"]


def assign(df: DataFrame, key: str, leaves: list[Leaf], out: str = "shard") -> DataFrame:
    """df with the shard of each row in column out (replaced if it was there); no shuffle."""
    return df.withColumn(out, descend(key_text(F.col(key)), leaves))


def shard_table(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """Shard, slot in the shard and the shard after growth by one, per row; the layouts are those of sized().

    Slots number the rows of a shard without gaps from 0, in the order of a
    hash of key, size and checksum.  Equal rows are counted before they are
    numbered; the others are numbered inside hash buckets and shifted by the
    counts of the buckets before.  Equal rows are written out in ranges of
    RANGE that are dealt over all tasks.  So no task holds a whole shard, the
    rows of one key or a set of equal rows.
    """
    k = key_text(F.col("key"))
    rows = df.select(F.col(f"`{key}`").alias("key"), text_or_empty(text).alias("text")).select("key", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    hashed = F.md5(F.concat_ws("/", k, F.col("size").cast("string"), F.col("text_crc32").cast("string")).cast("binary"))
    distinct = rows.groupBy("key", "size", "text_crc32").agg(F.count("*").alias("n"))
    placed = distinct.select("*", hashed.alias("hash"), descend(k, sized(shards)).alias("shard"), descend(k, sized(shards + 1)).alias("grown_shard")).withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS))
    # Rows of each bucket; the bucket of a row follows from the row alone.
    counts = rows.select(descend(k, sized(shards)).alias("shard"), F.substring(hashed, 1, BUCKET_DIGITS).alias("bucket")).groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("hash", "key", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.withColumn("rank", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["shard", "bucket"]).withColumn("first", F.col("offset") + F.col("rank"))
    ranges = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RANGE))).alias("range")
    dealt = first.select("key", "size", "text_crc32", "shard", "grown_shard", "first", "n", "hash", ranges).repartition("hash", "range")
    from_, upto = F.col("first") + F.col("range") * RANGE, F.col("first") + F.least(F.col("n"), (F.col("range") + 1) * RANGE) - 1
    return dealt.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence(from_, upto)).alias("slot"), "grown_shard")
