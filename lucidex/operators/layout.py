"""Layout geometry: boxes, reading order, picture regions, ghost blocks, section paths."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shares that decide about text inside pictures and about agreement with page words.
PICTURE_OVERLAP, PICTURE_SHARE, TOKEN_SHARE, SMALL_BOX = 0.6, 0.5, 0.2, 0.0015


def rect(l: Column, t: Column, r: Column, b: Column, origin: Column, page_height: Column) -> Column:
    """Top-left rectangle of a box given from either origin."""
    below = F.upper(F.coalesce(origin, F.lit("BOTTOMLEFT"))) == "BOTTOMLEFT"
    top = F.when(below, page_height - F.greatest(t, b)).otherwise(F.least(t, b))
    bottom = F.when(below, page_height - F.least(t, b)).otherwise(F.greatest(t, b))
    return F.struct(F.least(l, r).alias("x0"), top.alias("y0"), F.greatest(l, r).alias("x1"), bottom.alias("y1"))


def area(q: Column) -> Column:
    return F.greatest(q["x1"] - q["x0"], F.lit(0.0)) * F.greatest(q["y1"] - q["y0"], F.lit(0.0))


def overlap_ratio(inner: Column, outer: Column) -> Column:
    """Area of the intersection over the inner area, 0 for an empty box."""
    w = F.least(inner["x1"], outer["x1"]) - F.greatest(inner["x0"], outer["x0"])
    h = F.least(inner["y1"], outer["y1"]) - F.greatest(inner["y0"], outer["y0"])
    return F.when((area(inner) > 0) & (area(outer) > 0) & (w > 0) & (h > 0), w * h / area(inner)).otherwise(0.0)


def inside_pictures(boxes: DataFrame, pictures: DataFrame) -> DataFrame:
    """boxes (box_id, page, label, q) with inside: a picture of their page covers most of them; captions never."""
    hit = boxes.alias("b").join(pictures.alias("p"), (F.col("b.page") == F.col("p.page")) & (overlap_ratio(F.col("b.q"), F.col("p.q")) >= PICTURE_OVERLAP), "left_semi").select(F.col("box_id").alias("_hit")).distinct()
    return boxes.join(hit, F.col("box_id") == F.col("_hit"), "left").withColumn("inside", F.col("_hit").isNotNull() & (F.col("label") != "caption")).drop("_hit")


def words_inside(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """(box_id, tokens): distinct tokens of page words whose middle lies in the box."""
    x, y = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.y0") + F.col("w.y1")) / 2
    q = F.col("b.q")
    held = boxes.alias("b").join(words.alias("w"), (F.col("b.page") == F.col("w.page")) & x.between(q["x0"], q["x1"]) & y.between(q["y0"], q["y1"]))
    return held.groupBy("b.box_id").agg(F.array_sort(F.collect_set("w.word")).alias("tokens"))


def agrees(own: Column, page: Column) -> Column:
    """At least one shared token and a fifth of the block's own."""
    shared = F.size(F.array_intersect(own, page))
    return F.coalesce((shared >= 1) & (shared >= TOKEN_SHARE * F.size(own)), F.lit(False))


def block_decisions(provs: DataFrame) -> DataFrame:
    """keep per block from provs (block_id, n, label, inside, supports, area_ratio), n in reading order.

    Boxes count up to the first that supports the block; a block mostly inside
    pictures goes even so, unless it is a caption.
    """
    before = Window.partitionBy("block_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    seen = provs.withColumn("stop", F.coalesce(F.max(F.col("supports").cast("int")).over(before), F.lit(0))).where("stop = 0")
    agg = seen.groupBy("block_id").agg(F.max("label").alias("label"), F.bool_or("supports").alias("supported"), F.avg(F.col("inside").cast("double")).alias("picture_share"), F.max("area_ratio").alias("max_area"))
    return agg.select("block_id", (F.col("supported") & ~((F.col("label") != "caption") & (F.col("picture_share") >= PICTURE_SHARE))).alias("keep"), "picture_share", "max_area", (F.col("max_area") <= SMALL_BOX).alias("is_small"))


def reading_order(blocks: DataFrame, *by: str) -> DataFrame:
    """order of blocks in bands of 20 units from the top, then from the left."""
    order = Window.partitionBy(*by).orderBy(F.bround(F.col("y0") / 20), "x0", "block_id")
    return blocks.withColumn("position", F.row_number().over(order))


def flatten_elements(layout: DataFrame) -> DataFrame:
    """One row per element and place from (doc_id, kind, elements array<struct<text,label,prov array<struct<page_no,l,t,r,b>>>>)."""
    each = layout.select("doc_id", "kind", F.posexplode("elements").alias("n", "e")).select("doc_id", "kind", "n", F.col("e.text").alias("text"), F.lower(F.coalesce("e.label", F.lit("text"))).alias("label"), F.explode("e.prov").alias("p"))
    return each.where("p.page_no is not null and p.l is not null").select("doc_id", "kind", "n", "text", "label", "p.*")


SECTION_PATHS = """
WITH RECURSIVE up(id, parent, depth, path, seen) AS (
  SELECT id, parent, 0, title, array(id) FROM {t}
  UNION ALL
  SELECT u.id, t.parent, u.depth + 1, concat(t.title, ' / ', u.path), array_append(u.seen, t.id) FROM up u JOIN {t} t ON u.parent = t.id WHERE NOT array_contains(u.seen, t.id)
)
SELECT id, max_by(path, depth) AS path, max(depth) AS depth FROM up GROUP BY id
"""


def section_paths(tree: DataFrame) -> DataFrame:
    """(id, path, depth) from a tree (id, parent, title): titles from the root down; a circle ends where it began."""
    name = f"lucidex_sections_{uuid.uuid4().hex}"
    tree.createOrReplaceTempView(name)
    try:
        return tree.sparkSession.sql(SECTION_PATHS.format(t=name))
    finally:
        tree.sparkSession.catalog.dropTempView(name)
