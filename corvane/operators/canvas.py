"""The map of a collection: notes in groups by top folder, groups in columns, and links as edges between sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import rules as R
from corvane.functions import text as T

# Top folder, column, order within the column, color.
CATEGORIES = [
    ("00-MOC", 0, 1, "6"),
    ("01-Rules", 1, 2, "1"),
    ("02-Fundamentals", 2, 3, "6"),
    ("03-Languages", 2, 4, "4"),
    ("04-Systems", 3, 5, "5"),
    ("05-Tools", 3, 6, "5"),
    ("06-Sources", 4, 7, "3"),
    ("07-Academics", 4, 8, "3"),
    ("08-Projects", 5, 9, "2"),
    ("09-Career", 5, 10, "2"),
    ("10-Daily", 6, 11, "6"),
    ("99-Inbox", 6, 12, "3"),
    ("11-Agents", 6, 13, "6"),
    ("Root", 0, 0, "5"),
]
# Sizes of notes and gaps in pixels.
NOTE_W, NOTE_H = 280, 110
PAD_X, PAD_TOP, PAD_BOTTOM = 30, 60, 30
GAP_X, GAP_Y = 30, 25
BASE_X, BASE_Y = -1800, -600
COLUMN = 700 + 80
GROUP_GAP = 60


def category(rel: Column) -> Column:
    """The top folder of a path if it is one of the known ones, else Root."""
    top = F.substring_index(rel, "/", 1)
    known = F.contains(rel, F.lit("/")) & top.isin([c for c, *_ in CATEGORIES if c != "Root"])
    return F.when(known, top).otherwise("Root")


def _categories(notes: DataFrame) -> DataFrame:
    table = notes.sparkSession.createDataFrame(CATEGORIES, "category string, column int, place int, color string")
    return F.broadcast(table)


def groups(notes: DataFrame) -> DataFrame:
    """(category, n, x, y, width, height, color) of the groups of notes (rel) that are not empty: at most one for each known category."""
    counts = notes.groupBy(category(F.col("rel")).alias("category")).agg(F.count("*").alias("n")).join(_categories(notes), "category")
    wide = F.when(F.col("n") >= 4, 2).otherwise(1)
    tall = F.ceil(F.col("n") / wide)
    rows = counts.select("category", "n", "column", "place", "color", (2 * PAD_X + wide * NOTE_W + (wide - 1) * GAP_X).cast("long").alias("width"), (PAD_TOP + PAD_BOTTOM + tall * NOTE_H + (tall - 1) * GAP_Y).cast("long").alias("height"))
    above = Window.partitionBy("column").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    y = BASE_Y + F.coalesce(F.sum(F.col("height") + GROUP_GAP).over(above), F.lit(0))
    return rows.select("category", "n", (BASE_X + F.col("column") * COLUMN).cast("long").alias("x"), y.cast("long").alias("y"), "width", "height", "color")


def positions(notes: DataFrame) -> DataFrame:
    """(rel, id, category, x, y, color) of every note (rel): by name in the rows of its group, two beside each other from four notes on."""
    boxes = F.broadcast(groups(notes).withColumnsRenamed({"x": "gx", "y": "gy"}))
    place = F.row_number().over(Window.partitionBy("category").orderBy("rel")) - 1
    rows = notes.select("rel", category(F.col("rel")).alias("category")).withColumn("i", place).join(boxes, "category")
    wide = F.when(F.col("n") >= 4, 2).otherwise(1)
    x = F.col("gx") + PAD_X + F.col("i") % wide * (NOTE_W + GAP_X)
    y = F.col("gy") + PAD_TOP + F.floor(F.col("i") / wide) * (NOTE_H + GAP_Y)
    return rows.select("rel", T.node_id(F.col("rel")).alias("id"), "category", x.cast("long").alias("x"), y.cast("long").alias("y"), "color")


def sides(dx: Column, dy: Column) -> Column:
    """STRUCT<from_side, to_side> of an edge by the axis along which its ends are farther apart; the horizontal one if equal."""
    pair = lambda a, b: F.struct(F.lit(a).alias("from_side"), F.lit(b).alias("to_side"))
    flat = F.abs(dx) >= F.abs(dy)
    return R.choose([(flat & (dx >= 0), pair("right", "left")), (flat, pair("left", "right")), (dy >= 0, pair("bottom", "top"))], pair("top", "bottom"))


def edges(places: DataFrame, links: DataFrame) -> DataFrame:
    """(from_id, from_side, to_id, to_side, color) of distinct links (src, dst) between placed notes."""
    end = lambda c, p: places.select(F.col("rel").alias(c), F.col("id").alias(f"{p}_id"), F.col("x").alias(f"{p}_x"), F.col("y").alias(f"{p}_y"), F.col("color").alias(f"{p}_color"))
    rows = links.select("src", "dst").where("src <> dst").distinct().join(end("src", "from"), "src").join(end("dst", "to"), "dst")
    side = sides(F.col("to_x") - F.col("from_x"), F.col("to_y") - F.col("from_y"))
    return rows.select("from_id", side["from_side"].alias("from_side"), "to_id", side["to_side"].alias("to_side"), F.col("from_color").alias("color"))


def canvas(notes: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, json) of every node and edge of the map, as its file has them; written with a text writer, not collected."""
    places = positions(notes)
    box = groups(notes).select(F.lit("group").alias("kind"), F.to_json(F.struct(F.concat(F.lit("group_"), F.replace(F.lower("category"), F.lit("-"), F.lit("_"))).alias("id"), F.lit("group").alias("type"), F.concat("category", F.lit(" ("), "n", F.lit(")")).alias("label"), "x", "y", "width", "height", "color")).alias("json"))
    note = places.select(F.lit("file").alias("kind"), F.to_json(F.struct("id", F.lit("file").alias("type"), F.col("rel").alias("file"), "x", "y", F.lit(NOTE_W).alias("width"), F.lit(NOTE_H).alias("height"), "color")).alias("json"))
    edge_id = F.concat(F.lit("edge_"), F.substring(F.md5(F.concat("from_id", F.lit(" "), "to_id")), 1, 12))
    edge = edges(places, links).select(F.lit("edge").alias("kind"), F.to_json(F.struct(edge_id.alias("id"), F.col("from_id").alias("fromNode"), F.col("from_side").alias("fromSide"), F.col("to_id").alias("toNode"), F.col("to_side").alias("toSide"), F.lit("arrow").alias("toEnd"), "color")).alias("json"))
    return box.unionByName(note).unionByName(edge)


def counts(elements: DataFrame) -> DataFrame:
    """One row (nodes, files, groups, edges) of the elements (kind) of a map."""
    of = lambda *k: F.count_if(F.col("kind").isin(*k))
    return elements.agg(of("file", "group").alias("nodes"), of("file").alias("files"), of("group").alias("groups"), of("edge").alias("edges"))
