"""Link graphs: resolution with ordered fallbacks, degrees, islands and hubs, snapshots and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve(links: DataFrame, keys: DataFrame) -> DataFrame:
    """(rel, target, found) of links (rel, target): the key with the smallest (priority, node) wins; null if none fits.

    keys: (priority, key, node). One equi-join on the key and one grouping by link.
    """
    first = keys.groupBy("key").agg(F.min(F.struct("priority", "node")).alias("best"))
    return links.join(first, F.col("target") == F.col("key"), "left").select("rel", "target", F.col("best.node").alias("found"))


def file_keys(notes: DataFrame) -> DataFrame:
    """Keys by which notes (rel) are linked: the path, the path without .md, and the stem."""
    bare = F.regexp_replace("rel", "\\.md$", "")
    options = [F.struct(F.lit(i).alias("priority"), k.alias("key")) for i, k in enumerate((F.col("rel"), bare, F.substring_index(bare, "/", -1)))]
    return notes.select(F.col("rel").alias("node"), F.explode(F.array(*options)).alias("k")).select("k.priority", "k.key", "node")


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct (src, dst) without self-loops."""
    return resolved.where("found IS NOT NULL AND found <> rel").select(F.col("rel").alias("src"), F.col("found").alias("dst")).distinct()


def broken(resolved: DataFrame) -> DataFrame:
    return resolved.where("found IS NULL").select("rel", "target")


def degrees(nodes: DataFrame, edges_: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, role) of nodes (node): island, hub (in >= 4 or out >= 6), weak (in + out <= 1) or plain."""
    sides = edges_.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges_.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    counts = sides.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    rows = nodes.join(counts, "node", "left").fillna(0, ["in_degree", "out_degree"])
    role = F.expr("CASE WHEN in_degree + out_degree = 0 THEN 'island' WHEN in_degree >= 4 OR out_degree >= 6 THEN 'hub' WHEN in_degree + out_degree <= 1 THEN 'weak' ELSE 'plain' END")
    return rows.select("node", "in_degree", "out_degree", role.alias("role"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, columns...): rows added and removed between two snapshots of equal columns; an empty first one adds all."""
    return after.subtract(before).select(F.lit("added").alias("change"), "*").unionByName(before.subtract(after).select(F.lit("removed").alias("change"), "*"))


def grid(nodes: DataFrame, columns: int = 4, width: int = 320, height: int = 120, gap: int = 40) -> DataFrame:
    """(category, node, col, row, x, y): nodes of a category in a grid, categories below one another by name."""
    place = F.row_number().over(Window.partitionBy("category").orderBy("node")) - 1
    sizes = nodes.groupBy("category").agg(F.ceil(F.count("*") / columns).alias("rows"))
    above = F.coalesce(F.sum(F.col("rows") * height + gap).over(Window.orderBy("category").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each category
    top = sizes.select("category", above.alias("top"))
    rows = nodes.select("category", "node", place.alias("i")).join(top, "category")
    col, row = F.col("i") % columns, F.floor(F.col("i") / columns)
    return rows.select("category", "node", col.cast("long").alias("col"), row.cast("long").alias("row"), (col * width).cast("long").alias("x"), (F.col("top") + row * height).cast("long").alias("y"))
