"""Notes by inexact names, and a search that goes from source to source until one has hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import rules as R


def find_note(notes: DataFrame, name: str, suggestions: int = 10) -> DataFrame:
    """(rel, match): the note of that path, else with .md, else with that stem, else at most ten whose stem contains it.

    name may be a link with brackets and an alias. match is path, file, stem or part; only the best kind is returned.
    """
    clean = name.strip().strip("[]").split("|")[0].strip().lstrip("/\\")
    wanted = clean.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
    stem = F.lower(F.regexp_replace(F.substring_index("rel", "/", -1), "\\.[^.]*$", ""))
    match = R.choose([(F.col("rel") == clean, 0), (F.col("rel") == f"{clean}.md", 1), (stem == wanted, 2), (F.contains(stem, F.lit(wanted)), 3)])
    rows = notes.select("rel", match.alias("m")).where("m IS NOT NULL").orderBy("m", "rel").limit(suggestions)
    best = rows.withColumn("best", F.min("m").over(Window.partitionBy(F.lit(0))))  # at most ten rows
    place = F.row_number().over(Window.partitionBy("m").orderBy("rel"))
    kept = best.where("m = best").select("rel", "m", place.alias("i")).where("m = 3 OR i = 1")
    return kept.select("rel", F.element_at(F.array(*map(F.lit, ("path", "file", "stem", "part"))), F.col("m") + 1).alias("match"))


def ladder(tiers: list[tuple[str, DataFrame]], top: int = 5) -> DataFrame:
    """(tier, columns...) of the first tier that has rows; every tier is (rel, score) and gives at most ``top`` of them."""
    rows = [d.select("rel", "score").orderBy(F.desc("score"), "rel").limit(top).select(F.lit(i).alias("i"), F.lit(n).alias("tier"), "rel", "score") for i, (n, d) in enumerate(tiers)]
    all_ = reduce(DataFrame.unionByName, rows)
    first = F.min("i").over(Window.partitionBy(F.lit(0)))  # top rows for each tier
    return all_.withColumn("first", first).where("i = first").select("tier", "rel", "score")
