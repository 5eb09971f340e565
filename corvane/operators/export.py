"""Exports: known link targets, links to what is left out turned into plain text, pruned routes, and a lint of forbidden words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK = r"(!?\[\[)([^\]|#]+)(#[^\]|]*)?(?:\|([^\]]*))?\]\]"


def known_targets(files: DataFrame) -> DataFrame:
    """(target) of files (rel): full paths without .md and .canvas, and the names that one file alone has."""
    path = F.regexp_replace("rel", "(?i)\\.(md|canvas)$", "")
    names = files.select(F.substring_index(path, "/", -1).alias("target")).groupBy("target").count().where("count = 1").select("target")
    return files.select(path.alias("target")).where(F.contains("target", F.lit("/"))).unionByName(names).distinct()


def neutralise_links(notes: DataFrame, known: DataFrame) -> DataFrame:
    """(rel, content, n_repaired) of notes (rel, content): links whose target is not known become their display text.

    Texts are cut at their links; the pieces are put together again by position, so a note is one group and known
    targets are met by an equi-join, not by a broadcast set. A note with null content has null content and 0.
    """
    links = F.regexp_extract_all("content", F.lit(LINK), 0)
    between = F.split("content", LINK, -1)
    pieces = F.transform(between, lambda t, i: F.struct(t.alias("text"), F.get(links, i).alias("link")))
    rows = notes.select("rel", F.posexplode_outer(pieces).alias("pos", "p")).select("rel", "pos", "p.text", "p.link")
    target = F.trim(F.regexp_extract("link", LINK, 2))
    rows = rows.withColumn("target", target).withColumn("name", F.substring_index("target", "/", -1))
    once = known.select("target").distinct().withColumn("k", F.lit(True))
    plain = rows.where("link IS NULL").select("rel", "pos", F.col("text").alias("w"), F.lit(False).alias("lost"))  # these have no target to look up
    rows = rows.where("link IS NOT NULL")
    rows = rows.join(once.withColumnRenamed("k", "k1"), "target", "left").join(once.select(F.col("target").alias("name"), F.col("k").alias("k2")), "name", "left")
    shown = F.trim(F.coalesce(F.nullif(F.regexp_extract("link", LINK, 4), F.lit("")), "name"))
    lost = F.col("k1").isNull() & F.col("k2").isNull()
    put = plain.unionByName(rows.select("rel", "pos", F.concat("text", F.when(lost, shown).otherwise(F.col("link"))).alias("w"), lost.alias("lost")))
    out = put.groupBy("rel").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("x"), F.count_if("lost").alias("n_repaired"), F.count("w").alias("n"))
    return out.select("rel", F.when(F.col("n") > 0, F.array_join(F.transform("x", lambda x: x["w"]), "")).alias("content"), "n_repaired")


def prune(routes: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes (target, ...) whose target (rel of files) is exported, and the others."""
    there = files.select(F.col("rel").alias("target")).distinct()
    return routes.join(there, "target", "left_semi"), routes.join(there, "target", "left_anti")


def forbidden_tokens(patterns: DataFrame) -> DataFrame:
    """(token) of patterns (pattern) that name one file: its name and its stem."""
    base = F.substring_index("pattern", "/", -1)
    rows = patterns.where(~F.col("pattern").rlike("[*?]") & base.contains("."))
    return rows.select(F.explode(F.array(base, F.regexp_replace(base, "\\.[^.]*$", ""))).alias("token")).distinct()


def lint(lines: DataFrame, tokens: list[str]) -> DataFrame:
    """(rel, line_no, token) of lines (rel, line_no, line) that hold a forbidden token in any case; the list is a manifest's, a parameter."""
    hits = F.filter(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower("line"), F.lower(t)))
    return lines.select("rel", "line_no", F.explode(hits).alias("token")) if tokens else lines.select("rel", "line_no", F.lit("").alias("token")).limit(0)
