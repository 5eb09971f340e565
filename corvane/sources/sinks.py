"""Sinks: month-sharded audit logs, drafts with free names, and snapshots that are swapped in whole.

A table of many files cannot be replaced file by file under a lock on a cluster. Publishing writes a new snapshot
folder and then one small numbered pointer file; readers follow the last pointer, so that they see the old or the new
snapshot and a job that is lost midway leaves the old one in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.sources import shared


class StaleSnapshot(RuntimeError):
    """The published snapshot is not the one that the change was made from."""


def append_audit(events: DataFrame, path: str) -> None:
    """Append events (ts, agent, op, paths, summary) below month folders; pipes in texts are escaped."""
    safe = lambda c: F.replace(F.col(c), F.lit("|"), F.lit("\\|")).alias(c)
    rows = events.select("ts", "agent", "op", safe("paths"), safe("summary"), F.date_format("ts", "yyyy-MM").alias("month"))
    spread = F.pmod(F.xxhash64("ts", "agent", "op"), F.lit(8))  # a month with most rows is not one task's
    rows.repartition("month", spread).write.partitionBy("month").mode("append").parquet(path)


def free_names(drafts: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, rel) of drafts (id, day, slug): distinct inbox paths that no taken file (rel) has.

    The first draft (by id) of a free name keeps it. All others get numbers above every number that files or drafts of
    the same name, without its trailing number, have; so no two names can meet.
    """
    split = lambda c: (F.regexp_replace(c, "-\\d{1,9}$", ""), F.coalesce(F.regexp_extract(c, "-(\\d{1,9})$", 1).try_cast("int"), F.lit(0)))
    name = F.concat_ws("-", F.date_format("day", "yyyy-MM-dd"), "slug")
    used = taken.where(F.col("rel").startswith("99-Inbox/")).select(F.regexp_extract("rel", "^99-Inbox/(.*)\\.md$", 1).alias("name")).distinct()
    rows = drafts.select("id", name.alias("name")).join(used.withColumn("used", F.lit(True)), "name", "left")
    first = (F.row_number().over(Window.partitionBy("name").orderBy("id")) == 1) & F.col("used").isNull()
    rows = rows.select("id", "name", first.alias("keeps"), split(F.col("name"))[0].alias("base"))
    numbers = used.select("name").unionByName(rows.select("name")).select(split(F.col("name"))[0].alias("base"), split(F.col("name"))[1].alias("n")).groupBy("base").agg(F.max("n").alias("most"))
    place = F.row_number().over(Window.partitionBy("base", "keeps").orderBy("id"))
    rows = rows.join(numbers, "base").select("id", F.when(F.col("keeps"), F.col("name")).otherwise(F.concat("base", F.lit("-"), (F.col("most") + place).cast("string"))).alias("name"))
    return rows.select("id", F.concat(F.lit("99-Inbox/"), "name", F.lit(".md")).alias("rel"))


def stale_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(rel, expected, found) of changes whose precondition fails: the SHA-256 of the present content is not the expected one.

    files: (rel, content); changes: (rel, content or null to delete, expected: hex digest, null for a file that must not be there).
    """
    now = files.select("rel", F.sha2("content", 256).alias("found"))
    return changes.select("rel", "expected").join(now, "rel", "left").where(~F.col("expected").eqNullSafe(F.col("found")))


def changed(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(rel, content): files after staged changes and deletions. Nothing is written; publish() makes it current as a whole."""
    new = changes.select("rel", F.col("content").alias("new"), F.lit(True).alias("touched"))
    rows = files.select("rel", "content").join(new, "rel", "full_outer")
    return rows.select("rel", F.when(F.col("touched"), F.col("new")).otherwise(F.col("content")).alias("content")).where("content IS NOT NULL")


def commit(files: DataFrame, changes: DataFrame, root: str, expected: str | None) -> str:
    """Publish the files after the changes, all or none; refused if a precondition fails. A former snapshot is restored by point_to()."""
    refused = stale_changes(files, changes).orderBy("rel").limit(5).collect()
    if refused:
        raise StaleSnapshot(f"changed meanwhile: {', '.join(r['rel'] for r in refused)}")
    return publish(changed(files, changes), root, expected)


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return [int(n.split("-")[1]) for n in shared.names(spark, root) if n.startswith("POINTER-")]


def _pointed(spark: SparkSession, root: str, numbers: list[int]) -> str | None:
    """What the last whole pointer says; an empty one is that of a publisher that died, or is about to write it."""
    return next((name for n in reversed(numbers) if (name := shared.read_small(spark, f"{root}/POINTER-{n:09d}").strip())), None)


def current(spark: SparkSession, root: str) -> str | None:
    """The name of the published snapshot, or None before the first."""
    return _pointed(spark, root, _numbers(spark, root))


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    name = current(spark, root)
    return None if name is None else spark.read.parquet(f"{root}/{name}")


def point_to(spark: SparkSession, root: str, name: str, expected: str | None) -> None:
    """Make a written snapshot the current one; refused if the current one is not the expected one.

    Pointers are numbered and only added, so a reader always finds the last whole one. Creating the next number
    fails if another publisher has it, which decides between two of them; one that dies leaves no lock behind.
    """
    numbers = _numbers(spark, root)
    found = _pointed(spark, root, numbers)
    if found != expected:
        raise StaleSnapshot(f"expected {expected}, found {found}")
    number = numbers[-1] + 1 if numbers else 1
    if not shared.write_new(spark, f"{root}/POINTER-{number:09d}", name):
        raise StaleSnapshot(f"another publisher made pointer {number}")


def publish(rows: DataFrame, root: str, expected: str | None) -> str:
    """Write rows as a new snapshot and point to it; refused if the published one is not the expected one."""
    spark = rows.sparkSession
    if current(spark, root) != expected:
        raise StaleSnapshot(f"expected {expected}, found {current(spark, root)}")
    name = f"s-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{name}")
    point_to(spark, root, name, expected)
    return name
