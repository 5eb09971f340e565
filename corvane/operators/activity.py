"""Activity from event tables: daily and weekly counts, streaks, start-end pairs, event sizes, triage ages, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import rules as R


def by_day(events: DataFrame) -> DataFrame:
    """(day, week, n) of events (ts); week is ISO, such as 2026-W36."""
    day = F.to_date("ts")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("day")), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), F.col("day")).cast("string"), 2, "0"))
    return events.groupBy(day.alias("day")).agg(F.count("*").alias("n")).select("day", week.alias("week"), "n")


def overview(daily: DataFrame) -> DataFrame:
    """One row from (day, n): total, active days, span, the last 7 days, and the first best day."""
    last = daily.agg(F.max("day").alias("last"))
    rows = daily.join(last, F.lit(True))  # one row beside each
    return rows.agg(
        F.sum("n").alias("total"), F.count("*").alias("active_days"), (F.date_diff(F.max("day"), F.min("day")) + 1).alias("span"),
        F.coalesce(F.sum(F.when(F.date_diff("last", "day") < 7, F.col("n"))), F.lit(0)).alias("last_7"),
        F.min(F.struct((-F.col("n")).alias("k"), "day"))["day"].alias("best_day"),
    )


def streaks(days: DataFrame) -> DataFrame:
    """(key, longest, current) of distinct (key, day): runs of consecutive days, and the run that ends on the key's last day."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("day"))
    runs = days.distinct().select("key", "day", F.date_sub("day", place).alias("island")).groupBy("key", "island").agg(F.count("*").alias("n"), F.max("day").alias("end"))
    return runs.groupBy("key").agg(F.max("n").alias("longest"), F.max_by("n", "end").alias("current"))


def pair_events(events: DataFrame, start: str, end: str) -> DataFrame:
    """(key, starts, ends, open_since) of events (key, ts, id, type): open_since is the last start that no end follows."""
    order = Window.partitionBy("key").orderBy("ts", "id")
    rows = events.where(F.col("type").isin(start, end)).withColumn("next", F.lead("type").over(order))
    return rows.groupBy("key").agg(
        F.count_if(F.col("type") == start).alias("starts"), F.count_if(F.col("type") == end).alias("ends"),
        F.max(F.when((F.col("type") == start) & F.col("next").isNull(), F.col("ts"))).alias("open_since"),
    )


def block_sizes(lines: DataFrame, header: str, most: int = 4096) -> DataFrame:
    """(rel, block, bytes, oversized) of lines (rel, line_no, line): a header pattern opens a block, its lines and line feeds count."""
    order = Window.partitionBy("rel").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("block", F.sum(F.col("line").rlike(header).cast("int")).over(order)).where("block > 0")
    return rows.groupBy("rel", "block").agg(F.sum(F.octet_length("line") + 1).alias("bytes")).select("*", (F.col("bytes") > most).alias("oversized"))


def ages(drafts: DataFrame, today: F.Column) -> DataFrame:
    """(rel, age_days, tier, source) of drafts (rel, created DATE, mtime DATE); a future date counts as today."""
    days = F.greatest(F.date_diff(today, F.coalesce("created", "mtime")), F.lit(0))
    return drafts.select("rel", days.alias("age_days"), R.age_tier(days).alias("tier"), F.when(F.col("created").isNotNull(), "created").otherwise("mtime").alias("source"))


def breakdown(rows: DataFrame, column: str, default: str) -> DataFrame:
    """(value, n) over a multi-valued column; rows without values count under the default."""
    return rows.select(F.explode_outer(column).alias("v")).groupBy(F.coalesce("v", F.lit(default)).alias("value")).agg(F.count("*").alias("n"))


def route(drafts: DataFrame, routes: DataFrame, fallbacks: DataFrame, default: str) -> DataFrame:
    """(rel, target): the route of the first tag in note order that has one, else of the type, else the default.

    drafts: rel, type, tags; routes: tag, target; fallbacks: type, target.
    """
    hits = drafts.select("rel", F.posexplode("tags").alias("pos", "tag")).join(routes, "tag").groupBy("rel").agg(F.min_by("target", "pos").alias("by_tag"))
    other = fallbacks.select("type", F.col("target").alias("by_type"))
    return drafts.select("rel", "type").join(hits, "rel", "left").join(other, "type", "left").select("rel", F.coalesce("by_tag", "by_type", F.lit(default)).alias("target"))


def unclaimed_first(tasks: DataFrame) -> DataFrame:
    """(plan, next_task, percent) of tasks (plan, idx, title, status): the first open one and the share that is completed."""
    open_ = F.col("status").isin("pending", "in_progress")
    return tasks.groupBy("plan").agg(F.min(F.when(open_, F.struct("idx", "title")))["title"].alias("next_task"), F.round(100.0 * F.count_if(F.col("status") == "completed") / F.count("*"), 1).alias("percent"))
