"""Report tables: recent sources, a timeline, conflicts, open questions, insights, and one page of text from a bounded table.

The row limits are part of the reports; each is an ordered top-k, never a collected group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T


def recent_sources(rollup: DataFrame, limit: int = 20) -> DataFrame:
    """The first sources of a roll-up (source, note_count, max_authority, reviewed_count, dirs) by name."""
    return rollup.orderBy("source").limit(limit)


def timeline(daily: DataFrame, log_lines: DataFrame, limit: int = 30) -> DataFrame:
    """(date, entry), newest first, of daily notes (rel, content) and review lines (rel, line_no, line); undated ones are left out."""
    stem = F.regexp_replace(F.substring_index("rel", "/", -1), "\\.[^.]*$", "")
    days = daily.select(T.first_date(F.substring_index("rel", "/", -1), F.col("content")).alias("date"), F.concat(F.lit("daily: "), stem).alias("entry"))
    seen = log_lines.select(T.first_date(F.col("line")).alias("date"), F.concat(F.lit("review: "), T.redact_urls(F.trim("line"))).alias("entry"))
    return days.unionByName(seen).where("date IS NOT NULL").orderBy(F.desc("date"), "entry").limit(limit)


def listed_conflicts(candidates: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """The candidates with at least that score, and one row with the number of the others."""
    return candidates.where(F.col("score") >= least), candidates.agg(F.count_if(F.col("score") < least).alias("folded"))


def open_questions(lines: DataFrame, limit: int = 50) -> DataFrame:
    """(rel, line_no, question), in order of place, of lines (rel, line_no, line, in_fence, in_fields) outside code and fields
    that have a question mark or a to-do mark; addresses are hidden."""
    rows = lines.where(~F.col("in_fence") & ~F.col("in_fields") & F.col("line").rlike("TODO|待定|\\?"))
    rows = rows.select("rel", "line_no", T.redact_urls(F.trim("line")).alias("question"))
    return rows.orderBy("rel", "line_no").limit(limit)


def corrections(rows: DataFrame) -> DataFrame:
    """(category, n, open) of corrections (date, category, status); a status other than closed is open."""
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if(~F.lower(F.coalesce("status", F.lit("open"))).isin("closed", "done", "distilled")).alias("open"))


def page(rows: DataFrame, title: str, columns: list[str], order: list[str], limit: int = 200) -> DataFrame:
    """One row (title, content): a Markdown table of the first rows by an order; at most ``limit`` rows are gathered."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    first = rows.orderBy(*order).limit(limit)
    packed = first.select(F.struct(*order).alias("k"), line.alias("l")).agg(F.array_sort(F.collect_list(F.struct("k", "l"))).alias("x"))
    head = f"# {title}\n\n| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    body = F.array_join(F.transform("x", lambda x: x["l"]), "\n")
    return packed.select(F.lit(title).alias("title"), F.when(F.size("x") == 0, f"# {title}\n\n(none)\n").otherwise(F.concat(F.lit(head), body, F.lit("\n"))).alias("content"))
