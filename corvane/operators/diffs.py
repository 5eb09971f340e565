"""What a version control system prints: added lines of unified diffs with their numbers, and NUL-separated lists of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import checks

# Where an address in a text ends, and marks that do not belong to its end.
URL = "(?i)https?://[^\\s\"'`<>{}\\\\^|()\\[\\]]+"
TRAILING = "[.,;:!?]+$"


def tracked_files(listed: DataFrame) -> DataFrame:
    """(rel) of NUL-separated lists of files (raw); blank names are none."""
    return listed.select(F.explode(F.split("raw", "\\x00")).alias("rel")).where("trim(rel) <> ''")


def hunks(diffs: DataFrame) -> DataFrame:
    """(id, path, start, lines) of unified diffs (id, raw): each hunk with the number of its first new line and its lines as printed.

    A line of a hunk begins with a blank, plus, minus or backslash, so headers of files and hunks cannot be taken for content. path is that of
    the new file, without its ``b/``; deleted files have no hunk. Null and empty diffs have none.
    """
    files = diffs.select("id", F.explode(F.split("raw", "(?m)^(?=diff --git )")).alias("file"))
    head = F.substring_index("file", "\n@@ -", 1)
    path = F.regexp_replace(F.regexp_extract(head, "(?m)^\\+\\+\\+ (\"?)(?:b/)?([^\\t\\r\\n]*?)\\1(?:\\t[^\\n]*)?\\r?$", 2), "^/dev/null$", "")
    rows = files.select("id", path.alias("path"), F.explode(F.split("file", "(?m)^(?=@@ -)")).alias("hunk")).where("path <> '' AND hunk LIKE '@@ -%'")
    start = F.regexp_extract("hunk", "^@@ -\\d+(?:,\\d+)? \\+(\\d+)", 1).try_cast("int")
    return rows.select("id", "path", start.alias("start"), F.slice(F.split("hunk", "\\r?\\n"), F.lit(2), F.size(F.split("hunk", "\n"))).alias("lines")).where("start IS NOT NULL")


def added_lines(diffs: DataFrame) -> DataFrame:
    """(id, path, line_no, line) of unified diffs (id, raw): the lines that they add, with their numbers in the new file.

    The number of a line is the hunk's start and the count of new-side lines, added or kept, before it; its place among those is that count.
    """
    side = F.filter("lines", lambda x: F.startswith(x, F.lit("+")) | F.startswith(x, F.lit(" ")))
    rows = hunks(diffs).select("id", "path", "start", F.posexplode(side).alias("i", "line")).where("line LIKE '+%'")
    return rows.select("id", "path", (F.col("start") + F.col("i")).cast("int").alias("line_no"), F.substring(F.col("line"), F.lit(2), F.length("line")).alias("line"))


def urls(lines: DataFrame) -> DataFrame:
    """The addresses in rows with a line, one row for each, as url beside the other columns."""
    found: Column = F.transform(F.regexp_extract_all("line", F.lit(f"({URL})"), 1), lambda u: F.regexp_replace(u, TRAILING, ""))
    return lines.select(*[c for c in lines.columns if c != "line"], F.explode(F.array_distinct(found)).alias("url"))


def suspicious_additions(diffs: DataFrame) -> DataFrame:
    """(id, path, line_no, url, param, reason): suspicious addresses in the lines that diffs (id, raw) add; what they keep or take away does not count."""
    rows = urls(added_lines(diffs)).select(F.struct("id", "path", "line_no").alias("id"), "url")
    return checks.suspicious_urls(rows).select("id.*", "url", "param", "reason").distinct()
