"""Comments in source code that are worth a note: workarounds, annotations, design comments and design documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import rules as R

# Words that raise a comment's value, and words of design documents' file names.
VALUABLE = [
    "because", "reason", "windows", "crash", "leak", "deadlock", "race", "thread", "goroutine", "performance", "silent", "buffer", "encoding",
    "timeout", "mutex", "unsafe", "workaround", "trap", "override", "compat", "fallback", "patch", "drift", "symlink",
]
DESIGN_NAMES = ["convention", "architecture", "design", "rule", "pattern", "guideline", "standard"]

# The line patterns and generated-file marks.
WORKAROUND = r"(?i)(?:^|[\s/#*;-]+)\b(workaround|work-around|trap|override|gotcha|bypass|edge[- ]case|monkey[- ]patch|deadlock|race condition|silent drift)\b[:：\s]*(.+)?"
CRITICAL = r"(?i)(?:^|[\s/#*;-]+)\b(HACK|BUG|FIXME|COMPATIBILITY)\b[:：\s]+(.+)"
INFORMATIVE = r"(?i)(?:^|[\s/#*;-]+)\b(TODO|NOTE|XXX|OPTIMIZE|WARN)\b[:：\s]+(.+)"
DESIGN_COMMENTS = ["architecture:", "design decision:", "pattern:", "convention:"]
GENERATED = ["Code generated by", "DO NOT EDIT", "Autogenerated by"]


def any_of(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def readable(files: DataFrame, most_bytes: int = 1 << 20, most_chars: int = 1000) -> DataFrame:
    """Source files (rel, content, size) that people write: not packed, not large, no very long line among the first five."""
    name = F.lower("rel")
    packed = name.endswith(".min.js") | name.endswith(".bundle.js") | name.endswith(".chunk.js")
    long_ = F.exists(F.slice(F.split("content", "\n", 6), 1, 5), lambda x: F.length(x) > most_chars)
    return files.where(~packed & (F.col("size") <= most_bytes) & ~long_)


def comments(lines: DataFrame, least: float = 0.0) -> DataFrame:
    """(rel, line_no, category, pattern, excerpt, score) of lines (rel, line_no, line); the first kind that fits a line counts."""
    s = F.trim(F.regexp_replace("line", "[\\t\\r\\f]", " "))
    rows = lines.select("rel", "line_no", s.alias("s")).where((F.length("s").between(1, 1000)) & ~any_of(F.col("s"), GENERATED))
    part = lambda p, i: F.trim(F.regexp_extract("s", p, i))
    kind = R.choose([(F.col("s").rlike(WORKAROUND), "workaround"), (F.col("s").rlike(CRITICAL), "critical"), (F.col("s").rlike(INFORMATIVE), "informative"),
                     ((F.col("line_no") <= 25) & any_of(F.lower("s"), DESIGN_COMMENTS), "design")])
    rows = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    pattern = {"workaround": WORKAROUND, "critical": CRITICAL, "informative": INFORMATIVE}
    pick = lambda i: R.choose([(F.col("kind") == k, part(p, i)) for k, p in pattern.items()], F.lit(""))
    rows = rows.select("*", F.upper(pick(1)).alias("mark"), pick(2).alias("detail"))
    idle = (F.col("kind") == "informative") & (F.length("detail") < 15) & ~any_of(F.lower("detail"), VALUABLE)
    whole = F.when((F.col("kind") == "design") | (F.col("detail") == ""), F.col("s")).otherwise(F.concat_ws(": ", "mark", "detail"))
    base = R.choose([(F.col("kind") == "workaround", 0.78), (F.col("mark").isin("HACK", "BUG"), 0.72), (F.col("kind") == "critical", 0.65), (F.col("kind") == "informative", 0.52)], 0.70)
    category = R.choose([(F.col("kind") == "workaround", "WORKAROUND_TRAP"), (F.col("kind") == "design", "ARCHITECTURE_COMMENT")], F.concat(F.lit("ANNOTATION_"), F.col("mark")))
    name = F.when(F.col("kind") == "design", "architecture-header").otherwise(F.col("mark"))
    scored = F.when(F.col("kind").isin("critical", "informative"), F.col("detail")).otherwise(F.col("whole"))
    rows = rows.where(~idle).select("rel", "line_no", "kind", "detail", category.alias("category"), name.alias("pattern"), base.alias("base"), whole.alias("whole"))
    rows = rows.select("rel", "line_no", "category", "pattern", "whole", "base", scored.alias("scored"))
    score = R.value_score(F.col("base"), F.col("scored"), VALUABLE)
    return rows.select("rel", "line_no", "category", "pattern", F.substring("whole", 1, 140).alias("excerpt"), score.alias("score")).where(F.col("score") >= least)


def design_documents(files: DataFrame) -> DataFrame:
    """Rows like those of comments for Markdown files (rel, content) named like a design document; over 20 lines count more."""
    name = F.substring_index("rel", "/", -1)
    n_lines = F.size(F.split(F.regexp_replace("content", "\n\\z", ""), "\n"))
    score = F.when(n_lines > 20, 0.85).otherwise(0.75)
    stem = F.regexp_replace(name, "\\.md$", "")
    return files.where(F.lower(name).endswith(".md") & any_of(F.lower(name), DESIGN_NAMES)).select(
        "rel", F.lit(1).alias("line_no"), F.lit("ARCHITECTURE_DOC").alias("category"), F.lit("architecture-filename").alias("pattern"),
        F.concat(F.lit("Architecture / Design document: "), stem).alias("excerpt"), score.alias("score"),
    )


def destination(rel: Column, excerpt: Column, by_extension: dict[str, str], by_words: list[tuple[list[str], str]], default: Column | str) -> Column:
    """Where a finding goes: by the file's extension, else by the first word list that its excerpt or name has."""
    extension = F.lower(F.regexp_extract(rel, "(\\.[^./]+)$", 1))
    text = F.lower(F.concat_ws(" ", excerpt, F.substring_index(rel, "/", -1)))
    return R.choose([(extension == e, d) for e, d in by_extension.items()] + [(any_of(text, words), d) for words, d in by_words], default)


def top(found: DataFrame, limit: int) -> DataFrame:
    """The most valuable findings by score, then place."""
    return found.orderBy(F.desc("score"), "rel", "line_no").limit(limit)


def rule_drift(projects: DataFrame, most_days: int = 7) -> DataFrame:
    """(project, days, state) of projects (project, rules DATE, code DATE): missing rules, or rules older than the code by more than the limit."""
    days = F.date_diff("code", "rules")
    state = R.choose([(F.col("rules").isNull(), "missing"), (days > most_days, "behind")], "fresh")
    return projects.select("project", days.alias("days"), state.alias("state"))
