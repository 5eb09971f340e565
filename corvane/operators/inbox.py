"""Drafts: destinations, clusters, field edits, consolidation targets, and the checks of a routing table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import rules as R
from corvane.functions import text as T

# Topics with a rule file of their own, and titles that are refused.
GIT_TOPICS = ["git", "symlink", "windows"]
CONCURRENCY_TOPICS = ["concurrency", "channel", "mutex", "errgroup"]
ERROR_TOPICS = ["error", "error-handling", "panic"]
TRIVIAL_TITLES = ["test", "temp", "123", "todo", "fix typo", "临时", "测试"]


def tagged(tags: Column, space: str) -> Column:
    """The names under one tag space, in order."""
    own = F.filter(F.coalesce(tags, F.expr(T.EMPTY)), lambda t: t.startswith(f"{space}/"))
    return F.transform(own, lambda t: F.substring(t, F.lit(len(space) + 2), F.length(t)))


def destinations(drafts: DataFrame) -> DataFrame:
    """(rel, destination) of drafts (rel, type, tags, promoted_to), first rule first: where it was promoted to, language, topic, tool, source, project, rules."""
    to = F.replace(F.regexp_replace(F.coalesce("promoted_to", F.lit("")), "^[\\[\\]]+|[\\[\\]]+$", ""), F.lit("\\"), F.lit("/"))
    lang, topic, category = (tagged(F.col("tags"), s) for s in ("lang", "topic", "category"))
    has = lambda a, words: F.arrays_overlap(a, F.array(*map(F.lit, words)))
    tool = lambda a: F.exists(a, lambda x: F.contains(F.lower(x), F.lit("tool")))
    project = F.get(F.filter(category, lambda c: c.startswith("project:")), F.lit(0))
    cases = [
        (to.startswith("01-Rules/"), "01-Rules/"), (to.startswith("03-Languages/"), "03-Languages/"),
        (F.size(lang) > 0, F.concat(F.lit("03-Languages/"), F.initcap(F.lower(F.get(lang, F.lit(0)))), F.lit("/"))),
        (has(topic, GIT_TOPICS) | has(topic, CONCURRENCY_TOPICS) | has(topic, ERROR_TOPICS), "01-Rules/"),
        (tool(category) | tool(topic), "05-Tools/"),
        (F.coalesce(F.col("type") == "source-notes", F.lit(False)) | (F.size(tagged(F.col("tags"), "source")) > 0), "06-Sources/"),
        (project.isNotNull(), F.concat(F.lit("08-Projects/"), F.substring_index(project, ":", -1), F.lit("/"))),
    ]
    return drafts.select("rel", R.choose(cases, "01-Rules/").alias("destination"))


def clusters(drafts: DataFrame) -> DataFrame:
    """(cluster, n, chars) of drafts (rel, tags, content) by the first language or topic tag."""
    first = F.get(F.filter(F.coalesce("tags", F.expr(T.EMPTY)), lambda t: t.startswith("lang/") | t.startswith("topic/")), F.lit(0))
    name = F.get(F.split(first, "/"), F.lit(1))
    cluster = R.choose([(first.startswith("lang/"), F.concat(F.lit("Language: "), F.upper(name))), (first.startswith("topic/"), F.concat(F.lit("Topic: "), F.initcap(name)))], "general")
    return drafts.groupBy(cluster.alias("cluster")).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


def admitted(drafts: DataFrame) -> DataFrame:
    """(rel..., refused): null, or why a draft (title, content) is refused: short title, short content, trivial title."""
    title, content = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("content", F.lit("")))
    return drafts.select("*", R.choose([(F.length(title) < 4, "title"), (F.length(content) < 30, "content"), (F.lower(title).isin(TRIVIAL_TITLES), "trivial")]).alias("refused"))


def file_slug(title: Column) -> Column:
    """A title as a file name; one without usable characters becomes knowledge-note."""
    s = F.regexp_replace(F.lower(F.trim(title)), "[\\\\/:*?\"<>|\\s]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", ""), F.lit("")), F.lit("knowledge-note"))


def upsert_field(content: Column, field: str, value: Column | str) -> Column:
    """The note with a field of its leading block set: the line replaced, or one added before the block's end. Notes without a block stay."""
    value = F.lit(value) if isinstance(value, str) else value
    quoted = F.concat(F.lit(f"{field}: "), value)
    block = F.regexp_extract(content, "(?s)\\A(---[ \\t]*\\r?\\n.*?\\n)---", 1)
    rest = F.substring(content, F.length(block) + 1, F.length(content))
    line = F.regexp_extract(block, f"(?m)^({field}:[^\\r\\n]*)", 1)
    eol = F.when(F.contains(block, F.lit("\r\n")), "\r\n").otherwise("\n")
    place = F.locate(f"\n{field}:", block)
    changed = F.concat(F.substring(block, F.lit(1), place), quoted, F.substring(block, place + 1 + F.length(line), F.length(block)))
    return F.when(block == "", content).when(place > 0, F.concat(changed, rest)).otherwise(F.concat(block, quoted, eol, rest))


def add_fields(content: Column, fields: list[tuple[str, str]]) -> Column:
    """The note with the fields that its block lacks added at the block's end; present ones stay as they are."""
    for name, value in fields:
        block = F.regexp_extract(content, "(?s)\\A(---[ \\t]*\\r?\\n.*?\\n)---", 1)
        content = F.when(block.rlike(f"(?m)^{name}:"), content).otherwise(upsert_field(content, name, value))
    return content


def body_statistics(notes: DataFrame) -> DataFrame:
    """(rel, n_headings, n_code_blocks, n_lines) of notes (rel, content)."""
    ends = F.regexp_count("content", F.lit("\n")) + F.when(F.col("content").rlike("[^\\n]\\z"), 1).otherwise(0)
    return notes.select(
        "rel", F.regexp_count("content", F.lit("(?m)^#{1,3}\\s+.+$")).cast("long").alias("n_headings"),
        F.regexp_count("content", F.lit("(?s)```.*?```")).cast("long").alias("n_code_blocks"), ends.cast("long").alias("n_lines"),
    )


def sheet_status(drafts: DataFrame, sheets: DataFrame) -> DataFrame:
    """(rel, status) of drafts (rel, heading, sheet) against sheets (sheet, content): synced, stale or missing."""
    rows = drafts.join(sheets.select("sheet", "content", F.lit(True).alias("found")), "sheet", "left")
    return rows.select("rel", R.choose([(F.col("found").isNull(), "missing"), (F.contains("content", "heading"), "synced")], "stale").alias("status"))


def route_problems(routes: DataFrame, files: DataFrame, kinds: tuple[str, ...] = ("language", "rule", "project")) -> DataFrame:
    """(tag, problem) of routes (tag, type, target): unknown type, tag without space and name, repeated tag, target (rel of files) that is not there."""
    bad = lambda rows, why: rows.select("tag", F.lit(why).alias("problem"))
    found = bad(routes.where(~F.coalesce(F.col("type").isin(*kinds), F.lit(False))), "type")
    found = found.unionByName(bad(routes.where(~F.coalesce(F.col("tag").rlike("^[^/\\s]+/[^/\\s]+$"), F.lit(False))), "tag form"))
    found = found.unionByName(bad(routes.groupBy("tag").count().where("count > 1"), "repeated"))
    return found.unionByName(bad(routes.join(files.select(F.col("rel").alias("target")), "target", "left_anti"), "target"))
