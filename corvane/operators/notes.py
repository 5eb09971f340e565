"""Notes to lines, sections, headings, fields, tags and links.

A note is (rel STRING, content STRING); every function is DataFrame to DataFrame and keeps rel as the key, so that one
partitioning by rel serves all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T


#: What opens and closes a fence, by reader: most of them, those that know backticks only, and those that look anywhere in a line.
FENCE_MARKS = {"prefix": "^\\s*(```|~~~)", "backticks": "^\\s*```", "anywhere": "```"}


def lines(notes: DataFrame, fences: str = "prefix") -> DataFrame:
    """(rel, line_no, line, in_fence, in_fields); line feeds end lines, a carriage return before them is dropped. fences: one of FENCE_MARKS."""
    text = F.regexp_replace(F.regexp_replace("content", "\r\n", "\n"), "\n\\z", "")
    rows = notes.select("rel", F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    order = Window.partitionBy("rel").orderBy("i")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.col("line").rlike(FENCE_MARKS[fences])
    first = F.first(F.col("line") == "---").over(so_far)
    rules = F.sum((F.col("line") == "---").cast("int")).over(so_far)
    rows = rows.select("rel", (F.col("i") + 1).alias("line_no"), "line", (first & ((rules < 2) | ((rules == 2) & (F.col("line") == "---")))).alias("in_fields"), mark.alias("mark"))
    toggles = F.sum((F.col("mark") & ~F.col("in_fields")).cast("int")).over(Window.partitionBy("rel").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("rel", "line_no", "line", ((toggles % 2 == 1) | F.col("mark")).alias("in_fence"), "in_fields")


def fields(notes: DataFrame) -> DataFrame:
    """(rel, fields): the ``key: value`` lines between a leading pair of ``---``, keys in lower case; an open block is none."""
    block = F.regexp_extract("content", "(?s)\\A---[ \\t]*\\r?\\n(.*?)\\r?\\n---[ \\t]*(?:\\r?\\n|\\z)", 1)
    pairs = F.filter(F.split(block, "\r?\n"), lambda x: x.rlike("^[A-Za-z_-]+:"))
    entry = lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v"))
    entries = F.transform(pairs, entry)
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"])
    return notes.select("rel", F.map_from_arrays(keys, last).alias("fields"))


def fields_of_search(notes: DataFrame) -> DataFrame:
    """(rel, fields MAP<STRING, ARRAY<STRING>>) as search reads them: inline lists, empty and block values as empty lists, tags in lower case without #.

    A block that is not closed takes the whole note.
    """
    opened = F.col("content").rlike("\\A---[ \\t]*(\\r?\\n|\\z)")
    block = F.regexp_replace(F.regexp_replace("content", "\\A---[ \\t]*\\r?\\n", ""), "(?s)(\\A|\\n)---[ \\t]*(\\r?\\n.*)?\\z", "")
    pairs = F.filter(F.split(F.when(opened, block).otherwise(""), "\r?\n"), lambda x: x.rlike("^[A-Za-z_-]+\\s*:"))

    def entry(x: Column) -> Column:
        key, value = F.lower(F.trim(F.substring_index(x, ":", 1))), F.trim(F.regexp_replace(x, "^[^:]*:", ""))
        items = F.when(value.isin("", "|"), F.expr(T.EMPTY)).otherwise(listed(value))
        return F.struct(key.alias("k"), F.when(key == "tags", F.transform(items, lambda t: F.lower(t))).otherwise(items).alias("v"))

    entries = F.transform(pairs, entry)
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"])
    return notes.select("rel", F.map_from_arrays(keys, last).alias("fields"))


def fields_of_drafts(notes: DataFrame) -> DataFrame:
    """(rel, fields, body) as triage and consolidation read them: what stands between the first two ---, wherever those are."""
    parts = F.split("content", "---", 3)
    whole = F.startswith("content", F.lit("---")) & (F.size(parts) == 3)
    as_note = F.concat(F.lit("---\n"), F.trim(F.regexp_replace(F.get(parts, F.lit(1)), "^\\s+|\\s+$", "")), F.lit("\n---\n"))
    read = fields(notes.select("rel", F.when(whole, as_note).otherwise("").alias("content")))
    body = F.when(whole, F.regexp_replace(F.get(parts, F.lit(2)), "^\\s+|\\s+$", "")).otherwise(F.col("content"))
    return notes.select("rel", body.alias("body")).join(read, "rel").select("rel", "fields", "body")


def tags_of_block(notes: DataFrame) -> DataFrame:
    """(rel, tags) as the compactor reads them: every ``- `` line of the leading block is a tag."""
    block = F.regexp_extract("content", "(?s)\\A---[ \\t]*\\r?\\n(.*?)\\r?\\n---", 1)
    items = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("- ")))
    return notes.select("rel", F.transform(items, lambda x: F.regexp_replace(F.trim(F.substring(x, F.lit(3), F.length(x))), "^['\"]+|['\"]+$", "")).alias("tags"))


def with_placeholders(content: Column) -> Column:
    """Template marks {{x}} as plain words placeholder_x, so that a leading block with them can be read."""
    return F.regexp_replace(content, "\\{\\{\\s*([^{}]*?)\\s*\\}\\}", "placeholder_$1")


def without_fences(content: Column) -> Column:
    """The text without what stands between pairs of three backticks, wherever they are in a line."""
    return F.regexp_replace(content, "(?s)```.*?```", "")


def link_forms(notes: DataFrame) -> DataFrame:
    """(rel, target, name): distinct targets of all links of a note, its leading block and fences included, with their last part."""
    raw = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit("\\[\\[([^\\]]+)\\]\\]"), 1), T.link_target)))
    rows = notes.select("rel", raw.alias("target")).where("target <> ''")
    return rows.select("rel", "target", F.substring_index("target", "/", -1).alias("name"))


def listed(value: Column) -> Column:
    """The items of an inline list ``[a, b]`` or of one bare value."""
    inner = F.regexp_replace(value, "^\\[|\\]$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^['\"#]+|['\"]+$", "")), lambda x: x != "")


def inline_tags(notes: DataFrame) -> DataFrame:
    """(rel, tags): distinct ``#space/name`` tags in order, in lower case; only those with a slash."""
    found = F.regexp_extract_all("content", F.lit("(?:^|\\s)#([a-zA-Z0-9_\\-/]+)"), 1)
    return notes.select("rel", F.array_distinct(F.transform(F.filter(found, lambda x: x.contains("/")), F.lower)).alias("tags"))


def sections(notes: DataFrame, deepest: int = 3) -> DataFrame:
    """(rel, section, level, heading, start_line, body): split at headings up to a level, wherever they stand; section 0 is before the first."""
    rows = lines(notes)
    head = f"^(#{{1,{deepest}}})\\s+(.+)$"
    is_head = F.col("line").rlike(head)
    number = F.sum(is_head.cast("int")).over(Window.partitionBy("rel").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.select("*", number.alias("section"), is_head.alias("is_head"))
    body = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    out = rows.groupBy("rel", "section").agg(
        F.max(F.when(F.col("is_head"), F.length(F.regexp_extract("line", head, 1)))).alias("level"),
        F.max(F.when(F.col("is_head"), F.trim(F.regexp_extract("line", head, 2)))).alias("heading"),
        F.min("line_no").alias("start_line"), body.alias("body"),
    )
    return out.select("rel", "section", "level", "heading", "start_line", F.array_join(F.transform("body", lambda x: x["line"]), "\n").alias("body"))


def headings(notes: DataFrame) -> DataFrame:
    """(rel, line_no, level, title, number): headings of all six levels outside fences."""
    rows = lines(notes).where(~F.col("in_fence") & F.col("line").rlike("^#{1,6}\\s+\\S"))
    title = F.trim(F.regexp_extract("line", "^#{1,6}\\s+(.*)$", 1))
    number = F.nullif(F.regexp_extract(title, "^(?:§\\s*|第\\s*)?([0-9]+(?:\\.[0-9]+)*|[一二三四五六七八九十]+)", 1), F.lit(""))
    return rows.select("rel", "line_no", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), title.alias("title"), number.alias("number"))


def links(notes: DataFrame) -> DataFrame:
    """(rel, line_no, target): wikilinks outside fences and inline code, targets normalised, placeholders left out."""
    rows = lines(notes).where(~F.col("in_fence"))
    raw = F.explode(F.regexp_extract_all(F.regexp_replace("line", "`[^`\n]*`", ""), F.lit("\\[\\[([^\\]]+)\\]\\]"), 1))
    return rows.select("rel", "line_no", raw.alias("raw")).select("rel", "line_no", T.link_target(F.col("raw")).alias("target")).where(~T.is_placeholder(F.col("target")))


def heading_keys(notes: DataFrame) -> DataFrame:
    """(rel, keys ARRAY): what an anchor can name in a note (rel, content): its headings in lower case, as written and without Markdown marks, those in fences too."""
    written = F.transform(F.regexp_extract_all("content", F.lit("(?m)^#{1,6}\\s+(.+)$"), 1), lambda h: F.lower(F.regexp_replace(h, "^\\s+|\\s+$", "")))
    bare = F.transform(written, lambda h: F.regexp_replace(F.regexp_replace(h, "[#*`_\\[\\]]", ""), "^\\s+|\\s+$", ""))
    return notes.select("rel", F.array_union(written, bare).alias("keys"))


def local_anchors(notes: DataFrame) -> DataFrame:
    """(rel, line_no, anchor, known) of links to a place in the note itself, outside fences and inline code: known if it is one of its headings.

    Block references (``^``) name no heading and are left out.
    """
    rows = lines(notes).where(~F.col("in_fence"))
    raw = F.explode(F.regexp_extract_all(F.regexp_replace("line", "`[^`\n]*`", ""), F.lit("\\[\\[([^\\]]+)\\]\\]"), 1))
    link = F.trim(F.substring_index(F.substring_index(F.col("raw"), "\\|", 1), "|", 1))
    rows = rows.select("rel", "line_no", raw.alias("raw")).select("rel", "line_no", link.alias("link")).where("startswith(link, '#')")
    rows = rows.select("rel", "line_no", F.trim(F.substring(F.col("link"), F.lit(2), F.length("link"))).alias("anchor")).where("anchor <> '' AND NOT startswith(anchor, '^')")
    known = F.coalesce(F.array_contains("keys", F.lower("anchor")), F.lit(False))
    return rows.join(heading_keys(notes), "rel").select("rel", "line_no", "anchor", known.alias("known"))


def titles(notes: DataFrame) -> DataFrame:
    """(rel, title): the title field, else the first top heading, else the file's stem."""
    top = F.nullif(F.regexp_extract("content", "(?m)^#\\s+(.+)$", 1), F.lit(""))
    stem = F.regexp_replace(F.substring_index("rel", "/", -1), "\\.[^.]*$", "")
    named = fields(notes).select("rel", F.nullif(F.element_at("fields", "title"), F.lit("")).alias("named"))
    return notes.select("rel", top.alias("top"), stem.alias("stem")).join(named, "rel").select("rel", F.coalesce("named", "top", "stem").alias("title"))


def snippet(sections_: DataFrame, name: str) -> DataFrame:
    """(rel, start_line, text): each section whose heading contains a name, with the deeper sections that follow it."""
    rows = sections_.withColumn("hit", F.contains(F.lower("heading"), F.lit(name.lower())))
    starts = rows.where("hit").select("rel", F.col("section").alias("s"), F.col("level").alias("l"), F.col("start_line").alias("at"))
    joined = starts.join(rows, "rel").where("section >= s")
    ends = joined.where("section > s AND level <= l").groupBy("rel", "s").agg(F.min("section").alias("e"))
    inside = joined.join(ends, ["rel", "s"], "left").where("e IS NULL OR section < e")
    body = F.array_sort(F.collect_list(F.struct("section", "body")))
    return inside.groupBy("rel", F.col("at").alias("start_line")).agg(F.array_join(F.transform(body, lambda x: x["body"]), "\n").alias("text"))
