"""Results as texts: snippets with their surroundings, marked terms, ordered listings, pages and JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snippet_frame(body: Column, best: Column, before: int = 1, after: int = 2) -> Column:
    """The lines around the one at 0-based position best, without blank ones and trailing blanks."""
    rows = F.split(body, "\n")
    first = F.greatest(best - before, F.lit(0))
    around = F.slice(rows, first + 1, best + after + 1 - first)
    return F.array_join(F.filter(F.transform(around, lambda x: F.regexp_replace(x, "\\s+$", "")), lambda x: x != ""), "\n")


def preview(content: Column, lines: int = 45) -> Column:
    """The first lines of a note, for a request without a section."""
    return F.array_join(F.slice(F.split(content, "\r?\n"), 1, lines), "\n")


def marked(text: Column, terms: list[str], left: str = "**", right: str = "**") -> Column:
    """The text with every term, longest first and in any case, between marks; without terms as it is."""
    found = sorted({t for t in terms if t.strip()}, key=lambda t: (-len(t), t))
    safe = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, "(?i)(" + "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in found) + ")", f"{safe(left)}$1{safe(right)}") if found else text


def hits_json(hits: DataFrame) -> DataFrame:
    """(rank, json) of ranked hits (rank, score, ...): one object for each, scores with two digits."""
    rest = [c for c in hits.columns if c not in ("rank", "score")]
    return hits.select("rank", F.to_json(F.struct("rank", F.round("score", 2).alias("score"), *rest)).alias("json"))


def hits_compact(hits: DataFrame) -> DataFrame:
    """(rank, text) of ranked hits (rank, title, score, rel, line, section, tags, snippet): title, place, and at most 140 characters of the snippet."""
    lines = F.filter(F.transform(F.split("snippet", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("---")))
    joined = F.array_join(F.slice(lines, 1, 2), " ")
    short = F.when(F.length(joined) > 140, F.concat(F.substring(joined, 1, 137), F.lit("..."))).otherwise(joined)
    place = F.concat_ws(" | ", F.concat("rel", F.lit(":"), "line"), F.nullif(F.coalesce("section", F.lit("")), F.lit("")), F.nullif(F.array_join(F.coalesce("tags", F.expr("cast(array() as array<string>)")), ", "), F.lit("")))
    return hits.select("rank", F.concat_ws("\n", F.concat(F.lit("["), "rank", F.lit("] "), "title", F.lit(" ("), F.format_number("score", 1), F.lit(" pts)")), F.concat(F.lit("    "), place), F.when(short != "", F.concat(F.lit("    "), short))).alias("text"))


def hits_detailed(hits: DataFrame, terms: list[str]) -> DataFrame:
    """(rank, text) of ranked hits as in hits_compact, with a line for each fact and the whole snippet, its terms marked."""
    body = F.array_join(F.transform(F.split(marked(F.col("snippet"), terms), "\n"), lambda x: F.concat(F.lit("     | "), x)), "\n")
    tags = F.nullif(F.array_join(F.coalesce("tags", F.expr("cast(array() as array<string>)")), ", "), F.lit(""))
    head = F.concat(F.lit("["), "rank", F.lit("] "), "title", F.lit(" ["), F.format_number("score", 2), F.lit(" pts]"))
    return hits.select("rank", F.concat_ws("\n", head, F.concat(F.lit("     "), "rel", F.lit(":"), "line"), F.concat(F.lit("     "), tags), F.concat(F.lit("     "), F.nullif(F.col("section"), F.lit(""))), body).alias("text"))


# --- ordered listings: every order ends in a unique key ----------------------------------------------------------


def by_value(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """Code candidates (rel, line_no, value_score) with the most valuable first."""
    rows = candidates.orderBy(F.desc("value_score"), "rel", "line_no")
    return rows if limit is None else rows.limit(limit)


def by_ratio(pairs: DataFrame) -> DataFrame:
    """Duplicate pairs (a, b, ratio), the most similar first."""
    return pairs.orderBy(F.desc("ratio"), "a", "b")


def by_conflict(candidates: DataFrame) -> DataFrame:
    """Conflict candidates (rel_a, rel_b, keyword, idx_a, idx_b, score): score, then files, keyword and places."""
    return candidates.orderBy(F.desc("score"), "rel_a", "rel_b", "keyword", "idx_a", "idx_b")


def hubs(degrees: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree) of hubs, the best connected first."""
    return degrees.where("role = 'hub'").select("node", "in_degree", "out_degree").orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "node")


def by_age(ages: DataFrame) -> DataFrame:
    """Drafts (rel, age_days, ...), the oldest first."""
    return ages.orderBy(F.desc("age_days"), "rel")


def recently_changed(notes: DataFrame, today: Column, days: int = 7, limit: int = 8, kind: str | None = None, without: str | None = None) -> DataFrame:
    """The last changed notes (rel, type, mtime) of the last days, of one type, without those whose path has a part."""
    rows = notes.where(F.to_date("mtime") >= F.date_sub(today, days))
    rows = rows if kind is None else rows.where(F.col("type") == kind)
    rows = rows if without is None else rows.where(~F.contains("rel", F.lit(without)))
    return rows.orderBy(F.desc("mtime"), "rel").limit(limit)


# --- listings of a collection ------------------------------------------------------------------------------------


def standards(files: DataFrame) -> DataFrame:
    """(part, name, long_form, short_form) of files (rel): for each language its two forms or null, then rules and career notes."""
    parts, name = F.split("rel", "/"), F.substring_index("rel", "/", -1)
    language = files.where(F.startswith("rel", F.lit("03-Languages/")) & (F.size(parts) >= 3)).select(F.get(parts, F.lit(1)).alias("name"), (F.size(parts) == 3).alias("here"), name.alias("file"))
    form = lambda kind: F.min(F.when(F.col("here") & F.endswith("file", F.lit(f"-{kind}.md")), F.col("file")))
    out = language.groupBy("name").agg(form("STANDARDS").alias("long_form"), form("CHEATSHEET").alias("short_form")).select(F.lit("language").alias("part"), "name", "long_form", "short_form")
    none = F.lit(None).cast("string")
    note = F.endswith("rel", F.lit(".md"))
    rest = lambda part, test: files.where(note & test).select(F.lit(part).alias("part"), F.col("rel").alias("name"), none.alias("long_form"), none.alias("short_form"))
    rules_ = rest("rule", F.startswith("rel", F.lit("01-Rules/")) & (F.size(parts) == 2))
    return out.unionByName(rules_).unionByName(rest("career", F.startswith("rel", F.lit("09-Career/"))))


def code_template(files: DataFrame, name: str, lang: str | None = None) -> DataFrame:
    """At most one row (rel, content): the first file by path below Templates/code whose name has this part, and a language in its name or folder."""
    file, folder = F.lower(F.substring_index("rel", "/", -1)), F.lower(F.regexp_extract("rel", "([^/]*)/[^/]*$", 1))
    test = F.startswith("rel", F.lit("Templates/code/")) & F.contains(file, F.lit(name.strip().lower()))
    if lang:
        test = test & (F.contains(folder, F.lit(lang.lower())) | F.contains(file, F.lit(lang.lower())))
    first = files.where(test).select("rel", "content").orderBy("rel").limit(1)
    return first.select("rel", F.concat(F.lit("// Code Template: "), "rel", F.lit("\n\n"), "content").alias("content"))


def conflict_rows(candidates: DataFrame) -> DataFrame:
    """(score, files, tag, keyword, folded) for a page: candidates of score 2 and more, and one row with the number of the others."""
    listed = candidates.where("score >= 2").select("score", F.concat("rel_a", F.lit(" - "), "rel_b").alias("files"), "tag", "keyword", F.lit(None).cast("long").alias("folded"))
    rest = candidates.where("score < 2").agg(F.count("*").alias("folded")).where("folded > 0")
    none = F.lit(None).cast("string")
    return listed.unionByName(rest.select(F.lit(1).cast("long").alias("score"), none.alias("files"), none.alias("tag"), none.alias("keyword"), "folded"))


def index_page(pages: DataFrame) -> DataFrame:
    """One row (page): links to pages (position, name, title) in order; a mark where there are none. Pages are a handful."""
    link = F.concat(F.lit("- [[dashboards/"), "name", F.lit("|"), "title", F.lit("]]"))
    rows = F.array_sort(F.collect_list(F.struct("position", link.alias("link"))))
    body = F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda x: x["link"]), "\n")).otherwise("- (none)")
    return pages.agg(body.alias("page"))


def matrix(capabilities: DataFrame, sections: list[str]) -> DataFrame:
    """(section, page) of capabilities (position, section, name, type, tier, verification_command, declared_status): a table for each section in order."""
    command = F.when(F.col("verification_command").isNull(), "—").otherwise(F.concat(F.lit("`"), "verification_command", F.lit("`")))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "name", "type", "tier", command, "declared_status"), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", row.alias("row")))), lambda x: x["row"]), "\n")
    known = capabilities.where(F.col("section").isin(sections))
    return known.groupBy("section").agg(F.concat(F.lit("| name | type | tier | command | status |\n|---|---|---|---|---|\n"), body).alias("page"))


def backfill_summary(planned: DataFrame, scanned: DataFrame) -> DataFrame:
    """(authority, n, lines, scanned) of a backfill plan (rel, adds MAP) against all notes: for each value, and in all (authority null)."""
    value = F.coalesce(F.element_at("adds", "authority"), F.lit(""))
    rows = planned.select(value.alias("authority"), F.size("adds").alias("k"))
    counts = rows.rollup("authority").agg(F.count("*").alias("n"), F.sum("k").cast("long").alias("lines"))
    return counts.join(scanned.agg(F.count("*").alias("scanned")), F.lit(True))  # one row beside each


def nightly(steps: list[tuple[str, object]], gate: str = "quality-check") -> tuple[int, list[tuple[str, str]]]:
    """Run named steps in order; (exit code, what became of each). A step that raises or returns a code is noted and passed over; a failing gate ends the run with 1."""
    done = []
    for name, run in steps:
        try:
            code = run() or 0
            done.append((name, "ok" if code == 0 else f"code {code}"))
        except Exception as e:  # any failure of a step that is no gate is tolerated, and reported
            code = 1
            done.append((name, f"raised {type(e).__name__}: {e}"))
        if name == gate and code:
            return 1, done
    return 0, done
