"""Rules on the form of notes and on contracts: bytes, leading blocks, fields, links, drafts, hooks and capabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import rules as R
from corvane.functions import text as T
from corvane.operators import notes as N

# Files at the root that are no notes, and the enumerations of the contracts.
ROOT_FILES = ["AGENTS.md", "README.md", "CLAUDE.md", "GEMINI.md", "CONVENTIONS.md"]
HOOK_STAGES = ["pre-commit", "posttooluse", "stop"]
INTERPRETERS = ["bash", "sh", "python", "python3"]
CAPABILITY_STATUSES = ["verified", "configured", "degraded"]
CAPABILITY_FIELDS = ["name", "type", "tier", "declared_status", "section", "scope", "confirmation_required"]
LINK_ENDINGS = ["", ".md", ".canvas", ".png", ".jpg", ".pdf", ".svg"]


def _rows(source: DataFrame, issues: Column, *columns: str) -> DataFrame:
    """One pass: a row for each entry of an array of issues that is not null."""
    return source.select(*columns, F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("x")).select(*columns, "x.*")


def nul_issues(files: DataFrame) -> DataFrame:
    """(rel, level, category, n, line) of files (rel, content BINARY) with NUL bytes: how many, and the line of the first.

    The bytes are judged before they are decoded. A null content has no issue.
    """
    digits = F.hex("content")
    # pairs of digits, so that a match never begins in the middle of a byte
    before = F.regexp_extract(digits, "^((?:(?!00)..)*)00", 1)
    n = F.regexp_count(F.regexp_replace(digits, "(..)", "$1 "), F.lit("00 "))
    line = F.regexp_count(F.regexp_replace(before, "(..)", "$1 "), F.lit("0A ")) + 1
    rows = files.where(F.position(F.lit(b"\x00"), "content") > 0)
    return rows.select("rel", F.lit("ERROR").alias("level"), F.lit("ENCODING").alias("category"), n.cast("long").alias("n"), line.cast("long").alias("line"))


def exempt(notes: DataFrame, root_files: list[str] | None = None) -> Column:
    """Whether a note (rel) is left out of the checks: root files, plans and phases at the root, templates of work memory."""
    top = ~F.contains("rel", F.lit("/"))
    return F.col("rel").isin(root_files or ROOT_FILES) | (top & (F.contains(F.upper("rel"), F.lit("PLAN")) | F.startswith("rel", F.lit("PHASE")))) | F.startswith("rel", F.lit("Templates/workmemory/"))


def block_state(content: Column) -> Column:
    """missing, open or closed: the state of a note's leading block."""
    text = F.coalesce(content, F.lit(""))
    return R.choose([(~text.rlike("\\A---[ \\t]*(\\r?\\n|\\z)"), "missing"), (text.rlike("(?s)\\A---[ \\t]*\\r?\\n(.*?\\r?\\n)?---[ \\t]*(\\r?\\n|\\z)"), "closed")], "open")


def block_issues(notes: DataFrame) -> DataFrame:
    """(rel, level, category, message) of notes (rel, content) whose leading block is missing or open: a warning in templates."""
    state = block_state(F.col("content"))
    template = F.startswith("rel", F.lit("Templates/")) | F.contains("rel", F.lit("tpl-"))
    rows = notes.where(~exempt(notes)).select("rel", state.alias("message"), F.when(template, "WARN").otherwise("ERROR").alias("level")).where("message <> 'closed'")
    return rows.select("rel", "level", F.lit("FRONTMATTER").alias("category"), "message")


def link_keys(files: DataFrame) -> DataFrame:
    """(key) by which something is there: paths with and without the endings that links leave out, stems, and folders.

    files: rel of all files, notes or not.
    """
    endings = "|".join(e.replace(".", "\\.") for e in LINK_ENDINGS if e)
    bare = F.regexp_replace("rel", f"({endings})$", "")
    stem = F.regexp_replace(F.substring_index("rel", "/", -1), "\\.[^.]*$", "")
    parts = F.split("rel", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i - 1), "/"))
    return files.select(F.explode(F.array_union(F.array("rel", bare, stem), F.filter(folders, lambda d: d != ""))).alias("key")).distinct()


def checked_links(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(rel, line_no, target, found) of the links of notes (rel, content) that are no placeholders, against all files (rel).

    A target is there as a path from the root or from the note's folder, as a stem, or as a folder. Anchors of the note itself are.
    """
    links = N.links(notes).where("target <> ''").withColumn("target", F.replace("target", F.lit("\\"), F.lit("/")))
    folder = F.regexp_extract("rel", "^(.*/)[^/]*$", 1)
    stem = F.regexp_replace(F.substring_index("target", "/", -1), "\\.[^.]*$", "")
    keys = F.array_distinct(F.array("target", F.concat(folder, "target"), stem))
    hits = links.select("rel", "target", F.explode(keys).alias("key")).join(link_keys(files), "key").select("rel", "target", F.lit(True).alias("hit")).distinct()
    return links.join(hits, ["rel", "target"], "left").select("rel", "line_no", "target", F.col("hit").isNotNull().alias("found"))


def link_issues(links: DataFrame) -> DataFrame:
    """(rel, level, category, message, line) of checked links that are broken."""
    message = F.concat(F.lit("broken link "), "target")
    return links.where("NOT found").select("rel", F.lit("WARN").alias("level"), F.lit("WIKILINK").alias("category"), message.alias("message"), F.col("line_no").alias("line"))


def link_totals(links: DataFrame) -> DataFrame:
    """One row (checked, distinct_targets, broken) of checked links."""
    return links.agg(F.count("*").alias("checked"), F.count_distinct("target").alias("distinct_targets"), F.count_if(~F.col("found")).alias("broken"))


def strict_gate(issues: DataFrame, totals: DataFrame) -> DataFrame:
    """One row (errors, broken, passed): a strict run passes without errors and without broken links."""
    errors = issues.agg(F.count_if(F.col("level") == "ERROR").alias("errors"))
    return errors.join(totals.select("broken"), F.lit(True)).select("errors", "broken", ((F.col("errors") == 0) & (F.col("broken") == 0)).alias("passed"))  # one row beside one row


def field_presence(notes: DataFrame) -> DataFrame:
    """(rel, reason) of notes (rel, content) without a closed block, without required fields (presence, not value), or with no tags.

    The first reason of a note only; missing fields are listed in their order.
    """
    rows = notes.select("rel", block_state(F.col("content")).alias("state")).join(N.fields(notes), "rel")
    missing = F.filter(F.array(*map(F.lit, R.REQUIRED_FIELDS)), lambda f: ~F.array_contains(F.map_keys("fields"), f))
    tags = N.listed(F.coalesce(F.element_at("fields", "tags"), F.lit("")))
    reason = R.choose([(F.col("state") != "closed", F.lit("no block")), (F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))), (F.size(tags) == 0, F.lit("no tags"))])
    return rows.select("rel", reason.alias("reason")).where("reason IS NOT NULL")


def inbox(files: DataFrame) -> DataFrame:
    """(rel, name, size, modified) of the drafts among files (rel, size, mtime): a notice, never a failure; the folder's README is none."""
    name = F.substring_index("rel", "/", -1)
    rows = files.where(F.startswith("rel", F.lit("99-Inbox/")) & F.endswith("rel", F.lit(".md")) & (name != "README.md"))
    return rows.select("rel", name.alias("name"), "size", F.date_format("mtime", "yyyy-MM-dd HH:mm").alias("modified"))


def hook_problems(hooks: DataFrame, files: DataFrame) -> DataFrame:
    """(id, problem) of hooks (id, stage, entry): stage not in the enumeration; entry empty, not interpreter and script, or without its file (rel)."""
    entry = F.trim(F.coalesce("entry", F.lit("")))
    tokens = F.transform(F.regexp_extract_all(entry, F.lit("(\"[^\"]*\"|'[^']*'|\\S+)"), 1), lambda t: F.regexp_replace(t, "^[\"']|[\"']$", ""))
    rows = hooks.select("id", F.coalesce(F.col("stage").isin(HOOK_STAGES), F.lit(False)).alias("staged"), entry.alias("entry"), tokens.alias("tokens"))
    formed = (F.size("tokens") == 2) & F.get("tokens", F.lit(0)).isin(INTERPRETERS)
    rows = rows.withColumn("script", F.when(formed, F.get("tokens", F.lit(1))))
    rows = rows.join(files.select(F.col("rel").alias("script"), F.lit(True).alias("there")).distinct(), "script", "left")
    of_entry = R.choose([(F.col("entry") == "", "entry empty"), (F.col("script").isNull(), "entry form"), (F.col("there").isNull(), "script missing")])
    return _rows(rows, F.array(F.when(~F.col("staged"), F.struct(F.lit("stage").alias("problem"))), F.when(of_entry.isNotNull(), F.struct(of_entry.alias("problem")))), "id")


def capability_problems(capabilities: DataFrame) -> DataFrame:
    """(name, problem) of capabilities (name, type, tier, declared_status, section, scope, confirmation_required, verification_command).

    Missing fields, repeated names, status not in the enumeration, a scope other than read-only, and a status other than
    configured without a command. A repeated name is reported once for each further row.
    """
    missing = F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in CAPABILITY_FIELDS]), lambda f: f.isNotNull())
    claim = F.col("verification_command").isNull() & F.col("declared_status").isin("verified", "degraded")
    entry = lambda test, text: F.when(test, F.struct(text.alias("problem") if isinstance(text, Column) else F.lit(text).alias("problem")))
    found = _rows(capabilities, F.array(
        entry(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))),
        entry(~F.col("declared_status").isin(CAPABILITY_STATUSES), "status"), entry(F.col("scope") != "read-only", "scope"), entry(claim, "no command"),
    ), "name")
    twice = capabilities.where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    return found.unionByName(twice.select("name", F.explode(F.array_repeat(F.lit("repeated"), (F.col("n") - 1).cast("int"))).alias("problem")))


def rpc_results(lines: DataFrame) -> DataFrame:
    """(id, error, n_tools, protocol) of output lines (line_no, line): JSON objects with an id, the last of each; other lines are noise."""
    kind = "id STRING, error STRING, result STRUCT<tools: ARRAY<STRING>, protocolVersion: STRING>"
    rows = lines.where(F.trim("line").startswith("{")).select("line_no", F.from_json("line", kind).alias("m")).where("m.id IS NOT NULL")
    last = rows.groupBy("m.id").agg(F.max_by("m", "line_no").alias("m"))
    return last.select("id", "m.error", F.size("m.result.tools").alias("n_tools"), F.col("m.result.protocolVersion").alias("protocol"))


def plan_tasks(lines: DataFrame) -> DataFrame:
    """(id, title, status, implementer) of lines (line_no, line) of the form ``### Task N: title [Subagent: role]``."""
    form = "^###\\s+Task\\s+(\\d+):\\s*(.+)$"
    rows = lines.select("line_no", F.trim("line").alias("line")).where(F.col("line").rlike(form))
    title = F.trim(F.regexp_extract("line", form, 2))
    role = F.nullif(F.trim(F.regexp_extract(title, "\\[Subagent:\\s*([^\\]]+)\\]", 1)), F.lit(""))
    return rows.select("line_no", F.concat(F.lit("Task-"), F.regexp_extract("line", form, 1)).alias("id"), title.alias("title"), F.lit("pending").alias("status"), F.coalesce(role, F.lit("TDD")).alias("implementer"))


def papers(feeds: DataFrame) -> DataFrame:
    """(feed, id, title, published, summary) of the entries of fetched Atom feeds (feed, xml); ids without their address, summaries of 200 characters."""
    bare = F.regexp_replace("xml", "xmlns(:\\w+)?=\"[^\"]*\"", "")
    field = lambda name: F.xpath(F.col("xml"), F.lit(f"//entry/{name}/text()"))
    rows = feeds.select("feed", bare.alias("xml"))
    entry = F.explode(F.arrays_zip(*[field(n).alias(n) for n in ("id", "title", "published", "summary")]))
    rows = rows.select("feed", entry.alias("e"))
    flat = lambda c: F.replace(F.trim(F.col(c)), F.lit("\n"), F.lit(" "))
    return rows.select("feed", F.substring_index(F.trim("e.id"), "/abs/", -1).alias("id"), flat("e.title").alias("title"), F.substring(F.trim("e.published"), 1, 10).alias("published"), F.replace(F.substring(F.trim("e.summary"), 1, 200), F.lit("\n"), F.lit(" ")).alias("summary"))


def changed_files(porcelain: DataFrame) -> DataFrame:
    """(rel) of NUL-separated status outputs (raw): changed files, and both names of renamed ones; untracked and ignored ones are none."""
    fields = F.filter(F.split("raw", "\\x00"), lambda x: x != "")
    # a rename or copy is followed by its old name, which has no status of its own
    state = F.struct(F.lit(False).alias("old"), F.expr(T.EMPTY).alias("out"))

    def step(s: Column, x: Column) -> Column:
        code, path = F.substring(x, 1, 2), F.substring(x, F.lit(4), F.length(x))
        formed = (F.length(x) >= 4) & (F.substring(x, 3, 1) == " ")
        moved = ~s["old"] & formed & code.rlike("^[RC]")
        one = F.when(s["old"], F.array(x)).when(~formed | code.isin("??", "!!"), F.expr(T.EMPTY)).otherwise(F.array(path))
        return F.struct(moved.alias("old"), F.concat(s["out"], one).alias("out"))

    return porcelain.select(F.explode(F.aggregate(fields, state, step)["out"]).alias("rel")).select(F.replace("rel", F.lit("\\"), F.lit("/")).alias("rel")).distinct()
