"""Whole reports put together from the single operators: indexing, code scans, triage, lint, registries, exports, ledger gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import rules as R
from corvane.functions import text as T
from corvane.operators import code, export, inbox, ledger

# Folders and endings that are indexed, folders and endings of source code, endings of text.
TARGET_FOLDERS = ["00-MOC", "01-Rules", "02-Fundamentals", "03-Languages", "04-Systems", "05-Tools", "06-Sources", "07-Academics", "08-Projects", "09-Career", "10-Daily", "99-Inbox", "Templates"]
INDEXED_ENDINGS = [".md", ".go", ".py", ".ts", ".rs", ".sh", ".sql", ".yaml", ".yml"]
SKIPPED_FOLDERS = ["venv", "env", "site-packages", "node_modules", "vendor", "dist", "build", "out", "_next", "coverage", "target", "bin", "obj", "__pycache__", "_artifacts", "data"]
CODE_ENDINGS = [".go", ".py", ".ts", ".tsx", ".js", ".jsx", ".rs", ".md"]
TEXT_ENDINGS = [".md", ".py", ".sh", ".ps1", ".json", ".txt", ".canvas", ".css", ".yml", ".yaml", ".toml", ".cfg", ".ini", ".html"]


def ending(rel: Column) -> Column:
    """The lower-case ending of a path's name with its dot; empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(rel, "[^/](\\.[^./]*)$", 1))


def excluded(rel: Column, names: list[str], prefixes: list[str] = ()) -> Column:
    """Whether a part of a path is one of the names, or the path begins with one of the prefixes (those have a slash)."""
    parts = F.arrays_overlap(F.split(rel, "/"), F.array(*map(F.lit, names))) if names else F.lit(False)
    return reduce(lambda a, p: a | F.startswith(rel, F.lit(p)), prefixes, parts)


def indexable(files: DataFrame) -> DataFrame:
    """The files (rel, real_path, ...) that search indexes: of the target folders by ending, Markdown at the root, each real path once (the first rel)."""
    folder = F.substring_index("rel", "/", 1).isin(TARGET_FOLDERS) & F.contains("rel", F.lit("/")) & ending(F.col("rel")).isin(INDEXED_ENDINGS)
    root = ~F.contains("rel", F.lit("/")) & F.endswith("rel", F.lit(".md"))
    rows = files.where(folder | root)
    first = rows.groupBy("real_path").agg(F.min("rel").alias("rel"))
    return rows.join(first, ["real_path", "rel"], "left_semi").select(*files.columns)


def text_files(files: DataFrame) -> DataFrame:
    """The files (rel, content BINARY) that are text: by ending, or without ending and without a NUL in the first 8 KiB; nothing below .git."""
    own = ending(F.col("rel"))
    plain = (own == "") & ~(F.position(F.lit(b"\x00"), F.substring("content", 1, 8192)) > 0)
    return files.where(~excluded(F.col("rel"), [".git"]) & (own.isin(TEXT_ENDINGS) | plain))


def code_files(files: DataFrame) -> DataFrame:
    """The source files (rel, content, size) below no skipped and no hidden folder, with a known ending, that people write."""
    folders = F.slice(F.split("rel", "/"), 1, F.greatest(F.size(F.split("rel", "/")) - 1, F.lit(0)))
    pruned = F.exists(folders, lambda d: d.isin(SKIPPED_FOLDERS) | F.startswith(d, F.lit(".")))
    return code.readable(files.where(~pruned & ending(F.col("rel")).isin(CODE_ENDINGS)))


def code_scan(files: DataFrame, limit: int | None = None, least: float = 0.0) -> DataFrame:
    """(rel, line_no, category, pattern, excerpt, score): findings in comments, and design documents, of the files that count."""
    kept = code_files(files)
    lines = kept.where(ending(F.col("rel")) != ".md").select("rel", F.posexplode(F.split("content", "\n")).alias("i", "line")).select("rel", (F.col("i") + 1).alias("line_no"), "line")
    found = code.comments(lines, least).unionByName(code.design_documents(kept).where(F.col("score") >= least))
    return found if limit is None else code.top(found, limit)


def registry(lines: DataFrame, sections: dict[str, str], column: str) -> DataFrame:
    """(layer, name) of the tables of a registry (rel, line_no, line): the names in code marks in the column whose header says so.

    sections: layer by the number of a second- or third-level heading; a table ends at the first line that is none of its.
    """
    s = F.trim("line")
    number = F.nullif(F.regexp_extract(s, "^#{2,3}\\s+([0-9]+(?:\\.[0-9]+)?)", 1), F.lit(""))
    so_far = Window.partitionBy("rel").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.select("rel", "line_no", s.alias("s"), F.last(number, ignorenulls=True).over(so_far).alias("section"))
    rows = rows.withColumn("block", F.sum((~F.startswith("s", F.lit("|"))).cast("int")).over(so_far)).where(F.startswith("s", F.lit("|")))
    cells = F.transform(F.split(F.regexp_replace("s", "^\\|+|\\|+$", ""), "\\|"), lambda c: F.trim(c))
    rows = rows.select("rel", "line_no", "section", "block", cells.alias("c")).withColumn("at", F.array_position("c", column))
    head = rows.where("at > 0").groupBy("rel", "block").agg(F.min(F.struct("line_no", "at")).alias("h")).select("rel", "block", "h.*").withColumnsRenamed({"line_no": "head", "at": "column"})
    inside = rows.join(head, ["rel", "block"]).where("line_no > head").select("section", F.get("c", F.col("column") - 1).alias("cell"))
    layer = R.choose([(F.col("section") == k, v) for k, v in sections.items()])
    return inside.select(layer.alias("layer"), F.explode(F.regexp_extract_all("cell", F.lit("`([a-z][a-z0-9-]+)`"), 1)).alias("name")).where("layer IS NOT NULL")


def registry_sync(names: DataFrame, hard: DataFrame, soft: DataFrame | None) -> DataFrame:
    """(layer, name, level) of registered names (layer, name) that are not installed: L2 against hard (name) is an error, L1 against soft a warning, or skipped without it."""
    names = names.distinct()
    missing = names.where("layer = 'L2'").join(hard, "name", "left_anti").select("layer", "name", F.lit("ERROR").alias("level"))
    if soft is None:
        return missing
    return missing.unionByName(names.where("layer = 'L1'").join(soft, "name", "left_anti").select("layer", "name", F.lit("WARN").alias("level")))


def triage(drafts: DataFrame, threshold: int = 14) -> DataFrame:
    """(part, value, n) of drafts (rel, age_days, type, tags, promoted_to): totals, age tiers, languages, topics and destinations.

    A draft counts under each of its languages and topics, or under the name of none. All parts come from one pass.
    """
    rows = drafts.join(inbox.destinations(drafts), "rel")
    names = lambda space, none: F.when(F.size(inbox.tagged(F.col("tags"), space)) > 0, inbox.tagged(F.col("tags"), space)).otherwise(F.array(F.lit(none)))
    age = F.greatest(F.col("age_days"), F.lit(0))
    entry = lambda part, value: F.struct(F.lit(part).alias("part"), value.alias("value"))
    each = F.concat(
        F.array(entry("total", F.lit("drafts")), entry("total", F.when(age >= threshold, "overdue").otherwise("fresh")), entry("tier", R.age_tier(age)), entry("destination", F.col("destination"))),
        F.transform(names("lang", "generic / unassigned"), lambda v: entry("lang", v)), F.transform(names("topic", "general"), lambda v: entry("topic", v)),
    )
    return rows.select(F.explode(each).alias("e")).groupBy("e.part", "e.value").agg(F.count("*").alias("n"))


def lint(lines: DataFrame, files: DataFrame, tokens: list[str], patterns: list[tuple[str, str]], endings: list[str], skipped: list[str] = (), allowed: list[str] = ()) -> DataFrame:
    """(rel, line_no, kind, detail) of an export's lines (rel, line_no, line): forbidden tokens in any case, (reason, pattern) hits, and paths in code marks that are not there.

    files: rel of what is there. skipped: paths without token and path checks; allowed: prefixes of paths that may be missing.
    """
    exempt = F.col("rel").isin(list(skipped)) if skipped else F.lit(False)
    low = F.lower("line")
    entry = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    hits = [F.when(~exempt & F.contains(low, F.lit(t.lower())), entry("token", F.lit(t))) for t in dict.fromkeys(tokens) if t] + [F.when(F.col("line").rlike(f"(?i){p}"), entry("pattern", F.lit(why or p))) for why, p in patterns]
    found = [lines.select("rel", "line_no", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("x")).select("rel", "line_no", "x.*")] if hits else []
    path = lines.where(~exempt).select("rel", "line_no", F.explode(F.regexp_extract_all("line", F.lit("`([^`\\s]+)`"), 1)).alias("detail")).where(F.contains("detail", F.lit("/")) & ending(F.col("detail")).isin(endings))
    path = reduce(lambda d, p: d.where(~F.startswith("detail", F.lit(p))), allowed, path)
    found.append(path.join(files.select(F.col("rel").alias("detail")).distinct(), "detail", "left_anti").select("rel", "line_no", F.lit("path").alias("kind"), "detail"))
    return reduce(DataFrame.unionByName, found)


def route_targets(routes: DataFrame, files: DataFrame) -> DataFrame:
    """(tag, problem) of routes as in consolidate.plan: a target of the kind that is not named, or is not there.

    files: rel of files; standards, cheatsheet and target are files, target_dir a folder, target_project a folder below 08-Projects.
    """
    from corvane.operators.consolidate import ROUTE_TARGETS

    folder = lambda c: F.concat(F.regexp_replace(c, "/+$", ""), F.lit("/"))
    place = {"target_dir": folder(F.col("target_dir")), "target_project": F.concat(F.lit("08-Projects/"), folder(F.col("target_project")))}
    wanted = R.choose([(F.col("type") == k, F.array(*[F.struct(F.lit(c).alias("key"), F.nullif(F.coalesce(c, F.lit("")), F.lit("")).alias("named"), place.get(c, F.col(c)).alias("place")) for c in v])) for k, v in ROUTE_TARGETS.items()])
    unknown = routes.where(~F.coalesce(F.col("type").isin(*ROUTE_TARGETS), F.lit(False))).select("tag", F.lit("type").alias("problem"))
    rows = routes.select("tag", F.explode(wanted).alias("w")).select("tag", "w.*")
    parts = F.split("rel", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    there = files.select("rel", F.explode(F.concat(F.array("rel"), F.when(F.size(parts) > 1, above).otherwise(F.expr(T.EMPTY)))).alias("place")).select("place").distinct()
    unnamed = rows.where("named IS NULL").select("tag", F.concat(F.lit("missing "), "key").alias("problem"))
    lost = rows.where("named IS NOT NULL").join(there, "place", "left_anti").select("tag", F.concat(F.lit("no "), "named").alias("problem"))
    return unknown.unionByName(unnamed).unionByName(lost)


def export_package(files: DataFrame, fates: list[tuple[str, list[str]]], replacements: list[tuple[str, str]]) -> DataFrame:
    """(rel, content, n_repaired, n_replaced) of the files (rel, content) that an export keeps.

    Kept are those whose first fate is keep; of structure ones only the place stays, with no content. Links to what is left
    out become text, then the literal replacements are made in order.
    """
    rows = files.select("rel", R.fate(F.col("rel"), fates).alias("fate"), "content").where("fate IN ('keep', 'structure')")
    kept = rows.where("fate = 'keep'").select("rel", "content")
    repaired = export.neutralise_links(kept, export.known_targets(rows.select("rel")))
    text, n = T.deidentify(F.col("content"), replacements)
    done = repaired.select("rel", text.alias("content"), "n_repaired", n.alias("n_replaced"))
    return done.unionByName(rows.where("fate = 'structure'").select("rel", F.lit(None).cast("string").alias("content"), F.lit(0).cast("long").alias("n_repaired"), F.lit(0).cast("long").alias("n_replaced")))


def ledger_gate(records: DataFrame) -> DataFrame:
    """One row (notes, illegal, all_unknown, passed): a ledger fails on any illegal value, and if no note of some has an authority."""
    stats = ledger.statistics(records).select(F.col("total").alias("notes"), ((F.col("total") > 0) & (F.col("unknown") == F.col("total"))).alias("all_unknown"))
    illegal = ledger.illegal_values(records).agg(F.count("*").alias("illegal"))
    rows = stats.join(illegal, F.lit(True))  # one row beside one row
    return rows.select("notes", "illegal", "all_unknown", ((F.col("illegal") == 0) & ~F.col("all_unknown")).alias("passed"))


def claims(lines: DataFrame, most: int = 20) -> DataFrame:
    """(rel, line_no, line): of each note (rel, line_no, line, in_fence) the first claims outside fences; the limit is the ledger's."""
    place = F.row_number().over(Window.partitionBy("rel").orderBy("line_no"))
    rows = lines.where(~F.col("in_fence") & R.is_claim(F.col("line"))).withColumn("i", place)
    return rows.where(F.col("i") <= most).select("rel", "line_no", F.trim("line").alias("line"))


def dual_version(a: Column, b: Column) -> Column:
    """Whether two paths of one folder are the long and the short form of a standard."""
    name = lambda c: F.upper(F.regexp_replace(F.substring_index(c, "/", -1), "\\.[^.]*$", ""))
    folder = lambda c: F.regexp_extract(c, "^(.*)/", 1)
    long_, short = (lambda c, w=w: F.contains(name(c), F.lit(w)) for w in ("STANDARDS", "CHEATSHEET"))
    return (folder(a) == folder(b)) & ((long_(a) & short(b)) | (short(a) & long_(b)))


def duplicate_report(pairs: DataFrame) -> DataFrame:
    """(a, b, ratio, advice) of similar pairs (a, b, ratio): the two forms of a standard are expected to be alike."""
    return pairs.select("a", "b", "ratio", F.when(dual_version(F.col("a"), F.col("b")), "pair").otherwise(F.coalesce(R.duplicate_advice(F.col("ratio")), F.lit("none"))).alias("advice"))


def work_log(events: DataFrame, files: DataFrame, most: int = 4096) -> DataFrame:
    """(project, notice) for projects with work logs, never a failure: no index, no log, an event over the limit, a start that is still open.

    events: project, id, type (START or END), bytes; files: project, name.
    """
    names = files.groupBy("project").agg(F.collect_set("name").alias("n"))
    lacking = names.select("project", F.explode(F.filter(F.array(F.when(~F.array_contains("n", "INDEX.md"), F.lit("no index")), F.when(~F.array_contains("n", "LOG.md"), F.lit("no log"))), lambda x: x.isNotNull())).alias("notice"))
    large = events.where(F.col("bytes") > most).select("project", F.concat(F.lit("large event "), F.col("id").cast("string")).alias("notice"))
    last = events.groupBy("project").agg(F.max_by("type", "id").alias("type")).where("type = 'START'").select("project", F.lit("open start").alias("notice"))
    return lacking.unionByName(large).unionByName(last)
