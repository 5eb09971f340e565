"""Data-quality rules: each is one predicate that gives rows (rel, level, category, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import rules as R


def _issue(notes: DataFrame, test: Column, level: str, category: str, message: Column | str) -> DataFrame:
    message = F.lit(message) if isinstance(message, str) else message
    return notes.where(test).select("rel", F.lit(level).alias("level"), F.lit(category).alias("category"), message.alias("message"))


def _entry(level: str, category: str, message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), message.alias("message"))


def _when(test: Column, level: str, category: str, message: Column | str) -> Column:
    """An array of one issue if the test holds, else null."""
    return F.when(test, F.array(_entry(level, category, message)))


def _each(items: Column, test, level: str, category: str, message) -> Column:
    """An issue for each item that a test holds for."""
    return F.transform(F.filter(items, test), lambda x: _entry(level, category, message(x)))


def _all(notes: DataFrame, found: list[Column]) -> DataFrame:
    """The issues of every note in one pass over them; each rule is an array, and one without issues may be null."""
    none = F.slice(F.array(_entry("", "", "")), 2, 1)
    return notes.select("rel", F.explode(F.concat(*[F.coalesce(f, none) for f in found])).alias("x")).select("rel", "x.*")


def note_issues(notes: DataFrame) -> DataFrame:
    """Issues of notes (rel, fields MAP, tags ARRAY, audience ARRAY): missing fields, illegal values, tag form, dates, names."""
    value = lambda f: F.element_at("fields", f)
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    name = F.substring_index("rel", "/", -1)
    after = lambda text: lambda x: F.concat(F.lit(text), x)
    slash = lambda x: F.contains(x, F.lit("/"))
    return _all(notes, [
        *[_when(blank(value(f)), "ERROR", "FRONTMATTER", f"missing {f}") for f in R.REQUIRED_FIELDS],
        _when(~blank(value("status")) & ~value("status").isin(R.STATUSES), "ERROR", "FRONTMATTER", F.concat(F.lit("status "), value("status"))),
        _when(~blank(value("type")) & ~value("type").isin(R.TYPES), "WARN", "FRONTMATTER", F.concat(F.lit("type "), value("type"))),
        _each(F.col("audience"), lambda x: ~x.isin(R.AUDIENCES), "WARN", "FRONTMATTER", after("audience ")),
        _each(F.col("tags"), lambda x: ~slash(x), "WARN", "TAG", after("tag form ")),
        _each(F.col("tags"), lambda x: slash(x) & ~F.substring_index(x, "/", 1).isin(R.TAG_NAMESPACES), "WARN", "TAG", after("tag space ")),
        *[_when(~blank(value(f)) & ~value(f).rlike("^\\d{4}-\\d{2}-\\d{2}$"), "WARN", "FRONTMATTER", F.concat(F.lit(f"{f} "), value(f))) for f in ("created", "updated")],
        _when(name.rlike('[<>:"\\\\|?*]'), "ERROR", "NAMING", "illegal character"),
        _when(name.contains(" "), "WARN", "NAMING", "space"),
    ])


def stale(notes: DataFrame, grace: int = 2) -> DataFrame:
    """Changed notes (rel, updated DATE, mtime DATE, dirty BOOLEAN) whose update field lags by more than the grace."""
    lag = F.date_diff("mtime", "updated")
    return _issue(notes, F.col("dirty") & (lag > grace), "WARN", "FRESHNESS", F.concat(lag.cast("string"), F.lit(" days")))


def summary(notes: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: files, errors, warnings and score = max(0, 100 - (5 errors + warnings) / files * 10)."""
    counts = issues.agg(F.count_if(F.col("level") == "ERROR").alias("errors"), F.count_if(F.col("level") == "WARN").alias("warnings"))
    files = notes.agg(F.count("*").alias("files"))
    score = F.greatest(F.lit(0.0), 100 - (5 * F.col("errors") + F.col("warnings")) / F.greatest(F.lit(1), F.col("files")) * 10)
    return files.join(counts, F.lit(True)).select("files", "errors", "warnings", F.round(score, 1).alias("score"))  # one row beside one row


def paired(notes: DataFrame, left: str, right: str) -> DataFrame:
    """(key, left_rel, right_rel) of notes (key, kind, rel): a full outer join, so that one-sided pairs show a null."""
    side = lambda k: notes.where(F.col("kind") == k).select("key", F.col("rel").alias(f"{k}_rel"))
    return side(left).join(side(right), "key", "full_outer")


def misaligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, pos, left_title, right_title) of heading lists (key, titles ARRAY) that differ at a position."""
    flat = lambda d, n: d.select("key", F.posexplode("titles").alias("pos", n))
    both = flat(left, "left_title").join(flat(right, "right_title"), ["key", "pos"], "full_outer")
    return both.where(~F.col("left_title").eqNullSafe(F.col("right_title")))


def drift(one: DataFrame, two: DataFrame) -> DataFrame:
    """(side, columns...): rows that only one of two tables of equal columns has."""
    return one.subtract(two).select(F.lit("first").alias("side"), "*").unionByName(two.subtract(one).select(F.lit("second").alias("side"), "*"))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def suspicious_urls(rows: DataFrame) -> DataFrame:
    """(id, url, param, reason): credential-like parameter names, and values of 16-64 characters, three classes and three bits.

    rows: id, url. Query and fragment parameters count; trusted hosts are spared the entropy rule only.
    """
    from corvane.functions.text import entropy

    query = F.regexp_extract("url", "\\?([^#]*)", 1)
    fragment = F.regexp_extract("url", "#(.*)$", 1)
    host = F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1))
    pairs = F.filter(F.concat(F.split(query, "&"), F.split(fragment, "&")), lambda x: F.contains(x, F.lit("=")))
    rows = rows.select("id", "url", host.alias("host"), F.explode(pairs).alias("p"))
    value = F.regexp_replace("p", "^[^=]*=", "")
    rows = rows.select("id", "url", "host", F.substring_index("p", "=", 1).alias("name"), value.alias("value"))
    classes = sum((F.col("value").rlike(c).cast("int") for c in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]")), F.lit(0))
    named = F.lower("name").isin(R.CREDENTIAL_NAMES)
    random = F.length("value").between(16, 64) & (classes >= 3) & (entropy(F.col("value")) >= 3.0) & ~F.col("host").isin(R.TRUSTED_HOSTS)
    reason = F.concat_ws("; ", F.when(named, "credential name"), F.when(random, "high-entropy value"))
    return rows.where(named | random).select("id", "url", F.when(named, F.col("name")).otherwise("<high-entropy-value>").alias("param"), reason.alias("reason"))


def name_issues(notes: DataFrame) -> DataFrame:
    """Issues of file names of notes (rel): illegal characters, spaces, language files, date prefixes, and drafts' forms in formal folders."""
    name = F.substring_index("rel", "/", -1)
    under = lambda *dirs: reduce(lambda a, d: a | F.col("rel").startswith(f"{d}/"), dirs, F.lit(False))
    loose = under("99-Inbox", "10-Daily", "Templates", "11-Agents")
    lang = F.get(F.split("rel", "/"), F.lit(1))
    dated = name.rlike("^\\d{4}-\\d{2}-\\d{2}")
    issue = lambda test, level, message: _when(test, level, "NAMING", message)
    found = [
        _each(F.split(name, ""), lambda c: c.isin(*'<>:"|?*'), "ERROR", "NAMING", lambda c: F.concat(F.lit("character "), c)),
        issue(name.contains(" ") & ~under("10-Daily", "Templates"), "WARN", "space"),
        issue(under("99-Inbox") & (name != "README.md") & ~name.rlike("^\\d{4}-\\d{2}-\\d{2}-"), "WARN", "draft without date"),
        issue(under("10-Daily") & (name != "README.md") & ~dated, "WARN", "daily without date"),
        issue(~loose & dated, "ERROR", "dated name"), issue(~loose & name.rlike("[（）]"), "ERROR", "full-width parentheses"),
    ]
    for kind in ("STANDARDS", "CHEATSHEET"):
        wanted = F.concat(F.upper(lang), F.lit(f"-{kind}.md"))
        off = F.lower(F.regexp_replace(name, "\\.[^.]*$", "")).contains(f"-{kind.lower()}") & (name != wanted) & (name != F.concat(lang, F.lit(f"-{kind}.md")))
        found.append(issue(under("03-Languages") & (F.size(F.split("rel", "/")) >= 3) & off, "WARN", F.concat(F.lit("expected "), wanted)))
    return _all(notes, found)


def pair_issues(pairs: DataFrame) -> DataFrame:
    """(key, level, message) of pairs (key, left and right STRUCT<rel, content, numbers, updated, mtime>) of a long and a short form.

    numbers are the section numbers of the second-level headings. One side missing, other counts, other numbers at a
    place, a long form that changed later while they differ, and references that are missing.
    """
    side = lambda s, f: F.col(f"{s}.{f}")
    stem = lambda s: F.regexp_replace(F.substring_index(side(s, "rel"), "/", -1), "\\.md$", "")
    both = F.col("left").isNotNull() & F.col("right").isNotNull()
    shorter = F.least(F.size(side("left", "numbers")), F.size(side("right", "numbers")))
    differ = F.filter(F.transform(F.arrays_zip(F.slice(side("left", "numbers"), F.lit(1), shorter), F.slice(side("right", "numbers"), F.lit(1), shorter)), lambda z, i: F.struct((i + 1).alias("at"), z["0"].eqNullSafe(z["1"]).alias("same"))), lambda x: ~x["same"])
    counts = F.size(side("left", "numbers")) != F.size(side("right", "numbers"))
    later = (F.unix_timestamp(side("left", "mtime")) - F.unix_timestamp(side("right", "mtime")) > 300) | F.coalesce(side("left", "updated") > side("right", "updated"), F.lit(False))
    entry = lambda test, level, m: F.when(test, F.array(F.struct(F.lit(level).alias("level"), (F.lit(m) if isinstance(m, str) else m).alias("message"))))
    found = [
        entry(F.col("right").isNull(), "WARN", "no short form"), entry(F.col("left").isNull(), "WARN", "no long form"),
        entry(both & counts, "ERROR", "section count"),
        F.when(both, F.transform(differ, lambda x: F.struct(F.lit("ERROR").alias("level"), F.concat(F.lit("section number at "), x["at"].cast("string")).alias("message")))),
        entry(both & later & (counts | (F.size(differ) > 0)), "WARN", "drift"),
        entry(both & ~F.contains(side("right", "content"), stem("left")), "WARN", "short form does not name the long form"),
        entry(both & ~F.contains(side("left", "content"), stem("right")), "WARN", "long form does not name the short form"),
    ]
    none = F.slice(F.array(F.struct(F.lit("").alias("level"), F.lit("").alias("message"))), 2, 1)
    return pairs.select("key", F.explode(F.concat(*[F.coalesce(f, none) for f in found])).alias("x")).select("key", "x.*")


def entry_states(entries: DataFrame, truth: DataFrame) -> DataFrame:
    """(rel, state) of entries (rel, content BINARY or null, link BOOLEAN) against one true file (content): missing, symlink, copy or mismatch."""
    one = truth.select(F.sha2("content", 256).alias("digest"))
    rows = entries.join(one, F.lit(True), "left")  # one row beside each
    state = R.choose([(F.col("content").isNull(), "missing"), (~F.sha2("content", 256).eqNullSafe(F.col("digest")), "mismatch"), (F.col("link"), "symlink")], "copy")
    return rows.select("rel", state.alias("state"))


def first_with(lines: DataFrame, words: list[str]) -> DataFrame:
    """(rel, line_no, word): the first line of each note that has one of the words, such as old folder names."""
    hits = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains("line", w))
    return lines.where(F.size(hits) > 0).groupBy("rel").agg(F.min(F.struct("line_no", F.get(hits, F.lit(0)).alias("word"))).alias("m")).select("rel", "m.line_no", "m.word")


def sizes(notes: DataFrame, most: int = 10240) -> DataFrame:
    """(rel, bytes, percent, ok) of notes (rel, content) against a limit in bytes."""
    n = F.octet_length("content")
    return notes.select("rel", n.cast("long").alias("bytes"), F.round(n * 100.0 / most, 1).alias("percent"), (n <= most).alias("ok"))


def unregistered(registry: DataFrame, installed: DataFrame) -> DataFrame:
    """(name) of a registry that are not installed."""
    return registry.select("name").distinct().join(installed.select("name").distinct(), "name", "left_anti")


def healthy(results: DataFrame, advisory: list[str]) -> DataFrame:
    """One row (healthy): whether all checks (name, ok) but the advisory ones hold; with none it is true."""
    return results.where(~F.col("name").isin(advisory)).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("healthy"))
