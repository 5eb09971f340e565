"""Drafts to their places: validated routes, a plan with target paths, and the texts that executing it would write."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import rules as R
from corvane.functions import text as T
from corvane.operators import inbox

# Kinds of routes and the target that each must name.
ROUTE_TARGETS = {"dual": ["standards", "cheatsheet"], "rule-append": ["target"], "source-article": ["target_dir"], "project": ["target_project"]}


def route_form_problems(routes: DataFrame) -> DataFrame:
    """(tag, problem) of routes (tag, type, name, standards, cheatsheet, target, target_dir, target_project), the first of each row; then repeated tags.

    tag form (namespace/name), type not one of the kinds, no name, and targets of the kind that are missing or empty.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    lacking = R.choose([(F.col("type") == k, F.filter(F.array(*[F.when(blank(c), F.lit(c)) for c in v]), lambda c: c.isNotNull())) for k, v in ROUTE_TARGETS.items()], F.expr(T.EMPTY))
    tag = F.coalesce("tag", F.lit(""))
    formed = F.contains(tag, F.lit("/")) & ~F.startswith(tag, F.lit("/")) & ~F.endswith(tag, F.lit("/"))
    problem = R.choose([
        (~formed, F.lit("tag form")), (~F.coalesce(F.col("type").isin(*ROUTE_TARGETS), F.lit(False)), F.lit("type")), (blank("name"), F.lit("name")),
        (F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ", "))),
    ])
    own = routes.select("tag", problem.alias("problem")).where("problem IS NOT NULL")
    return own.unionByName(routes.groupBy("tag").count().where("count > 1 AND tag IS NOT NULL").select("tag", F.lit("repeated").alias("problem")))


def plan(drafts: DataFrame, routes: DataFrame, fallback: DataFrame) -> DataFrame:
    """(rel, title, matched_tag, kind, name, target_path, cheatsheet, action) of drafts (rel, title, type, tags).

    The route of the first tag, in the draft's order, that has one; else the fallback of its type, else the default one.
    routes: tag and the columns of route_form_problems; fallback: the same with type_of, the draft type, for tag.
    """
    columns = ["type", "name", "standards", "cheatsheet", "target", "target_dir", "target_project"]
    goal = F.struct(*columns).alias("goal")
    tagged = drafts.select("rel", F.posexplode("tags").alias("at", "tag")).join(routes.select("tag", goal), "tag")
    first = tagged.groupBy("rel").agg(F.min_by(F.struct("tag", "goal"), "at").alias("m"))
    other = fallback.select(F.col("type_of").alias("type"), F.struct(*columns).alias("of_type"))
    default = fallback.where("type_of = 'default'").select(F.struct(*columns).alias("of_default"))
    rows = drafts.select("rel", "title", F.coalesce("type", F.lit("source-notes")).alias("type")).join(first, "rel", "left").join(other, "type", "left").join(default, F.lit(True), "left")  # one default
    rows = rows.select("rel", "title", F.col("m.tag").alias("matched_tag"), F.coalesce("m.goal", "of_type", "of_default").alias("g"))
    file = F.concat(T.upper_slug(F.col("title")), F.lit(".md"))
    path = R.choose([
        (F.col("g.type") == "dual", F.col("g.standards")), (F.col("g.type") == "rule-append", F.col("g.target")),
        (F.col("g.type") == "source-article", F.concat("g.target_dir", F.lit("/"), file)), (F.col("g.type") == "project", F.concat(F.lit("08-Projects/"), "g.target_project", F.lit("/"), file)),
    ])
    action = R.choose([(F.col("g.type") == "dual", "dual-append"), (F.col("g.type") == "rule-append", "append"), (F.col("g.type").isin("source-article", "project"), "create")], "skip")
    return rows.select("rel", "title", "matched_tag", F.col("g.type").alias("kind"), F.col("g.name").alias("name"), path.alias("target_path"), F.col("g.cheatsheet").alias("cheatsheet"), action.alias("action"))


def appendix(title: Column, body: Column, rel: Column, day: Column) -> Column:
    """What a draft adds to a file: a rule, its title, its source and date, and its body."""
    return F.concat(F.lit("\n\n---\n\n#### "), title, F.lit("\n\n> 来源: `"), rel, F.lit("` | 日期: "), F.date_format(day, "yyyy-MM-dd"), F.lit("\n\n"), body, F.lit("\n"))


def body_of(content: Column) -> Column:
    """What stands behind the first two ---, without white space around it; the whole content if it does not begin with one or has no second."""
    parts = F.split(content, "---", 3)
    return F.when(F.startswith(content, F.lit("---")) & (F.size(parts) == 3), F.regexp_replace(F.get(parts, F.lit(2)), "^\\s+|\\s+$", "")).otherwise(content)


def pieces(planned: DataFrame, drafts: DataFrame, files: DataFrame, day: Column) -> DataFrame:
    """(target_path, at, text, n_drafts) of every file that executing a plan would write: its content is its texts in the order of (at, text).

    planned: from plan(); drafts: (rel, content); files: (rel, content) as they are. Drafts are added to their target in the order
    of rel, behind what it has or behind a heading of its own, which has a null at; of drafts that create one file the last by rel stays,
    with its status set to stable. No row holds more than one draft or file, and no grouping more than one text.
    """
    rows = planned.where("action <> 'skip'")
    head = R.choose([(F.col("action") == "dual-append", F.concat(F.lit("# "), F.upper("name"), F.lit(" Standards\n"))), (F.col("action") == "append", F.concat(F.lit("# "), "name", F.lit("\n")))], "")
    # what a file is made of is known without the texts, which then come once, to the rows that need them
    made = rows.join(drafts.select("rel"), "rel").groupBy("target_path").agg(F.min(head).alias("head"), F.max(F.col("action") == "create").alias("creates"), F.max("rel").alias("last"), F.count("*").alias("n_drafts"))
    needed = rows.join(made.drop("head"), "target_path").where("NOT creates OR rel = last").join(drafts.select("rel", "content"), "rel")
    added = appendix(F.col("title"), body_of(F.col("content")), F.col("rel"), day)
    text = F.when(F.col("action") == "create", inbox.upsert_field(F.col("content"), "status", "stable")).otherwise(added)
    texts = needed.select("target_path", "rel", "creates", "n_drafts", text.alias("text"))
    own = texts.where("NOT creates").select("target_path", F.col("rel").alias("at"), "text", "n_drafts")
    new = texts.where("creates").groupBy("target_path").agg(F.max("rel").alias("at"), F.max("text").alias("text"), F.max("n_drafts").alias("n_drafts"))
    before = made.where("NOT creates").join(files.select(F.col("rel").alias("target_path"), F.col("content").alias("before")), "target_path", "left")
    first = before.select("target_path", F.lit(None).cast(drafts.schema["rel"].dataType).alias("at"), F.coalesce("before", "head").alias("text"), "n_drafts")
    return first.unionByName(own).unionByName(new)


def rendered(planned: DataFrame, drafts: DataFrame, files: DataFrame, day: Column) -> DataFrame:
    """(target_path, content, n_drafts) of every file of pieces() as one text each, for files that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct(F.col("at").isNotNull().alias("k"), "at", "text")))
    made = pieces(planned, drafts, files, day).groupBy("target_path").agg(parts.alias("parts"), F.max("n_drafts").alias("n_drafts"))
    texts = F.transform("parts", lambda p: p["text"])
    return made.select("target_path", F.when(F.exists(texts, lambda t: t.isNotNull()), F.array_join(texts, "")).alias("content"), "n_drafts")


def digests(pieces: DataFrame, slice_bytes: int = 1 << 20) -> DataFrame:
    """(target_path, n_drafts, digest): the MD5 of every file of pieces(), however long it is.

    All cores sort pieces by range and join neighbours to slices of about slice_bytes. MD5 goes through a file in order, so the slices of one
    file stream through one task, which holds a slice at a time.
    """
    order = ["target_path", F.col("at").asc_nulls_first(), "text"]
    kind, slices = pieces.schema["target_path"].dataType.simpleString(), "target_path {}, n_drafts long, part int, slice int, data binary"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, number = None, [], 0, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, number, b"".join(x for x in held if x is not None) if any(x is not None for x in held) else None), (*kinds, pa.int32(), pa.binary()))], names=["target_path", "n_drafts", "part", "slice", "data"])

        for batch in batches:
            kinds = [c.type for c in batch.columns[:3]]
            for *now, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (now != key or size >= slice_bytes):
                    yield done()
                    held, size, number = [], 0, number + 1
                key = now
                held.append(text)
                size += len(text or b"")
        if held:
            yield done()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            kinds = [c.type for c in batch.columns[:2]]
            for i in range(batch.num_rows):
                now = [batch.column(0)[i].as_py(), batch.column(1)[i].as_py()]
                if now != key:
                    if key is not None:
                        yield result(key, state, kinds)
                    key, state = now, None
                if batch.column(2)[i].is_valid:  # a file of null texts only has no digest
                    state = state or hashlib.md5()
                    state.update(batch.column(2)[i].as_buffer())
        if key is not None:
            yield result(key, state, kinds)

    def result(key: list, state, kinds: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, state and state.hexdigest()), (*kinds, pa.string()))], names=["target_path", "n_drafts", "digest"])

    # ranges without the text, as the driver gets a sample of what they are made by; equal keys stay together
    ranged = pieces.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("target_path", "n_drafts", F.spark_partition_id().alias("part"), F.encode("text", "UTF-8").alias("text"))
    joined = ranged.mapInArrow(join, slices.format(kind))
    return joined.repartition("target_path").sortWithinPartitions("target_path", "part", "slice").select("target_path", "n_drafts", "data").mapInArrow(digest, f"target_path {kind}, n_drafts long, digest string")


def session_summary(drafts: DataFrame, limit: int = 14) -> DataFrame:
    """One row (drafts, overdue) of drafts (rel, age_days): what the end of a session reports."""
    return drafts.agg(F.count("*").alias("drafts"), F.count_if(F.greatest("age_days", F.lit(0)) >= limit).alias("overdue"))
