"""Operators on notes, CJK text and logs, on small fixtures with hand-computed results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.functions import rules as R
from corvane.functions import text as T
from corvane.operators import activity, checks, conflicts, graph, ledger, notes, search, similarity
from corvane.sources import readers

NOTE = """---
title: Alpha
tags: [lang/go, topic/x]
---
intro [[docs/simple]] and [[a/b.md#part|alias]] and [[YYYY-MM-DD]]
# One
text #topic/cache more
```
# not a heading
[[hidden]]
```
## 2.1 Two
必须加锁 `[[code]]`
### Three
deep
## Four
end"""


@pytest.fixture(scope="module")
def vault(spark):
    return spark.createDataFrame([("01-Rules/alpha.md", NOTE), ("empty.md", ""), ("crlf.md", "---\r\nTitle: B\r\n---\r\nbody\r\n")], "rel string, content string")


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_index_tokens(spark):
    assert one(spark, T.index_tokens, "Use std.vector, 并发场景 锁 三个字") == ["use", "std.vector", "std", "vector", "并发场景", "并发", "场景", "并", "发", "场", "景", "锁", "锁", "三个字", "三个", "个字", "三", "个", "字"]


def test_conflict_tokens(spark):
    assert one(spark, lambda c: T.conflict_tokens(c, ["the"], ["缓存"]), "The Lock 缓存加") == ["lock", "存加", "缓存加"]


def test_node_ids(spark):
    assert one(spark, T.node_id, "01-Rules/alpha.md") == "node_01_rules_alpha_md_4faa09"
    assert len(one(spark, T.node_id, "x/" * 60)) <= 40


@pytest.mark.parametrize("raw,want", [("docs/simple|x", "docs/simple"), ("a\\|b", "a"), ("a/b/#part", "a/b"), ("v5.0.1", "v5.0.1")])
def test_link_targets(spark, raw, want):
    assert one(spark, T.link_target, raw) == want


@pytest.mark.parametrize("target,want", [("RAW-YYYY-MM-DD", True), ("{{x}}", True), ("<x>", True), ("2026-01-01", False), ("..", True)])
def test_placeholders(spark, target, want):
    assert one(spark, T.is_placeholder, target) is want


@pytest.mark.parametrize("clause,want", [("缓存必须加锁", "positive"), ("禁止无锁", "negative"), ("you must not", "negative"), ("you must", "positive"), ("mustard", None), ("MUST", None), ("是否", None)])
def test_polarity(spark, clause, want):
    assert one(spark, R.polarity, clause) == want


def test_sections_headings_and_links(spark, vault):
    got = [(r.section, r.level, r.heading) for r in notes.sections(vault).where("rel = '01-Rules/alpha.md'").orderBy("section").collect()]
    assert got == [(0, None, None), (1, 1, "One"), (2, 1, "not a heading"), (3, 2, "2.1 Two"), (4, 3, "Three"), (5, 2, "Four")]
    assert [(r.level, r.title, r.number) for r in notes.headings(vault).orderBy("line_no").collect()] == [(1, "One", None), (2, "2.1 Two", "2.1"), (3, "Three", None), (2, "Four", None)]
    assert sorted(r.target for r in notes.links(vault).collect()) == ["a/b.md", "docs/simple"]
    assert notes.snippet(notes.sections(vault), "two").first().text == "## 2.1 Two\n必须加锁 `[[code]]`\n### Three\ndeep"


def test_fields_tags_titles(spark, vault):
    assert notes.fields(vault).where("rel = '01-Rules/alpha.md'").first().fields == {"title": "Alpha", "tags": "[lang/go, topic/x]"}
    assert notes.inline_tags(vault).where("rel = '01-Rules/alpha.md'").first().tags == ["topic/cache"]
    assert {r.rel: r.title for r in notes.titles(vault).collect()} == {"01-Rules/alpha.md": "Alpha", "empty.md": "empty", "crlf.md": "B"}


def test_resolution_prefers_paths(spark):
    files = spark.createDataFrame([("docs/simple.md",), ("other/simple.md",), ("docs/V5.0.1.md",)], "rel string")
    links = spark.createDataFrame([("n", t) for t in ("docs/simple", "simple", "V5.0.1", "docs/NO")], "rel string, target string")
    assert {r.target: r.found for r in graph.resolve(links, graph.file_keys(files)).collect()} == {"docs/simple": "docs/simple.md", "simple": "docs/simple.md", "V5.0.1": "docs/V5.0.1.md", "docs/NO": None}


def test_conflicts(spark):
    rows = [("a", 0, "positive", ["topic/x"], ["缓存", "加锁"]), ("b", 0, "negative", ["topic/x"], ["缓存"]), ("c", 0, "positive", ["topic/x"], ["缓存"]), ("d", 0, "negative", ["topic/y"], ["缓存"])]
    df = spark.createDataFrame(rows, "rel string, idx int, polarity string, tags array<string>, tokens array<string>")
    assert [(r.rel_a, r.rel_b, r.tag, r.score) for r in conflicts.candidates(df).orderBy("rel_a").collect()] == [("a", "b", "topic/x", 1), ("b", "c", "topic/x", 1)]


def test_ledger(spark):
    rows = [("01-Rules/s.md", "X", "official", "high", "reviewed"), ("06-Sources/u.md", "Y", None, None, None), ("08-Projects/p.md", "X", "synthetic", "bogus", "unreviewed")]
    df = spark.createDataFrame(rows, "rel string, source string, authority string, claim_risk string, review_status string")
    assert ledger.statistics(df).first().asDict() == {"total": 3, "with_authority": 2, "official": 1, "primary": 0, "secondary": 0, "community": 0, "synthetic": 1, "unknown": 1}
    assert sorted(map(tuple, ledger.sources(df).collect())) == [("X", 2, "official", 1, ["01-Rules", "08-Projects"]), ("Y", 1, "unknown", 0, ["06-Sources"])]
    assert [tuple(r) for r in ledger.illegal_values(df).collect()] == [("08-Projects/p.md", "claim_risk", "bogus")]


def test_backfill(spark):
    rows = [("01-Rules/E.md", None), ("06-Sources/Books/B.md", "primary"), ("10-Daily/2026-09-09.md", None)]
    none = F.lit(None).cast("string")
    df = spark.createDataFrame(rows, "rel string, authority string").select("rel", "authority", *[none.alias(c) for c in ("type", "title", "source_type", "source_author", "claim_risk", "review_status")], F.lit(None).cast("array<string>").alias("tags"))
    assert {r.rel: r.adds for r in ledger.backfill(df).collect()} == {
        "01-Rules/E.md": ["authority: synthetic", "claim_risk: high", "review_status: unreviewed"],
        "06-Sources/Books/B.md": ["claim_risk: medium", "review_status: unreviewed"],
        "10-Daily/2026-09-09.md": ["authority: unknown", "claim_risk: none", "review_status: unreviewed"],
    }


@pytest.mark.parametrize("query,want", [
    ("a?Token=1", [("Token", "credential name")]), ("a?key=1&sig=2", [("key", "credential name"), ("sig", "credential name")]), ("a?q=aB3dE5gH7jK9mN1p", [("<high-entropy-value>", "high-entropy value")]),
    ("a?q=abcdefghijklmnop", []), ("a?q=aB3dE5gH7jK9mN1", []), ("a?monkey=1", []), ("a#auth=1", [("auth", "credential name")]),
])
def test_suspicious_urls(spark, query, want):
    df = spark.createDataFrame([(1, "https" + "://h.io/" + query)], "id int, url string")
    assert [(r.param, r.reason) for r in checks.suspicious_urls(df).orderBy("param").collect()] == want


def test_trusted_host_skips_entropy(spark):
    df = spark.createDataFrame([(1, "https" + "://fonts.gstatic.com/a?q=aB3dE5gH7jK9mN1p")], "id int, url string")
    assert checks.suspicious_urls(df).count() == 0


@pytest.mark.parametrize("mtime,dirty,want", [("2026-03-11", True, ["10 days"]), ("2026-03-03", True, []), ("2026-03-01", True, []), ("2026-03-11", False, [])])
def test_staleness(spark, mtime, dirty, want):
    df = spark.createDataFrame([("n", "2026-03-01", mtime, dirty)], "rel string, updated string, mtime string, dirty boolean").select("rel", F.to_date("updated").alias("updated"), F.to_date("mtime").alias("mtime"), "dirty")
    assert [r.message for r in checks.stale(df).collect()] == want


def test_days_and_weeks(spark):
    rows = [("2026-08-20 10:00:00",), ("2026-09-01 10:00:00",), ("2026-09-01 11:00:00",), ("2027-01-01 00:00:00",)]
    df = spark.createDataFrame(rows, "ts string").select(F.to_timestamp("ts").alias("ts"))
    assert sorted((str(r.day), r.week, r.n) for r in activity.by_day(df).collect()) == [("2026-08-20", "2026-W34", 1), ("2026-09-01", "2026-W36", 2), ("2027-01-01", "2026-W53", 1)]


def test_streaks(spark):
    days = [dt.date(2026, 1, d) for d in (1, 2, 3, 7, 8)]
    assert activity.streaks(spark.createDataFrame([("k", d) for d in days], "key string, day date")).first()[1:] == (3, 2)


def test_similarity(spark):
    base = "an ordinary sentence about caches and locks that is longer than eighty characters in all, so it counts "
    df = spark.createDataFrame([("a", base), ("b", base.upper()), ("c", base.replace("caches", "queues")), ("d", "short")], "rel string, content string")
    got = {(r.a, r.b): (round(r.ratio, 2), r.advice) for r in similarity.duplicates(df).collect()}
    assert got[("a", "b")] == (1.0, "delete") and got[("a", "c")][1] in ("delete", "merge") and len(got) == 3


def test_search_boosts(spark):
    rows = [("1", "Locks", ["lang/go"], "standards", "locks in go", [(None, "locks in go")]), ("2", "Other", ["lang/cpp"], "notes", "locks in cpp", [("locks", "in cpp")]), ("3", "None", [], "notes", "nothing", [(None, "nothing")])]
    df = spark.createDataFrame(rows, "rel string, title string, tags array<string>, kind string, content string, sections array<struct<heading:string,body:string>>")
    got = search.search(df, "locks", [search.Term("locks")], language="lang/go").collect()
    assert [r.rel for r in got] == ["1", "2"] and got[0].score > got[1].score
    assert search.search(df, "locks", [search.Term("locks")], tag="lang/cpp").first().rel == "2"
    assert [t.text for t in search.expand("cache bug", [search.Term("cache")], [(["cache"], ["redis", "cache"]), (["tree"], ["heap"])])] == ["cache", "redis"]


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "n.md").write_text("| date | what |\n|---|---|\n| 2026-01-01 | x |\n", encoding="utf-8")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.md").write_text("no")
    (tmp_path / "nul.md").write_bytes(b"a\x00b")
    found = readers.read_notes(spark, str(tmp_path))
    assert {r.rel: r.content is None for r in found.collect()} == {"a/n.md": False, "nul.md": True}
    assert [tuple(r) for r in readers.pipe_table(found, ["date", "what"]).collect()] == [("a/n.md", "2026-01-01", "x")]
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO x VALUES (1)"):
        with pytest.raises(ValueError):
            readers.guarded_sql(spark, bad)
    assert readers.guarded_sql(spark, "SELECT * FROM range(100)", 7).count() == 7


def test_stream_counts(spark, sf, tmp_path):
    from corvane.streaming.activity import counts_by_window

    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    q = counts_by_window(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    want = batch.groupBy(F.to_date("ts").alias("d"), "event_type").count()
    got = spark.sql("SELECT to_date(start) AS d, event_type, n FROM counts")
    assert sorted(map(str, got.toDF("d", "event_type", "count").collect())) == sorted(map(str, want.collect()))
