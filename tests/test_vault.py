"""Linker, draft, code, export, pair, lookup and sink operators on small fixtures with hand-computed results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.operators import checks, code, export, inbox, linker, lookup, reports, search
from corvane.sources import sinks

WORDS = [("Cache Lines", "02/cache|Cache Lines", "02/cache.md"), ("cache-lines", "02/cache", "02/cache.md"), ("并发设计", "01/并发", "01/并发.md")]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(WORDS, "term string, target string, source string")


@pytest.mark.parametrize("text,want", [
    ("about cache-lines and cache-lines\n", "about [[02/cache]] and cache-lines\n"),
    ("see [[02/cache]]\ncache-lines\n", None), ("see [[cache#x|y]]\ncache-lines\n", None), ("my-cache-lines\n", None), ("# cache-lines\n```\ncache-lines\n```\n`cache-lines` <!-- -->\n", None),
    ("---\ncache-lines\n---\n谈并发设计\r\nend", "---\ncache-lines\n---\n谈[[01/并发]]\r\nend"), ("", None),
])
def test_link(spark, words, text, want):
    notes = spark.createDataFrame([("n.md", text), ("02/cache.md", "cache-lines"), ("nil.md", None)], "rel string, content string")
    got = {r.rel: r.content for r in linker.link(notes, words).collect()}
    assert got == ({} if want is None else {"n.md": want})


def test_dictionary(spark):
    rows = [("b/alpha.md", "Alpha Note", ["topic/long-name", "x/y"]), ("a/alpha.md", None, None), ("a/the.md", "x" * 41, ["plain-tag"])]
    got = {r.term: r.target for r in linker.dictionary(spark.createDataFrame(rows, "rel string, title string, tags array<string>")).collect()}
    assert got == {"alpha": "a/alpha", "Alpha Note": "b/alpha|Alpha Note", "long-name": "b/alpha"}


def test_fields(spark):
    df = spark.createDataFrame([("---\r\na: 1\r\n---\r\nx",), ("no block",), ("---\nab: 1\na: 2\n---\n",), (None,)], "c string")
    assert [r[0] for r in df.select(inbox.upsert_field(F.col("c"), "a", "9")).collect()] == ["---\r\na: 9\r\n---\r\nx", "no block", "---\nab: 1\na: 9\n---\n", None]
    assert [r[0] for r in df.select(inbox.add_fields(F.col("c"), [("a", "9"), ("z", "0")])).collect()] == ["---\r\na: 1\r\nz: 0\r\n---\r\nx", "no block", "---\nab: 1\na: 2\nz: 0\n---\n", None]


def test_drafts(spark):
    df = spark.createDataFrame([("ab", "y" * 40), ("long title", "short"), ("TODO", "y" * 40), ("good title", "y" * 40), (None, None)], "title string, content string")
    assert [r.refused for r in inbox.admitted(df).collect()] == ["title", "content", "trivial", None, "title"]
    assert [r[0] for r in spark.createDataFrame([(" A: b/c? ",), ("??",)], "t string").select(inbox.file_slug(F.col("t"))).collect()] == ["a-b-c", "knowledge-note"]
    day = dt.date(2026, 1, 1)
    drafts = spark.createDataFrame([(1, day, "x"), (2, day, "x"), (3, day, "x-2"), (4, day, "y")], "id int, day date, slug string")
    taken = spark.createDataFrame([("99-Inbox/2026-01-01-y.md",)], "rel string")
    got = {r.id: r.rel for r in sinks.free_names(drafts, taken).collect()}
    assert got == {1: "99-Inbox/2026-01-01-x.md", 2: "99-Inbox/2026-01-01-x-3.md", 3: "99-Inbox/2026-01-01-x-2.md", 4: "99-Inbox/2026-01-01-y-1.md"}


def test_routes_and_sheets(spark):
    routes = spark.createDataFrame([("lang/go", "language", "a.md"), ("lang/go", "language", "a.md"), ("bad", "odd", "b.md")], "tag string, type string, target string")
    files = spark.createDataFrame([("a.md",)], "rel string")
    assert sorted(map(tuple, inbox.route_problems(routes, files).collect())) == [("bad", "tag form"), ("bad", "target"), ("bad", "type"), ("lang/go", "repeated")]
    drafts = spark.createDataFrame([("1", "H", "s"), ("2", "I", "s"), ("3", "H", "t")], "rel string, heading string, sheet string")
    sheets = spark.createDataFrame([("s", "## H")], "sheet string, content string")
    assert {r.rel: r.status for r in inbox.sheet_status(drafts, sheets).collect()} == {"1": "synced", "2": "stale", "3": "missing"}


def test_comments(spark):
    lines = [(1, "x = 1  # FIXME: the buffer leaks because of a race"), (2, "// todo: test"), (3, "# Code generated by tool, HACK: no"), (4, "bypass"), (30, "pattern: late"), (5, ""), (6, None)]
    got = code.comments(spark.createDataFrame([("a.py", *x) for x in lines], "rel string, line_no int, line string")).orderBy("line_no").collect()
    assert [(r.line_no, r.category, r.excerpt, r.score) for r in got] == [(1, "ANNOTATION_FIXME", "FIXME: the buffer leaks because of a race", 0.8), (4, "WORKAROUND_TRAP", "bypass", 0.68)]


def test_export(spark):
    notes = spark.createDataFrame([("n", "a [[d/x#p|X]] [[gone/y]] [[gone/z| Z ]]"), ("e", ""), ("nil", None), ("plain", "text")], "rel string, content string")
    known = export.known_targets(spark.createDataFrame([("d/x.md",), ("README.md",), ("d/README.md",)], "rel string"))
    assert sorted(r.target for r in known.collect()) == ["d/README", "d/x", "x"]
    assert {r.rel: (r.content, r.n_repaired) for r in export.neutralise_links(notes, known).collect()} == {"n": ("a [[d/x#p|X]] y Z", 2), "e": ("", 0), "nil": (None, 0), "plain": ("text", 0)}
    assert sorted(r.token for r in export.forbidden_tokens(spark.createDataFrame([("a/key.md",), ("b/*.md",), ("dir",)], "pattern string")).collect()) == ["key", "key.md"]


def test_pair_issues(spark):
    at = dt.datetime(2026, 1, 1)
    side = "struct<rel:string,content:string,numbers:array<string>,updated:string,mtime:timestamp>"
    rows = [
        ("go", ("GO-S.md", "GO-C", ["1", "2"], "2026-01-02", at), ("GO-C.md", "GO-S", ["1", "2"], "2026-01-01", at)),
        ("py", ("PY-S.md", "", ["1", None, "3"], "2026-01-02", at), ("PY-C.md", "PY-S", ["1", "2"], "2026-01-01", at)),
        ("rs", ("RS-S.md", "", [], None, at), None),
    ]
    got = checks.pair_issues(spark.createDataFrame(rows, f"key string, left {side}, right {side}")).collect()
    assert sorted((r.key, r.level, r.message) for r in got) == [
        ("py", "ERROR", "section count"), ("py", "ERROR", "section number at 2"), ("py", "WARN", "drift"), ("py", "WARN", "long form does not name the short form"), ("rs", "WARN", "no short form"),
    ]


def test_lookup(spark):
    notes = spark.createDataFrame([("a/go.md",), ("b/GO.md",), ("go-tips.md",)], "rel string")
    find = lambda n: [(r.rel, r.match) for r in lookup.find_note(notes, n).orderBy("rel").collect()]
    assert find("[[a/go|x]]") == [("a/go.md", "file")] and find("go") == [("a/go.md", "stem")] and find("tip") == [("go-tips.md", "part")] and find("zz") == []


def test_query_terms():
    got = [(t.text, t.weight, t.core) for t in search.query_terms("Go std.vector 并发 内存泄漏")]
    assert got[:4] == [("go", 1.5, True), ("std.vector", 1.5, True), ("std", 1.0, False), ("vector", 1.0, False)]
    assert ("内存", 1.3, True) in got and ("泄漏", 1.3, True) in got and ("漏", 0.3, False) in got
    assert search.query_language("how in C++ and go") == "lang/go" and search.query_language("rust") == "lang/rust" and search.query_language("food") is None


def test_pages_and_health(spark):
    rows = spark.createDataFrame([("b", 1), ("a|x", 2)], "name string, n int")
    assert reports.page(rows, "T", ["name", "n"], ["name"]).first().content == "# T\n\n| name | n |\n|---|---|\n| a\\|x | 2 |\n| b | 1 |\n"
    assert reports.page(rows.limit(0), "T", ["name"], ["name"]).first().content.endswith("(none)\n")
    results = spark.createDataFrame([("links", True), ("inbox", False)], "name string, ok boolean")
    assert checks.healthy(results, ["inbox"]).first()[0] is True and checks.healthy(results, []).first()[0] is False


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "s")
    assert sinks.read_snapshot(spark, root) is None
    one = sinks.publish(spark.range(3).toDF("id"), root, None)
    with pytest.raises(sinks.StaleSnapshot):
        sinks.publish(spark.range(4).toDF("id"), root, None)
    assert sinks.read_snapshot(spark, root).count() == 3
    sinks.publish(spark.range(5).toDF("id"), root, one)
    assert sinks.read_snapshot(spark, root).count() == 5
    events = spark.createDataFrame([(dt.datetime(2026, 1, 1), "a", "w", "p|q", "s")], "ts timestamp, agent string, op string, paths string, summary string")
    sinks.append_audit(events, str(tmp_path / "audit"))
    sinks.append_audit(events, str(tmp_path / "audit"))
    assert [(r.paths, str(r.month)) for r in spark.read.parquet(str(tmp_path / "audit")).collect()] == [("p\\|q", "2026-01")] * 2
