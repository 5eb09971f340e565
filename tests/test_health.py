import difflib
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corvane import catalog
from corvane.functions import text as T
from corvane.operators import canvas, checks, conflicts, consolidate, health, render, search, similarity
from corvane.sources import sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_nul_bytes(spark):
    files = spark.createDataFrame([("a", b"x\ny\x00z\n\x00"), ("b", b"plain \x10\x01"), ("c", b"\x00"), ("d", None), ("e", b"")], "rel string, content binary")
    assert rows(health.nul_issues(files).select("rel", "n", "line")) == [("a", 2, 2), ("c", 1, 1)]


def test_blocks_and_exemptions(spark):
    notes = [("README.md", "x"), ("phase-PLAN.md", "x"), ("PHASE2.md", "x"), ("a/PLAN.md", "x"), ("Templates/workmemory/a.md", "x"), ("Templates/t.md", "---\nopen"), ("b.md", "---\na: b\n---\n"), ("c.md", "---\n---"), ("d.md", None), ("e.md", "")]
    got = rows(health.block_issues(spark.createDataFrame(notes, "rel string, content string")))
    assert got == [("Templates/t.md", "WARN", "FRONTMATTER", "open"), ("a/PLAN.md", "ERROR", "FRONTMATTER", "missing"), ("d.md", "ERROR", "FRONTMATTER", "missing"), ("e.md", "ERROR", "FRONTMATTER", "missing")]
    assert health.block_issues(spark.createDataFrame([], "rel string, content string")).count() == 0


def test_links_by_path_folder_stem_and_ending(spark):
    files = spark.createDataFrame([("a/b/n.md",), ("a/pic.png",), ("top.md",)], "rel string")
    content = "[[n]] [[b/n]] [[a/b/n|x]] [[a/b/]] [[a]] [[pic]] [[a/pic.png]] [[top#h]] [[#own]] [[lost]] [[{{x}}]]\n```\n[[fenced]]\n```\n[[n/x]]"
    notes = spark.createDataFrame([("a/s.md", content), ("e.md", None)], "rel string, content string")
    links = health.checked_links(notes, files)
    assert sorted(r.target for r in links.where("NOT found").collect()) == ["lost", "n/x"]
    assert rows(health.link_issues(links).select("message", "line")) == [("broken link lost", 1), ("broken link n/x", 5)]
    gate = health.strict_gate(health.block_issues(notes), health.link_totals(links)).first()
    assert (gate.errors, gate.broken, gate.passed) == (2, 2, False)


def test_contracts(spark):
    hooks = spark.createDataFrame([(1, "stop", "python 'a b.py'"), (2, None, None), (3, "stop", "python a b c"), (4, "stop", "node x.py"), (5, "odd", "sh x.py")], "id int, stage string, entry string")
    files = spark.createDataFrame([("a b.py",), ("a b.py",)], "rel string")
    assert rows(health.hook_problems(hooks, files)) == [(2, "entry empty"), (2, "stage"), (3, "entry form"), (4, "entry form"), (5, "script missing"), (5, "stage")]
    lines = [(1, '{"id": 1, "result": {"tools": [{"name": "x"}], "protocolVersion": "p"}}'), (2, "noise"), (3, "[1]"), (4, '{"id": 1, "error": {"code": 3}}'), (5, "{broken"), (6, None)]
    got = health.rpc_results(spark.createDataFrame(lines, "line_no int, line string")).collect()
    assert [(r.id, r.error) for r in got] == [("1", '{"code":3}')]


def test_changed_files(spark):
    raw = " M a.md\0R  new.md\0old.md\0?? u.md\0!! i.md\0x\0C  c\0d\0 D g\\h.md"
    assert rows(health.changed_files(spark.createDataFrame([(raw,), (None,), ("",)], "raw string"))) == [("a.md",), ("c",), ("d",), ("g/h.md",), ("new.md",), ("old.md",)]


def test_map_of_a_collection(spark):
    notes = spark.createDataFrame([(f"01-Rules/{i}.md",) for i in range(5)] + [("x.md",), ("odd/y.md",)], "rel string")
    at = {r.rel: (r.category, r.x, r.y) for r in canvas.positions(notes).collect()}
    assert at["01-Rules/0.md"] == ("01-Rules", -990, -540) and at["01-Rules/3.md"] == ("01-Rules", -680, -405) and at["odd/y.md"][0] == at["x.md"][0] == "Root"
    links = spark.createDataFrame([("x.md", "01-Rules/0.md"), ("x.md", "01-Rules/0.md"), ("x.md", "x.md"), ("x.md", "gone.md")], "src string, dst string")
    assert [(r.from_side, r.to_side) for r in canvas.edges(canvas.positions(notes), links).collect()] == [("right", "left")]
    assert tuple(canvas.counts(canvas.canvas(notes, links)).first()) == (9, 7, 2, 1)
    assert tuple(canvas.counts(canvas.canvas(notes.limit(0), links)).first()) == (0, 0, 0, 0)


def test_consolidation_of_no_tags_and_ties(spark):
    columns = "tag string, type string, name string, standards string, cheatsheet string, target string, target_dir string, target_project string"
    routes = spark.createDataFrame([("lang/x", "dual", "x", "S.md", "C.md", None, None, None)], columns)
    fallback = spark.createDataFrame([("default", "source-article", "A", None, None, None, "Art", None)], columns.replace("tag", "type_of", 1))
    drafts = spark.createDataFrame([("a", "My Title!", None, ["y", "lang/x"]), ("b", "T", "odd", None), ("c", "T", None, [])], "rel string, title string, type string, tags array<string>")
    planned = consolidate.plan(drafts, routes, fallback)
    assert rows(planned.select("rel", "matched_tag", "target_path")) == [("a", "lang/x", "S.md"), ("b", None, "Art/T.md"), ("c", None, "Art/T.md")]
    texts = spark.createDataFrame([("a", "body"), ("b", "---\nstatus: draft\n---\nB"), ("c", "---\nstatus: draft\n---\nC")], "rel string, content string")
    out = {r.target_path: (r.content, r.n_drafts) for r in consolidate.rendered(planned, texts, texts.limit(0), F.lit("2024-01-02").cast("date")).collect()}
    assert out["Art/T.md"] == ("---\nstatus: stable\n---\nC", 2) and out["S.md"][0].startswith("# X Standards\n\n\n---\n\n#### My Title!") and "2024-01-02" in out["S.md"][0]


def test_duplicates_against_all_pairs(spark):
    rng = random.Random(4)
    base = [" ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(26)) for _ in range(4)]
    texts = {}
    for i in range(24):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(("zq", "oth", "wo he"))
        texts[f"n{i:02}"] = " ".join(w)
    texts["short"] = "too short"
    want = {(a, b): difflib.SequenceMatcher(None, texts[a], texts[b]).ratio() for a in texts for b in texts if a < b and min(len(texts[a]), len(texts[b])) > 80}
    notes = spark.createDataFrame([*texts.items(), ("null", None), ("empty", "")], "rel string, content string")
    got = {(r.a, r.b): r.ratio for r in similarity.duplicates(notes).collect()}
    assert got == {k: v for k, v in want.items() if v >= 0.70} and got


def test_conflicts_share_tags_and_split_hot_tokens(spark, monkeypatch):
    data = [(f"r{i:02}", 0, "positive" if i % 2 else "negative", ["t/1", "t/2"] if i % 3 else ["t/2"], ["hot", f"w{i // 2}"]) for i in range(40)]
    data += [("none", 0, None, ["t/1"], ["hot"]), ("bare", 0, "positive", None, ["hot"]), ("odd", 0, "positive", ["u"], ["hot"])]
    clauses = spark.createDataFrame(data, "rel string, idx int, polarity string, tags array<string>, tokens array<string>")
    want = rows(conflicts.candidates(clauses))
    assert len(want) == 400 and all(r[5 + 1] in (1, 2) for r in want)
    monkeypatch.setattr(conflicts, "SLICE", 7)
    assert rows(conflicts.candidates(clauses)) == want


def test_term_counts_equal_the_tokens(spark):
    texts = ["The the.the x.y a_b-cd ...", "go go.go-go2 2go _go_ GO", "中文字符 the 中文", "", None, "é the-é a.b.c.d ab..cd .ab. ab.", "the" * 3 + " the"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    tokens = T.index_tokens(F.col("t"))
    for r in df.select(F.size(tokens).alias("a"), T.token_count(T.token_bags(F.col("t"))).alias("b"), F.sort_array(F.array_distinct(tokens)).alias("c"), F.sort_array(T.index_terms(F.col("t"))).alias("d"), *[x for w in ("the", "go", "x", "中文", "ab") for x in (T.count_of(tokens, w).alias(f"e{w}"), T.term_count(T.token_bags(F.col("t")), w).alias(f"f{w}"))]).collect():
        assert r.a == r.b and r.c == r.d and all(r[f"e{w}"] == r[f"f{w}"] for w in ("the", "go", "x", "中文", "ab")), r


def test_snapshots_of_changes(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "rel string, content string")
    one = sinks.publish(files, root, None)
    changes = spark.createDataFrame([("a", "9", sha("1")), ("b", None, sha("2")), ("c", "3", None)], "rel string, content string, expected string")
    two = sinks.commit(sinks.read_snapshot(spark, root), changes, root, one)
    assert rows(sinks.read_snapshot(spark, root)) == [("a", "9"), ("c", "3")]
    with pytest.raises(sinks.StaleSnapshot, match="changed meanwhile: a, b, c"):
        sinks.commit(sinks.read_snapshot(spark, root), changes, root, two)
    with pytest.raises(sinks.StaleSnapshot):
        sinks.publish(files, root, one)
    sinks.point_to(spark, root, one, two)  # the former state again
    assert rows(sinks.read_snapshot(spark, root)) == [("a", "1"), ("b", "2")] and sinks.current(spark, root) == one


def test_snapshot_of_a_publisher_that_died(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    one = sinks.publish(spark.range(2), root, None)
    (tmp_path / "s" / "POINTER-000000002").touch()
    assert sinks.current(spark, root) == one
    sinks.publish(spark.range(3), root, one)
    assert sinks.read_snapshot(spark, root).count() == 3


def test_marks_frames_and_nightly_steps(spark):
    df = spark.createDataFrame([("The C++ $x the", "a\n\n b  \nc\nd")], "t string, b string")
    got = df.select(render.marked(F.col("t"), ["the", "c++", "$x"], "$", "\\"), render.snippet_frame(F.col("b"), F.lit(2)), render.snippet_frame(F.col("b"), F.lit(0)), render.marked(F.col("t"), [" "])).first()
    assert tuple(got) == ("$The\\ $C++\\ $$x\\ $the\\", " b\nc\nd", "a\n b", "The C++ $x the")
    fail = lambda: 1 / 0
    assert render.nightly([("a", fail), ("b", lambda: 2), ("quality-check", lambda: 0), ("c", lambda: None)]) == (0, [("a", "raised ZeroDivisionError: division by zero"), ("b", "code 2"), ("quality-check", "ok"), ("c", "ok")])
    assert render.nightly([("quality-check", fail), ("c", lambda: None)])[0] == 1


def test_hits_as_text(spark):
    hits = spark.createDataFrame([(1, "T", 2.345, "a.md", 7, "S", ["x/y"], "---\n one the \n\ntwo"), (2, "U", 1.0, "b.md", 1, None, None, "")], "rank int, title string, score double, rel string, line int, section string, tags array<string>, snippet string")
    assert [r.text for r in render.hits_compact(hits).orderBy("rank").collect()] == ["[1] T (2.3 pts)\n    a.md:7 | S | x/y\n    one the two", "[2] U (1.0 pts)\n    b.md:1"]
    assert "     | **the**" not in render.hits_detailed(hits, ["the"]).orderBy("rank").first().text and "**the**" in render.hits_detailed(hits, ["the"]).orderBy("rank").first().text
    assert checks.repeated(hits, "rank").count() == 0 and search.query_language("go now") == "lang/go"


def test_recent_orders_of_one_day_by_number(spark, duck, tmp_path):
    orders = [(k, "O", "3-MEDIUM") for k in (100, 9, 20, 1000, 3, 77, 500, 41, 8, 600)] + [(1, "F", "3-MEDIUM"), (2, "O", "1-URGENT")]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderpriority string").selectExpr("*", "TIMESTAMP '1998-08-02' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    want = duck.sql(catalog.oracle_sql()["cls13_recently_changed"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")).fetchall()
    found = catalog.queries()["cls13_recently_changed"](spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == want == [(k,) for k in (3, 8, 9, 20, 41, 77, 100, 500)]


@pytest.mark.parametrize("slice_bytes", [1, 1 << 20])
def test_digests_of_long_files_in_slices(spark, slice_bytes):
    """The digest of each file is that of its whole content, which no grouping holds."""
    columns = "tag string, type string, name string, standards string, cheatsheet string, target string, target_dir string, target_project string"
    routes = spark.createDataFrame([("lang/x", "dual", "x", "S.md", "C.md", None, None, None), ("lang/y", "rule-append", "y", None, None, "R.md", None, None)], columns)
    fallback = spark.createDataFrame([("default", "source-article", "A", None, None, None, "Art", None)], columns.replace("tag", "type_of", 1))
    drafts = [(f"n{i:03}", "T" if i % 7 else "Ä", None, [["lang/x"], ["lang/y"], []][i % 3]) for i in range(90)]
    planned = consolidate.plan(spark.createDataFrame(drafts, "rel string, title string, type string, tags array<string>"), routes, fallback)
    texts = spark.createDataFrame([(d[0], f"body ü {d[0]}\n" * 40 if int(d[0][1:]) % 11 and d[0] != "n089" else None) for d in drafts], "rel string, content string")
    files = spark.createDataFrame([("R.md", "old")], "rel string, content string")
    day = F.lit("2024-01-02").cast("date")
    pieces = consolidate.pieces(planned, texts, files, day)
    want = rows(consolidate.rendered(planned, texts, files, day).select("target_path", "n_drafts", F.md5("content")))
    assert rows(consolidate.digests(pieces, slice_bytes)) == want and len(want) == 4 and any(w[2] is None for w in want)
    assert "collect_list" not in consolidate.digests(pieces)._jdf.queryExecution().toString()
