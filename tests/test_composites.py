from pyspark.sql import functions as F

from corvane.operators import composites as C
from corvane.operators import notes as N


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_indexing_takes_each_real_path_once(spark):
    files = [("01-Rules/a.MD", 1), ("00-MOC/link.md", 1), ("README.md", 2), ("x/y.md", 3), ("05-Tools/.sh", 4), ("05-Tools/t.sh", 5), ("05-Tools/t.png", 6)]
    df = spark.createDataFrame([(*f, "extra") for f in files], "rel string, real_path int, content string")
    assert [r[0] for r in rows(C.indexable(df))] == ["00-MOC/link.md", "05-Tools/t.sh", "README.md"] and C.indexable(df.limit(0)).count() == 0


def test_text_and_code_files(spark):
    files = [("a.md", b"x\0"), ("hook", b"text"), ("bin", b"x\0y"), ("late", b"x" * 8192 + b"\0"), (".git/hook", b"t"), ("a.png", b"t"), ("nul", None)]
    assert [r.rel for r in C.text_files(spark.createDataFrame(files, "rel string, content binary")).orderBy("rel").collect()] == ["a.md", "hook", "late"]
    code = [("src/a.py", "x"), ("src/out/a.py", "x"), (".hid/a.py", "x"), ("out.py", "x"), ("a.min.js", "x"), ("long.ts", "y" * 1001), ("sixth.go", "\n" * 5 + "y" * 1001), ("big.rs", "x")]
    df = spark.createDataFrame([(r, c, (1 << 20) + 1 if r == "big.rs" else len(c)) for r, c in code], "rel string, content string, size long")
    assert [r.rel for r in C.code_files(df).orderBy("rel").collect()] == ["out.py", "sixth.go", "src/a.py"]
    assert C.code_scan(df.limit(0)).count() == 0


def test_registry_by_header(spark):
    text = "| no | section |\n## 2.1 A\n| # | S | t |\n|--|--|--|\n| 1 | `a-b` / `cc` | `x` |\n| 2 |\n\n| `d` | `e` | `f` |\n### 3\n| S |\n| :-- |\n| `cc` |\n| S |\n## 4\n| S |\n| `no` |"
    lines = spark.createDataFrame([("r", i, x) for i, x in enumerate(text.split("\n"))], "rel string, line_no int, line string")
    names = C.registry(lines, {"2.1": "L1", "3": "L2"}, "S")
    assert rows(names) == [("L1", "a-b"), ("L1", "cc"), ("L2", "cc")]
    installed = spark.createDataFrame([("a-b",), ("a-b",)], "name string")
    assert rows(C.registry_sync(names, installed, None)) == [("L2", "cc", "ERROR")] and rows(C.registry_sync(names, installed, installed)) == [("L1", "cc", "WARN"), ("L2", "cc", "ERROR")]


def test_triage_counts_drafts_without_tags(spark):
    drafts = [("a", -3, None, None, None), ("b", 40, "notes", ["lang/go", "lang/py", "topic/x"], None), ("c", 14, "notes", [], None)]
    got = {(r.part, r.value): r.n for r in C.triage(spark.createDataFrame(drafts, "rel string, age_days int, type string, tags array<string>, promoted_to string")).collect()}
    assert got[("total", "drafts")] == 3 and got[("total", "overdue")] == 2 and got[("tier", "<7d")] == 1 and got[("lang", "go")] == got[("lang", "py")] == 1 and got[("lang", "generic / unassigned")] == 2


def test_lint_in_any_case(spark):
    lines = spark.createDataFrame([("a", 1, "see SECRET and `d/x.md` `d/y.md` `t/z.md` `plain.md`"), ("b", 1, "secret `d/x.md`"), ("c", 1, None)], "rel string, line_no int, line string")
    files = spark.createDataFrame([("d/y.md",)], "rel string")
    got = rows(C.lint(lines, files, ["Secret", ""], [("", "se+")], [".md"], skipped=["b"], allowed=["t/"]))
    assert got == [("a", 1, "path", "d/x.md"), ("a", 1, "pattern", "se+"), ("a", 1, "token", "Secret"), ("b", 1, "pattern", "se+")]
    assert rows(C.lint(lines, files, [], [], [".md"], allowed=["d/"])) == [("a", 1, "path", "t/z.md")]


def test_export_gate_and_claims(spark):
    files = spark.createDataFrame([("k/a.md", "[[k/a]] [[s/b]] [[gone|shown]] Me"), ("s/b.md", "secret"), ("x/c.md", "no"), ("k/n.md", None)], "rel string, content string")
    got = {r.rel: (r.content, r.n_repaired, r.n_replaced) for r in C.export_package(files, [("keep", ["k/**"]), ("structure", ["s/**"])], [("Me", "You")]).collect()}
    assert got == {"k/a.md": ("[[k/a]] [[s/b]] shown You", 1, 1), "s/b.md": (None, 0, 0), "k/n.md": (None, 0, None)}
    kind = "rel string, authority string, claim_risk string, review_status string"
    gate = lambda *r: tuple(C.ledger_gate(spark.createDataFrame(list(r), kind)).first())
    assert gate(("a", None, None, None)) == (1, 0, True, False) and gate(("a", "official", "low", "reviewed"), ("b", None, None, None)) == (2, 0, False, True) and gate(("a", "bad", None, None))[3] is False
    assert tuple(C.ledger_gate(spark.createDataFrame([], kind)).first()) == (0, 0, False, True)
    lines = spark.createDataFrame([("a", i, "- MUST x", i == 3) for i in range(30)], "rel string, line_no int, line string, in_fence boolean")
    assert [r.line_no for r in C.claims(lines).orderBy("line_no").collect()] == [i for i in range(21) if i != 3]


def test_dual_versions(spark):
    df = spark.createDataFrame([("l/GO-STANDARDS.md", "l/go-cheatsheet.md", 0.9), ("l/GO-STANDARDS.md", "m/GO-CHEATSHEET.md", 0.9), ("GO-STANDARDS.md", "A-STANDARDS.md", 0.5)], "a string, b string, ratio double")
    assert [r.advice for r in C.duplicate_report(df).collect()] == ["pair", "merge", "none"]


def test_field_variants(spark):
    notes = spark.createDataFrame([("a", "---\nTitle: T\ntags: [#A/b, 'c']\nempty:\nblock: |\n---\nbody"), ("b", "---\nTitle: open\nx"), ("c", "no block"), ("d", None), ("e", "---\ntitle: a---b\n---\nbody\n")], "rel string, content string")
    got = {r.rel: r.fields for r in N.fields_of_search(notes).collect()}
    assert got["a"] == {"title": ["T"], "tags": ["a/b", "c"], "empty": [], "block": []} and got["b"] == {"title": ["open"]} and not got["c"] and not got["d"]
    drafts = {r.rel: (r.fields, r.body) for r in N.fields_of_drafts(notes).collect()}
    assert drafts["e"][0] == {"title": "a"} and drafts["e"][1].startswith("b") and drafts["c"][1] == "no block"
    block = spark.createDataFrame([("a", "---\ntags:\n  - x/y\n- 'z'\n---\n- no")], "rel string, content string")
    assert N.tags_of_block(block).first().tags == ["x/y", "z"]
    assert block.select(N.with_placeholders(F.lit("a: {{ x y }}")), N.without_fences(F.lit("a ```b\n``` c"))).first() == ("a: placeholder_x y", "a  c")
