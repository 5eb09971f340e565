"""Unified diffs against a line-by-line reader."""

import re

from corvane.operators import diffs

DIFFS = [
    ("a", "diff --git a/x.md b/x.md\n--- a/x.md\n+++ b/x.md\n@@ -1,3 +1,4 @@ title\n one\n-two\n+2 https://h.io/?token=1,\n+\n three\n\\ No newline at end of file\n@@ -9 +10,2 @@\n-@@ -1 +1 @@\n+diff --git a/no b/no\n++++ b/no\n"),
    ("b", "diff --git a/old.md b/old.md\ndeleted file mode 100644\n--- a/old.md\n+++ /dev/null\n@@ -1 +0,0 @@\n-+x\ndiff --git \"a/s p\" \"b/s p\"\nnew file mode 100644\n--- /dev/null\n+++ \"b/s p\"\n@@ -0,0 +1,2 @@\n+first\r\n+second\r\ndiff --git a/bin b/bin\nBinary files a/bin and b/bin differ\n"),
    ("c", None), ("d", ""), ("e", "no diff at all\n+x\n"),
]


def plain(raw):
    """One line after the other, with counters."""
    out, path, number = [], None, None
    for line in (raw or "").split("\n"):
        line = line.removesuffix("\r")
        if line.startswith("diff --git "):
            path, number = "", None
        elif number is None and line.startswith("+++ "):
            path = re.sub(r"^b/", "", line[4:].strip('"'))
        elif path and path != "/dev/null" and line.startswith("@@ -"):
            number = int(re.search(r"\+(\d+)", line)[1])
        elif number is not None and line[:1] in ("+", " ") and line:
            if line[0] == "+":
                out.append((path, number, line[1:]))
            number += 1
    return out


def test_added_lines(spark):
    df = spark.createDataFrame(DIFFS, "id string, raw string")
    got = sorted((r.id, r.path, r.line_no, r.line) for r in diffs.added_lines(df).collect())
    assert got == sorted((i, *x) for i, raw in DIFFS for x in plain(raw)) and len(got) == 6
    assert [tuple(r) for r in diffs.suspicious_additions(df).collect()] == [("a", "x.md", 2, "https://h.io/?token=1", "token", "credential name")]


def test_tracked_files(spark):
    df = spark.createDataFrame([("a/b\0c d\0\0 \0并\0",), ("",), (None,)], "raw string")
    assert [r.rel for r in diffs.tracked_files(df).collect()] == ["a/b", "c d", "并"]


def test_local_anchors(spark):
    from corvane.operators import notes as N

    text = "# One *Two*\n```\n## In fence\n[[#skipped]]\n```\n[[#one two]] [[#One *Two*|x]] [[#in FENCE]] [[#^b]] [[#]] [[other#One]] `[[#code]]` [[#three]]\n"
    got = N.local_anchors(spark.createDataFrame([("a", text), ("b", None), ("c", "[[#x]]")], "rel string, content string")).collect()
    assert sorted((r.rel, r.line_no, r.anchor, r.known) for r in got) == [("a", 6, "One *Two*", True), ("a", 6, "in FENCE", True), ("a", 6, "one two", True), ("a", 6, "three", False), ("c", 1, "x", False)]
