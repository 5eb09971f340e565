"""The postings index beside the search that scans texts."""

import random

import pytest

from corvane.operators import postings, search
from corvane.operators.search import Term
from corvane.sources import sinks

NOTE = "rel string, title string, tags array<string>, kind string, content string, sections array<struct<heading:string, body:string>>"
WORDS = ["lock", "Locks", "mutex", "std.vector", "go", "golang", "memory-leak", "Rust", "内存泄漏", "内存", "锁", "a", "of", "the", "un_lock.er", "c++", "```", "lock,", "(mutex)"]


def notes(seed, names):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    out = []
    for rel in names:
        sections = [(rng.choice((None, say(2))), rng.choice((None, "", say(rng.randrange(1, 12)), say(5) + "\n" + say(4)))) for _ in range(rng.randrange(0, 4))]
        content = "\n".join("\n".join(x for x in s if x is not None) for s in sections)
        out.append((rel, rng.choice((None, "", say(3))), rng.choice((None, [], ["lang/go"], ["lang/rust", "topic/lock"])), rng.choice(("notes", "standards")), content, sections))
    return out


def rows(df):
    return sorted((r.rel, r.section, round(r.score, 6)) for r in df.collect())


ASKED = [
    ("lock", [Term("lock", 1.5)], None, None),
    ("go mutex", search.query_terms("go mutex"), "lang/go", None),
    ("std.vector 内存泄漏 锁", search.query_terms("std.vector 内存泄漏 锁"), None, None),
    ("the lock", [Term("the"), Term("lock", 2.0), Term("leak", 0.9, False), Term("nowhere", 1.0)], "lang/rust", "topic"),
    ("k m", [Term("k"), Term("c++", 1.2), Term("lock mutex", 1.0, False)], None, None),
]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    some = notes(1, [f"n{i}" for i in range(60)])
    postings.add(spark.createDataFrame(some, NOTE), root)
    return root, some


@pytest.mark.parametrize("asked", ASKED, ids=[a[0] for a in ASKED])
def test_scores_as_the_scan_does(spark, built, asked):
    root, some = built
    query, terms, language, tag = asked
    df = spark.createDataFrame(some, NOTE)
    index = postings.Index(spark, root)
    assert rows(postings.search(index, query, terms, language, tag, top=None)) == rows(search.search(df, query, terms, language, tag, top=None))
    best = [(r.rel, r["rank"]) for r in postings.search(index, query, terms, language, tag, top=4).collect()]
    assert best == [(r.rel, r["rank"]) for r in search.search(df, query, terms, language, tag, top=4).collect()]


def test_added_and_removed_notes(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError):
        postings.Index(spark, root)
    first, second = notes(2, [f"n{i}" for i in range(20)]), notes(3, [f"n{i}" for i in range(10, 30)])
    query, terms = "go lock", search.query_terms("go lock")
    postings.add(spark.createDataFrame(first, NOTE), root)
    old = postings.Index(spark, root)
    before = rows(postings.search(old, query, terms, top=None))
    postings.add(spark.createDataFrame(second, NOTE), root)
    postings.remove(spark.createDataFrame([("n3",), ("n12",), ("never",)], "rel string"), root)
    postings.add(spark.createDataFrame(notes(4, ["n3"]), NOTE), root)
    now = {r[0]: r for r in [*first, *second, *notes(4, ["n3"])]}
    del now["n12"]
    want = rows(search.search(spark.createDataFrame(list(now.values()), NOTE), query, terms, top=None))
    assert rows(postings.search(postings.Index(spark, root), query, terms, top=None)) == want
    assert rows(postings.search(old, query, terms, top=None)) == before  # a reader keeps the state that it opened


def test_clusters_cover_core_terms(spark, tmp_path):
    root = str(tmp_path)
    some = [("a", "x", [], "notes", "a mutex", [(None, "a mutex")]), ("b", "x", [], "notes", "a lock", [(None, "a lock")]), ("c", "x", [], "notes", "nothing", [(None, "nothing")]), (None, "x", [], "notes", "a lock", [])]
    postings.add(spark.createDataFrame(some, NOTE), root)
    clusters = [(["lock"], ["mutex"])]
    terms = search.expand("lock", [Term("lock")], clusters)
    index = postings.Index(spark, root)
    plain = {r.rel: r.score for r in postings.search(index, "lock", terms, top=None).collect()}
    met = {r.rel: r.score for r in postings.search(index, "lock", terms, top=None, clusters=clusters).collect()}
    assert set(plain) == {"b"} and set(met) == {"a", "b"} and met["b"] == plain["b"] and met["a"] > 5


def test_dead_publishers_hide_nothing(spark, tmp_path):
    root = str(tmp_path)
    name = sinks.publish(spark.range(4), root, None)
    for n in range(2, 6):
        (tmp_path / f"POINTER-{n:09d}").write_text("")
    assert sinks.current(spark, root) == name
    with pytest.raises(sinks.StaleSnapshot):
        sinks.publish(spark.range(2), root, None)
    assert sinks.publish(spark.range(5), root, name) == sinks.current(spark, root)
    assert sinks.read_snapshot(spark, root).count() == 5


def test_places_of_a_section_of_very_many_words(spark):
    """What tells where words stand is asked once for a section, not once for each pair of its words."""
    import time

    words = 20_000
    body = " ".join(f"w{i}" for i in range(words))
    shape = "rel int, title string, tags array<string>, kind string, content string, sections array<struct<heading: string, body: string>>"
    # by rel: a body alone, one beside a heading, one beside CJK, one with a fence
    rows = [(1, "t", [], "k", body, [(None, body)]), (2, "t", [], "k", "head one\none two", [("head one", "one two")]), (3, "t", [], "k", "one 中文", [(None, "one 中文")]), (4, "t", [], "k", "``` x", [(None, "``` x")])]
    start = time.time()
    found = postings._postings(spark.createDataFrame(rows, shape), 4).where("section >= 0").collect()
    assert time.time() - start < 25
    of = lambda rel: {(r.term, r.tf, r.n, r.area) for r in found if r.rel == rel}
    assert of(1) == {(f"w{i}", 1, words, 2) for i in range(words)}
    assert of(2) == {("head", 1, 4, 1), ("one", 2, 4, 3), ("two", 1, 4, 2)}
    assert {("one", 1, 2), ("中文", 1, 2)} <= {(t, tf, area) for t, tf, _, area in of(3)}
    assert of(4) == {("x", 1, 1, 6)}
