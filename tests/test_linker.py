"""Mentions and links against plain versions, with one automaton and with several."""

import random
import re

import pytest

from corvane import catalog
from corvane.operators import linker

TERMS = ["cache", "cache line", "line", "lines", "aa", "aaa", "并发", "并发设计", "std-mutex", "mutex", "C++ note", "note-x"]


def fixture(seed=3):
    rng = random.Random(seed)
    glue = [" ", " ", " ", "-", ".", "/", "`", "(", "[", "]", "设", "\n", "x", "[[b/7]]", "[cache](u)", "<aa>", "https://a/line "]
    notes = [(f"n{i}", "".join(rng.choice(TERMS) + rng.choice(glue) for _ in range(rng.randrange(0, 14)))) for i in range(150)]
    return [*notes, ("b/1", "cache and line"), ("nil", None), (None, "cache"), ("n0", "aaaa cache")], [(t, f"b/{i}", f"b/{i}") for i, t in enumerate(TERMS)] + [("", "b/99", "b/99"), (None, "b/98", "b/98")]


def brute_mentions(notes, words):
    out = []
    for rel, text in notes:
        for term, target, source in words:
            if term and rel is not None and text is not None and source != rel:
                places = [i for i in range(len(text)) if text.startswith(term, i)]
                if places:
                    out.append((rel, term, target, source, len(places), places[0]))
    return sorted(out)


def brute_link(rel, text, words):
    """One link for each term, at the first place outside protected stretches; longer terms first within a stretch."""
    there = {x for t in re.findall(r"\[\[([^\]|#]+)[^\]]*\]\]", text) for x in (t.strip(), t.strip().split("/")[-1])}
    done, lines, n = set(), [], 0
    for line in text.split("\n"):
        at, pieces = 0, []
        if line.strip()[:1] != "#":
            for m in [*re.finditer(r"\[\[[^\]]+\]\]|!?\[[^\]]*\]\([^)]+\)|`[^`]+`|<[^>]+>|https?://[^\s)\]]+", line), None]:
                piece = line[at : m.start() if m else len(line)]
                for term, target, source in sorted((w for w in words if w[0]), key=lambda w: (-len(w[0]), w[0])):
                    if term in done or source == rel or target in there or target.split("/")[-1] in there:
                        continue
                    for i in range(len(piece) - len(term) + 1):
                        before, after = piece[i - 1 : i] if i else "", piece[i + len(term) : i + len(term) + 1]
                        ascii_ = all(c.isascii() and (c.isalnum() or c in "_-") for c in term)
                        word = lambda c: c.isalnum() or c == "_"
                        ok = before not in ("[", "`") and after not in ("]", "`") if before or after else True
                        if ascii_ and ((before and (word(before) or before in "-/")) or (after and (word(after) or after in "-."))):
                            ok = False
                        if piece.startswith(term, i) and ok:
                            piece = f"{piece[:i]}[[{target}]]{piece[i + len(term):]}"
                            done.add(term)
                            n += 1
                            break
                pieces.append(piece + (m[0] if m else ""))
                at = m.end() if m else at
            line = "".join(pieces)
        lines.append(line)
    return "\n".join(lines), n


@pytest.mark.parametrize("most", [64 << 20, 300])
def test_against_plain_versions(spark, monkeypatch, most):
    monkeypatch.setattr(linker, "DICTIONARY_BYTES", most)
    notes, words = fixture()
    df, known = spark.createDataFrame(notes, "rel string, content string"), spark.createDataFrame(words, "term string, target string, source string")
    assert (len(linker._automata(known)) > 1) == (most == 300)
    assert sorted(tuple(r) for r in linker.mentions(df, known).collect()) == brute_mentions(notes, words)
    once = [n for n in notes if n != ("n0", "aaaa cache")]  # terms of a larger dictionary come together by rel
    df = spark.createDataFrame(once, "rel string, content string")
    want = {rel: brute_link(rel, text, words) for rel, text in once if rel and text}
    assert {r.rel: (r.content, len(r.links)) for r in linker.link(df, known).collect()} == {k: v for k, v in want.items() if v[1]}


def test_without_words(spark):
    df, none = spark.createDataFrame([("a", "cache")], "rel string, content string"), spark.createDataFrame([], "term string, target string, source string")
    assert linker.mentions(df, none).count() == 0 and linker.link(df, none).count() == 0


def test_terms_that_overlap_themselves(spark, duck, tmp_path):
    texts = ["x elleelleelleelle", "elleelleelle elleelle", "none"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(27, "elleelle")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sql = catalog.oracle_sql()["join9_term_mentions"]
    for name in ("documents", "benchmark"):
        sql = sql.replace(f"FROM {name}", f"FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(duck.sql(f"SELECT rel, term, n, first FROM ({sql})").fetchall())
    found = catalog.queries()["join9_term_mentions"](spark, str(tmp_path)).select("rel", "term", "n", "first")
    assert sorted(tuple(r) for r in found.collect()) == want == [("0", "elleelle", 2, 2), ("1", "elleelle", 2, 0)]
