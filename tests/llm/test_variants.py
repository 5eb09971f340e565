"""Toxicity, centroid clustering and spelling variants."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import centroids, langid, queries, spelling, toxicity

CLASHES = "s string, score double, predicted int, k0 string, word string, n int, v int, `cluster` int"


def widened(df):
    """The same rows with columns whose names the operators use themselves."""
    return df.selectExpr("*", *(f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in CLASHES.split(", ")))


# --- toxicity


def test_toxicity_held_out(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.op11_toxicity(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert docs.count() == queries.op11_toxicity(spark, "/root/testdata/sf0.01").count()
    toxic, clean = ([r for r in got if r.toxic == y] for y in (1, 0))
    above = sum(a.score > b.score for a in toxic for b in clean) / len(toxic) / len(clean)
    assert above > 0.75 and sum(r.predicted for r in clean) < 0.1 * len(clean)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def labelled(spark, n=240):
    rng = random.Random(4)
    plain = ["".join(rng.choice(("ba", "do", "ki", "lu", "me", "no")) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    rude = ["grumpfish", "wartlenose", "snivelbag"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randrange(30, 200))]
        if i % 4 == 0:
            for _ in range(1 + len(w) // 25):
                w[rng.randrange(len(w))] = rng.choice(rude)
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0), 1))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_finds_planted_words(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(got[i] == (i % 4 == 0) for i in got) > 0.95 * len(got)
    held = docs.where(langid.is_held_out()).count()
    assert len(got) == held > 20
    lied = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    again = toxicity.train(docs, lied)  # labels that are held out change nothing
    assert (again.toxic, again.ordinary, again.weights.tolist()) == (model.toxic, model.ordinary, model.weights.tolist())


def test_toxicity_odd_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(widened(docs), widened(labels.drop("score", "predicted")))
    rows = [(1, None), (2, ""), (3, "123 !!"), (3, "123 !!"), (None, "grumpfish " * 40), (4, "x" * 300000), (5, "ba do " * 60000 + "grumpfish snivelbag"), (6, "ßä日本語 " * 50)]
    odd = widened(spark.createDataFrame(rows, "doc_id long, text string"))
    got = toxicity.score(odd, model, ["doc_id", "score", "k0"]).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "score_in", "k0", "score", "predicted"}
    by = {}
    for r in toxicity.score(odd, model).collect():
        assert 0 <= r.score <= 1
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[1] == by[2] == by[3] and len(by[3]) == 1 and min(by[None]) > 0.9
    assert model.score(rows[6][1].encode()) > model.score(rows[6][1][:-20].encode())  # whole texts are read
    assert toxicity.train(docs.limit(0), labels) is None and toxicity.train(docs, labels.where("toxic = 0")) is None
    assert {(r.score, r.predicted) for r in toxicity.score(odd, None).collect()} == {(0.0, 0)}
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_windows_hold_every_letter_once():
    for text in (b"", b"One two-three " * 30, b"q" * 1000, "éß x".encode() * 40):
        letters = re.sub(rb"[^a-z\x80-\xff]", b"", text.lower())
        assert b"".join(b"".join(toxicity.windows(text)).split()) == letters


# --- centroid clustering


def brute_clusters(rows, k, rounds, size):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    x, c = np.array([v for _, v in kept], object), np.array([v for _, v in order[:k]], object)

    def near():
        d = [[int(((p - q) ** 2).sum()) for q in c] for p in x]
        return [min(range(len(c)), key=lambda j: (row[j], j)) for row in d], d

    for _ in range(rounds):
        own, _d = near()
        for j in set(own):
            members = [p for p, o in zip(x, own) if o == j]
            c[j] = [sum(z) // len(members) for z in zip(*members)]
    own, d = near()
    far = [row[o] for row, o in zip(d, own)]
    each = Counter()
    for o, f in zip(own, far):
        each[o] += f
    return sorted((str(i), o, f, each[o], sum(far), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, _), o, f in zip(kept, own, far))


def clusters(rows, spark, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted((str(r.vec_id), *tuple(r)[1:]) for r in centroids.cluster(widened(df.repartition(3)), **how).collect())


def test_clusters_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 60)
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 1, (7, 6))
    rows = [(i, (middles[i % 7] + rng.normal(0, 0.2, 6)).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)]  # equal vectors
    rows += [(i, [round(x) / 256 for x in rng.integers(-2, 3, 6)]) for i in range(2000, 2080)]  # ties
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (3000, None), (3001, []), (3002, [0.0] * 5), (3003, [float("nan")] + [0.0] * 5), (3004, [float("inf")] + [0.0] * 5), (3005, [None] + [0.0] * 5)]
    rows += [(3006, [2.0**18] + [0.0] * 5), (3007, [-(2.0**18)] * 6), (3008, [-1e-9] * 6)]
    for k, rounds in ((9, 4), (1, 2)):
        assert clusters(rows, spark, k=k, rounds=rounds, size=6) == brute_clusters(rows, k, rounds, 6)


def test_clusters_with_few_or_no_vectors(spark):
    rows = [(1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, None)]
    assert clusters(rows, spark, k=40, rounds=2, size=2) == brute_clusters(rows, 40, 2, 2)
    assert clusters(rows[2:], spark, k=3, rounds=1, size=2) == []
    with pytest.raises(Exception, match="component too large"):
        clusters([(1, [1e30, 0.0])], spark, k=3, rounds=1, size=2)


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-5, 6, (100, 8)) + 500 * i for i in range(6)]).astype(np.int32)
    tree, over = centroids.cover_tree(points, 4), centroids.cover_tree(points[::100].astype(np.int64), 1)
    for k in range(len(tree.center)):
        own = points[tree.order[tree.begin[k] : tree.end[k]]].astype(float)
        assert np.sqrt(((own - points[tree.center[k]]) ** 2).sum(axis=1)).max() <= tree.radius[k]
        kids = range(tree.child[k], tree.after[k])
        assert not len(kids) or [tree.begin[kids[0]], *(tree.end[c] for c in kids)] == [*(tree.begin[c] for c in kids), tree.end[k]]
    whole, open_ = centroids.assign(points, tree, points[::100].astype(np.int64), over)
    assert sum(b - a for a, b, _ in whole) == len(points) and not open_ and len(whole) < 20


# --- spelling variants


def brute_variants(docs, every=31):
    counts = Counter()
    small = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(small)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 7
    n = {w: k for w, k in counts.items() if k >= 2}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        a, b = sorted((a, b), key=len)
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[i + (len(a) == len(b)) :] == b[i + 1 :]

    out, form = {}, {}
    for w in n:
        close = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        form[w] = close[0] if close and n[close[0]] >= 10 * n[w] else None
        out[w] = len(close)
    root = dict(zip(n, n))
    for w in n:
        while form[root[w]]:
            root[w] = form[root[w]]
    return {w: (form[w], root[w], n[w], out[w], n[form[w]] if form[w] else None) for w in n}


def variants(spark, docs, **how):
    df = widened(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = spelling.spelling_variants(df, **how).collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("hot", [20_000, 3])
def test_variants_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HOT", hot)
    rng = random.Random(5)
    docs = []
    for i in range(120):
        w = "".join(rng.choice("abé") for _ in range(rng.randrange(6, 10)))
        docs += [(i, f"{w} " * rng.choice((1, 2, 3, 40, 700)))]
    docs += [(i, "internationally Internationally " * 30) for i in range(200, 240)] + [(None, "ÄÖÜßäöü ÄÖÜßäöü×÷ xyz aaaaaaa aaaaaaaa"), (None, "ÄÖÜßäöü"), (1, None), (2, ""), (2, "12 !"), (3, "aaaaaaa aaaaaaaa aaaaaaaaa " * 3)]
    docs += [(7, "b" * 200 + " " + "b" * 201 + " " + "b" * 100 + "c" + "b" * 100), (8, "b" * 200 + " " + "b" * 201 + " " + "b" * 100 + "c" + "b" * 100), (9, "q" * 50000), (9, "q" * 50000)]
    assert variants(spark, docs, every=3) == brute_variants(docs, 3)


def test_variants_follow_chains_of_forms(spark):
    docs = [(1, "abcdefg " * 2), (1, "abcdefgh " * 20), (1, "abcdefghi " * 200), (1, "abcdefghij " * 2000), (1, "zzzzzzz zzzzzzz")]
    got = variants(spark, docs, every=1 << 40)
    assert got["abcdefg"] == ("abcdefgh", "abcdefghij", 2, 1, 20) and got["abcdefghi"][1] == "abcdefghij" and got["zzzzzzz"] == (None, "zzzzzzz", 2, 0, None)


def test_variants_without_words(spark):
    assert variants(spark, [(1, None), (2, "a bc"), (3, "onlyonce")]) == {}
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_variants_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op13_spelling_variants(spark, sf).collect()}
    assert got == brute_variants(docs)


# --- language ID: what is learned does not hang on ids


def test_language_sample_of_repeated_and_even_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    for one in (1, 2, 3, 11):  # every text under one id, in copies
        same = docs.select(*[langid.F.lit(one).cast("long").alias("doc_id"), "text", "lang"]).where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
        many = same.unionByName(same).unionByName(same)
        n = langid._sample(many).count()
        assert n == 0 if same.isEmpty() else 300 < n <= langid.MOST_ROWS
    rows = langid._features(langid._sample(docs.selectExpr("doc_id * 2 AS doc_id", "text", "lang")))
    disguised = sum(r[0] is None for r in rows)
    assert 0.35 < disguised / (len(rows) - disguised) < 0.65


def test_kept_columns_may_have_the_names_of_results(spark, sf):
    from corvane.llm import suffix

    docs = spark.createDataFrame([(1, "one two three " * 20, 0.5, "x"), (2, None, None, None)], "doc_id long, text string, score double, kept string")
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    assert langid.predict(docs, model, ["doc_id", "score", "text"]).columns == ["doc_id", "score_in", "text", "lang_pred", "score", "rejected"]
    assert sorted((r.doc_id, r.score_in) for r in langid.predict(docs, model, ["doc_id", "score"]).collect()) == [(1, 0.5), (2, None)]
    found = suffix.remove_repeats(docs, keep=("kept", "score"))
    assert found.columns[-2:] == ["kept_in", "score"] and {r.kept_in for r in found.collect()} == {"x", None}


def test_stages_can_be_chained_without_writing(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    one = two = docs
    for _, stage in p.STAGES:
        one = stage(spark, one, sf)
    for _, stage in p.STAGES:
        two = stage(spark, two, sf)  # the tables that the first chain still reads stay
    rows = lambda df: sorted((r.doc_id, r.n_tokens, tuple(r.ids)) for r in df.collect())
    assert rows(one) == rows(two) and len(rows(one)) > 10


def test_signatures_in_small_pieces(spark, monkeypatch):
    """All subsets of small sets and the entries of large ones, whatever the size of a piece."""
    from corvane.llm import jaccard

    monkeypatch.setattr(jaccard, "SIGNATURES", 3)
    rows = [(1, 20, [5, 6, 7, 8], 2, 0.0, None), (2, 20, [6, 8], 1, 0.0, None), (3, 4000, [5, 6, 8], 2, 0.0, None), (4, 20, [9], 0, 0.0, None)]
    sets = spark.createDataFrame(rows, jaccard._SETS)
    last_small = sets.where("doc_id = 1").select(jaccard._step("n")).first()[0]
    found = jaccard._signatures(sets, last_small, 9, 10).collect()
    of = {i: {r.sig for r in found if r.doc_id == i} for i in (1, 2, 3, 4)}
    assert len(found) == 12 and [len(of[i]) for i in (1, 2, 3, 4)] == [6 + 2, 1 + 1, 2, 0]  # small ones near the boundary are in lists too
    assert of[2] < of[1] and len(of[3] & of[1]) == 2 and len(of[3] & of[2]) == 1
    assert "Generate" not in jaccard._signatures(sets, last_small, 9, 10)._jdf.queryExecution().toString()
    assert jaccard._signatures(sets, last_small - 1, 9, 10).count() == 5  # all are large


@pytest.mark.parametrize("piece", [1 << 18, 3])
def test_members_of_hubs_without_rows_for_signatures(spark, monkeypatch, piece):
    """The same members as from a join of all signatures with themselves, though no row for each moves; also where a set is dealt into pieces."""
    from corvane.llm import jaccard

    for name, size in (("PIECE", piece), ("GROUP_SIGNATURES", 64), ("PART_SIGNATURES", 64)):
        monkeypatch.setattr(jaccard, name, size)
    rows = [(i - 3, 20 + i % 3 * 2000, [j * 7919 for j in range(i % 9, i % 9 + 4 + i % 5)] + [i], 3, 0.0, None) for i in range(120)]  # one element is in many sets
    sets = spark.createDataFrame([*rows, (500, 30, [12345], 0, 0.0, None)], jaccard._SETS)
    last_small = sets.where("n = 2020").select(jaccard._step("n")).first()[0]
    for at in (-1, last_small, last_small + 100):
        together = {}
        for r in jaccard._signatures(sets, at, 9, 10).collect():
            together.setdefault(r.sig, set()).add(r.doc_id)
        want = {(min(ids), i) for ids in together.values() for i in ids if i != min(ids)}
        members = jaccard._members(sets, at, 9, 10)
        found = [tuple(r) for r in members.collect()]
        assert len(found) == len(set(found)) and set(found) == want and len(want) > 100
        assert "Join" not in members._jdf.queryExecution().toString()


def test_language_sample_comes_to_the_driver_packed(spark, sf, monkeypatch):
    """Less than half of the eight bytes for each bucket and weight; unpacked, they are the shares of the buckets in a text."""
    came, kind = [], type(spark.range(1))
    plain = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: came.append(plain(self)) or came[-1])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid._features(langid._sample(docs.select("doc_id", "text", "lang")))
    assert sum(t.nbytes for t in came) < 4 * sum(len(ids) for _, ids, _ in rows) and len(rows) > 50
    want = set()
    for text in [r.text.encode() for r in docs.where("text IS NOT NULL").select("text").collect()]:
        buckets, _ = langid.subwords(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        ids, counts = np.unique(buckets, return_counts=True)
        want.add((ids.astype(np.int32).tobytes(), (counts / max(1, len(buckets))).astype(np.float32).tobytes()))
    assert all((ids.tobytes(), weights.tobytes()) in want for lang, ids, weights in rows if lang is not None)
