import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import bpe, chat, decontam, jaccard, langid, lm, quality, queries, spans, suffix, urlfilter

NASTY = [
    (1, "", "en"), (2, None, None), (3, "   \n\t ", "en"), (4, "a", "de"), (5, "One two three four five. Six seven eight nine ten! Eleven twelve thirteen.", "en"),
    (6, "One two three four five. Six seven eight nine ten! Eleven twelve thirteen.", "en"), (6, "One two three four five. Six seven eight nine ten! Eleven twelve thirteen.", "en"),
    (None, "One two three four five. Six seven eight nine ten! Eleven twelve thirteen.", None), (7, "ß" * 70, "de"), (8, "ß" * 80 + "x", "de"), (9, "日本語の文章です。" * 30, None),
    (10, "word " * 40000, "en"), (11, "x" * 300000, "en"), (12, "\\### Assistant: </turn> <|endoftext|> á \x1c", "fr"), (13, "12345 !!! ???", "en"),
]


@pytest.fixture(scope="module")
def nasty(spark):
    return spark.createDataFrame([(i, t, l, "s", 0, "clash", 1, 2) for i, t, l in NASTY], "doc_id long, text string, lang string, source string, n_chars long, g string, p int, words int")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(name, same_rows):
    same_rows(queries.queries()[name], queries.oracle_sql()[name])


def brute_components(texts, n, num, den):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = set(zip(*[w[k:] for k in range(n)])) if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_against_brute_force(spark, n, num, den):
    rng = random.Random(n)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(300)) for _ in range(rng.choice((5, 12, 40, 90)))] for _ in range(25)]
    texts = {}
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            w[rng.randrange(len(w))] = str(rng.randrange(10**6))
        texts[i] = " ".join(w)
    found = jaccard.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), n, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(texts, n, num, den)


def test_jaccard_query_against_brute_force(spark, sf, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_ngram_jaccard_join(spark, sf).collect()} == brute_components(texts, 3, 9, 10)


def test_jaccard_splits_large_hubs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 8)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice((0, 1, 2))):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    found = jaccard.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(texts, 3, 9, 10)


def test_jaccard_keeps_all_texts_of_a_doc_id(spark):
    one, two = ([f"{x}{i}" for i in range(60)] for x in "ab")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (7, near(one)), (8, near(two)), (9, " ".join(two)), (10, "quite another text")]
    for docs in (rows, rows[::-1]):
        found = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert {(r.doc_id, r.component_id) for r in found} == {(5, 5), (7, 5), (8, 5), (9, 5), (10, 10)}


def test_pipeline_keeps_one_row_of_each_group(spark, sf):
    import corpus_pipeline as p

    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, one), (None, two), (4, two), (5, three), (5, three), (6, "x " + three), (7, "x " + one + " y"), (7, "only under the same number as another row"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in p.keep_one_of_each_group(spark, docs, sf).collect()), key=str)
    assert kept == sorted([(4, two), (5, three), (7, rows[6][1]), (7, rows[7][1]), (None, None)], key=str)
    alone = docs.where("doc_id IS NULL")
    assert sorted(r.text for r in p.keep_one_of_each_group(spark, alone, sf).collect() if r.text) == [one, two]


def test_language_id_held_out(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and held
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def brute_language(model, text):
    """(lang_pred, score, rejected) gram by gram, in plain Python."""
    import math

    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, True
    grams, letters = [], bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    padded = b" " + letters + b"  "
    for i, b in enumerate(letters):
        if b != 32:
            grams += [padded[i] | b << 8 | 1 << 24, padded[i] | b << 8 | padded[i + 2] << 16]
    buckets = [g * 0x9E3779B97F4A7C15 % 2**64 >> 50 for g in grams]
    z = [sum(float(model.scores[b, k]) for b in buckets) / len(buckets) + float(model.bias[k]) for k in range(len(model.bias))]
    p = [math.exp(x - max(z)) for x in z]
    p = [x / sum(p) for x in p]
    best = max(range(len(model.labels)), key=lambda k: (p[k], -k))
    return model.labels[best], p[best], p[best] < model.threshold


def test_language_id_against_brute_force(spark, sf, texts):
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    more = {-1: "ÀÉ déjà", -2: "a", -3: "1 ª", -4: "", -5: None, -6: "x" * 5000}
    df = spark.createDataFrame(list({**texts, **more}.items()), "doc_id long, text string")
    for r in langid.predict(df, model).collect():
        label, score, rejected = brute_language(model, texts.get(r.doc_id, more.get(r.doc_id)))
        assert r.lang_pred == label and abs(r.score - score) < 1e-6 and (r.rejected == rejected or abs(score - model.threshold) < 1e-6), r


def test_language_id_rejects_other_languages_only(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    other = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.", "Minden emberi lény szabadon születik és egyenlő méltósága és joga van.", "Zxqv kwrtp gfdh jklq mnbvc xzqw.",
    ]
    rng = np.random.default_rng(11)
    plain = [r.text for r in docs.where("doc_id % 5 = 0 AND length(text) > 200").collect()][:40]
    hidden = [bytes(langid.disguised(d := np.frombuffer(t.encode(), np.uint8), np.array([0, len(d)]), rng)).decode(errors="replace") for t in plain]
    rows = [(i, t) for i, t in enumerate(other)] + [(100 + i, t) for i, t in enumerate(hidden)]
    gone = {r.doc_id: r.rejected for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert sum(gone[i] for i in range(len(other))) >= 7 and np.mean([gone[100 + i] for i in range(len(hidden))]) > 0.9, gone
    found = langid.predict(docs, model).collect()
    assert np.mean([r.rejected for r in found if r.lang_pred != "und"]) < 0.02


def test_language_id_learns_all_labels_or_refuses(spark, monkeypatch):
    rows = [(i, f"word{i % 40} " * 30, f"l{i % 40:02}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.train(docs).labels) == 40
    monkeypatch.setattr(langid, "MOST_ROWS", 39)
    with pytest.raises(ValueError, match="40 labels"):
        langid.train(docs)
    assert langid.train(docs.where("lang IS NULL")) is None


def test_bpe_equals_the_library(spark, sf, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    for r in queries.op7_bpe(spark, sf).collect():
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_nasty_texts_and_join_repair(spark, nasty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = sorted((i is None, i or 0, tok.encode(t or "", add_special_tokens=False).ids) for i, t, _ in NASTY)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in bpe.encode_documents(nasty, queries.tokenizer_path()).collect())
    assert got == want
    with open(queries.tokenizer_path(), "rb") as f:
        codec = bpe.Codec(f.read())
    assert codec.separates()
    assert codec.marks[ord(".")] is not None
    for word in ("end.", "end..", "a.b.", "it's.", "Zoë,", "É!", "x?!", "1.", "<|endoftext|>.", "a<|endoftext|", "ﬁ;", "don't:"):
        assert codec.chunk(word.encode()) == codec.encode(word)
    left, right = b"some word in", b"side it all"  # a cut inside a word: the join has to be encoded again
    a, b = codec.chunk(left), codec.chunk(right)
    n, ids, m = codec.join(left, right, a, b)
    assert a[: len(a) - n] + ids + b[m:] == codec.encode((left + right).decode())


def test_bpe_tells_texts_of_one_pattern_apart(spark):
    """Thue-Morse strings, which collide in polynomial hashes modulo a power of two, as one word and as words."""
    from tokenizers import Tokenizer

    tok, line = Tokenizer.from_file(queries.tokenizer_path()), "a"
    while len(line) < 4096:
        line += line.translate({97: 98, 98: 97})
    other = line.translate({97: 98, 98: 97})
    texts = {i: t for i, t in enumerate((line, other, " ".join(line), " ".join(other), f"one {line} two", f"one {other} two", "x " + line[:2048] + " " + other[:2048]))}
    for r in bpe.encode_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), queries.tokenizer_path()).collect():
        want = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (want, tok.decode(want, skip_special_tokens=False))


def test_bpe_refuses_tokenizers_that_see_blanks(spark):
    docs = spark.createDataFrame([(1, "a  b")], "doc_id long, text string")
    with pytest.raises(ValueError, match="white space"):
        bpe.encode_documents(docs, queries.tokenizer_path("byte_bpe_50k.json"))


def test_bpe_keeps_chunks_of_one_key_apart(spark, monkeypatch):
    """With a first hash that says the same of all chunks and words, the second one and the bytes decide."""
    from tokenizers import Tokenizer

    from corvane.llm import textkit as tk

    rng, tok, real = random.Random(3), Tokenizer.from_file(queries.tokenizer_path()), tk.span_hashes
    texts = [" ".join("".join(rng.choices("abcde", k=rng.randrange(1, 7))) for _ in range(3000)) for _ in range(3)]
    table = pa.table({"doc_id": [1, 2, 3, 4], "text": [*texts, texts[0]]})
    calls = lambda data, start, end, seed=0: real(data, start, end, seed or 1) if seed == bpe._SECOND else real(data, start, end) % tk.U(7)
    monkeypatch.setattr(tk, "span_hashes", calls)
    with open(queries.tokenizer_path(), "rb") as f:
        codec = bpe.Codec(f.read())
    chunks = bpe._Chunks(table)
    ids, counts = chunks.encode(codec, np.arange(len(chunks.keys)))
    at = np.concatenate(([0], np.cumsum(counts)))
    for d, text in enumerate(table["text"].to_pylist()):
        got = [i for k in chunks.key[chunks.doc_off[d] : chunks.doc_off[d + 1]] for i in ids[at[k] : at[k + 1]].tolist()]
        assert got == tok.encode(text, add_special_tokens=False).ids


def brute_repeats(texts, length=50):
    seen, out = {}, {}
    for i in sorted(texts):
        b = texts[i].encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if seen.get(b[j : j + length], i) < i:
                gone[j : j + length] = True
        for j in range(len(b) - length + 1):
            seen.setdefault(b[j : j + length], i)
        edge = np.diff(np.concatenate(([0], gone.astype(int))))
        out[i] = (len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def test_suffix_against_brute_force(spark, sf, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op10_suffix_array_dedup(spark, sf).collect()}
    assert got == brute_repeats(texts)


def test_two_stage_sorting():
    rng = np.random.default_rng(0)
    for _ in range(200):
        t = rng.integers(0, int(rng.integers(1, 5)) + 1, int(rng.integers(1, 60))).astype(np.uint8)
        b = t.tobytes()
        assert [b[i:] for i in suffix.two_stage_suffix_array(t, 64)] == sorted(b[i:] for i in range(len(b)))


def test_suffix_texts_stay_valid(spark, nasty):
    rows = suffix.remove_repeats(nasty, keep=("g", "source")).collect()
    assert len(rows) == len(NASTY) and all(r.g == "clash" for r in rows)
    kept = {r.doc_id: r.kept for r in rows}
    assert kept[7] == "ß" * 70 and kept[8] == "x" and kept[2] is None and kept[1] == "" and kept[11] == "x" * 300000


def test_leaks_remove(spark):
    docs = spark.createDataFrame([(1, "Clean text here."), (2, "before A b c d e f g h i j k after"), (3, None), (2, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "a B c, d e f g h i j"), (6, "k after"), (7, None), (None, "")], "item_id long, text string")
    assert sorted((r.doc_id, r.text) for r in decontam.remove_leaks(docs, bench).collect() if r.text) == [(1, "Clean text here."), (2, "before ")]
    report = [r for r in decontam.leak_report(docs, bench).collect() if r.n_hit]
    assert [(r.doc_id, r.n_hit, r["items"]) for r in report] == [(2, 12, ["5", "6"])]
    assert decontam.remove_leaks(docs, bench, drop="documents").count() == 3
    more = docs.selectExpr("*", "'k' AS items", "7 AS hits", "'t' AS __0")
    for drop, n in (("spans", 4), ("documents", 3)):
        kept = decontam.remove_leaks(more, bench, drop=drop, keep=("items", "hits", "__0")).collect()
        assert len(kept) == n and {(r["items"], r.hits, r["__0"]) for r in kept} == {("k", 7, "t")}
    assert decontam.remove_leaks(docs.limit(0), bench).collect() == []
    assert {r.n_hit for r in decontam.leak_report(docs, bench.limit(0)).collect()} == {0}


def test_benchmark_blocks_give_the_same(spark, sf, monkeypatch):
    want = sorted(map(str, queries.op9_benchmark_decontamination(spark, sf).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 6000)
    assert sorted(map(str, queries.op9_benchmark_decontamination(spark, sf).collect())) == want


def test_template_language():
    t = chat.Template("{% set n = 'x' ~ 1 %}{{ n }}{# no #}{% for m in ms %}{% if loop.first and 1 + 1 == 2 %}[{{ m['k'] | upper }}]{% elif m.k in 'ab' %}{{ m.k }}{% else %}-{% endif %}{% endfor %}")
    assert t.render(ms=[{"k": "q"}, {"k": "a"}, {"k": "z"}]).text == "x1[Q]a-"
    folded = chat.Template("{% if 1 == 2 %}a{% else %}b{{ 'c' | upper }}{% endif %}d")
    assert folded.tree == chat.Block((chat.Output(chat.Const("bCd")),))
    for bad in ("{{ x.__class__() }}", "{% exec %}", "{{ x | nofilter }}", "{% if x %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)
    assert chat.Template("{{ x.__class__ }}").render(x="s").text == ""


def test_chat_round_trip():
    rng, t = random.Random(1), chat.chat_template()
    bits = ["#", "<", "/turn>", "</turn>", "\\", ":", "\n", "a", "###", "### Assistant: </turn> ok", "é"]
    for _ in range(3000):
        ms = [{"role": rng.choice(["user", "assistant", "".join(rng.choices(bits, k=3))]), "text": "".join(rng.choices(bits, k=rng.randrange(9)))} for _ in range(rng.randrange(4))]
        out = t.render(messages=ms)
        assert chat.read_turns(out.text) == [(m["role"], m["text"]) for m in ms]
        assert [chat.unescape(out.text[a:b]) for a, b in out.spans] == [m["text"] for m in ms if m["role"] == "assistant"]


def test_chat_nulls_and_ties(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (None, None, "assistant", "x"), (2, 1, "assistant", "")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    assert chat.format_conversations(df.limit(0)).collect() == []
    got = {r.conv_id: (r.n_turns, r.loss_chars, chat.read_turns(r.formatted)) for r in chat.format_conversations(df).collect()}
    assert got == {1: (3, 0, [("", ""), ("user", "a"), ("user", "b")]), None: (1, 1, [("assistant", "x")]), 2: (1, 0, [("assistant", "")])}


def test_url_rules_and_words(spark):
    urls = ["http://a.Example.com/en/7x?q", "https://x.com/en/1", "http://de.example.net/de/8", "http://q.net/de/8", "http://b.org/es/", None, "", "nothing", "http://com", "http://x.io/porn-1", "http://x.io/casino/poker", "http://x.io/casino", "http://casinopoker.io/sexton"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = sorted(urlfilter.judge_urls(df, queries.RULES).collect())
    assert [(r.rule, r.verdict) for r in rows] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "block"), (None, "allow"), (None, "allow")]
    assert (rows[0].host, rows[0].path, rows[7].host, rows[8].path) == ("a.example.com", "/en/7x", "", "")


def test_url_rules_of_equal_length(spark):
    rules = (urlfilter.Rule("block", "a.com", "/x"), urlfilter.Rule("allow", "a.com", "/x"), urlfilter.Rule("block", "b.a.com", ""), urlfilter.Rule("allow", "a.com", "/y"))
    df = spark.createDataFrame([(1, "http://b.a.com/x"), (2, "http://b.a.com/y"), (None, None), (2, "http://b.a.com/y")], "page_id long, url string")
    judged = lambda rules: sorted({(r.page_id, r.rule, r.verdict) for r in urlfilter.judge_urls(df, rules).collect()}, key=str)
    assert judged(rules) == [(1, "a.com/x", "block"), (2, "b.a.com", "block"), (None, None, "allow")]
    assert judged(rules[::-1]) == [(1, "b.a.com", "block"), (2, "a.com/y", "allow"), (None, None, "allow")]
    assert urlfilter.judge_urls(df, rules).count() == 4 and urlfilter.judge_urls(df.limit(0), rules).collect() == []


def test_no_shared_folder_on_a_cluster():
    from corvane.llm import storage

    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                class _sc:
                    class getCheckpointDir:
                        isDefined = staticmethod(lambda: False)

                    getCheckpointDir = staticmethod(lambda: type("none", (), {"isDefined": staticmethod(lambda: False)}))

                sc = staticmethod(lambda: Session.sparkContext._jsc._sc)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session)


def test_spans_keep_the_first(spark):
    s = [f"Sentence number {i} has its own words." for i in range(9)]
    docs = spark.createDataFrame([(1, " ".join(s[:5])), (2, "Start here. " + " ".join(s[1:5]) + " End here."), (3, " ".join(s[:2])), (4, None), (None, " ".join(s[:3]))], "doc_id long, text string")
    got = {r.doc_id: (r.removed, r.kept) for r in spans.remove_repeated_spans(docs).collect()}
    assert got[1] == ([], " ".join(s[:5])) and got[2] == ([1, 2, 3, 4], "Start here. End here.") and got[3][0] == [] and got[4] == ([], None) and got[None] == ([0, 1, 2], "")


def test_spans_cut_passages_of_fifty_words(spark):
    p = [f"p{i}" for i in range(51)]
    rows = [(1, "Before one. " + " ".join(p) + ". After one."), (2, "Before two. " + " ".join(p[:25]) + ". " + " ".join(p[25:]) + ". Then two."), (3, "Before three goes on " + " ".join(p[:30]) + ". " + " ".join(p[30:]) + " and so on."), (4, "Some short " + " ".join(p[:49]) + " end."), (5, None), (6, "w " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.removed, (r.kept or "").split()) for r in spans.remove_repeated_spans(docs, words=50).collect()}
    assert got[1][1] == rows[0][1].split() and got[2] == ([1, 2], "Before two. Then two.".split())
    assert got[3] == ([0, 1], "Before three goes on and so on.".split()) and got[4][1] == rows[3][1].split() and got[5] == ([], []) and got[6][1] == ["w"]


def test_quality_base_measures(spark, texts):
    df = spark.createDataFrame([(i, t, "en") for i, t in texts.items()] + [(-1, None, None), (-2, "a b c d e " * 9, "en")], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in quality.judge(df).collect()}
    for i, t in {**texts, -1: "", -2: "a b c d e " * 9}.items():
        w, at = re.findall(r"[^\x20\x09-\x0D]+", t), defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        covered = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(5)}
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_quality_rejects_texts_without_common_words(spark):
    rng = random.Random(5)
    rare = [f"{a}{b}{c}or" for a in "bdfgklmn" for b in "aeiou" for c in "rstvz"]
    prose = lambda n, share: " ".join(rng.choice(quality.COMMON[:12]) if rng.random() < share else rng.choice(rare) for _ in range(n))
    good = [(i, prose(1500, 0.2)) for i in range(40)]
    bad = [(100, prose(300, 0.0)), (101, prose(3000, 0.0)), (102, prose(3000, 0.002))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in [*good, *bad, (200, prose(60, 0.0))]], "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality.judge(docs).collect() if not r.kept} == {100, 101, 102}


OPERATORS = {
    "jaccard": jaccard.jaccard_components,
    "langid": lambda d: langid.predict(d, langid.train(d)),
    "lm": lm.backoff_scores,
    "quality": quality.judge,
    "spans": spans.remove_repeated_spans,
    "bpe": lambda d: bpe.encode_documents(d, queries.tokenizer_path(), digests=True),
    "leaks": lambda d: decontam.leak_report(d, d.selectExpr("doc_id as item_id", "text").limit(4)),
    "suffix": suffix.remove_repeats,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_nasty_rows_and_empty_tables(name, nasty):
    rows = OPERATORS[name](nasty).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _, _ in NASTY)
    assert OPERATORS[name](nasty.limit(0)).collect() == []
    if name == "jaccard":
        comp = {r.doc_id: r.component_id for r in rows}
        assert comp[5] == comp[6] == 5 and comp[1] == 1 and comp[None] == 5
    if name == "langid":
        assert {r.doc_id for r in rows if r.lang_pred == "und"} >= {1, 2, 3, 13}


def test_pipeline_stages(spark, sf, texts):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(p.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "bpe_encoding"]
    kept = stages["language_id"](spark, docs, sf)
    assert sorted(kept.columns) == sorted(docs.columns) and kept.count() >= 0.95 * len(texts)
    one = {r.doc_id for r in stages["ngram_jaccard_join"](spark, docs, sf).collect()}
    assert one == {i for i, (_, c) in brute_components(texts, 5, 4, 5).items() if i == c}
    cut = {r.doc_id: r.text for r in stages["suffix_array_dedup"](spark, docs, sf).collect()}
    want = brute_repeats(texts)
    assert all(cut[i] == t for i, t in texts.items() if want[i][1] == 0)
    assert all(len(cut.get(i, "").encode()) < n for i, (n, gone, _, _) in want.items() if gone > 8)
    leaks = {r.doc_id for r in queries.op9_benchmark_decontamination(spark, sf).collect() if r.contaminated}
    clean = stages["benchmark_decontamination"](spark, docs, sf)
    assert {r.doc_id for r in clean.collect()} == set(texts) - leaks and sorted(clean.columns) == sorted(docs.columns)
    assert p.run(spark, sf).columns == ["doc_id", "n_tokens", "ids"]


def test_pipeline_against_brute_force(spark, sf, texts):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    left = {i: t for i, t in texts.items() if not brute_language(model, t)[2]}
    one_each = brute_components(left, 5, 4, 5)
    left = {i: t for i, t in left.items() if one_each[i][1] == i}
    seen, cut = {}, {}
    for i in sorted(left):
        b = left[i].encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if seen.setdefault(b[j : j + 50], i) < i:
                gone[j : j + 50] = True
        at, kept = 0, []
        for c in left[i]:
            size = len(c.encode())
            kept.append("" if gone[at : at + size].all() else c)
            at += size
        if "".join(kept):
            cut[i] = "".join(kept)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + n]) for w in (words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()) if w for n in [min(10, len(w))] for k in range(len(w) - n + 1)}
    sizes = {len(w) for w in windows}
    leaks = lambda t: any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))
    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = {i: tok.encode(t, add_special_tokens=False).ids for i, t in cut.items() if not leaks(t)}
    got = p.run(spark, sf).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want) and all(r.n_tokens == len(r.ids) for r in got)


def test_pipeline_nasty_rows(spark, sf, nasty):
    import corpus_pipeline as p

    for rows in (nasty, nasty.limit(0)):
        for _, stage in p.STAGES:
            stage(spark, rows, sf).collect()
