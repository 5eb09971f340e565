"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, decontam, jaccard, langid, lm, quality, spans, spelling, suffix, toxicity, urlfilter

TOKENIZER = "word_bpe_49k.json"
RULES = (
    urlfilter.Rule("block", "com", "/en/"),
    urlfilter.Rule("allow", "example.com", "/en/7"),
    urlfilter.Rule("allow", "net", "/de/"),
    urlfilter.Rule("block", "example.net", "/de/8"),
    urlfilter.Rule("block", "org", "/es/"),
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"), n=3, num=9, den=10)


def op2_language_id(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", langid.is_held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_chat_formatting(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.format_conversations(rows.unionByName(extra), texts=False)


def op4_lm_scoring(spark, sf_dir):
    found = lm.backoff_scores(_read(spark, sf_dir, "documents"), order=3, least=2)
    return found.select("doc_id", "n_words", "n_backoff", F.round("log_score", 4).alias("log_score"))


def op5_quality_rules(spark, sf_dir):
    return quality.judge(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_substring_dedup(spark, sf_dir):
    """Spans of three sentences, and runs of 50 words wherever they begin."""
    found = spans.remove_repeated_spans(_read(spark, sf_dir, "documents"), size=3, words=50)
    return found.select("doc_id", "n_sentences", F.size("removed").cast("long").alias("n_removed"), F.sha2(F.concat_ws(",", F.col("removed").cast("array<string>")), 256).alias("removed_sha256"), "n_words_removed")


def op7_bpe(spark, sf_dir):
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


def op8_url_filters(spark, sf_dir):
    return urlfilter.judge_urls(_read(spark, sf_dir, "pages"), RULES)


def op9_benchmark_decontamination(spark, sf_dir):
    found = decontam.leak_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), n=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_suffix_array_dedup(spark, sf_dir):
    found = suffix.remove_repeats(_read(spark, sf_dir, "documents"), length=50, texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def op11_toxicity(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))
    return found.select("doc_id", langid.is_held_out().alias("held_out"), "score", "predicted")


def op12_centroid_clustering(spark, sf_dir):
    return centroids.cluster(_read(spark, sf_dir, "embeddings"), k=40, rounds=5)


def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_ngram_jaccard_join, op2_language_id, op3_chat_formatting, op4_lm_scoring, op5_quality_rules, op6_substring_dedup, op7_bpe, op8_url_filters,
            op9_benchmark_decontamination, op10_suffix_array_dedup, op11_toxicity, op12_centroid_clustering, op13_spelling_variants,
        )
    }


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"


def _sql_escaped_length(column: str) -> str:
    runs = f"coalesce(list_sum(list_transform(regexp_extract_all({column}, '#{{3,}}'), lambda x: length(x) - 2)), 0)"
    times = lambda s: f"((length({column}) - length(replace({column}, {s}, ''))) // length({s}))"
    lone = " + ".join(times(s) for s in ("'\\'", "'</turn>'", "(':' || chr(10))"))
    return f"(length({column}) + {runs} + {lone})"


def _sql_chat() -> str:
    said = "'\\### Assistant: </turn> ok'"
    return f"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', {said} UNION ALL SELECT -7, 1, 'assistant', {said})
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum({_sql_escaped_length("role")} + {_sql_escaped_length("text")} + length('### :' || chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
    FROM rows GROUP BY conv_id"""


def _sql_lm() -> str:
    return f"""
    WITH w AS (
      SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') AS ws FROM documents)),
    g AS (
      SELECT doc_id, i, w AS a, lag(w) OVER d || ' ' || w AS b, lag(w, 2) OVER d || ' ' || lag(w) OVER d || ' ' || w AS c, lag(w) OVER d AS ctx
      FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    c1 AS (SELECT a, count(*) AS n FROM g GROUP BY a), c2 AS (SELECT b, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b), c3 AS (SELECT c, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY c),
    s AS (
      SELECT g.doc_id, g.i,
        CASE WHEN c3.n >= 2 AND p2.n >= 2 THEN 3 WHEN c2.n >= 2 THEN 2 ELSE 1 END AS depth,
        CASE WHEN c3.n >= 2 AND p2.n >= 2 THEN ln(c3.n / p2.n) WHEN c2.n >= 2 THEN ln(c2.n / p1.n) ELSE ln(c1.n / (SELECT count(*) FROM g)) END AS score
      FROM g JOIN c1 ON g.a = c1.a LEFT JOIN c2 ON g.b = c2.b LEFT JOIN c3 ON g.c = c3.c LEFT JOIN c1 p1 ON g.ctx = p1.a
      LEFT JOIN c2 p2 ON p2.b = regexp_replace(g.c, ' [^ ]*$', '')),
    t AS (SELECT doc_id, count(*) AS n_words, sum(least(3, i) - depth)::BIGINT AS n_backoff, sum(score + (least(3, i) - depth) * ln(0.4)) AS log_score FROM s GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(coalesce(log_score, 0.0), 4) AS log_score
    FROM documents d LEFT JOIN t USING (doc_id)"""


def _sql_quality() -> str:
    common = "[" + ", ".join(f"'{w}'" for w in quality.COMMON) + "]"
    classes = [f"length(regexp_replace(t, '[^{k.replace(chr(39), chr(39) * 2)}]+', '', 'g'))::DOUBLE" for k in quality.CLASSES.values()]
    symbols = list(quality.CLASSES).index("symbols") + 1
    js = """(SELECT CASE WHEN sp > 0 AND sq > 0 THEN sqrt(greatest(0, (SELECT sum(CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2
      FROM (SELECT unnest(list_transform({p}, lambda x: x / sp)) AS a, unnest(list_transform({q}, lambda x: x / sq)) AS b)))) END
      FROM (SELECT list_sum({p}) AS sp, list_sum({q}) AS sq))"""
    return f"""
    WITH base AS (
      SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM documents),
    win AS (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n
      FROM (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS w FROM base WHERE len(ws) >= 5)),
    rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(5) r(k) WHERE n > 1 GROUP BY doc_id),
    cls AS (SELECT doc_id, [{", ".join(classes)}] AS c, length(t)::DOUBLE AS n FROM base),
    word AS (
      SELECT doc_id, list_append(wc, len(ws) - list_sum(wc)) AS wc FROM (SELECT doc_id, ws, list_transform({common}, lambda x: len(list_filter(ws, lambda y: y = x))::DOUBLE) AS wc FROM base)),
    m AS (
      SELECT doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, c[{symbols}]::BIGINT AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
        len(ws) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(ws) AS base_failed, list_append(c, cls.n - list_sum(c)) AS p, wc
      FROM base JOIN cls USING (doc_id) JOIN word USING (doc_id) LEFT JOIN rep USING (doc_id)),
    sums AS (
      SELECT lang, list(s ORDER BY k) AS q FROM (SELECT lang, k, sum(x) AS s FROM (SELECT lang, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM m WHERE NOT base_failed AND lang IS NOT NULL) GROUP BY lang, k) GROUP BY lang),
    wsums AS (
      SELECT lang, list(s ORDER BY k) AS wq FROM (SELECT lang, k, sum(x) AS s FROM (SELECT lang, unnest(wc) AS x, generate_subscripts(wc, 1) AS k FROM m WHERE NOT base_failed AND lang IS NOT NULL) GROUP BY lang, k) GROUP BY lang),
    d AS (SELECT m.*, {js.format(p="p", q="q")} AS cd, {js.format(p="wc", q="wq")} AS wd FROM m LEFT JOIN sums USING (lang) LEFT JOIN wsums USING (lang))
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
      NOT base_failed AND NOT coalesce(cd > {quality.MOST_CLASS_DISTANCE} AND list_sum(p) >= {quality.LEAST_CHARS}, false)
        AND NOT coalesce(wd > {quality.MOST_WORD_DISTANCE} AND list_sum(wc) >= {quality.LEAST_WORDS}, false) AS kept
    FROM d"""


def _sql_spans() -> str:
    return rf"""
    WITH s AS (
      SELECT doc_id, list_filter(list_transform(string_split_regex({_LOWER.format("text")}, '[.!?\n]'),
        lambda x: array_to_string(regexp_extract_all(x, '{_WORD}'), ' ')), lambda x: x <> '') AS ss FROM documents),
    span AS (
      SELECT doc_id, unnest(range(len(ss) - 2)) AS i, unnest(list_transform(range(len(ss) - 2), lambda i: array_to_string(ss[i + 1:i + 3], chr(10)))) AS t FROM s WHERE len(ss) >= 3),
    later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM span) WHERE r > 1),
    gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(3) r(k)),
    w AS (
      SELECT doc_id, flatten(list_transform(ss, lambda x: string_split(x, ' '))) AS ws,
        flatten(list_transform(range(len(ss)), lambda i: list_transform(string_split(ss[i + 1], ' '), lambda x: i))) AS si FROM s WHERE len(ss) > 0),
    run AS (
      SELECT doc_id, unnest(range(len(ws) - 49)) AS i, unnest(list_transform(range(len(ws) - 49), lambda i: md5(array_to_string(ws[i + 1:i + 50], ' ')))) AS t FROM w WHERE len(ws) >= 50),
    later_run AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM run) WHERE r > 1),
    word AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(si) AS si FROM w),
    cut AS (SELECT DISTINCT doc_id, i + k AS i FROM later_run, range(50) r(k)),
    lost AS (SELECT doc_id, word.i, si FROM word SEMI JOIN cut USING (doc_id, i) UNION SELECT word.doc_id, word.i, si FROM word JOIN gone ON word.doc_id = gone.doc_id AND word.si = gone.i),
    g AS (SELECT doc_id, count(*) AS n, string_agg(i::VARCHAR, ',' ORDER BY i) AS x, sum(words)::BIGINT AS words FROM (SELECT doc_id, si AS i, count(*) AS words FROM lost GROUP BY doc_id, si) GROUP BY doc_id)
    SELECT s.doc_id, len(coalesce(ss, [])) AS n_sentences, coalesce(n, 0) AS n_removed, sha256(coalesce(x, '')) AS removed_sha256, coalesce(words, 0) AS n_words_removed FROM s LEFT JOIN g USING (doc_id)"""


def _sql_urls() -> str:
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
    hit = lambda terms: " + ".join(f"(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)'))::BIGINT" for t in terms)
    return rf"""
    WITH p AS (SELECT page_id, {_LOWER.format("coalesce(url, '')")} AS u, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
    h AS (SELECT page_id, u, {_LOWER.format(r"regexp_extract(r, '^[^/?#]*')")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
    rules(verdict, rh, rp) AS (VALUES {rules}),
    m AS (SELECT page_id, max_by(verdict, length(rh || rp)) AS v, max_by(rh || rp, length(rh || rp)) AS rule FROM h JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY page_id),
    c AS (SELECT page_id, host, path, {hit(urlfilter.STRICT)} AS n_strict, {hit(urlfilter.SOFT)} AS n_soft FROM h)
    SELECT c.page_id, host, path, rule, coalesce(v, CASE WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM c LEFT JOIN m USING (page_id)"""


def _sql_leaks() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda t, k: f"SELECT {k} AS k, regexp_extract_all({_LOWER.format('text')}, '{word}') AS ws FROM {t}"
    return f"""
    WITH b AS ({words("benchmark", "item_id")}), d AS ({words("documents", "doc_id")}),
    bw AS (SELECT DISTINCT k, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS w FROM (SELECT *, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0)),
    dw AS (SELECT k, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS w FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n),
    hit AS (SELECT dw.k, dw.n, i, bw.k AS item FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n),
    cover AS (SELECT k, count(DISTINCT i + j) AS n_hit FROM hit, range(10) r(j) WHERE j < n GROUP BY k),
    items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS x FROM (SELECT DISTINCT k, item::VARCHAR AS item FROM hit) GROUP BY k)
    SELECT d.k AS doc_id, coalesce(len(ws), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN cover USING (k) LEFT JOIN items USING (k)"""


def _sql_centroids(k: int = 40, rounds: int = 5) -> str:
    def near(r):
        return f"""
    a{r} AS MATERIALIZED (
      SELECT rid, k, d FROM (SELECT rid, k, d, row_number() OVER (PARTITION BY rid ORDER BY d, k) AS r FROM (
        SELECT rid, k, sum((xs.x - c.x) * (xs.x - c.x))::BIGINT AS d FROM xs JOIN c{r} c USING (i) GROUP BY rid, k)) WHERE r = 1)"""

    def moved(r):
        return f"""
    c{r + 1} AS MATERIALIZED (
      SELECT k, i, coalesce((s - ((s % n) + n) % n) // n, x)::BIGINT AS x FROM c{r} LEFT JOIN (
        SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN xs USING (rid) GROUP BY k, i) m USING (k, i))"""

    steps = ",".join(f"{near(r)},{moved(r)}" for r in range(rounds))
    return f"""
    WITH x AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS rid, vec_id, v FROM (
        SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)),
    xs AS MATERIALIZED (SELECT rid, unnest(range(64)) AS i, unnest(v) AS x FROM x),
    c0 AS MATERIALIZED (SELECT rid AS k, i, x FROM xs WHERE rid < {k}),{steps},{near(rounds)},
    g AS (SELECT k, sum(d)::BIGINT AS s FROM a{rounds} GROUP BY k),
    h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k)
    SELECT vec_id, k::INTEGER AS cluster, d AS distance, s AS cluster_inertia, (SELECT sum(d)::BIGINT FROM a{rounds}) AS inertia, h AS centroid_sha256
    FROM a{rounds} JOIN x USING (rid) JOIN g USING (k) JOIN h USING (k)"""


def _sql_spelling() -> str:
    low = _LOWER.format("run")
    return f"""
    WITH RECURSIVE tab AS (
      SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    r AS (SELECT d, {low} AS w FROM (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents)),
    u AS (SELECT d, w, count(*) AS n FROM r GROUP BY d, w),
    b AS (SELECT w, n, hex(encode(d || ':' || w)) AS x FROM u),
    h AS (
      SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x), 2), lambda i: 16 * strpos('0123456789ABCDEF', x[i + 1]) + strpos('0123456789ABCDEF', x[i + 2]) - 17)),
        lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM b, tab),
    v AS MATERIALIZED (
      SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h)
      WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    cut AS MATERIALIZED (SELECT word, n, i, left(word, i::INT) AS p, substr(word, i::INT + 2) AS q FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
    near AS MATERIALIZED (
      SELECT DISTINCT * FROM (
        SELECT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.p = b.p AND a.q = b.q AND a.word <> b.word
        UNION ALL SELECT cut.word, v.word, v.n FROM cut JOIN v ON v.word = p || q
        UNION ALL SELECT v.word, cut.word, cut.n FROM cut JOIN v ON v.word = p || q)),
    best AS (SELECT a, b, n, k FROM (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS k, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM near) WHERE r = 1),
    f AS MATERIALIZED (SELECT word, v.n, coalesce(k, 0) AS n_near, CASE WHEN best.n >= 10 * v.n THEN b END AS form, CASE WHEN best.n >= 10 * v.n THEN best.n END AS form_n FROM v LEFT JOIN best ON word = a),
    walk AS (SELECT word, coalesce(form, word) AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.at = f.word WHERE f.form IS NOT NULL AND walk.at <> walk.word)
    SELECT f.word, f.form, last.root, f.n, f.n_near, f.form_n
    FROM f JOIN (SELECT walk.word, walk.at AS root FROM walk JOIN f ON walk.at = f.word WHERE f.form IS NULL) last ON last.word = f.word"""


def oracle_sql() -> dict[str, str]:
    return {
        "op12_centroid_clustering": _sql_centroids(),
        "op13_spelling_variants": _sql_spelling(),
        "op3_chat_formatting": _sql_chat(),
        "op4_lm_scoring": _sql_lm(),
        "op5_quality_rules": _sql_quality(),
        "op6_substring_dedup": _sql_spans(),
        "op8_url_filters": _sql_urls(),
        "op9_benchmark_decontamination": _sql_leaks(),
    }
