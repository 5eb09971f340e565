"""The library's operators applied to the test tables, each with an independently written DuckDB statement.

The documents table has no Markdown, so operators on notes run on the column that has their structure: page markup
for links and headings, events for logs, labels for trust fields. Operators on CJK and Markdown syntax are tested on
fixtures in tests/.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import rules as R
from corvane.functions import text as T
from corvane.operators import activity, checks, conflicts, graph, ledger, postings, search, similarity
from corvane.sources import readers, shared, sinks

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def events(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# --- tokens and search -------------------------------------------------------------------------------------------

_TOKENS = """flatten(list_transform(regexp_extract_all(lower(text), '[a-z0-9_.\\-]+'), lambda w: list_concat([w],
  CASE WHEN len(string_split_regex(w, '[._\\-]+')) > 1 THEN list_filter(string_split_regex(w, '[._\\-]+'), lambda p: length(p) > 1 AND p <> w) ELSE [] END)))"""


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def tok1_index_tokens(spark, sf_dir):
    t = documents(spark, sf_dir).select("doc_id", T.index_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents), n AS (SELECT count(*) AS n FROM t)
  SELECT w AS term, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf
  FROM (SELECT doc_id, unnest(list_distinct(t)) AS w FROM t), n GROUP BY w""")  # fmt: skip
def agg1_term_statistics(spark, sf_dir):
    found = search.term_statistics(documents(spark, sf_dir).select(F.col("text").alias("content")))
    return found.select("term", "df", F.round("idf", 6).alias("idf"))


SEARCH = [search.Term("the", 1.0), search.Term("and", 1.0), search.Term("that", 1.5), search.Term("with", 1.8), search.Term("thing", 0.9, False)]
_PHRASE = "that the"


def _search_sql(docs: str = "documents") -> str:
    terms = ", ".join(f"({i}, '{t.text}', {t.weight}, {str(t.core).lower()})" for i, t in enumerate(SEARCH))
    return f"""
    WITH d AS (SELECT doc_id, lower(text) AS raw, ['lang/' || lang, 'source/' || source] AS tags, lower(split_part(text, chr(10), 1)) AS title, {_TOKENS} AS t, string_split(text, chr(10)) AS ls FROM {docs}),
    terms(i, q, w, core) AS (VALUES {terms}),
    st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
    df AS (SELECT i, q, w, core, CASE WHEN count(*) FILTER (list_contains(t, q)) = 0 THEN 1.0 ELSE ln(1 + ((SELECT n FROM st) - count(*) FILTER (list_contains(t, q)) + 0.5) / (count(*) FILTER (list_contains(t, q)) + 0.5)) END AS idf FROM terms, d GROUP BY ALL),
    s AS (SELECT doc_id, sec, text, {_TOKENS} AS t FROM (SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS sec FROM d)),
    sc AS (
      SELECT doc_id, sec, sum(CASE WHEN tf > 0 THEN w * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean)) ELSE 0 END) + any_value(CASE WHEN contains(lower(text), '{_PHRASE}') THEN 8 ELSE 0 END) AS score
      FROM (SELECT s.*, df.*, (SELECT mean FROM st) AS mean, len(list_filter(s.t, lambda x: x = q)) AS tf FROM s, df) GROUP BY doc_id, sec),
    best AS (SELECT doc_id, max(score) AS score, arg_min(sec, (-score, sec)) AS sec FROM sc GROUP BY doc_id),
    boost AS (
      SELECT doc_id, sum(CASE WHEN contains(title, q) THEN idf * w * 3.5 ELSE 0 END + CASE WHEN len(list_filter(tags, lambda x: contains(x, q))) > 0 THEN idf * w * 4.0 ELSE 0 END) + any_value(CASE WHEN contains(title, '{_PHRASE}') THEN 20 ELSE 0 END) AS b,
        count(*) FILTER (core AND (contains(raw, q) OR contains(title, q) OR contains(array_to_string(tags, ' '), q))) / (count(*) FILTER (core)) AS cov
      FROM d, df GROUP BY doc_id),
    f AS (SELECT doc_id, CASE WHEN score > 0 THEN sec ELSE 0 END AS section, (greatest(score, 0) + b) * pow(cov, 1.5) * CASE WHEN list_contains(tags, 'lang/en') THEN 2.5 ELSE 0.2 END + CASE WHEN cov >= 0.99 THEN 5 ELSE 0 END AS score
      FROM best JOIN boost USING (doc_id) JOIN d USING (doc_id))
    SELECT doc_id AS rel, section::INT AS section, round(score, 4) AS score FROM f WHERE score > 0.5"""


def _search_notes(docs: DataFrame) -> DataFrame:
    body = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.lit(None).cast("string").alias("heading"), x.alias("body")))
    tags = F.array(F.concat(F.lit("lang/"), "lang"), F.concat(F.lit("source/"), "source"))
    return docs.select(F.col("doc_id").alias("rel"), F.substring_index("text", "\n", 1).alias("title"), tags.alias("tags"), F.lit("notes").alias("kind"), F.col("text").alias("content"), body.alias("sections"))


def _search_index(spark, sf_dir, changed: bool = False) -> postings.Index:
    """The index of the documents in the shared folder, built when it is not there yet; its name holds sizes and times of the files."""
    fs, path = shared.store(spark, f"{sf_dir}/documents.parquet")
    files = fs.listStatus(path)
    key = hashlib.md5(" ".join([sf_dir, str(changed), *sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in files)]).encode()).hexdigest()
    root = f"{shared.folder(spark)}/search-{key}"
    notes = _search_notes(documents(spark, sf_dir))
    steps = [lambda: postings.add(notes, root)]
    if changed:
        again = notes.where("rel % 7 = 0 AND rel % 5 <> 0").withColumn("content", F.concat(F.lit("with that thing\n"), "content"))
        again = again.withColumn("title", F.lit("with that thing")).withColumn("sections", F.concat(F.array(F.struct(F.lit(None).cast("string").alias("heading"), F.lit("with that thing").alias("body"))), "sections"))
        steps += [lambda: postings.remove(notes.where("rel % 5 = 0"), root), lambda: postings.add(again, root)]
    done = len(postings.Index(spark, root).segments) if sinks.current(spark, root) else 0
    for step in steps[done:]:
        step()
    return postings.Index(spark, root)


@query(f"""WITH s AS (SELECT doc_id, unnest({_TOKENS}) AS term, sec FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS sec FROM documents))
  SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, count(DISTINCT (doc_id, sec)) AS sections FROM s GROUP BY term""")  # fmt: skip
def srch1_index(spark, sf_dir):
    rows = _search_index(spark, sf_dir)._table("postings").where("section >= 0 AND tf > 0")
    return rows.groupBy("term").agg(F.count_distinct("rel").alias("df"), F.sum("tf").alias("cf"), F.count("*").alias("sections"))


@query(_search_sql())
def srch1_scores(spark, sf_dir):
    found = postings.search(_search_index(spark, sf_dir), _PHRASE, SEARCH, language="lang/en", top=None)
    return found.select("rel", "section", F.round("score", 4).alias("score"))


@query(_search_sql("(SELECT doc_id, lang, source, CASE WHEN doc_id % 7 = 0 THEN 'with that thing' || chr(10) || text ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0)"))
def srch1_changed_index(spark, sf_dir):
    """The same search after a fifth of the notes was taken out and some of the others indexed anew, without a rebuild."""
    found = postings.search(_search_index(spark, sf_dir, changed=True), _PHRASE, SEARCH, language="lang/en", top=None)
    return found.select("rel", "section", F.round("score", 4).alias("score"))


@query(f"SELECT *, row_number() OVER (ORDER BY score DESC, rel) AS rank FROM ({_search_sql()}) ORDER BY score DESC, rel LIMIT 10")
def srch1_search(spark, sf_dir):
    found = postings.search(_search_index(spark, sf_dir), _PHRASE, SEARCH, language="lang/en", top=10)
    return found.select("rel", "section", F.round("score", 4).alias("score"), "rank")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
  s AS (SELECT *, (CASE WHEN contains(lower(line), 'that the') THEN 10.0 ELSE 0 END + CASE WHEN contains(lower(line), 'with') THEN 2.5 ELSE 0 END + CASE WHEN contains(lower(line), 'and') THEN 2.5 ELSE 0 END - CASE WHEN regexp_matches(line, '^\\s*(-{3,})?\\s*$') THEN 1.0 ELSE 0 END) AS score FROM l)
  SELECT doc_id, max(score)::DOUBLE AS score, md5(arg_min(line, (-score, i))) AS digest FROM s GROUP BY doc_id""")  # fmt: skip
def win2_snippet_line(spark, sf_dir):
    best = search.snippet_line(F.col("text"), "that the", ["with", "and"])
    return documents(spark, sf_dir).select("doc_id", best.alias("b")).select("doc_id", F.col("b.score").alias("score"), F.md5(F.col("b.line")).alias("digest"))


# --- normal forms, ids, rules ------------------------------------------------------------------------------------


@query("""SELECT doc_id, md5(lower(regexp_replace(regexp_replace(regexp_replace(text, '[#*_`>|\\-]', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), '^ | $', '', 'g'))) AS digest FROM documents""")
def norm1_normal_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(T.normal_text(F.col("text"))).alias("digest"))


@query("SELECT page_id, upper(regexp_replace(regexp_replace(url, '[^A-Za-z0-9一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM pages")
def norm2_slug(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.upper_slug(F.col("url")).alias("slug"))


@query("SELECT page_id, 'node_' || substr(regexp_replace(lower(regexp_replace(url, '[^a-zA-Z0-9_]', '_', 'g')), '^_+|_+$', '', 'g'), 1, 28) || '_' || substr(md5(url), 1, 6) AS node_id FROM pages")
def norm3_node_id(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.node_id(F.col("url")).alias("node_id"))


@query("SELECT page_id, md5(regexp_replace(html, 'https?://\\S+', '[link]', 'g')) AS digest FROM pages")
def norm4_redact_urls(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(T.redact_urls(F.col("html"))).alias("digest"))


@query("""WITH c AS (SELECT page_id, unnest(string_split(url, '')) AS c, length(url) AS n FROM pages),
  p AS (SELECT page_id, count(*) / any_value(n) AS p FROM c GROUP BY page_id, c) SELECT page_id, round(-sum(p * log2(p)), 6) AS bits FROM p GROUP BY page_id""")  # fmt: skip
def agg18_entropy(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.round(T.entropy(F.col("url")), 6).alias("bits"))


@query("""SELECT doc_id, round(least(greatest(0.5 + CASE WHEN length(text) >= 80 THEN 0.12 WHEN length(text) >= 40 THEN 0.06 WHEN length(text) < 15 THEN -0.10 ELSE 0 END
  + least(0.04 * (contains(lower(text), 'thing')::INT + contains(lower(text), 'with')::INT + contains(lower(text), 'for')::INT), 0.15), 0), 1), 2)::DOUBLE AS score FROM documents""")  # fmt: skip
def cls7_value_score(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", R.value_score(F.lit(0.5), F.col("text"), ["thing", "with", "for"]).alias("score"))


@query("""SELECT page_id, CASE WHEN contains(url, 'page=') THEN 'drop' WHEN regexp_matches(url, '^https://[^/]*/en/.*$') THEN 'keep' WHEN regexp_matches(url, '^http://m[.].*$') THEN 'structure' ELSE 'exclude' END AS fate FROM pages""")
def cls11_fate(spark, sf_dir):
    rules = [("drop", ["**page=**"]), ("keep", ["https://*/en/**"]), ("structure", ["http://m.**"])]
    return read(spark, sf_dir, "pages").select("page_id", R.fate(F.col("url"), rules).alias("fate"))


@query("SELECT doc_id, replace(replace(text, 'the', 'X'), 'ing', 'Y') = text AS unchanged, ((length(text) - length(replace(text, 'the', ''))) // 3 + (length(replace(text, 'the', 'X')) - length(replace(replace(text, 'the', 'X'), 'ing', ''))) // 3)::BIGINT AS n_replaced FROM documents")
def misc14_deidentify(spark, sf_dir):
    text, n = T.deidentify(F.col("text"), [("the", "X"), ("ing", "Y")])
    return documents(spark, sf_dir).select("doc_id", (text == F.col("text")).alias("unchanged"), n.alias("n_replaced"))


# --- graph -------------------------------------------------------------------------------------------------------

_HREF = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages"
_PATHS = "SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '://[^/]*(/[^?#]*)', 1), '/$', ''), '^.*/', '') AS key FROM pages"


def _page_links(spark, sf_dir):
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
    return read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("rel"), href.alias("target"))


def _page_edges(spark, sf_dir):
    """Pages link to words; two pages are joined through the words they name."""
    links = _page_links(spark, sf_dir)
    keys = links.groupBy("target").agg(F.min(F.col("rel").cast("long")).cast("string").alias("node")).select(F.lit(0).alias("priority"), F.col("target").alias("key"), "node")
    return links, keys


_EDGES = f"""WITH l AS ({_HREF}), k AS (SELECT target, min(page_id) AS node FROM l GROUP BY target),
  e AS (SELECT DISTINCT page_id::VARCHAR AS src, node::VARCHAR AS dst FROM l JOIN k USING (target) WHERE node <> page_id)"""


_TITLE_KEYS = "SELECT '/' || w AS target, min(page_id) AS node FROM (SELECT page_id, unnest(string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ')) AS w FROM pages) GROUP BY 1"


def _title_keys(spark, sf_dir):
    """The words of all pages' titles; a word that several have leads to the first page."""
    word = F.explode(F.split(F.regexp_extract("html", "<title>([^<]*)</title>", 1), " "))
    keys = read(spark, sf_dir, "pages").select("page_id", word.alias("word")).groupBy("word").agg(F.min("page_id").alias("node"))
    return keys.select(F.lit(0).alias("priority"), F.concat(F.lit("/"), "word").alias("key"), F.col("node").cast("string").alias("node"))


@query(f"WITH l AS ({_HREF}), k AS ({_TITLE_KEYS}) SELECT page_id::VARCHAR AS rel, target, node::VARCHAR AS found FROM l LEFT JOIN k USING (target)")
def join1_link_resolution(spark, sf_dir):
    return graph.resolve(_page_links(spark, sf_dir), _title_keys(spark, sf_dir))


@query(f"WITH l AS ({_HREF}), k AS ({_TITLE_KEYS}) SELECT page_id::VARCHAR AS rel, target FROM l ANTI JOIN k USING (target)")
def join2_broken_links(spark, sf_dir):
    return graph.broken(graph.resolve(_page_links(spark, sf_dir), _title_keys(spark, sf_dir)))


@query(_EDGES + """, n AS (SELECT page_id::VARCHAR AS node FROM pages), i AS (SELECT dst AS node, count(*) AS i FROM e GROUP BY dst), o AS (SELECT src AS node, count(*) AS o FROM e GROUP BY src),
  d AS (SELECT node, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM n LEFT JOIN i USING (node) LEFT JOIN o USING (node))
  SELECT *, CASE WHEN in_degree + out_degree = 0 THEN 'island' WHEN in_degree >= 4 OR out_degree >= 6 THEN 'hub' WHEN in_degree + out_degree <= 1 THEN 'weak' ELSE 'plain' END AS role FROM d""")  # fmt: skip
def graph1_degrees(spark, sf_dir):
    links, keys = _page_edges(spark, sf_dir)
    nodes = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("node"))
    return graph.degrees(nodes, graph.edges(graph.resolve(links, keys)))


@query(f"""WITH l AS ({_HREF}), a AS (SELECT DISTINCT target FROM l WHERE page_id % 2 = 0), b AS (SELECT DISTINCT target FROM l WHERE page_id % 2 = 1)
  SELECT 'added' AS change, target FROM (FROM b EXCEPT FROM a) UNION ALL SELECT 'removed', target FROM (FROM a EXCEPT FROM b)""")  # fmt: skip
def set1_snapshot_diff(spark, sf_dir):
    links = _page_links(spark, sf_dir)
    half = lambda k: links.where(F.col("rel").cast("long") % 2 == k).select("target").distinct()
    return graph.snapshot_diff(half(0), half(1))


@query(f"WITH l AS ({_HREF}) SELECT DISTINCT 'added' AS change, target FROM l")
def set2_first_snapshot(spark, sf_dir):
    """A first run has nothing before it, so all is added."""
    links = _page_links(spark, sf_dir).select("target").distinct()
    return graph.snapshot_diff(links.where("false"), links)


@query("""WITH n AS (SELECT n_name AS node, n_regionkey AS category, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS i FROM nation),
  s AS (SELECT category, ceil(count(*) / 4) AS rows FROM n GROUP BY category), t AS (SELECT category, coalesce(sum(rows * 120 + 40) OVER (ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM s)
  SELECT category, node, (i % 4)::BIGINT AS col, (i // 4)::BIGINT AS row, (i % 4 * 320)::BIGINT AS x, (top + i // 4 * 120)::BIGINT AS y FROM n JOIN t USING (category)""")  # fmt: skip
def win9_grid_layout(spark, sf_dir):
    return graph.grid(read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("category"), F.col("n_name").alias("node")))


# --- similarity and conflicts ------------------------------------------------------------------------------------


def _benchmark_notes(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rel"), F.col("text").alias("content"))


_NORM_BENCH = "SELECT item_id, length(lower(regexp_replace(regexp_replace(regexp_replace(text, '[#*_`>|\\-]', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), '^ | $', '', 'g'))) AS n FROM benchmark"


@query(f"WITH t AS ({_NORM_BENCH}) SELECT x.item_id AS a, y.item_id AS b FROM t x JOIN t y ON x.item_id < y.item_id AND x.n > 80 AND y.n > 80 AND 2 * least(x.n, y.n) >= 0.9 * (x.n + y.n)")
def join4_length_bound_pairs(spark, sf_dir):
    return similarity.candidates(_benchmark_notes(spark, sf_dir), least=0.9, by_characters=False)


@query()
def dedup1_sequence_ratio(spark, sf_dir):
    return similarity.duplicates(_benchmark_notes(spark, sf_dir), least=0.40)  # the items are distinct: a low threshold, so that there are rows


_SAID = "replace(replace(text, ' with ', ' must '), ' that ', ' never ')"
_OPENING = "'w/' || lower(regexp_extract(text, '^[^A-Za-z]*([A-Za-z]+[^A-Za-z]+[A-Za-z]+)', 1))"


@query(rf"""WITH d AS (SELECT doc_id AS rel, {_OPENING} AS tag, {_SAID} AS content FROM documents WHERE text IS NOT NULL),
  l AS (SELECT rel, tag, list_transform(list_filter(string_split(regexp_replace(content, '`[^`
]*`', ' ', 'g'), chr(10)), lambda x: NOT starts_with(ltrim(x), '|')), lambda x: regexp_replace(x, '^[>\s#*`-]+', '')) AS ls FROM d),
  p AS (SELECT rel, tag, list_filter(list_transform(flatten(list_transform(ls, lambda x: string_split_regex(x, '[!?;:]'))), lambda x: trim(x)), lambda x: x <> '') AS ps FROM l),
  c AS (SELECT rel, tag, unnest(ps) AS c, generate_subscripts(ps, 1) - 1 AS idx FROM p),
  q AS (SELECT *, CASE WHEN regexp_matches(c, '(^|[^A-Za-z])never($|[^A-Za-z])') THEN 'negative' WHEN regexp_matches(c, '(^|[^A-Za-z])(always|must|should)($|[^A-Za-z])') THEN 'positive' END AS pol FROM c),
  t AS (SELECT rel, tag, idx, pol, unnest(list_distinct(list_transform(regexp_extract_all(c, '[A-Za-z][A-Za-z0-9_\-]+'), lambda w: lower(w)))) AS w FROM q WHERE pol IS NOT NULL),
  f AS (SELECT * FROM t WHERE w NOT IN ('must', 'never', 'always', 'should', {", ".join(f"'{w}'" for w in R.ENGLISH_STOPS)})),
  j AS (SELECT a.rel AS rel_a, b.rel AS rel_b, a.tag, a.idx AS idx_a, b.idx AS idx_b, count(*) AS score, arg_min(a.w, (-length(a.w), a.w)) AS keyword
    FROM f a JOIN f b ON a.tag = b.tag AND a.w = b.w AND a.rel < b.rel AND a.pol <> b.pol GROUP BY ALL)
  SELECT rel_a, rel_b, keyword, tag, idx_a::INT AS idx_a, idx_b::INT AS idx_b, score FROM (SELECT *, row_number() OVER (PARTITION BY rel_a, rel_b, keyword ORDER BY idx_a, idx_b) AS r FROM j) WHERE r = 1""")  # fmt: skip
def conf1_conflicts(spark, sf_dir):
    """Whole documents with two words exchanged for markers of polarity; notes meet under the two words that they open with."""
    notes = documents(spark, sf_dir).where("text IS NOT NULL").selectExpr("doc_id AS rel", f"array({_OPENING}) AS tags", f"{_SAID} AS content")
    return conflicts.candidates(conflicts.clauses(shared.spread(notes)))


# --- trust and quality -------------------------------------------------------------------------------------------


def _records(spark, sf_dir):
    quality = F.when(F.col("quality") == 1, "official").when(F.col("quality") == 0, "community")
    labels = read(spark, sf_dir, "labels").select("doc_id", quality.alias("authority"), F.when(F.col("toxic") == 0, "reviewed").otherwise("unreviewed").alias("review_status"))
    docs = documents(spark, sf_dir).select("doc_id", F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("rel"), "source")
    return docs.join(labels, "doc_id", "left").withColumn("claim_risk", F.lit("low"))


_RECORDS = """SELECT d.doc_id, lang || '/' || d.doc_id AS rel, source, CASE quality WHEN 1 THEN 'official' WHEN 0 THEN 'community' END AS authority, CASE WHEN toxic = 0 THEN 'reviewed' WHEN toxic IS NOT NULL THEN 'unreviewed' END AS review_status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


@query(f"SELECT count(*) AS total, count(authority) AS with_authority, count(*) FILTER (authority = 'official') AS official, 0::BIGINT AS primary, 0::BIGINT AS secondary, count(*) FILTER (authority = 'community') AS community, 0::BIGINT AS synthetic, count(*) FILTER (authority IS NULL) AS unknown FROM ({_RECORDS})")
def agg5_authority_counts(spark, sf_dir):
    return ledger.statistics(_records(spark, sf_dir))


@query(f"""SELECT source, count(*) AS note_count, arg_min(coalesce(authority, 'unknown'), CASE coalesce(authority, 'unknown') WHEN 'official' THEN 0 WHEN 'community' THEN 3 ELSE 5 END) AS max_authority, count(*) FILTER (review_status = 'reviewed') AS reviewed_count,
  array_to_string(list_sort(list(DISTINCT split_part(rel, '/', 1))), ',') AS dirs FROM ({_RECORDS}) GROUP BY source""")  # fmt: skip
def agg6_source_rollup(spark, sf_dir):
    return ledger.sources(_records(spark, sf_dir)).withColumn("dirs", F.array_join("dirs", ","))


_TRUSTED = """concat(CASE p_size % 14 WHEN 0 THEN '06-Sources/Books/' WHEN 1 THEN '06-Sources/Papers/' WHEN 2 THEN '06-Sources/Articles/' WHEN 3 THEN '03-Languages/go/' WHEN 4 THEN '01-Rules/' WHEN 5 THEN '00-MOC/' WHEN 6 THEN '08-Projects/' WHEN 7 THEN '09-Career/'
  WHEN 8 THEN '04-Systems/' WHEN 9 THEN '05-Tools/' WHEN 10 THEN '10-Daily/' WHEN 11 THEN '99-Inbox/' WHEN 12 THEN '03-Languages/c/' ELSE 'other/' END, CASE p_partkey % 5 WHEN 0 THEN 'README.md' WHEN 1 THEN concat(p_name, '-STANDARDS.md') WHEN 2 THEN concat(p_name, '-CHEATSHEET.md') ELSE concat(p_name, '.md') END)"""
_TRUST_FIELDS = "CASE WHEN p_partkey % 11 = 0 THEN 'moc' ELSE 'notes' END AS type, CASE WHEN p_partkey % 7 = 0 THEN concat(p_name, ' 索引') ELSE p_name END AS title, CASE WHEN p_partkey % 13 = 0 THEN 'article' END AS source_type, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE '' END AS source_author"


@query(f"""WITH n AS (SELECT p_partkey AS id, {_TRUSTED} AS rel, {_TRUST_FIELDS} FROM part), t AS (SELECT *, split_part(rel, '/', 1) AS top, regexp_replace(rel, '^.*/', '') AS name FROM n)
  SELECT id, CASE WHEN source_type = 'article' AND source_author <> '' THEN 'community low' WHEN rel LIKE '06-Sources/Books/%' OR rel LIKE '06-Sources/Papers/%' THEN 'primary medium'
    WHEN rel LIKE '06-Sources/Articles/%' THEN CASE WHEN contains(title, '索引') THEN 'secondary low' ELSE 'secondary medium' END WHEN top = '03-Languages' AND name LIKE '%-CHEATSHEET.md' THEN 'synthetic low' WHEN top = '03-Languages' AND name LIKE '%-STANDARDS.md' THEN 'synthetic high'
    WHEN top = '01-Rules' THEN 'synthetic high' WHEN top = '00-MOC' OR name = 'README.md' OR type = 'moc' THEN 'synthetic none' WHEN top IN ('08-Projects', '09-Career', '04-Systems', '05-Tools') THEN 'synthetic medium' ELSE 'unknown none' END AS trust FROM t""")  # fmt: skip
def cls1_trust(spark, sf_dir):
    notes = read(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_TRUSTED} AS rel", *[f"CASE{x}" for x in f", {_TRUST_FIELDS}".split(", CASE")[1:]], "CAST(NULL AS ARRAY<STRING>) AS tags")
    pair = R.trust(*[F.col(c) for c in ("rel", "type", "title", "tags", "source_type", "source_author")])
    return notes.select("id", F.concat_ws(" ", pair["authority"], pair["claim_risk"]).alias("trust"))


def _quality_notes(spark, sf_dir):
    pairs = [("title", F.substring_index("text", "\n", 1)), ("created", F.lit("2024-01-01")), ("updated", F.when(F.col("n_chars") % 5 == 0, "soon").otherwise("2024-01-02")), ("type", F.col("source")), ("tags", F.col("lang")), ("status", F.when(F.col("lang") == "en", "stable").otherwise("odd")), ("audience", F.lit("both"))]
    fields = F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
    tags = F.array(F.concat(F.lit("lang/"), "lang"), F.col("source"), F.concat(F.lit("team/"), "lang"))
    return documents(spark, sf_dir).select(F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel"), fields.alias("fields"), tags.alias("tags"), F.array(F.lit("both"), F.col("lang")).alias("audience"))


_ISSUES = """SELECT 'notes/' || doc_id || '.md' AS rel, unnest([
    {l: CASE WHEN trim(split_part(text, chr(10), 1)) = '' THEN 'ERROR' END, c: 'FRONTMATTER', m: 'missing title'}, {l: CASE WHEN lang <> 'en' THEN 'ERROR' END, c: 'FRONTMATTER', m: 'status odd'},
    {l: 'WARN', c: 'FRONTMATTER', m: 'type ' || source}, {l: 'WARN', c: 'FRONTMATTER', m: 'audience ' || lang}, {l: 'WARN', c: 'TAG', m: 'tag form ' || source}, {l: 'WARN', c: 'TAG', m: 'tag space team/' || lang},
    {l: CASE WHEN n_chars % 5 = 0 THEN 'WARN' END, c: 'FRONTMATTER', m: 'updated soon'}]) AS x FROM documents"""


@query(f"SELECT rel, x.l AS level, x.c AS category, x.m AS message FROM ({_ISSUES}) WHERE x.l IS NOT NULL")
def qual2_note_issues(spark, sf_dir):
    return checks.note_issues(_quality_notes(spark, sf_dir))


@query(f"""WITH i AS (SELECT x.l AS level FROM ({_ISSUES}) WHERE x.l IS NOT NULL), c AS (SELECT count(*) FILTER (level = 'ERROR') AS errors, count(*) FILTER (level = 'WARN') AS warnings FROM i), f AS (SELECT count(*) AS files FROM documents)
  SELECT files, errors, warnings, round(greatest(0.0, 100 - (5 * errors + warnings) / files * 10), 1) AS score FROM c, f""")  # fmt: skip
def agg11_quality_score(spark, sf_dir):
    notes = _quality_notes(spark, sf_dir)
    return checks.summary(notes, checks.note_issues(notes))


@query("""WITH a AS (SELECT c_custkey AS key, 'c' || c_custkey AS left_rel FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS key, 's' || c_custkey AS right_rel FROM customer WHERE c_custkey % 2 <> 0)
  SELECT key, left_rel, right_rel FROM a FULL JOIN b USING (key)""")  # fmt: skip
def join5_paired(spark, sf_dir):
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(k.alias("key"), F.explode(F.array(F.when(k % 3 != 0, F.lit("left")), F.when(k % 2 != 0, F.lit("right")))).alias("kind")).where("kind IS NOT NULL")
    rows = rows.withColumn("rel", F.concat(F.when(F.col("kind") == "left", "c").otherwise("s"), F.col("key").cast("string")))
    return checks.paired(rows, "left", "right")


@query("""WITH p AS (SELECT doc_id AS key, string_split(text, chr(10)) AS t FROM documents), q AS (SELECT doc_id - 1 AS key, string_split(text, chr(10)) AS t FROM documents),
  a AS (SELECT key, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS x FROM p), b AS (SELECT key, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS y FROM q)
  SELECT key, pos::INT AS pos, md5(x) AS left_digest, md5(y) AS right_digest FROM a FULL JOIN b USING (key, pos) WHERE x IS DISTINCT FROM y""")  # fmt: skip
def join6_misaligned(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("key"), F.split("text", "\n", -1).alias("titles"))
    found = checks.misaligned(docs, docs.select((F.col("key") - 1).alias("key"), "titles"))
    return found.select("key", "pos", F.md5("left_title").alias("left_digest"), F.md5("right_title").alias("right_digest"))


@query("""WITH a AS (SELECT DISTINCT user_id, event_type, hour(ts)::INT AS hour FROM events WHERE day(ts) <= 15), b AS (SELECT DISTINCT user_id, event_type, hour(ts)::INT FROM events WHERE day(ts) > 15)
  SELECT 'first' AS side, * FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'second', * FROM (FROM b EXCEPT FROM a)""")  # fmt: skip
def join12_drift(spark, sf_dir):
    early = F.dayofmonth("ts") <= 15
    rows = events(spark, sf_dir).select("user_id", "event_type", F.hour("ts").alias("hour"), early.alias("early"))
    return checks.drift(rows.where("early").drop("early"), rows.where("NOT early").drop("early"))


@query("SELECT lang, source, n_chars, count(*) AS count FROM documents GROUP BY ALL HAVING count(*) > 1")
def agg16_repeated(spark, sf_dir):
    return checks.repeated(documents(spark, sf_dir), "lang", "source", "n_chars")


@query("""WITH p AS (SELECT page_id, url, unnest(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) AS p FROM (SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'token=abc&v=' || md5(url) || 'Zz#x=1' AS url FROM pages) WHERE contains(url, '?')),
  v AS (SELECT page_id, url, split_part(p, '=', 1) AS name, regexp_replace(p, '^[^=]*=', '') AS value FROM p WHERE contains(p, '='))
  SELECT page_id AS id, CASE WHEN name = 'token' THEN name ELSE '<high-entropy-value>' END AS param FROM v WHERE name = 'token' OR name = 'v'""")  # fmt: skip
def url1_suspicious_urls(spark, sf_dir):
    """Every URL gets one credential-like and one random parameter before an anchor, so that both rules have rows."""
    whole = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.regexp_replace("url", "#.*$", "").contains("?"), "&").otherwise("?"), F.lit("token=abc&v="), F.md5("url"), F.lit("Zz#x=1"))
    return checks.suspicious_urls(read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), whole.alias("url"))).select("id", "param")


# --- activity ----------------------------------------------------------------------------------------------------


@query("SELECT ts::DATE AS day, isoyear(ts) || '-W' || lpad(week(ts)::VARCHAR, 2, '0') AS week, count(*) AS n FROM events GROUP BY ALL")
def agg7_events_by_day(spark, sf_dir):
    return activity.by_day(events(spark, sf_dir))


@query("""WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1)
  SELECT sum(n)::BIGINT AS total, count(*) AS active_days, (max(day) - min(day) + 1)::INT AS span, (sum(n) FILTER ((SELECT max(day) FROM d) - day < 7))::BIGINT AS last_7, arg_min(day, (-n, day)) AS best_day FROM d""")  # fmt: skip
def agg13_activity_overview(spark, sf_dir):
    return activity.overview(activity.by_day(events(spark, sf_dir)))


@query("""WITH d AS (SELECT DISTINCT user_id AS key, ts::DATE AS day FROM events), r AS (SELECT key, day, day - (row_number() OVER (PARTITION BY key ORDER BY day))::INT AS island FROM d),
  g AS (SELECT key, count(*) AS n, max(day) AS e FROM r GROUP BY key, island) SELECT key, max(n) AS longest, arg_max(n, e) AS current FROM g GROUP BY key""")  # fmt: skip
def win6_streaks(spark, sf_dir):
    return activity.streaks(events(spark, sf_dir).select(F.col("user_id").alias("key"), F.to_date("ts").alias("day")))


@query("""WITH e AS (SELECT user_id AS key, ts, event_type AS type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WHERE event_type IN ('signup', 'purchase'))
  SELECT key, count(*) FILTER (type = 'signup') AS starts, count(*) FILTER (type = 'purchase') AS ends, strftime(max(CASE WHEN type = 'signup' AND nxt IS NULL THEN ts END), '%Y-%m-%d %H:%M:%S') AS open_since FROM e GROUP BY key""")  # fmt: skip
def win7_event_pairs(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("type"))
    return activity.pair_events(rows, "signup", "purchase").withColumn("open_since", F.date_format("open_since", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH l AS (SELECT conv_id AS rel, turn AS line_no, role || ' ' || text AS line FROM conversations), b AS (SELECT *, sum((line LIKE 'user %')::INT) OVER (PARTITION BY rel ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block FROM l)
  SELECT rel, block::BIGINT AS block, sum(strlen(line) + 1)::BIGINT AS bytes, sum(strlen(line) + 1) > 1024 AS oversized FROM b WHERE block > 0 GROUP BY ALL""")  # fmt: skip
def win8_block_sizes(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rel"), F.col("turn").alias("line_no"), F.concat_ws(" ", "role", "text").alias("line"))
    return activity.block_sizes(rows, "^user ", 1024)


@query("""SELECT c_custkey AS rel, greatest(c_custkey % 45 - 3, 0)::INT AS age_days, CASE WHEN c_custkey % 45 - 3 >= 30 THEN '>=30d' WHEN c_custkey % 45 - 3 >= 14 THEN '>=14d' WHEN c_custkey % 45 - 3 >= 7 THEN '>=7d' ELSE '<7d' END AS tier, 'created' AS source FROM customer""")
def cls9_draft_ages(spark, sf_dir):
    today = F.to_date(F.lit("2024-06-30"))
    created = F.date_sub(today, (F.col("c_custkey") % 45 - 3).cast("int"))
    return activity.ages(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rel"), created.alias("created"), today.alias("mtime")), today)


@query("""WITH t AS (SELECT unnest(CASE WHEN p_size % 3 = 0 THEN [p_brand, p_type] WHEN p_size % 3 = 1 THEN [p_brand] ELSE [NULL] END) AS v FROM part) SELECT coalesce(v, 'none') AS value, count(*) AS n FROM t GROUP BY 1""")
def agg9_breakdown(spark, sf_dir):
    tags = F.when(F.col("p_size") % 3 == 0, F.array("p_brand", "p_type")).when(F.col("p_size") % 3 == 1, F.array("p_brand")).otherwise(F.expr(T.EMPTY))
    return activity.breakdown(read(spark, sf_dir, "part").select(tags.alias("tags")), "tags", "none")


@query("""WITH t AS (SELECT p_partkey AS rel, p_type AS type, p_size, p_brand FROM part), r AS (SELECT DISTINCT p_brand AS tag FROM part WHERE p_size < 25)
  SELECT rel, CASE WHEN r1.tag IS NOT NULL THEN 'brand/' || r1.tag WHEN t.p_size % 2 = 0 THEN 'size/even' WHEN type < 'M' THEN 'type/' || type ELSE 'inbox' END AS target FROM t LEFT JOIN r r1 ON r1.tag = t.p_brand""")  # fmt: skip
def join7_routing(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    drafts = part.select(F.col("p_partkey").alias("rel"), F.col("p_type").alias("type"), F.array("p_brand", F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd")).alias("tags"))
    even = part.sparkSession.createDataFrame([("even", "size/even")], "tag string, target string")
    brands = part.where("p_size < 25").select(F.col("p_brand").alias("tag"), F.concat(F.lit("brand/"), "p_brand").alias("target")).distinct()
    types = part.where("p_type < 'M'").select(F.col("p_type").alias("type"), F.concat(F.lit("type/"), "p_type").alias("target")).distinct()
    return activity.route(drafts, brands.unionByName(even), types, "inbox")


@query("""WITH t AS (SELECT o_custkey AS plan, o_orderkey AS idx, 'order ' || o_orderkey AS title, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'in_progress' END AS status FROM orders)
  SELECT plan, arg_min(title, idx) FILTER (status <> 'completed') AS next_task, round(100.0 * count(*) FILTER (status = 'completed') / count(*), 1) AS percent FROM t GROUP BY plan""")  # fmt: skip
def cls15_next_task(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("in_progress")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("idx"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), status.alias("status"))
    return activity.unclaimed_first(rows)


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 20")
def scan9_guarded_sql(spark, sf_dir):
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem_view")
    return readers.guarded_sql(spark, "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem_view WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY 1, 2 ORDER BY 1, 2", 20)
