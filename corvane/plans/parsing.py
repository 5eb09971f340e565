"""Queries of the parsers, tokenizers, predicates and remaining checks over Markdown made from the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as S

from corvane.functions import rules as R
from corvane.functions import text as T
from corvane.operators import checks, code, inbox, ledger, render, search
from corvane.operators import notes as N
from corvane.plans.queries import _PHRASE, SEARCH, _records, _search_notes, _search_sql, documents, query, read
from corvane.plans.vault import rows
from corvane.sources import readers

_MD = "concat(CASE n_chars % 4 WHEN 0 THEN concat('---', chr(10), 'Title: ', lang, ' note', chr(10), '---', chr(10)) WHEN 1 THEN concat('---', chr(10), 'x: y', chr(10), '---', chr(10)) ELSE '' END, CASE WHEN n_chars % 5 < 3 THEN concat('# Top of ', lang, chr(10)) ELSE '' END, 'intro #Topic/', source, ' #plain x#no/tag', chr(10), '## 1.2 First', chr(10), text, chr(10), '### Sub', chr(10), 'sub', chr(10), '```', chr(10), '## In fence', chr(10), '```', chr(10), '##  三 Last  ', chr(10), '#### § 4 Deep', chr(10), 'end')"
_NOTES = f"n AS (SELECT doc_id AS rel, {_MD} AS content FROM documents), l AS (SELECT rel, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line_no FROM n)"


def markdown(spark, sf_dir):
    return rows(spark, sf_dir, "documents", "doc_id AS rel", f"{_MD} AS content")


@query(rf"""WITH {_NOTES}, h AS (SELECT *, regexp_matches(line, '^#{{1,3}}\s+.+$') AS head FROM l), s AS (SELECT *, sum(head::INT) OVER (PARTITION BY rel ORDER BY line_no) AS section FROM h)
  SELECT rel, section::BIGINT AS section, max(length(regexp_extract(line, '^#+'))) FILTER (head)::INT AS level, max(trim(regexp_replace(line, '^#+', ''))) FILTER (head) AS heading, min(line_no) AS start_line, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM s GROUP BY rel, section""")  # fmt: skip
def parse2_sections(spark, sf_dir):
    return N.sections(markdown(spark, sf_dir)).select("rel", "section", "level", "heading", "start_line", F.md5("body").alias("digest"))


@query(rf"""WITH {_NOTES}, f AS (SELECT *, sum(starts_with(line, '```')::INT) OVER (PARTITION BY rel ORDER BY line_no) % 2 AS inside FROM l), t AS (SELECT rel, line_no, length(regexp_extract(line, '^#+'))::INT AS level, trim(regexp_replace(line, '^#+', '')) AS title FROM f WHERE inside = 0 AND regexp_matches(line, '^#{{1,6}}\s+\S'))
  SELECT *, nullif(regexp_extract(title, '^(§ ?|第 ?)?([0-9]+([.][0-9]+)*|[一二三四五六七八九十]+)', 2), '') AS number FROM t""")  # fmt: skip
def parse5_headings(spark, sf_dir):
    return N.headings(markdown(spark, sf_dir))


@query(f"""WITH {_NOTES}, a AS (SELECT rel, min(line) FILTER (starts_with(line, 'Title: ') AND line_no = 2) AS t, arg_min(line, line_no) FILTER (starts_with(line, '# ')) AS h FROM l GROUP BY rel)
  SELECT 'd/' || rel || '.x.md' AS rel, coalesce(substr(t, 8), substr(h, 3), rel || '.x') AS title FROM a""")  # fmt: skip
def parse3_titles(spark, sf_dir):
    return N.titles(markdown(spark, sf_dir).withColumn("rel", F.concat(F.lit("d/"), "rel", F.lit(".x.md"))))


@query(r"SELECT doc_id AS rel, array_to_string(list_distinct(list_transform(list_filter(string_split_regex(c, '[ \t\n\r\f\v]+'), lambda w: regexp_matches(w, '^#[A-Za-z0-9_\-/]*/')), lambda w: lower(regexp_extract(w, '^#([A-Za-z0-9_\-/]+)', 1)))), ',') AS tags FROM (SELECT doc_id, " + _MD + " AS c FROM documents)")
def parse4_inline_tags(spark, sf_dir):
    return N.inline_tags(markdown(spark, sf_dir)).select("rel", F.array_join("tags", ",").alias("tags"))


@query(rf"""WITH {_NOTES}, h AS (SELECT rel, line_no, CASE WHEN regexp_matches(line, '^#{{1,3}}\s+.+$') THEN length(regexp_extract(line, '^#+')) END AS level, line FROM l),
  s AS (SELECT rel, line_no AS start_line, level FROM h WHERE contains(lower(line), 'first') AND level IS NOT NULL), e AS (SELECT s.rel, start_line, min(h.line_no) AS stop FROM s LEFT JOIN h ON s.rel = h.rel AND h.line_no > start_line AND h.level <= s.level GROUP BY ALL)
  SELECT e.rel, start_line, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM e JOIN h ON e.rel = h.rel AND line_no >= start_line AND (stop IS NULL OR line_no < stop) GROUP BY ALL""")  # fmt: skip
def srch3_rule_snippet(spark, sf_dir):
    return N.snippet(N.sections(markdown(spark, sf_dir)), "First").select("rel", "start_line", F.md5("text").alias("digest"))


_RAW = "concat(' ', p_name, CASE p_size % 6 WHEN 0 THEN '/' WHEN 1 THEN '#part|shown' WHEN 2 THEN concat(chr(92), '|shown') WHEN 3 THEN '//' WHEN 4 THEN '|a#b|c' ELSE '' END)"


@query(f"SELECT p_partkey AS id, regexp_replace(trim(split_part(split_part(split_part({_RAW}, chr(92) || '|', 1), '|', 1), '#', 1)), '/+$', '') AS target FROM part")
def parse9_link_targets(spark, sf_dir):
    return rows(spark, sf_dir, "part", "p_partkey AS id", f"{_RAW} AS raw").select("id", T.link_target(F.col("raw")).alias("target"))


_HOLES = "CASE p_size % 9 WHEN 0 THEN '...' WHEN 1 THEN concat('a{{', p_name) WHEN 2 THEN concat('<', p_name, '>') WHEN 3 THEN concat('〔', p_name, '〕') WHEN 4 THEN 'log-YYYY-MM' WHEN 5 THEN 'xYYYY-MM' WHEN 6 THEN '' WHEN 7 THEN concat('<', p_name) ELSE p_name END"


@query(f"WITH t AS (SELECT p_partkey AS id, {_HOLES} AS t FROM part) SELECT id, t IN ('...', '') OR contains(t, '{{{{') OR (strpos(t, '>') > strpos(t, '<') AND contains(t, '<')) OR (contains(t, '〔') AND contains(t, '〕')) OR t = 'log-YYYY-MM' AS hole FROM t")
def parse10_placeholders(spark, sf_dir):
    return rows(spark, sf_dir, "part", "p_partkey AS id", f"{_HOLES} AS t").select("id", T.is_placeholder(F.col("t")).alias("hole"))


@query(r"SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_\-]+'), lambda w: lower(w)), lambda w: w NOT IN ('the', 'and', 'of')))), ' ')) AS digest FROM documents")
def tok3_conflict_tokens(spark, sf_dir):
    tokens = T.conflict_tokens(F.col("text"), ["the", "and", "of"], ["的是"])
    return documents(spark, sf_dir).select("doc_id", F.md5(F.array_join(F.array_sort(tokens), " ")).alias("digest"))


# benchmark texts and page addresses as what is asked for; every third one has some CJK behind it
_ASKED = "concat(text, CASE length(text) % 3 WHEN 0 THEN ' 内存泄漏 锁' WHEN 1 THEN ' 并发设计模式' ELSE '' END)"
_TERMS = rf"""asked AS (SELECT item_id, lower({_ASKED}) AS q FROM benchmark),
  word AS (SELECT item_id, unnest(regexp_extract_all(q, '[a-z0-9_.\-]+')) AS w, generate_subscripts(regexp_extract_all(q, '[a-z0-9_.\-]+'), 1) AS i FROM asked),
  run AS (SELECT item_id, unnest(regexp_extract_all(q, '[一-鿿]+')) AS w, generate_subscripts(regexp_extract_all(q, '[一-鿿]+'), 1) AS i FROM asked),
  part AS (SELECT item_id, i, unnest(list_filter(string_split_regex(w, '[._\-]+'), lambda p: length(p) > 1)) AS w, generate_subscripts(list_filter(string_split_regex(w, '[._\-]+'), lambda p: length(p) > 1), 1) AS j FROM word),
  pair AS (SELECT item_id, i, unnest(range(1, length(w))) AS j, w FROM run WHERE length(w) > 2),
  one AS (SELECT item_id, i, unnest(range(1, length(w) + 1)) AS j, w FROM run),
  offer AS (
    SELECT item_id, w AS term, 1.5 AS weight, true AS core, 0 AS k, i, 0 AS j, 0 AS l FROM word UNION ALL SELECT item_id, w, 1.0, false, 0, i, 1, j FROM part
    UNION ALL SELECT item_id, w, 1.8, true, 1, i, 0, 0 FROM run UNION ALL SELECT item_id, w[j:j + 1], CASE WHEN length(w) = 4 THEN 1.3 ELSE 1.2 END, true, 1, i, 1, j FROM pair WHERE length(w) <> 4 OR j % 2 = 1
    UNION ALL SELECT item_id, w[j:j], 0.3, false, 1, i, 2, j FROM one),
  terms AS (SELECT item_id, term, weight::DOUBLE AS weight, core FROM (SELECT *, row_number() OVER (PARTITION BY item_id, term ORDER BY k, i, j, l) AS r FROM offer) WHERE r = 1)"""


@query(f"WITH {_TERMS} FROM terms")
def tok2_query_terms(spark, sf_dir):
    asked = rows(spark, sf_dir, "benchmark", "item_id", f"{_ASKED} AS q")
    return asked.select("item_id", F.explode(search.terms_of(F.col("q"))).alias("t")).select("item_id", "t.*")


_LANGUAGE = "concat(substr(text, 1, 30), CASE n_chars % 9 WHEN 0 THEN ' in C++ and go' WHEN 1 THEN ' RUST' WHEN 2 THEN ' food' WHEN 3 THEN ' a c++ thing' WHEN 4 THEN ' x-py' WHEN 5 THEN ' shell.' WHEN 6 THEN ' .sh/bash' WHEN 7 THEN ' typescripts' ELSE '' END)"


@query(f"""WITH q AS (SELECT doc_id, lower({_LANGUAGE}) AS q FROM documents), l(i, word, tag) AS (VALUES {", ".join(f"({i}, '{w}', '{t}')" for i, (w, t) in enumerate(search.LANGUAGES.items()))}),
  hit AS (SELECT doc_id, min(i) AS i FROM q, l WHERE list_contains(string_split_regex(trim(q, ' ' || chr(10) || chr(9)), '\\s+'), word) OR regexp_matches(q, '(^|[^\\p{{L}}\\p{{N}}_])' || replace(word, '+', '\\+') || CASE WHEN word LIKE '%+' THEN '[\\p{{L}}\\p{{N}}_]' ELSE '([^\\p{{L}}\\p{{N}}_]|$)' END) GROUP BY doc_id)
  SELECT q.doc_id, tag AS language FROM q LEFT JOIN hit USING (doc_id) LEFT JOIN l USING (i)""")  # fmt: skip
def tok4_query_languages(spark, sf_dir):
    return rows(spark, sf_dir, "documents", "doc_id", f"{_LANGUAGE} AS q").select("doc_id", search.language_of(F.col("q")).alias("language"))


_CLUSTERS = [(["the", "lock"], ["mutex", "the", "race"]), (["锁"], ["mutex", "并发"]), (["tion"], ["race", "state"])]


@query(f"""WITH {_TERMS}, c(k, x, w, j) AS (VALUES {", ".join(f"({k}, '{x}', '{w}', {j})" for k, (xs, ws) in enumerate(_CLUSTERS) for x in xs for j, w in enumerate(ws))}),
  hit AS (SELECT DISTINCT item_id, k, w, j FROM asked, c WHERE contains(q, x) OR EXISTS (SELECT 1 FROM terms t WHERE t.item_id = asked.item_id AND contains(t.term, x))),
  extra AS (SELECT item_id, w AS term FROM hit GROUP BY item_id, w)
  SELECT item_id, term, weight, core FROM terms UNION ALL SELECT item_id, term, 0.9, false FROM extra ANTI JOIN terms USING (item_id, term)""")  # fmt: skip
def tok5_expanded_terms(spark, sf_dir):
    asked = rows(spark, sf_dir, "benchmark", "item_id", f"lower({_ASKED}) AS q").select("item_id", "q", search.terms_of(F.col("q")).alias("terms"))
    return asked.select("item_id", F.explode(search.expanded(F.col("q"), F.col("terms"), _CLUSTERS)).alias("t")).select("item_id", "t.*")


@query(f"SELECT rel, score FROM ({_search_sql()}) JOIN documents ON rel = doc_id WHERE contains('source/' || source, 'e/src1')")
def cls12_search_by_tag(spark, sf_dir):
    return search.search(_search_notes(documents(spark, sf_dir)), _PHRASE, SEARCH, language="lang/en", tag="E/SRC1", top=None).select("rel", F.round("score", 4).alias("score"))


_CLAUSE = "concat(CASE turn % 9 WHEN 0 THEN 'you must ' WHEN 1 THEN 'You must  not ' WHEN 2 THEN 'MUST ' WHEN 3 THEN 'it is never always ' WHEN 4 THEN '禁止 ' WHEN 5 THEN '应当 ' WHEN 6 THEN 'mustard should' WHEN 7 THEN '是否 ' ELSE 'we should, ' END, substr(text, 1, 12))"


@query(rf"""WITH c AS (SELECT conv_id, turn, {_CLAUSE} AS c FROM conversations)
  SELECT conv_id, turn, CASE WHEN regexp_matches(c, '禁止|(^|[^A-Za-z])must\s+not($|[^A-Za-z])|(^|[^A-Za-z])never($|[^A-Za-z])') THEN 'negative' WHEN regexp_matches(c, '应当|(^|[^A-Za-z])(always|must|should)($|[^A-Za-z])') THEN 'positive' END AS polarity FROM c""")  # fmt: skip
def cls3_polarity(spark, sf_dir):
    return rows(spark, sf_dir, "conversations", "conv_id", "turn", f"{_CLAUSE} AS c").select("conv_id", "turn", R.polarity(F.col("c")).alias("polarity"))


@query("""WITH d AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, CASE WHEN n % 9 = 0 THEN 0 WHEN n % 9 = 1 THEN 1 WHEN n % 9 <= 3 THEN 2 WHEN n % 9 <= 6 THEN 3 ELSE 4 END AS heat, CASE WHEN n >= 100 THEN 100 WHEN n >= 30 THEN 30 WHEN n >= 7 THEN 7 WHEN n >= 1 THEN 1 ELSE 0 END AS badge FROM d""")
def cls14_heat_and_badges(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", R.heat(F.col("n") % 9).alias("heat"), R.streak_badge(F.col("n")).alias("badge"))


# --- checks ------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS rel, 'WARN' AS level, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') || ' days' AS message FROM orders WHERE o_orderstatus = 'O' AND date_diff('day', o_orderdate::DATE, DATE '1998-08-02') > 2")
def qual5_stale(spark, sf_dir):
    notes = rows(spark, sf_dir, "orders", "o_orderkey AS rel", "to_date(o_orderdate) AS updated", "DATE '1998-08-02' AS mtime", "o_orderstatus = 'O' AS dirty")
    return checks.stale(notes).select("rel", "level", "message")


@query("""WITH p AS (SELECT p_partkey AS key, p_size % 7 <> 0 AS l, p_size % 11 <> 0 AS r, [CAST(i AS VARCHAR) FOR i IN range(1, p_size % 4 + 2)] AS ln, [CASE WHEN i = 2 AND p_size % 3 = 0 THEN NULL ELSE CAST(i AS VARCHAR) END FOR i IN range(1, p_size % 5 + 2)] AS rn, p_size % 2 = 0 AS named, p_partkey % 2 = 0 AS late FROM part WHERE p_size % 7 <> 0 OR p_size % 11 <> 0),
  d AS (SELECT *, list_filter(range(1, least(len(ln), len(rn)) + 1), lambda i: ln[i] IS DISTINCT FROM rn[i]) AS off FROM p)
  SELECT key, 'no short form' AS message FROM d WHERE NOT r UNION ALL SELECT key, 'no long form' FROM d WHERE NOT l UNION ALL SELECT key, 'section count' FROM d WHERE l AND r AND len(ln) <> len(rn) UNION ALL SELECT key, 'section number at ' || unnest(off) FROM d WHERE l AND r
  UNION ALL SELECT key, 'drift' FROM d WHERE l AND r AND late AND (len(ln) <> len(rn) OR len(off) > 0) UNION ALL SELECT key, 'long form does not name the short form' FROM d WHERE l AND r UNION ALL SELECT key, 'short form does not name the long form' FROM d WHERE l AND r AND NOT named""")  # fmt: skip
def qual6_pair_issues(spark, sf_dir):
    side = lambda there, rel, content, numbers, updated, mtime: f"IF({there}, struct({rel} AS rel, {content} AS content, {numbers} AS numbers, {updated} AS updated, {mtime} AS mtime), NULL)"
    text = lambda low, expr: f"transform(sequence(1, {low}), i -> {expr})"
    left = side("p_size % 7 <> 0", "concat('L-', p_partkey, '.md')", "'x'", text("p_size % 4 + 1", "CAST(i AS STRING)"), "DATE '2024-01-01'", "timestamp_seconds(1000 + 301 * (1 - p_partkey % 2))")
    right = side("p_size % 11 <> 0", "concat('S-', p_partkey, '.md')", "IF(p_size % 2 = 0, concat('see L-', p_partkey), 'y')", text("p_size % 5 + 1", "IF(i = 2 AND p_size % 3 = 0, NULL, CAST(i AS STRING))"), "DATE '2024-01-01'", "timestamp_seconds(1000)")
    pairs = rows(spark, sf_dir, "part", "p_partkey AS key", f"{left} AS left", f"{right} AS right").where("left IS NOT NULL OR right IS NOT NULL")
    return checks.pair_issues(pairs).select("key", "message")


@query("SELECT bool_and(n_regionkey < 4 OR n_name LIKE '%9') AS healthy FROM nation WHERE n_name NOT IN ('NATION_24', 'NATION_14', 'NATION_4')")
def agg12_healthy(spark, sf_dir):
    results = rows(spark, sf_dir, "nation", "n_name AS name", "n_regionkey < 4 OR n_name LIKE '%9' AS ok")
    return checks.healthy(results, ["NATION_24", "NATION_14", "NATION_4"])


_SQL_RECORDS = "SELECT d.doc_id, lang || '/' || d.doc_id AS rel, CASE quality WHEN 1 THEN 'official' WHEN 0 THEN 'community' END AS authority, CASE WHEN toxic = 0 THEN 'reviewed' WHEN toxic IS NOT NULL THEN 'unreviewed' END AS review FROM documents d LEFT JOIN labels USING (doc_id)"


@query(f"WITH r AS ({_SQL_RECORDS}) SELECT rel, concat_ws('; ', CASE WHEN authority IS NULL THEN 'authority: unknown' END, CASE WHEN review IS NULL THEN 'review_status: unreviewed' END) AS adds FROM r WHERE authority IS NULL OR review IS NULL")
def ledg2_backfill(spark, sf_dir):
    none = F.lit(None).cast("string")
    records = _records(spark, sf_dir).select("rel", none.alias("type"), none.alias("title"), F.lit(None).cast("array<string>").alias("tags"), none.alias("source_type"), none.alias("source_author"), "authority", "claim_risk", "review_status")
    return ledger.backfill(records).select("rel", F.array_join("adds", "; ").alias("adds"))


@query("SELECT doc_id AS rel, 'authority' AS field, lang AS value FROM documents UNION ALL SELECT doc_id, 'review_status', source FROM documents WHERE source NOT IN ('reviewed', 'unreviewed')")
def hr14_illegal_values(spark, sf_dir):
    return ledger.illegal_values(rows(spark, sf_dir, "documents", "doc_id AS rel", "lang AS authority", "IF(n_chars % 2 = 0, 'low', NULL) AS claim_risk", "source AS review_status"))


_JSON = """CASE turn % 5 WHEN 0 THEN concat('{"schema_version": 1, "name": "n', CAST(conv_id AS STRING), '"}') WHEN 1 THEN '{"schema_version": 2}' WHEN 2 THEN '{broken' WHEN 3 THEN '{"name": "x"}' ELSE '[1, 2]' END"""


@query(f"""WITH d AS (SELECT conv_id * 1000 + turn AS rel, {_JSON} AS c FROM conversations), j AS (SELECT *, CASE WHEN json_valid(c) THEN json_type(c) END AS kind FROM d)
  SELECT rel, CASE WHEN kind IS DISTINCT FROM 'OBJECT' THEN 'not JSON' WHEN (c->>'$.schema_version')::INT IS DISTINCT FROM 1 THEN 'schema_version' END AS problem, CASE WHEN kind = 'OBJECT' THEN c->>'$.name' END AS name FROM j""")  # fmt: skip
def hlth10_contracts(spark, sf_dir):
    schema = S.StructType([S.StructField("schema_version", S.IntegerType()), S.StructField("name", S.StringType())])
    found = readers.json_contract(rows(spark, sf_dir, "conversations", "conv_id * 1000 + turn AS rel", f"{_JSON} AS content"), schema)
    return found.select("rel", "problem", F.col("data.name").alias("name"))


@query("""WITH n AS (SELECT doc_id AS rel, CASE n_chars % 3 WHEN 0 THEN ['a: b', 'risk: own'] WHEN 1 THEN ['a: b'] END AS f, text FROM documents)
  SELECT rel, md5(CASE WHEN f IS NULL THEN '' ELSE '---' || chr(10) || array_to_string(f, chr(10)) || chr(10) || CASE WHEN len(f) = 1 THEN 'risk: low' || chr(10) ELSE '' END || 'seen: no' || chr(10) || '---' || chr(10) END || text) AS digest FROM n""")  # fmt: skip
def misc4_added_fields(spark, sf_dir):
    notes = rows(spark, sf_dir, "documents", "doc_id AS rel", "concat(CASE n_chars % 3 WHEN 0 THEN '---\na: b\nrisk: own\n---\n' WHEN 1 THEN '---\na: b\n---\n' ELSE '' END, text) AS content")
    return notes.select("rel", F.md5(inbox.add_fields(F.col("content"), [("risk", "low"), ("seen", "no")])).alias("digest"))


@query("""SELECT c_custkey AS rel, CASE WHEN n_name IS NULL THEN 'missing' WHEN contains(n_comment, 'n' || (c_custkey % 30)) THEN 'synced' ELSE 'stale' END AS status FROM customer LEFT JOIN (SELECT *, 'n' || n_nationkey || ' n' || (n_nationkey + 1) AS n_comment FROM nation) ON c_custkey % 30 = n_nationkey + (c_custkey % 2)""")
def misc7_sheet_status(spark, sf_dir):
    drafts = rows(spark, sf_dir, "customer", "c_custkey AS rel", "concat('n', c_custkey % 30) AS heading", "c_custkey % 30 - c_custkey % 2 AS sheet")
    return inbox.sheet_status(drafts, rows(spark, sf_dir, "nation", "CAST(n_nationkey AS BIGINT) AS sheet", "concat('n', n_nationkey, ' n', n_nationkey + 1) AS content"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN '2020-01-02' END AS date FROM orders")
def misc16_first_dates(spark, sf_dir):
    found = rows(spark, sf_dir, "orders", "o_orderkey AS id", "IF(o_orderkey % 3 = 0, concat('at ', date_format(o_orderdate, 'yyyy-MM-dd'), ' not 2019-01-01'), 'no 20-1-2') AS text", "IF(o_orderkey % 3 < 2, 'x-2020-01-02.md', 'plain') AS name")
    return found.select("id", T.first_date(F.col("text"), F.col("name")).alias("date"))


@query("SELECT p_partkey AS rel, p_retailprice AS score FROM part ORDER BY score DESC, rel LIMIT 40")
def sort2_top_findings(spark, sf_dir):
    return code.top(rows(spark, sf_dir, "part", "p_partkey AS rel", "1 AS line_no", "p_retailprice AS score"), 40).select("rel", "score")


_FENCED = "concat('a', chr(10), CASE n_chars % 4 WHEN 0 THEN '~~~' WHEN 1 THEN 'see ```x' WHEN 2 THEN '  ```py' ELSE 'b' END, chr(10), 'c', chr(10), '```', chr(10), 'd')"


@query(f"""WITH n AS (SELECT doc_id AS rel, {_FENCED} AS content FROM documents), l AS (SELECT rel, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM n),
  m AS (SELECT rel, i, k, CASE k WHEN 'prefix' THEN starts_with(ltrim(line), '```') OR starts_with(ltrim(line), '~~~') WHEN 'backticks' THEN starts_with(ltrim(line), '```') ELSE contains(line, '```') END AS mark FROM l, (VALUES ('prefix'), ('backticks'), ('anywhere')) v(k)),
  t AS (SELECT *, sum(mark::INT) OVER (PARTITION BY rel, k ORDER BY i) AS s FROM m) SELECT rel, k AS fences, count(*) FILTER (s % 2 = 1 OR mark) AS n FROM t GROUP BY rel, k""")  # fmt: skip
def parse7_fences(spark, sf_dir):
    notes = rows(spark, sf_dir, "documents", "doc_id AS rel", f"{_FENCED} AS content")
    found = [N.lines(notes, kind).groupBy("rel").agg(F.count_if("in_fence").alias("n")).select("rel", F.lit(kind).alias("fences"), "n") for kind in N.FENCE_MARKS]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT min(rel) AS rel, '// Code Template: ' || min(rel) || chr(10) || chr(10) || arg_min(p_type, rel) AS content FROM (SELECT 'Templates/code/' || CASE WHEN p_size % 2 = 0 THEN 'go/' ELSE 'py/' END || p_brand || '-' || p_partkey || '.txt' AS rel, p_type FROM part) WHERE contains(lower(rel), 'brand#2') AND contains(rel, '/go/')")
def srch4_code_template(spark, sf_dir):
    files = rows(spark, sf_dir, "part", "concat('Templates/code/', IF(p_size % 2 = 0, 'go/', 'py/'), p_brand, '-', p_partkey, '.txt') AS rel", "p_type AS content")
    return render.code_template(files, " Brand#2", "Go")
