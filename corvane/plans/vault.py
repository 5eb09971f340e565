"""Queries of the draft, code, export, link, report and lookup operators on rows made from the test tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.operators import checks, code, export, inbox, linker, lookup, reports
from corvane.plans.queries import query, read
from corvane.sources import journal, shared, sinks


def rows(spark, sf_dir, name, *columns):
    return read(spark, sf_dir, name).selectExpr(*columns)


_LINE = """CASE p_size % 12 WHEN 0 THEN concat('  // TODO: ', p_name, ' because of the lock') WHEN 1 THEN concat('# HACK: ', p_name) WHEN 2 THEN concat('x = 1; workaround: ', p_name) WHEN 3 THEN concat('Pattern: ', p_name)
  WHEN 4 THEN '/* NOTE: short */' WHEN 5 THEN concat('-- Note: ', p_type, ' and then some more of it') WHEN 6 THEN concat('# Code generated by x. TODO: ', p_type) WHEN 7 THEN concat('; ', p_type, ' has an edge-case') WHEN 8 THEN 'BUG:' WHEN 9 THEN repeat('HACK: y ', 200)
  WHEN 10 THEN concat('todolist: ', p_name) ELSE concat('plain ', p_type) END"""


@query(rf"""WITH l AS (SELECT p_partkey AS rel, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 40 END AS line_no, trim({_LINE}) AS s FROM part),
  w AS (SELECT *, '(?i)(?:^|[\s/#*;-]+)\b(workaround|work-around|trap|override|gotcha|bypass|edge[- ]case|monkey[- ]patch|deadlock|race condition|silent drift)\b[:：\s]*(.+)?' AS w, '(?i)(?:^|[\s/#*;-]+)\b(HACK|BUG|FIXME|COMPATIBILITY)\b[:：\s]+(.+)' AS c,
    '(?i)(?:^|[\s/#*;-]+)\b(TODO|NOTE|XXX|OPTIMIZE|WARN)\b[:：\s]+(.+)' AS i FROM l WHERE length(s) BETWEEN 1 AND 1000 AND NOT contains(s, 'Code generated by')),
  k AS (SELECT *, CASE WHEN regexp_matches(s, w) THEN w WHEN regexp_matches(s, c) THEN c WHEN regexp_matches(s, i) THEN i END AS p, line_no <= 25 AND contains(lower(s), 'pattern:') AS design FROM w),
  m AS (SELECT *, upper(regexp_extract(s, p, 1)) AS mark, trim(regexp_extract(s, p, 2)) AS detail FROM k WHERE p IS NOT NULL OR design)
  SELECT rel, line_no, CASE WHEN p = w THEN 'WORKAROUND_TRAP' WHEN p IS NULL THEN 'ARCHITECTURE_COMMENT' ELSE 'ANNOTATION_' || mark END AS category, coalesce(mark, 'architecture-header') AS pattern, substr(CASE WHEN p IS NULL OR detail = '' THEN s ELSE mark || ': ' || detail END, 1, 140) AS excerpt
  FROM m WHERE NOT (coalesce(p = i, false) AND length(detail) < 15)""")  # fmt: skip
def cls5_code_comments(spark, sf_dir):
    return code.comments(rows(spark, sf_dir, "part", "p_partkey AS rel", "IF(p_partkey % 2 = 0, 1, 40) AS line_no", f"{_LINE} AS line")).drop("score")


_DESIGN = "concat('d/', CASE p_size % 5 WHEN 0 THEN 'My-Design-' WHEN 1 THEN 'rules' WHEN 2 THEN 'desig-' WHEN 3 THEN 'design/x' ELSE 'STANDARDS-' END, p_partkey, CASE WHEN p_size % 3 = 0 THEN '.txt' ELSE '.md' END)"


@query(f"""WITH f AS (SELECT {_DESIGN} AS rel, repeat('x' || chr(10), p_size) AS content FROM part), n AS (SELECT *, regexp_replace(rel, '^.*/', '') AS name FROM f)
  SELECT rel, 1 AS line_no, 'ARCHITECTURE_DOC' AS category, 'architecture-filename' AS pattern, 'Architecture / Design document: ' || regexp_replace(name, '[.]md$', '') AS excerpt, (CASE WHEN len(string_split(rtrim(content, chr(10)), chr(10))) > 20 THEN 0.85 ELSE 0.75 END)::DOUBLE AS score
  FROM n WHERE ends_with(name, '.md') AND regexp_matches(lower(name), 'convention|architecture|design|rule|pattern|guideline|standard')""")  # fmt: skip
def cls6_design_documents(spark, sf_dir):
    return code.design_documents(rows(spark, sf_dir, "part", f"{_DESIGN} AS rel", "repeat('x\n', p_size) AS content"))


@query("""WITH f AS (SELECT p_partkey AS rel, p_name || CASE WHEN p_size % 3 = 0 THEN '.GO' WHEN p_size % 3 = 1 THEN '' ELSE '.txt' END AS name, p_type FROM part)
  SELECT rel, CASE WHEN regexp_matches(name, '(?i)[.]go$') THEN 'go' WHEN regexp_matches(lower(p_type || ' ' || name), 'ring|bolt') THEN 'metal' WHEN contains(lower(p_type || ' ' || name), 'economy') THEN 'one' ELSE 'rest' END AS destination FROM f""")  # fmt: skip
def cls8_destination(spark, sf_dir):
    found = rows(spark, sf_dir, "part", "p_partkey", "concat('d/', p_name, CASE p_size % 3 WHEN 0 THEN '.GO' WHEN 1 THEN '' ELSE '.txt' END) AS rel", "p_type")
    place = code.destination(F.col("rel"), F.col("p_type"), {".go": "go"}, [(["ring", "bolt"], "metal"), (["economy"], "one")], "rest")
    return found.select("p_partkey", place.alias("destination")).withColumnRenamed("p_partkey", "rel")


_TAGS = "CASE p_size % 9 WHEN 0 THEN NULL WHEN 1 THEN {0}'topic/git', 'lang/GO'{1} WHEN 2 THEN {0}'topic/mutex', 'category/tools'{1} WHEN 3 THEN {0}'category/my-Tool'{1} WHEN 4 THEN {0}'topic/powertools', 'source/web'{1} WHEN 5 THEN {0}'category/project:x'{1} WHEN 6 THEN {0}'source/book'{1} WHEN 7 THEN {0}'lang/python', 'lang/go'{1} ELSE {0}'topic/other'{1} END"
_TO = "CASE p_size % 7 WHEN 0 THEN '[[01-Rules\\\\A]]' WHEN 1 THEN '[[03-Languages/x]]' WHEN 2 THEN 'elsewhere' END"


@query(f"""WITH d AS (SELECT p_partkey AS rel, CASE WHEN p_size % 4 = 0 THEN 'source-notes' ELSE 'notes' END AS type, coalesce({_TAGS.format("[", "]")}, []) AS tags, replace(regexp_replace(coalesce({_TO.replace(chr(92) * 2, chr(92))}, ''), '[\\[\\]]', '', 'g'), chr(92), '/') AS dest FROM part),
  g AS (SELECT *, list_filter(tags, lambda t: starts_with(t, 'lang/')) AS lang, list_filter(tags, lambda t: starts_with(t, 'category/project:')) AS project FROM d)
  SELECT rel, CASE WHEN starts_with(dest, '01-Rules/') THEN '01-Rules/' WHEN starts_with(dest, '03-Languages/') THEN '03-Languages/' WHEN len(lang) > 0 THEN '03-Languages/' || upper(lang[1][6:6]) || lower(lang[1][7:]) || '/'
    WHEN list_has_any(tags, ['topic/git', 'topic/symlink', 'topic/windows', 'topic/concurrency', 'topic/channel', 'topic/mutex', 'topic/errgroup', 'topic/error', 'topic/error-handling', 'topic/panic']) THEN '01-Rules/'
    WHEN len(list_filter(tags, lambda t: regexp_matches(t, '(?i)^(category|topic)/.*tool'))) > 0 THEN '05-Tools/' WHEN type = 'source-notes' OR len(list_filter(tags, lambda t: starts_with(t, 'source/'))) > 0 THEN '06-Sources/'
    WHEN len(project) > 0 THEN '08-Projects/' || split_part(project[1], ':', 2) || '/' ELSE '01-Rules/' END AS destination FROM g""")  # fmt: skip
def tri1_destinations(spark, sf_dir):
    return inbox.destinations(rows(spark, sf_dir, "part", "p_partkey AS rel", "IF(p_size % 4 = 0, 'source-notes', 'notes') AS type", f"{_TAGS.format('array(', ')')} AS tags", f"{_TO} AS promoted_to"))


@query("SELECT CASE WHEN lang = 'en' THEN 'general' ELSE 'Language: ' || upper(lang) END AS cluster, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def agg10_clusters(spark, sf_dir):
    return inbox.clusters(rows(spark, sf_dir, "documents", "doc_id AS rel", "IF(lang = 'en', array('source/x'), array(concat('source/', source), concat('lang/', lang), 'topic/y')) AS tags", "text AS content"))


@query("SELECT doc_id AS rel, md5('---' || chr(10) || 'title: x' || chr(10) || 'status: stable' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'type: y' || chr(10) ELSE '' END || '---' || chr(10) || text) AS digest FROM documents")
def misc3_field_upsert(spark, sf_dir):
    docs = rows(spark, sf_dir, "documents", "doc_id AS rel", "concat('---\ntitle: x\n', IF(doc_id % 2 = 0, 'status: draft\ntype: y\n', ''), '---\n', text) AS content")
    return docs.select("rel", F.md5(inbox.upsert_field(F.col("content"), "status", "stable")).alias("digest"))


_BODY = "concat(CASE WHEN n_chars % 3 = 0 THEN concat('# A', chr(10), '##   B c', chr(10), '#no', chr(10), '#### deep', chr(10)) ELSE '' END, text, CASE WHEN n_chars % 4 = 0 THEN concat(chr(10), '```go', chr(10), '# In', chr(10), '```', chr(10), '```x```', chr(10), '``` open') ELSE '' END)"


@query(rf"""WITH n AS (SELECT doc_id AS rel, {_BODY} AS c FROM documents)
  SELECT rel, len(list_filter(string_split(c, chr(10)), lambda x: regexp_matches(x, '^#{{1,3}}\s+\S')))::BIGINT AS n_headings, (len(string_split(c, '```')) - 1) // 2 AS n_code_blocks, (len(string_split(c, chr(10))) - (c = '' OR ends_with(c, chr(10)))::INT)::BIGINT AS n_lines FROM n""")  # fmt: skip
def misc5_body_statistics(spark, sf_dir):
    return inbox.body_statistics(rows(spark, sf_dir, "documents", "doc_id AS rel", f"{_BODY} AS content"))


_FILES = "'d' || (p_partkey % 7) || '/n' || (p_partkey // 3)"


@query(f"SELECT DISTINCT {_FILES} AS target FROM part UNION SELECT 'n' || (p_partkey // 3) FROM part GROUP BY 1 HAVING count(*) = 1")
def agg15_known_targets(spark, sf_dir):
    return export.known_targets(rows(spark, sf_dir, "part", "concat('d', p_partkey % 7, '/n', p_partkey DIV 3, '.md') AS rel"))


@query("""SELECT page_id AS rel, 'see ' || CASE WHEN page_id % 10 < 4 THEN '[[k/' || page_id % 10 || '|the ' || page_id || ']]' ELSE 'the ' || page_id END || ' end ' || CASE WHEN page_id % 3 = 0 THEN '[[k/0]]' ELSE 'z' || (page_id % 3) END AS content,
  (page_id % 10 >= 4)::BIGINT + (page_id % 3 <> 0)::BIGINT AS n_repaired FROM pages""")  # fmt: skip
def misc15_neutralised_links(spark, sf_dir):
    notes = rows(spark, sf_dir, "pages", "page_id AS rel", "concat('see [[k/', page_id % 10, '|the ', page_id, ']] end [[', IF(page_id % 3 = 0, 'k/0', concat('q/z', page_id % 3)), ']]') AS content")
    return export.neutralise_links(notes, spark.range(4).selectExpr("concat('k/', id) AS target"))


@query("SELECT doc_id AS rel, i AS line_no, token FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS i FROM documents), (VALUES ('ing'), ('License'), ('th')) t(token) WHERE contains(lower(line), lower(token))")
def lint1_forbidden(spark, sf_dir):
    lines = rows(spark, sf_dir, "documents", "doc_id AS rel", "posexplode(split(text, '\n')) AS (i, line)").selectExpr("rel", "i + 1 AS line_no", "line")
    return export.lint(lines, ["ing", "License", "th"])


_NAMED = "CASE WHEN {0} % 12 = 11 THEN '01-Rules/（s p' ELSE CASE {0} % 6 WHEN 0 THEN '99-Inbox/x' WHEN 1 THEN '10-Daily/x' WHEN 2 THEN '01-Rules/2024-01-01-' WHEN 3 THEN '03-Languages/go/x-standards-' WHEN 4 THEN 'a?b|' ELSE '01-Rules/(s p' END END"


@query(f"""WITH n AS (SELECT {_NAMED.format('doc_id')} || doc_id || '.md' AS rel FROM documents), f AS (SELECT *, regexp_replace(rel, '^.*/', '') AS name, NOT regexp_matches(rel, '^(99-Inbox|10-Daily|Templates|11-Agents)/') AS formal FROM n)
  SELECT rel, 'ERROR' AS level, 'NAMING' AS category, 'character ' || unnest(regexp_extract_all(name, '[<>:"|?*]')) AS message FROM f
  UNION ALL SELECT rel, 'WARN', 'NAMING', 'space' FROM f WHERE contains(name, ' ') AND NOT regexp_matches(rel, '^(10-Daily|Templates)/')
  UNION ALL SELECT rel, 'WARN', 'NAMING', CASE WHEN starts_with(rel, '99') THEN 'draft' ELSE 'daily' END || ' without date' FROM f WHERE regexp_matches(rel, '^(99-Inbox|10-Daily)/') AND NOT regexp_matches(name, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
  UNION ALL SELECT rel, 'ERROR', 'NAMING', 'dated name' FROM f WHERE formal AND regexp_matches(name, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
  UNION ALL SELECT rel, 'ERROR', 'NAMING', 'full-width parentheses' FROM f WHERE formal AND regexp_matches(name, '[（）]')
  UNION ALL SELECT rel, 'WARN', 'NAMING', 'expected ' || upper(split_part(rel, '/', 2)) || '-STANDARDS.md' FROM f WHERE starts_with(rel, '03-Languages/') AND contains(lower(name), '-standards') AND upper(name) <> upper(split_part(rel, '/', 2)) || '-STANDARDS.MD'""")  # fmt: skip
def qual4_name_issues(spark, sf_dir):
    return checks.name_issues(rows(spark, sf_dir, "documents", f"concat({_NAMED.format('doc_id')}, doc_id, '.md') AS rel"))


@query("SELECT doc_id AS rel, strlen(text)::BIGINT AS bytes, round(strlen(text) * 100.0 / 10240, 1)::DOUBLE AS percent, strlen(text) <= 10240 AS ok FROM documents")
def hlth6_sizes(spark, sf_dir):
    return checks.sizes(rows(spark, sf_dir, "documents", "doc_id AS rel", "text AS content")).withColumn("percent", F.col("percent").cast("double"))


_ENTRY = "CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN substr(url, 1, 5) WHEN 2 THEN 'http:' WHEN 3 THEN 'https' ELSE 'http: ' END"


@query(f"""WITH e AS (SELECT page_id AS rel, {_ENTRY} AS content, length(url) % 2 = 0 AS link FROM pages)
  SELECT rel, CASE WHEN content IS NULL THEN 'missing' WHEN sha256(content) <> sha256('http:') THEN 'mismatch' WHEN link THEN 'symlink' ELSE 'copy' END AS state FROM e""")  # fmt: skip
def join15_entry_states(spark, sf_dir):
    entries = rows(spark, sf_dir, "pages", "page_id AS rel", f"CAST({_ENTRY} AS BINARY) AS content", "length(url) % 2 = 0 AS link")
    return checks.entry_states(entries, spark.range(1).selectExpr("CAST('http:' AS BINARY) AS content"))


@query("""WITH l AS (SELECT doc_id AS rel, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM documents)
  SELECT rel, min(line_no) AS line_no, arg_min(CASE WHEN contains(line, 'and') THEN 'and' ELSE 'ing' END, line_no) AS word FROM l WHERE contains(line, 'and') OR contains(line, 'ing') GROUP BY rel""")  # fmt: skip
def hlth7_first_with(spark, sf_dir):
    lines = rows(spark, sf_dir, "documents", "doc_id AS rel", "posexplode(split(text, '\n')) AS (i, line)").selectExpr("rel", "i + 1 AS line_no", "line")
    return checks.first_with(lines, ["and", "ing"])


@query("SELECT DISTINCT c_custkey AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join13_unregistered(spark, sf_dir):
    return checks.unregistered(rows(spark, sf_dir, "customer", "c_custkey AS name"), read(spark, sf_dir, "orders").where("o_totalprice > 200000").selectExpr("o_custkey AS name"))


@query("SELECT o_orderpriority AS category, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS open FROM orders GROUP BY 1")
def ins1_corrections(spark, sf_dir):
    return reports.corrections(rows(spark, sf_dir, "orders", "o_orderpriority AS category", "IF(o_orderstatus = 'F', 'Closed', o_orderstatus) AS status"))


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, 'daily: ' || strftime(o_orderdate, '%Y-%m-%d') || '-' || o_orderkey AS entry FROM orders
  UNION ALL SELECT strftime(ts, '%Y-%m-%d'), 'review: ' || strftime(ts, '%Y-%m-%d') || ' ' || event_id || ' [link]' FROM events ORDER BY 1 DESC, 2 LIMIT 30""")  # fmt: skip
def dash2_timeline(spark, sf_dir):
    daily = rows(spark, sf_dir, "orders", "concat('10-Daily/', date_format(o_orderdate, 'yyyy-MM-dd'), '-', o_orderkey, '.md') AS rel", "'' AS content")
    return reports.timeline(daily, rows(spark, sf_dir, "events", "concat(' ', date_format(ts, 'yyyy-MM-dd'), ' ', event_id, ' https://h.io/', event_id) AS line"))


@query("SELECT lpad(conv_id::VARCHAR, 9, '0') AS rel, turn AS line_no, text || '?' AS question FROM conversations WHERE turn % 2 = 1 ORDER BY 1, 2 LIMIT 50")
def dash4_open_questions(spark, sf_dir):
    return reports.open_questions(rows(spark, sf_dir, "conversations", "lpad(CAST(conv_id AS STRING), 9, '0') AS rel", "turn AS line_no", "concat(' ', text, IF(turn % 2 = 1, '? ', '')) AS line", "false AS in_fence", "false AS in_fields"))


@query("SELECT * FROM (SELECT source, count(*) AS note_count FROM documents GROUP BY 1) ORDER BY source LIMIT 20")
def dash1_recent_sources(spark, sf_dir):
    return reports.recent_sources(rows(spark, sf_dir, "documents", "source").groupBy("source").agg(F.count("*").alias("note_count")))


@query("""SELECT c_custkey AS project, date_diff('day', r, c)::INT AS days, CASE WHEN r IS NULL THEN 'missing' WHEN date_diff('day', r, c) > 7 THEN 'behind' ELSE 'fresh' END AS state FROM
  (SELECT c_custkey, min(o_orderdate::DATE) FILTER (o_orderstatus = 'O') AS r, max(o_orderdate::DATE) AS c FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)""")  # fmt: skip
def join11_rule_drift(spark, sf_dir):
    dates = rows(spark, sf_dir, "orders", "o_custkey AS project", "o_orderstatus", "to_date(o_orderdate) AS d").groupBy("project").agg(F.min(F.when(F.col("o_orderstatus") == "O", F.col("d"))).alias("rules"), F.max("d").alias("code"))
    return code.rule_drift(rows(spark, sf_dir, "customer", "c_custkey AS project").join(dates, "project", "left"))


@query("SELECT 'd/' || p_name || '.md' AS rel, 'part' AS match FROM (SELECT DISTINCT p_name FROM part WHERE contains(lower(p_name), 'a')) ORDER BY 1 LIMIT 10")
def join16_find_note(spark, sf_dir):
    return lookup.find_note(rows(spark, sf_dir, "part", "concat('d/', p_name, '.md') AS rel").distinct(), "[[A|alias]]")


@query("SELECT 'code' AS tier, p_partkey AS rel, p_retailprice AS score FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def srch2_ladder(spark, sf_dir):
    part = rows(spark, sf_dir, "part", "p_partkey AS rel", "p_retailprice AS score")
    return lookup.ladder([("vault", part.where("score < 0")), ("code", part), ("docs", part)])


@query("""WITH d AS (SELECT o_orderkey AS id, '2024-01-01-p' || substr(o_orderpriority, 3, 2) AS n FROM orders), r AS (SELECT id, n, row_number() OVER (PARTITION BY n ORDER BY id) AS i FROM d)
  SELECT id, '99-Inbox/' || n || CASE WHEN i = 1 THEN '' ELSE '-' || (i - 1) END || '.md' AS rel FROM r""")  # fmt: skip
def sink6_free_names(spark, sf_dir):
    drafts = rows(spark, sf_dir, "orders", "o_orderkey AS id", "DATE '2024-01-01' AS day", "concat('p', substr(o_orderpriority, 3, 2)) AS slug")
    return sinks.free_names(drafts, spark.range(0).selectExpr("'' AS rel"))


_WORDS = "SELECT w AS term, 'b/' || min(item_id) AS target FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]{8,}'))) AS w FROM benchmark) GROUP BY w"


def _words(spark, sf_dir):
    found = rows(spark, sf_dir, "benchmark", "item_id", "explode(array_distinct(regexp_extract_all(text, '([A-Za-z]{8,})', 1))) AS term").groupBy("term").agg(F.min("item_id").alias("i"))
    return found.selectExpr("term", "concat('b/', i) AS target", "concat('b/', i) AS source")


@query(f"""WITH w AS ({_WORDS}) SELECT doc_id::VARCHAR AS rel, term, target, strpos(text, term) - 1 AS first,
  (length(text) - length(replace(text, term, ''))) // length(term) AS n FROM documents JOIN w ON contains(text, term)""")  # fmt: skip
def join9_term_mentions(spark, sf_dir):
    """Words of the benchmark in documents, as often as replacing them would meet them: a word can overlap itself."""
    found = linker.mentions(rows(spark, sf_dir, "documents", "CAST(doc_id AS STRING) AS rel", "text AS content"), _words(spark, sf_dir), overlapping=False)
    return found.select("rel", "term", "target", "n", "first")


_ONE_LINE = "trim(regexp_replace(text, '[^A-Za-zÀ-ÿ .,]+', ' '{}))"


_FIRST = r"'(^|[^\[`\p{L}\p{N}_\-/])' || ws[i + 1].term || '([^\]`\p{L}\p{N}_\-.]|$)'"


@query(rf"""WITH RECURSIVE w AS ({_WORDS}), d AS (SELECT doc_id::VARCHAR AS rel, {_ONE_LINE.format(", 'g'")} AS t FROM documents WHERE text IS NOT NULL),
  m AS (SELECT rel, t, list(struct_pack(term := term, target := target) ORDER BY length(term) DESC, term) AS ws FROM d JOIN w ON contains(t, term) GROUP BY rel, t),
  s AS (SELECT rel, t, ws, 0 AS i, 0 AS n FROM m UNION ALL
    SELECT rel, regexp_replace(t, {_FIRST}, '\1[[' || ws[i + 1].target || ']]\2'), ws, i + 1, n + regexp_matches(t, {_FIRST})::INT FROM s WHERE i < len(ws))
  SELECT rel, n AS n_links, md5(t) AS digest FROM s WHERE i = len(ws) AND n > 0""")  # fmt: skip
def link1_linked_lines(spark, sf_dir):
    """Documents as one plain line each, without marks that protect text, so that SQL can replace first mentions one term after the other."""
    notes = rows(spark, sf_dir, "documents", "CAST(doc_id AS STRING) AS rel", f"{_ONE_LINE.format('')} AS content")
    return linker.link(notes, _words(spark, sf_dir)).select("rel", F.size("links").alias("n_links"), F.md5("content").alias("digest"))


@query()
def link1_linked_notes(spark, sf_dir):
    found = linker.link(rows(spark, sf_dir, "documents", "CAST(doc_id AS STRING) AS rel", "text AS content"), _words(spark, sf_dir))
    return found.select("rel", F.size("links").alias("n_links"), F.md5("content").alias("digest"))


@query("""WITH n AS (SELECT 'd' || (p_partkey % 5) || '/' || p_name || '.md' AS rel, p_name AS stem FROM part WHERE length(p_name) >= 4 AND lower(p_name) NOT IN ('note', 'code'))
  SELECT stem AS term, replace(min(rel), '.md', '') AS target, min(rel) AS source FROM n GROUP BY stem""")  # fmt: skip
def join10_dictionary(spark, sf_dir):
    return linker.dictionary(rows(spark, sf_dir, "part", "concat('d', p_partkey % 5, '/', p_name, '.md') AS rel", "CAST(NULL AS STRING) AS title", "CAST(NULL AS ARRAY<STRING>) AS tags"))


def _damaged_store(spark, sf_dir) -> journal.Store:
    """Documents as files; one change whose writer is lost when all is prepared, one whose writer is lost before, and what recovery makes of them."""
    root = f"{shared.folder(spark)}/store-{uuid.uuid4().hex}"
    fs, where = shared.store(spark, root)
    fs.deleteOnExit(where)
    store = journal.Store(spark, root, buckets=16)
    files = rows(spark, sf_dir, "documents", "CAST(doc_id AS STRING) AS rel", "text AS content", "doc_id").where("content IS NOT NULL")
    journal.apply(store, files.selectExpr("rel", "content", "CAST(NULL AS STRING) AS expected"))
    new = "CASE WHEN doc_id % 10 = 3 THEN NULL ELSE concat('{} ', content) END AS content"
    journal.Transaction(store).stage(files.where("doc_id % 10 IN (3, 4)").selectExpr("rel", new.format("first"), "sha2(content, 256) AS expected")).prepare()
    journal.Transaction(store).stage(files.where("doc_id % 10 = 5").selectExpr("rel", new.format("second"), "sha2(content, 256) AS expected"))
    journal.recover(store)
    return store


@query("""SELECT doc_id::VARCHAR AS rel, md5(CASE WHEN doc_id % 10 = 4 THEN 'first ' || text ELSE text END) AS digest FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 3""")
def sink3_recovered_files(spark, sf_dir):
    return _damaged_store(spark, sf_dir).files().select("rel", F.md5("content").alias("digest"))


@query("""WITH d AS (SELECT doc_id, text, doc_id % 10 AS k FROM documents WHERE text IS NOT NULL),
  j AS (SELECT 'create' AS action, 'committed' AS status, doc_id, NULL AS b, sha256(text) AS a FROM d
    UNION ALL SELECT CASE k WHEN 3 THEN 'delete' ELSE 'write' END, CASE k WHEN 5 THEN 'rolled_back' ELSE 'committed' END, doc_id, sha256(text),
      CASE k WHEN 4 THEN sha256('first ' || text) WHEN 5 THEN sha256('second ' || text) END FROM d WHERE k IN (3, 4, 5))
  SELECT doc_id::VARCHAR AS rel, action, status, b AS before_sha256, a AS after_sha256 FROM j""")  # fmt: skip
def sink3_journal(spark, sf_dir):
    return _damaged_store(spark, sf_dir).journal().drop("tx")
