"""Queries of the composite reports over rows made from the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import canvas, composites, graph, render
from corvane.operators import notes as N
from corvane.plans.health import CONTENT, NOTES, REL, _split
from corvane.plans.queries import query, read
from corvane.plans.vault import rows
from corvane.sources import readers, sinks

_PATH = "concat(CASE p_size % 8 WHEN 0 THEN '01-Rules/' WHEN 1 THEN 'src/.hidden/' WHEN 2 THEN 'lib/node_modules/' WHEN 3 THEN '05-Tools/x/' WHEN 4 THEN '' WHEN 5 THEN '.git/' ELSE 'src/' END, replace(p_name, ' ', '-'), CASE p_size % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.PY' WHEN 2 THEN '.min.js' WHEN 3 THEN '' WHEN 4 THEN '.go' WHEN 5 THEN '.png' ELSE '.ts' END)"


@query(f"""WITH f AS (SELECT {_PATH} AS rel, p_partkey % 400 AS real_path FROM part), e AS (SELECT *, lower(regexp_extract(rel, '[^/](\\.[^./]*)$', 1)) AS x FROM f)
  SELECT real_path, min(rel) AS rel FROM e WHERE (split_part(rel, '/', 1) IN ('01-Rules', '05-Tools') AND x IN ('.md', '.go', '.py', '.ts', '.rs', '.sh', '.sql', '.yaml', '.yml')) OR (NOT contains(rel, '/') AND rel LIKE '%.md') GROUP BY 1""")  # fmt: skip
def scan1_indexable(spark, sf_dir):
    return composites.indexable(rows(spark, sf_dir, "part", f"{_PATH} AS rel", "p_partkey % 400 AS real_path").distinct())


@query(f"SELECT rel FROM (SELECT {_PATH} AS rel FROM part) WHERE NOT list_contains(string_split(rel, '/'), 'node_modules') AND NOT starts_with(rel, 'src/.hid')")
def scan3_not_excluded(spark, sf_dir):
    found = rows(spark, sf_dir, "part", f"{_PATH} AS rel")
    return found.where(~composites.excluded(F.col("rel"), ["node_modules"], ["src/.hid"]))


_BYTES = "CASE WHEN p_size % 3 = 0 THEN concat(p_type, {nul}, 'x') ELSE p_type END"


@query(f"""WITH f AS (SELECT {_PATH} AS rel, {_BYTES.format(nul="'#'")} AS t FROM part), e AS (SELECT *, lower(regexp_extract(rel, '[^/](\\.[^./]*)$', 1)) AS x FROM f)
  SELECT rel FROM e WHERE NOT starts_with(rel, '.git/') AND (x IN ('.md', '.py') OR (x = '' AND NOT contains(t, '#')))""")  # fmt: skip
def scan11_text_files(spark, sf_dir):
    return composites.text_files(rows(spark, sf_dir, "part", f"{_PATH} AS rel", f"CAST({_BYTES.format(nul='char(0)')} AS BINARY) AS content")).select("rel")


_CODE = "CASE p_size % 5 WHEN 0 THEN concat('a = 1', chr(10), ' // HACK: ', p_type, ' because the lock leaks') WHEN 1 THEN concat('# TODO: short', chr(10), '# NOTE: ', p_type, ' drifts on windows, see the encoding of ', p_brand) WHEN 2 THEN repeat('x', 1200) ELSE concat('workaround: ', p_type) END"


@query(f"""WITH f AS (SELECT {_PATH} AS rel, {_CODE} AS content FROM part), k AS (
    SELECT rel, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line_no FROM f
    WHERE NOT regexp_matches(rel, '(^|/)(node_modules|[.][^/]*)/') AND regexp_matches(lower(rel), '[.](go|py|ts)$') AND length(content) < 1000)
  SELECT rel, line_no, CASE WHEN contains(line, 'HACK: ') THEN 'ANNOTATION_HACK' WHEN contains(line, 'NOTE: ') THEN 'ANNOTATION_NOTE' ELSE 'WORKAROUND_TRAP' END AS category FROM k
  WHERE contains(line, 'HACK: ') OR contains(line, 'NOTE: ') OR starts_with(line, 'workaround: ')""")  # fmt: skip
def scanc1_code_scan(spark, sf_dir):
    found = composites.code_scan(rows(spark, sf_dir, "part", f"{_PATH} AS rel", f"{_CODE} AS content", f"octet_length({_CODE}) AS size"))
    return found.select("rel", "line_no", "category")


@query("""WITH n AS (SELECT r_name AS rel, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'L1' ELSE 'L2' END AS layer, unnest([lower(replace(n_name, '_', '-')), 'and-more']) AS name FROM n""")  # fmt: skip
def scan7_registry(spark, sf_dir):
    cell = "concat('`', lower(replace(n_name, '_', '-')), '` / `and-more`')"
    table = lambda *texts: f"array({', '.join(f'struct(n_nationkey * 10 + {i} AS line_no, {t} AS line)' for i, t in enumerate(texts))})"
    first = table("'## 2.1 First'", "'| # | Skill | x |'", "'|---|---|---|'", f"concat('| 1 | ', {cell}, ' | `no` |')", "'text'", "'| `not` | `a-table` |'")
    second = table("'### 3 Second'", "'| Skill |'", f"concat(' | ', {cell}, ' |')", "'## 9 Other'", "'| Skill |'", "'| `never` |'")
    of_region = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = of_region.selectExpr("r_name AS rel", f"explode(IF(n_nationkey % 2 = 0, {first}, {second})) AS l")
    return composites.registry(lines.select("rel", "l.line_no", "l.line"), {"2.1": "L1", "3": "L2"}, "Skill")


@query("""SELECT layer, name, level FROM (SELECT 'L2' AS layer, s_name AS name, 'ERROR' AS level FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT 'L1', s_name, 'WARN' FROM supplier WHERE s_suppkey % 2 = 1) WHERE name NOT IN (SELECT s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 3)""")
def hlth8_registry_sync(spark, sf_dir):
    names = rows(spark, sf_dir, "supplier", "IF(s_suppkey % 2 = 0, 'L2', 'L1') AS layer", "s_name AS name")
    installed = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation").where("n_regionkey < 3"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"))
    return composites.registry_sync(names, installed, installed)


_DRAFTS = "doc_id AS rel, n_chars % 50 - 4 AS age_days, 'notes' AS type, CASE n_chars % 4 WHEN 0 THEN NULL WHEN 1 THEN {0}'topic/git'{1} WHEN 2 THEN {0}concat('lang/', lang), 'lang/all'{1} ELSE {0}'category/x', concat('topic/', source){1} END AS tags, '' AS promoted_to"


@query(f"""WITH d AS (SELECT {_DRAFTS.format("[", "]")} FROM documents), a AS (SELECT *, greatest(age_days, 0) AS age FROM d), t AS (SELECT rel, unnest(tags) AS t FROM d),
  g AS (SELECT 'lang' AS part, rel, t[6:] AS v FROM t WHERE t LIKE 'lang/%' UNION ALL SELECT 'topic', rel, t[7:] FROM t WHERE t LIKE 'topic/%'),
  dest AS (SELECT rel, coalesce((SELECT '03-Languages/' || upper(min(v)[1]) || min(v)[2:] || '/' FROM g WHERE part = 'lang' AND v <> 'all' AND g.rel = a.rel), '01-Rules/') AS v FROM a)
  SELECT part, value, count(*) AS n FROM (
    SELECT 'total' AS part, 'drafts' AS value FROM a UNION ALL SELECT 'total', CASE WHEN age >= 14 THEN 'overdue' ELSE 'fresh' END FROM a
    UNION ALL SELECT 'tier', CASE WHEN age >= 30 THEN '>=30d' WHEN age >= 14 THEN '>=14d' WHEN age >= 7 THEN '>=7d' ELSE '<7d' END FROM a UNION ALL SELECT 'destination', v FROM dest
    UNION ALL SELECT part, v FROM g UNION ALL SELECT 'lang', 'generic / unassigned' FROM a WHERE rel NOT IN (SELECT rel FROM g WHERE part = 'lang') UNION ALL SELECT 'topic', 'general' FROM a WHERE rel NOT IN (SELECT rel FROM g WHERE part = 'topic')) GROUP BY ALL""")  # fmt: skip
def tri1_triage(spark, sf_dir):
    return composites.triage(rows(spark, sf_dir, "documents", *_split(_DRAFTS.format("array(", ")"))))


@query("""WITH l AS (SELECT page_id AS rel, unnest(string_split(html, '>')) AS line, generate_subscripts(string_split(html, '>'), 1)::INT AS line_no FROM pages), p AS (SELECT rel, line_no, unnest(regexp_extract_all(line, 'href="([^"]*)"', 1)) || '/a.md' AS detail FROM l)
  SELECT rel, line_no, 'token' AS kind, 'Nicht' AS detail FROM l WHERE contains(lower(line), 'nicht') UNION ALL SELECT rel, line_no, 'pattern', 'numbers' FROM l WHERE regexp_matches(line, '(?i)track\\([0-9]+\\)')
  UNION ALL SELECT rel, line_no, 'path', 'k' || detail FROM p WHERE detail NOT IN (SELECT '/' || regexp_extract(html, '<title>([^< ]*)', 1) || '/a.md' FROM pages) AND NOT starts_with(detail, '/the')""")  # fmt: skip
def lint1_whole(spark, sf_dir):
    marked = F.regexp_replace("line", 'href="([^"]*)"', "`k$1/a.md`")
    lines = rows(spark, sf_dir, "pages", "page_id AS rel", "posexplode(split(html, '>')) AS (i, line)").select("rel", (F.col("i") + 1).alias("line_no"), marked.alias("line"))
    files = read(spark, sf_dir, "pages").select(F.concat(F.lit("k/"), F.regexp_extract("html", "<title>([^< ]*)", 1), F.lit("/a.md")).alias("rel"))
    return composites.lint(lines, files, ["Nicht"], [("numbers", "TRACK\\([0-9]+\\)")], [".md"], allowed=["k/the"])


_TARGETS = "concat('t/', CAST(p_partkey AS STRING)) AS tag, CASE p_size % 5 WHEN 0 THEN 'dual' WHEN 1 THEN 'rule-append' WHEN 2 THEN 'source-article' WHEN 3 THEN 'project' ELSE 'odd' END AS type, p_name AS name, concat('a/', p_brand, '.md') AS standards, CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('b/', p_brand, '.md') END AS cheatsheet, CASE WHEN p_size % 2 = 0 THEN concat('a/', p_brand, '.md') END AS target, CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'c/' END AS target_dir, CASE WHEN p_size % 2 = 0 THEN 'one' ELSE 'two' END AS target_project"


@query(f"""WITH r AS (SELECT {_TARGETS} FROM part), f AS (SELECT DISTINCT 'a/' || p_brand || '.md' AS rel FROM part WHERE p_brand < 'Brand#3'),
  w AS (SELECT tag, 'standards' AS key, standards AS t FROM r WHERE type = 'dual' UNION ALL SELECT tag, 'cheatsheet', cheatsheet FROM r WHERE type = 'dual' UNION ALL SELECT tag, 'target', target FROM r WHERE type = 'rule-append')
  SELECT tag, 'type' AS problem FROM r WHERE type = 'odd' UNION ALL SELECT tag, 'missing ' || key FROM w WHERE coalesce(t, '') = '' UNION ALL SELECT tag, 'no ' || t FROM w WHERE t <> '' AND t NOT IN (FROM f)
  UNION ALL SELECT tag, 'no c/' FROM r WHERE type = 'source-article' AND target_dir = 'c/' UNION ALL SELECT tag, 'no two' FROM r WHERE type = 'project' AND target_project = 'two'""")  # fmt: skip
def hlth11_route_targets(spark, sf_dir):
    files = rows(spark, sf_dir, "part", "concat('a/', p_brand, '.md') AS rel", "p_brand").where("p_brand < 'Brand#3'").select("rel")
    extra = spark.sql("SELECT '08-Projects/one/x.md' AS rel UNION ALL SELECT 'top.md'")
    return composites.route_targets(rows(spark, sf_dir, "part", *_split(_TARGETS)), files.unionByName(extra))


@query(rf"""WITH {NOTES}, k AS (SELECT rel, content FROM notes WHERE starts_with(rel, '01-Rules/') OR starts_with(rel, '03-Languages/')),
  known AS (SELECT regexp_replace(regexp_replace(rel, '^.*/', ''), '.md$', '') AS n FROM notes WHERE contains(rel, '/')),
  l AS (SELECT rel, unnest(regexp_extract_all(content, '\[\[([^\]]+)\]\]', 1)) AS raw FROM k), t AS (SELECT rel, regexp_replace(split_part(split_part(raw, '|', 1), '#', 1), '^.*/', '') AS n FROM l)
  SELECT k.rel, (SELECT count(*) FROM t WHERE t.rel = k.rel AND n NOT IN (FROM known)) AS n_repaired, strlen(content) > 0 AS kept FROM k UNION ALL SELECT rel, 0, NULL FROM notes WHERE starts_with(rel, '99-Inbox/')""")  # fmt: skip
def exp1_package(spark, sf_dir):
    files = rows(spark, sf_dir, "documents", f"{REL} AS rel", f"{CONTENT} AS content")
    found = composites.export_package(files, [("keep", ["01-Rules/**", "03-Languages/**"]), ("structure", ["99-Inbox/**"])], [("See", "Look at")])
    return found.select("rel", "n_repaired", (F.octet_length("content") > 0).alias("kept"))


_LEDGER = "doc_id AS rel, CASE quality WHEN 1 THEN 'official' ELSE 'oficial' END AS authority, CAST(NULL AS STRING) AS claim_risk, CASE toxic WHEN 1 THEN 'seen' END AS review_status"


@query("SELECT count(*) AS notes, count(*) FILTER (quality = 0) + count(*) FILTER (toxic = 1) AS illegal, false AS all_unknown, false AS passed FROM labels")
def ledg1_gate(spark, sf_dir):
    return composites.ledger_gate(rows(spark, sf_dir, "labels", *_split(_LEDGER)))


_CLAIMS = "CASE turn % 3 WHEN 0 THEN concat(' - ', 'MUST ', text) WHEN 1 THEN concat('> 2) NEVER ', text) ELSE text END"


@query(f"""WITH l AS (SELECT conv_id % 15 AS rel, conv_id * 100 + turn AS line_no, {_CLAIMS} AS line FROM conversations), c AS (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY line_no) AS i FROM l WHERE contains(line, '- MUST') OR contains(line, ') NEVER') OR regexp_matches(line, '^(is |is not|MUST|SHOULD|NEVER|必须|禁止|不得|应|推荐)'))
  SELECT rel, line_no FROM c WHERE i <= 20""")  # fmt: skip
def cls4_claims(spark, sf_dir):
    return composites.claims(rows(spark, sf_dir, "conversations", "conv_id % 15 AS rel", "conv_id * 100 + turn AS line_no", f"{_CLAIMS} AS line", "false AS in_fence")).select("rel", "line_no")


@query("""WITH p AS (SELECT 'd' || (l_orderkey % 3) || '/go-' || CASE WHEN l_linenumber % 2 = 0 THEN 'standards' ELSE 'x' END || '.md' AS a, 'd' || (l_partkey % 3) || '/GO-CHEATSHEET.md' AS b, l_discount * 10 AS ratio FROM lineitem)
  SELECT a, b, ratio, CASE WHEN split_part(a, '/', 1) = split_part(b, '/', 1) AND contains(a, 'standards') THEN 'pair' WHEN ratio >= 0.95 THEN 'delete' WHEN ratio >= 0.85 THEN 'merge' WHEN ratio >= 0.70 THEN 'review' ELSE 'none' END AS advice FROM p""")  # fmt: skip
def cls10_duplicate_report(spark, sf_dir):
    return composites.duplicate_report(rows(spark, sf_dir, "lineitem", "concat('d', l_orderkey % 3, '/go-', IF(l_linenumber % 2 = 0, 'standards', 'x'), '.md') AS a", "concat('d', l_partkey % 3, '/GO-CHEATSHEET.md') AS b", "l_discount * 10 AS ratio"))


@query("""WITH e AS (SELECT o_custkey AS project, o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'START' ELSE 'END' END AS type, o_totalprice / 50 AS bytes FROM orders)
  SELECT c_custkey AS project, 'no index' AS notice FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT project, 'large event ' || id FROM e WHERE bytes > 4096
  UNION ALL SELECT project, 'open start' FROM (SELECT project, arg_max(type, id) AS t FROM e GROUP BY 1) WHERE t = 'START'""")  # fmt: skip
def hlth9_work_log(spark, sf_dir):
    events = rows(spark, sf_dir, "orders", "o_custkey AS project", "o_orderkey AS id", "IF(o_orderstatus = 'O', 'START', 'END') AS type", "o_totalprice / 50 AS bytes")
    files = rows(spark, sf_dir, "customer", "c_custkey AS project", "explode(IF(c_custkey % 4 = 0, array('LOG.md'), array('LOG.md', 'INDEX.md'))) AS name")
    return composites.work_log(events, files)


@query("SELECT 'nation' AS \"table\", count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def scan9_table_counts(spark, sf_dir):
    for name in ("nation", "region"):
        read(spark, sf_dir, name).createOrReplaceTempView(name)
    return readers.table_counts(spark, ["nation", "region"])


_RAW = f"""{NOTES}, b AS (SELECT rel, content, CASE WHEN NOT starts_with(content, '---' || chr(10)) THEN '' WHEN strpos(substr(content, 4), chr(10) || '---' || chr(10)) > 0 THEN substr(content, 5, greatest(0, strpos(substr(content, 4), chr(10) || '---' || chr(10)) - 2)) ELSE substr(content, 5) END AS block FROM notes)"""


@query(rf"""WITH {_RAW}, l AS (SELECT rel, unnest(string_split(block, chr(10))) AS line FROM b), k AS (SELECT rel, lower(split_part(line, ':', 1)) AS key FROM l WHERE regexp_matches(line, '^[A-Za-z_-]+\s*:'))
  SELECT b.rel, coalesce(string_agg(DISTINCT key, ',' ORDER BY key), '') AS keys, coalesce(max(trim(regexp_extract(block, 'tags: \[([^\]]*)\]', 1))), '') AS tags FROM b LEFT JOIN k USING (rel) GROUP BY b.rel""")  # fmt: skip
def parse1_search_fields(spark, sf_dir):
    found = N.fields_of_search(rows(spark, sf_dir, "documents", f"{REL} AS rel", f"{CONTENT} AS content"))
    return found.select("rel", F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("keys"), F.coalesce(F.array_join(F.element_at("fields", "tags"), ", "), F.lit("")).alias("tags"))


@query(rf"""WITH {NOTES}, l AS (SELECT rel, unnest(regexp_extract_all(content, '\[\[([^\]]+)\]\]', 1)) AS raw FROM notes), t AS (SELECT DISTINCT rel, rtrim(trim(split_part(split_part(raw, '|', 1), '#', 1)), '/') AS target FROM l)
  SELECT rel, target, regexp_replace(target, '^.*/', '') AS name FROM t WHERE target <> ''""")  # fmt: skip
def parse8_link_forms(spark, sf_dir):
    return N.link_forms(rows(spark, sf_dir, "documents", f"{REL} AS rel", f"{CONTENT} AS content"))


# --- orders, and what is staged ----------------------------------------------------------------------------------


@query("SELECT o_orderkey AS rel, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS age_days FROM orders ORDER BY age_days DESC, rel LIMIT 40")
def sort6_oldest_drafts(spark, sf_dir):
    return render.by_age(rows(spark, sf_dir, "orders", "o_orderkey AS rel", "CAST(datediff(DATE '2000-01-01', o_orderdate) AS BIGINT) AS age_days")).limit(40)


@query("SELECT l_orderkey || '/' || l_linenumber AS a, 'x' || l_partkey AS b, l_discount AS ratio FROM lineitem ORDER BY l_discount DESC, a, b LIMIT 30")
def sort4_most_similar(spark, sf_dir):
    return render.by_ratio(rows(spark, sf_dir, "lineitem", "concat(l_orderkey, '/', l_linenumber) AS a", "concat('x', l_partkey) AS b", "l_discount AS ratio")).limit(30)


@query("SELECT o_custkey AS rel_a, o_orderkey AS rel_b, o_orderpriority AS keyword, 1 AS idx_a, o_custkey % 7 AS idx_b, o_orderkey % 3 AS score FROM orders ORDER BY score DESC, rel_a, rel_b, keyword, idx_a, idx_b LIMIT 50")
def sort5_first_conflicts(spark, sf_dir):
    return render.by_conflict(rows(spark, sf_dir, "orders", "o_custkey AS rel_a", "o_orderkey AS rel_b", "o_orderpriority AS keyword", "1 AS idx_a", "o_custkey % 7 AS idx_b", "o_orderkey % 3 AS score")).limit(50)


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 40 AS dst FROM lineitem WHERE l_suppkey <> l_partkey % 40), n AS (SELECT s_suppkey AS node FROM supplier), o AS (SELECT src AS node, count(*) AS o FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS i FROM e GROUP BY 1)
  SELECT node, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM n LEFT JOIN i USING (node) LEFT JOIN o USING (node) WHERE coalesce(i, 0) >= 4 OR coalesce(o, 0) >= 6 ORDER BY coalesce(i, 0) + coalesce(o, 0) DESC, node LIMIT 20""")  # fmt: skip
def sort6_hubs(spark, sf_dir):
    edges = rows(spark, sf_dir, "lineitem", "l_suppkey AS src", "l_partkey % 40 AS dst").where("src <> dst").distinct()
    return render.hubs(graph.degrees(rows(spark, sf_dir, "supplier", "s_suppkey AS node"), edges)).limit(20)


@query("SELECT CASE WHEN contains(rel, '/') AND split_part(rel, '/', 1) IN ('01-Rules', '05-Tools') THEN split_part(rel, '/', 1) ELSE 'Root' END AS category, count(*) AS n FROM (SELECT " + _PATH + " AS rel FROM part) GROUP BY 1")
def cls2_categories(spark, sf_dir):
    return rows(spark, sf_dir, "part", f"{_PATH} AS rel").groupBy(canvas.category(F.col("rel")).alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT p_brand AS section, md5('| name | type | tier | command | status |' || chr(10) || '|---|---|---|---|---|' || chr(10) || string_agg('| ' || p_name || ' | ' || p_type || ' | t | ' || CASE WHEN p_size % 2 = 0 THEN '`run ' || p_size || '`' ELSE '—' END || ' | ok |', chr(10) ORDER BY p_partkey)) AS digest
  FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY 1""")  # fmt: skip
def sink5_matrix(spark, sf_dir):
    found = rows(spark, sf_dir, "part", "p_partkey AS position", "p_brand AS section", "p_name AS name", "p_type AS type", "'t' AS tier", "IF(p_size % 2 = 0, concat('run ', p_size), NULL) AS verification_command", "'ok' AS declared_status")
    return render.matrix(found, ["Brand#11", "Brand#12", "Brand#13", "none"]).select("section", F.md5("page").alias("digest"))


_CHANGES = "SELECT doc_id AS rel, CASE WHEN n_chars % 3 = 0 THEN NULL ELSE concat(lang, source) END AS content, CASE WHEN n_chars % 2 = 0 THEN {sha} ELSE 'old' END AS expected FROM documents WHERE n_chars % 5 < 2 UNION ALL SELECT -1, 'new', NULL UNION ALL SELECT -2, 'new', 'gone'"


@query(f"WITH c AS ({_CHANGES.format(sha='sha256(text)')}), f AS (SELECT doc_id AS rel, text FROM documents) SELECT coalesce(c.rel, f.rel) AS rel, md5(CASE WHEN c.rel IS NOT NULL THEN c.content ELSE f.text END) AS digest FROM f FULL JOIN c ON f.rel = c.rel WHERE c.rel IS NULL OR c.content IS NOT NULL")
def sink3_changed(spark, sf_dir):
    files, changes = _changes(spark, sf_dir)
    return sinks.changed(files, changes).select("rel", F.md5("content").alias("digest"))


@query(f"WITH c AS ({_CHANGES.format(sha='sha256(text)')}), f AS (SELECT doc_id AS rel, sha256(text) AS found FROM documents) SELECT c.rel, expected, found FROM c LEFT JOIN f USING (rel) WHERE expected IS DISTINCT FROM found")
def sink3_refused(spark, sf_dir):
    return sinks.stale_changes(*_changes(spark, sf_dir))


def _changes(spark, sf_dir):
    documents = read(spark, sf_dir, "documents")
    documents.createOrReplaceTempView("documents")
    return documents.select(F.col("doc_id").alias("rel"), F.col("text").alias("content")), spark.sql(_CHANGES.format(sha="sha2(text, 256)"))


@query(rf"""WITH {NOTES}, l AS (SELECT rel, content, len(regexp_extract_all(content, '\[\[([^\]]+)\]\]')) AS n FROM notes) SELECT split_part(rel, '/', 1) AS top, count(*) AS notes, sum(n)::BIGINT AS links FROM l WHERE contains(rel, '/') GROUP BY 1""")
def graph1_links_by_folder(spark, sf_dir):
    found = rows(spark, sf_dir, "documents", f"{REL} AS rel", f"{CONTENT} AS content").where(F.contains("rel", F.lit("/")))
    return N.links(found).groupBy(F.substring_index("rel", "/", 1).alias("top")).agg(F.count_distinct("rel").alias("notes"), F.count("*").alias("links"))
