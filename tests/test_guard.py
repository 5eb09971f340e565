"""Statements that only read, and those that do more, however they are dressed."""

import pytest

from corvane.sources.readers import guarded_sql

READING = [
    'SELECT a, sum(b) OVER w FROM VALUES (1,2) t(a,b) WINDOW w AS (PARTITION BY a)',
    'SELECT * FROM v t JOIN v u ON t.id=u.id UNION SELECT 1,2 ORDER BY 1 LIMIT 2 OFFSET 1',
    'SELECT id, count(*) FROM v GROUP BY id HAVING count(*)>0',
    'SELECT * FROM range(3) r, LATERAL (SELECT r.id+1 AS y)',
    'SELECT x FROM v LATERAL VIEW explode(array(1,2)) e AS x',
    'SELECT * FROM v TABLESAMPLE (10 PERCENT)',
    'SELECT * FROM (SELECT 1 AS a, 2 AS b) PIVOT (sum(b) FOR a IN (1))',
    'SELECT /*+ BROADCAST(v) */ DISTINCT * FROM v',
    'SELECT * FROM v EXCEPT SELECT 1',
    'DESCRIBE FUNCTION abs',
    "SHOW FUNCTIONS LIKE 'abs'",
    'SELECT 1',
    'WITH x AS (SELECT 1 AS a) SELECT * FROM x',
    "SELECT ';' AS s",
    'SELECT 1; ',
    'SELECT 1 -- ; DROP TABLE tt',
    "PRAGMA table_info('v');",
    'DESCRIBE v',
    'SHOW TABLES',
    'EXPLAIN SELECT * FROM v',
    'SELECT * FROM v WHERE id IN (SELECT max(id) FROM v)',
    'VALUES (1),(2)',
    'FROM v SELECT id',
    'SHOW COLUMNS IN v',
    'DESCRIBE QUERY SELECT 1',
    'TABLE v',
    'SELECT * FROM v |> WHERE id > 1',
]
OTHER = [
    'INSERT INTO tt VALUES (1)',
    'WITH x AS (SELECT 99L AS id) INSERT INTO tt SELECT * FROM x',
    'EXPLAIN INSERT INTO tt VALUES (1)',
    'SELECT 1; SELECT 2',
    'SELECT 1; DROP TABLE tt',
    'DROP TABLE tt',
    'CREATE TABLE z AS SELECT 1',
    'SET a=b',
    'CACHE TABLE v',
    'FROM v INSERT INTO tt SELECT id',
    'FROM v INSERT INTO tt SELECT id INSERT INTO tt SELECT id',
    'BEGIN SELECT 1; END',
    "SELECT TRANSFORM(id) USING 'cat' FROM v",
    "SELECT reflect('java.lang.System','currentTimeMillis')",
    "SELECT * FROM v WHERE id = (SELECT java_method('java.lang.Math','abs',1))",
    "WITH x AS (SELECT java_method('java.lang.Math','abs',1) AS a) SELECT * FROM x",
    'TRUNCATE TABLE tt',
    'MERGE INTO tt USING v ON tt.id=v.id WHEN MATCHED THEN DELETE',
    'EXPLAIN WITH x AS (SELECT 1) INSERT INTO tt SELECT * FROM x',
    '',
    'REFRESH TABLE v',
    'USE default',
    "EXECUTE IMMEDIATE 'DROP TABLE tt'",
    'DECLARE x INT',
    'DELETE FROM tt',
    'UPDATE tt SET id=1',
    'ANALYZE TABLE tt COMPUTE STATISTICS',
    "LOAD DATA INPATH 'x' INTO TABLE tt",
    "INSERT OVERWRITE DIRECTORY '/tmp/never' USING parquet SELECT 1",
    "ADD JAR '/tmp/never.jar'",
]


@pytest.fixture(scope="module")
def views(spark):
    spark.range(3).createOrReplaceTempView("v")
    return spark


@pytest.mark.parametrize("statement", READING)
def test_reads(views, statement):
    assert guarded_sql(views, statement).columns


@pytest.mark.parametrize("statement", OTHER)
def test_refuses(views, statement):
    with pytest.raises(ValueError):
        guarded_sql(views, statement)


def test_refused_write_leaves_the_table(views, tmp_path):
    views.range(3).write.parquet(str(tmp_path / "tt"))
    for text in ("WITH x AS (SELECT 99L AS id) INSERT INTO parquet.`{0}` SELECT * FROM x", "EXPLAIN INSERT INTO parquet.`{0}` VALUES (1)"):
        with pytest.raises(ValueError):
            guarded_sql(views, text.format(tmp_path / "tt"))
    assert guarded_sql(views, f"SELECT count(*) AS n FROM parquet.`{tmp_path / 'tt'}`").first().n == 3
