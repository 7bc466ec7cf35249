"""The SQL explorer lets queries through and nothing else."""

import pytest
from pyspark.sql import functions as F

from gridsmith.operators.explorer import PRESETS, VIA, RefusedError, answer, guarded, preset
from gridsmith.session import Tables

SF = "/root/testdata/sf0.001"
WIDE = ", ".join(f"o_orderkey + {i} AS c{i}" for i in range(30))

REFUSED = [
    # functions that call into the JVM, wherever they stand
    "SELECT reflect('java.lang.System', 'getProperty', 'java.version') FROM g_orders",
    "SELECT try_reflect('java.lang.System', 'getProperty', 'java.version') FROM g_orders",
    f"SELECT {WIDE}, java_method('java.lang.System', 'getProperty', 'java.version') FROM g_orders",
    f"SELECT {WIDE}, upper(coalesce(try_reflect('java.lang.System', 'getProperty', 'java.version'), 'x')) FROM g_orders",
    "SELECT nvl(o_comment, reflect('java.lang.System', 'getenv', 'PATH')) FROM (SELECT 'a' AS o_comment FROM g_orders)",
    "SELECT o_orderkey FROM g_orders WHERE java_method('java.lang.System', 'currentTimeMillis') > '1'",
    "SELECT o_orderkey FROM g_orders ORDER BY reflect('java.lang.System', 'nanoTime')",
    "SELECT o_orderkey FROM g_orders GROUP BY 1 HAVING max(reflect('java.lang.System', 'nanoTime')) > '1'",
    "SELECT sum(o_totalprice) OVER (PARTITION BY reflect('java.lang.System', 'nanoTime')) FROM g_orders",
    "SELECT (SELECT max(reflect('java.lang.System', 'nanoTime')) FROM g_orders)",
    "SELECT * FROM g_orders WHERE o_orderkey IN (SELECT length(reflect('java.lang.System', 'nanoTime')))",
    "SELECT transform(array(1), x -> reflect('java.lang.System', 'nanoTime'))",
    "SELECT * FROM VALUES (reflect('java.lang.System', 'nanoTime')) AS t(x)",
    "WITH a AS (SELECT java_method('java.lang.System', 'nanoTime') AS x FROM g_orders) SELECT * FROM a",
    # what the session or the machine tells
    "SELECT input_file_name() FROM g_orders",
    "SELECT current_user(), version(), current_database()",
    "SELECT uuid(), rand()",
    "SELECT _metadata.file_path FROM g_orders",
    # table functions and other relations
    "SELECT * FROM range(10)",
    "SELECT * FROM sql_keywords()",
    "SELECT * FROM read_files('/etc')",
    "SELECT * FROM g_orders, LATERAL explode(array(reflect('java.lang.System', 'nanoTime')))",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`",
    "SELECT * FROM text.`/etc/passwd`",
    "SELECT * FROM other",
    "SELECT * FROM default.g_orders",
    "SELECT * FROM g_orders JOIN g_customer ON true",
    "SELECT * FROM (SELECT * FROM text.`/etc/passwd`)",
    "SELECT * FROM g_orders WHERE EXISTS (SELECT * FROM text.`/etc/passwd`)",
    "WITH a AS (SELECT * FROM text.`/etc/passwd`) SELECT 1",
    "WITH a AS (WITH b AS (SELECT 1) SELECT * FROM b) SELECT * FROM b",
    "SELECT transform(*) USING 'cat' FROM g_orders",
    "SELECT TRANSFORM(o_orderkey) USING 'cat' AS (x) FROM g_orders",
    "FROM g_orders SELECT TRANSFORM(o_orderkey) USING 'cat' AS (x)",
    # commands
    "DROP TABLE g_orders",
    "DROP VIEW g_orders",
    "CREATE TABLE x AS SELECT * FROM g_orders",
    "CREATE TEMPORARY VIEW x AS SELECT * FROM g_orders",
    "INSERT INTO g_orders SELECT * FROM g_orders",
    "INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT * FROM g_orders",
    "FROM g_orders INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT *",
    "UPDATE g_orders SET o_orderkey = 1",
    "DELETE FROM g_orders",
    "TRUNCATE TABLE g_orders",
    "ALTER VIEW g_orders RENAME TO x",
    "SET spark.sql.shuffle.partitions = 1",
    "SHOW TABLES",
    "DESCRIBE g_orders",
    "EXPLAIN SELECT * FROM g_orders",
    "CACHE TABLE g_orders",
    "ADD JAR '/tmp/x.jar'",
    "BEGIN SELECT 1; END",
    "SELECT 1; SELECT 2",
    "EXECUTE IMMEDIATE 'DROP VIEW g_orders'",
    "nonsense",
    "",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    with pytest.raises(RefusedError) as e:
        guarded(Tables(spark, SF), sql, ["orders"])
    assert e.value.code == "INVALID_QUERY"


ALLOWED = [
    "SELECT * FROM g_orders",
    "select o_orderstatus s, count(*), sum(o_totalprice) FILTER (WHERE o_orderpriority LIKE '1%') FROM G_ORDERS o WHERE o_orderkey BETWEEN 1 AND 900 AND NOT o_orderstatus IN ('X') GROUP BY ROLLUP (1) HAVING count(*) > 0 ORDER BY 2 DESC NULLS LAST",
    "WITH a AS (SELECT o_custkey AS k, max(o_orderdate) AS d FROM g_orders GROUP BY 1), b AS (SELECT * FROM a WHERE k > 3) SELECT year(d), nvl(k, 0), row_number() OVER (PARTITION BY year(d) ORDER BY k) FROM b",
    "SELECT a.o_orderkey FROM g_orders a LEFT JOIN g_lineitem b ON a.o_orderkey = b.l_orderkey WHERE EXISTS (SELECT 1 FROM g_lineitem c WHERE c.l_orderkey = a.o_orderkey)",
    "SELECT o_orderkey FROM g_orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM g_orders) UNION SELECT l_orderkey FROM g_lineitem INTERSECT SELECT 1",
    "SELECT CASE WHEN o_totalprice > 1e5 THEN 'much' ELSE lower(trim(o_orderpriority)) END || '!' AS c, CAST(o_totalprice AS INT) / 2, o_orderdate + INTERVAL 1 DAY, if(o_orderkey % 2 = 0, -1, 1) FROM g_orders LIMIT 3",
    "SELECT k, x FROM (VALUES (1, 'a'), (2, NULL)) t(k, x) WHERE x IS NOT NULL",
    "SELECT o_orderstatus, e FROM g_orders LATERAL VIEW explode(split(o_orderpriority, '-')) t AS e",
    "SELECT * FROM (SELECT o_orderstatus, year(o_orderdate) y FROM g_orders) PIVOT (count(*) FOR y IN (1995, 1996))",
    "-- a remark\nSELECT 1",
]


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, sql):
    got = guarded(Tables(spark, SF), sql, ["orders", "lineitem"])
    spark_says = Tables(spark.newSession(), SF)
    for name in ("orders", "lineitem"):
        getattr(spark_says, name).createOrReplaceTempView(f"g_{name}")
    assert sorted(map(str, got.collect())) == sorted(map(str, spark_says.spark.sql(sql).limit(1000).collect())) or got.count() == 1000


def test_views_are_narrowed(spark):
    t = Tables(spark, SF)
    mine = {r.o_orderkey for r in t.orders.filter("o_custkey = 7").collect()}
    assert mine
    got = guarded(t, "SELECT DISTINCT l_orderkey AS k FROM g_lineitem UNION SELECT o_orderkey FROM g_orders", ["orders", "lineitem"], "o_custkey", 7, via=VIA)
    assert {r.k for r in got.collect()} == mine
    # only the child is asked for: it is narrowed all the same, and its parent isn't shown
    assert {r.k for r in guarded(t, "SELECT l_orderkey AS k FROM g_lineitem", ["lineitem"], "o_custkey", 7, via=VIA).collect()} == mine
    with pytest.raises(RefusedError):
        guarded(t, "SELECT * FROM g_orders", ["lineitem"], "o_custkey", 7, via=VIA)
    with pytest.raises(ValueError, match="narrowed"):
        guarded(t, "SELECT * FROM g_nation", ["nation"], "o_custkey", 7)
    # the caller's own views can't be seen
    t.nation.createOrReplaceTempView("nations")
    with pytest.raises(RefusedError):
        guarded(t, "SELECT * FROM nations", ["orders"])


@pytest.mark.parametrize("name", list(PRESETS))
def test_presets(spark, name):
    got = preset(Tables(spark, SF), name, 7)
    assert got.count() <= 1000 and got.columns


def test_answer(spark):
    t = Tables(spark, SF)
    said = answer(guarded(t, "SELECT o_orderkey AS k FROM g_orders ORDER BY 1", ["orders"]), limit=5)
    assert said["columns"] == ["k"] and said["row_count"] == 5 and said["truncated"] and len(said["rows"]) == 5
    whole = answer(guarded(t, "SELECT count(*) FROM g_orders", ["orders"]))
    assert not whole["truncated"] and whole["rows"] == [[t.orders.count()]]
    slow = t.orders.crossJoin(t.orders.select(F.col("o_custkey").alias("x"))).crossJoin(t.orders.select(F.col("o_custkey").alias("y"))).filter("x * y % 1000003 = 999999").select("x")
    with pytest.raises(RefusedError, match="stopped"):
        answer(slow, seconds=1.0)
