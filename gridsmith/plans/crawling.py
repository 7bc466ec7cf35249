"""Crawls over link graphs, and guarded SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.operators import crawl, explorer
from gridsmith.registry import query
from gridsmith.session import Tables

c = F.col


def _crawl_sql(budget: int, width: int, depth: int) -> str:
    """Round after round, as many as the budget could need; those beyond the end are empty."""
    ctes = [
        "e AS (SELECT 'p' || c_custkey AS url, 'p' || unnest([(c_custkey * 7 + 1) % 150, (c_custkey + 3) % 150]) AS too FROM customer)",
        "s AS (SELECT 'p' || c_custkey AS url, c_acctbal AS score FROM customer)",
        "f0 AS (SELECT 'p0' AS url, 0 AS depth, coalesce((SELECT score FROM s WHERE url = 'p0'), 0) AS score)",
        "v0 AS (SELECT url, depth, score, 0 AS visit FROM f0 WHERE false)",
    ]
    for i in range(budget):
        ctes += [
            f"b{i} AS MATERIALIZED (SELECT url, depth, score, {i} AS visit FROM (SELECT *, row_number() OVER (ORDER BY score DESC, depth, url) AS n FROM f{i}) WHERE n <= least({width}, {budget} - (SELECT count(*) FROM v{i})))",
            f"v{i + 1} AS MATERIALIZED (SELECT * FROM v{i} UNION ALL SELECT * FROM b{i})",
            f"f{i + 1} AS MATERIALIZED (SELECT url, min(depth) AS depth, max(score) AS score FROM (SELECT * FROM f{i} UNION ALL SELECT url, depth, coalesce(score, 0) FROM (SELECT too AS url, min(depth) + 1 AS depth FROM b{i} JOIN e USING (url) WHERE depth < {depth} GROUP BY 1) LEFT JOIN s USING (url)) WHERE url NOT IN (SELECT url FROM v{i + 1}) GROUP BY 1)",
        ]
    return f"WITH {', '.join(ctes)} SELECT url, depth, score, visit FROM v{budget}"


@query("x3_best_first_crawl", _crawl_sql(30, 10, 4))
def x3(t: Tables) -> DataFrame:
    """Customers as pages: order of a customer links to that of number 7 k + 1 and k + 3."""
    n = t.customer.select(c("c_custkey").alias("k"), c("c_acctbal").alias("s"))
    name = lambda k: F.concat(F.lit("p"), k)
    edges = n.select(name(c("k")).alias("url"), F.explode(F.array(name((c("k") * 7 + 1) % 150), name((c("k") + 3) % 150))).alias("to"))
    return crawl.crawl(t.spark.range(1).select(F.lit("p0").alias("url")), edges, n.select(name(c("k")).alias("url"), c("s").alias("score")), 4, 30, 10)


@query("s18_recursive_sitemaps", "WITH RECURSIVE r AS (SELECT CAST(1 AS BIGINT) AS k, 0 AS d UNION ALL SELECT o_custkey * 2, d + 1 FROM r JOIN orders ON o_orderkey = k WHERE d < 2) SELECT k, min(d) AS d FROM r GROUP BY 1")
def s18(t: Tables) -> DataFrame:
    index = t.orders.select(c("o_orderkey").alias("url"), (c("o_custkey") * 2).alias("to"))
    return crawl.sitemaps(t.spark.range(1).select(F.lit(1).cast("long").alias("url")), index).select(c("url").alias("k"), c("depth").alias("d"))


@query("x13_guarded_sql", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey = 5 GROUP BY 1")
def x13(t: Tables) -> DataFrame:
    return explorer.guarded(t, "SELECT o_orderpriority, count(*) AS n FROM g_orders GROUP BY 1", ["orders"], "o_custkey", 5)


@query("x13_preset_sources", "SELECT year(l_shipdate) AS year, l_returnflag AS kind, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 7 GROUP BY 1, 2")
def x13_sources(t: Tables) -> DataFrame:
    """Line items have no customer; they are narrowed through their orders."""
    return explorer.preset(t, "sources", 7)


@query("x13_preset_trend", "SELECT o_orderpriority AS level, year(o_orderdate) AS year, round(avg(o_totalprice), 2) AS price FROM orders WHERE o_custkey = 7 AND year(o_orderdate) >= 1994 GROUP BY 1, 2")
def x13_trend(t: Tables) -> DataFrame:
    return explorer.preset(t, "trend", 7)
