"""Filters, joins, aggregates, sets and projections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.operators import discovery
from gridsmith.operators.joins import band, first_match
from gridsmith.registry import query
from gridsmith.session import Tables


@query("f1_membership", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O','P') AND o_orderpriority = '1-URGENT'")
def f1(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("f2_year_in_list", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1995, 1996, 1997) GROUP BY 1")
def f2(t: Tables) -> DataFrame:
    return t.orders.withColumn("y", F.year("o_orderdate")).filter(F.col("y").isin(1995, 1996, 1997)).groupBy("y").agg(F.count("*").alias("n"))


@query("f5_exists_status", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def f5(t: Tables) -> DataFrame:
    of = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(of("O"), "c_custkey", "left_semi").join(of("P"), "c_custkey", "left_anti")


@query("f10_default_year_filter", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE year(o_orderdate) = (SELECT coalesce(max(CASE WHEN year(o_orderdate) = 2024 THEN 2024 END), max(year(o_orderdate))) FROM orders) AND o_orderpriority NOT IN ('1-URGENT') GROUP BY 1")
def f10(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    default = t.orders.agg(F.coalesce(F.max(F.when(y == 2024, 2024)), F.max(y)).alias("_y"))
    return t.orders.withColumn("_yy", y).join(F.broadcast(default), F.col("_yy") == F.col("_y")).filter("o_orderpriority != '1-URGENT'").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("f21_stale_jobs", "SELECT event_id FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 1 HOUR")
def f21(t: Tables) -> DataFrame:
    return t.events.filter((F.col("event_type") == "view") & (F.col("ts") < F.expr("timestamp'2024-01-10 12:00:00' - interval 1 hour"))).select("event_id")


@query("f22_cache_ttl", "SELECT o_orderkey FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-01') < 120")
def f22(t: Tables) -> DataFrame:
    return t.orders.filter(F.datediff(F.lit("1998-08-01").cast("date"), F.col("o_orderdate")) < 120).select("o_orderkey")


@query("f15_mode_predicate", "SELECT o_orderkey, CASE 'no_verified' WHEN 'flagged_only' THEN o_orderstatus = 'P' WHEN 'no_verified' THEN o_orderstatus <> 'F' ELSE true END AS allowed FROM orders")
def f15(t: Tables) -> DataFrame:
    mode = F.lit("no_verified")
    return t.orders.select("o_orderkey", F.when(mode == "flagged_only", F.col("o_orderstatus") == "P").when(mode == "no_verified", F.col("o_orderstatus") != "F").otherwise(F.lit(True)).alias("allowed"))


@query("f26_duplicate_job_guard", "SELECT e.event_id FROM events e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'purchase' AND r.ts >= TIMESTAMP '2024-01-29 23:00:00')")
def f26(t: Tables) -> DataFrame:
    active = t.events.filter("event_type = 'purchase' and ts >= timestamp'2024-01-29 23:00:00'").select("user_id")
    return t.events.filter("event_type = 'click'").join(active, "user_id", "left_anti").select("event_id")


@query("f16_prior_url_penalty", "SELECT p.page_id, 50 - CASE WHEN d.source = 'src1' THEN 30 ELSE 0 END AS score FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id WHERE coalesce(d.source, '') <> 'src2'")
def f16(t: Tables) -> DataFrame:
    known = t.documents.select(F.col("doc_id").alias("page_id"), "source")
    return t.pages.select("page_id").join(known, "page_id", "left").filter(F.coalesce("source", F.lit("")) != "src2").select("page_id", (F.lit(50) - F.when(F.col("source") == "src1", 30).otherwise(0)).alias("score"))


@query("f17_candidate_drop", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_discount <= 0 AND l_returnflag = 'N')")
def f17(t: Tables) -> DataFrame:
    return t.lineitem.filter(~((F.col("l_discount") <= 0) & (F.col("l_returnflag") == "N"))).select("l_orderkey", "l_linenumber")


@query("j2_first_matching_element", "WITH a AS (SELECT o_orderkey, o_custkey, o_custkey + 1 AS second FROM orders), c AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0) SELECT o_orderkey, coalesce(x.c_nationkey, y.c_nationkey) AS c_nationkey FROM a LEFT JOIN c x ON x.c_custkey = o_custkey LEFT JOIN c y ON y.c_custkey = second WHERE x.c_custkey IS NOT NULL OR y.c_custkey IS NOT NULL")
def j2(t: Tables) -> DataFrame:
    listed = t.orders.select("o_orderkey", F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("ids"))
    return first_match(listed, "ids", t.customer.filter("c_acctbal > 0"), "c_custkey", "c_nationkey", "o_orderkey")


@query("j3_inner_grouping", "SELECT n_regionkey, count(*) AS n, max(s_acctbal) AS top FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def j3(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("n"), F.max("s_acctbal").alias("top"))


@query("j5_flagged_facts", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def j5(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("j6_missing_enrichment", "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def j6(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("j7_semi_anti", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def j7(t: Tables) -> DataFrame:
    of = lambda f: t.lineitem.filter(f).select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey").join(of("l_returnflag = 'R'"), "p_partkey", "left_semi").join(of("l_quantity > 49"), "p_partkey", "left_anti")


@query("j8_batched_lookup", "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j8(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("j9_children", "SELECT n_nationkey, count(s_suppkey) AS n_children, min(s_suppkey) AS first_child, max(s_suppkey) AS last_child FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def j9(t: Tables) -> DataFrame:
    kids = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list("s_suppkey")).alias("kids"))
    out = t.nation.select("n_nationkey").join(kids, "n_nationkey", "left").withColumn("kids", F.coalesce("kids", F.array().cast("array<bigint>")))
    return out.select("n_nationkey", F.size("kids").cast("long").alias("n_children"), F.try_element_at("kids", F.lit(1)).alias("first_child"), F.try_element_at("kids", F.lit(-1)).alias("last_child"))


@query("j10_band_join", "WITH a AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, s_nationkey / 2.0 AS y FROM supplier), b AS (SELECT c_custkey AS cid, c_acctbal / 100 AS cx, c_nationkey / 2.0 AS cy FROM customer), h AS (SELECT id, cid, row_number() OVER (PARTITION BY id ORDER BY cid) AS n FROM a JOIN b ON abs(x - cx) < 0.75 AND abs(y - cy) < 0.75) SELECT id, cid FROM h WHERE n = 1")
def j10(t: Tables) -> DataFrame:
    a = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_nationkey") / 2).alias("y"))
    b = t.customer.select(F.col("c_custkey").alias("cid"), (F.col("c_acctbal") / 100).alias("cx"), (F.col("c_nationkey") / 2).alias("cy"))
    # the least of each id by hashes: pairs are not sorted to find the first, and a task holds a row an id
    return band(a, b, "x", "y", "cx", "cy", 0.75).groupBy("id").agg(F.min("cid").alias("cid"))


@query("j16_composite_lookup", "WITH s AS (SELECT l_returnflag AS f, l_linestatus AS st, l_linenumber AS ln, max(l_tax) AS top FROM lineitem GROUP BY 1, 2, 3) SELECT l_orderkey, l_linenumber, top FROM lineitem LEFT JOIN s ON f = l_returnflag AND st = l_linestatus AND ln = l_linenumber WHERE l_quantity = 50")
def j16(t: Tables) -> DataFrame:
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    s = t.lineitem.groupBy(*keys).agg(F.max("l_tax").alias("top"))
    return t.lineitem.filter("l_quantity = 50").join(s, keys, "left").select("l_orderkey", "l_linenumber", "top")


@query("j17_parent_child", "SELECT a.conv_id, a.turn, b.turn AS parent_turn FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def j17(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", "turn")
    p = c.select("conv_id", F.col("turn").alias("parent_turn"), (F.col("turn") + 1).alias("turn"))
    return c.join(p, ["conv_id", "turn"], "left")


@query("j18_enriched_then_stats_only", "SELECT c_custkey AS k, o AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT o_custkey, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderpriority LIKE '1%' GROUP BY 1")
def j18(t: Tables) -> DataFrame:
    base = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    count = lambda d: d.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    rest = count(t.orders.filter("o_orderpriority like '1%'")).join(base, "k", "left_anti")
    return base.join(count(t.orders), "k", "left").unionByName(rest)


@query("j19_static_catalog", "SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'ns' WHEN 'BUILDING' THEN 'ms' WHEN 'MACHINERY' THEN 'hs' ELSE 'other' END AS bucket FROM customer")
def j19(t: Tables) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in {"HOUSEHOLD": "ns", "BUILDING": "ms", "MACHINERY": "hs"}.items() for x in kv])
    return t.customer.select("c_custkey", F.coalesce(F.try_element_at(m, F.col("c_mktsegment")), F.lit("other")).alias("bucket"))


@query("j20_level_year_grid", "WITH l AS (SELECT DISTINCT o_orderpriority AS l FROM orders), y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders) SELECT l, y, count(o_orderkey) AS n FROM l CROSS JOIN y LEFT JOIN orders ON o_orderpriority = l AND year(o_orderdate) = y AND o_orderstatus = 'P' GROUP BY 1, 2")
def j20(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderpriority").alias("l"), F.year("o_orderdate").alias("y"), "o_orderstatus")
    # the levels and years of a chart: a grid of distinct labels, not of rows
    grid = o.groupBy().agg(F.collect_set("l").alias("ls"), F.collect_set("y").alias("ys")).select(F.explode("ls").alias("l"), "ys").select("l", F.explode("ys").alias("y"))
    n = o.filter("o_orderstatus = 'P'").groupBy("l", "y").agg(F.count("*").alias("n"))
    return grid.join(n, ["l", "y"], "left").select("l", "y", F.coalesce("n", F.lit(0)).alias("n"))


@query("a2_networks", "SELECT s_nationkey AS k, count(*) FILTER (WHERE s_acctbal > 5000) AS n, coalesce(bool_or(s_acctbal > 9000) FILTER (WHERE s_acctbal > 5000), false) AS any_big FROM supplier GROUP BY 1")
def a2(t: Tables) -> DataFrame:
    on = F.col("s_acctbal") > 5000
    return t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count_if(on).alias("n"), F.coalesce(F.bool_or(F.when(on, F.col("s_acctbal") > 9000)), F.lit(False)).alias("any_big"))


@query("a4_unit_counts", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS n_a, count(*) FILTER (WHERE l_returnflag = 'N') AS n_n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_r FROM lineitem GROUP BY 1")
def a4(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(*(F.count_if(F.col("l_returnflag") == f).alias(f"n_{f.lower()}") for f in "ANR"))


@query("a7_group_counts", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def a7(t: Tables) -> DataFrame:
    out = t.orders.groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return out.select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("a8_scalar_counts", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT count(DISTINCT user_id) FROM events) AS users")
def a8(t: Tables) -> DataFrame:
    e = t.events.agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users"))
    return t.orders.agg(F.count("*").alias("orders")).join(t.customer.agg(F.count("*").alias("customers"))).join(e)


@query("a9_dashboard", "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS verified, count(*) FILTER (WHERE o_orderstatus = 'P') AS flagged, count(DISTINCT o_custkey) AS operators FROM orders")
def a9(t: Tables) -> DataFrame:
    return t.orders.agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("verified"), F.count_if(F.col("o_orderstatus") == "P").alias("flagged"), F.countDistinct("o_custkey").alias("operators"))


@query("a10_enrichment_stats", "SELECT count(*) AS total, count(o_orderkey) AS with_raw, (SELECT count(*) FROM customer) - count(o_orderkey) AS missing_raw, count(DISTINCT o_custkey) AS with_distinct FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def a10(t: Tables) -> DataFrame:
    joined = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").agg(F.count("*").alias("total"), F.count("o_orderkey").alias("with_raw"), F.countDistinct("o_custkey").alias("with_distinct"))
    return joined.join(t.customer.agg(F.count("*").alias("n"))).select("total", "with_raw", (F.col("n") - F.col("with_raw")).alias("missing_raw"), "with_distinct")


@query("a11_histogram", "WITH b AS (SELECT CAST(least(floor(greatest(s_acctbal, 0) / 1000), 9) AS INTEGER) AS bucket FROM supplier), r AS (SELECT CAST(i AS INTEGER) AS bucket FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) AS x(i)) SELECT r.bucket AS bucket, count(b.bucket) AS n FROM r LEFT JOIN b ON b.bucket = r.bucket GROUP BY 1")
def a11(t: Tables) -> DataFrame:
    b = t.supplier.select(F.least(F.floor(F.greatest("s_acctbal", F.lit(0.0)) / 1000), F.lit(9)).cast("int").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return t.spark.range(10).select(F.col("id").cast("int").alias("bucket")).join(b, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query("a12_percentiles", "WITH r AS (SELECT c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS n, count(*) OVER (PARTITION BY c_nationkey) AS m FROM customer) SELECT c_nationkey, max(CASE WHEN n = floor((m - 1) * 0.5) + 1 THEN c_acctbal END) AS p50, max(CASE WHEN n = floor((m - 1) * 0.9) + 1 THEN c_acctbal END) AS p90 FROM r GROUP BY 1")
def a12(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey")
    r = t.customer.select("c_nationkey", "c_acctbal", F.row_number().over(w.orderBy("c_acctbal")).alias("n"), F.count("*").over(w).alias("m"))
    at = lambda q: F.max(F.when(F.col("n") == F.floor((F.col("m") - 1) * q) + 1, F.col("c_acctbal")))
    return r.groupBy("c_nationkey").agg(at(0.5).alias("p50"), at(0.9).alias("p90"))


@query("a13_distinct_sets", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_levels, count(DISTINCT year(o_orderdate)) AS n_years FROM orders GROUP BY 1")
def a13(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.size(F.collect_set("o_orderpriority")).cast("long").alias("n_levels"), F.size(F.collect_set(F.year("o_orderdate"))).cast("long").alias("n_years"))


@query("a14_running_cutoff", "WITH r AS (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM documents) SELECT source, doc_id, CAST(upto AS BIGINT) AS upto FROM r WHERE upto <= 30000")
def a14(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.documents.select("source", "doc_id", F.sum("n_chars").over(w).alias("upto")).filter("upto <= 30000")


@query("a15_status_rollup", "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'verified' WHEN bool_or(o_orderstatus = 'P') THEN 'flagged' ELSE 'unverified' END AS status, count(*) AS n FROM orders GROUP BY 1")
def a15(t: Tables) -> DataFrame:
    has = lambda s: F.bool_or(F.col("o_orderstatus") == s)
    return t.orders.groupBy("o_custkey").agg(F.when(has("F"), "verified").when(has("P"), "flagged").otherwise("unverified").alias("status"), F.count("*").alias("n"))


@query("a15_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def a15_sets(t: Tables) -> DataFrame:
    return t.orders.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("a16_bulk_preview", "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus <> 'F') AS no_verified, count(*) FILTER (WHERE o_orderstatus = 'P') AS flagged_only, count(*) FILTER (WHERE o_totalprice IS NULL) AS no_data FROM orders")
def a16(t: Tables) -> DataFrame:
    return t.orders.agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") != "F").alias("no_verified"), F.count_if(F.col("o_orderstatus") == "P").alias("flagged_only"), F.count_if(F.col("o_totalprice").isNull()).alias("no_data"))


@query("a17_bulk_progress", "SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) FILTER (WHERE event_type = 'error') AS failed, round(CASE WHEN count(*) > 0 THEN 100.0 * count(*) FILTER (WHERE event_type IN ('purchase','error')) / count(*) ELSE 0 END, 1) AS percent FROM events")
def a17(t: Tables) -> DataFrame:
    e = F.col("event_type")
    n = F.count("*")
    return t.events.agg(n.alias("total"), F.count_if(e == "purchase").alias("done"), F.count_if(e == "error").alias("failed"), F.round(F.when(n > 0, 100.0 * F.count_if(e.isin("purchase", "error")) / n).otherwise(0.0), 1).alias("percent"))


@query("a21_having_two", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) >= 2")
def a21(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus != 'P'").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 2")


@query("a23_success_rate", "SELECT user_id, coalesce(CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) / nullif(count(*) FILTER (WHERE event_type IN ('purchase','error')), 0), 0) AS rate FROM events GROUP BY 1")
def a23(t: Tables) -> DataFrame:
    e = F.col("event_type")
    return t.events.groupBy("user_id").agg(F.coalesce(F.try_divide(F.count_if(e == "purchase").cast("double"), F.count_if(e.isin("purchase", "error"))), F.lit(0.0)).alias("rate"))


@query("a24_consecutive_failures", "WITH r AS (SELECT user_id, event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id ELSE -1 END) OVER (PARTITION BY user_id) AS last_ok FROM events) SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND event_id > last_ok) AS failures, count(*) FILTER (WHERE event_type = 'purchase') AS successes FROM r GROUP BY 1")
def a24(t: Tables) -> DataFrame:
    e = t.events
    ok = e.groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))), F.lit(-1)).alias("last_ok"))
    return e.join(ok, "user_id").groupBy("user_id").agg(F.count_if((F.col("event_type") == "error") & (F.col("event_id") > F.col("last_ok"))).alias("failures"), F.count_if(F.col("event_type") == "purchase").alias("successes"))


@query("a27_page_count", "WITH c AS (SELECT count(*) AS total FROM customer) SELECT total, CAST(ceil(total / 50.0) AS BIGINT) AS pages, CAST(greatest(1, least(9999, ceil(total / 50.0))) AS BIGINT) AS page FROM c")
def a27(t: Tables) -> DataFrame:
    pages = F.ceil(F.col("total") / 50).cast("long")
    return t.customer.agg(F.count("*").alias("total")).select("total", pages.alias("pages"), F.greatest(F.lit(1), F.least(F.lit(9999), pages)).cast("long").alias("page"))


@query("a28_diagnostics", "SELECT count(*) FILTER (WHERE nullif(l_discount, 0) IS NULL) AS missing, count(*) FILTER (WHERE l_tax = 0) AS fallback FROM lineitem")
def a28(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count_if(F.nullif(F.col("l_discount"), F.lit(0.0)).isNull()).alias("missing"), F.count_if(F.col("l_tax") == 0).alias("fallback"))


@query("a29_rows_by_year", "SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n, min(o_orderpriority) AS first_level FROM orders GROUP BY 1, 2")
def a29(t: Tables) -> DataFrame:
    rows = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sort_array(F.collect_list(F.struct("o_orderpriority", "o_orderkey"))).alias("rows"))
    return rows.select("o_custkey", "y", F.size("rows").cast("long").alias("n"), F.col("rows")[0]["o_orderpriority"].alias("first_level"))


@query("a30_config_status", "SELECT count(*) AS total, count(*) FILTER (WHERE s_acctbal > 0) AS enabled, coalesce(min(s_suppkey) FILTER (WHERE s_acctbal > 5000), min(s_suppkey) FILTER (WHERE s_acctbal > 0)) AS active FROM supplier")
def a30(t: Tables) -> DataFrame:
    on, well = F.col("s_acctbal") > 0, F.col("s_acctbal") > 5000
    return t.supplier.agg(F.count("*").alias("total"), F.count_if(on).alias("enabled"), F.coalesce(F.min(F.when(well, F.col("s_suppkey"))), F.min(F.when(on, F.col("s_suppkey")))).alias("active"))


@query("u1_union_all", "SELECT 'netz' AS kind, o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'hlzf', l_orderkey FROM lineitem WHERE l_quantity = 1")
def u1(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'P'").select(F.lit("netz").alias("kind"), F.col("o_orderkey").alias("id")).unionByName(t.lineitem.filter("l_quantity = 1").select(F.lit("hlzf").alias("kind"), F.col("l_orderkey").alias("id")))


@query("u2_full_outer_keys", "WITH a AS (SELECT c_nationkey AS k, min(c_acctbal) AS under FROM customer WHERE c_acctbal < -900 GROUP BY 1), b AS (SELECT s_nationkey AS k, max(s_acctbal) AS over FROM supplier WHERE s_acctbal > 8000 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, under, over FROM a FULL JOIN b ON a.k = b.k")
def u2(t: Tables) -> DataFrame:
    a = t.customer.filter("c_acctbal < -900").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_acctbal").alias("under"))
    b = t.supplier.filter("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("over"))
    return a.join(b, "k", "full")


@query("u3_set_difference", "SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def u3(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).distinct().join(t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), "k", "left_anti")


@query("u4_ordered_distinct", "SELECT text, min(doc_id) AS first_id FROM documents GROUP BY 1")
def u4(t: Tables) -> DataFrame:
    return t.documents.groupBy("text").agg(F.min("doc_id").alias("first_id"))


@query("u5_union_of_lists", "SELECT count(DISTINCT w) AS n FROM (SELECT p_brand AS w FROM part WHERE p_size < 10 UNION ALL SELECT p_brand FROM part WHERE p_size > 40)")
def u5(t: Tables) -> DataFrame:
    s = t.part.agg(F.collect_set(F.when(F.col("p_size") < 10, F.col("p_brand"))).alias("a"), F.collect_set(F.when(F.col("p_size") > 40, F.col("p_brand"))).alias("b"))
    return s.select(F.size(F.array_union("a", "b")).cast("long").alias("n"))


@query("p2_golden_record", "SELECT c_custkey, coalesce(nullif(o.p, '1-URGENT'), c_mktsegment) AS best FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS p FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def p2(t: Tables) -> DataFrame:
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("p"))
    return t.customer.join(o, "c_custkey", "left").select("c_custkey", F.coalesce(F.nullif(F.col("p"), F.lit("1-URGENT")), F.col("c_mktsegment")).alias("best"))


@query("p3_enrichment_sources", "SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal > 0 THEN 'mastr' END, CASE WHEN c_nationkey < 10 THEN 'vnb' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'bdew' END) AS sources FROM customer")
def p3(t: Tables) -> DataFrame:
    a = F.array_compact(F.array(F.when(F.col("c_acctbal") > 0, "mastr"), F.when(F.col("c_nationkey") < 10, "vnb"), F.when(F.col("c_mktsegment") == "BUILDING", "bdew")))
    return t.customer.select("c_custkey", F.array_join(a, ",").alias("sources"))


@query("p4_struct_builder", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN l_tax + l_discount END AS other, CASE WHEN l_tax > 0 THEN l_quantity END AS solar FROM lineitem")
def p4(t: Tables) -> DataFrame:
    s = F.when(F.col("l_tax") > 0, F.struct((F.col("l_tax") + F.col("l_discount")).alias("other"), F.col("l_quantity").alias("solar")))
    return t.lineitem.withColumn("s", s).select("l_orderkey", "l_linenumber", "s.other", "s.solar")


@query("p5_bucket_rollup", "SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment IN ('HOUSEHOLD','FURNITURE')) AS ns, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS ms, count(*) FILTER (WHERE c_mktsegment IN ('MACHINERY','AUTOMOBILE')) AS hs FROM customer GROUP BY 1")
def p5(t: Tables) -> DataFrame:
    m = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("m"))
    get = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0))
    return m.select("c_nationkey", (get("HOUSEHOLD") + get("FURNITURE")).alias("ns"), get("BUILDING").alias("ms"), (get("MACHINERY") + get("AUTOMOBILE")).alias("hs"))


@query("p6_address", "SELECT s_suppkey, concat_ws(', ', s_name, nullif(n_name, 'FRANCE'), CAST(s_nationkey AS VARCHAR)) AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def p6(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat_ws(", ", "s_name", F.nullif(F.col("n_name"), F.lit("FRANCE")), F.col("s_nationkey").cast("string")).alias("address"))


@query("p7_live_status", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND event_id % 16 = 0) THEN 'running' WHEN bool_or(event_type = 'click' AND event_id % 16 = 1) THEN 'pending' WHEN bool_or(event_type = 'error' AND event_id % 16 = 2) THEN 'protected' WHEN count(*) > 60 THEN 'crawled' ELSE 'uncrawled' END AS status FROM events GROUP BY 1")
def p7(t: Tables) -> DataFrame:
    """A job of a sixteenth of the events is still open."""
    has = lambda k, n: F.bool_or((F.col("event_type") == k) & (F.col("event_id") % 16 == n))
    return t.events.groupBy("user_id").agg(F.when(has("purchase", 0), "running").when(has("click", 1), "pending").when(has("error", 2), "protected").when(F.count("*") > 60, "crawled").otherwise("uncrawled").alias("status"))


@query("p8_list_score", "SELECT o_custkey, CAST(least(round_even(count(*) * 100.0 / 50, 0), 100) AS INTEGER) AS score FROM orders GROUP BY 1")
def p8(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.least(F.bround(F.count("*") * 100.0 / 50), F.lit(100)).cast("int").alias("score"))


@query("p9_creation_fields", "SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), c_mktsegment) AS field FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def p9(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", F.coalesce(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), F.col("c_mktsegment")).alias("field"))


@query("p10_patch_fields", "SELECT c_custkey, coalesce(x.b, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, CAST(min(o_totalprice) AS DOUBLE) AS b FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) x ON o_custkey = c_custkey")
def p10(t: Tables) -> DataFrame:
    patch = t.orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_totalprice").alias("b"))
    return t.customer.join(patch, "c_custkey", "left").select("c_custkey", F.coalesce("b", "c_acctbal").alias("c_acctbal"))


@query("p11_cp_normalization", "SELECT c_nationkey, CASE WHEN count(*) FILTER (WHERE c_acctbal > 9900) > 0 THEN count(*) FILTER (WHERE c_acctbal > 9900) ELSE nullif(count(*) FILTER (WHERE c_acctbal > 9000), 0) END AS ns FROM customer GROUP BY 1")
def p11(t: Tables) -> DataFrame:
    new, old = F.count_if(F.col("c_acctbal") > 9900), F.count_if(F.col("c_acctbal") > 9000)
    return t.customer.groupBy("c_nationkey").agg(new.alias("new"), old.alias("old")).select("c_nationkey", F.when(F.col("new") > 0, F.col("new")).otherwise(F.nullif(F.col("old"), F.lit(0))).alias("ns"))


@query("p1_transform_row", "SELECT c_custkey AS id, lower(c_name) AS slug, CAST(c_acctbal AS DECIMAL(10,2)) > 0 AS active FROM customer")
def p1(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("slug"), (F.col("c_acctbal").cast("decimal(10,2)") > 0).alias("active"))


@query("x14_fan_out", "SELECT l_orderkey, l_returnflag AS kind, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2")
def x14(t: Tables) -> DataFrame:
    best = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n")).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("m"))
    return best.select("l_orderkey", F.explode("m").alias("kind", "n")).filter("kind != 'N'")


@query("x14_extract_jobs", """WITH k AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'N' THEN 'hlzf:2023' WHEN l_returnflag = 'A' THEN 'netzentgelte' ELSE 'hlzf' END AS kind, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey AS parent, kind, 1990 + l_orderkey % 9 AS year, 'f' || n || '.pdf' AS file, 'slug' || l_orderkey AS slug, 'classified' AS strategy, 'u' || n AS found, 'Queued for extraction' AS step FROM k WHERE kind NOT LIKE '%:%'""")
def x14_jobs(t: Tables) -> DataFrame:
    """Orders as crawl jobs, the flags of their lines as kinds of files, one kind of another year."""
    kind = F.when(F.col("l_returnflag") == "N", "hlzf:2023").when(F.col("l_returnflag") == "A", "netzentgelte").otherwise("hlzf")
    n = t.lineitem.groupBy("l_orderkey", kind.alias("kind")).agg(F.min("l_linenumber").alias("n"))
    file = F.struct(F.concat(F.lit("f"), "n", F.lit(".pdf")).alias("path"), F.lit("pdf").alias("format"), F.concat(F.lit("u"), "n").alias("source_url"))
    files = n.groupBy(F.col("l_orderkey").alias("job")).agg(F.map_from_entries(F.collect_list(F.struct("kind", file.alias("file")))).alias("files"))
    jobs = files.select("job", F.lit("op").alias("operator"), (1990 + F.col("job") % 9).alias("year"), F.lit(5).alias("priority"), F.create_map(F.lit("slug"), F.concat(F.lit("slug"), "job"), F.lit("strategy"), F.lit("crawl")).alias("context"), "files")
    out = discovery.extract_jobs(jobs)
    return out.select("parent", "kind", "year", F.col("context")["file_to_process"].alias("file"), F.col("context")["slug"].alias("slug"), F.col("context")["strategy"].alias("strategy"), F.col("context")["found_url"].alias("found"), "step")
