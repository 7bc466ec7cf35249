"""Ranks, picks, sorts and pages. Orders end in a unique column, so results are fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.operators.ranking import last_value, page, pick
from gridsmith.registry import query
from gridsmith.session import Tables

c = F.col


@query("w1_queue_position", "SELECT event_id, row_number() OVER (PARTITION BY event_type = 'purchase', user_id ORDER BY ts, event_id) AS pos FROM events WHERE event_type IN ('purchase','click')")
def w1(t: Tables) -> DataFrame:
    w = Window.partitionBy(c("event_type") == "purchase", "user_id").orderBy("ts", "event_id")
    return t.events.filter(c("event_type").isin("purchase", "click")).select("event_id", F.row_number().over(w).alias("pos"))


@query("w2_best_candidate", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate) ORDER BY l_quantity DESC, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END DESC, l_orderkey, l_linenumber) AS n FROM lineitem) SELECT l_suppkey, year(l_shipdate) AS y, l_orderkey, l_linenumber FROM r WHERE n = 1")
def w2(t: Tables) -> DataFrame:
    kind = F.when(c("l_returnflag") == "R", 2).when(c("l_returnflag") == "A", 1).otherwise(0)
    rows = t.lineitem.select("l_suppkey", F.year("l_shipdate").alias("y"), "l_orderkey", "l_linenumber", "l_quantity", kind.alias("kind"))
    return pick(rows, ["l_suppkey", "y"], [c("l_quantity").desc(), c("kind").desc(), c("l_orderkey"), c("l_linenumber")]).select("l_suppkey", "y", "l_orderkey", "l_linenumber")


@query("w3_role_priority", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 99 END, o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE n = 1")
def w3(t: Tables) -> DataFrame:
    at = F.array_position(F.array(F.lit("2-HIGH"), F.lit("1-URGENT")), c("o_orderpriority"))
    return pick(t.orders.withColumn("at", F.when(at > 0, at).otherwise(99)), ["o_custkey"], [c("at"), c("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("w4_last_wins", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS n FROM orders) SELECT o_custkey, o_orderpriority, o_totalprice FROM r WHERE n = 1")
def w4(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.max_by("o_totalprice", "o_orderkey").alias("o_totalprice"))


@query("w5_first_wins", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) SELECT l_partkey, l_orderkey, l_linenumber FROM r WHERE n = 1")
def w5(t: Tables) -> DataFrame:
    first = t.lineitem.groupBy("l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("f"))
    return first.select("l_partkey", "f.l_orderkey", "f.l_linenumber")


@query("w6_cross_type_dedup", "WITH k AS (SELECT o_custkey, year(o_orderdate) AS y, o_orderstatus AS kind, count(*) AS n FROM orders WHERE o_orderstatus IN ('F','O') GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, y ORDER BY n DESC, kind) AS rn FROM k) SELECT o_custkey, y, kind, n FROM r WHERE rn = 1")
def w6(t: Tables) -> DataFrame:
    k = t.orders.filter(c("o_orderstatus").isin("F", "O")).groupBy("o_custkey", F.year("o_orderdate").alias("y"), c("o_orderstatus").alias("kind")).agg(F.count("*").alias("n"))
    return pick(k, ["o_custkey", "y"], [c("n").desc(), c("kind")])


@query("w7_top_n_per_key", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) SELECT source, doc_id FROM r WHERE n <= 5")
def w7(t: Tables) -> DataFrame:
    return pick(t.documents.select("source", "doc_id", "n_chars"), ["source"], [c("n_chars").desc(), c("doc_id")], 5).select("source", "doc_id")


@query("w8_carry_forward", "WITH m AS (SELECT user_id, event_id, ts, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section FROM events) SELECT user_id, event_id, section FROM m WHERE section IS NOT NULL")
def w8(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(c("event_type") == "signup", c("event_id"))
    return t.events.select("user_id", "event_id", F.last(mark, ignorenulls=True).over(w).alias("section")).filter("section is not null")


@query("w9_region_to_next_label", "SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS until FROM events WHERE event_type = 'signup'")
def w9(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'signup'").select("user_id", "event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("until"))


@query("w10_kth_to_season", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey, CASE k WHEN 1 THEN 'winter' WHEN 2 THEN 'fruehling' WHEN 3 THEN 'sommer' ELSE 'herbst' END AS season FROM r WHERE k <= 4")
def w10(t: Tables) -> DataFrame:
    from gridsmith.functions.times import SEASONS

    listed = t.orders.groupBy("o_custkey").agg(F.slice(F.sort_array(F.collect_list("o_orderkey")), 1, 4).alias("ks"))
    return listed.select("o_custkey", F.posexplode("ks").alias("k", "o_orderkey")).select("o_custkey", "o_orderkey", F.element_at(F.array(*[F.lit(s) for s in SEASONS]), c("k") + 1).alias("season"))


@query("w11_actual_forecast", "SELECT o_orderpriority, year(o_orderdate) AS y, round(sum(CASE WHEN year(o_orderdate) <= 1996 THEN o_totalprice END), 2) AS actual, round(sum(CASE WHEN year(o_orderdate) >= 1996 THEN o_totalprice END), 2) AS forecast FROM orders GROUP BY 1, 2")
def w11(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    side = lambda cond: F.round(F.sum(F.when(cond, c("o_totalprice"))), 2)
    return t.orders.groupBy("o_orderpriority", y.alias("y")).agg(side(y <= 1996).alias("actual"), side(y >= 1996).alias("forecast"))


@query("w12_whole_table_recompute", "SELECT c_custkey, round(c_acctbal * 0.7, 4) AS score FROM customer")
def w12(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.round(c("c_acctbal") * 0.7, 4).alias("score"))


@query("s4_last_non_empty", "WITH r AS (SELECT user_id, event_id, nullif(event_type, 'view') AS v FROM events) SELECT user_id, max(v) AS v FROM (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM r WHERE v IS NOT NULL) WHERE n = 1 GROUP BY 1")
def s4(t: Tables) -> DataFrame:
    return last_value(t.events.select("user_id", "event_id", F.nullif(c("event_type"), F.lit("view")).alias("v")), ["user_id"], "event_id", ["v"]).filter("v is not null")


@query("o1_sort_keys_nulls", "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS d FROM lineitem ORDER BY d ASC NULLS LAST, l_orderkey, l_linenumber LIMIT 100")
def o1(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.nullif(c("l_discount"), F.lit(0.0)).alias("d")).orderBy(c("d").asc_nulls_last(), "l_orderkey", "l_linenumber").limit(100)


@query("o3_paging", "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 50 OFFSET 100")
def o3(t: Tables) -> DataFrame:
    return page(t.customer.select("c_custkey", "c_name"), [c("c_name"), c("c_custkey")], 3, 200)


@query("o4_recent_jobs", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def o4(t: Tables) -> DataFrame:
    return t.events.orderBy(c("ts").desc(), c("event_id").desc()).limit(20).select("event_id")


@query("o5_merged_flagged", "SELECT kind, id FROM (SELECT 'netz' AS kind, o_orderkey AS id, o_orderdate AS made FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'hlzf', l_orderkey * 10 + l_linenumber, nullif(l_shipdate, l_shipdate) FROM lineitem WHERE l_quantity = 50) ORDER BY made DESC NULLS LAST, kind, id LIMIT 200")
def o5(t: Tables) -> DataFrame:
    a = t.orders.filter("o_orderstatus = 'P'").select(F.lit("netz").alias("kind"), c("o_orderkey").alias("id"), c("o_orderdate").alias("at"))
    b = t.lineitem.filter("l_quantity = 50").select(F.lit("hlzf").alias("kind"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), F.nullif(c("l_shipdate"), c("l_shipdate")).alias("at"))
    return a.unionByName(b).orderBy(c("at").desc_nulls_last(), "kind", "id").limit(200).select("kind", "id")


@query("o6_multi_key", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_orderpriority ASC, year(o_orderdate) DESC, o_orderkey LIMIT 50")
def o6(t: Tables) -> DataFrame:
    return t.orders.orderBy("o_orderpriority", F.year("o_orderdate").desc(), "o_orderkey").limit(50).select("o_custkey", "o_orderkey")


@query("o7_canonical_order", "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 999 END AS k FROM customer")
def o7(t: Tables) -> DataFrame:
    from gridsmith.functions.levels import order_key

    return t.customer.select("c_custkey", order_key(c("c_mktsegment"), ["MACHINERY", "BUILDING", "HOUSEHOLD"]).cast("int").alias("k"))


@query("o8_top_20", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20")
def o8(t: Tables) -> DataFrame:
    return t.supplier.orderBy(c("s_acctbal").desc(), "s_suppkey").limit(20).select("s_suppkey", "s_acctbal")


@query("o9_limit_filter_limit", "SELECT p_brand, n, rate FROM (SELECT p_brand, n, rate FROM (SELECT p_brand, count(*) AS n, CAST(count(*) FILTER (WHERE p_size > 25) AS DOUBLE) / count(*) AS rate FROM part GROUP BY 1) ORDER BY n DESC, p_brand LIMIT 20) WHERE rate >= 0.5 ORDER BY n DESC, p_brand LIMIT 10")
def o9(t: Tables) -> DataFrame:
    n = t.part.groupBy("p_brand").agg(F.count("*").alias("n"), (F.count_if(c("p_size") > 25).cast("double") / F.count("*")).alias("rate"))
    order = [c("n").desc(), c("p_brand")]
    return n.orderBy(*order).limit(20).filter("rate >= 0.5").orderBy(*order).limit(10)


@query("o10_score_desc_stable", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
def o10(t: Tables) -> DataFrame:
    return t.part.orderBy(c("p_retailprice").desc(), "p_partkey").limit(30).select("p_partkey")


@query("o11_provider_order", "SELECT s_suppkey FROM supplier ORDER BY s_nationkey, CASE WHEN s_acctbal > 0 THEN 0 ELSE 1 END, s_suppkey LIMIT 40")
def o11(t: Tables) -> DataFrame:
    return t.supplier.orderBy("s_nationkey", F.when(c("s_acctbal") > 0, 0).otherwise(1), "s_suppkey").limit(40).select("s_suppkey")


@query("o12_newest_first", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def o12(t: Tables) -> DataFrame:
    return t.orders.orderBy(c("o_orderdate").desc(), "o_orderkey").limit(25).select("o_orderkey")


@query("r3_cache_eviction", "WITH r AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY 1), f AS (SELECT user_id, seen, row_number() OVER (ORDER BY seen DESC, user_id) AS n, count(*) OVER () AS m FROM r WHERE seen > TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 1 DAY) SELECT user_id FROM f WHERE n <= CASE WHEN m > 50 THEN 40 ELSE m END")
def r3(t: Tables) -> DataFrame:
    live = t.events.groupBy("user_id").agg(F.max("ts").alias("at")).filter("at > timestamp'2024-01-30 23:00:00' - interval 1 day")
    m = live.agg(F.count("*").alias("m"))
    # a cache of 50 entries: those that stay are the newest 40 when it is full
    return live.orderBy(c("at").desc(), "user_id").limit(40).join(m).filter("m > 50").select("user_id").union(live.join(m).filter("m <= 50").select("user_id"))


@query("r4_latest_state", "SELECT user_id, event_type AS state FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def r4(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


@query("r5_stuck_jobs", "SELECT event_type, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 HOUR) AS stuck, count(*) AS n FROM events GROUP BY 1")
def r5(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_if(F.expr("ts < timestamp'2024-01-20 00:00:00' - interval 1 hour")).alias("stuck"), F.count("*").alias("n"))


@query("x15_enrichment_queue", "SELECT event_id FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 15")
def x15(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'signup'").orderBy("ts", "event_id").limit(15).select("event_id")
