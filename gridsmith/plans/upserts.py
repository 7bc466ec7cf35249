"""Sinks: upserts, review transitions, patches, exports. Parquet has no MERGE, so an upsert is a full
join of the stored and the new rows; of a stored table only the buckets touched are written anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.operators import discovery
from gridsmith.operators.upserts import Facts, upsert
from gridsmith.plans.extraction import folder
from gridsmith.registry import query
from gridsmith.session import Tables

c = F.col


_K2 = "WITH o AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus = 'F' AS lock FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT l_orderkey AS k, max(l_extendedprice) AS price FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1) SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL AND NOT coalesce(lock, false) THEN n.price ELSE o.price END AS price, CASE WHEN n.k IS NULL THEN 'kept' WHEN o.k IS NULL THEN 'inserted' WHEN lock THEN 'skipped' ELSE 'updated' END AS action FROM o FULL JOIN n ON o.k = n.k"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = t.orders.filter("o_orderkey % 3 != 0").select(c("o_orderkey").alias("k"), c("o_totalprice").alias("price"), "o_orderstatus")
    return old, t.lineitem.filter("l_orderkey % 2 = 0").groupBy(c("l_orderkey").alias("k")).agg(F.max("l_extendedprice").alias("price"))


@query("k2_upsert_facts", _K2)
def k2(t: Tables) -> DataFrame:
    return upsert(*_sides(t), ["k"], ["price"], "o_orderstatus = 'F'")


_FACTS = """WITH n AS (SELECT l_orderkey AS o_orderkey, max_by(l_extendedprice, (l_linenumber, l_extendedprice)) AS price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, {price} AS price, {status} AS verification_status FROM orders FULL JOIN n USING (o_orderkey)"""
_LOCKED = "o_orderstatus = 'F' AND o_orderpriority < '3'"


def _facts(t: Tables, force: bool) -> DataFrame:
    """Stored prices of orders, some verified; returned lines bring new ones, the last line's counts."""
    status = F.when(F.expr(_LOCKED), "verified").otherwise("pending")
    facts = Facts(t.spark, folder(t), ["o_orderkey"], ["price", "verification_status"], 16).create(t.orders.select("o_orderkey", c("o_totalprice").alias("price"), status.alias("verification_status")))
    new = t.lineitem.filter("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey"), c("l_extendedprice").alias("price"), F.lit("flagged").alias("verification_status"), "l_linenumber")
    facts.upsert(new, F.struct("l_linenumber", "price"), force=force)
    return facts.read()


@query("k2_stored_facts", _FACTS.format(price=f"CASE WHEN n.price IS NULL OR ({_LOCKED}) THEN o_totalprice ELSE n.price END", status=f"CASE WHEN {_LOCKED} THEN 'verified' WHEN n.price IS NULL THEN 'pending' ELSE 'flagged' END"))
def k2_stored(t: Tables) -> DataFrame:
    return _facts(t, False)


@query("k2_stored_facts_forced", _FACTS.format(price="coalesce(n.price, o_totalprice)", status=f"CASE WHEN n.price IS NOT NULL THEN 'flagged' WHEN {_LOCKED} THEN 'verified' ELSE 'pending' END"))
def k2_forced(t: Tables) -> DataFrame:
    return _facts(t, True)


@query("k4_seed_actions", f"SELECT action, count(*) AS n FROM ({_K2}) GROUP BY 1")
def k4(t: Tables) -> DataFrame:
    return upsert(*_sides(t), ["k"], ["price"], "o_orderstatus = 'F'").groupBy("action").agg(F.count("*").alias("n"))


@query("k3_registry_upsert", "SELECT doc_id AS k, CASE WHEN l.quality IS NULL THEN source ELSE 'q' || CAST(l.quality AS VARCHAR) END AS class FROM documents LEFT JOIN labels l USING (doc_id)")
def k3(t: Tables) -> DataFrame:
    new = t.labels.select("doc_id", F.concat(F.lit("q"), c("quality")).alias("class"))
    return upsert(t.documents.select("doc_id", c("source").alias("class")), new, ["doc_id"], ["class"]).select(c("doc_id").alias("k"), "class")


@query("k5_stats_import", "SELECT count(*) FILTER (WHERE c_custkey IS NOT NULL) AS found, count(*) FILTER (WHERE c_custkey IS NULL) AS not_found FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN customer ON c_custkey = user_id AND c_acctbal > 0")
def k5(t: Tables) -> DataFrame:
    out = t.events.select("user_id").distinct().join(t.customer.filter("c_acctbal > 0"), c("c_custkey") == c("user_id"), "left")
    return out.agg(F.count_if(c("c_custkey").isNotNull()).alias("found"), F.count_if(c("c_custkey").isNull()).alias("not_found"))


@query("k6_export", "SELECT o_custkey, count(*) AS n, max(nullif(o_totalprice, 0)) AS top FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1")
def k6(t: Tables) -> DataFrame:
    rows = t.orders.filter(F.year("o_orderdate") == 1996).groupBy("o_custkey").agg(F.to_json(F.collect_list(F.struct(F.nullif(c("o_totalprice"), F.lit(0.0)).alias("price")))).alias("json"))
    back = F.from_json("json", "array<struct<price:double>>")
    return rows.select("o_custkey", F.size(back).cast("long").alias("n"), F.array_max(F.transform(back, lambda x: x["price"])).alias("top"))


@query("k7_import_merge", "WITH n AS (SELECT l_orderkey AS k, nullif(max(l_tax), 0.08) AS v FROM lineitem GROUP BY 1) SELECT coalesce(o_orderkey, k) AS k, coalesce(v, o_totalprice) AS v FROM orders FULL JOIN n ON k = o_orderkey")
def k7(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(c("l_orderkey").alias("k")).agg(F.nullif(F.max("l_tax"), F.lit(0.08)).alias("v"))
    o = t.orders.select(c("o_orderkey").alias("k"), "o_totalprice")
    return o.join(n, "k", "full").select("k", F.coalesce("v", "o_totalprice").alias("v"))


@query("k7_import_replace", "SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE year(o_orderdate) NOT IN (1996, 1997) UNION ALL SELECT o_orderkey, 0.5 FROM orders WHERE year(o_orderdate) IN (1996, 1997) AND o_orderstatus = 'O'")
def k7_replace(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    rows = t.orders.select(c("o_orderkey").alias("k"), c("o_totalprice").alias("v"), y.alias("y"), "o_orderstatus")
    new = rows.filter(c("y").isin(1996, 1997) & (c("o_orderstatus") == "O")).select("k", F.lit(0.5).alias("v"), "y")
    return rows.select("k", "v", "y").join(new.select("y").distinct(), "y", "left_anti").unionByName(new).select("k", "v")


@query("k12_review_transitions", "WITH a AS (SELECT user_id, max(event_id) AS e FROM events WHERE event_type IN ('purchase','error','signup') GROUP BY 1) SELECT c_custkey, CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'error' THEN 'flagged' WHEN 'signup' THEN CASE WHEN c_acctbal < 0 THEN 'unverified' ELSE 'error' END ELSE 'unverified' END AS status FROM customer LEFT JOIN a ON a.user_id = c_custkey LEFT JOIN events ON event_id = e")
def k12(t: Tables) -> DataFrame:
    """The latest action counts; unflagging something that isn't flagged is an error."""
    log = t.events.filter(c("event_type").isin("purchase", "error", "signup")).groupBy(c("user_id").alias("c_custkey")).agg(F.max_by("event_type", "event_id").alias("act"))
    act = c("act")
    now = F.when(act == "purchase", "verified").when(act == "error", "flagged").when(act == "signup", F.when(c("c_acctbal") < 0, "unverified").otherwise("error")).otherwise("unverified")
    return t.customer.join(log, "c_custkey", "left").select("c_custkey", now.alias("status"))


@query("k13_patch_delete", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'manual' ELSE 'auto' END AS origin, CASE WHEN o_orderkey % 10 = 1 THEN 1.5 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 10 <> 2")
def k13(t: Tables) -> DataFrame:
    patches = t.orders.filter("o_orderkey % 10 = 1").select("o_orderkey", F.lit(1.5).alias("p"))
    gone = t.orders.filter("o_orderkey % 10 = 2").select("o_orderkey")
    out = t.orders.join(patches, "o_orderkey", "left").join(gone, "o_orderkey", "left_anti")
    return out.select("o_orderkey", F.when(c("p").isNotNull(), "manual").otherwise("auto").alias("origin"), F.coalesce("p", "o_totalprice").alias("price"))


@query("k14_cascade_delete", "SELECT count(*) AS orders, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 7) AS items FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 7")
def k14(t: Tables) -> DataFrame:
    gone = t.customer.filter("c_nationkey = 7").select(c("c_custkey").alias("o_custkey"))
    orders = t.orders.join(gone, "o_custkey", "left_anti")
    dead = t.orders.join(gone, "o_custkey", "left_semi").select(c("o_orderkey").alias("l_orderkey"))
    return orders.agg(F.count("*").alias("orders")).join(t.lineitem.join(dead, "l_orderkey", "left_anti").agg(F.count("*").alias("items")))


@query("k15_predicate_update", "SELECT CASE WHEN event_type = 'view' AND ts > TIMESTAMP '2024-01-20 00:00:00' THEN 'cancelled' ELSE event_type END AS status, count(*) AS n FROM events WHERE NOT (event_type = 'error' AND value < 50) GROUP BY 1")
def k15(t: Tables) -> DataFrame:
    off = F.expr("event_type = 'view' and ts > timestamp'2024-01-20 00:00:00'")
    rows = t.events.filter("not (event_type = 'error' and value < 50)")
    return rows.groupBy(F.when(off, "cancelled").otherwise(c("event_type")).alias("status")).agg(F.count("*").alias("n"))


@query("k16_compensate", "SELECT event_id, CASE WHEN user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'failed' ELSE event_type END AS status FROM events WHERE event_type = 'click'")
def k16(t: Tables) -> DataFrame:
    bad = t.customer.filter("c_acctbal < 0").select(c("c_custkey").alias("user_id"), F.lit(True).alias("bad"))
    return t.events.filter("event_type = 'click'").join(bad, "user_id", "left").select("event_id", F.when(c("bad"), "failed").otherwise(c("event_type")).alias("status"))


@query("k17_fill_if_empty", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN s_name WHEN s_nationkey % 2 = 0 THEN coalesce(n_name, s_name) ELSE s_name END AS address FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def k17(t: Tables) -> DataFrame:
    j = t.supplier.join(t.nation, c("n_nationkey") == c("s_nationkey"), "left")
    return j.select("s_suppkey", F.when((c("s_acctbal") >= 0) & (c("s_nationkey") % 2 == 0), F.coalesce("n_name", "s_name")).otherwise(c("s_name")).alias("address"))


@query("k18_get_or_create", "SELECT c_custkey AS id, 'old' AS origin FROM customer UNION ALL SELECT DISTINCT o_custkey + 1400, 'new' FROM orders WHERE o_custkey + 1400 NOT IN (SELECT c_custkey FROM customer)")
def k18(t: Tables) -> DataFrame:
    have = t.customer.select(c("c_custkey").alias("id"))
    want = t.orders.select((c("o_custkey") + 1400).alias("id")).distinct().join(have, "id", "left_anti")
    return have.withColumn("origin", F.lit("old")).unionByName(want.withColumn("origin", F.lit("new")))


@query("k19_usage_counter", "SELECT user_id, count(*) AS calls, max(ts) AS last_used FROM events GROUP BY 1")
def k19(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count("*").alias("calls"), F.max("ts").alias("last_used"))


@query("k1_nested_stats", "SELECT n_nationkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def k1(t: Tables) -> DataFrame:
    """The nested object {key: {cp: {total}}} as one JSON text for each operator, read back."""
    stats = t.customer.groupBy(c("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    nested = stats.select("n_nationkey", F.to_json(F.struct(F.struct(c("n").alias("total")).alias("cp"))).alias("json"))
    return nested.select("n_nationkey", F.from_json("json", "cp struct<total:bigint>")["cp"]["total"].alias("n"))


@query("k8_canonical_names", "SELECT o_orderkey, 'c' || CAST(o_custkey AS VARCHAR) || '-netz-' || CAST(year(o_orderdate) AS VARCHAR) || '.pdf' AS file FROM orders")
def k8(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.concat(F.lit("c"), c("o_custkey"), F.lit("-netz-"), F.year("o_orderdate"), F.lit(".pdf")).alias("file"))


@query("k10_quarantine", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 49 THEN 'quantity' ELSE 'discount' END AS reason FROM lineitem WHERE l_quantity > 49 OR l_discount > 0.09")
def k10(t: Tables) -> DataFrame:
    reason = F.when(c("l_quantity") > 49, "quantity").when(c("l_discount") > 0.09, "discount")
    return t.lineitem.withColumn("reason", reason).filter("reason is not null").select("l_orderkey", "l_linenumber", "reason")


@query("k11_error_log", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def k11(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'error'").groupBy(c("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))


@query("s25_status_refresh", "SELECT c_custkey, CASE WHEN event_type = 'error' THEN 'protected' ELSE 'open' END AS status FROM customer LEFT JOIN (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) ON user_id = c_custkey AND k = 1")
def s25(t: Tables) -> DataFrame:
    last = t.events.groupBy(c("user_id").alias("c_custkey")).agg(F.max_by("event_type", "event_id").alias("e"))
    return t.customer.select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", F.when(c("e") == "error", "protected").otherwise("open").alias("status"))


@query("s26_enrichment_tag", "SELECT c_custkey, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL OR b.k IS NOT NULL THEN 'one' ELSE 'none' END AS tag FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) a ON a.k = c_custkey LEFT JOIN (SELECT DISTINCT user_id AS k FROM events) b ON b.k = c_custkey")
def s26(t: Tables) -> DataFrame:
    a = t.orders.select(c("o_custkey").alias("c_custkey")).distinct().withColumn("a", F.lit(1))
    b = t.events.select(c("user_id").alias("c_custkey")).distinct().withColumn("b", F.lit(1))
    n = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))
    return t.customer.select("c_custkey").join(a, "c_custkey", "left").join(b, "c_custkey", "left").select("c_custkey", F.when(n == 2, "both").when(n == 1, "one").otherwise("none").alias("tag"))


@query("a25_merge_windows", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1")
def a25(t: Tables) -> DataFrame:
    """Union of arrays of one key in the order of an ordinal, repeats dropped."""
    rows = t.orders.select("o_custkey", "o_orderkey", F.array("o_orderpriority").alias("w"))
    merged = rows.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "w"))).alias("l"))
    return merged.select("o_custkey", F.size(F.array_distinct(F.flatten(F.transform("l", lambda x: x["w"])))).cast("long").alias("n"))


@query("f24_add_column", "SELECT r_regionkey, r_name, CAST(NULL AS INTEGER) AS added FROM region")
def f24(t: Tables) -> DataFrame:
    df = t.region
    return df if "added" in df.columns else df.withColumn("added", F.lit(None).cast("int"))


_X6 = """WITH a AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.02) >= 2 AS sane FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
b AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (WHERE l_tax > 0.02) >= 2 AS sane FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN coalesce(a.sane, false) OR b.k IS NULL THEN 'patterns' ELSE 'fallback' END AS method, CASE WHEN coalesce(a.sane, false) OR b.k IS NULL THEN a.n ELSE b.n END AS n, NOT coalesce(a.sane, false) AND NOT coalesce(b.sane, false) AS flagged FROM a FULL JOIN b ON a.k = b.k"""


@query("x6_extract_fallback", _X6)
def x6(t: Tables) -> DataFrame:
    rows = t.lineitem.select(c("l_orderkey").alias("file"), "l_returnflag", "l_discount", "l_tax")
    own = rows.filter("l_returnflag = 'N'").withColumn("valid", c("l_discount") > 0.02)
    other = rows.filter("file % 3 > 0").withColumn("valid", c("l_tax") > 0.02)
    return discovery.chosen(own, other).withColumnRenamed("file", "k")


_X7J = "SELECT o_orderkey AS job, lower(o_orderpriority[3:]) AS p, o_custkey % 4 = 0 AS via, count(l_orderkey) AS n, coalesce(bool_or(l_quantity > 49), false) AS e, coalesce(bool_or(l_discount > 0.09), false) AS w FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > 1 GROUP BY 1, 2, 3"
_X7 = f"""WITH j AS ({_X7J}), ok AS (SELECT * FROM j WHERE n > 0 AND NOT e),
x AS (SELECT '/' || p || '/' AS pattern, 1 AS ok FROM ok UNION ALL SELECT '/' || p || '/{{year}}/', 1 FROM ok UNION ALL SELECT '/' || p || '/', 0 FROM j WHERE via AND (n = 0 OR e))
SELECT pattern, count(*) FILTER (WHERE ok = 1) AS success, count(*) FILTER (WHERE ok = 0) AS fail FROM x GROUP BY 1"""


def _jobs(t: Tables) -> DataFrame:
    part = F.lower(F.substring("o_orderpriority", 3, 100))
    jobs = t.orders.select(c("o_orderkey").alias("job"), F.concat(F.lit("https://x.de/"), part, F.lit("/2024/a.pdf")).alias("url"), F.when(c("o_custkey") % 4 == 0, F.concat(F.lit("/"), part, F.lit("/"))).alias("via"))
    return discovery.finalized(jobs, t.lineitem.filter("l_linenumber > 1").select(c("l_orderkey").alias("job"), (c("l_quantity") > 49).alias("error"), (c("l_discount") > 0.09).alias("warning")))


@query("x7_finalized_jobs", f"SELECT job, CASE WHEN e THEN 0 ELSE n END AS n, n > 0 AND NOT e AS saved, n > 0 AND NOT e AND w AS flagged FROM ({_X7J})")
def x7_jobs(t: Tables) -> DataFrame:
    return _jobs(t).select("job", "n", "saved", "flagged")


@query("x7_validate_finalize_learn", _X7)
def x7(t: Tables) -> DataFrame:
    return discovery.learned(_jobs(t))


@query(
    "x11_seed_pipeline",
    """WITH e AS (SELECT c_custkey AS k, lower(c_name) AS name, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_mktsegment <> 'FURNITURE'),
    a AS (SELECT k, name, coalesce(n, 0) AS n FROM e UNION ALL SELECT user_id, 'user', count(*) FROM events WHERE user_id NOT IN (SELECT k FROM e) GROUP BY 1, 2)
    SELECT a.k, a.name, CASE WHEN s_suppkey IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM a LEFT JOIN supplier ON s_suppkey = a.k AND s_acctbal > 0""",
)
def x11(t: Tables) -> DataFrame:
    """Names, enrichment, merge with statistics-only rows, and the upsert's action of each."""
    names = t.customer.filter("c_mktsegment != 'FURNITURE'").select(c("c_custkey").alias("k"), F.lower("c_name").alias("name"))
    found = names.join(t.orders.groupBy(c("o_custkey").alias("k")).agg(F.count("*").alias("n")), "k", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rest = t.events.groupBy(c("user_id").alias("k")).agg(F.count("*").alias("n")).join(names.select("k"), "k", "left_anti").select("k", F.lit("user").alias("name"), "n")
    stored = t.supplier.filter("s_acctbal > 0").select(c("s_suppkey").alias("k"), c("s_name").alias("name"))
    return upsert(stored, found.unionByName(rest).select("k", "name"), ["k"], ["name"]).filter("action in ('inserted', 'updated')")
