"""Search and entity matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.functions.text import address_key
from gridsmith.operators import names, search
from gridsmith.operators.ranking import pick
from gridsmith.registry import query
from gridsmith.session import Tables

c = F.col


def _grams(x: str) -> str:
    """The trigrams of a text of one or two plain words, in SQL."""
    word = lambda w: f"[substr('  ' || {w} || ' ', i, 3) FOR i IN range(1, length({w}) + 2)]"
    a, b = (f"split_part(lower({x}), ' ', {k})" for k in (1, 2))
    return f"list_distinct(list_concat({word(a)}, CASE WHEN {b} = '' THEN [] ELSE {word(b)} END))"


_X1 = f"""WITH g AS (SELECT p_partkey, p_name, p_brand, {_grams('p_name')} AS a, {_grams("'red'")} AS b FROM part),
s AS (SELECT *, CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) AS sim, contains(lower(p_name), 'red') AS n, contains(lower(p_brand), 'red') AS r FROM g)
SELECT p_partkey, round(sim + CASE WHEN n THEN 2.0 ELSE 0 END + CASE WHEN r THEN 0.5 ELSE 0 END, 6) AS relevance FROM s WHERE n OR r OR sim > 0.08 ORDER BY relevance DESC, p_partkey LIMIT 50"""


@query("x1_hybrid_search", _X1)
def x1(t: Tables) -> DataFrame:
    return search.hybrid(t.part, "p_name", "p_brand", "red").select("p_partkey", "relevance").orderBy(c("relevance").desc(), "p_partkey").limit(50)


_F4 = f"""WITH g AS (SELECT n_nationkey, {_grams("replace(n_name, '_', ' ')")} AS a, {_grams("'nation 7'")} AS b FROM nation),
s AS (SELECT n_nationkey, CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) AS sim FROM g) SELECT n_nationkey, round(sim, 6) AS sim FROM s WHERE sim > 0.2"""


@query("f4_trigram_filter", _F4)
def f4(t: Tables) -> DataFrame:
    sim = search.similarity(search.trigrams(c("n_name")), search.trigrams(F.lit("nation 7")))
    return t.nation.select("n_nationkey", F.round(sim, 6).alias("sim")).filter(c("sim") > search.threshold(8))


@query("o2_relevance_sort", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 2.0 ELSE 0.0 END AS relevance FROM part ORDER BY relevance DESC, p_name, p_partkey LIMIT 40")
def o2(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name", F.when(F.lower("p_name").contains("red"), 2.0).otherwise(0.0).alias("relevance")).orderBy(c("relevance").desc(), "p_name", "p_partkey").limit(40).drop("p_name")


@query("j11_address_hash", "SELECT s.s_suppkey, c_custkey FROM supplier s JOIN customer c ON s_nationkey = c_nationkey AND CAST(floor(s_acctbal / 10) AS BIGINT) = CAST(floor(c_acctbal / 10) AS BIGINT)")
def j11(t: Tables) -> DataFrame:
    key = lambda n, b: address_key(F.concat(F.lit("Musterstr. "), n), F.floor(b / 10).cast("string"))
    s = t.supplier.select("s_suppkey", key(c("s_nationkey"), c("s_acctbal")).alias("h"))
    return s.join(t.customer.select("c_custkey", key(c("c_nationkey"), c("c_acctbal")).alias("h")), "h").select("s_suppkey", "c_custkey")


@query("j12_name_containment", "WITH r AS (SELECT r_regionkey, n_nationkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS k FROM region JOIN nation ON contains(lower(r_name), lower(substr(n_name, 2, 1))) OR contains(lower(n_name), lower(r_name))) SELECT r_regionkey, n_nationkey FROM r WHERE k = 1")
def j12(t: Tables) -> DataFrame:
    r = t.region.select("r_regionkey", F.lower("r_name").alias("r"))
    n = t.nation.select("n_nationkey", F.lower("n_name").alias("n"), F.lower(F.substring("n_name", 2, 1)).alias("l"))
    hits = names.parts(n, r, "l", "r").join(n, "l").select("r", "n_nationkey").union(names.parts(r, n, "r", "n").join(n, "n").select("r", "n_nationkey"))
    return hits.join(r, "r").groupBy("r_regionkey").agg(F.min("n_nationkey").alias("n_nationkey"))


#: Names asked in six ways: spelt otherwise, a part, with a part more, with the words turned round, unknown, one word.
_ASKED = """CASE s_suppkey % 6 WHEN 0 THEN ' ' || upper(p_name) || ', ' || p_brand || ' GmbH & Co KG' WHEN 1 THEN p_name || ' ' || p_brand WHEN 2 THEN 'neue ' || p_name || '-' || p_brand || ' gmbh&co.kg holding'
WHEN 3 THEN substr(p_brand, 1, 5) || ' ' || substr(p_name, 1, 3) || ' ' || p_brand WHEN 4 THEN s_name ELSE p_brand || ' the' END"""
_KNOWN = "p_name || ' ' || p_brand || ' GmbH & Co. KG'"


def _normal(c_: str) -> str:
    out = f"trim(lower({c_}))"
    for x, y in names.SAME:
        out = f"replace({out}, '{x}', '{y}')"
    return f"trim({out})"


_J12 = f"""WITH asked AS (SELECT s_suppkey, {_normal(_ASKED)} AS a FROM supplier JOIN part ON p_partkey = s_suppkey * 2),
known AS (SELECT {_normal(_KNOWN)} AS b, min(p_partkey) AS k FROM part GROUP BY 1),
w AS (SELECT *, list_filter(string_split_regex(a, '\\s+'), lambda x: len(x) > 3)[1:3] AS ws FROM asked),
h AS (SELECT s_suppkey, k, CASE WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN 2 WHEN len(ws) > 0 AND len(list_filter(ws, lambda x: len(list_filter(string_split_regex(b, '\\s+'), lambda y: contains(x, y) OR contains(y, x))) = 0)) = 0 THEN 3 END AS step FROM w, known),
f AS (SELECT s_suppkey, k, step, row_number() OVER (PARTITION BY s_suppkey ORDER BY step, k) AS n FROM h WHERE step IS NOT NULL)
SELECT s_suppkey, k AS p_partkey, CASE step WHEN 1 THEN 'exact' WHEN 2 THEN 'part' ELSE 'words' END AS how FROM f WHERE n = 1"""


def _asked(t: Tables) -> DataFrame:
    return t.supplier.join(t.part, c("p_partkey") == c("s_suppkey") * 2).select("s_suppkey", F.expr(_ASKED).alias("name"), (c("p_partkey") % 5).alias("zip"))


@query("j12_company_by_name", _J12)
def j12_companies(t: Tables) -> DataFrame:
    known = t.part.select("p_partkey", F.expr(_KNOWN).alias("known"))
    return names.first_named(_asked(t), known, "s_suppkey", "name", "p_partkey", "known")


_J13 = f"""WITH asked AS (SELECT s_suppkey, p_partkey % 5 AS z, {_normal(_ASKED)} AS a FROM supplier JOIN part ON p_partkey = s_suppkey * 2),
known AS (SELECT p_partkey, p_partkey % 5 AS z, {_normal(_KNOWN)} AS b FROM part)
SELECT s_suppkey, min(p_partkey) AS p_partkey FROM asked JOIN known USING (z) WHERE contains(a, b) OR contains(b, a) GROUP BY 1"""


@query("j13_company_by_zip_and_name", _J13)
def j13_companies(t: Tables) -> DataFrame:
    known = t.part.select("p_partkey", F.expr(_KNOWN).alias("known"), (c("p_partkey") % 5).alias("z"))
    return names.first_in_zip(_asked(t), known, "s_suppkey", "zip", "name", "p_partkey", "z", "known")


@query("j13_zip_and_name", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND contains(c_name, right(s_name, 2))")
def j13(t: Tables) -> DataFrame:
    """The digits looked for are the key, not the nation, of which there are few."""
    s = t.supplier.select("s_suppkey", c("s_nationkey").alias("k"), F.right("s_name", F.lit(2)).alias("d"))
    found = names.parts(s, t.customer.select("c_name"), "d", "c_name").join(t.customer.select("c_name", "c_custkey", c("c_nationkey").alias("k")), "c_name")
    return s.join(found, ["d", "k"]).select("s_suppkey", "c_custkey")


@query("j14_fuzzy_entities", "SELECT n_nationkey AS ask, n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'fuzzy' ELSE 'exact' END AS outcome FROM nation")
def j14(t: Tables) -> DataFrame:
    asked = t.nation.select(c("n_nationkey").alias("ask"), F.when(c("n_nationkey") % 3 == 0, F.concat(c("n_name"), F.lit("X"))).otherwise(F.lower("n_name")).alias("name"))
    return search.resolve(asked, t.nation.select("n_nationkey", "n_name"), "ask", "name", "n_nationkey", "n_name")


@query("j15_best_name_match", "WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN contains(c_name, '77') THEN 0 ELSE 1 END, c_custkey) AS k FROM customer) SELECT c_nationkey, c_custkey FROM r WHERE k = 1")
def j15(t: Tables) -> DataFrame:
    return pick(t.customer, ["c_nationkey"], [F.when(c("c_name").contains("77"), 0).otherwise(1), c("c_custkey")]).select("c_nationkey", "c_custkey")


_X8 = """WITH h AS (SELECT s_suppkey % 40 AS k, min(s_nationkey) AS op FROM supplier GROUP BY 1), g AS (SELECT s_suppkey % 20 AS k, min(s_nationkey) AS op FROM supplier GROUP BY 1),
a AS (SELECT o_orderkey, h.op AS held, CASE WHEN o_custkey % 7 > 0 THEN g.op END AS near, CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 5 = 0 AND c_acctbal <= 0 THEN 99 ELSE c_nationkey END AS told FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN h ON h.k = o_custkey % 60 LEFT JOIN g ON g.k = o_custkey % 30)
SELECT o_orderkey, coalesce(held, near, told) AS operator, CASE WHEN held IS NOT NULL THEN 'cached' WHEN near IS NOT NULL THEN 'near' WHEN told IS NOT NULL THEN 'skeleton' ELSE 'missing' END AS outcome FROM a"""


@query("x8_search_waterfall", _X8)
def x8(t: Tables) -> DataFrame:
    at = lambda k, off=0.0: (50 + k * 0.001 + off).alias("lat")
    key = lambda street, k: address_key(F.concat(F.lit(street), k), F.lit("10115"))
    a = t.orders.join(t.customer, c("c_custkey") == c("o_custkey")).select(c("o_orderkey").alias("ask"), c("o_custkey").alias("k"), "c_nationkey", "c_acctbal")
    asked = a.select("ask", key("Hauptstraße ", c("k") % 60).alias("key"))
    stored = t.supplier.select(key("Hauptstr. ", c("s_suppkey") % 40).alias("key"), at(c("s_suppkey") % 20), F.lit(10.0).alias("lon"), c("s_nationkey").alias("operator"))
    told = F.array(F.struct(c("c_nationkey").alias("operator"), (c("c_acctbal") > 0).alias("electricity")), F.struct(F.when(c("k") % 5 == 0, 99).alias("operator"), (c("k") % 5 == 0).alias("electricity")))
    answers = a.filter("k % 7 > 0").select("ask", at(c("k") % 30, 0.00003), F.lit(10.00002).alias("lon"), F.explode(told).alias("o")).select("ask", "lat", "lon", "o.*")
    return search.waterfall(asked, stored, answers).select(c("ask").alias("o_orderkey"), "operator", "outcome")


_X9 = """WITH f AS (SELECT DISTINCT o_custkey AS k, year(o_orderdate) AS y, (['NS', 'MS/NS', 'MS', 'HS', 'HS/MS'])[CAST(o_orderpriority[1] AS INTEGER)] AS level, o_orderstatus = 'F' AS price FROM orders),
g AS (SELECT k, string_agg(CAST(y AS VARCHAR) || ':' || level, ',' ORDER BY y, level) FILTER (WHERE price) AS prices, count(*) FILTER (WHERE NOT price) AS n_hours, count(DISTINCT level) FILTER (WHERE price AND level IN ('NS', 'MS', 'MS/NS')) AS three, count(DISTINCT level) FILTER (WHERE price AND level = 'NS') AS one FROM f GROUP BY 1)
SELECT c_custkey, k IS NOT NULL AS has_data, coalesce(prices, '') AS prices, CAST(coalesce(n_hours, 0) AS INTEGER) AS n_hours, CAST(CASE WHEN c_custkey % 11 = 0 THEN CASE WHEN k IS NULL THEN 0 ELSE 100 END WHEN c_custkey % 2 = 0 THEN round_even(coalesce(three, 0) * 100.0 / 3, 0) ELSE coalesce(one, 0) * 100 END AS INTEGER) AS score, CASE WHEN k IS NULL THEN c_name || ' is registered; no data yet.' END AS message FROM customer LEFT JOIN g ON k = c_custkey"""


@query("x9_search_response", _X9)
def x9(t: Tables) -> DataFrame:
    level = F.element_at(F.array(*[F.lit(x) for x in ("NS", "MS/NS", "MS", "HS", "HS/MS")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    kind = F.when(c("o_orderstatus") == "F", "prices").otherwise("hours")
    facts = t.orders.groupBy(c("o_custkey").alias("id"), F.year("o_orderdate").alias("year"), level.alias("level"), kind.alias("kind")).agg(F.max("o_totalprice").alias("value"))
    k = c("c_custkey")
    points = F.when(k % 11 != 0, F.create_map(F.lit("ns"), F.lit(5), F.lit("ms"), F.when(k % 2 == 0, 3).otherwise(0)))
    out = search.response(t.customer.select(k.alias("id"), c("c_name").alias("name"), points.alias("points")), facts)
    said = F.array_join(F.transform("prices", lambda f: F.concat(f["year"], F.lit(":"), f["level"])), ",")
    return out.select(c("id").alias("c_custkey"), "has_data", said.alias("prices"), F.size("hours").alias("n_hours"), c("completeness.score").alias("score"), "message")


@query("x16_bulk_enqueue", "SELECT CASE WHEN k % 5 = 0 THEN 'missing' ELSE 'exact' END AS outcome, count(*) AS n FROM (SELECT DISTINCT s_nationkey AS k FROM supplier) GROUP BY 1")
def x16(t: Tables) -> DataFrame:
    names = t.supplier.select(c("s_nationkey").alias("k")).distinct().join(t.nation, c("k") == c("n_nationkey")).select("k", F.when(c("k") % 5 == 0, F.lit("Stadtwerke Nirgendwo")).otherwise(c("n_name")).alias("name"))
    done = search.resolve(names, t.nation.select("n_nationkey", "n_name"), "k", "name", "n_nationkey", "n_name")
    return done.groupBy("outcome").agg(F.count("*").alias("n"))


@query("x10_bulk_planner", "WITH s AS (SELECT o_custkey, year(o_orderdate) AS y, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'verified' WHEN bool_or(o_orderstatus = 'P') THEN 'flagged' ELSE 'unverified' END AS status FROM orders GROUP BY 1, 2) SELECT c_custkey, y FROM customer CROSS JOIN (SELECT 1996 AS y UNION ALL SELECT 1997) LEFT JOIN s USING (y) WHERE o_custkey = c_custkey AND status <> 'verified' AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def x10(t: Tables) -> DataFrame:
    has = lambda s: F.bool_or(c("o_orderstatus") == s)
    y = F.year("o_orderdate")
    s = t.orders.filter(y.isin(1996, 1997)).groupBy(c("o_custkey").alias("c_custkey"), y.alias("y")).agg(F.when(has("F"), "verified").when(has("P"), "flagged").otherwise("unverified").alias("status"))
    active = t.events.filter("event_type = 'error'").select(c("user_id").alias("c_custkey"))
    return t.customer.select("c_custkey").join(s.filter("status != 'verified'"), "c_custkey").join(active, "c_custkey", "left_anti").select("c_custkey", "y")
