"""Records of operators (P1 to P11), their extracted prices (F8, F9), files (K8), pages (M4) and register entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.functions import html, validation
from gridsmith.functions.text import UMLAUTS
from gridsmith.operators import names, records
from gridsmith.registry import query
from gridsmith.session import Tables
from gridsmith.sources import files, listing

c = F.col

#: The export's columns made of a customer.
_EXPORT = {
    "mastr_nr": "' SNB' || c_custkey", "name": "c_name || CASE c_custkey % 3 WHEN 0 THEN ' Größe & Söhne GmbH' WHEN 1 THEN '  ' ELSE '' END", "street": "CASE c_custkey % 4 WHEN 0 THEN '  ' ELSE ' Weg' END", "house_number": "CASE c_custkey % 5 WHEN 0 THEN NULL ELSE CAST(c_custkey % 90 AS VARCHAR) END",
    "zip_code": "CASE c_custkey % 6 WHEN 0 THEN '' ELSE lpad(CAST(c_custkey % 99999 AS VARCHAR), 5, '0') END", "city": "CASE c_custkey % 7 WHEN 0 THEN '' ELSE 'Ort ' || c_custkey % 9 END", "region": "CASE WHEN c_custkey % 2 = 0 THEN 'Bayern ' ELSE '' END", "country": "'Deutschland'", "acer_code": "CASE WHEN c_custkey % 8 = 0 THEN ' A' || c_custkey ELSE ' ' END",
    "roles": "CASE c_custkey % 3 WHEN 0 THEN 'Netz, , Lieferant ' WHEN 1 THEN ' , ' ELSE c_mktsegment END", "registration_date": "CASE c_custkey % 5 WHEN 0 THEN '1/31/2020' WHEN 1 THEN '31/1/2020' WHEN 2 THEN '2020-01-31' WHEN 3 THEN '31.1.2020' ELSE 'soon' END", "closed_network": "CASE WHEN c_custkey % 10 = 0 THEN ' JA' ELSE 'Nein' END", "activity_status": "CASE WHEN c_custkey % 4 = 0 THEN 'Endgültig stillgelegt' ELSE ' aktiv' END",
}


def _slug_sql(x: str) -> str:
    out = f"lower({x})"
    for a, b in UMLAUTS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', '-', 'g'), '-')"


_T = {n: f"trim(coalesce({v}, ''))" for n, v in _EXPORT.items()}


@query(
    "p1_registry_records",
    f"""SELECT {_T['mastr_nr']} AS mastr_nr, {_slug_sql(_T['name'])} AS slug, nullif({_T['region']}, '') AS region, nullif({_T['acer_code']}, '') AS acer_code, 1 + CASE WHEN street <> '' THEN 1 ELSE 0 END + CASE WHEN house <> '' THEN 1 ELSE 0 END + CASE WHEN zip <> '' THEN 1 ELSE 0 END + CASE WHEN city <> '' THEN 1 ELSE 0 END AS n_components,
    nullif(concat_ws(', ', CASE WHEN street <> '' THEN street || CASE WHEN house <> '' THEN ' ' || house ELSE '' END END, CASE WHEN city <> '' THEN CASE WHEN zip <> '' THEN zip || ' ' ELSE '' END || city END), '') AS contact_address,
    CASE c_custkey % 3 WHEN 0 THEN 'Netz|Lieferant' WHEN 2 THEN c_mktsegment END AS roles, CASE WHEN c_custkey % 5 < 4 THEN '2020-01-31' END AS registration_date, CAST(NULL AS VARCHAR) AS activity_end, c_custkey % 10 = 0 AS closed_network, c_custkey % 4 <> 0 AS is_active
    FROM (SELECT *, {_T['street']} AS street, {_T['house_number']} AS house, {_T['zip_code']} AS zip, {_T['city']} AS city FROM customer)""",
)
def p1(t: Tables) -> DataFrame:
    rows = t.customer.select(*[F.expr(v.replace("VARCHAR", "STRING")).alias(records.EXPORT[n]) for n, v in _EXPORT.items()])
    out = records.from_export(rows)
    return out.select("mastr_nr", "slug", "region", "acer_code", F.size("address_components").alias("n_components"), "contact_address", F.array_join("marktrollen", "|").alias("roles"), "registration_date", "activity_end", "closed_network", "is_active")


#: A third of the customers has a directory entry, some with gaps; their orders are entries of the code register.
_GOLDEN = """WITH b AS (SELECT o_custkey, min(o_orderkey) AS first, min(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS grid, min(o_orderkey) FILTER (WHERE o_orderpriority < '3') AS site FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'official ' || c_custkey END, CASE WHEN c_custkey % 5 = 0 THEN 'own ' || c_custkey END, c_name) AS display_name,
coalesce(CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 > 0 THEN 'home' || c_custkey END, 'site' || site, 'web' || c_custkey) AS display_website, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN 'v' ELSE 'o' END AS display_phone,
CASE WHEN first IS NULL THEN 'primary' ELSE 'b' || coalesce(grid, first) END AS bdew_code, concat_ws(',', CASE WHEN c_acctbal > 0 THEN 'mastr' END, CASE WHEN c_custkey % 3 = 0 THEN 'vnb' END, CASE WHEN first IS NOT NULL THEN 'bdew' END) AS sources
FROM customer LEFT JOIN b ON o_custkey = c_custkey"""


@query("p2_p3_golden_records", _GOLDEN)
def p2(t: Tables) -> DataFrame:
    k = c("c_custkey")
    entry = F.struct(c("o_orderkey").alias("k"), F.when(c("o_orderpriority") < "3", F.concat(F.lit("site"), "o_orderkey")).otherwise("").alias("website"), F.concat(F.lit("b"), "o_orderkey").alias("bdew_code"), (c("o_orderstatus") == "F").alias("is_grid_operator"))
    register = t.orders.groupBy(c("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(entry)).alias("bdew"))
    vnb = F.when(k % 3 == 0, F.struct(F.when(k % 2 == 0, F.concat(F.lit("official "), k)).alias("official_name"), F.when(k % 4 > 0, F.concat(F.lit("home"), k)).otherwise("").alias("homepage_url"), F.when(k % 2 == 1, "v").otherwise("").alias("phone"), F.lit(None).cast("string").alias("email")))
    base = t.customer.join(register, "c_custkey", "left").select("c_custkey", c("c_name").alias("name"), F.when(k % 5 == 0, F.concat(F.lit("own "), k)).otherwise("").alias("official_name"), F.concat(F.lit("web"), k).alias("website"), F.lit("o").alias("phone"), F.lit("e").alias("email"), F.lit("primary").alias("primary_bdew_code"), vnb.alias("vnb"), F.when(c("c_acctbal") > 0, F.struct("c_acctbal")).alias("mastr"), "bdew")
    return records.golden(base).select("c_custkey", "display_name", "display_website", "display_phone", "bdew_code", F.array_join("enrichment_sources", ",").alias("sources"))


_STATS = """WITH m AS (SELECT c_nationkey AS k, count(*) AS n, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS ns, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS mw FROM customer GROUP BY 1)
SELECT k, CASE WHEN k % 3 > 0 THEN mw END AS total_mw, CASE WHEN k % 3 > 0 THEN CASE WHEN k % 2 = 0 THEN 0.0 ELSE 1.5 END + 2.0 END AS other_mw, CASE WHEN k % 4 > 0 THEN n END AS total, CASE WHEN k % 4 > 0 THEN CASE WHEN k % 5 = 0 THEN 0 ELSE ns END END AS ns, k % 12 > 0 AS has_stats, CASE WHEN k % 12 > 0 AND k % 4 > 0 THEN n END AS reply_total FROM m"""


@query("p4_display_structs", _STATS)
def p4(t: Tables) -> DataFrame:
    k = c("k")
    sums = t.customer.groupBy(c("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.count_if(c("c_mktsegment") == "BUILDING").alias("ns"), F.sum(c("c_acctbal").cast("decimal(18,2)")).alias("mw"))
    none = lambda kind: F.lit(None).cast(kind)
    mastr = F.struct(
        F.when(k % 3 > 0, c("mw")).alias("total_capacity_mw"), *[none("double").alias(f"{x}_capacity_mw") for x in ("solar", "wind", "storage")], F.when(k % 2 == 1, 1.5).alias("biomass_capacity_mw"), F.lit(2.0).alias("hydro_capacity_mw"),
        F.when(k % 4 > 0, c("n")).alias("connection_points_total"), F.when(k % 5 > 0, c("ns")).alias("connection_points_ns"), *[none("bigint").alias(f"connection_points_{x}") for x in ("ms", "hs", "hoe")], none("map<string,bigint>").alias("connection_points_by_level"),
        *[none("bigint").alias(x) for x in ("networks_count", "solar_units", "wind_units", "storage_units")], *[none("boolean").alias(x) for x in ("has_customers", "closed_distribution_network")], none("string").alias("stats_data_quality"), none("timestamp").alias("stats_computed_at"),
    )
    m = sums.select("k", mastr.alias("m"))
    out = m.select("k", records.capacity(c("m")).alias("c"), records.voltages(c("m")).alias("v"), records.statistics(c("m")).alias("s"))
    return out.select("k", "c.total_mw", "c.other_mw", "v.total", "v.ns", c("s").isNotNull().alias("has_stats"), c("s.connection_points.total").alias("reply_total"))


_LEVELS_SQL = "CASE c_custkey % 9 WHEN 0 THEN 'NS' WHEN 1 THEN 'Umspannung NS/MS' WHEN 2 THEN 'MS' WHEN 3 THEN 'Umspannung MS/HS' WHEN 4 THEN 'HS' WHEN 5 THEN 'Umspannung HS/HöS' WHEN 6 THEN 'HöS' WHEN 7 THEN 'MS/NS' ELSE 'HS/MS' END"


@query("p5_coarse_levels", f"SELECT c_nationkey, count(*) FILTER (WHERE l IN ('NS', 'Umspannung NS/MS')) AS ns, count(*) FILTER (WHERE l IN ('MS', 'Umspannung MS/HS')) AS ms, count(*) FILTER (WHERE l IN ('HS', 'Umspannung HS/HöS')) AS hs, count(*) FILTER (WHERE l = 'HöS') AS hoe, count(*) FILTER (WHERE l IN ('MS/NS', 'HS/MS')) AS other FROM (SELECT c_nationkey, {_LEVELS_SQL} AS l FROM customer) GROUP BY 1")
def p5(t: Tables) -> DataFrame:
    counts = t.customer.groupBy("c_nationkey", F.expr(_LEVELS_SQL).alias("l")).agg(F.count("*").alias("n"))
    maps = counts.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("m"))
    other = F.coalesce(F.try_element_at("m", F.lit("MS/NS")), F.lit(0)) + F.coalesce(F.try_element_at("m", F.lit("HS/MS")), F.lit(0))
    return maps.select("c_nationkey", records.coarse(c("m"), other).alias("x")).select("c_nationkey", "x.*")


@query("p7_live_states", "SELECT c_custkey, CASE WHEN running > 0 THEN 'running' WHEN pending > 0 THEN 'pending' WHEN c_acctbal < 0 THEN 'protected' WHEN n > 0 THEN 'crawled' ELSE 'uncrawled' END AS status, CAST(CASE WHEN n > 0 THEN least(round_even(n / 50 * 100, 0), 100) ELSE 0 END AS INTEGER) AS score FROM (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderkey % 9 = 0) AS running, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderkey % 9 = 1) AS pending FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)")
def p7(t: Tables) -> DataFrame:
    """Orders are data points, some of them jobs that run or wait."""
    job = lambda s, n: F.count_if((c("o_orderstatus") == s) & (c("o_orderkey") % 9 == n))
    counts = t.orders.groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), job("P", 0).alias("running"), job("O", 1).alias("pending"))
    both = t.customer.join(counts, "c_custkey", "left").fillna(0, ["n", "running", "pending"])
    return both.select("c_custkey", records.live_status(c("c_acctbal") >= 0, c("n"), c("running"), c("pending")).alias("status"), records.list_score(c("n")).alias("score"))


_P9 = """WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN 's' || c_custkey % 120 END AS vnb, CASE c_custkey % 3 WHEN 0 THEN c_name END AS official, CASE c_custkey % 5 WHEN 0 THEN 'w' || c_custkey % 7 END AS web, CASE WHEN c_custkey % 2 = 0 THEN 'p' END AS phone, CASE WHEN c_custkey % 2 = 0 THEN 'e' END AS email, CASE WHEN c_custkey % 6 = 0 THEN 'a' END AS address FROM customer),
f AS (SELECT a.*, s.* FROM a LEFT JOIN supplier s ON vnb = 's' || s_suppkey AND NOT (web IS NOT NULL AND phone IS NOT NULL AND email IS NOT NULL)),
g AS (SELECT id, coalesce(official, s_name) AS official_name, coalesce(web, 'w' || s_suppkey % 11) AS website, coalesce(phone, CAST(s_suppkey AS VARCHAR)) AS phone, address, CASE WHEN address IS NULL AND s_suppkey % 2 = 0 THEN 'd' || s_suppkey END AS found FROM f)
SELECT id, official_name, website, phone, coalesce(address, CASE WHEN found IS NOT NULL THEN coalesce(CASE WHEN CAST(substr(website, 2) AS INTEGER) < 5 THEN 'rich ' || website END, found) END) AS contact_address, coalesce(CASE WHEN CAST(substr(website, 2) AS INTEGER) < 8 THEN CAST(substr(website, 2) AS INTEGER) % 2 = 0 END, true) AS crawlable FROM g"""


@query("p9_fields_at_creation", _P9)
def p9(t: Tables) -> DataFrame:
    """Customers are asked for, suppliers the directory, eight of their websites answered."""
    k, s = c("c_custkey"), c("s_suppkey")
    asked = t.customer.select(k.alias("id"), F.when(k % 4 > 0, F.concat(F.lit("s"), k % 120)).otherwise("").alias("vnb_id"), F.when(k % 3 == 0, c("c_name")).otherwise("").alias("official_name"), F.when(k % 5 == 0, F.concat(F.lit("w"), k % 7)).alias("website"), F.when(k % 2 == 0, "p").alias("phone"), F.when(k % 2 == 0, "e").otherwise("").alias("email"), F.when(k % 6 == 0, "a").alias("contact_address"))
    directory = t.supplier.select(F.concat(F.lit("s"), s).alias("vnb_id"), c("s_name").alias("name"), F.concat(F.lit("w"), s % 11).alias("homepage_url"), s.cast("string").alias("phone"), F.lit("x").alias("email"), F.when(s % 2 == 0, F.concat(F.lit("d"), s)).otherwise("").alias("address"))
    n = F.substring("website", 2, 9).cast("int")
    web = directory.select(c("homepage_url").alias("website")).distinct().filter(n < 8).select("website", (n % 2 == 0).alias("crawlable"), F.lit(None).cast("string").alias("blocked_reason"), F.when(n < 5, F.concat(F.lit("rich "), "website")).otherwise("").alias("enriched_address"))
    return records.resolved(asked, directory, web).select("id", "official_name", "website", "phone", "contact_address", "crawlable")


_P10 = """WITH p AS (SELECT l_orderkey AS k, CASE WHEN count(*) % 2 = 0 THEN max(l_extendedprice) END AS price, CASE WHEN count(*) % 3 = 0 THEN max(l_returnflag) END AS status FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT o_orderkey, coalesce(price, o_totalprice) AS o_totalprice, coalesce(status, o_orderstatus) AS o_orderstatus, CASE WHEN k IS NOT NULL THEN 'manual' ELSE 'pdf' END AS extraction_source, CASE WHEN k IS NOT NULL THEN 'me' END AS last_edited_by FROM orders LEFT JOIN p ON k = o_orderkey"""


@query("p10_patched_records", _P10)
def p10(t: Tables) -> DataFrame:
    n = F.count("*")
    patch = t.lineitem.filter("l_linestatus = 'O'").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.when(n % 2 == 0, F.max("l_extendedprice")).alias("o_totalprice"), F.when(n % 3 == 0, F.max("l_returnflag")).alias("o_orderstatus"))
    base = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", F.lit("pdf").alias("extraction_source"))
    return records.patched(base, patch, "o_orderkey", ["o_totalprice", "o_orderstatus"], "me").select("o_orderkey", "o_totalprice", "o_orderstatus", "extraction_source", "last_edited_by")


_P11 = f"""WITH l AS (SELECT c_nationkey AS k, count(*) AS n, {', '.join(f"count(*) FILTER (WHERE l = '{x}') AS l{i}" for i, x in enumerate(['NS', 'Umspannung NS/MS', 'MS', 'Umspannung MS/HS', 'HS', 'Umspannung HS/HöS', 'HöS', 'MS/NS', 'HS/MS']))}, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS b FROM (SELECT *, {_LEVELS_SQL} AS l FROM customer) GROUP BY 1)
SELECT k, n AS total, CASE WHEN k % 3 > 0 THEN l0 + coalesce(nullif(l1, 0), l7) WHEN k % 2 = 0 THEN b END AS ns, CASE WHEN k % 3 > 0 THEN l2 + coalesce(nullif(l3, 0), l8) END AS ms, CASE WHEN k % 3 > 0 THEN l6 END AS hoe, CASE WHEN k % 3 > 0 THEN l0 WHEN k % 2 = 0 THEN b ELSE 0 END AS level_ns, CASE WHEN k % 3 > 0 THEN coalesce(nullif(l1, 0), l7) ELSE 0 END AS level_between FROM l"""


@query("p11_normalized_points", _P11)
def p11(t: Tables) -> DataFrame:
    """Nations have their customers by level, a third of them by coarse level only, half of those without a count."""
    rows = t.customer.groupBy(c("c_nationkey").alias("k"), F.expr(_LEVELS_SQL).alias("l")).agg(F.count("*").alias("n"), F.count_if(c("c_mktsegment") == "BUILDING").alias("b"))
    maps = rows.groupBy("k").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("fine"), F.sum("b").alias("b"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    p = F.struct("total", F.when((c("k") % 3 == 0) & (c("k") % 2 == 0), F.create_map(F.lit("ns"), c("b"))).otherwise(empty).alias("by_voltage"), F.when(c("k") % 3 > 0, c("fine")).alias("by_canonical_level"))
    out = maps.select("k", records.points(p).alias("p"))
    return out.select("k", "p.total", "p.ns", "p.ms", "p.hoe", c("p.by_level")["NS"].alias("level_ns"), c("p.by_level")["Umspannung NS/MS"].alias("level_between"))


_SPELT = "CASE p_partkey % 6 WHEN 0 THEN upper(p_name) || ' GmbH & Co. KG' WHEN 1 THEN p_name || ' GmbH&Co.KG ' WHEN 2 THEN p_name || '-' || p_brand || ' gmbh & co kg' WHEN 3 THEN '  ' || p_name || ' & ' || p_brand || ', e.V.' WHEN 4 THEN p_name || '   ' || p_brand ELSE '' END"


def _normal(x: str) -> str:
    out = f"trim(lower({x}))"
    for a, b in names.SAME:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim({out})"


@query("g4_normalized_names", f"SELECT p_partkey, {_normal(_SPELT)} AS name FROM part")
def g4(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", names.normalized(F.expr(_SPELT)).alias("name"))


_PRICE = "CASE l_linenumber % 5 WHEN 0 THEN '-' WHEN 1 THEN ' Keine ' WHEN 2 THEN replace(CAST(l_quantity AS VARCHAR), '.', ',') WHEN 3 THEN 'k.A.' ELSE CAST(l_quantity * 20 AS VARCHAR) END"
_WARN = "CASE l_linenumber % 5 WHEN 2 THEN CASE WHEN l_quantity NOT BETWEEN {a} AND {b} THEN '{n}: unusual' END WHEN 3 THEN '{n}: not a number' WHEN 4 THEN CASE WHEN l_quantity * 20 NOT BETWEEN {a} AND {b} THEN '{n}: unusual' END END"


@query("f8_price_warnings", f"SELECT l_orderkey, l_linenumber, l_quantity, concat_ws(',', {_WARN.format(n='arbeit', a=0.01, b=20)}, {_WARN.format(n='leistung', a=0, b=500)}) AS warnings FROM lineitem")
def f8(t: Tables) -> DataFrame:
    x = F.expr(_PRICE.replace("VARCHAR", "STRING"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.array_join(validation.price_warnings(x, x), ",").alias("warnings"))


@query("f9_sane_files", "WITH r AS (SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN 'hlzf' ELSE 'netzentgelte' END AS kind, l_returnflag <> 'N' OR l_linenumber % 3 = 0 AS priced FROM lineitem) SELECT l_orderkey, kind, count(*) AS n, CASE WHEN count(*) < 2 THEN 'too few records' WHEN kind = 'netzentgelte' AND count(*) FILTER (WHERE priced) < 2 THEN 'too few prices' ELSE 'ok' END AS verdict FROM r GROUP BY 1, 2")
def f9(t: Tables) -> DataFrame:
    kind = F.when(c("l_orderkey") % 3 == 0, "hlzf").otherwise("netzentgelte")
    rows = t.lineitem.select("l_orderkey", kind.alias("kind"), F.when(c("l_returnflag") != "N", c("l_extendedprice")).alias("leistung"), F.lit(" N/A ").alias("arbeit"), F.lit(None).cast("string").alias("leistung_unter_2500h"), F.when(c("l_linenumber") % 3 == 0, "5,5").otherwise("entfällt").alias("arbeit_unter_2500h"))
    return validation.sane_files(rows, "l_orderkey", "kind")


@query("k8_classified_names", "SELECT o_orderkey, 'c' || o_custkey || '-' || CASE WHEN o_orderkey % 3 = 0 THEN 'hlzf-2023' ELSE 'netzentgelte-' || CASE WHEN o_orderkey % 4 = 0 THEN 2025 ELSE year(o_orderdate) END END || CASE WHEN o_orderkey % 5 = 0 THEN '.xlsx' ELSE '.pdf' END AS file FROM orders")
def k8(t: Tables) -> DataFrame:
    k = c("o_orderkey")
    path = F.when(k % 5 == 0, F.concat(F.lit("/d.x/f"), k)).otherwise(F.concat(F.lit("/d/f"), k, F.lit(".pdf")))
    name = files.canonical_name(F.concat(F.lit("c"), "o_custkey"), F.when(k % 3 == 0, "hlzf:2023").otherwise("netzentgelte"), F.when(k % 4 != 0, F.year("o_orderdate")), F.lit(2025), path, F.when(k % 5 == 0, "xlsx").otherwise("html"))
    return t.orders.select("o_orderkey", name.alias("file"))


_STYLED = "CASE page_id % 4 WHEN 0 THEN '<p class=\"a\" style=\"x:y\">' WHEN 1 THEN '<div STYLE=x><link rel=\"alternate StyleSheet\" href=\"a\"><link rel=\"icon\">' WHEN 2 THEN '<style>p</style><style media=x>q</style><i data-style=\"k\">' ELSE '<b>' END || html"


@query("m4_without_styles", "SELECT page_id, CASE page_id % 4 WHEN 2 THEN 2 ELSE 0 END + 1 AS tags, CASE WHEN page_id % 4 < 2 THEN 1 ELSE 0 END AS attributes, CASE WHEN page_id % 4 = 1 THEN 1 ELSE 0 END AS sheets, CASE page_id % 4 WHEN 0 THEN '<p class=\"a\">' WHEN 1 THEN '<div><link rel=\"icon\">' WHEN 2 THEN '<i data-style=\"k\">' ELSE '<b>' END || regexp_replace(html, '(?is)<style>.*?</style>', '', 'g') AS html FROM pages")
def m4(t: Tables) -> DataFrame:
    return t.pages.select("page_id", html.without_styles(F.expr(_STYLED)).alias("s")).select("page_id", "s.tags", "s.attributes", "s.sheets", "s.html")


_DETAILS = """WITH r AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Verteilnetzbetreiber' WHEN 1 THEN 'Netzbetreiber' ELSE 'Lieferant' END AS f FROM orders WHERE o_custkey % 7 > 1),
b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE f WHEN 'Netzbetreiber' THEN 1 WHEN 'Verteilnetzbetreiber' THEN 2 ELSE 3 END, o_orderkey) AS n FROM r)
SELECT o_custkey AS id, 'B' || o_orderkey AS bdew_code, f AS market_function FROM b WHERE n = 1 AND o_orderkey % 11 > 0"""


@query("s15_detail_answers", _DETAILS)
def s15(t: Tables) -> DataFrame:
    """An answer for each customer with its orders as records; some answers are pages or errors, some codes empty."""
    k, f = c("o_orderkey"), F.when(c("o_orderkey") % 5 == 0, "Verteilnetzbetreiber").when(c("o_orderkey") % 5 == 1, "Netzbetreiber").otherwise("Lieferant")
    record = F.struct(k.alias("o"), F.when(k % 11 > 0, F.concat(F.lit("B"), k)).otherwise("").alias("BdewCode"), f.alias("MarketFunctionName"))
    id_ = c("o_custkey")
    answers = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(record)).alias("Records")).select(id_, F.to_json(F.struct(F.when(id_ % 7 == 1, "ERROR").otherwise("OK").alias("Result"), "Records")).alias("body"))
    rows = answers.select(id_.alias("id"), id_.alias("company_uid"), F.lit("c").alias("company_name"), F.when(id_ % 7 == 0, "text/html").otherwise("Application/JSON; charset=utf-8").alias("content_type"), "body")
    return listing.details(rows).select("id", "bdew_code", "market_function")
