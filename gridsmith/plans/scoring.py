"""Scores, classes and entity measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.catalogs import ADDRESS_POINTS, DATA_PATTERNS, EMBEDDED_POINTS, EMBEDDED_WORDS, IMPORTANCE_FALLBACK, IMPORTANCE_P90, IMPORTANCE_WEIGHTS, KNOWN_DOCUMENTS, PAGE_WORDS, PROTECTION_MARKERS, WORDS_AGAINST, WORDS_FOR, WORDS_NEEDED, YEAR_PATTERNS
from gridsmith.functions import html, levels, urls, verification
from gridsmith.functions.numbers import log_share
from gridsmith.operators import discovery
from gridsmith.registry import query
from gridsmith.session import Tables

c = F.col


def importance(points: Column, customers: Column, has: Column, area: Column, p90: dict[str, float] = IMPORTANCE_P90) -> Column:
    """Struct of score, confidence and the factors with their fallbacks."""
    w, fb = IMPORTANCE_WEIGHTS, IMPORTANCE_FALLBACK
    a, p, k = (log_share(x, F.lit(p90[n])) for x, n in ((area, "area"), (points, "connection_points"), (customers, "customers")))
    factor_a, factor_p = F.coalesce(a, F.lit(fb["area"])), F.coalesce(p, F.lit(0.0))
    factor_k = F.coalesce(k, F.when(has, fb["has_customers"]).when(~has, 0.0).otherwise(fb["customers"]))
    missing = sum((x.isNull().cast("int") for x in (a, p, k)), F.lit(0))
    source = F.when(k.isNotNull(), "customer_count").when(has, "has_customers_true").when(~has, "has_customers_false").otherwise("default_fallback")
    return F.struct(
        F.round((w["area"] * factor_a + w["connection_points"] * factor_p + w["customers"] * factor_k) * 100, 2).alias("score"),
        F.round(1.0 - missing / 3.0 * 0.6, 2).alias("confidence"),
        factor_a.alias("area"),
        factor_p.alias("connection_points"),
        factor_k.alias("customers"),
        source.alias("customer_source"),
    )


_IMP = "least(1.0, ln(1 + greatest({v}, 0)) / ln(1 + {p}))"


@query(
    "n7_importance",
    f"""WITH i AS (SELECT n_nationkey, count(c_custkey) AS cp, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE sum(c_acctbal) END AS area FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT n_nationkey, round(100 * (0.15 * CASE WHEN area IS NULL THEN 0.25 WHEN area <= 0 THEN 0.0 ELSE {_IMP.format(v='area', p='1500.0')} END + 0.7 * {_IMP.format(v='cp', p='20000.0')} + 0.15 * 0.35), 2) AS score,
    round(1.0 - (1 + CASE WHEN area IS NULL THEN 1 ELSE 0 END) / 3.0 * 0.6, 2) AS confidence FROM i""",
)
def n7(t: Tables) -> DataFrame:
    i = t.customer.groupBy(c("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("cp"), F.sum("c_acctbal").alias("s")).withColumn("area", F.when(c("n_nationkey") % 3 != 0, c("s")))
    return i.withColumn("i", importance(c("cp"), F.lit(None).cast("long"), F.lit(True), c("area"))).select("n_nationkey", "i.score", "i.confidence")


@query("c15_expected_levels", "SELECT c_nationkey, CASE WHEN count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') > 12 THEN 'MS,MS/NS,NS' ELSE 'MS,MS/NS' END AS levels FROM customer GROUP BY 1")
def c15(t: Tables) -> DataFrame:
    n = F.count_if(c("c_mktsegment") == "HOUSEHOLD")
    m = F.create_map(F.lit("ns"), F.when(n > 12, n).otherwise(0), F.lit("ms"), F.lit(5).cast("long"), F.lit("hs"), F.lit(None).cast("long"))
    return t.customer.groupBy("c_nationkey").agg(m.alias("m")).select("c_nationkey", F.array_join(levels.expected(c("m")), ",").alias("levels"))


@query("a18_completeness", "SELECT c_nationkey, CASE WHEN count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') > 12 THEN 33 ELSE 50 END AS score, 1 AS covered FROM customer GROUP BY 1")
def a18(t: Tables) -> DataFrame:
    n = F.count_if(c("c_mktsegment") == "HOUSEHOLD")
    m = F.create_map(F.lit("ns"), F.when(n > 12, n).otherwise(0), F.lit("ms"), F.lit(5).cast("long"))
    s = levels.completeness(c("m"), F.array(F.lit("MS"), F.lit("HS")), F.array().cast("array<string>"))
    return t.customer.groupBy("c_nationkey").agg(m.alias("m")).withColumn("s", s).select("c_nationkey", "s.score", "s.covered")


@query("a19_ui_completeness", "SELECT o_custkey, CAST(round_even((least(100.0, 100.0 * count(*) / (5 * greatest(3, count(DISTINCT year(o_orderdate))))) + least(100.0, 100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / (5 * greatest(3, count(DISTINCT year(o_orderdate)))))) / 2, 0) AS INTEGER) AS score FROM orders GROUP BY 1")
def a19(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(c("o_orderstatus") == "F").alias("f"), F.countDistinct(F.year("o_orderdate")).alias("y"))
    cells = 5 * F.greatest(F.lit(3), c("y"))
    share = lambda x: F.least(F.lit(100.0), 100.0 * c(x) / cells)
    return n.select("o_custkey", F.bround((share("n") + share("f")) / 2).cast("int").alias("score"))


@query("a20_validation_rollup", "SELECT l_orderkey, count(*) FILTER (WHERE l_quantity > 48) AS errors, count(*) FILTER (WHERE l_discount < 0.01) AS warnings, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS DOUBLE) / count(*) < 0.4 AS sparse FROM lineitem GROUP BY 1")
def a20(t: Tables) -> DataFrame:
    said = lambda cond, text: F.size(F.collect_list(F.when(cond, text))).cast("long")
    fill = F.count_if(c("l_returnflag") == "N").cast("double") / F.count("*")
    return t.lineitem.groupBy("l_orderkey").agg(said(c("l_quantity") > 48, "quantity").alias("errors"), said(c("l_discount") < 0.01, "discount").alias("warnings"), (fill < 0.4).alias("sparse"))


@query("a22_pattern_counters", "WITH p AS (SELECT source AS pattern, l.quality AS ok, lang FROM documents JOIN labels l USING (doc_id)) SELECT pattern, count(*) FILTER (WHERE ok = 1) AS success, count(*) FILTER (WHERE ok = 0) AS fail, CASE WHEN count(DISTINCT lang) > 1 THEN 'both' ELSE max(lang) END AS kind FROM p GROUP BY 1")
def a22(t: Tables) -> DataFrame:
    p = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id")
    langs = F.collect_set("lang")
    return p.groupBy(c("source").alias("pattern")).agg(F.count_if(c("quality") == 1).alias("success"), F.count_if(c("quality") == 0).alias("fail"), F.when(F.size(langs) > 1, "both").otherwise(F.max("lang")).alias("kind"))


WORDS, OFF = ["the", "and", "page"], ["/fr/", "/login"]


_DATED = "url || CASE page_id % 3 WHEN 0 THEN '/x-' || (2010 + page_id % 18) || '.x' WHEN 1 THEN '/' || (2010 + page_id % 18) || '-' || (2012 + page_id % 18) || '.x' ELSE '' END"
_YEARS = "list_distinct(list_transform(flatten([" + ", ".join(f"regexp_extract_all(lower(u), '{p}', 1)" for p in YEAR_PATTERNS) + "]), lambda x: CAST(x AS INTEGER)))"
_BONUS = f"coalesce(list_sum(list_transform({_YEARS}, lambda y: CASE WHEN y = 2024 THEN 50 WHEN y < 2015 THEN -30 WHEN y BETWEEN 2019 AND 2026 THEN 10 ELSE 3 END)), 0)"


@query("c1_crawl_score", f"SELECT page_id, CAST(CASE WHEN contains(lower(u), 'the') THEN 15 ELSE 0 END + CASE WHEN contains(lower(u), 'and') THEN 15 ELSE 0 END + CASE WHEN contains(lower(u), 'page') THEN 15 ELSE 0 END - 2 * (page_id % 4) - CASE WHEN contains(lower(u), '/fr/') OR contains(lower(u), '/login') THEN 50 ELSE 0 END - CASE WHEN contains(lower(u), 'gas') THEN 100 ELSE 0 END + {_BONUS} AS DOUBLE) AS score FROM (SELECT page_id, {_DATED} AS u FROM pages)")
def c1(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.crawl_score(F.expr(_DATED), c("page_id") % 4, F.lit(""), WORDS, 2024, 2025, OFF).alias("score"))


@query("c2_year_bonus", "SELECT o_orderkey, CASE WHEN y = 1996 THEN 50 WHEN y < 1989 THEN -30 WHEN y BETWEEN 1993 AND 2000 THEN 10 ELSE 3 END AS bonus FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)")
def c2(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", urls.year_bonus(F.concat(F.lit("https://x.de/d/"), F.year("o_orderdate"), F.lit("/a.pdf")), 1996, 1999).alias("bonus"))


_ENDS = ["/preisblatt-strom.pdf", "/hochlast-regelung", "/tarif/arbeitspreis.html", "/Preisblatt-Hochlast.pdf", "/kontakt"]
_SAYS = lambda words: " OR ".join(f"contains(lower(url), '{w}')" for w in words)
_KIND_POINTS = lambda kind: " + ".join(f"CASE WHEN {_SAYS(words)} THEN {n} ELSE 0 END" for words, n in ADDRESS_POINTS[kind])


@query("c3_type_adjust", f"SELECT page_id, CAST({_KIND_POINTS('netzentgelte')} AS DOUBLE) AS prices, CAST({_KIND_POINTS('hlzf')} - CASE WHEN contains(lower(url), 'preisblatt') AND NOT contains(lower(url), 'hochlast') THEN 10 ELSE 0 END AS DOUBLE) AS hours, CAST(0 AS DOUBLE) AS any_kind FROM (SELECT page_id, concat(url, ({_ENDS})[1 + page_id % 5]) AS url FROM pages)")
def c3(t: Tables) -> DataFrame:
    url = F.concat(F.coalesce("url", F.lit("")), F.element_at(F.array(*[F.lit(x) for x in _ENDS]), (1 + c("page_id") % 5).cast("int")))
    return t.pages.select("page_id", *[urls.kind_points(url, k).alias(n) for k, n in (("netzentgelte", "prices"), ("hlzf", "hours"), ("all", "any_kind"))])


@query("c4_discovery_score", "SELECT page_id, CAST(CASE WHEN contains(lower(url), 'the') THEN 15 ELSE 0 END + CASE WHEN contains(lower(url), 'and') THEN 15 ELSE 0 END + CASE WHEN contains(url, '76') THEN 50 ELSE 0 END - CASE WHEN contains(lower(url), 'gas') THEN 100 ELSE 0 END AS DOUBLE) AS score, contains(url, '76') AS has_year FROM pages")
def c4(t: Tables) -> DataFrame:
    return t.pages.withColumn("s", urls.discovery_score(c("url"), F.lit(""), ["the", "and"], 76)).select("page_id", "s.score", "s.has_year")


#: What documents of these kinds say, dealt to the texts by their ids.
_SAID = [
    "",
    "Preisblatt 2025: Leistungspreis 12,34 €/kW, Arbeitspreis 5,67 ct/kWh, Niederspannung",
    "Netzentgelte und Preise der Netznutzung 2024",
    "Hochlastzeitfenster nach §19 StromNEV: Winter 08:00 - 20:00 Uhr, Sommer entfällt",
    "Netzanschluss, Hausanschluss und Impressum; Entgeltblatt 1,25 ct Mittelspannung",
    "HLZF Herbst 16:00–18:00 Uhr",
    "Gas: Preisblatt, Arbeitspreis 3,10 ct/kWh, Jahresleistungspreis 44,00 Euro",
    "Karriere, Job, Datenschutz, Cookie, Netzentgelt",
    "Netzentgelt Leistungspreis Hochlast Peak Spitzenlast Uhr Winter",
]
_TEXTS = "(SELECT doc_id, concat(coalesce(text, ''), ' ', (" + str(_SAID) + ")[1 + doc_id % 9]) AS text FROM documents)"


def _said(t: Tables) -> DataFrame:
    more = F.element_at(F.array(*[F.lit(x) for x in _SAID]), (1 + c("doc_id") % 9).cast("int"))
    return t.documents.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), more).alias("text"))


_SQL_HITS = lambda words, test: f"len(list_filter({words}, lambda x: {test}))"
_PRICES = _SQL_HITS(WORDS_FOR["netzentgelte"], "contains(lower(text), x)") + " + CASE WHEN lower(text) LIKE '%netzentgelt%' AND lower(text) LIKE '%leistungspreis%' THEN 5 ELSE 0 END"
_HOURS = _SQL_HITS(WORDS_FOR["hlzf"], "contains(lower(text), x)") + " + CASE WHEN lower(text) LIKE '%hochlastzeitfenster%' OR lower(text) LIKE '%hlzf%' THEN 5 ELSE 0 END"
_DETECTED = f"SELECT *, CASE WHEN greatest(prices, hours) <= 3 OR prices = hours THEN NULL WHEN prices > hours THEN 'netzentgelte' ELSE 'hlzf' END AS detected FROM (SELECT *, {_PRICES} AS prices, {_HOURS} AS hours FROM {_TEXTS})"


def _verified_sql(kind: str, year: int) -> str:
    low, n, m = "contains(lower(text), x)", len(WORDS_FOR[kind]), len(DATA_PATTERNS[kind])
    seen = f"""SELECT doc_id, detected, {_SQL_HITS(WORDS_NEEDED[kind], low)} > 0 AS required, {_SQL_HITS(WORDS_AGAINST[kind], low)} AS against,
        {_SQL_HITS(WORDS_FOR[kind], low)} + 2 * CAST(contains(text, '{year}') AS INTEGER) AS words, {" + ".join(f"CAST(regexp_matches(lower(text), '{p}') AS INTEGER)" for p in DATA_PATTERNS[kind])} AS found FROM ({_DETECTED})"""
    raw = f"0.5::DOUBLE * least(1, words / ({n} * 0.3::DOUBLE)) + 0.5::DOUBLE * found / {m} - least(0.5::DOUBLE, against / 5.0::DOUBLE)"
    sure = f"round(greatest(0, least({raw}, CASE WHEN NOT required THEN 0.3::DOUBLE WHEN found = 0 THEN 0.5 ELSE 1 END)), 9)"
    return f"SELECT doc_id, '{kind}' AS kind, sure AS confidence, found > 0 AS has_data, required AND sure >= 0.4 AND coalesce(detected, '{kind}') = '{kind}' AS is_verified FROM (SELECT *, {sure} AS sure FROM ({seen}))"


@query("c5_content_verification", " UNION ALL ".join(_verified_sql(k, 2025) for k in verification.KINDS))
def c5(t: Tables) -> DataFrame:
    return _said(t).select("doc_id", F.explode(verification.verified(c("text"), 2025)).alias("v")).select("doc_id", "v.kind", "v.confidence", "v.has_data", "v.is_verified")


@query("c6_detect_type", f"SELECT doc_id, detected AS kind FROM ({_DETECTED})")
def c6(t: Tables) -> DataFrame:
    return _said(t).select("doc_id", verification.detected(c("text")).alias("kind"))


def keyword_match(text: Column, title_words: list[str], level_words: list[str], words: list[str], least: int = 4) -> Column:
    """A word in the title area, a level, and `least` hits."""
    low, head = F.lower(text), F.lower(F.substring(text, 1, 500))
    any_ = lambda area, ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(area, w))
    hits = F.lit(0)
    for w in words:
        hits = hits + F.regexp_count(low, F.lit(w))
    return any_(head, title_words) & any_(low, level_words) & (hits >= least)


@query("c7_keyword_match", "SELECT doc_id FROM documents WHERE (contains(lower(substr(text, 1, 500)), 'then') OR contains(lower(substr(text, 1, 500)), 'ung')) AND contains(lower(text), 'er') AND (length(lower(text)) - length(replace(lower(text), 'and', ''))) / 3 + (length(lower(text)) - length(replace(lower(text), 'ein', ''))) / 3 >= 4")
def c7(t: Tables) -> DataFrame:
    return t.documents.filter(keyword_match(c("text"), ["then", "ung"], ["er"], ["and", "ein"])).select("doc_id")


_C8 = """WITH f AS (SELECT source AS job, doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'html' ELSE 'pdf' END AS format, CASE WHEN doc_id % 5 > 0 THEN 2023 + doc_id % 3 END AS y, doc_id % 4 AS np, doc_id // 4 % 3 AS nh, coalesce(contains(text, '555'), false) AS sp, coalesce(contains(lower(text), 'license'), false) AS sh FROM documents),
k AS (SELECT job, path, format, 'netzentgelte' AS kind, CASE WHEN np >= 2 THEN np WHEN sp THEN 0 END AS n, nullif(y, 2024) AS y FROM f UNION ALL SELECT job, path, format, 'hlzf', CASE WHEN nh >= 2 THEN nh WHEN sh THEN 0 END, CASE WHEN nh <= 0 THEN nullif(y, 2024) END FROM f),
w AS (SELECT * FROM k WHERE n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job, kind, y ORDER BY n DESC, format = 'pdf' DESC, path) = 1),
v AS (SELECT w.job, w.path, w.kind FROM w LEFT JOIN w o ON w.job = o.job AND w.y IS NOT DISTINCT FROM o.y AND w.path = o.path AND w.kind <> o.kind WHERE o.path IS NULL OR w.n > o.n OR (w.n = o.n AND w.kind = 'netzentgelte')),
g AS (SELECT job, path, min(kind) AS kind FROM v GROUP BY 1, 2)
SELECT f.path AS doc_id, coalesce(kind, CASE WHEN np <= 0 AND nh <= 0 AND NOT sp AND NOT sh THEN 'irrelevant' ELSE 'unclassified' END) AS class FROM f LEFT JOIN g ON f.job = g.job AND f.path = g.path"""


@query("c8_classify_files", _C8)
def c8(t: Tables) -> DataFrame:
    k = c("doc_id")
    said = lambda x: F.coalesce(x, F.lit(False))
    files = t.documents.select(c("source").alias("job"), k.alias("path"), F.when(k % 3 == 0, "html").otherwise("pdf").alias("format"), F.when(k % 5 > 0, 2023 + k % 3).alias("year"), (k % 4).alias("n_prices"), (F.floor(k / 4) % 3).alias("n_hours"), said(c("text").contains("555")).alias("said_prices"), said(F.lower("text").contains("license")).alias("said_hours"))
    return discovery.classified(files, 2024).select(c("path").alias("doc_id"), "class")


_TURN = "concat(coalesce(text, ''), CASE WHEN conv_id % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN ' Netzentgelte 2025' WHEN turn % 3 = 2 THEN ' UMSPANNUNG' ELSE '' END)"


@query("c13_page_relevance", f"WITH p AS (SELECT conv_id, turn, {_SQL_HITS(PAGE_WORDS, f'contains(lower({_TURN}), x)')} > 0 AS hit FROM conversations), g AS (SELECT conv_id, count(*) >= 3 AND bool_or(hit) AS cut FROM p GROUP BY 1) SELECT conv_id, turn FROM p JOIN g USING (conv_id) WHERE hit OR NOT cut")
def c13(t: Tables) -> DataFrame:
    pages = t.conversations.select("conv_id", "turn", F.expr(_TURN).alias("text"))
    return discovery.relevant_pages(pages, "conv_id", "text").select("conv_id", "turn")


@query("c14_known_documents", "SELECT doc_id, CASE source WHEN 'src1' THEN 2023 WHEN 'src2' THEN 2024 END AS known_year FROM documents WHERE source IN ('src1','src2')")
def c14(t: Tables) -> DataFrame:
    known = t.spark.sql("select * from values ('src1', 2023), ('src2', 2024) as k(source, known_year)")
    return t.documents.select("doc_id", "source").join(F.broadcast(known), "source").select("doc_id", "known_year")


_COMPANY = "CASE event_id % 3 WHEN 0 THEN ' Netze BW ' WHEN 1 THEN 'netze bw' ELSE 'Netze Nord' END"
_KIND = "CASE WHEN user_id % 2 = 0 THEN 'netzentgelte' ELSE 'regelungen' END"


@query("c14_known_addresses", f"WITH k(n, kind, y, address) AS (VALUES {', '.join(map(str, KNOWN_DOCUMENTS))}) SELECT event_id, address FROM (SELECT event_id, lower(trim({_COMPANY})) AS n, {_KIND} AS kind, 2023 + event_id % 4 AS y FROM events) LEFT JOIN k USING (n, kind, y)")
def c14_addresses(t: Tables) -> DataFrame:
    asked = t.events.select("event_id", F.expr(_COMPANY).alias("n"), F.expr(_KIND).alias("kind"), (2023 + c("event_id") % 4).alias("y"))
    return discovery.known_documents(asked, "n", "kind", "y").select("event_id", "address")


@query("m1_html_text", "SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?is)<nav\\b.*?</nav\\s*>', ' ', 'g'), '(?is)<footer\\b.*?</footer\\s*>', ' ', 'g'), '(?is)<header\\b.*?</header\\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n FROM pages")
def m1(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.length(html.text_of(c("html"))).cast("long").alias("n"))


def _clean_sql(x: str) -> str:
    """Unwanted elements, tags and attributes dropped one kind after another: the pages' own tags of a kind don't nest."""
    out = f"regexp_replace({x}, '(?s)<!--.*?-->|<![a-zA-Z][^>]*>', '', 'g')"
    for tag in sorted(html.UNWANTED - html.UNWANTED_VOID):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    for rx, by in ((f"<({'|'.join(sorted(html.UNWANTED_VOID))})\\b[^>]*>", ""), ('<a\\b[^>]*?\\bhref="([^"]*)"[^>]*>', '<a href="\\1">'), ("<(a[a-z0-9]+|[b-z][a-z0-9]*)\\b[^>]*>", "<\\1>"), ("&([a-z][a-z0-9]*)([^a-z0-9;]|$)", "&\\1;\\2")):
        out = f"regexp_replace({out}, '(?i){rx}', '{by}', 'g')"
    return out


@query("m2_clean_html", f"SELECT page_id, md5(x) AS cleaned, CAST(length(x) AS INTEGER) AS n FROM (SELECT page_id, {_clean_sql('html')} AS x FROM pages)")
def m2(t: Tables) -> DataFrame:
    x = t.pages.select("page_id", html.cleaned(c("html")).alias("x"))
    return x.select("page_id", F.md5(F.encode("x", "UTF-8")).alias("cleaned"), F.length("x").alias("n"))


@query("m3_tables_with_years", "SELECT page_id, '2025' AS year, CAST(page_id AS VARCHAR) AS value FROM pages")
def m3(t: Tables) -> DataFrame:
    made = F.concat(F.lit("<h2>Preise 2025</h2><table><tr><td>HS</td><td>"), c("page_id"), F.lit("</td></tr></table>"), c("html"))
    found = t.pages.select("page_id", F.explode(html.tables(made)).alias("t"))
    return found.select("page_id", F.regexp_extract("t.header", "(20[0-9]{2})", 1).alias("year"), c("t.rows")[0][1].alias("value"))


@query("m5_links", "SELECT page_id, CAST((length(html) - length(replace(html, '<a href=', ''))) / 8 AS BIGINT) AS n FROM pages")
def m5(t: Tables) -> DataFrame:
    found = t.pages.select("page_id", "url", F.explode_outer(html.links(c("html"))).alias("l"))
    return found.groupBy("page_id").agg(F.count(html.resolve(c("url"), c("l.href"))).alias("n"))


#: What pages with tables hold, dealt by their ids.
_TABLED = [
    "",
    "<div><h2>Hochlastzeitfenster ab 2025</h2><table><tr><td>Winter</td><td>08:00 Uhr</td></tr></table></div>",
    "<div><p>gültig ab 01.01.2024</p><table><tr><td>Mittelspannung</td><td>1,20 ct/kWh</td></tr></table></div>",
    "<div>Preisblatt<table><tr><td>Sommer</td></tr></table></div><h3>Stand 2019</h3>",
    "<div><table><tr><td>Umspannung 01.11. bis 31.03.</td></tr></table></div><h4>Preise ab 2026</h4>",
    "<h2>Tarif 2025</h2>",
]


def _embedded_sql(kind: str, tables_with: str) -> str:
    """The places of tables and years are known, for the pages themselves have neither."""
    n, p = f"len(list_filter({EMBEDDED_WORDS[kind]['page']}, lambda x: contains(low, x)))", EMBEDDED_POINTS[kind]
    text = "regexp_replace(regexp_replace(concat((" + str(_TABLED) + ")[1 + page_id % 6], coalesce(html, '')), '(?is)<(script|style)\\b.*?</(script|style)\\s*>|<!--.*?-->', '', 'g'), '(?s)<[^>]+>', '', 'g')"
    return f"""SELECT page_id, '{kind}' AS kind, n AS words, CAST(k BETWEEN 1 AND 4 AS INTEGER) AS tables, has, coalesce(year, '') AS years,
        round(CASE WHEN k NOT BETWEEN 1 AND 4 THEN 0 ELSE CASE WHEN has THEN 0.4 ELSE 0 END + least(n * 0.1, 0.3) + CASE WHEN k = 1 THEN 0.3 WHEN year IS NOT NULL THEN 0.1 ELSE 0 END END::DOUBLE, 9) AS confidence,
        CAST(CASE WHEN has THEN {p['table']} ELSE 0 END + n * {p['word']} + CASE WHEN k = 1 THEN {p['year']} ELSE 0 END AS DOUBLE) AS points
        FROM (SELECT *, {n} AS n, k IN {tables_with} AS has, CASE k WHEN 1 THEN '2025' WHEN 2 THEN '2024' WHEN 4 THEN '2026' END AS year FROM (SELECT page_id, page_id % 6 AS k, lower({text}) AS low FROM pages))"""


@query("m7_embedded_data", _embedded_sql("hlzf", "(1, 4)") + " UNION ALL " + _embedded_sql("netzentgelte", "(2)"))
def m7(t: Tables) -> DataFrame:
    made = F.concat(F.element_at(F.array(*[F.lit(x) for x in _TABLED]), (1 + c("page_id") % 6).cast("int")), F.coalesce("html", F.lit("")))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), html.embedded(c("p"), k, 2025).alias("e")) for k in ("hlzf", "netzentgelte")])
    e = t.pages.select("page_id", html.placed(made).alias("p")).select("page_id", F.explode(kinds).alias("x")).select("page_id", "x.kind", "x.e.*")
    return e.select("page_id", "kind", F.size("words").alias("words"), "tables", c("has_data").alias("has"), F.array_join(c("years").cast("array<string>"), ",").alias("years"), "confidence", "points")


_MARKED = """CASE page_id % 11 WHEN 0 THEN 'Please Enable JavaScript' WHEN 1 THEN '<p>JavaScript is REQUIRED</p>' WHEN 2 THEN '<script>window._cf_chl_opt={}</script>' WHEN 3 THEN '/cdn-cgi/Challenge-Platform/' WHEN 4 THEN 'set __cf_bm' WHEN 5 THEN 'Just a moment... Cloudflare'
WHEN 6 THEN 'Checking your browser' WHEN 7 THEN 'DDoS protection by x' WHEN 8 THEN '<meta http-equiv="refresh" content="0;/challenge">' WHEN 9 THEN '<meta http-equiv="refresh" content="0;/x">' ELSE '' END || html"""
_MARKERS = " OR ".join(f"contains(x, '{m}')" for m in PROTECTION_MARKERS)


@query("m10_protection", f"""SELECT page_id, CASE WHEN {_MARKERS} THEN CASE WHEN contains(x, 'cloudflare') OR contains(x, 'cf_chl') THEN 'cloudflare' ELSE 'javascript_required' END
WHEN contains(x, 'meta http-equiv="refresh"') AND contains(x, 'challenge') THEN 'javascript_challenge' END AS p FROM (SELECT page_id, lower({_MARKED}) AS x FROM pages)""")
def m10(t: Tables) -> DataFrame:
    return t.pages.select("page_id", html.protection(F.expr(_MARKED)).alias("p"))


#: Heads of pages, the system and generator that each tells.
_HEADS = [
    ('<meta name="generator" content="TYPO3 CMS {k}">', "TYPO3", "TYPO3 CMS {k}"), ("<META CONTENT='WordPress 6.{k}' NAME='generator' />", "WordPress", "WordPress 6.{k}"), ('<meta name="viewport" content="drupal"><meta name=generator content="Joomla! {k}">', "Joomla", "Joomla! {k}"),
    ('<meta data-x name="generator" content="Drupal {k}">', "Drupal", "Drupal {k}"), ('<meta name="generator" content="Contao {k}"><link href="/typo3temp/a.css">', "Contao", "Contao {k}"), ('<meta name="generator" content="Wix.com {k}">', "Wix", "Wix.com {k}"), ('<meta name="generator" content="Squarespace {k}">', "Squarespace", "Squarespace {k}"),
    ('<meta name="generator" content="Hugo {k}"><script src="/typo3conf/{k}.js"></script>', "TYPO3", "Hugo {k}"), ('<link rel="x" href="/wp-content/{k}.css">', "WordPress", None), ('<script async src="/wp-includes/{k}.js">', "WordPress", None), ('<a href="/typo3/{k}"></a><meta name="x-generator" content="TYPO3">', None, None), ('<!-- <meta name="generator" content="TYPO3"> -->', None, None), ("", None, None),
]
_text = lambda v: "CAST(NULL AS VARCHAR)" if v is None else "'" + v.replace("'", "''").replace("{k}", "' || page_id || '") + "'"
_head = lambda i: f"CASE page_id % {len(_HEADS)} " + " ".join(f"WHEN {k} THEN {_text(h[i])}" for k, h in enumerate(_HEADS)) + " END"


@query("m11_tech_stack", f"SELECT page_id, {_head(1)} AS cms, 'nginx/' || page_id % 5 AS server, {_head(2)} AS generator FROM pages")
def m11(t: Tables) -> DataFrame:
    head = F.coalesce(*[F.when(c("page_id") % len(_HEADS) == k, F.replace(F.lit(h), F.lit("{k}"), c("page_id").cast("string"))) for k, (h, _, _) in enumerate(_HEADS)])
    return t.pages.select("page_id", html.tech_stack(F.concat(head, c("html")), F.expr("'nginx/' || page_id % 5")).alias("t")).select("page_id", "t.*")


@query("a26_page_counters", "SELECT page_id, CAST((length(html) - length(replace(html, '<a ', ''))) / 3 AS INTEGER) AS links, CAST((length(lower(html)) - length(replace(lower(html), '<table', ''))) / 6 AS INTEGER) AS tables FROM pages")
def a26(t: Tables) -> DataFrame:
    return t.pages.withColumn("k", html.counters(c("html"), ["tion"])).select("page_id", "k.links", "k.tables")


@query("f13_link_filter", "SELECT page_id FROM pages WHERE contains(html, 'href=\"/th')")
def f13(t: Tables) -> DataFrame:
    found = t.pages.select("page_id", "url", F.explode(html.links(c("html"))).alias("l"))
    full = found.select("page_id", html.resolve(c("url"), c("l.href")).alias("to"))
    ok = full.filter(urls.part(c("to"), "scheme").isin("http", "https") & ~urls.domain(c("to")).isin("facebook.com", "twitter.com") & urls.part(c("to"), "path").startswith("/th"))
    return ok.select("page_id").distinct()


@query("f14_language_preference", "WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h, CASE WHEN contains(url, '/de/') THEN 1 WHEN contains(url, '/en/') THEN 2 ELSE 3 END AS k FROM pages), g AS (SELECT h, min(k) AS best FROM p GROUP BY 1) SELECT page_id FROM p JOIN g USING (h) WHERE k = best")
def f14(t: Tables) -> DataFrame:
    kind = F.when(c("url").contains("/de/"), 1).when(c("url").contains("/en/"), 2).otherwise(3)
    p = t.pages.select("page_id", urls.host(c("url")).alias("h"), kind.alias("k"))
    return p.join(p.groupBy("h").agg(F.min("k").alias("k")), ["h", "k"]).select("page_id")


@query("s13_cached_files", "SELECT o_orderkey, 'c' || CAST(o_custkey AS VARCHAR) AS slug, 'netz' AS kind, year(o_orderdate) AS y FROM orders")
def s13(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/d/c"), c("o_custkey"), F.lit("-netz-"), F.year("o_orderdate"), F.lit(".pdf"))
    g = lambda i: F.regexp_extract(path, r"([^/]+)-(netz|hlzf)-([0-9]{4})\.[a-z]+$", i)
    return t.orders.select("o_orderkey", g(1).alias("slug"), g(2).alias("kind"), g(3).cast("int").alias("y"))


@query("s17_robots_verdict", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'protected' WHEN 2 THEN 'open' WHEN 3 THEN 'error' ELSE 'protected' END AS verdict FROM events")
def s17(t: Tables) -> DataFrame:
    k = c("event_id") % 5
    status = F.when(k == 0, 200).when(k == 1, 403).when(k == 2, 404).when(k == 3, 503).otherwise(200)
    return t.events.select("event_id", html.robots_verdict(status, F.when(k == 4, "Just a moment ...").otherwise("User-agent: *")).alias("verdict"))


_X4 = """WITH e AS (SELECT user_id % 5 AS site, 'u' || CAST(event_id % 500 AS VARCHAR) AS url, event_type AS kind, event_id % 97 AS v FROM events),
a AS (SELECT site, url, 80 AS score, 0 AS i FROM e WHERE kind = 'purchase' UNION ALL SELECT site, url, v, 1 FROM e WHERE kind = 'view' UNION ALL SELECT site, url, 60, 2 FROM e WHERE kind = 'click' UNION ALL SELECT site, url, v, 3 FROM e WHERE v > 20),
f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY i, score DESC) = 1),
k AS (SELECT f.*, n_nationkey AS n FROM f LEFT JOIN nation ON url = 'u' || CAST(n_nationkey AS VARCHAR))
SELECT site, url, CAST(score - CASE WHEN n % 3 = 1 THEN 30 ELSE 0 END AS DOUBLE) AS score, CASE i WHEN 0 THEN 'profile' WHEN 1 THEN 'sitemap' WHEN 2 THEN 'pattern' ELSE 'crawl' END AS source FROM k WHERE n IS NULL OR n % 3 > 0 QUALIFY row_number() OVER (PARTITION BY site ORDER BY i, score DESC, url) <= 80"""


@query("x4_discovery_cascade", _X4)
def x4(t: Tables) -> DataFrame:
    e = t.events.select((c("user_id") % 5).alias("site"), F.concat(F.lit("u"), c("event_id") % 500).alias("url"), c("event_type").alias("kind"), (c("event_id") % 97).alias("score"))
    of = lambda cond, score=None: e.filter(cond) if score is None else e.filter(cond).withColumn("score", F.lit(score))
    sources = [("profile", of("kind = 'purchase'", 80)), ("sitemap", of("kind = 'view'")), ("pattern", of("kind = 'click'", 60)), ("crawl", of("score > 20"))]
    n = c("n_nationkey")
    known = t.nation.select(F.concat(F.lit("u"), n).alias("url"), F.when(n % 3 == 0, "irrelevant").when(n % 3 == 1, "unclassified").otherwise("hlzf").alias("class"))
    return discovery.cascade(sources, known)


_X5 = """WITH f AS (SELECT user_id AS site, event_id AS id, (CASE WHEN event_id % 11 = 0 THEN 'HLZF-' ELSE 'doc-' END) || CAST(event_id AS VARCHAR) AS url, CAST(event_id % 97 AS DOUBLE) AS score FROM events WHERE event_type = 'view'),
t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY site ORDER BY score DESC, url) <= 10),
b AS (SELECT site FROM t GROUP BY 1 HAVING NOT bool_or(contains(lower(url), 'hlzf'))),
a AS (SELECT site, url, score FROM f UNION ALL SELECT user_id, 'page-' || CAST(event_id AS VARCHAR), event_id % 90 + 50 FROM events WHERE event_type = 'click' AND event_id % 90 > 30 AND user_id IN (SELECT site FROM b))
SELECT site, url, score FROM a QUALIFY row_number() OVER (PARTITION BY site ORDER BY score DESC, url) <= 20"""


@query("x5_fallback_scan", _X5)
def x5(t: Tables) -> DataFrame:
    k = c("event_id")
    rows = t.events.select(c("user_id").alias("site"), "event_id", "event_type")
    found = rows.filter("event_type = 'view'").select("site", F.concat(F.when(k % 11 == 0, "HLZF-").otherwise("doc-"), k).alias("url"), (k % 97).alias("score"))
    pages = rows.filter("event_type = 'click'").select("site", F.concat(F.lit("page-"), k).alias("url"), (k % 90).alias("points"))
    return discovery.with_scan(found, pages)


_X12 = """WITH n AS (SELECT conv_id, turn, coalesce(contains(text, 'qui'), false) AS hit, turn <= 1 AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 50 AS one FROM conversations WHERE turn <= 5),
d AS (SELECT *, bool_or(one AND hit) OVER (PARTITION BY conv_id) AS done FROM n)
SELECT conv_id, turn, CASE WHEN done THEN 1 ELSE 2 END AS crawl_pass FROM d WHERE CASE WHEN done THEN one ELSE NOT one END"""


@query("x12_deepen", _X12)
def x12(t: Tables) -> DataFrame:
    pages = t.conversations.select(c("conv_id").alias("job"), c("turn").alias("url"), c("turn").alias("depth"), F.coalesce(c("text").contains("qui"), F.lit(False)).alias("classified"))
    return discovery.deepened(pages, ((1, 50), (5, 150))).select(c("job").alias("conv_id"), c("url").alias("turn"), "crawl_pass")
