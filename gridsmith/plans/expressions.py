"""The expression library over columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.functions import levels, numbers, replies, text, times, urls, validation
from gridsmith.registry import query
from gridsmith.session import Tables
from gridsmith.sources import files

c = F.col
_GERMAN = "CASE p_size % 5 WHEN 0 THEN '1.' || CAST(p_size AS VARCHAR) || ',56' WHEN 1 THEN CAST(p_size AS VARCHAR) || ',5' WHEN 2 THEN CAST(p_size AS VARCHAR) || '.25' WHEN 3 THEN 'k.A.' ELSE p_name END"


def _german(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_size", F.expr(_GERMAN.replace("VARCHAR", "STRING")).alias("s"))


_GERMAN_VALUE = "CASE p_size % 5 WHEN 0 THEN CAST('1' || CAST(p_size AS VARCHAR) || '.56' AS DOUBLE) WHEN 1 THEN p_size + 0.5 WHEN 2 THEN p_size + 0.25 END"


@query("n1_german_number", f"SELECT p_partkey, {_GERMAN_VALUE} AS v FROM part")
def n1(t: Tables) -> DataFrame:
    return _german(t).select("p_partkey", numbers.german_number(c("s")).alias("v"))


@query("n2_german_float", f"SELECT p_partkey, {_GERMAN_VALUE} AS v FROM part")
def n2(t: Tables) -> DataFrame:
    return _german(t).select("p_partkey", numbers.german_float(c("s")).alias("v"))


@query("n3_clean_price", f"SELECT p_partkey, CASE WHEN p_size % 5 = 3 THEN '-' ELSE trim({_GERMAN}) END AS v FROM part")
def n3(t: Tables) -> DataFrame:
    return _german(t).select("p_partkey", numbers.clean_price(c("s")).alias("v"))


@query("n4_parse_year", "SELECT o_orderkey, year(o_orderdate) AS y FROM orders")
def n4(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", numbers.parse_year(F.concat(F.lit("Stand "), F.date_format("o_orderdate", "dd.MM.yyyy"))).alias("y"))


@query("n5_falsy_zero", "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0), nullif(l_tax, 0)) AS v FROM lineitem")
def n5(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", numbers.falsy(c("l_discount"), F.nullif(c("l_tax"), F.lit(0.0))).alias("v"))


@query("n6_log_share", "SELECT c_custkey, round(CASE WHEN c_acctbal <= 0 THEN 0.0 ELSE least(1.0, ln(1 + c_acctbal) / ln(1 + 5000.0)) END, 9) AS v FROM customer")
def n6(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.round(numbers.log_share(c("c_acctbal"), F.lit(5000.0)), 9).alias("v"))


@query("n8_percent", "SELECT l_orderkey, CAST(round_even(100.0 * count(*) FILTER (WHERE l_returnflag = 'N') / count(*), 0) AS INTEGER) AS v FROM lineitem GROUP BY 1")
def n8(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.bround(100.0 * F.count_if(c("l_returnflag") == "N") / F.count("*")).cast("int").alias("v"))


@query("n9_coordinate_snap", "SELECT c_custkey, CAST(CAST(CAST(c_acctbal AS DECIMAL(18,2)) / 64 AS DECIMAL(18,6)) AS DOUBLE) AS v FROM customer")
def n9(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", (c("c_acctbal").cast("decimal(18,2)") / 64).cast("decimal(18,6)").cast("double").alias("v"))


@query("n10_safe_decimal", "SELECT p_partkey, CASE WHEN p_size % 5 = 2 THEN CAST(p_size + 0.25 AS DOUBLE) END AS v FROM part")
def n10(t: Tables) -> DataFrame:
    return _german(t).select("p_partkey", c("s").try_cast("decimal(18,4)").cast("double").alias("v"))


@query("n11_bytes_text", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN CAST(n_chars AS VARCHAR) || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', round(n_chars / 1024, 1)) ELSE printf('%.1f MB', round(n_chars / 1048576, 1)) END AS v FROM documents")
def n11(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", numbers.bytes_text(c("n_chars")).alias("v"))


@query("t1_safe_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def t1(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", times.safe_date(F.when(c("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))).alias("d"))


@query("t2_any_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE day(o_orderdate) > 12")
def t2(t: Tables) -> DataFrame:
    k = c("o_orderkey") % 4
    s = F.when(k == 0, F.date_format("o_orderdate", "M/d/yyyy")).when(k == 1, F.date_format("o_orderdate", "d/M/yyyy")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "d.M.yyyy"))
    return t.orders.filter(F.dayofmonth("o_orderdate") > 12).select("o_orderkey", times.any_date(s).alias("d"))


_HM = "lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0')"


@query("t3_time_window", f"SELECT event_id, CASE WHEN event_type = 'error' THEN '-' ELSE {_HM} || '-23:59' END AS w FROM events")
def t3(t: Tables) -> DataFrame:
    s = F.when(c("event_type") == "error", "k.A.").when(c("event_id") % 2 == 0, F.concat(F.date_format("ts", "H:mm"), F.lit(" Uhr bis 23:59 Uhr"))).otherwise(F.concat(F.date_format("ts", "H.mm"), F.lit(" – 23.59")))
    return t.events.select("event_id", times.time_window(s).alias("w"))


@query("t4_time_ranges", f"SELECT event_id, {_HM} || ':00' AS s, '23:59:00' AS e FROM events WHERE event_type <> 'view'")
def t4(t: Tables) -> DataFrame:
    s = F.when(c("event_id") % 2 == 0, F.concat(F.date_format("ts", "H:mm"), F.lit(" - 23:59"))).otherwise(F.concat(F.date_format("ts", "HH:mm:'00'"), F.lit(" 23:59")))
    return t.events.filter("event_type != 'view'").withColumn("r", times.time_ranges(s)).select("event_id", c("r")[0]["start"].alias("s"), c("r")[0]["end"].alias("e"))


@query("t7_ranges_text", f"SELECT event_id, {_HM} || '-23:59' AS w FROM events WHERE event_type = 'click'")
def t7(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'click'").select("event_id", times.ranges_text(times.time_ranges(F.concat(F.date_format("ts", "HH:mm"), F.lit("-23:59")))).alias("w"))


@query("t8_six_digit_year", "SELECT event_id, 2024 AS y FROM events")
def t8(t: Tables) -> DataFrame:
    return t.events.select("event_id", times.six_digit_year(F.date_format("ts", "yyMMdd")).alias("y"))


@query("t9_years_near", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2026 END AS y FROM events")
def t9(t: Tables) -> DataFrame:
    return t.events.select("event_id", times.years_near(F.concat(F.lit("Preise 2025, "), F.year("ts"), F.lit(" und 2026")), c("event_id") % 2 == 1).alias("y"))


@query("t10_duration", "SELECT user_id, CAST(date_diff('second', min(ts), max(ts)) AS BIGINT) AS s FROM events GROUP BY 1")
def t10(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("s"))


@query("t11_plot_interval", "SELECT event_id, hour(ts) * 3600 + minute(ts) * 60 AS s FROM events")
def t11(t: Tables) -> DataFrame:
    return t.events.select("event_id", times.seconds_of_day(F.date_format("ts", "HH:mm")).cast("long").alias("s"))


@query("g1_slugs", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def g1(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.slug(c("p_name")).alias("slug"))


@query("g2_address_key", "SELECT s_suppkey, sha256('musterstr|' || CAST(s_nationkey AS VARCHAR) || '|12345') AS k FROM supplier")
def g2(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", text.address_key(F.concat(F.lit("Musterstraße "), c("s_nationkey")), F.lit("12345")).alias("k"))


@query("g3_company_name", "SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g') AS n FROM supplier")
def g3(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", text.company_name(F.concat(c("s_name"), F.lit(" GmbH & Co. KG 2023"))).alias("n"))


@query("g5_clean_string", "SELECT doc_id, CASE WHEN length(x) > 60 THEN substr(x, 1, 57) || '...' ELSE x END AS s FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents)")
def g5(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.clean_string(c("text"), 60).alias("s"))


_SIMPLE = "regexp_replace(regexp_replace(url, '#.*$', ''), '[?&](utm_[a-z]+|ref)=[^&]*', '', 'g')"


@query("g6_normalize_url", f"SELECT page_id, regexp_replace(lower(regexp_extract({_SIMPLE}, '^[a-z]+://[^/?]*', 0)) || regexp_extract({_SIMPLE}, '^[a-z]+://[^/?]*(.*)$', 1), '^(https?://[^/]*)$', '\\1/') AS u FROM pages")
def g6(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.normalize(c("url")).alias("u"))


@query("g7_domain", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS d FROM pages")
def g7(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.domain(c("url")).alias("d"))


@query("g8_file_type", "SELECT page_id, CASE WHEN lower(url) LIKE '%.pdf%' THEN 'pdf' WHEN lower(url) LIKE '%.xls%' THEN 'xls' WHEN lower(url) LIKE '%.doc%' THEN 'doc' ELSE 'unknown' END AS k FROM pages")
def g8(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.file_type(c("url")).alias("k"))


@query("g9_magic_bytes", "SELECT doc_id, CASE WHEN text LIKE 'A%' THEN 'pdf' WHEN text LIKE 'E%' THEN 'zip' ELSE 'other' END AS k FROM documents")
def g9(t: Tables) -> DataFrame:
    starts = lambda x: F.startswith(c("text").cast("binary"), F.lit(x).cast("binary"))
    return t.documents.select("doc_id", F.when(starts("A"), "pdf").when(starts("E"), "zip").otherwise("other").alias("k"))


_BYTES = "CASE doc_id % 9 WHEN 0 THEN '%PDF-1.7' WHEN 1 THEN 'PK' || chr(3) || chr(4) || '..xl/workbook.xml' WHEN 2 THEN 'PK' || chr(3) || chr(4) || 'word/document.xml' WHEN 3 THEN 'PK' || chr(3) || chr(4) WHEN 4 THEN '' ELSE ' %PDF' END || text"
_TYPE = "CASE doc_id % 7 WHEN 0 THEN 'Application/PDF' WHEN 1 THEN 'application/vnd.ms-excel' WHEN 2 THEN 'application/x-zip' WHEN 3 THEN 'TEXT/HTML; charset=x' ELSE 'application/octet-stream' END"
_NAME = "'https://x.de/d' || doc_id || CASE doc_id % 8 WHEN 0 THEN '.PDF?x=.zip' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.xls' WHEN 3 THEN '.docx' WHEN 4 THEN '.zip?v=1' WHEN 5 THEN '.htm' ELSE '' END"
_BY_NAME = "CASE WHEN bare LIKE '%.pdf' THEN 'pdf' WHEN bare LIKE '%.xlsx' THEN 'xlsx' WHEN bare LIKE '%.xls' THEN 'xls' WHEN bare LIKE '%.docx' THEN 'docx' WHEN bare LIKE '%.zip' THEN 'zip' ELSE 'html' END"
_FORMAT = f"""CASE WHEN starts_with(x, '%PDF') THEN 'pdf' WHEN starts_with(x, 'PK' || chr(3) || chr(4)) THEN CASE WHEN contains(left(x, 2500), 'workbook.xml') THEN 'xlsx' WHEN contains(left(x, 2500), 'word/') THEN 'docx' WHEN bare LIKE '%.zip' THEN 'zip' ELSE 'xlsx' END
WHEN lower(kind) LIKE '%pdf%' THEN 'pdf' WHEN lower(kind) LIKE '%excel%' THEN 'xlsx' WHEN lower(kind) LIKE '%zip%' THEN 'zip' WHEN lower(kind) LIKE '%text/html%' THEN 'html' ELSE {_BY_NAME} END"""


@query("g9_file_formats", f"SELECT doc_id, {_FORMAT} AS format FROM (SELECT doc_id, coalesce({_BYTES}, '') AS x, {_TYPE} AS kind, lower(split_part({_NAME}, '?', 1)) AS bare FROM documents)")
def g9_formats(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", files.file_format(F.coalesce(F.expr(_BYTES), F.lit("")).cast("binary"), F.expr(_TYPE), F.expr(_NAME)).alias("format"))


@query("g10_year_template", "SELECT o_orderkey, '/d/{year}/a.pdf' AS u FROM orders")
def g10(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    return t.orders.select("o_orderkey", urls.year_template(F.concat(F.lit("/d/"), y, F.lit("/a.pdf")), y).alias("u"))


_G11 = """WITH p AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
d AS (SELECT page_id, CASE WHEN contains(list_last(string_split(path, '/')), '.') THEN regexp_replace(path, '[^/]*$', '') ELSE path END AS path FROM p),
w AS (SELECT page_id, regexp_replace(path, '/20[0-9]{2}/', '/{year}/', 'g') AS whole, list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT regexp_matches(x, '^20[0-9]{2}$')) AS segments FROM d),
b AS (SELECT *, string_split(trim(whole, '/'), '/') AS parts FROM w),
a AS (SELECT page_id, unnest(list_concat([whole], list_transform(segments, lambda x: '/' || x || '/'), list_transform(range(1, len(parts)), lambda i: '/' || array_to_string(parts[1:i], '/') || '/'))) AS pattern FROM b)
SELECT DISTINCT page_id, pattern FROM a WHERE pattern NOT IN ('', '/')"""


@query("g11_path_patterns", _G11)
def g11(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(urls.path_patterns(c("url"))).alias("pattern"))


@query("g12_hashes", "SELECT doc_id, md5(text) AS m, sha256(text) AS s, substr(sha256(text), 1, 12) AS h FROM documents")
def g12(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5("text").alias("m"), F.sha2("text", 256).alias("s"), text.short_hash(c("text")).alias("h"))


@query("g14_flags_and_lists", "SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS yes, 2 AS n FROM lineitem")
def g14(t: Tables) -> DataFrame:
    parts = text.listed(F.concat(c("l_returnflag"), F.lit("; ;"), c("l_linestatus")), ";")
    return t.lineitem.select("l_orderkey", "l_linenumber", text.yes(F.when(c("l_returnflag") == "R", " Ja ").otherwise("Nein")).alias("yes"), F.size(parts).alias("n"))


_LEVEL = "CASE c_nationkey % 8 WHEN 0 THEN 'Hochspannung' WHEN 1 THEN '110 kV / 20 kV' WHEN 2 THEN 'Umspannung 20/0,4kV' WHEN 3 THEN 'Mittelspannung (MSP)' WHEN 4 THEN '400 V' WHEN 5 THEN 'Umspannung Hoch - / Mittelspannung' WHEN 6 THEN 'Entnahme in MS ab 2025' ELSE c_name END"


@query("g15_level_normalization", "SELECT c_custkey, CASE c_nationkey % 8 WHEN 0 THEN 'HS' WHEN 1 THEN 'HS/MS' WHEN 2 THEN 'MS/NS' WHEN 3 THEN 'MS' WHEN 4 THEN 'NS' WHEN 5 THEN 'HS/MS' WHEN 6 THEN 'MS' END AS level FROM customer")
def g15(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", levels.normalize(F.expr(_LEVEL)).alias("level"))


@query("g16_file_names", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'netzentgelte' ELSE 'hlzf' END AS kind, 2021 AS y FROM orders")
def g16(t: Tables) -> DataFrame:
    name = F.concat(F.lit("20201026_x_"), F.when(c("o_orderkey") % 2 == 0, "Preisblatt-Strom").otherwise("HLZF"), F.lit("_2021.pdf"))
    return t.orders.select("o_orderkey", text.file_type(name).alias("kind"), text.file_year(name).alias("y"))


@query("g17_prompt_value", "SELECT s_suppkey, s_name AS v FROM supplier")
def g17(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", text.prompt_value(F.concat(F.lit("{<"), c("s_name"), F.lit(">}\n"))).alias("v"))


@query("g20_client_ip", "SELECT user_id, event_id, '10.0.0.' || CAST(user_id AS VARCHAR) AS ip FROM events WHERE event_type = 'error'")
def g20(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'error'").select("user_id", "event_id", text.client_ip(F.concat(F.lit("1.1.1.1, 10.0.0."), c("user_id"))).alias("ip"))


@query("m12_json_reply", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def m12(t: Tables) -> DataFrame:
    reply = F.concat(F.lit("```json\n"), c("props"), F.lit("\n```"))
    bare = F.trim(F.regexp_replace(reply, r"(?s)^\s*```(json)?|```\s*$", ""))
    return t.events.select("event_id", F.get_json_object(bare, "$.k").alias("k"))


_REPLY = """CASE event_id % 7 WHEN 0 THEN '{"data":[' || props || ',{"v":["e' || event_id || '",{"w":" ' || chr(92) || '"q' || chr(92) || '" "}]}],"_extraction_meta":{"model":["no",{"a":"no"}]},"z":"last"}'
WHEN 1 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || '{"z":"first","data":[{"n":1},' || props || ']}' || chr(10) || '```' || chr(10) || 'Done.' WHEN 2 THEN props WHEN 3 THEN '[' || props || ',"x"]' WHEN 4 THEN 'see ' || props WHEN 5 THEN '{"data":[' || props || ', ' || event_id || ']}' ELSE '{"data":"none","text":" t' || event_id || ' "}' END"""

_FENCED = "trim(regexp_extract(reply, '(?s)```json(.*?)```', 1), chr(10))"
_REPLIES = f"""WITH r AS (SELECT event_id, {_REPLY} AS reply FROM events),
b AS (SELECT event_id, CASE WHEN json_valid(reply) THEN reply WHEN json_valid({_FENCED}) THEN {_FENCED} END AS body FROM r),
v AS (SELECT *, CASE WHEN body IS NULL THEN 'not JSON' WHEN json_type(body) <> 'OBJECT' THEN 'not an object' WHEN json_type(body, '$.data') <> 'ARRAY' THEN 'data is no list'
  WHEN len(list_filter(json_extract(body, '$.data[*]'), lambda x: json_type(x) <> 'OBJECT')) > 0 THEN 'no object' END AS wrong FROM b),
l AS (SELECT event_id, string_agg(trim(j.atom ->> '$'), '|' ORDER BY j.id) AS texts FROM b, json_tree(b.body) j WHERE j.type = 'VARCHAR' AND NOT contains(j.fullkey, '_extraction_meta') AND trim(j.atom ->> '$') <> '' GROUP BY 1)
SELECT event_id, wrong, CASE WHEN wrong IS NULL THEN len(json_extract(body, '$.data[*]')) END AS n, CASE WHEN body IS NOT NULL THEN coalesce(texts, '') END AS texts FROM v LEFT JOIN l USING (event_id)"""


@query("m12_replies", _REPLIES)
def m12_replies(t: Tables) -> DataFrame:
    """Replies of seven kinds: whole, fenced, without records, lists, malformed, of wrong shapes."""
    b = t.events.select("event_id", replies.body(F.expr(_REPLY)).alias("b"))
    wrong = F.split_part(replies.verdict(c("b")), F.lit(":"), F.lit(1))
    return b.select("event_id", wrong.alias("wrong"), F.when(wrong.isNull(), F.coalesce(F.size(replies.records(c("b"))), F.lit(0))).cast("long").alias("n"), F.array_join(replies.texts(c("b")), "|").alias("texts"))


@query("f3_contains_escaped", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'an')")
def f3(t: Tables) -> DataFrame:
    return t.part.filter(F.lower("p_name").contains("an")).select("p_partkey")


@query("f6_any_price", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.09 OR l_tax > 0.07")
def f6(t: Tables) -> DataFrame:
    return t.lineitem.filter((c("l_discount") > 0.09) | (c("l_tax") > 0.07)).select("l_orderkey", "l_linenumber")


@query("f7_no_value", "SELECT p_partkey FROM part WHERE p_size % 5 = 3")
def f7(t: Tables) -> DataFrame:
    return _german(t).filter(numbers.no_value(c("s"))).select("p_partkey")


@query("f8_plausible_range", "SELECT l_orderkey, l_linenumber, l_discount BETWEEN 0.01 AND 20 AS arbeit_ok, l_quantity BETWEEN 0 AND 45 AS leistung_ok FROM lineitem")
def f8(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", c("l_discount").between(0.01, 20).alias("arbeit_ok"), c("l_quantity").between(0, 45).alias("leistung_ok"))


@query("f9_sanity_gate", "SELECT l_orderkey, CASE WHEN count(*) < 2 THEN 'too few records' WHEN count(*) FILTER (WHERE l_discount > 0) < 2 THEN 'too few prices' ELSE 'ok' END AS verdict FROM lineitem GROUP BY 1")
def f9(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.when(F.count("*") < 2, "too few records").when(F.count_if(c("l_discount") > 0) < 2, "too few prices").otherwise("ok").alias("verdict"))


@query("f11_safe_url", "SELECT page_id, url LIKE 'http%://%' AND NOT contains(url, '@') AS ok FROM pages")
def f11(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.safe(c("url")).alias("ok"))


@query("f12_allowed_domain", "SELECT page_id FROM pages WHERE regexp_matches(lower(url), '^https?://([a-z0-9-]+\\.)*example\\.com([/?#]|$)')")
def f12(t: Tables) -> DataFrame:
    return t.pages.filter(urls.allowed(c("url"), ["example.com"])).select("page_id")


_HOST = "'www' || page_id % 50 || CASE page_id % 3 WHEN 0 THEN '.Site' ELSE '.site' END || page_id % 90 || CASE WHEN page_id % 7 = 0 THEN '.org' ELSE '.de' END"
_LISTED = "CASE s_suppkey % 3 WHEN 0 THEN 'site' || s_suppkey % 90 || '.de' WHEN 1 THEN 'www' || s_suppkey % 50 || '.SITE' || s_suppkey % 90 || '.org' ELSE 'ite' || s_suppkey % 90 || '.de' END"


@query("f12_domain_list", f"SELECT page_id FROM pages WHERE EXISTS (SELECT 1 FROM supplier WHERE lower({_HOST}) = lower({_LISTED}) OR ends_with(lower({_HOST}), '.' || lower({_LISTED})))")
def f12_list(t: Tables) -> DataFrame:
    """Pages whose host a list of suppliers' domains allows, itself or by a domain above it."""
    pages = t.pages.select("page_id", F.expr(f"'https://' || {_HOST} || ':8080/a?b'").alias("url"))
    return urls.in_list(pages, "url", t.supplier.select(F.expr(_LISTED).alias("domain")), "domain").select("page_id")


@query("f18_bounds", "SELECT o_orderkey, year(o_orderdate) BETWEEN 1993 AND 1997 AND o_totalprice BETWEEN 0 AND 200000 AND o_orderpriority IN ('1-URGENT','2-HIGH') AS ok FROM orders")
def f18(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", (F.year("o_orderdate").between(1993, 1997) & c("o_totalprice").between(0, 200000) & c("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("ok"))


_RECORD = """o_custkey AS request, o_orderkey, 1998 + o_orderkey % 107 AS year, CASE o_orderkey % 9 WHEN 0 THEN 'HöS' WHEN 1 THEN 'HöS/HS' WHEN 2 THEN 'HS' WHEN 3 THEN 'HS/MS' WHEN 4 THEN 'MS' WHEN 5 THEN 'MS/NS' WHEN 6 THEN 'NS' WHEN 7 THEN 'ms' END AS voltage_level,
CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice * 3 END AS leistung, o_totalprice - 2000 AS arbeit, CASE o_orderkey % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'flagged' WHEN 2 THEN 'done' END AS verification_status"""
_LIMITS = f"""WITH r AS (SELECT {_RECORD} FROM orders), e AS (SELECT *, list_filter([CASE WHEN year NOT BETWEEN 2000 AND 2100 THEN 'year' END, CASE WHEN voltage_level IS NULL OR voltage_level = 'ms' THEN 'voltage_level' END, CASE WHEN verification_status = 'done' THEN 'verification_status' END,
CASE WHEN leistung NOT BETWEEN 0 AND 1000000 THEN 'leistung' END, CASE WHEN arbeit NOT BETWEEN 0 AND 1000000 THEN 'arbeit' END], lambda x: x IS NOT NULL) AS errors FROM r)
SELECT o_orderkey, array_to_string(CASE WHEN count(*) OVER w > 500 THEN list_append(errors, 'records') WHEN bool_or(len(errors) > 0) OVER w AND len(errors) = 0 THEN ['request'] ELSE errors END, ',') AS errors FROM e WINDOW w AS (PARTITION BY request)"""


@query("f18_import_bounds", _LIMITS)
def f18_bounds(t: Tables) -> DataFrame:
    """Orders as imported prices, a request for each customer."""
    none = "CAST(NULL AS DOUBLE)"
    rows = t.spark.sql(f"SELECT {_RECORD}, {none} AS leistung_unter_2500h, {none} AS arbeit_unter_2500h FROM {{orders}}", orders=t.orders)
    return validation.checked(rows, validation.price_errors(), "request").select("o_orderkey", F.array_join("errors", ",").alias("errors"))


_BAD = ["<ScRipt>", "JavaScript:x", "vbscript:x", "<a onMouseOver = x>", "data:text/HTML,x", "data:application/x", "width:expression (1)", "url( javascript", "&#60;", "plain text", "on = off", "a & b < c > d"]
_TAINTED = "CASE event_id % 12 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_BAD)) + " END || chr(1) || event_id || chr(9) || event_type"
#: The patterns that this input can hold, in SQL's own words.
_HARM = " OR ".join(["contains(y, '<script')", "contains(y, 'javascript:')", "contains(y, 'vbscript:')", "regexp_matches(y, 'on[a-z0-9_]+[ ]*=')", "contains(y, 'data:text/html')", "contains(y, 'data:application/')", "regexp_matches(y, 'expression[ ]*[(]')", "regexp_matches(y, 'url[ ]*[(][ ]*javascript')", "contains(y, '&#')"])


@query("f19_dangerous", f"SELECT event_id, CASE WHEN length(x) > 30 THEN 'too long' WHEN {_HARM} THEN 'dangerous content' END AS error, CASE WHEN length(x) <= 30 AND NOT ({_HARM}) THEN replace(replace(replace(replace(x, chr(1), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END AS value FROM (SELECT event_id, {_TAINTED} AS x, lower(replace({_TAINTED}, chr(1), '')) AS y FROM events)")
def f19(t: Tables) -> DataFrame:
    return t.events.select("event_id", text.sanitized(F.expr(_TAINTED), 30).alias("s")).select("event_id", "s.error", "s.value")


@query("f19_dangerous_pages", "SELECT page_id FROM pages WHERE regexp_matches(html, '(?i)<script|javascript:|vbscript:|on\\w+\\s*=|data:text/html|data:application/|expression\\s*\\(|&#')")
def f19_pages(t: Tables) -> DataFrame:
    return t.pages.filter(text.dangerous(c("html"))).select("page_id")


_ROW = ["CASE event_id % 4 WHEN 0 THEN '<script>' ELSE event_type END AS name", "CASE event_id % 5 WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN '7:30-15:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') WHEN 3 THEN '7:3x' END AS winter"]
_ROW_ERRORS = "array_to_string(list_filter([CASE WHEN event_id % 4 = 0 THEN 'name: dangerous content' END, CASE WHEN event_id % 5 = 3 THEN 'winter: no time window' END], lambda x: x IS NOT NULL), ', ')"


@query("g18_sanitized_rows", f"SELECT event_id, CASE WHEN event_id % 4 > 0 THEN name END AS name, CASE WHEN event_id % 5 <> 3 THEN winter END AS winter, {_ROW_ERRORS} AS errors FROM (SELECT event_id, {', '.join(_ROW)} FROM events)")
def g18_rows(t: Tables) -> DataFrame:
    rows = t.events.selectExpr("event_id", *[x.replace("VARCHAR", "STRING") for x in _ROW])
    return text.sanitized_rows(rows, ["name"], ["winter"]).withColumn("errors", F.array_join("errors", ", "))


@query("f20_title_area", "SELECT doc_id FROM documents WHERE contains(lower(substr(text, 1, 500)), 'tion') OR contains(lower(substr(text, 1, 500)), 'ung')")
def f20(t: Tables) -> DataFrame:
    head = F.lower(F.substring("text", 1, 500))
    return t.documents.filter(F.exists(F.array(F.lit("tion"), F.lit("ung")), lambda k: F.contains(head, k))).select("doc_id")


@query("f23_capability", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND turn > 0")
def f23(t: Tables) -> DataFrame:
    return t.conversations.withColumn("caps", F.array("role", F.when(c("turn") > 0, "late").otherwise("first"))).filter(F.array_contains("caps", "user") & F.array_contains("caps", "late")).select("conv_id", "turn")


@query("f25_first_page_glance", "SELECT doc_id FROM documents WHERE contains(text, '555') AND (contains(lower(text), 'th') OR contains(lower(text), 'ei'))")
def f25(t: Tables) -> DataFrame:
    low = F.lower("text")
    return t.documents.filter(c("text").contains("555") & F.exists(F.array(F.lit("th"), F.lit("ei")), lambda k: F.contains(low, k))).select("doc_id")


_FIRST = "CASE doc_id % 5 WHEN 0 THEN 'Preisblatt ' WHEN 1 THEN 'NETZENTGELTE ' WHEN 2 THEN 'Arbeitspreis ' ELSE 'Preise ' END || (2020 + doc_id % 7) || coalesce(text, '')"


@query("f25_glance", f"SELECT doc_id, contains(x, '2025') AND (contains(lower(x), 'netzentgelt') OR contains(lower(x), 'leistungspreis') OR contains(lower(x), 'arbeitspreis') OR contains(lower(x), 'preisblatt')) AS ok FROM (SELECT doc_id, {_FIRST} AS x FROM documents)")
def f25_glance(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.glance(F.expr(_FIRST), F.lit(2025)).alias("ok"))


@query("f27_subsequence", "SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), 'r.*d.*g.*t')")
def f27(t: Tables) -> DataFrame:
    return t.part.filter(text.subsequence(c("p_name"), "rdgt")).select("p_partkey")


@query("g4_literal_replaces", "SELECT s_suppkey, replace(replace(lower(s_name), 'supplier#', ''), '000', ' ') AS n FROM supplier")
def g4(t: Tables) -> DataFrame:
    n = F.lower("s_name")
    for a, b in (("supplier#", ""), ("000", " ")):
        n = F.replace(n, F.lit(a), F.lit(b))
    return t.supplier.select("s_suppkey", n.alias("n"))


@query("t5_pdf_time_value", f"SELECT event_id, CASE WHEN event_type = 'error' THEN '-' ELSE {_HM} || '-24:00' END AS w FROM events")
def t5(t: Tables) -> DataFrame:
    s = F.when(c("event_type") == "error", "entfällt").otherwise(F.concat(F.date_format("ts", "H:mm"), F.lit(" bis 24:00 Uhr")))
    return t.events.select("event_id", times.time_window(s).alias("w"))


@query("t6_normalized_ranges", f"SELECT event_id, {_HM} || ':00' AS a, '18:00:00' AS b, 2 AS n FROM events WHERE event_type = 'signup'")
def t6(t: Tables) -> DataFrame:
    r = times.time_ranges(F.concat(F.date_format("ts", "H:mm"), F.lit("-9:00, 18:00 20:00")))
    return t.events.filter("event_type = 'signup'").withColumn("r", r).select("event_id", c("r")[0]["start"].alias("a"), c("r")[1]["start"].alias("b"), F.size("r").alias("n"))
