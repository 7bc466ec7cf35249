"""Extraction from XML, archives, text, cells and pages, over inputs made of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.functions import html, page_tables
from gridsmith.operators import extraction
from gridsmith.registry import query
from gridsmith.session import Tables, shared_folder
from gridsmith.sources import files, listing, registry_xml, sheets

c = F.col


def folder(t: Tables) -> str:
    """A fresh folder below the one that all executors share; a temporary one where none is named."""
    return f"{shared_folder(t.spark)}/made/{uuid.uuid4().hex}"


def dealt(t: Tables, df: DataFrame, key: str) -> DataFrame:
    """df over all cores: a table of few bytes has few splits, whatever is made of its rows."""
    return df.repartition(4 * t.spark.sparkContext.defaultParallelism, key)


def _export(t: Tables, *kinds: str) -> str:
    """The driver's tables in the registry's XML layout: nations are operators (actors), suppliers networks, customers
    connection points, orders locations, line items units. Of the kinds that a query reads, packed."""
    path = folder(t)

    def put(kind: str, df: DataFrame, name: str, tag: str) -> None:
        if kind in kinds:
            df.write.format("xml").option("rowTag", tag).option("rootTag", tag + "s").option("compression", "gzip").save(f"{path}/{name}")

    op = lambda k: F.concat(F.lit("OP"), k)
    put("actors", t.nation.select(op(c("n_nationkey")).alias("MarktakteurMastrNummer"), F.when(c("n_nationkey") == 24, "Lieferant").otherwise("Anschlussnetzbetreiber").alias("Marktrolle")), "MarktakteureUndRollen.xml", "MarktakteurUndRolle")
    put("actors", t.nation.select(op(c("n_nationkey")).alias("MastrNummer"), c("n_name").alias("Firmenname")), "Marktakteure_1.xml", "Marktakteur")
    put("networks", t.supplier.select(c("s_suppkey").alias("MastrNummer"), op(c("s_nationkey")).alias("NetzbetreiberMastrNummer"), F.when(c("s_acctbal") > 0, "20").otherwise("21").alias("Sparte"), F.lit("1").alias("KundenAngeschlossen")), "Netze.xml", "Netz")
    put("points", t.customer.select(F.concat(F.lit("CP"), c("c_custkey")).alias("NetzanschlusspunktMastrNummer"), op(c("c_nationkey")).alias("NetzbetreiberMaStRNummer"), F.when(c("c_mktsegment") == "HOUSEHOLD", "354").otherwise("352").alias("Spannungsebene")), "Netzanschlusspunkte_1.xml", "Netzanschlusspunkt")
    put("locations", t.orders.select(F.concat(F.lit("L"), c("o_orderkey")).alias("MastrNummer"), F.concat(F.lit("CPx; CP"), c("o_custkey")).alias("NetzanschlusspunkteMaStRNummern")), "Lokationen_1.xml", "Lokation")
    u = t.lineitem.select(F.concat(F.lit("U"), c("l_orderkey"), F.lit("-"), c("l_linenumber")).alias("EinheitMastrNummer"), F.concat(F.lit("L"), c("l_orderkey")).alias("LokationMaStRNummer"), F.when(c("l_linestatus") == "O", "35").otherwise("31").alias("EinheitBetriebsstatus"), F.when(c("l_returnflag") == "A", "2495").otherwise("2497").alias("Energietraeger"), c("l_quantity").cast("string").alias("Bruttoleistung"), "l_returnflag")
    put("units", u.filter("l_returnflag = 'A'").drop("l_returnflag"), "EinheitenSolar_1.xml", "EinheitSolar")
    put("units", u.filter("l_returnflag != 'A'").drop("l_returnflag"), "EinheitenWind.xml", "EinheitWind")
    return path


_OPS = "SELECT n_nationkey, 'OP' || CAST(n_nationkey AS VARCHAR) AS id, n_name FROM nation WHERE n_nationkey <> 24"


@query("s3_s4_market_roles_actors", f"SELECT id, n_name AS name, 1 AS n_roles FROM ({_OPS})")
def s3(t: Tables) -> DataFrame:
    return registry_xml.operators(t.spark, _export(t, "actors")).select("id", c("Firmenname").alias("name"), F.size("roles").alias("n_roles"))


@query("s5_networks", "SELECT 'OP' || CAST(s_nationkey AS VARCHAR) AS id, count(*) AS n, count(*) FILTER (WHERE s_acctbal > 0) AS power FROM supplier GROUP BY 1")
def s5(t: Tables) -> DataFrame:
    return registry_xml.networks(t.spark, _export(t, "networks")).groupBy("id").agg(F.count("*").alias("n"), F.count_if(c("Sparte") == "20").alias("power"))


@query("s6_connection_points", "SELECT 'CP' || CAST(c_custkey AS VARCHAR) AS cp, 'OP' || CAST(c_nationkey AS VARCHAR) AS id, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '354' ELSE '352' END AS level FROM customer")
def s6(t: Tables) -> DataFrame:
    return registry_xml.connection_points(t.spark, _export(t, "points")).select("cp", "id", "level")


@query("s7_locations", "SELECT 'L' || CAST(o_orderkey AS VARCHAR) AS location, 'OP' || CAST(c_nationkey AS VARCHAR) AS id FROM orders JOIN customer ON c_custkey = o_custkey")
def s7(t: Tables) -> DataFrame:
    path = _export(t, "points", "locations")
    return registry_xml.location_operator(t.spark, path, registry_xml.connection_points(t.spark, path))


@query("s8_energy_units", "SELECT CASE WHEN l_returnflag = 'A' THEN 'solar' ELSE 'wind' END AS unit_type, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS kw FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def s8(t: Tables) -> DataFrame:
    return registry_xml.units(t.spark, _export(t, "units")).groupBy("unit_type").agg(F.count("*").alias("n"), F.sum("kw").cast("double").alias("kw"))


@query(
    "x2_registry_stats_xml",
    f"""WITH o AS ({_OPS}), cp AS (SELECT c_nationkey AS k, count(*) AS cp_total, count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS cp_ns FROM customer GROUP BY 1),
    u AS (SELECT c_nationkey AS k, count(*) FILTER (WHERE l_returnflag = 'A') AS n_solar, CAST(CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,4))), 0) / 1000 AS DECIMAL(18,4)) AS DOUBLE) AS mw_total FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_linestatus = 'O' GROUP BY 1)
    SELECT id, coalesce(cp_ns, 0) AS cp_ns, coalesce(cp_total, 0) AS cp_total, coalesce(n_solar, 0) AS n_solar, coalesce(mw_total, 0) AS mw_total FROM o LEFT JOIN cp ON cp.k = n_nationkey LEFT JOIN u ON u.k = n_nationkey""",
)
def x2_xml(t: Tables) -> DataFrame:
    return registry_xml.statistics(t.spark, _export(t, "actors", "networks", "points", "locations", "units")).select("id", "cp_ns", "cp_total", "n_solar", c("mw_total").cast("double").alias("mw_total"))


@query("s9_semicolon_csv", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0")
def s9(t: Tables) -> DataFrame:
    path = folder(t)
    t.supplier.select(F.when(c("s_suppkey") % 2 == 0, c("s_suppkey").cast("string")).alias("﻿id"), c("s_name").alias("name")).write.csv(path, sep=";", header=True)
    return files.semicolon_csv(t.spark, path, "id", "name").select("id", "name")


@query("s10_name_list", "SELECT s_name AS name FROM supplier")
def s10(t: Tables) -> DataFrame:
    path = folder(t)
    t.supplier.select(c("s_suppkey").alias("no"), c("s_name").alias("Firma")).write.csv(path, header=True)
    return files.names_csv(t.spark, path)


@query("s11_parquet_seed", "SELECT c_custkey, nullif(c_acctbal, c_acctbal) AS c_acctbal FROM customer")
def s11(t: Tables) -> DataFrame:
    path = folder(t)
    t.customer.select("c_custkey", F.lit(float("nan")).alias("c_acctbal")).write.parquet(path)
    return files.seed(t.spark, [path + "-missing", path])


@query("s12_json_stats", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def s12(t: Tables) -> DataFrame:
    path = folder(t)
    t.nation.agg(F.struct(F.lit("1").alias("version")).alias("metadata"), F.map_from_entries(F.collect_list(F.struct(c("n_nationkey").cast("string").alias("k"), F.struct(c("n_name").alias("name"))))).alias("dnos")).coalesce(1).write.json(path)
    return files.stats_json(t.spark, path, "name: string")


def _pages(t: Tables, broken: int | None = None) -> str:
    """Customers as a folder of pages of 500; the page `broken` says so."""
    path, start = folder(t), F.floor(c("c_custkey") / 500) * 500
    record = F.struct(c("c_custkey").alias("Id"), c("c_nationkey").alias("CompanyUId"), F.concat(F.lit("\t "), c("c_name")).alias("Company"))
    total = t.customer.agg(F.max("c_custkey") + 1).first()[0]
    pages = t.customer.groupBy(start.cast("long").alias("start")).agg(F.sort_array(F.collect_list(record)).alias("Records"))
    said = F.struct(F.when(c("start") == (-1 if broken is None else broken), "ERROR").otherwise("OK").alias("Result"), "Records", F.lit(total).alias("TotalRecordCount"))
    pages.select("start", F.to_json(said).alias("value")).write.partitionBy("start").text(path)
    return path


@query("s14_paged_listing", "SELECT c_custkey, c_custkey // 500 AS page, c_nationkey, c_name FROM customer")
def s14(t: Tables) -> DataFrame:
    got = listing.companies(t.spark, _pages(t), folder(t))
    return got.select(c("id").alias("c_custkey"), "page", c("company_uid").alias("c_nationkey"), c("name").alias("c_name"))


@query("s14_listing_ends_at_error", "SELECT c_custkey FROM customer WHERE c_custkey < 1000")
def s14_error(t: Tables) -> DataFrame:
    return listing.companies(t.spark, _pages(t, 1000), folder(t)).select(c("id").alias("c_custkey"))


@query("s14_listing_from_page", "SELECT c_custkey FROM customer WHERE c_custkey >= 500")
def s14_from(t: Tables) -> DataFrame:
    return listing.companies(t.spark, _pages(t), folder(t), start=500).select(c("id").alias("c_custkey"))


@query("s15_company_details", "WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 9 END, c_custkey) AS k FROM customer) SELECT c_nationkey, c_custkey FROM r WHERE k = 1")
def s15(t: Tables) -> DataFrame:
    rank = F.when(c("c_mktsegment") == "BUILDING", 1).when(c("c_mktsegment") == "MACHINERY", 2).otherwise(9)
    return t.customer.groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct(rank, "c_custkey")).alias("c_custkey"))


@query("s16_lookup_table", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20")
def s16(t: Tables) -> DataFrame:
    """Remote lookups as a join with a table of their answers."""
    known = t.nation.filter("n_nationkey < 20").select(c("n_nationkey").alias("s_nationkey"), "n_name")
    return t.supplier.join(known, "s_nationkey", "left").select("s_suppkey", "n_name")


@query("s19_downloads", "WITH d AS (SELECT sha256(text) AS h, min(doc_id) AS doc_id FROM documents WHERE n_chars < 50000 GROUP BY 1) SELECT doc_id, h FROM d")
def s19(t: Tables) -> DataFrame:
    """Files below a size, one for each content."""
    return t.documents.filter("n_chars < 50000").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))


@query("s20_unzip", "SELECT CAST(s_suppkey AS VARCHAR) AS path, 'a.pdf' AS name, CAST(length(s_name) AS INTEGER) AS n FROM supplier")
def s20(t: Tables) -> DataFrame:
    import io
    import zipfile

    import pandas as pd

    def zipped(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["text"], strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    z.writestr("a.pdf", text)
                    z.writestr("b.exe", "no")
                out.append((path, held.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    made = t.supplier.select(c("s_suppkey").cast("string").alias("path"), c("s_name").alias("text")).mapInPandas(zipped, "path string, content binary")
    return files.unzip(made).select("path", "name", F.length("content").alias("n"))


def _archives(t: Tables) -> DataFrame:
    """A job for each nation; a third of its files are archives: of several members, of none that counts, or broken."""
    import io
    import zipfile

    def content(k: int, format_: str) -> bytes:
        if format_ != "zip" or k % 5 == 0:
            return b"no zip" if format_ == "zip" else f"file {k}".encode()
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for name, text in [("only.txt", "x")] if k % 5 == 1 else [("dir/", ""), ("dir/Preis Blatt.PDF", f"%PDF {k}"), ("empty.pdf", ""), ("b.exe", "x"), ("c.html", f"<p class='x'>{k}</p><script>1</script>")]:
                z.writestr(name, text)
        return held.getvalue()

    def pack(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = [content(k, format_) for k, format_ in zip(b["c_custkey"], b["format"], strict=True)]
            yield b.assign(content=out)

    rows = dealt(t, t.customer, "c_custkey").select("c_nationkey", c("c_name").alias("slug"), "c_custkey", F.when(c("c_custkey") % 3 == 0, "zip").otherwise("pdf").alias("format"))
    kinds = "c_nationkey long, slug string, c_custkey long, format string, content binary"
    return rows.mapInPandas(pack, kinds).select(c("c_nationkey").alias("job"), F.concat(F.lit("n"), "c_nationkey").alias("slug"), c("c_custkey").alias("k"), F.concat(F.lit("f"), "c_custkey").alias("path"), "format", F.concat(F.lit("u"), "c_custkey").alias("url"), "content")


_MEMBERS = """WITH f AS (SELECT c_nationkey AS job, c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'zip' ELSE 'pdf' END AS format FROM customer),
m AS (SELECT job, k, no, name, row_number() OVER (PARTITION BY job ORDER BY k, no) - 1 AS n FROM f, (VALUES (1, 'Preis_Blatt.PDF'), (4, 'c.html')) AS x(no, name) WHERE format = 'zip' AND k % 5 > 1)
SELECT job, k, 'f' || k AS path, format, 'u' || k AS url, CAST(NULL AS VARCHAR) AS text FROM f WHERE format = 'pdf' OR k % 5 = 0 OR job NOT IN (SELECT job FROM m)
UNION ALL SELECT job, k, 'n' || job || '_zip_' || CASE WHEN n < 10 THEN '0' ELSE '' END || n || '_' || name, CASE no WHEN 1 THEN 'pdf' ELSE 'html' END, 'u' || k, CASE no WHEN 1 THEN '%PDF ' || k ELSE '<p>' || k || '</p>' END FROM m"""


@query("s20_expanded_archives", _MEMBERS)
def s20_expanded(t: Tables) -> DataFrame:
    out = files.expanded(_archives(t), "job", "slug")
    return out.select("job", "k", "path", "format", "url", F.when(c("member").isNotNull(), F.decode("content", "UTF-8")).alias("text"))


_FILES = "SELECT doc_id % 200 AS job, doc_id, 'https://x.de/' || doc_id || '.pdf' AS url, CASE WHEN doc_id % 3 = 0 THEN '%PDF' ELSE '' END || coalesce(text, '') AS content FROM {documents}"


@query("s19_kept_downloads", f"""WITH f AS ({_FILES.format(documents="documents")}), k AS (SELECT *, strlen(content) AS size, sha256(content) AS h, row_number() OVER (PARTITION BY job ORDER BY doc_id) AS n FROM f),
d AS (SELECT *, row_number() OVER (PARTITION BY job, h ORDER BY n) AS again FROM k WHERE n <= 20 AND size <= 8000), s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY job ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM d WHERE again = 1)
SELECT job, url, size, h AS file_hash, 'pdf' AS format FROM s WHERE upto < 15000""")
def s19_kept(t: Tables) -> DataFrame:
    """Files of 200 jobs: twenty candidates, 8,000 bytes a file, 15,000 a job."""
    rows = t.spark.sql(_FILES, documents=t.documents)
    own = rows.select("job", "doc_id", "url", c("content").cast("binary").alias("content"), F.lit("application/octet-stream").alias("content_type"))
    return files.kept_downloads(own, "job", c("doc_id"), 8_000, 15_000, 20).select("job", "url", c("size").cast("long").alias("size"), "file_hash", "format")


@query("s24_checked_pdfs", f"SELECT doc_id, 'stadtwerke-' || doc_id % 7 || '--gmbh/netzentgelte-' || 2020 + doc_id % 6 || '.pdf' AS path FROM ({_FILES.format(documents='documents')}) WHERE starts_with(content, '%PDF')")
def s24_pdfs(t: Tables) -> DataFrame:
    rows = t.spark.sql(_FILES, documents=t.documents)
    named = rows.select("doc_id", F.concat(F.lit("Stadtwerke "), c("doc_id") % 7, F.lit(", GmbH")).alias("name"), F.lit("netzentgelte").alias("kind"), (2020 + c("doc_id") % 6).alias("year"), c("content").cast("binary").alias("content"))
    return files.checked_pdfs(named).select("doc_id", "path")


@query("s21_page_text", "SELECT conv_id AS file, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS n FROM conversations GROUP BY 1")
def s21(t: Tables) -> DataFrame:
    """Texts of the pages of a file, in order; PDFs enter as such rows."""
    pages = t.conversations.groupBy(c("conv_id").alias("file")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda p: p["text"]).alias("texts"))
    return pages.select("file", F.size("texts").cast("long").alias("pages"), F.aggregate("texts", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n"))


@query("s22_sheet_text", "SELECT CAST(l_suppkey AS VARCHAR) AS path, count(*) AS n FROM lineitem WHERE l_linenumber < 3 AND l_orderkey < 50 GROUP BY 1")
def s22(t: Tables) -> DataFrame:
    cells = t.lineitem.select(c("l_suppkey").cast("string").alias("path"), (c("l_linenumber") - 1).alias("sheet"), c("l_orderkey").alias("row"), F.array("l_returnflag", "l_linestatus").alias("cells"))
    return files.sheet_text(cells.filter("sheet >= 0")).select("path", F.size(F.split("text", "\n")).cast("long").alias("n"))


_BOOKS = """WITH r AS (SELECT c_nationkey, c_custkey % 3 AS sheet, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 3 ORDER BY c_custkey) AS k, c_name || ' ' || c_mktsegment || ' ' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS line FROM customer)
SELECT CAST(c_nationkey AS VARCHAR) AS path, string_agg(line, '\n' ORDER BY sheet, k) AS text FROM r WHERE sheet < 2 AND k <= 50 GROUP BY 1"""


@query("s22_workbooks", _BOOKS)
def s22_books(t: Tables) -> DataFrame:
    """A workbook for each nation with its customers on three sheets, written and scanned."""

    def write(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield b.assign(content=[sheets.packed([[[r["name"], r["segment"], r["id"]] for r in rows if r["sheet"] == k] for k in range(3)]) for rows in b["rows"]])[["path", "content"]]

    row = F.struct((c("c_custkey") % 3).alias("sheet"), "c_custkey", c("c_name").alias("name"), c("c_mktsegment").alias("segment"), F.when(c("c_custkey") % 5 != 0, c("c_custkey")).otherwise(0).alias("id"))
    rows = t.customer.groupBy(c("c_nationkey").cast("string").alias("path")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return sheets.text(rows.mapInPandas(write, "path string, content binary"))


@query("s23_export_date")
def s23(t: Tables) -> DataFrame:
    return files.export_date(t.spark, f"{t.path}/nation.parquet")


@query("s24_checked_download", "SELECT doc_id FROM documents WHERE text LIKE 'The%'")
def s24(t: Tables) -> DataFrame:
    return t.documents.filter(F.startswith(c("text").cast("binary"), F.lit("The").cast("binary"))).select("doc_id")


_TEXT = "concat('Preisblatt\nHochspannungsnetz 26,88 8,58 230,39 0,44\nMittelspannung ', p_size, ',5 2,5 3,5 4,5\n')"


@query("c9_tariffs_from_text", "SELECT p_partkey, 'HS' AS level, 26.88 AS a, 0.44 AS d FROM part UNION ALL SELECT p_partkey, 'MS', p_size + 0.5, 4.5 FROM part")
def c9(t: Tables) -> DataFrame:
    rows = dealt(t, t.part, "p_partkey").select("p_partkey", F.expr(_TEXT).alias("text"))
    return extraction.tariffs_from_text(rows, "p_partkey", "text").select("p_partkey", "level", c("leistung_unter_2500h").alias("a"), c("arbeit").alias("d"))


@query("c9_tariff_sections", "SELECT p_partkey, 'MS' AS level, p_size + 0.5 AS a, p_size + 1.5 AS e FROM part UNION ALL SELECT p_partkey, 'NS', NULL, 9.5 FROM part")
def c9_sections(t: Tables) -> DataFrame:
    text = F.concat(F.lit("bis zu 2.500 Stunden\nMittelspannung (MSP) "), c("p_size"), F.lit(",5 EUR/kW 1,1 Ct/kWh\nüber 2.500 Stunden\nMittelspannung (MSP) "), c("p_size") + 1, F.lit(",5 EUR/kW\nNiederspannung (NSP) 9,5 EUR/kW\n"))
    rows = dealt(t, t.part, "p_partkey").select("p_partkey", text.alias("text"))
    return extraction.tariffs_from_text(rows, "p_partkey", "text").select("p_partkey", "level", c("leistung_unter_2500h").alias("a"), c("leistung").alias("e"))


@query("c10_tariffs_from_cells", "SELECT p_partkey, 'MS' AS level, p_size + 0.5 AS a, 7.5 AS e FROM part UNION ALL SELECT p_partkey, 'HS/MS', NULL, 42.5 FROM part")
def c10(t: Tables) -> DataFrame:
    row = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    table = F.array(row("", "< 2.500 h", ""), row("1", "Mittelspannung", F.concat(c("p_size"), F.lit(",5")), "1,5"), row("", "≥ 2.500 h", ""), row("1", "Mittelspannung", "7,5", "8,5"), row("2", "Umspannung", "42,5", "5,5"), row("", "110 kV / 20 kV", ""))
    cells = t.part.select("p_partkey", F.posexplode(table).alias("row", "cells"))
    return extraction.tariffs_from_cells(cells, "p_partkey").select("p_partkey", "level", c("leistung_unter_2500h").alias("a"), c("leistung").alias("e"))


@query("c11_windows_from_cells", "SELECT p_partkey, l AS level, s AS season, 1 AS n FROM part, (VALUES ('HS','winter'),('MS','winter'),('MS','herbst')) AS x(l, s)")
def c11(t: Tables) -> DataFrame:
    row = lambda *x: F.array(*[F.lit(v) for v in x])
    table = F.array(row("Ebene", "Winter", "Frühling", "Sommer", "Herbst"), row("Hochspannung", "07:30-15:30", "entfällt", "", ""), row("Mittelspannung", "08:00-12:00", "", "", "16:00-18:00"))
    cells = dealt(t, t.part, "p_partkey").select("p_partkey", F.posexplode(table).alias("row", "cells"))
    return extraction.windows_from_cells(cells, "p_partkey").select("p_partkey", "level", "season", F.size("windows").alias("n"))


@query("c12_windows_from_text", "SELECT event_id, 'HS' AS level, 'winter' AS season, '07:30' AS s FROM events UNION ALL SELECT event_id, 'MS', 'winter', '08:00' FROM events UNION ALL SELECT event_id, 'MS', 'herbst', '16:00' FROM events")
def c12(t: Tables) -> DataFrame:
    text = F.lit("Winter Herbst\nHochspannung 07:30 - 15:30\nMittelspannung 08:00 - 12:00 16:00 - 18:00\n")
    rows = t.events.select("event_id", text.alias("t"))
    return extraction.windows_from_text(rows, "event_id", "t").select("event_id", "level", "season", c("start").alias("s"))


@query("m6_html_windows", "SELECT page_id, 'MS' AS level, 'winter' AS season FROM pages")
def m6(t: Tables) -> DataFrame:
    made = F.lit("<h2>2025</h2><table><tr><th>Ebene</th><th>Winter</th><th>Sommer</th></tr><tr><td>Mittelspannung</td><td>08:00 - 12:00</td><td>-</td></tr></table>")
    cells = t.pages.select("page_id", F.posexplode(html.tables(F.concat(made, c("html")))[0]["rows"]).alias("row", "cells"))
    return extraction.windows_from_cells(cells, "page_id").select("page_id", "level", "season")


@query("m6_html_windows_whole")
def m6_whole(t: Tables) -> DataFrame:
    """Of every table in the pages' own html."""
    rows = t.pages.select("page_id", F.posexplode(html.tables("html")).alias("no", "table"))
    cells = rows.select(F.struct("page_id", "no").alias("of"), F.posexplode("table.rows").alias("row", "cells"))
    return extraction.windows_from_cells(cells, "of").select("of.page_id", "of.no", "level", "season", "windows")


def _hours_page() -> str:
    """A page of one of eight kinds, before the page's own html. Every cell differs from page to page."""
    head = "<h3>Stand 01.12.2024 <b>gültig</b> ab 01.01.{y}</h3>"
    cell = lambda text: f"<td>{text}</td>"
    row = lambda tag, *more: "<tr>" + cell(f"<b>{tag}</b>\n spannung' || page_id || '") + cell("' || page_id % 12 || ':00-12:00") + cell("") + cell("8:00<br/>9:0' || page_id % 7 || '<br>") + cell(" - ") + "".join(more) + "</tr>"
    table = lambda *rows: "<table class=\"t\"><thead><tr><th>Ebene</th></tr></thead><tbody>" + "".join(rows) + "</tbody></table>"
    kinds = [
        head.format(y=2025) + "<p>Note</p><div class=\"wide table-wrapper\"><p>" + table(row("Hoch"), row("Mittel")) + "</p></div>" + table(row("Later")),
        head.format(y=2024) + table(row("Old")) + head.format(y=2025) + "text" + table(row("Hoch")),
        "<div>" + table(row("Hoch")) + "</div>" + table(row("Later")),
        table(row("Hoch")) + head.format(y=2023) + table(row("Old")),
        head.format(y=2025) + "<table><tr>" + cell("a") * 5 + "</tr></table>" + table(row("Later")),
        head.format(y=2025) + table("<tr>" + cell("four") * 4 + "</tr>", row("Hoch", cell("six")), "<tr>" + cell("") + cell("x") * 4 + "</tr>"),
        table(row("Hoch")) + head.format(y=2025).replace("h3", "h2") + table(row("Later")),
        head.format(y=2025) + "<p>No table here</p>",
    ]
    return "CASE page_id % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(kinds)) + " END || html"


_HOURS_ROWS = """SELECT page_id, 2025 AS year, tag || ' spannung' || page_id AS voltage_level, page_id % 12 || ':00-12:00' AS fruehling, CAST(NULL AS VARCHAR) AS sommer, '8:00' || chr(10) || '9:0' || page_id % 7 AS herbst, '-' AS winter
FROM pages, (VALUES (0, 'Hoch'), (0, 'Mittel'), (1, 'Hoch'), (2, 'Hoch'), (3, 'Hoch'), (5, 'Hoch'), (6, 'Hoch')) k(kind, tag) WHERE page_id % 8 = kind"""


@query("m6_hours_of_a_year", _HOURS_ROWS)
def m6_hours(t: Tables) -> DataFrame:
    return page_tables.hours(t.pages, "page_id", F.expr(_hours_page()), F.lit(2025))


@query("m13_clean_records", "SELECT event_id, CASE WHEN event_type = 'error' THEN '-' ELSE '07:30-15:30' END AS w, CASE WHEN event_type = 'view' THEN '-' ELSE '1,5' END AS p FROM events")
def m13(t: Tables) -> DataFrame:
    from gridsmith.functions import numbers, times

    return t.events.select("event_id", times.time_window(F.when(c("event_type") == "error", "k.A.").otherwise("7:30 Uhr bis 15:30 Uhr")).alias("w"), numbers.clean_price(F.when(c("event_type") == "view", "entfällt").otherwise(" 1,5 ")).alias("p"))


@query("m8_sitemap_urls", "SELECT page_id, 2 AS n FROM pages")
def m8(t: Tables) -> DataFrame:
    xml = F.concat(F.lit("<urlset><url><loc> "), c("url"), F.lit(" </loc></url><url><ns:loc>https://x.de/a</ns:loc></url><url><loc>https://x.de/a</loc></url></urlset>"))
    return t.pages.select("page_id", F.size(html.sitemap_urls(xml)).alias("n"))


@query("m9_robots", "SELECT page_id, 1 AS maps, '/intern' AS deny FROM pages")
def m9(t: Tables) -> DataFrame:
    body = F.concat(F.lit("User-agent: other\nDisallow: /x\nUser-agent: *\nDisallow: /intern # no\nDisallow:\nSitemap: "), c("url"))
    return t.pages.withColumn("r", html.robots(body)).select("page_id", F.size("r.sitemaps").alias("maps"), F.array_join("r.disallow", ",").alias("deny"))


@query("g13_decode_bytes", "SELECT s_suppkey, 'Größe ' || s_name AS s FROM supplier")
def g13(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Größe "), c("s_name"))
    data = F.when(c("s_suppkey") % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    return t.supplier.select("s_suppkey", html.decoded(data).alias("s"))


@query("g18_sanitize", "SELECT event_id, event_id % 2 = 0 AS ok FROM events")
def g18(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.when(c("event_id") % 2 == 0, "07:30").otherwise("7:3x").rlike("^([01]?[0-9]|2[0-4]):[0-5][0-9](:[0-5][0-9])?$").alias("ok"))


@query("g19_impressum_address", "SELECT s_suppkey, 'Hauptstraße 5' AS street, '12345' AS zip, 'Musterstadt' AS city FROM supplier")
def g19(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Impressum\n"), c("s_name"), F.lit("\nHauptstraße 5\nPostfach 1\nD-12345 Musterstadt\n"))
    return extraction.impressum_address(t.supplier.select("s_suppkey", text.alias("t")), "s_suppkey", "t")


@query("m4_style_stripping", "SELECT page_id, CAST((length(html) - length(replace(html, '<style', ''))) / 6 AS INTEGER) AS n FROM pages")
def m4(t: Tables) -> DataFrame:
    bare = F.regexp_replace("html", r"(?is)<style\b.*?</style>", "")
    return t.pages.select("page_id", (F.regexp_count("html", F.lit("<style")) - F.regexp_count(bare, F.lit("<style"))).alias("n"))


@query("k9_year_split_html", "SELECT o_orderstatus AS slug, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1, 2")
def k9(t: Tables) -> DataFrame:
    path = folder(t)
    files.write_html_years(t.orders.select(c("o_orderstatus").alias("slug"), F.year("o_orderdate").alias("year"), F.concat(F.lit("<p>"), c("o_orderkey"), F.lit("</p>")).alias("html")), path)
    return t.spark.read.text(path).groupBy("slug", "year").agg(F.count("*").alias("n"))


@query("s1_s2_xml_glob", "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s FROM customer")
def s1(t: Tables) -> DataFrame:
    """Elements of one tag in all files of a glob."""
    path = folder(t)
    t.customer.select("c_custkey").repartition(3).write.format("xml").option("rowTag", "Kunde").option("rootTag", "Kunden").save(f"{path}/k_1.xml")
    rows = registry_xml.scan(t.spark, f"{path}/k_*.xml", "Kunde", ["c_custkey"])
    return rows.agg(F.count("*").alias("n"), F.sum(c("c_custkey").cast("long")).alias("s"))
