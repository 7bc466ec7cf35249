"""Operators over small hand-written inputs."""

import random

import pytest
from pyspark.sql import functions as F

from gridsmith.functions import html, urls
from gridsmith.operators import crawl, discovery, extraction, search
from gridsmith.operators.explorer import RefusedError, guarded
from gridsmith.operators.joins import band
from gridsmith.plans.scoring import importance
from gridsmith.plans.upserts import upsert
from gridsmith.session import Tables
from gridsmith.sources import files, registry_xml

SF = "/root/testdata/sf0.001"


def test_band_join_equals_brute_force(spark):
    r = random.Random(3)
    a = [(i, r.uniform(0, 10), r.uniform(0, 10)) for i in range(200)]
    b = [(i, r.uniform(0, 10), r.uniform(0, 10)) for i in range(200)]
    left, right = spark.createDataFrame(a, "a int, x double, y double"), spark.createDataFrame(b, "b int, u double, v double")
    got = {(r.a, r.b) for r in band(left, right, "x", "y", "u", "v", 0.5).collect()}
    assert got == {(i, j) for i, x, y in a for j, u, v in b if abs(x - u) < 0.5 and abs(y - v) < 0.5}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", False)], "k int, v string, verified boolean")
    new = spark.createDataFrame([(1, "A"), (2, "B"), (4, "D")], "k int, v string")
    got = {(r.k, r.v, r.action) for r in upsert(old, new, ["k"], ["v"], "verified").collect()}
    assert got == {(1, "a", "skipped"), (2, "B", "updated"), (3, "c", "kept"), (4, "D", "inserted")}


def test_importance(spark):
    rows = [(None, None, None, None), (20000, 500000, None, 1500.0), (0, None, False, None), (100, None, True, 10.0)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, p long, c long, h boolean, a double")
    got = [r.s for r in df.select("i", importance(F.col("p"), F.col("c"), F.col("h"), F.col("a")).alias("s")).orderBy("i").collect()]
    assert (got[0].score, got[0].confidence, got[0].customer_source) == (5.25, 0.4, "default_fallback")
    assert (got[1].score, got[1].confidence) == (100.0, 1.0)
    assert got[2].customer_source == "has_customers_false" and got[3].customers == 0.35


def test_registry_xml(spark, tmp_path):
    def put(name, tag, rows):
        body = "".join(f"<{tag}>" + "".join(f"<{k}>{v}</{k}>" for k, v in r.items()) + f"</{tag}>" for r in rows)
        (tmp_path / name).write_text(f"<?xml version='1.0' encoding='UTF-8'?><all>{body}</all>", encoding="utf-8")

    put("MarktakteureUndRollen.xml", "MarktakteurUndRolle", [{"MarktakteurMastrNummer": "A", "Marktrolle": "Anschlussnetzbetreiber"}, {"MarktakteurMastrNummer": "A", "Marktrolle": "Übertragungsnetzbetreiber"}, {"MarktakteurMastrNummer": "B", "Marktrolle": "Lieferant"}, {"MarktakteurMastrNummer": "C", "Marktrolle": "Anschlussnetzbetreiber"}])
    put("Marktakteure_1.xml", "Marktakteur", [{"MastrNummer": "A", "Firmenname": "Alt", "Ort": "X"}])
    put("Marktakteure_2.xml", "Marktakteur", [{"MastrNummer": "A", "Firmenname": "Neu", "Ort": ""}])
    put("Netze.xml", "Netz", [{"MastrNummer": "N1", "NetzbetreiberMastrNummer": "A", "Sparte": "20", "KundenAngeschlossen": "1"}])
    put("Netzanschlusspunkte_1.xml", "Netzanschlusspunkt", [{"NetzanschlusspunktMastrNummer": "P1", "NetzbetreiberMaStRNummer": "A", "Spannungsebene": "354"}, {"NetzanschlusspunktMastrNummer": "P1", "NetzbetreiberMaStRNummer": "A", "Spannungsebene": "352"}])
    put("Lokationen_1.xml", "Lokation", [{"MastrNummer": "L1", "NetzanschlusspunkteMaStRNummern": "P0; P1"}])
    put("EinheitenSolar_1.xml", "EinheitSolar", [{"EinheitMastrNummer": "U1", "LokationMaStRNummer": "L1", "EinheitBetriebsstatus": "35", "Energietraeger": "2495", "Bruttoleistung": "1500"}, {"EinheitMastrNummer": "U2", "LokationMaStRNummer": "L1", "EinheitBetriebsstatus": "31", "Energietraeger": "2495", "Bruttoleistung": "9"}])
    got = {r.id: r for r in registry_xml.statistics(spark, str(tmp_path)).collect()}
    a = got["A"]
    assert set(got) == {"A", "C"} and a.roles == ["Anschlussnetzbetreiber", "Übertragungsnetzbetreiber"]
    assert (a.Firmenname, a.Ort, a.networks, a.has_customers) == ("Neu", "X", 1, True)
    assert (a.cp_total, a.cp_ms, a.cp_ns) == (2, 2, 0), "each occurrence counts, with the last record's level"
    assert (float(a.mw_solar), a.n_solar, a.has_full_data) == (1.5, 1, True)
    assert (got["C"].cp_total, float(got["C"].mw_total), got["C"].has_full_data) == (0, 0.0, False)
    assert "mw_total" not in registry_xml.statistics(spark, str(tmp_path), quick=True).columns


def test_tariffs(spark):
    df = spark.createDataFrame([(1, "Hochspannungsnetz 26,88 8,58 230,39 0,44")], "k int, t string")
    got = extraction.tariffs_from_text(df, "k", "t").collect()
    assert [(r.level, r.leistung_unter_2500h, r.arbeit_unter_2500h, r.leistung, r.arbeit) for r in got] == [("HS", 26.88, 8.58, 230.39, 0.44)]


def test_windows_by_year(spark):
    text = "Hochlastzeitfenster 2024\nWinter\nMS 08:00-12:00\nHochlastzeitfenster 2025\nWinter\nMS 09:00-12:00\n"
    got = extraction.windows_from_text(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").collect()
    assert sorted((r.year, r.level, r.season, r.start) for r in got) == [(2024, "MS", "winter", "08:00"), (2025, "MS", "winter", "09:00")]


def test_inverted_windows(spark):
    cells = [(1, 0, ["", "Hochspannung", "Mittelspannung"]), (1, 1, ["Winter", "07:00-08:00", ""]), (1, 2, ["Herbst", "", "16:00-17:00"])]
    got = extraction.windows_from_cells(spark.createDataFrame(cells, "k int, row int, cells array<string>"), "k").collect()
    assert sorted((r.level, r.season, r.windows[0]) for r in got) == [("HS", "winter", "07:00-08:00"), ("MS", "herbst", "16:00-17:00")]


def test_crawl_bounds(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "e"), ("e", "a")], "url string, to string")
    scores = spark.createDataFrame([("b", 1.0), ("c", 5.0), ("d", 9.0)], "url string, score double")
    start = spark.createDataFrame([("a",)], "url string")
    got = {r.url: (r.depth, r.visit) for r in crawl.crawl(start, edges, scores, max_depth=2, budget=10, width=1).collect()}
    assert got == {"a": (0, 0), "c": (1, 1), "b": (1, 2), "d": (2, 3)}
    assert crawl.crawl(start, edges, scores, budget=2, width=1).count() == 2


def test_guarded_sql(spark):
    t = Tables(spark, SF)
    assert guarded(t, "SELECT * FROM g_orders", ["orders"], rows=7).count() == 7
    for bad in ("DROP TABLE g_orders", "SELECT 1; SELECT 2", "SELECT * FROM other", "SELECT * FROM parquet.`/x`"):
        with pytest.raises(RefusedError):
            guarded(t, bad, ["orders"])


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id;name\n1;Zeta\n;Leer\n2;alpha\n", encoding="utf-8")
    assert [r.name for r in files.semicolon_csv(spark, str(tmp_path / "a.csv"), "id", "name").collect()] == ["alpha", "Zeta"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "netz-x-hlzf-2024.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "d" / "netz-x-netzentgelte-2025.pdf").write_bytes(b"%PDF-1.4")
    assert {(r.slug, r.kind, r.year) for r in files.listing(spark, str(tmp_path / "d")).collect()} == {("netz-x", "hlzf", 2024), ("netz-x", "netzentgelte", 2025)}
    docs = files.documents(spark, str(tmp_path / "d")).collect()
    assert len(docs) == 1 and docs[0].format == "pdf"


def _dicts(df):
    return [r.asDict() for r in df.collect()]


def test_cascade_first_source_wins(spark):
    at = lambda *rows: spark.createDataFrame(rows, "site long, url string, score double")
    known = spark.createDataFrame([("c", "irrelevant"), ("d", "unclassified")], "url string, class string")
    sources = [("profile", at((1, "a", 80.0))), ("crawl", at((1, "a", 99.0), (1, "c", 90.0), (1, "d", 70.0), (1, "e", 60.0), (1, "f", 65.0)))]
    got = {(r.url, r.score, r.source) for r in discovery.cascade(sources, known, 3).collect()}
    assert got == {("a", 80.0, "profile"), ("d", 40.0, "crawl"), ("f", 65.0, "crawl")}
    assert discovery.cascade([("none", at().limit(0))], known.limit(0)).count() == 0


def test_scan_only_where_no_windows_are_named(spark):
    found = spark.createDataFrame([(1, "x/HLZF.pdf", 9.0), (2, "x/a.pdf", 9.0)], "site long, url string, score double")
    pages = spark.createDataFrame([(1, "p", 40.0), (2, "p", 40.0), (2, "q", 30.0), (3, "p", 99.0)], "site long, url string, points double")
    assert {(r.site, r.url, r.score) for r in discovery.with_scan(found, pages).collect()} == {(1, "x/HLZF.pdf", 9.0), (2, "x/a.pdf", 9.0), (2, "p", 90.0)}


def test_second_pass_leaves_out_the_first(spark):
    rows = [(1, "a", 1, True), (1, "b", 4, False), (2, "a", 1, False), (2, "b", 4, False), (2, "c", 6, True)]
    got = discovery.deepened(spark.createDataFrame(rows, "job long, url string, depth int, classified boolean"))
    assert {tuple(r) for r in got.collect()} == {(1, "a", 1), (2, "b", 2)}


def test_classified_files(spark):
    rows = [
        (1, "a", "html", 2024, 5, 0, False, False),
        (1, "b", "pdf", None, 5, 0, False, False),  # as many, but PDF
        (1, "c", "pdf", 2023, 3, 0, False, False),  # another year
        (1, "d", "pdf", 2024, 1, 0, False, False),
        (1, "e", "pdf", 2024, 0, 0, False, False),
        (2, "a", "pdf", 2024, 2, 4, False, False),  # both kinds, more windows
        (3, "a", "pdf", 2024, 0, 0, True, True),  # both by words
    ]
    df = spark.createDataFrame(rows, "job long, path string, format string, year int, n_prices int, n_hours int, said_prices boolean, said_hours boolean")
    got = {(r.job, r.path): r["class"] for r in discovery.classified(df, 2024).collect()}
    assert got == {(1, "a"): "unclassified", (1, "b"): "netzentgelte", (1, "c"): "netzentgelte", (1, "d"): "unclassified", (1, "e"): "irrelevant", (2, "a"): "hlzf", (3, "a"): "netzentgelte"}


def test_relevant_pages(spark):
    rows = [(1, 0, "Entgelt"), (1, 1, "x"), (1, 2, None), (2, 0, "x"), (2, 1, "Preisblatt"), (3, 0, "x"), (3, 1, "x"), (3, 2, "x")]
    got = discovery.relevant_pages(spark.createDataFrame(rows, "doc long, page int, text string"), "doc", "text")
    assert {(r.doc, r.page) for r in got.collect()} == {(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)}


def test_chosen_and_finalized(spark):
    df = lambda rows, s: spark.createDataFrame(rows, s)
    own = df([(1, True), (1, True), (2, True), (2, False), (3, True)], "file long, valid boolean")
    other = df([(2, True), (2, True), (4, None)], "file long, valid boolean")
    assert {tuple(r) for r in discovery.chosen(own, other).collect()} == {(1, "patterns", 2, False), (2, "fallback", 2, False), (3, "patterns", 1, True), (4, "fallback", 1, True)}
    jobs = df([(1, "https://x.de/a/2024/f.pdf", None), (2, "https://x.de/a/g.pdf", "/a/"), (3, None, "/b/")], "job long, url string, via string")
    done = discovery.finalized(jobs, df([(1, False, True), (2, True, False)], "job long, error boolean, warning boolean"))
    assert {(r.job, r.n, r.saved, r.flagged) for r in done.collect()} == {(1, 1, True, True), (2, 0, False, False), (3, 0, False, False)}
    assert {tuple(r) for r in discovery.learned(done).collect()} == {("/a/{year}/", 1, 0), ("/a/", 1, 1), ("/b/", 0, 1)}


def test_waterfall_steps(spark):
    asked = spark.createDataFrame([(1, "k"), (2, "x"), (3, None), (4, "y"), (5, "z")], "ask long, key string")
    stored = spark.createDataFrame([("k", 1.0, 1.0, 10), ("k", 1.0, 1.0, 11), (None, 2.0, 2.0, 20)], "key string, lat double, lon double, operator int")
    told = spark.createDataFrame([(1, 9.0, 9.0, 90, True), (2, 2.00005, 2.0, 30, True), (3, 2.0002, 2.0, 31, False), (3, 2.0002, 2.0, 32, True), (4, 5.0, 5.0, None, None)], "ask long, lat double, lon double, operator int, electricity boolean")
    got = {tuple(r) for r in search.waterfall(asked, stored, told).collect()}
    assert got == {(1, 10, "cached"), (2, 20, "near"), (3, 32, "skeleton"), (4, None, "missing"), (5, None, "missing")}


def test_embedded_data(spark):
    pages = [
        "<p>Hochlast<div>ab 2025<table><tr><td>Winter<td>8 Uhr</table></div>",
        "<h3>gültig ab 01.01.2024</h3><table><tr><td><table><tr><td>ct/kWh Netzebene</td></tr></table>",
        "<script>winter sommer</script><b>2025</b>",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string").withColumn("p", html.placed("h"))
    got = [r.e for r in df.select("i", html.embedded(F.col("p"), "hlzf", 2025).alias("e")).orderBy("i").collect()]
    assert [(e.words, e.tables, e.has_data, e.years, e.confidence, e.points) for e in got] == [(["hochlast", "winter"], 1, True, [2025], 0.9, 89.0), ([], 2, False, [2024], 0.1, 0.0), ([], 0, False, [], 0.0, 0.0), ([], 0, False, [], 0.0, 0.0)]
    prices = df.filter("i = 1").select(html.embedded(F.col("p"), "netzentgelte").alias("e")).first().e
    assert (prices.has_data, prices.confidence, prices.points) == (True, 0.5, 15.0)


def test_kind_points(spark):
    df = spark.createDataFrame([("x/Preisblatt.pdf",), ("x/hochlast-regelung",), (None,)], "u string")
    got = df.select(*[urls.kind_points(F.col("u"), k).alias(k) for k in ("netzentgelte", "hlzf", "all")]).collect()
    assert [tuple(r) for r in got[:2]] == [(15.0, -10.0, 0.0), (-20.0, 25.0, 0.0)]
