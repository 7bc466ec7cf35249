"""Records of operators on hand-written rows: gaps, empty texts, either shape of counts."""

import pytest
from pyspark.sql import functions as F

from gridsmith.operators import records


@pytest.mark.parametrize(
    "parts,want",
    [(("Weg", "5", "12345", "Ort"), "Weg 5, 12345 Ort"), (("Weg", "", "", "Ort"), "Weg, Ort"), (("", "5", "12345", ""), None), (("", "5", "12345", "Ort"), "12345 Ort"), (("Weg", "5", "12345", ""), "Weg 5"), (("", "", "", ""), None)],
)
def test_address(spark, parts, want):
    df = spark.createDataFrame([parts], "s string, h string, z string, c string")
    assert df.select(records.address(*(F.col(x) for x in "shzc"))).first()[0] == want


def test_export_without_columns(spark):
    df = spark.createDataFrame([(" SNB1 ", "Größe & Co", None), (None, None, " aktiv ")], "`MaStR-Nr.` string, `Name des Marktakteurs` string, `Tätigkeitsstatus` string")
    a, b = records.from_export(df).collect()
    assert (a.mastr_nr, a.slug, a.address_components, a.contact_address, a.marktrollen, a.registration_date, a.closed_network, a.is_active) == ("SNB1", "groesse-co", None, None, None, None, False, False)
    assert (b.mastr_nr, b.name, b.slug, b.region, b.is_active) == ("", "", "", None, True)


GOLDEN = "k int, name string, official_name string, website string, phone string, email string, primary_bdew_code string, mastr struct<x:int>, vnb struct<official_name:string,homepage_url:string,phone:string,email:string>, bdew array<struct<website:string,bdew_code:string,is_grid_operator:boolean>>"


def test_golden_records(spark):
    rows = [
        (1, "n", "o", "w", "p", "e", "pc", None, ("vo", "", None, "ve"), [("", "b1", None), ("bw", "b2", True), ("bx", "b3", True)]),
        (2, "n", "", None, None, None, "pc", (1,), None, []),
        (3, "n", "o", "w", "p", "e", None, (1,), (None, "vh", "vp", ""), [("", "b1", False), (None, "b2", None)]),
        (4, "n", None, "w", None, None, "pc", None, None, None),
    ]
    got = {r.k: (r.display_name, r.display_website, r.display_phone, r.display_email, r.bdew_code, r.enrichment_sources) for r in records.golden(spark.createDataFrame(rows, GOLDEN)).collect()}
    assert got == {1: ("vo", "bw", "p", "ve", "b2", ["vnb", "bdew"]), 2: ("n", None, None, None, "pc", ["mastr"]), 3: ("o", "vh", "vp", "e", "b1", ["mastr", "vnb", "bdew"]), 4: ("n", "w", None, None, "pc", [])}


def test_points_of_either_shape(spark):
    kind = "k int, p struct<total:long,by_voltage:map<string,long>,by_canonical_level:map<string,long>>"
    rows = [(1, (9, {"ns": 7}, {"NS": 1, "Umspannung NS/MS": 0, "MS/NS": 2, "HöS/HS": 4})), (2, (None, {"ns": 3, "hoe": 0}, {})), (3, (5, None, None)), (4, None)]
    got = {r.k: r.x for r in spark.createDataFrame(rows, kind).select("k", records.points(F.col("p")).alias("x")).collect()}
    one = got[1]
    assert (one.total, one.ns, one.ms, one.hs, one.hoe) == (9, 3, 0, 4, 0) and one.by_level["Umspannung NS/MS"] == 2 and one.by_level["Umspannung HS/HöS"] == 4 and len(one.by_level) == 7
    two = got[2]
    assert (two.total, two.ns, two.ms, two.hs, two.hoe) == (None, 3, None, None, 0) and two.by_level == {"NS": 3, "Umspannung NS/MS": 0, "MS": 0, "Umspannung MS/HS": 0, "HS": 0, "Umspannung HS/HöS": 0, "HöS": 0}
    assert (got[3].total, got[3].ns) == (5, None) and set(got[3].by_level.values()) == {0} and got[4].total is None


def test_states_and_scores(spark):
    df = spark.createDataFrame([(True, 0, 0, 0), (False, 9, 0, 0), (False, 9, 1, 1), (True, 9, 0, 2), (True, 25, 0, 0), (True, 60, 0, 0)], "ok boolean, n int, r int, w int")
    got = [(x.s, x.p) for x in df.select(records.live_status(F.col("ok"), F.col("n"), F.col("r"), F.col("w")).alias("s"), records.list_score(F.col("n")).alias("p")).collect()]
    assert got == [("uncrawled", 0), ("protected", 18), ("running", 18), ("pending", 18), ("crawled", 50), ("crawled", 100)]


def test_fields_at_creation(spark):
    asked = spark.createDataFrame([(1, "v", None, "", "p", "e", None), (2, "v", "o", "w", "p", "e", None), (3, "", None, None, None, None, "a"), (4, "x", None, None, None, None, None), (5, None, None, "w", None, None, None)], "id int, vnb_id string, official_name string, website string, phone string, email string, contact_address string")
    directory = spark.createDataFrame([("v", "dn", "w", "dp", "de", "da")], "vnb_id string, name string, homepage_url string, phone string, email string, address string")
    web = spark.createDataFrame([("w", False, "js", "rich")], "website string, crawlable boolean, blocked_reason string, enriched_address string")
    got = {r.id: (r.official_name, r.website, r.phone, r.contact_address, r.crawlable, r.blocked_reason) for r in records.resolved(asked, directory, web).collect()}
    assert got == {1: ("dn", "w", "p", "rich", False, "js"), 2: ("o", "w", "p", None, False, "js"), 3: (None, None, None, "a", True, None), 4: (None, None, None, None, True, None), 5: (None, "w", None, None, False, "js")}


def test_patches(spark):
    base = spark.createDataFrame([(1, "a", 1.0, "pdf"), (2, "b", 2.0, "pdf"), (3, "c", None, "pdf")], "k int, s string, x double, extraction_source string")
    patch = spark.createDataFrame([(1, None, 5.0), (3, "C", None), (9, "new", 1.0)], "k int, s string, x double")
    got = {r.k: (r.s, r.x, r.extraction_source, r.last_edited_by, r.last_edited_at is not None) for r in records.patched(base, patch, "k", ["s", "x"], "me").collect()}
    assert got == {1: ("a", 5.0, "manual", "me", True), 2: ("b", 2.0, "pdf", None, False), 3: ("C", None, "manual", "me", True)}
    assert records.patched(base, patch, "k", ["s", "x"]).columns == base.columns
