"""Records of operators from their sources (P1 to P11): rows of the registry's export, the golden record over three
sources, statistics for display, fields at creation, patches, and counts by level in either of two shapes.

Texts that are empty count as missing, as do counts that are zero where another source may have one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.functions import text, times

c = F.col

#: Columns of the registry's export.
EXPORT = {
    "mastr_nr": "MaStR-Nr.", "name": "Name des Marktakteurs", "street": "Straße", "house_number": "Hausnummer", "zip_code": "Postleitzahl", "city": "Ort", "region": "Bundesland", "country": "Land", "acer_code": "ACER-Code", "roles": "Marktrollen",
    "registration_date": "Registrierungsdatum", "last_updated": "Datum der letzten Aktualisierung", "activity_start": "Tätigkeitsbeginn", "activity_end": "Tätigkeitsende", "closed_network": "Geschlossenes Verteilernetz", "activity_status": "Tätigkeitsstatus",
}

#: Levels with their other names, the highest last, and the four coarse ones they make up.
POINT_LEVELS = [("NS", []), ("Umspannung NS/MS", ["MS/NS"]), ("MS", []), ("Umspannung MS/HS", ["HS/MS"]), ("HS", []), ("Umspannung HS/HöS", ["HöS/HS"]), ("HöS", [])]
COARSE = {"ns": ["NS", "Umspannung NS/MS"], "ms": ["MS", "Umspannung MS/HS"], "hs": ["HS", "Umspannung HS/HöS"], "hoe": ["HöS"]}


def _given(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def address(street: Column, house: Column, zip_: Column, city: Column) -> Column:
    """`street number, zip city`; a number without a street and a zip code without a city are left out; null if nothing is left."""
    first = F.when(street != "", F.when(house != "", F.concat_ws(" ", street, house)).otherwise(street))
    second = F.when(city != "", F.when(zip_ != "", F.concat_ws(" ", zip_, city)).otherwise(city))
    return _given(F.concat_ws(", ", first, second))


def from_export(rows: DataFrame) -> DataFrame:
    """A record for each row of the registry's export, whose columns are texts; columns that it lacks are empty."""
    raw = {n: F.trim(F.coalesce(c(f"`{col}`"), F.lit(""))) if col in rows.columns else F.lit("") for n, col in EXPORT.items()}
    parts = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), raw[n].alias("v")) for n in ("street", "house_number", "zip_code", "city", "country")]), lambda p: p["v"] != "")
    roles = text.listed(raw["roles"], ",")
    dates = {n: times.any_date(raw[n]).cast("string").alias(n) for n in ("registration_date", "last_updated", "activity_start", "activity_end")}
    return rows.select(
        raw["mastr_nr"].alias("mastr_nr"), raw["name"].alias("name"), text.slug(raw["name"]).alias("slug"), _given(raw["region"]).alias("region"), _given(raw["acer_code"]).alias("acer_code"),
        F.when(F.size(parts) > 0, F.map_from_entries(parts)).alias("address_components"), address(*(raw[n] for n in ("street", "house_number", "zip_code", "city"))).alias("contact_address"),
        F.when(F.size(roles) > 0, roles).alias("marktrollen"), *dates.values(), text.yes(raw["closed_network"]).alias("closed_network"), (F.lower(raw["activity_status"]) == "aktiv").alias("is_active"),
    )


def golden(df: DataFrame) -> DataFrame:
    """Operators with display_name, display_website, display_phone, display_email, bdew_code and enrichment_sources.

    df has name, official_name, website, phone, email and primary_bdew_code, the structs mastr and vnb
    (official_name, homepage_url, phone, email), null where there is none, and bdew, an array of (website, bdew_code,
    is_grid_operator). The official directory comes first, then the code register, then the operator's own."""
    v = lambda n: _given(c(f"vnb.{n}"))
    some = F.coalesce(F.size("bdew") > 0, F.lit(False))
    first = lambda keep, get: F.try_element_at(F.transform(F.filter("bdew", keep), get), F.lit(1))
    grid = F.filter("bdew", lambda b: F.coalesce(b["is_grid_operator"], F.lit(False)))
    code = F.when(some, F.when(F.size(grid) > 0, F.try_element_at(grid, F.lit(1))["bdew_code"]).otherwise(F.try_element_at("bdew", F.lit(1))["bdew_code"])).otherwise(c("primary_bdew_code"))
    sources = F.array_compact(F.array(F.when(c("mastr").isNotNull(), "mastr"), F.when(c("vnb").isNotNull(), "vnb"), F.when(some, "bdew")))
    return df.withColumns(
        {
            "display_name": F.coalesce(v("official_name"), _given(c("official_name")), c("name")),
            "display_website": F.coalesce(v("homepage_url"), first(lambda b: b["website"] != "", lambda b: b["website"]), c("website")),
            "display_phone": F.coalesce(v("phone"), c("phone")),
            "display_email": F.coalesce(v("email"), c("email")),
            "bdew_code": code,
            "enrichment_sources": sources,
        }
    )


def capacity(m: Column) -> Column:
    """Capacities for display, what neither sun, wind nor storage has as `other`; null without a total."""
    n = lambda k: F.coalesce(m[f"{k}_capacity_mw"].cast("double"), F.lit(0.0))
    total = m["total_capacity_mw"].cast("double")
    return F.when(total.isNotNull(), F.struct(total.alias("total_mw"), *[n(k).alias(f"{k}_mw") for k in ("solar", "wind", "storage")], (n("biomass") + n("hydro")).alias("other_mw")))


def voltages(m: Column) -> Column:
    """Connection points by coarse level; null without a total."""
    total = m["connection_points_total"]
    return F.when(total.isNotNull(), F.struct(total.alias("total"), *[F.coalesce(m[f"connection_points_{k}"], F.lit(0)).alias(k) for k in COARSE]))


def statistics(m: Column) -> Column:
    """The statistics of a reply; null if all that tell whether there are any are missing."""
    told = ["connection_points_total", "networks_count", "total_capacity_mw", "solar_units", "wind_units", "storage_units", "stats_data_quality", "stats_computed_at"]
    points = F.struct(m["connection_points_total"].alias("total"), m["connection_points_by_level"].alias("by_canonical_level"), F.struct(*[m[f"connection_points_{k}"].alias(k) for k in COARSE]).alias("by_voltage"))
    networks = F.struct(m["networks_count"].alias("count"), m["has_customers"].alias("has_customers"), m["closed_distribution_network"].alias("closed_distribution_network"))
    installed = F.struct(*[m[f"{k}_capacity_mw"].cast("double").alias(k) for k in ("total", "solar", "wind", "storage", "biomass", "hydro")])
    units = F.struct(*[m[f"{k}_units"].alias(k) for k in ("solar", "wind", "storage")])
    whole = F.struct(points.alias("connection_points"), networks.alias("networks"), installed.alias("installed_capacity_mw"), units.alias("unit_counts"), m["stats_data_quality"].alias("data_quality"), F.date_format(m["stats_computed_at"], "yyyy-MM-dd'T'HH:mm:ss").alias("computed_at"))
    return F.when(F.coalesce(*[m[k].cast("string") for k in told]).isNotNull(), whole)


def coarse(levels: Column, other: Column) -> Column:
    """P5: the four coarse levels of a map by level, what has no level apart."""
    n = lambda k: F.coalesce(F.try_element_at(levels, F.lit(k)), F.lit(0))
    sums = {k: sum((n(x) for x in names[1:]), n(names[0])) for k, names in COARSE.items()}
    return F.struct(*[v.alias(k) for k, v in sums.items()], other.alias("other"))


def points(p: Column) -> Column:
    """Struct of total, by_level and the coarse levels from (total, by_voltage, by_canonical_level), maps of counts. Levels go by either of
    their names. Without any levels the coarse counts stand for them, and may be null as such."""
    some = lambda m, *names: F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(n)), F.lit(0)) for n in names], F.lit(0))
    fine, rough = p["by_canonical_level"], p["by_voltage"]
    named = F.create_map(*[x for name, others in POINT_LEVELS for x in (F.lit(name), some(fine, name, *others))])
    whole = {names[0]: k for k, names in COARSE.items()}
    guessed = F.create_map(*[x for name, _ in POINT_LEVELS for x in (F.lit(name), some(rough, whole[name]) if name in whole else F.lit(0).cast("bigint"))])
    has = F.coalesce(F.size(fine) > 0, F.lit(False))
    kind = "map<string,bigint>"
    by_level = F.when(has, named.cast(kind)).otherwise(guessed.cast(kind))
    fields = {k: F.when(has, coarse(named, F.lit(0))[k].cast("bigint")).otherwise(F.try_element_at(rough, F.lit(k)).cast("bigint")) for k in COARSE}
    return F.struct(p["total"].cast("bigint").alias("total"), by_level.alias("by_level"), *[v.alias(k) for k, v in fields.items()])


def live_status(crawlable: Column, data: Column, running: Column, pending: Column) -> Column:
    """What an operator's page says of its state, the most urgent first."""
    return F.when(running > 0, "running").when(pending > 0, "pending").when(~crawlable, "protected").when(data > 0, "crawled").otherwise("uncrawled")


def list_score(data: Column) -> Column:
    """A share of fifty data points in percent, a hundred at most, halves to even."""
    return F.when(data > 0, F.least(F.bround(data / 50 * 100), F.lit(100.0))).otherwise(0.0).cast("int")


def resolved(asked: DataFrame, directory: DataFrame, web: DataFrame) -> DataFrame:
    """The fields of operators to be created (id, vnb_id, official_name, website, phone, email, contact_address).

    What wasn't given comes from the directory (vnb_id, name, homepage_url, phone, email, address), which is only asked where
    website, phone or email is missing. Of the website's answer (website, crawlable, blocked_reason, enriched_address) the
    address counts only if it enriches one of the directory's; without an answer a site is crawlable."""
    fields = ["official_name", "website", "phone", "email", "contact_address"]
    own = asked.select("id", "vnb_id", *[_given(c(f)).alias(f) for f in fields])
    complete = c("website").isNotNull() & c("phone").isNotNull() & c("email").isNotNull()
    key = F.when((c("vnb_id") != "") & ~complete, c("vnb_id"))
    known = directory.select(c("vnb_id").alias("_v"), c("name").alias("_official_name"), c("homepage_url").alias("_website"), c("phone").alias("_phone"), c("email").alias("_email"), _given(c("address")).alias("_address"))
    found = own.withColumn("_k", key).join(known, c("_k") == c("_v"), "left")
    filled = found.select("id", *[F.coalesce(c(f), c(f"_{f}")).alias(f) for f in fields[:4]], "contact_address", F.when(c("contact_address").isNull(), c("_address")).alias("_enrich"))
    answers = web.select(c("website").alias("_w"), "crawlable", "blocked_reason", _given(c("enriched_address")).alias("_enriched"))
    both = filled.join(answers, c("website") == c("_w"), "left")
    address_ = F.coalesce("contact_address", F.when(c("_enrich").isNotNull(), F.coalesce("_enriched", "_enrich")))
    return both.select("id", *fields[:4], address_.alias("contact_address"), F.coalesce("crawlable", F.lit(True)).alias("crawlable"), "blocked_reason")


def patched(base: DataFrame, patch: DataFrame, key: str, fields: list[str], editor: str | None = None, at: Column | None = None) -> DataFrame:
    """P10: the base rows with the fields that a patch gives, one patch a key. With an editor, rows that have a patch
    are marked as edited by hand."""
    p = patch.select(c(key), *[c(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_patched"))
    out = base.join(p, key, "left")
    sets = {f: F.coalesce(f"_new_{f}", f) for f in fields}
    if editor is not None:
        old = lambda n, kind: c(n) if n in base.columns else F.lit(None).cast(kind)
        marks = {"extraction_source": (F.lit("manual"), "string"), "last_edited_by": (F.lit(editor), "string"), "last_edited_at": (at if at is not None else F.current_timestamp(), "timestamp")}
        sets |= {n: F.when(c("_patched"), v).otherwise(old(n, kind)) for n, (v, kind) in marks.items()}
    return out.withColumns(sets).drop("_patched", *[f"_new_{f}" for f in fields])
