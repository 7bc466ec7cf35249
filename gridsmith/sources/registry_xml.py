"""Scans of the registry's XML export (S1 to S8) and its statistics.

Each scan reads a glob of files with a fixed schema of strings; the order of the
export is (file, row in the file's partition), kept as an ordinal where the last
record of a key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.functions.text import listed
from gridsmith.functions.times import safe_date
from gridsmith.operators.joins import first_match, with_defaults
from gridsmith.operators.ranking import last_value, pick

#: Roles of grid operators, the status of active units, level and source numbers.
ROLES = ["Anschlussnetzbetreiber", "Übertragungsnetzbetreiber"]
ACTIVE = "35"
LEVEL_NUMBERS = {"348": "hoe", "349": "umspannung_hs_hoe", "350": "hs", "351": "umspannung_ms_hs", "352": "ms", "353": "umspannung_ns_ms", "354": "ns"}
SOURCE_NUMBERS = {"2495": "solar", "2497": "wind", "2496": "storage", "2": "biomass", "6": "hydro", "7": "hydro", "2498": "hydro"}

FIELDS = {
    "MarktakteurUndRolle": ["MarktakteurMastrNummer", "Marktrolle"],
    "Marktakteur": ["MastrNummer", "Firmenname", "Strasse", "Hausnummer", "Postleitzahl", "Ort", "Email", "Telefon", "AcerCode", "RegistrierungsdatumMarktakteur", "Taetigkeitsbeginn", "Taetigkeitsende"],
    "Netz": ["MastrNummer", "NetzbetreiberMastrNummer", "Bezeichnung", "Sparte", "KundenAngeschlossen", "GeschlossenesVerteilnetz", "Bundesland"],
    "Netzanschlusspunkt": ["NetzanschlusspunktMastrNummer", "NetzbetreiberMaStRNummer", "NetzMaStRNummer", "Spannungsebene", "Nettoengpassleistung", "LokationMaStRNummer"],
    "Lokation": ["MastrNummer", "Lokationtyp", "VerknuepfteEinheitenMaStRNummern", "NetzanschlusspunkteMaStRNummern"],
    "Einheit": ["EinheitMastrNummer", "LokationMaStRNummer", "EinheitBetriebsstatus", "Energietraeger", "Bruttoleistung", "Nettonennleistung", "Bundesland", "Postleitzahl", "Ort", "Inbetriebnahmedatum"],
}
UNITS = [("EinheitenSolar_*.xml", "EinheitSolar", "solar"), ("EinheitenWind.xml", "EinheitWind", "wind"), ("EinheitenStromSpeicher_*.xml", "EinheitStromSpeicher", "storage"), ("EinheitenBiomasse.xml", "EinheitBiomasse", "biomass"), ("EinheitenWasser.xml", "EinheitWasser", "hydro")]


def scan(spark: SparkSession, path: str, tag: str, fields: list[str]) -> DataFrame:
    """Elements of a tag in all files of a glob, with _ord (file, place). No file: no rows."""
    schema = ", ".join(f"{f} string" for f in fields)

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    if found is None or len(found) == 0:
        return spark.createDataFrame([], schema + ", _ord struct<file:string,at:bigint>")
    df = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return df.withColumn("_ord", F.struct(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))).select(*fields, "_ord")


def operators(spark: SparkSession, folder: str) -> DataFrame:
    """(id, roles in first-seen order, name ... dates). Of text fields the last that
    isn't empty counts, of dates the last even if missing."""
    roles = scan(spark, f"{folder}/MarktakteureUndRollen.xml", "MarktakteurUndRolle", FIELDS["MarktakteurUndRolle"])
    kept = roles.filter(F.col("Marktrolle").isin(*ROLES) & (F.length("MarktakteurMastrNummer") > 0)).groupBy(F.col("MarktakteurMastrNummer").alias("id"), "Marktrolle").agg(F.min("_ord").alias("o"))
    ids = kept.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "Marktrolle"))), lambda x: x["Marktrolle"]).alias("roles"))
    actors = scan(spark, f"{folder}/Marktakteure_*.xml", "Marktakteur", FIELDS["Marktakteur"]).withColumnRenamed("MastrNummer", "id").join(ids.select("id"), "id", "left_semi")
    text = ["Firmenname", "Strasse", "Hausnummer", "Postleitzahl", "Ort", "Email", "Telefon", "AcerCode"]
    dates = ["RegistrierungsdatumMarktakteur", "Taetigkeitsbeginn", "Taetigkeitsende"]
    told = last_value(actors, ["id"], "_ord", text).join(last_value(actors, ["id"], "_ord", dates, skip_empty=False), "id")
    return ids.join(told, "id", "left").withColumns({d: safe_date(F.col(d)) for d in dates})


def networks(spark: SparkSession, folder: str) -> DataFrame:
    """The last record of each network."""
    n = scan(spark, f"{folder}/Netze.xml", "Netz", FIELDS["Netz"])
    n = n.withColumns({"has_customers": F.col("KundenAngeschlossen") == "1", "closed": F.col("GeschlossenesVerteilnetz") == "1"})
    return pick(n, ["MastrNummer"], [F.col("_ord").desc()]).select(F.col("NetzbetreiberMastrNummer").alias("id"), "MastrNummer", "Sparte", "has_customers", "closed")


def connection_points(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record, with the level of the last record of its number."""
    p = scan(spark, f"{folder}/Netzanschlusspunkte_*.xml", "Netzanschlusspunkt", FIELDS["Netzanschlusspunkt"])
    last = p.groupBy("NetzanschlusspunktMastrNummer").agg(F.max_by("Spannungsebene", "_ord").alias("level"), F.max_by("NetzbetreiberMaStRNummer", "_ord").alias("owner"))
    return p.select("NetzanschlusspunktMastrNummer", F.col("NetzbetreiberMaStRNummer").alias("id")).join(last, "NetzanschlusspunktMastrNummer").select(F.col("NetzanschlusspunktMastrNummer").alias("cp"), "id", "level", "owner")


def location_operator(spark: SparkSession, folder: str, points: DataFrame) -> DataFrame:
    """(location, id): the operator of the first connection point that has one."""
    loc = scan(spark, f"{folder}/Lokationen_*.xml", "Lokation", FIELDS["Lokation"])
    loc = pick(loc, ["MastrNummer"], [F.col("_ord").desc()]).select(F.col("MastrNummer").alias("location"), listed(F.coalesce("NetzanschlusspunkteMaStRNummern", F.lit("")), ";").alias("cps"))
    owners = points.filter(F.length("owner") > 0).select("cp", F.col("owner").alias("id")).distinct()
    return first_match(loc, "cps", owners, "cp", "id", "location")


def units(spark: SparkSession, folder: str, include_inactive: bool = False) -> DataFrame:
    """Units of the five kinds, active ones unless all are wanted."""
    parts = [scan(spark, f"{folder}/{glob}", tag, FIELDS["Einheit"]).withColumn("unit_type", F.lit(kind)) for glob, tag, kind in UNITS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out if include_inactive else out.filter(F.col("EinheitBetriebsstatus") == ACTIVE)
    return out.select("EinheitMastrNummer", F.col("LokationMaStRNummer").alias("location"), "Energietraeger", "unit_type", F.col("Bruttoleistung").try_cast("decimal(18,4)").alias("kw"))


def statistics(spark: SparkSession, folder: str, quick: bool = False) -> DataFrame:
    """One row for each operator with counts, networks, capacities and has_full_data."""
    who, points = operators(spark, folder), connection_points(spark, folder)
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVEL_NUMBERS.items() for x in kv]), F.col("level")), F.lit("other"))
    names = [*LEVEL_NUMBERS.values(), "other"]
    cps = points.groupBy("id").agg(*(F.count_if(level == n).alias(f"cp_{n}") for n in names), F.count("*").alias("cp_total"))
    power = F.col("Sparte") == "20"
    nets = networks(spark, folder).groupBy("id").agg(F.count_if(power).alias("networks"), F.coalesce(F.bool_or(F.when(power, F.col("has_customers"))), F.lit(False)).alias("has_customers"), F.coalesce(F.bool_or(F.when(power, F.col("closed"))), F.lit(False)).alias("closed"))
    zero = [*(f"cp_{n}" for n in names), "cp_total", "networks"]
    parts = [cps, nets]
    if not quick:
        u = units(spark, folder).join(location_operator(spark, folder, points), "location")
        source = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_NUMBERS.items() for x in kv]), F.col("Energietraeger")), F.lit("other"))
        mw = lambda cond: (F.coalesce(F.sum(F.when(cond, F.col("kw"))), F.lit(0)) / 1000).cast("decimal(18,4)")
        sums = {f"mw_{s}": mw(source == s) for s in ("solar", "wind", "storage", "biomass", "hydro", "other")} | {"mw_total": mw(F.lit(True))}
        kinds = {f"n_{k}": F.count_if(F.col("unit_type") == k) for _, _, k in UNITS}
        parts.append(u.groupBy("id").agg(*(v.alias(k) for k, v in (sums | kinds).items())))
        zero += [*sums, *kinds]
    out = with_defaults(who, parts, "id", zero)
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_customers", "closed")})
    full: Column = F.col("cp_total") > 0
    return out.withColumn("has_full_data", full & (F.lit(quick) | (F.col("mw_total") > 0)) if not quick else F.lit(False))
