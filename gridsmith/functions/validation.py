"""Bounds of records that are imported (F18), and what is unusual or too little in those extracted."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.catalogs import BOUNDS, LEVELS, NO_DATA, STATUSES, USUAL
from gridsmith.functions.times import SEASONS

PRICES = ["leistung", "arbeit", "leistung_unter_2500h", "arbeit_unter_2500h"]


def _clock(c: Column) -> Column:
    """HH:MM:SS that is a time of day."""
    return c.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$")


def _common() -> list[Column]:
    low, high = BOUNDS["year"]
    return [
        F.when(~F.coalesce(F.col("year").between(low, high), F.lit(False)), "year"),
        F.when(~F.coalesce(F.col("voltage_level").isin(LEVELS), F.lit(False)), "voltage_level"),
        F.when(F.col("verification_status").isNotNull() & ~F.col("verification_status").isin(STATUSES), "verification_status"),
    ]


def _named(errors: list[Column]) -> Column:
    return F.array_compact(F.array(*errors)).cast("array<string>")


def price_errors() -> Column:
    """Names of the fields of a price record that are out of bounds: year, level and status, and prices, which may be null."""
    low, high = BOUNDS["price"]
    bad = lambda p: ~F.col(p).between(low, high) | F.isnan(F.col(p).cast("double"))
    return _named([*_common(), *[F.when(F.coalesce(bad(p), F.lit(False)), p) for p in PRICES]])


def window_errors() -> Column:
    """The same of a record of windows: each season null or an array of (start, end), ten at most, all times of day."""
    good = lambda w: F.coalesce(_clock(w["start"]) & _clock(w["end"]), F.lit(False))
    return _named([*_common(), *[F.when(F.col(s).isNotNull() & ((F.size(s) > BOUNDS["ranges"]) | ~F.forall(s, good)), s) for s in SEASONS]])


def checked(records: DataFrame, errors: Column, request: str) -> DataFrame:
    """The records with `errors`. A request with more than 500 records is refused whole (`records`), one with a record in
    error too (`request`). Counts are aggregates, so a request of any size is in no task whole."""
    own = records.withColumn("errors", errors)
    sums = own.groupBy(F.col(request).alias("_r")).agg(F.count("*").alias("_n"), F.bool_or(F.size("errors") > 0).alias("_bad"))
    joined = own.join(sums, F.col(request).eqNullSafe(F.col("_r"))).drop("_r")
    more = F.when(F.col("_n") > BOUNDS["records"], F.array(F.lit("records"))).when(F.col("_bad") & (F.size("errors") == 0), F.array(F.lit("request"))).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("errors", F.concat("errors", more)).drop("_n", "_bad")


def has_data(x: Column) -> Column:
    """A field of an extracted record, as text, that says something."""
    return F.coalesce(~F.lower(F.trim(x)).isin(NO_DATA), F.lit(False))


def price_warnings(arbeit: Column, leistung: Column) -> Column:
    """F8: array of `arbeit: not a number`, `arbeit: unusual` and so on, for prices as texts with a comma or a dot; fields without
    data aren't looked at."""
    out = []
    for name, x in (("arbeit", arbeit), ("leistung", leistung)):
        value = F.replace(F.trim(x), F.lit(","), F.lit(".")).try_cast("double")
        wrong = F.when(value.isNull(), f"{name}: not a number").when(~value.between(*USUAL[name]) | F.isnan(value), f"{name}: unusual")
        out.append(F.when(has_data(x), wrong))
    return _named(out)


def sane_files(records: DataFrame, file: str, kind: str) -> DataFrame:
    """(file, n, verdict) of the extracted records of each file: of prices two records at least that hold a price, of time windows two
    records. Counts are added up before they are shuffled."""
    priced = F.count_if(reduce(or_, [has_data(F.col(p).cast("string")) for p in PRICES]))
    n = F.count("*")
    verdict = F.when(n < 2, "too few records").when((F.first(kind) == "netzentgelte") & (priced < 2), "too few prices").otherwise("ok")
    return records.groupBy(file, kind).agg(n.alias("n"), verdict.alias("verdict"))
