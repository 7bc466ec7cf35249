"""Dates and time windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridsmith.catalogs import NO_TIME

SEASONS = ["winter", "fruehling", "sommer", "herbst"]


def safe_date(c: Column) -> Column:
    """The date of an ISO date or datetime."""
    return F.coalesce(F.try_to_timestamp(c).cast("date"), F.to_date(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd"))))


def any_date(c: Column) -> Column:
    """The first of M/D/Y, D/M/Y, ISO and D.M.Y that fits."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)).cast("date") for f in ("M/d/yyyy", "d/M/yyyy", "yyyy-MM-dd", "d.M.yyyy")))


def _times(c: Column) -> Column:
    """T3's cleaning and pairs for one line; lines that hold no even number of times stay."""
    s = F.trim(F.regexp_replace(c, r"(?i)\s*uhr\s*", " "))
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)\s*bis\s*", "-"), r"\s*[-‐–—]\s*", "-")
    all_ = F.regexp_extract_all(s, F.lit(r"([0-9]{1,2}[:.][0-9]{2})"), F.lit(1))
    times = F.transform(all_, lambda t: F.concat(F.lpad(F.split(t, "[:.]")[0], 2, "0"), F.lit(":"), F.split(t, "[:.]")[1]))
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size(times) / 2).cast("int")), lambda i: F.concat_ws("-", F.get(times, 2 * i - 2), F.get(times, 2 * i - 1)))
    return F.when((F.size(times) >= 2) & (F.size(times) % 2 == 0), F.array_join(pairs, "\n")).otherwise(s)


def time_window(c: Column) -> Column:
    """`7:30 Uhr bis 15:30 Uhr` as 07:30-15:30, a line for each window; markers as a dash."""
    none = lambda x: F.lower(F.trim(x)).isin(*NO_TIME)
    lines = F.filter(F.transform(F.split(F.trim(c), "\n"), lambda x: F.when(none(x), F.lit("-")).otherwise(_times(F.trim(x)))), lambda x: x != "-")
    return F.when(c.isNull(), None).when(none(c) | (F.size(lines) == 0), F.lit("-")).otherwise(F.array_join(lines, "\n"))


def time_ranges(c: Column) -> Column:
    """Array of (start, end) as HH:MM:SS; null if there is none."""
    rx = r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?:\s*[-–—‐]\s*|\s+)([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?$"

    def one(p: Column) -> Column:
        g = lambda i: F.regexp_extract(p, rx, i)
        at = lambda i: F.concat_ws(":", F.lpad(g(i), 2, "0"), g(i + 1), F.when(g(i + 2) == "", "00").otherwise(g(i + 2)))
        return F.struct(at(1).alias("start"), at(4).alias("end"))

    parts = F.filter(F.transform(F.split(c, "[,\n]"), lambda x: F.trim(x)), lambda p: p.rlike(rx))
    return F.when(F.size(parts) > 0, F.transform(parts, one))


def clock_pairs(c: Column) -> Column:
    """Array of (start, end) of times of day that stand side by side in a text, a dash or blanks between. Times
    and all other characters are read one after another; any other one parts two times."""
    tokens = F.regexp_extract_all(F.translate(c, "-–—‐", "    "), F.lit(r"[0-9]{1,2}:[0-9]{2}|\S"), F.lit(0))
    start = F.struct(F.lit(None).cast("string").alias("held"), F.array().cast("array<struct<start:string,end:string>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        time = F.length(t) > 1
        pair = time & a["held"].isNotNull()
        return F.struct(F.when(time & ~pair, t).alias("held"), F.when(pair, F.concat(a["out"], F.array(F.struct(a["held"].alias("start"), t.alias("end"))))).otherwise(a["out"]).alias("out"))

    return F.aggregate(tokens, start, step, lambda a: a["out"])


def ranges_text(c: Column) -> Column:
    """Ranges as `HH:MM-HH:MM` joined by commas."""
    return F.array_join(F.transform(c, lambda r: F.concat_ws("-", F.substring(r["start"], 1, 5), F.substring(r["end"], 1, 5))), ", ")


def six_digit_year(c: Column) -> Column:
    """The year of YYMMDD, else DDMMYY, else MMDDYY, from 2020 to 2030."""
    a, b, d = (F.substring(c, i, 2).try_cast("int") for i in (1, 3, 5))
    month, day, year = (lambda x: x.between(1, 12)), (lambda x: x.between(1, 31)), (lambda x: x.between(20, 30))
    return F.when(
        c.rlike("^[0-9]{6}$"), F.when(year(a) & month(b) & day(d), 2000 + a).when(day(a) & month(b) & year(d), 2000 + d).when(month(a) & day(b) & year(d), 2000 + d)
    )


def years_near(c: Column, is_html: Column) -> Column:
    """The latest year in a text; pages of three years or more have none."""
    years = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(20[0-9]{2})"), F.lit(1)), lambda y: y.cast("int")))
    return F.when(is_html & (F.size(years) >= 3), None).otherwise(F.array_max(years))


def seconds_of_day(c: Column) -> Column:
    """HH:MM or HH:MM:SS as seconds."""
    p = F.split(c, ":")
    return F.try_add(p[0].try_cast("int") * 3600 + p[1].try_cast("int") * 60, F.coalesce(F.get(p, F.lit(2)).try_cast("int"), F.lit(0)))
