"""Numbers as German documents write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridsmith.catalogs import NO_NUMBER


def no_value(c: Column, markers: list[str] = NO_NUMBER) -> Column:
    return F.lower(F.trim(c)).isin(*markers)


def german_number(c: Column) -> Column:
    """By the numbers of commas and dots; `1.234` stays 1.234; null if it is none."""
    s = F.trim(c)
    commas, dots = F.regexp_count(s, F.lit(",")), F.regexp_count(s, F.lit(r"\."))
    plain = (
        F.when((commas == 1) & (dots == 0), F.replace(s, F.lit(","), F.lit(".")))
        .when(commas == 1, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when((commas >= 1) & (dots == 1), F.replace(s, F.lit(","), F.lit("")))
        .otherwise(s)
    )
    return F.when(~no_value(c), plain.try_cast("double"))


def german_float(c: Column) -> Column:
    """Any comma makes dots thousands."""
    s = F.trim(c)
    return F.when(~no_value(c), F.when(s.contains(","), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(s).try_cast("double"))


def clean_price(c: Column) -> Column:
    """The trimmed text, markers as a dash."""
    return F.when(c.isNotNull(), F.when(no_value(c), F.lit("-")).otherwise(F.trim(c)))


def parse_year(c: Column) -> Column:
    """A four-digit year from 1900 to 2099 in the text, else the whole as a number to 2100."""
    found = F.regexp_extract(c, r"(?:^|[^0-9A-Za-z_])((?:19|20)[0-9]{2})(?:$|[^0-9A-Za-z_])", 1)
    whole = F.trim(c).try_cast("int")
    return F.when(found != "", found.try_cast("int")).when(whole.between(1900, 2100), whole)


def falsy(a: Column, b: Column) -> Column:
    """Zero counts as missing."""
    return F.coalesce(F.nullif(a, F.lit(0)), b)


def log_share(value: Column, p90: Column) -> Column:
    """log1p of the value over that of an anchor, within 0 and 1; null stays."""
    share = F.log1p(value) / F.log1p(F.greatest(p90, F.lit(1.0)))
    return F.when(value.isNull(), None).when(value <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


def bytes_text(c: Column) -> Column:
    """Bytes in units of 1024 with one place."""
    return F.when(c < 1024, F.format_string("%d B", c)).when(c < 1024 * 1024, F.format_string("%.1f KB", c / 1024)).otherwise(F.format_string("%.1f MB", c / (1024 * 1024)))
