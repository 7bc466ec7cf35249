"""Names, addresses, hashes, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.catalogs import DANGEROUS, FILE_WORDS, GLANCE_WORDS
from gridsmith.functions.times import six_digit_year


def _swap(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


UMLAUTS = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")]


def slug(c: Column, umlauts: bool = True) -> Column:
    """G1: lower case, umlauts spelled out if wanted, other characters as single dashes."""
    s = F.lower(c)
    s = _swap(s, UMLAUTS) if umlauts else s
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", "-"), F.lit("-"))


def slug_spaces(c: Column) -> Column:
    """G1, spaces first: spaces as dashes, then all but letters, digits and dashes dropped."""
    s = F.regexp_replace(F.trim(_swap(F.lower(c), UMLAUTS)), r"\s+", "-")
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9-]", ""), "-+", "-")


def address_key(street: Column, zip_code: Column) -> Column:
    """SHA-256 of street name, number and zip code, joined by bars: `Musterstraße 5`
    is musterstr|5."""
    low = F.lower(F.trim(street))
    number = F.regexp_extract(low, r"([0-9]+\s*[a-z]?)\s*$", 1)
    name = F.trim(F.regexp_replace(low, r"[0-9]+\s*[a-z]?\s*$", ""))
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "stra(ß|ss)e", "str"), r"str\.", "str"), r"[\s.-]+", "")
    return F.sha2(F.concat_ws("|", name, F.regexp_replace(number, r"\s", ""), F.trim(zip_code)), 256)


LEGAL = r"\b(gmbh|ag|kg|co|mbh|ohg|eg|kgaa|se|e\.?v)\b\.?"


def company_name(c: Column) -> Column:
    """Legal forms, years and punctuation dropped, one space between words."""
    s = F.regexp_replace(F.lower(c), LEGAL, " ")
    s = F.regexp_replace(s, r"\b(19|20)[0-9]{2}\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9äöüß]+", " "), " +", " "))


def clean_string(c: Column, most: int | None = None) -> Column:
    """One space between words; null if empty; beyond `most` characters an ellipsis."""
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    s = F.nullif(s, F.lit(""))
    return s if most is None else F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 3), F.lit("..."))).otherwise(s)


def short_hash(c: Column, n: int = 12) -> Column:
    """G12."""
    return F.left(F.sha2(c, 256), F.lit(n))


def yes(c: Column) -> Column:
    """G14."""
    return F.coalesce(F.lower(F.trim(c)) == "ja", F.lit(False))


def listed(c: Column, sep: str) -> Column:
    """Trimmed parts that aren't empty."""
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


def file_type(name: Column) -> Column:
    """The type whose words in the name weigh 5 or more, and more than the other's."""
    tokens = F.split(F.lower(name), r"[-_.\s]")
    score = {k: sum((F.array_contains(tokens, w).cast("int") * n for w, n in v.items()), F.lit(0)) for k, v in FILE_WORDS.items()}
    a, b = score["netzentgelte"], score["hlzf"]
    return F.when((a >= 5) & (a > b), "netzentgelte").when((b >= 5) & (b > a), "hlzf")


def file_year(name: Column) -> Column:
    """The last year 20xx in the name, else of the first six digits that are a date."""
    years = F.regexp_extract_all(F.lower(name), F.lit("(20[0-9]{2})"), F.lit(1))
    dates = F.array_compact(F.transform(F.regexp_extract_all(name, F.lit("([0-9]{6})"), F.lit(1)), six_digit_year))
    return F.coalesce(F.try_element_at(years, F.lit(-1)).cast("int"), F.try_element_at(dates, F.lit(1)))


def prompt_value(c: Column, most: int = 200) -> Column:
    """Control characters and braces dropped."""
    return F.substring(F.regexp_replace(c, r"[\x00-\x1f{}<>`]", ""), 1, most)


def client_ip(forwarded: Column, proxies: int = 1) -> Column:
    """The n-th address from the right, or the first."""
    parts = F.transform(F.split(forwarded, ","), lambda x: F.trim(x))
    return F.element_at(parts, F.greatest(F.lit(1), F.size(parts) - proxies + 1))


def dangerous(c: Column) -> Column:
    """the text holds what could run as code, control characters apart."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f]", "").rlike("(?iU)" + "|".join(f"(?:{p})" for p in DANGEROUS))


def sanitized(c: Column, most: int = 1000) -> Column:
    """struct of value and error. Too long or dangerous texts have an error and no value; of others control
    characters are dropped, but line ends and tabs, and the characters that HTML needs are escaped."""
    plain = F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f]", "")
    error = F.when(F.length(c) > most, "too long").when(dangerous(c), "dangerous content")
    return F.struct(F.when(error.isNull(), _swap(plain, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")])).alias("value"), error.alias("error"))


def sanitized_time(c: Column) -> Column:
    """Struct of value and error: a window HH:MM-HH:MM, a dash or nothing."""
    good = c.isin("", "-") | c.rlike(r"^[0-9]{1,2}:[0-9]{2}-[0-9]{1,2}:[0-9]{2}$")
    return F.struct(F.when(good, c).alias("value"), F.when(~good, "no time window").alias("error"))


def sanitized_rows(df: DataFrame, texts: list[str], times: list[str], most: int = 1000) -> DataFrame:
    """The rows with these columns sanitized and `errors`, an array of `column: error`; a row with errors is to be
    refused as a whole. Other columns stay as they are."""
    found = {n: sanitized(F.col(n), most) for n in texts} | {n: sanitized_time(F.col(n)) for n in times}
    errors = F.array_compact(F.array(*[F.concat(F.lit(f"{n}: "), v["error"]) for n, v in found.items()])).cast("array<string>")
    return df.withColumns({**{n: v["value"] for n, v in found.items()}, "errors": errors})


def glance(first_page: Column, year: Column) -> Column:
    """a document's first page names the year and has a word of price sheets."""
    low = F.lower(first_page)
    return F.contains(first_page, year.cast("string")) & F.exists(F.array(*[F.lit(w) for w in GLANCE_WORDS]), lambda w: F.contains(low, w))


def subsequence(c: Column, wanted: str) -> Column:
    """contains the wanted text, or else all its characters in order."""
    import re

    return F.lower(c).rlike(".*".join(re.escape(x) for x in wanted.lower()))
