"""Addresses: parts, normal form, safety, patterns, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.catalogs import ADDRESS_POINTS, DOCUMENT_ENDINGS, NEGATIVE_WORDS, TOKEN_URLS, TRACKING, YEAR_PATTERNS

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, name: str) -> Column:
    """scheme, authority, path or query; empty if missing."""
    return F.regexp_extract(url, _URL, ["scheme", "authority", "path", "query"].index(name) + 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, "authority"), r"^.*@", ""), r":[0-9]*$", ""))


def port(url: Column) -> Column:
    return F.nullif(F.regexp_extract(part(url, "authority"), r":([0-9]+)$", 1), F.lit("")).try_cast("int")


def normalize(url: Column) -> Column:
    """G6, for ASCII addresses: host and scheme in lower case, default ports, fragments,
    double slashes and tracking parameters dropped, the others sorted."""
    scheme, p = F.lower(part(url, "scheme")), port(url)
    default = ((scheme == "http") & (p == 80)) | ((scheme == "https") & (p == 443))
    path = F.regexp_replace(part(url, "path"), "/+", "/")
    params = F.filter(F.split(part(url, "query"), "&"), lambda x: x != "")
    name = lambda x: F.lower(F.split(x, "=")[0])
    kept = F.filter(params, lambda x: ~name(x).isin(*TRACKING) & ~name(x).startswith("utm_"))
    query = F.array_join(F.array_sort(F.transform(kept, lambda x: F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("="))))), "&")
    whole = F.concat(scheme, F.lit("://"), host(url), F.when(p.isNotNull() & ~default, F.concat(F.lit(":"), p)).otherwise(""), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(part(url, "scheme") != "", whole).otherwise(url)


def domain(url: Column) -> Column:
    """Host without www."""
    return F.nullif(F.regexp_replace(host(url), r"^www\.", ""), F.lit(""))


def safe(url: Column, ports: tuple[int, ...] = (80, 443, 8080, 8443)) -> Column:
    """web scheme, a host, no user, a common port."""
    s = part(url, "scheme")
    return s.isin("http", "https") & ~part(url, "authority").contains("@") & (host(url) != "") & F.coalesce(port(url), F.when(s == "https", 443).otherwise(80)).isin(*ports)


def allowed(url: Column, domains: list[str]) -> Column:
    """the host is one of the domains or below one."""
    h = host(url)
    out = F.lit(False)
    for d in domains:
        out = out | (h == d.lower()) | h.endswith("." + d.lower())
    return out


def in_list(rows: DataFrame, url: str, domains: DataFrame, domain_col: str) -> DataFrame:
    """F12 for a list of any size: the rows whose host is one of the domains or below one. Each distinct host is
    looked up with its suffixes, by equality, so the list is never held by one task, nor rows shuffled for it."""
    hosts = rows.select(host(F.col(url)).alias("_h")).filter("_h != ''").distinct()
    labels = F.split("_h", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = domains.select(F.lower(F.trim(domain_col)).alias("_d")).filter("_d != ''").distinct()
    good = hosts.select("_h", F.explode(ends).alias("_d")).join(known, "_d", "left_semi").select("_h").distinct()
    return rows.withColumn("_h", host(F.col(url))).join(good, "_h", "left_semi").drop("_h")


def file_type(url: Column) -> Column:
    """G8, by contents of the address."""
    u = F.lower(url)
    return F.when(u.contains(".pdf"), "pdf").when(u.contains(".xlsx"), "xlsx").when(u.contains(".xls"), "xls").when(u.contains(".doc"), "doc").otherwise("unknown")


def year_template(url: Column, year: Column) -> Column:
    """The year in an address as {year}."""
    return F.replace(url, year.cast("string"), F.lit("{year}"))


def path_patterns(url: Column) -> Column:
    """The path with years as {year}, its segments and its beginnings, distinct and sorted."""
    path = part(url, "path")
    path = F.when(F.element_at(F.split(path, "/"), -1).contains("."), F.regexp_replace(path, "[^/]*$", "")).otherwise(path)
    whole = F.regexp_replace(path, "/20[0-9]{2}/", "/{year}/")
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike("^20[0-9]{2}$"))
    parts = F.split(F.trim(whole, F.lit("/")), "/")
    begin = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    begin = F.when(F.size(parts) > 1, begin).otherwise(F.array().cast("array<string>"))
    all_ = F.concat(F.array(whole), F.transform(segments, lambda s: F.concat(F.lit("/"), s, F.lit("/"))), begin)
    return F.array_sort(F.array_distinct(F.filter(all_, lambda p: ~p.isin("", "/"))))


def _sum(parts: list[Column]) -> Column:
    out = F.lit(0)
    for p in parts:
        out = out + p
    return out


def negative(url: Column, text: Column) -> Column:
    u, t = F.lower(url), F.lower(F.coalesce(text, F.lit("")))
    return _sum([F.when(u.contains(w) | t.contains(w), n).otherwise(0) for w, n in NEGATIVE_WORDS])


def discovery_score(url: Column, text: Column, words: list[str], year: int | None) -> Column:
    """C4: struct of score, words found and whether the year stands in the address or text."""
    u, t = F.lower(url), F.lower(F.coalesce(text, F.lit("")))
    kind = file_type(url)
    score = F.when(kind == "pdf", 20).when(kind.isin("xlsx", "xls"), 15).when(kind == "doc", 5).otherwise(0)
    score = score + _sum([F.when(u.contains(w), 15).otherwise(0) + F.when(t.contains(w), 5).otherwise(0) for w in words]) + negative(url, text)
    found = F.array_compact(F.array(*[F.when(u.contains(w) | t.contains(w), w) for w in words]))
    has = F.lit(False)
    if year is not None:
        y = str(year)
        has = url.contains(y) | F.coalesce(text.contains(y), F.lit(False))
        score = score + F.when(url.contains(y), 50).when(F.coalesce(text.contains(y), F.lit(False)), 25).otherwise(0)
    return F.struct(score.cast("double").alias("score"), found.alias("words"), has.alias("has_year"))


def years_in(url: Column) -> Column:
    found = [F.regexp_extract_all(F.lower(url), F.lit(p), F.lit(1)) for p in YEAR_PATTERNS]
    return F.array_distinct(F.transform(F.concat(*found), lambda y: y.cast("int")))


def year_bonus(url: Column, target: int, now: int) -> Column:
    """The target year 50, others by age."""
    one = lambda y: F.when(y == target, 50).when(y < now - 10, -30).when(y.between(now - 6, now + 1), 10).otherwise(3)
    return F.aggregate(years_in(url), F.lit(0), lambda a, y: a + one(y))


def crawl_score(url: Column, depth: Column, text: Column, words: list[str], target: int, now: int, irrelevant: list[str]) -> Column:
    """Depth, documents, words, years, irrelevant paths and words against."""
    u, t = F.lower(url), F.lower(F.coalesce(text, F.lit("")))
    any_ = lambda tests: F.greatest(*tests, F.lit(False))
    document = F.when(any_([url.rlike("(?i)" + p) for p in TOKEN_URLS]), 40).otherwise(0) + F.when(any_([u.endswith(e) for e in DOCUMENT_ENDINGS]), 20).otherwise(0) + F.when(u.endswith(".pdf"), 10).otherwise(0)
    words_ = _sum([F.when(u.contains(w), 15).otherwise(0) + F.when(t.contains(w), 10).otherwise(0) for w in words])
    off = F.when(any_([u.contains(p) for p in irrelevant]), -50).otherwise(0)
    told = F.when(F.coalesce(text.contains(str(target)), F.lit(False)), 25).otherwise(0)
    return (document - depth * 2 + words_ + year_bonus(url, target, now) + told + off + negative(url, text)).cast("double")


def kind_points(url: Column, kind: str) -> Column:
    """Points of an address for a kind of document; none for the kind "all". A price sheet
    that says nothing of peak load loses ten for time windows."""
    u = F.lower(url)
    said = lambda words: F.greatest(*[u.contains(w) for w in words], F.lit(False))
    points = _sum([F.when(said(words), n).otherwise(0) for words, n in ADDRESS_POINTS.get(kind, [])])
    prices_only = u.contains("preisblatt") & ~u.contains("hochlast")
    return (points - F.when(prices_only, 10).otherwise(0) if kind == "hlzf" else points).cast("double")
