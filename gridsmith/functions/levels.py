"""Voltage levels: normalisation (G15), expectations (C15) and order."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridsmith.catalogs import BUCKET_LEVELS, KV_LEVELS, LEVEL_ALIASES, LEVELS


#: What every alias and every voltage has somewhere in its cleaned text.
_MAY = "[hmnö]s|spannung|v"


def _lookup(m: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), key)


def _kv(number: Column, volt: Column) -> Column:
    n = F.regexp_replace(F.replace(number, F.lit(","), F.lit(".")), r"\.0$", "").try_cast("double")
    kv = F.when(volt, n / 1000).otherwise(n)
    return _lookup(KV_LEVELS, F.when(kv == F.floor(kv), kv.cast("long").cast("string")).otherwise(kv.cast("string")))


def _clean(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\s*([-/])\s*", "$1"), "[()]", ""))


def _part(s: Column) -> Column:
    """All rules but the last, which takes the sides of a slash by themselves."""
    full = r"([0-9]+(?:[.,][0-9]+)?)\s*kv\s*/\s*([0-9]+(?:[.,][0-9]+)?)\s*(kv|v)(?![0-9a-zäöüß_])"
    tail = r"([0-9]+(?:[.,][0-9]+)?)\s*/\s*([0-9]+(?:[.,][0-9]+)?)\s*kv"
    one = r"([0-9]+(?:[.,][0-9]+)?)\s*(kv|v)(?![0-9a-zäöüß_])"
    g = lambda rx, i: F.regexp_extract(s, rx, i)
    no = F.lit(False)
    pair = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("/", a, b))
    exact = {k: v for k, v in LEVEL_ALIASES.items() if "(" not in k}
    contained = []
    for alias in sorted(LEVEL_ALIASES, key=len, reverse=True):
        plain = alias.replace(" -", "-").replace(" /", "/")
        word = "(?<![0-9a-zäöüß_])" + plain + "(?![0-9a-zäöüß_])"
        contained.append(F.when(s.rlike(word) if len(plain) <= 4 else s.contains(plain), F.lit(LEVEL_ALIASES[alias])))
    volts = F.coalesce(pair(_kv(g(full, 1), no), _kv(g(full, 2), g(full, 3) == "v")), pair(_kv(g(tail, 1), no), _kv(g(tail, 2), no)), _kv(g(one, 1), g(one, 2) == "v"))
    return F.coalesce(_lookup(exact, s), F.when(s.contains("v"), volts), *contained)


def normalize(c: Column) -> Column:
    """The level a text names, or null."""
    # one text at a time, so that each step is computed once, and one copy of the rules for the whole and both sides
    sides = F.transform(F.array(_clean(c)), lambda s: F.when(s.rlike(_MAY), F.when(F.regexp_count(s, F.lit("/")) == 1, F.array(s, F.substring_index(s, "/", 1), F.substring_index(s, "/", -1))).otherwise(F.array(s))))

    def told(got: Column) -> Column:
        left, right = F.get(got, F.lit(1)), F.get(got, F.lit(2))
        return F.coalesce(F.get(got, F.lit(0)), F.when((F.length(left) <= 3) & (F.length(right) <= 3), F.concat_ws("/", left, right)))

    # what has neither of these letters is read no further: most cells of tables are numbers and times
    return F.when(F.lower(c).rlike("[sv]"), F.transform(F.transform(sides, lambda x: F.transform(x, _part)), told)[0])


def _wanted(points: Column) -> dict[str, Column]:
    """For each level, highest first, whether a map of connection points lets one expect it."""
    has = {k: F.coalesce(F.try_element_at(points, F.lit(k)), F.lit(0)) > 0 for k in BUCKET_LEVELS}
    return {x: reduce(or_, [has[k] for k, v in BUCKET_LEVELS.items() if x in v], F.lit(False)) for x in LEVELS}


def expected(points: Column) -> Column:
    """Levels that a map of connection points lets one expect, highest first."""
    return F.array_compact(F.array(*[F.when(w, F.lit(x)) for x, w in _wanted(points).items()])).cast("array<string>")


def completeness(points: Column, tariff: Column, windows: Column) -> Column:
    """Struct of score, expected and covered counts and whether there were expectations. Levels are counted one
    by one, with no array made of them."""
    wanted = _wanted(points)
    want = sum((w.cast("int") for w in wanted.values()), F.lit(0))
    covered = F.when(tariff.isNotNull(), sum(((w & F.coalesce(F.array_contains(tariff, F.lit(x)), F.lit(False))).cast("int") for x, w in wanted.items()), F.lit(0)))
    has = points.isNotNull() & (want > 0)
    any_ = (F.size(tariff) > 0) | (F.size(windows) > 0)
    return F.struct(
        F.when(has, F.bround(covered * 100.0 / want)).otherwise(F.when(any_, 100.0).otherwise(0.0)).cast("int").alias("score"),
        F.when(has, want).otherwise(0).alias("expected"),
        F.when(has, covered).otherwise(0).alias("covered"),
        F.coalesce(has, F.lit(False)).alias("has_expectations"),
    )


def order_key(level: Column, levels: list[str] = LEVELS) -> Column:
    """Place in the canonical order, unknown ones last."""
    at = F.array_position(F.array(*[F.lit(x) for x in levels]), level)
    return F.when(at > 0, at).otherwise(999)
