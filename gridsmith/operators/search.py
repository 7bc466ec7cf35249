"""Fuzzy name search: trigram similarity as array expressions, candidates by an
inverted trigram table, acceptance by sequence ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.functions import levels
from gridsmith.operators.joins import band
from gridsmith.session import written


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words of a text, each word padded by two blanks before
    and one behind."""
    words = F.filter(F.split(F.lower(c), "[^a-z0-9äöüß]+"), lambda w: w != "")

    def of(w: Column) -> Column:
        p = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams among all of two trigram arrays."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(a) + F.size(b) - shared), F.lit(0.0))


def threshold(length: int) -> float:
    """short searches accept less."""
    return 0.08 if length <= 3 else 0.12 if length <= 5 else 0.2


def hybrid(df: DataFrame, name: str, region: str, wanted: str) -> DataFrame:
    """Rows that contain the text or resemble it, with their relevance."""
    q = F.lit(wanted)
    sim = similarity(trigrams(F.col(name)), trigrams(q))
    in_name, in_region = F.lower(F.col(name)).contains(wanted.lower()), F.lower(F.col(region)).contains(wanted.lower())
    scored = df.withColumn("_sim", sim).withColumn("relevance", F.round(F.col("_sim") + F.when(in_name, 2.0).otherwise(0.0) + F.when(in_region, 0.5).otherwise(0.0), 6))
    return scored.filter(in_name | in_region | (F.col("_sim") > threshold(len(wanted)))).drop("_sim")


#: Names of one trigram for each task that it is dealt to, on either side.
HOT = 2_000


def candidates(left: DataFrame, right: DataFrame, lid: str, lname: str, rid: str, rname: str, least: float) -> DataFrame:
    """(lid, rid, sim) of pairs of names with that similarity or more, through shared trigrams.

    Only a prefix of each name's trigrams, the rarest, is looked up, which is enough for every pair at the
    threshold and leaves frequent trigrams alone. Of two names that meet, the numbers of trigrams and
    what can still be shared beyond the places where they meet must allow the similarity. A trigram that many
    prefixes hold is dealt to several tasks, each a part of the left's names by a part of the right's."""
    both = left.select(trigrams(F.col(lname)).alias("g")).union(right.select(trigrams(F.col(rname)).alias("g")))
    df = both.select(F.explode("g").alias("t")).groupBy("t").agg(F.count("*").alias("df"))

    def ranked(d: DataFrame, key: str, name: str, out: str) -> DataFrame:
        g = d.select(F.col(key).alias(out), F.explode(trigrams(F.col(name))).alias("t")).join(df, "t")
        g = g.groupBy(out).agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("s")).withColumn(f"{out}_g", F.transform("s", lambda x: x["t"]))
        n = F.size("s")
        return g.withColumn("pre", F.slice(f"{out}_g", F.lit(1), n - F.ceil(n * F.lit(least)).cast("int") + 1)).drop("s")

    a, b = written(ranked(left, lid, lname, "lid")), written(ranked(right, rid, rname, "rid"))
    pick = lambda d, k: d.select(k, F.size(f"{k}_g").alias(f"{k}_n"), F.posexplode("pre").alias(f"{k}_p", "t"))
    x, y = pick(a, "lid"), pick(b, "rid")
    # parts of the left's and the right's names of each trigram
    cuts = x.select("t", F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(y.select("t", F.lit(0), F.lit(1))).groupBy("t").agg(F.ceil(F.sum("l") / HOT).cast("int").alias("kl"), F.ceil(F.sum("r") / HOT).cast("int").alias("kr")).filter("kl > 0 and kr > 0")
    part = lambda k, n: F.pmod(F.xxhash64(k), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = x.join(cuts, "t").withColumn("i", part("lid", "kl")).withColumn("j", every("kr")).drop("kl", "kr")
    y = y.join(cuts, "t").withColumn("j", part("rid", "kr")).withColumn("i", every("kl")).drop("kl", "kr")
    n, m = F.col("lid_n"), F.col("rid_n")
    # shared / (n + m - shared) >= least
    needed = (n + m) * least / (1 + least) - 1e-9
    left_over = F.least(n - F.col("lid_p"), m - F.col("rid_p"))  # with the trigram where they meet
    before = F.least("lid_p", "rid_p")
    pairs = x.join(y, ["t", "i", "j"]).filter((F.least(n, m) >= needed) & (left_over + before >= needed)).select("lid", "rid").distinct()
    scored = pairs.join(a.select("lid", "lid_g"), "lid").join(b.select("rid", "rid_g"), "rid").withColumn("sim", similarity(F.col("lid_g"), F.col("rid_g")))
    return scored.filter(F.col("sim") >= least - 1e-12).select(F.col("lid").alias(lid), F.col("rid").alias(rid), "sim")


def _codes(texts: list[str]) -> np.ndarray:
    """Code points, a row for each text, filled with -1."""
    out = np.full((len(texts), max(map(len, texts), default=0)), -1, np.int64)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Share of matching characters of each pair: the longest block that both have (the first in a, then in b), and
    so on to its left and right. All pairs are searched at once, a column of a at a time."""
    x, y = _codes(a), _codes(b)
    la, lb = np.array([len(t) for t in a], np.int64), np.array([len(t) for t in b], np.int64)
    matched = np.zeros(len(a), np.int64)
    places = np.arange(y.shape[1])
    todo = np.stack([np.arange(len(a)), np.zeros_like(la), la, np.zeros_like(lb), lb], 1)  # pair, from and to in a and in b
    while len(todo := todo[(todo[:, 1] < todo[:, 2]) & (todo[:, 3] < todo[:, 4])]):
        p, alo, ahi, blo, bhi = todo.T
        inside = (places >= blo[:, None]) & (places < bhi[:, None])
        theirs, run = y[p], np.zeros((len(p), y.shape[1] + 1), np.int64)
        size, end_a, end_b = (np.zeros(len(p), np.int64) for _ in range(3))
        for i in range(int(alo.min()), int(ahi.max())):
            same = (theirs == x[p, i][:, None]) & inside & ((i >= alo) & (i < ahi))[:, None]
            run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            at = run.argmax(1)
            most = run[np.arange(len(p)), at]
            better = most > size
            size[better], end_a[better], end_b[better] = most[better], i + 1, at[better]
        matched += np.bincount(p, size, len(a)).astype(np.int64)
        found = size > 0
        p, alo, ahi, blo, bhi, size, end_a, end_b = (v[found] for v in (p, alo, ahi, blo, bhi, size, end_a, end_b))
        todo = np.concatenate([np.stack([p, alo, end_a - size, blo, end_b - size], 1), np.stack([p, end_a, ahi, end_b, bhi], 1)])
    return np.where(la + lb > 0, 2 * matched / np.maximum(la + lb, 1), 1.0)


@F.pandas_udf(T.DoubleType())
def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of matching characters of two texts, by longest matching blocks; short texts first, so a batch is narrow."""
    for a, b in pairs:
        a, b = a.fillna("").tolist(), b.fillna("").tolist()
        out, order = np.zeros(len(a)), sorted(range(len(a)), key=lambda i: len(b[i]))
        for k in range(0, len(order), 512):
            some = order[k : k + 512]
            out[some] = ratios([a[i] for i in some], [b[i] for i in some])
        yield pd.Series(out)


#: What of a name doesn't tell companies apart, and how alike short and long names must be.
LEGAL_END = r"(?i)\s*\b(gmbh|mbh|ag|kg|co\.\s*kg|gmbh\s*&\s*co\.\s*kg|se|e\.?\s*v\.?|ohg|ug)\s*$"
ALIKE_SHORT, ALIKE_LONG, LONG = 0.9, 0.8, 15


def plain_name(c: Column) -> Column:
    """A name without a legal form or a year in brackets at its end, punctuation as blanks, in lower case."""
    n = F.trim(F.regexp_replace(c, LEGAL_END, ""))
    n = F.trim(F.regexp_replace(n, r"\s*\([0-9]{4}\)\s*$", ""))
    return F.lower(F.trim(F.regexp_replace(n, r"[\s\-./+,]+", " ")))


def alike(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of names (columns a, b) that are plausibly one company's: alike enough, or the shorter begins the longer.
    Only pairs that their lengths and beginnings leave open are compared in full."""
    p = pairs.withColumns({"_x": plain_name(F.col(a)), "_y": plain_name(F.col(b))})
    short, long = F.least(F.length("_x"), F.length("_y")), F.greatest(F.length("_x"), F.length("_y"))
    first = F.when(F.length("_x") <= F.length("_y"), F.startswith(F.col("_y"), F.col("_x"))).otherwise(F.startswith(F.col("_x"), F.col("_y"))) & (short >= 3)
    enough = F.when(short < LONG, ALIKE_SHORT).otherwise(ALIKE_LONG)
    p = p.withColumns({"_first": first, "_enough": enough, "_most": F.when(short + long > 0, 2 * short / (short + long)).otherwise(1.0)})
    sure = p.filter("_first")
    open_ = p.filter("not _first and _most >= _enough").withColumn("_r", ratio("_x", "_y")).filter("_r >= _enough")
    return sure.select(pairs.columns).unionAll(open_.select(pairs.columns))


def resolve(names: DataFrame, known: DataFrame, key: str, name: str, kid: str, kname: str) -> DataFrame:
    """(key, kid, outcome): exact names first, then the most similar one by trigrams if it is alike."""
    exact = names.select(key, name, F.lower(F.trim(name)).alias("_n")).join(known.groupBy(F.lower(F.trim(kname)).alias("_n")).agg(F.min(kid).alias(kid)), "_n", "left")
    rest = exact.filter(F.col(kid).isNull()).select(key, name)
    near = candidates(rest, known, key, name, kid, kname, 0.3).join(rest, key).join(known.select(kid, kname), kid)
    best = near.groupBy(key, name).agg(F.max(F.struct("sim", (-F.col(kid)).alias("m"), F.col(kname).alias("_k"))).alias("b"))
    accepted = alike(best.select(key, (-F.col("b.m")).alias(kid), F.col(name).alias("_a"), F.col("b._k").alias("_k")), "_a", "_k").select(key, kid, F.lit("fuzzy").alias("outcome"))
    found = exact.filter(F.col(kid).isNotNull()).select(key, kid, F.lit("exact").alias("outcome")).union(accepted)
    return names.select(key).join(found, key, "left").withColumn("outcome", F.coalesce("outcome", F.lit("missing")))


def waterfall(asked: DataFrame, locations: DataFrame, answers: DataFrame, width: float = 0.0001) -> DataFrame:
    """(ask, operator, outcome) of addresses (ask, key): the operator of the stored location
    with that key (cached); else that of a stored location within `width` of the answered
    coordinates (near); else the answered operator, one for electricity first (skeleton).
    Without coordinates or operator the outcome is missing.

    locations: key, lat, lon, operator; answers: ask, lat, lon, operator, electricity, of any
    number of operators for an address. Each step asks only what the one before left."""
    held = locations.filter("key is not null").groupBy("key").agg(F.min("operator").alias("operator"))
    looked = asked.join(held, "key", "left")
    left = looked.filter("operator is null").select("ask")
    best = answers.join(left, "ask", "left_semi").groupBy("ask").agg(F.min(F.when(F.col("operator").isNotNull(), F.struct((~F.coalesce("electricity", F.lit(False))).alias("other"), F.col("operator")))).alias("b"), F.min(F.struct("lat", "lon")).alias("at"))
    placed = best.select("ask", F.col("at.lat").alias("x"), F.col("at.lon").alias("y"), F.col("b.operator").alias("told"))
    # each place meets each stored place once, however many addresses and locations are there
    spots = locations.groupBy("lat", "lon").agg(F.min("operator").alias("near"))
    hits = band(placed.select("x", "y").distinct(), spots, "x", "y", "lat", "lon", width)
    near = placed.join(hits.groupBy("x", "y").agg(F.min("near").alias("near")), ["x", "y"], "left")
    found = looked.join(near.select("ask", "told", "near"), "ask", "left")
    outcome = F.when(F.col("operator").isNotNull(), "cached").when(F.col("near").isNotNull(), "near").when(F.col("told").isNotNull(), "skeleton").otherwise("missing")
    return found.select("ask", F.coalesce("operator", "near", "told").alias("operator"), outcome.alias("outcome"))


def response(operators: DataFrame, facts: DataFrame) -> DataFrame:
    """For each of (id, name, points) its facts as arrays (year, level, value), their
    completeness against the levels its connection points let one expect, and a message where
    there is none. Facts are (id, year, level, value, kind), of kind prices or hours, one for a year and level, so
    that an operator's arrays are small. They are read once and meet the operators in one join."""
    kind = "array<struct<year:int,level:string,value:double>>"
    of_kind = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("year", "level", "value"))))
    nested = facts.groupBy("id").agg(of_kind("prices").alias("prices"), of_kind("hours").alias("hours"))
    some = lambda n: F.coalesce(F.col(n).cast(kind), F.array().cast(kind))
    both = operators.join(nested, "id", "left").withColumn("prices", some("prices")).withColumn("hours", some("hours"))
    of = lambda n: F.array_distinct(F.transform(n, lambda f: f["level"]))
    both = both.withColumns({"_prices": of("prices"), "_hours": of("hours")})
    has = (F.size("prices") > 0) | (F.size("hours") > 0)
    note = F.when(~has, F.concat(F.col("name"), F.lit(" is registered; no data yet.")))
    return both.select("id", has.alias("has_data"), "prices", "hours", levels.completeness(F.col("points"), F.col("_prices"), F.col("_hours")).alias("completeness"), note.alias("message"))
