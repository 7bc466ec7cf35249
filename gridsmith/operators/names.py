"""Companies found by parts of their names.

One name may be a part of the other, either way round. Such pairs are found by equality, not by
comparing all with all: the shorter name's rarest run of three characters must stand in the longer
one, so it is looked up among the runs of all names; shorter names are looked up whole. Names are compared once
however many rows bear them. A run that very many names hold is dealt to several tasks by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.session import written

#: Ordered replacements, fixed values: what is the same name.
SAME = [("gmbh & co. kg", "gmbh co kg"), ("gmbh & co kg", "gmbh co kg"), ("gmbh&co.kg", "gmbh co kg"), (" & ", " "), (".", ""), (",", ""), ("-", " "), ("  ", " ")]
RUN = 3
#: Names that hold a run for each task that it is dealt to.
HOT = 20_000
#: Words that say something are longer than this, and so many of them are looked at.
SHORT, WORDS = 3, 3


def normalized(c: Column) -> Column:
    """Lower case, spellings of legal forms, dots, commas and dashes made one."""
    s = F.trim(F.lower(c))
    for a, b in SAME:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(s)


def _runs(c: Column) -> Column:
    """All runs of one to RUN characters of a name, each once."""
    of = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in range(1, RUN + 1)]))


def _keys(c: Column) -> Column:
    """The runs of which one is enough to find a name that holds this one: those of RUN characters, or all of it."""
    return F.when(F.length(c) <= RUN, F.array(c)).otherwise(F.filter(_runs(c), lambda r: F.length(r) == RUN))


def parts(inner: DataFrame, outer: DataFrame, part: str, whole: str) -> DataFrame:
    """(part, whole): all pairs of distinct names where the part stands in the whole. inner has a column `part`,
    outer a column `whole`; empty names stand in none."""
    a = inner.select(part).filter(F.length(part) > 0).distinct()
    b = outer.select(whole).filter(F.length(whole) > 0).distinct()
    held = b.select(F.explode(_runs(F.col(whole))).alias("_r"), whole)
    # how many hold each run, for those that are looked for
    asked = a.select(part, F.explode(_keys(F.col(part))).alias("_r"))
    many = held.select("_r").join(asked.select("_r").distinct(), "_r", "left_semi").groupBy("_r").agg(F.count("*").alias("_n"))
    # a run that no name holds rules the part out
    rarest = asked.join(many, "_r", "left").groupBy(part).agg(F.min_by(F.struct("_r", "_n"), F.struct(F.coalesce("_n", F.lit(0)), "_r")).alias("_k")).filter("_k._n > 0").select(part, "_k._r", "_k._n")
    cuts = F.ceil(F.col("_n") / HOT).cast("int")
    left = rarest.select(part, "_r", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("_s"))
    salts = rarest.select("_r", cuts.alias("_c")).distinct()
    right = held.join(salts, "_r").select("_r", whole, F.pmod(F.xxhash64(whole), F.col("_c")).cast("int").alias("_s"))
    return left.join(right, ["_r", "_s"]).filter(F.contains(F.col(whole), F.col(part))).select(part, whole)


def first_named(asked: DataFrame, known: DataFrame, ask: str, name: str, order: str, known_name: str) -> DataFrame:
    """(ask, order, how) of each row asked whose company is found: the known one of the same name;
    else the first (by `order`, unique) of which one name is a part of the other; else the first in which
    each of the first three longer words of the name asked stands, or is a word's beginning, middle or end. Names
    are normalized; a known name that stands more than once is its first row."""
    asks = asked.select(ask, normalized(F.col(name)).alias("_a"))
    names = asks.filter("_a is not null").select("_a").distinct()
    firsts = written(known.select(normalized(F.col(known_name)).alias("_b"), F.col(order)).filter("_b is not null").groupBy("_b").agg(F.min(order).alias(order)))
    exact = names.join(firsts, F.col("_a") == F.col("_b")).select("_a", order, F.lit("exact").alias("how"))
    rest = written(names.join(exact.select("_a"), "_a", "left_anti"))
    inside = parts(rest, firsts, "_a", "_b").unionByName(parts(firsts, rest, "_b", "_a"))
    # an empty name is a part of every other
    empty = rest.filter("_a = ''").join(F.broadcast(firsts.agg(F.min(order).alias(order)))).select("_a", order)  # one row
    blank = rest.join(F.broadcast(firsts.filter("_b = ''").select(order))).select("_a", order)  # one row at most
    by_part = inside.join(firsts, "_b").select("_a", order).union(empty).union(blank).groupBy("_a").agg(F.min(order).alias(order)).filter(F.col(order).isNotNull())
    by_part = written(by_part)
    left = written(rest.join(by_part.select("_a"), "_a", "left_anti"))
    by_word = _by_words(left, firsts, order)
    found = exact.unionByName(by_part.withColumn("how", F.lit("part"))).unionByName(by_word.withColumn("how", F.lit("words")))
    return asks.join(found, "_a").select(ask, order, "how")


def _by_words(names: DataFrame, firsts: DataFrame, order: str) -> DataFrame:
    """(_a, order): candidates come from the word that fewest known names can match; the other words are looked for in those."""
    split = lambda c: F.filter(F.split(F.col(c), r"\s+"), lambda w: w != "")
    asked = names.select("_a", F.slice(F.filter(split("_a"), lambda w: F.length(w) > SHORT), 1, WORDS).alias("_w")).filter(F.size("_w") > 0)
    words = asked.select(F.explode("_w").alias("_x")).distinct()
    spread = firsts.select("_b", order, F.explode(F.array_distinct(split("_b"))).alias("_y"))
    theirs = spread.groupBy("_y").agg(F.count("*").alias("_n"))
    meet = written(parts(words, theirs, "_x", "_y").unionByName(parts(theirs, words, "_y", "_x")).distinct().join(theirs, "_y"))
    weight = meet.groupBy("_x").agg(F.sum("_n").alias("_n"))
    pick = asked.select("_a", "_w", F.explode("_w").alias("_x")).join(weight, "_x", "left").groupBy("_a").agg(F.first("_w").alias("_w"), F.min_by(F.struct("_x", "_n"), F.struct(F.coalesce("_n", F.lit(0)), "_x")).alias("_k")).filter("_k._n > 0").select("_a", "_w", "_k._x")
    near = pick.join(meet.select("_x", "_y"), "_x").join(spread, "_y")
    fits = F.forall("_w", lambda w: F.exists(split("_b"), lambda y: F.contains(y, w) | F.contains(w, y)))
    return near.filter(fits).groupBy("_a").agg(F.min(order).alias(order))


def first_in_zip(asked: DataFrame, known: DataFrame, ask: str, zip_: str, name: str, order: str, known_zip: str, known_name: str) -> DataFrame:
    """(ask, order) of the first known company with the zip code of which one name is a part of the
    other. Parts are found over all names, so a zip code that very many share is no hot key."""
    a = asked.select(ask, F.col(zip_).alias("_z"), normalized(F.col(name)).alias("_a")).filter("_z is not null and _a is not null")
    b = known.select(normalized(F.col(known_name)).alias("_b"), F.col(known_zip).alias("_z"), F.col(order)).filter("_z is not null and _b is not null").groupBy("_b", "_z").agg(F.min(order).alias(order))
    pairs = parts(a, b, "_a", "_b").unionByName(parts(b, a, "_b", "_a")).distinct()
    hits = a.select("_a", "_z").distinct().join(pairs, "_a").join(b, ["_b", "_z"]).select("_a", "_z", order)
    any_ = b.groupBy("_z").agg(F.min(order).alias(order), F.min(F.when(F.col("_b") == "", F.col(order))).alias("_e"))
    blank = a.select("_a", "_z").distinct().join(any_, "_z").select("_a", "_z", F.when(F.col("_a") == "", F.col(order)).otherwise(F.col("_e")).alias(order)).filter(F.col(order).isNotNull())
    first = hits.unionByName(blank).groupBy("_a", "_z").agg(F.min(order).alias(order))
    return a.join(first, ["_a", "_z"]).select(ask, order)
