"""What kind of document a text is, and how surely (C5, C6): words for and against each kind,
patterns of its data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridsmith.catalogs import DATA_PATTERNS, WORDS_AGAINST, WORDS_FOR, WORDS_NEEDED

KINDS = ["netzentgelte", "hlzf", "all"]


def _hits(low: Column, words: list[str]) -> Column:
    """How many of the words a lower-cased text holds."""
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _counts(text: Column, year: int | None) -> Column:
    """Struct of a text's hits: required words, words for and against and patterns of each kind
    that has lists of its own, the year's mention and the detected kind."""
    own = ["netzentgelte", "hlzf"]

    def count(low: Column) -> Column:
        has = lambda w: F.contains(low, F.lit(w))
        hits = [_hits(low, held[k]).alias(f"{name}_{k}") for name, held in (("need", WORDS_NEEDED), ("for", WORDS_FOR), ("against", WORDS_AGAINST)) for k in held if k in own or name == "against"]
        found = [sum((low.rlike(p).cast("int") for p in DATA_PATTERNS[k]), F.lit(0)).alias(f"data_{k}") for k in own]
        plain = [F.when(has("netzentgelt") & has("leistungspreis"), 5).otherwise(0).alias("plain_netzentgelte"), F.when(has("hochlastzeitfenster") | has("hlzf"), 5).otherwise(0).alias("plain_hlzf")]
        return F.struct(*hits, *found, *plain)

    said = F.when(F.contains(text, F.lit(str(year))), 2).otherwise(0) if year else F.lit(0)
    return F.struct(_let(F.lower(text), count).alias("n"), said.alias("year"))


def _detected(n: Column) -> Column:
    prices, hours = (n[f"for_{k}"] + n[f"plain_{k}"] for k in ("netzentgelte", "hlzf"))
    return F.when((prices > hours) & (prices > 3), "netzentgelte").when((hours > prices) & (hours > 3), "hlzf")


def _judged(x: Column, kind: str) -> Column:
    n = x["n"]
    of = lambda name: n[f"{name}_netzentgelte"] + n[f"{name}_hlzf"] if kind == "all" else n[f"{name}_{kind}"]
    found, against = of("data"), F.least(F.lit(0.5), n[f"against_{kind}"] * 2 * 0.1)
    raw = F.least(F.lit(1.0), (of("for") + x["year"]) / (len(WORDS_FOR[kind]) * 0.3)) * 0.5 + found / len(DATA_PATTERNS[kind]) * 0.5 - against
    most = F.when(of("need") == 0, 0.3).when(found == 0, 0.5).otherwise(1.0)
    confidence = F.round(F.greatest(F.lit(0.0), F.least(raw, most)), 9)
    told = _detected(n)
    return F.struct(F.lit(kind).alias("kind"), confidence.alias("confidence"), told.alias("detected"), (found > 0).alias("has_data"), ((of("need") > 0) & (confidence >= 0.4) & (told.isNull() | (told == kind))).alias("is_verified"))


def detected(text: Column) -> Column:
    """The kind with more words of its own, at least four; a kind's plain names count five."""
    return _let(_counts(text, None), lambda x: _detected(x["n"]))


def verified(text: Column, year: int | None = None, kinds: list[str] = KINDS) -> Column:
    """Array of kind, confidence (0 to 1), detected kind, has_data and is_verified.

    Confidence is half the share of the words for the kind (three in ten suffice), half the
    share of its patterns, less a fifth for each word against it, half at most. Without
    a required word it is 0.3 at most, without data 0.5."""
    return _let(_counts(text, year), lambda x: F.array(*(_judged(x, k) for k in kinds)))
