"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Generators with high recall propose overlapping spans by pattern.  Those of the base
kinds that pass their check (octets, Luhn, number of digits) always stay.  The
others are scored by boosted regression trees over features of the span's format
and of its context, and stay if their score reaches their kind's threshold and they
overlap no span of the base.

The trees are trained on the driver from examples written by rule (EXAMPLES
synthetic ones, of both classes), whose features are computed by the same
expressions; thresholds are calibrated on a third of them that the trees have not
seen, at PRECISION.  Trees become nested conditional expressions.

Patterns begin only where a run of their characters begins, and repeat possessively:
one pass over the text, no backtracking, however long it is.

Nulls: a null text is empty and has no spans. Places are code points from 0, ends
exclusive. Repeated rows give equal rows. Extra columns are kept by redact() and
not read.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base kinds in their order, then the method's own.
KINDS = ["email", "ip", "card", "phone", "id", "iban", "secret"]
EXAMPLES, PRECISION = 720, 0.97
DIGIT, AT, PLUS = "[0-9]", "@", "+"

#: kind: pattern and the text's need (a pattern for rlike or a plain character).
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", AT),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", DIGIT),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", DIGIT),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", PLUS),
}
MORE = {
    "phone": (r"(?<![0-9+(])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])", DIGIT),
    "id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", DIGIT),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", DIGIT),
    "secret": (r"(?<![A-Za-z0-9_+/.@-])[A-Za-z0-9_+/-]{16,}+(?![A-Za-z0-9@]|\.[A-Za-z0-9_+/@-])", DIGIT),
}
BEFORE, PART = 24, 256


def _need(text: Column, what: str) -> Column:
    return text.rlike(what) if len(what) > 1 else text.contains(what)


def _matches(text: Column, pattern: str, need: str) -> Column:
    none = F.array().cast("array<string>")
    return F.when(_need(text, need), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def _placed(text: Column, matches: Column, pattern: str, kind: str) -> Column:
    """Array of (start, end, kind, m, b) of the matches, b being the BEFORE characters before:
    what lies between them, split off by the same pattern, gives their places."""
    empty = F.array().cast("array<struct<start:int,end:int,kind:int,m:string,b:string>>")
    k = F.lit(KINDS.index(kind))
    last = lambda *parts: F.right(F.concat(*parts), F.lit(BEFORE))

    def step(acc: Column, x: Column) -> Column:
        start, before = acc["at"] + x["gap"], last(acc["tail"], x["tail"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), k.alias("kind"), x["m"].alias("m"), before.alias("b"))
        return F.struct(end.alias("at"), last(before, x["m"]).alias("tail"), F.concat(acc["out"], F.array(span)).alias("out"))

    gaps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), last(gap).alias("tail"), m.alias("m")))
    # each part by itself, then the parts one after the other: an array grows by parts, not by
    # spans. What stands before a part is in the BEFORE matches before it and their gaps.
    parts = lambda g: F.transform(_starts(g), lambda i: F.struct(F.slice(g, i + 1, PART).alias("items"), F.array_join(F.transform(F.slice(g, F.greatest(i - BEFORE, F.lit(0)) + 1, F.least(i, F.lit(BEFORE))), lambda x: F.concat(x["tail"], x["m"])), "").alias("tail")))
    local = F.transform(_let(gaps, parts), lambda part: F.aggregate(part["items"], F.struct(F.lit(0).alias("at"), last(part["tail"]).alias("tail"), empty.alias("out")), step))
    shift = lambda spans_, by: F.transform(spans_, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["kind"].alias("kind"), s["m"].alias("m"), s["b"].alias("b")))
    join = lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], shift(x["out"], acc["at"])).alias("out"))
    return F.when(F.size(matches) > 0, F.aggregate(local, F.struct(F.lit(0).alias("at"), empty.alias("out")), join)["out"]).otherwise(empty)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f's own lambdas use it."""
    return F.transform(F.array(value), f)[0]


def _starts(items: Column) -> Column:
    """Where the parts of PART items of an array begin. Items must be a lambda's variable."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / PART).cast("int")), lambda k: k * PART)


def _parts(items: Column) -> Column:
    """The parts: what is quadratic in a part is linear in a text."""
    return F.transform(_starts(items), lambda i: F.slice(items, i + 1, PART))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = 2 * d
        return acc + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _octet(part: Column) -> Column:
    value = F.ltrim(part, F.lit("0"))
    return (F.length(value) < 3) | ((F.length(value) == 3) & (value <= "255"))


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["m"])


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), _octet)
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _found(docs: DataFrame, text: str) -> DataFrame:
    """docs with _base (checked base spans) and _more (candidates of the method)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn("_t", t)
    out = out.withColumns({f"_b_{k}": _matches(F.col("_t"), *v) for k, v in BASE.items()} | {f"_m_{k}": _matches(F.col("_t"), *v) for k, v in MORE.items()})
    checked = [F.filter(_placed(F.col("_t"), F.col(f"_b_{k}"), v[0], k), _check(k)) for k, v in BASE.items()]
    more = [_placed(F.col("_t"), F.col(f"_m_{k}"), v[0], k) for k, v in MORE.items()]
    out = out.withColumns({"_base": F.concat(*checked), "_more": F.concat(*more)})
    return out.drop(*[f"_b_{k}" for k in BASE], *[f"_m_{k}" for k in MORE])


# ------------------------------------------------------------------ features and trees


def _count(m: Column, what: str) -> Column:
    return F.length(m) - F.length(F.regexp_replace(m, what, ""))


def _features(m: Column, before: Column, kind: Column) -> dict[str, Column]:
    n = F.length(m).cast("double")
    low = F.lower(before)
    said = lambda pattern: low.rlike(pattern).cast("double")
    return {
        "kind": kind.cast("double"),
        "length": n,
        "digits": _count(m, "[0-9]") / n,
        "upper": _count(m, "[A-Z]") / n,
        "lower": _count(m, "[a-z]") / n,
        "joints": _count(m, r"[ ._/+()-]") / n,
        "hex": m.rlike("^[0-9a-fA-F]+$").cast("double"),
        "turns": F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A")) / n,
        "distinct": F.size(F.array_distinct(F.split(m, ""))).cast("double"),
        "quoted": before.rlike("[\"'`]$").cast("double"),
        "assigned": before.rlike("[=:]\\s*[\"'`]?$").cast("double"),
        "secret_word": said("token|secret|passw|api.?key|access|private|credential|auth"),
        "phone_word": said("phone|tel|call|mobile|fax|cell|contact"),
        "id_word": said(r"ssn|social|passport|tax.?id|national|iban|account|bank"),
        "other_word": said(r"version|build|release|page|isbn|issn|order|invoice|serial|model|commit|sha|md5|hash|part|ticket|date|score|result"),
    }


NAMES = ["kind", "length", "digits", "upper", "lower", "joints", "hex", "turns", "distinct", "quoted", "assigned", "secret_word", "phone_word", "id_word", "other_word"]


@dataclass(frozen=True)
class Model:
    trees: tuple  # nested (feature, threshold, low, high) or leaf value
    start: float
    thresholds: dict[int, float]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> object:
    """A regression tree by second-order gain."""
    leaf = float(-0.3 * g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(x) < 8:
        return leaf
    best, gain = None, 1e-3
    whole = g.sum() ** 2 / (h.sum() + 1)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for t in (values[1:] + values[:-1]) / 2 if len(values) < 24 else np.unique(np.quantile(values, np.linspace(0.04, 0.96, 24))):
            left = x[:, k] < t
            if 4 <= left.sum() <= len(x) - 4:
                got = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - whole
                if got > gain:
                    best, gain = (k, float(t)), got
    if best is None:
        return leaf
    left = x[:, best[0]] < best[1]
    return (*best, _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1))


def _value(tree: object, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    k, t, low, high = tree
    return np.where(x[:, k] < t, _value(low, x), _value(high, x))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3) -> tuple[tuple, float]:
    """Trees of logistic boosting, and the score that they start from."""
    start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    f, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        trees.append(_grow(x, p - y, p * (1 - p) + 1e-6, depth))
        f += _value(trees[-1], x)
    return tuple(trees), start


def _examples(seed: int = 7) -> list[tuple[str, str, int, int]]:
    """(span, text before it, kind, label), by rule: what people write and look-alikes."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    of = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    hexes, b62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: of("aeioustrnlmdth", r.randint(2, 7))
    prose = lambda: f"{word()} {word()} {word()} "
    out = []
    kind = KINDS.index
    for _ in range(EXAMPLES // 12):
        area = digits(3)
        out += [
            (of(r.choice([hexes, b62]), r.choice([20, 24, 32, 40, 64])) + digits(1), r.choice(['token = "', 'api_key: "', "secret=", 'password = "', "access token: "]), kind("secret"), 1),
            (r.choice(["sk_live_", "ghp_", "AKIA"]) + of(b62, r.choice([16, 24, 36])) + digits(1), prose() + r.choice(['key = "', "", "auth: "]), kind("secret"), 1),
            (f"({area}) {digits(3)}-{digits(4)}", prose() + r.choice(["", "call ", "phone: ", "tel "]), kind("phone"), 1),
            (f"{area}-{digits(3)}-{digits(4)}", r.choice(["call ", "mobile ", "phone ", prose()]), kind("phone"), 1),
            (f"{digits(3)}-{digits(2)}-{digits(4)}", r.choice(["ssn ", "social security ", prose()]), kind("id"), 1),
            (r.choice(["DE", "FR", "ES", "GB"]) + digits(2) + r.choice(["", " "]).join(["", digits(4), digits(4), digits(4), digits(4)]), r.choice(["iban ", "account ", prose()]), kind("iban"), 1),
            (f"{word()}_{word()}_{r.randint(1990, 2030)}_{word()}", prose(), kind("secret"), 0),
            (of(hexes, r.choice([32, 40])), r.choice(["commit ", "md5 ", "sha hash ", "build "]), kind("secret"), 0),
            (digits(r.choice([16, 17, 18, 20, 24])), r.choice([prose(), "order ", "serial ", "invoice "]), kind("secret"), 0),
            (f"{r.randint(1, 99):02d}.{digits(3)}.{digits(3)}", r.choice([prose(), "version ", "score "]), kind("phone"), 0),
            (f"{r.randint(1000, 2100)} {digits(3)} {digits(4)}", r.choice(["page ", "part ", "result ", "model "]), kind("phone"), 0),
            (f"{digits(3)}-{digits(2)}-{digits(4)}", r.choice(["part ", "serial ", "ticket ", "order "]), kind("id"), 0),
        ]
    return out


def train(spark: SparkSession) -> Model:
    """Boosted trees and calibrated thresholds from the written examples."""
    rows = _examples()
    listed = json.dumps([{"m": m, "b": b, "k": k, "y": y, "i": i} for i, (m, b, k, y) in enumerate(rows)])
    got = spark.range(1).select(F.explode(F.from_json(F.lit(listed), "array<struct<m:string,b:string,k:int,y:int,i:int>>")).alias("e")).select("e.*")
    made = got.select("i", "k", "y", *(v.alias(n) for n, v in _features(F.col("m"), F.col("b"), F.col("k")).items())).collect()
    made.sort(key=lambda r: r.i)
    x, y = np.array([[r[n] for n in NAMES] for r in made], float), np.array([r.y for r in made], float)
    held = np.array([r.i // 12 % 3 == 2 for r in made])
    trees, start = boost(x[~held], y[~held])
    score = 1 / (1 + np.exp(-(start + sum(_value(t, x[held]) for t in trees))))
    kinds, thresholds = x[held, 0].astype(int), {}
    for k in {KINDS.index(n) for n in MORE}:
        s, truth = score[kinds == k], y[held][kinds == k]
        good = [t for t in sorted({*s.tolist(), 0.5}) if t >= 0.5 and (s >= t).any() and truth[s >= t].mean() >= PRECISION]
        thresholds[k] = float(min(good)) if good else 0.99
    return Model(trees, start, thresholds)


def _tree_column(tree: object, features: dict[str, Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    k, t, low, high = tree
    return F.when(features[NAMES[k]] < F.lit(t), _tree_column(low, features)).otherwise(_tree_column(high, features))


def _score(model: Model, features: dict[str, Column]) -> Column:
    total = F.lit(model.start)
    for t in model.trees:
        total = total + _tree_column(t, features)
    return 1 / (1 + F.exp(-total))


def spans(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with _base and _spans: arrays of (start, end, kind) by start, then kind."""
    found = _found(docs, text_col)

    def scored(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.struct(*(v.alias(n) for n, v in _features(s["m"], s["b"], s["kind"]).items())).alias("f"))

    least = F.create_map(*[F.lit(x) for kv in model.thresholds.items() for x in kv])
    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    found = found.withColumn("_base", F.array_sort(F.transform("_base", bare)))
    bounds = lambda part: F.struct(F.array_min(F.transform(part, lambda b: b["start"])).alias("low"), F.array_max(F.transform(part, lambda b: b["end"])).alias("high"), part.alias("spans"))
    meet = lambda s, a, b: (a < s["end"]) & (s["start"] < b)
    clear = lambda near: lambda s: ~F.exists(near, lambda part: F.coalesce(meet(s, part["low"], part["high"]), F.lit(False)) & F.exists(part["spans"], lambda b: meet(s, b["start"], b["end"])))
    left = _let(F.transform(_let(F.col("_base"), _parts), bounds), lambda near: F.filter(F.col("_more"), clear(near)))
    found = found.withColumn("_more", F.when(F.size("_more") > 0, F.transform(left, scored)))
    accepted = F.filter(F.col("_more"), lambda s: _score(model, {n: s["f"][n] for n in NAMES}) >= least[s["kind"]])
    return found.withColumn("_spans", F.when(F.size("_more") > 0, F.array_sort(F.concat("_base", F.transform(accepted, bare)))).otherwise(F.col("_base")))


def _told(spans_: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_sha256 and spans of every row."""
    got = spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")), model, "_text")
    many = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return got.select("doc_id", *(many(k) for k in BASE), F.sha2(_told(F.col("_base")), 256).alias("base_sha256"), _told(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with every span in the text replaced by its kind in brackets; null texts
    stay null. Overlapping spans become one, named for the first."""
    row = F.struct(*[F.col(f"`{n}`") for n in docs.columns])  # set apart, so that no name clashes
    got = spans(docs.select(row.alias("row"), F.col(text_col).cast("string").alias("_text")), model, "_text")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.array(F.substring(acc["rest"], F.lit(1), s["start"] - acc["at"]), names[s["kind"]]))).otherwise(acc["out"]).alias("out"),
            F.when(s["end"] > acc["at"], F.substring(acc["rest"], s["end"] - acc["at"] + 1, F.length(acc["rest"]))).otherwise(acc["rest"]).alias("rest"),
        )

    none = F.array().cast("array<string>")

    def leap(acc: Column, part: Column) -> Column:
        """A part of the spans, within the text up to its last end."""
        top = F.greatest(acc["at"], F.array_max(F.transform(part, lambda s: s["end"])))
        head = F.substring(acc["rest"], F.lit(1), top - acc["at"])
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out"), head.alias("rest")), step)
        return F.struct(top.alias("at"), F.concat(acc["out"], F.array(F.array_join(inner["out"], ""))).alias("out"), F.substring(acc["rest"], top - acc["at"] + 1, F.length(acc["rest"])).alias("rest"))

    first = F.struct(F.lit(0).alias("at"), none.alias("out"), F.col("_t").alias("rest"))
    done = F.aggregate(_let(F.col("_spans"), _parts), first, leap, lambda acc: F.concat(F.array_join(acc["out"], ""), acc["rest"]))
    text = F.when(F.col("_text").isNotNull(), F.when(F.size("_spans") > 0, done).otherwise(F.col("_text")))
    return got.select(*[text.alias(n) if n == text_col else F.col("row")[n].alias(n) for n in docs.columns])
