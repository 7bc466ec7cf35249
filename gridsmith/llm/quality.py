"""Quality rules: learned decision lists over text statistics.

Statistics of a text are counted in one vectorised pass over Arrow buffers.  From
labelled texts, sequential covering learns an ordered list of conjunctions of
thresholds: a rule is grown on two thirds of the rows that earlier rules leave,
condition by condition for the largest information gain, pruned on the last third
by dropping final conditions while that doesn't lower its precision, and kept if it
is precise enough there.  The list is emitted as one ordered conditional
expression of Spark, CASE WHEN rule THEN rejected ... ELSE kept.

The list is fitted on SAMPLE labelled rows at most, those of lowest hash of their
id; everything else covers all rows.

Nulls: a null text has no words. Texts without words fail the base rule. Labels
that are null are not learned from; without labels of both classes no rules are
learned and only the base rule holds. Repeated rows are each judged, alike. Extra
columns are kept by keep() and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridsmith.llm.common import NON_SPACE, id_text, ngrams, slices, words

#: Labelled rows that the list is fitted on, at most.
SAMPLE = 12_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_digits", "n_marks", "n_lines", "n_distinct"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
SYMBOLS = b"#*$%&|<>"


def _per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags)])
    return upto[offs[1:]] - upto[offs[:-1]]


def _member(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


IS_SYMBOL = _member(SYMBOLS)
IS_UPPER = _member(bytes(range(65, 91)))
IS_LETTER = _member(bytes([*range(65, 91), *range(97, 123)]))
IS_DIGIT = _member(bytes(range(48, 58)))
IS_MARK = _member(b"!?")


def repeated_words(h: np.ndarray, first: np.ndarray, n: int = 5) -> np.ndarray:
    """Words in runs of n words that a text holds twice or more, for each text."""
    out = np.zeros(len(first) - 1, np.int64)
    runs = ngrams(h, n)
    if not len(runs):
        return out
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[: len(runs)] == doc[n - 1 :])
    key = runs[at] + doc[at].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(key), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    same[:-1] |= same[1:]
    hit = at[order[same]]
    if not len(hit):
        return out
    cover = np.bincount(hit, minlength=len(h) + 1) - np.bincount(hit + n, minlength=len(h) + 1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return covered[first[1:]] - covered[first[:-1]]


def _lines(data: np.ndarray, offs: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier one, and lines with a word, of each text."""
    raw = data.tobytes()
    dup, count = np.zeros(len(offs) - 1, np.int64), np.zeros(len(offs) - 1, np.int64)
    for i in range(len(offs) - 1):
        lines = raw[offs[i] : offs[i + 1]].split(b"\n")
        if len(lines) > 1:
            lines = [x for x in lines if x and not x.isspace()]
            count[i] = len(lines)
            dup[i] = len(lines) - len(set(lines))
        else:
            count[i] = first[i + 1] > first[i]
    return dup, count


def count_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """All of COUNTS for each text."""
    h, first, at, _, data, offs = words(texts, NON_SPACE, places=True)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = h + doc.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    distinct = np.zeros(len(offs) - 1, np.int64)
    if len(key):
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.ones(len(key), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        distinct = np.bincount(doc[order[new]], minlength=len(distinct))
    dup, lines = _lines(data, offs, at, first)
    solid = (NON_SPACE[data] != 0) & ((data & 0xC0) != 0x80)  # the first byte of each character in words
    return {
        "n_words": np.diff(first),
        "word_chars": _per_text(solid, offs),
        "n_symbols": _per_text(IS_SYMBOL[data], offs),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(h, first),
        "n_upper": _per_text(IS_UPPER[data], offs),
        "n_letters": _per_text(IS_LETTER[data], offs),
        "n_digits": _per_text(IS_DIGIT[data], offs),
        "n_marks": _per_text(IS_MARK[data], offs),
        "n_lines": lines,
        "n_distinct": distinct,
    }


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            found = count_texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", *COUNTS])

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


#: Features: name, numerator, denominator (a count of COUNTS or None).
FEATURES = [
    ("repeat_share", "n_repeat_words", "n_words"),
    ("symbol_rate", "n_symbols", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("upper_share", "n_upper", "n_letters"),
    ("digit_share", "n_digits", "word_chars"),
    ("mark_rate", "n_marks", "n_words"),
    ("distinct_share", "n_distinct", "n_words"),
    ("word_length", "word_chars", "n_words"),
    ("line_length", "n_words", "n_lines"),
    ("words", "n_words", None),
]


def feature_columns() -> dict[str, Column]:
    return {name: F.col(a).cast("double") if b is None else F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)) for name, a, b in FEATURES}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    at: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        col = x[:, [f[0] for f in FEATURES].index(self.feature)]
        return col >= self.at if self.above else col < self.at

    def column(self) -> Column:
        col = feature_columns()[self.feature]
        return col >= F.lit(self.at) if self.above else col < F.lit(self.at)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.at:g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, cuts: int, most: int) -> Rule:
    """Add the condition of the largest gain (FOIL's) until only bad rows are covered."""
    rule: list[Condition] = []
    on = np.ones(len(x), bool)
    while len(rule) < most and (on & ~bad).any():
        p, n = (on & bad).sum(), on.sum()
        base, best, gain = np.log2(max(p, 1e-9) / n), None, 1e-6
        for k, (name, *_) in enumerate(FEATURES):
            values = np.unique(x[on, k])
            at = values[1:] if len(values) <= cuts else np.unique(np.quantile(x[on & bad, k], np.linspace(0, 1, cuts)))
            for t in at:
                for above in (True, False):
                    m = on & (x[:, k] >= t if above else x[:, k] < t)
                    pm, nm = (m & bad).sum(), m.sum()
                    if pm and nm < n and (g := pm * (np.log2(pm / nm) - base)) > gain:
                        best, gain = Condition(name, above, float(t)), g
        if best is None:
            break
        rule.append(best)
        on &= best.holds(x)
    return tuple(rule)


def _precision(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[float, int]:
    m = _covers(rule, x)
    return ((m & bad).sum() + 0.5) / (m.sum() + 1), int(m.sum())


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, least: int = 8, most_rules: int = 12, cuts: int = 24) -> list[Rule]:
    """An ordered list of rules that reject, from features and labels (true: reject).

    Rows are split by their order: every third one prunes. A pruned rule must cover
    `least` of the pruning rows or so, at the wanted precision there."""
    prune = np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), bool), []
    while len(rules) < most_rules and (left & bad & ~prune).sum() >= least:
        g, v = left & ~prune, left & prune
        rule = _grow(x[g], bad[g], cuts, 4)
        while len(rule) > 1 and _precision(rule[:-1], x[v], bad[v])[0] >= _precision(rule, x[v], bad[v])[0]:
            rule = rule[:-1]
        p, n = _precision(rule, x[v], bad[v])
        if not rule or p < precision or n < least // 2:
            break
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """Kept or not: the ordered conditional expression of a list."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Learn a list from labels (1: good) on `sample` labelled rows at most."""
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
    features = counts(known).select("doc_id", *(c.alias(n) for n, c in feature_columns().items()), base_failed().alias("failed"))
    rows = features.join(F.broadcast(chosen), "doc_id").filter("not failed").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample).toPandas()
    if not len(rows) or rows.y.nunique() < 2:
        return []
    return learn(rows[[f[0] for f in FEATURES]].to_numpy(float), rows.y.to_numpy() == 0)


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS, base_failed and kept of every row."""
    return counts(docs, id_col, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows that the list keeps, with all their columns: counted in one pass, then judged
    by the list's conditional expression; nothing is moved."""
    row = F.struct(*[F.col(f"`{n}`") for n in docs.columns])  # set apart, so that no name clashes
    packed = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            found = count_texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=["row", *COUNTS])

    schema = StructType([packed.schema["row"], *(StructField(c, LongType()) for c in COUNTS)])
    return packed.mapInArrow(run, schema).filter(~base_failed() & verdict(rules)).select(*(F.col("row")[n].alias(n) for n in docs.columns))
