"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max index.

A text's terms are its words and their beginnings of PREFIX letters.  The features
are all terms associated with the label among the examples (chi-square over LEAST,
in EXAMPLES labelled rows at most); their document frequencies are counted over all
texts.  An example is its unit TF-IDF vector.

For each text the NEIGHBOURS examples of highest cosine are found exactly.  A term's
postings are in blocks of BLOCK examples with each block's largest weight; blocks
are taken in the order of their upper bounds, sums of those weights times the
text's, and the search ends at the first bound that the worst neighbour reaches.
Neighbours vote with weight cosine / (1 + DISTANCE - cosine), against a prior vote;
the votes are calibrated by a logistic curve on a third of the examples that was
kept out of the index. The neighbours' ids are the evidence.

Nulls: a null text is empty; texts without features have the prior's score, as have
all when labels of both classes are missing. Ties between neighbours go to the
smaller id. Rows with null labels are not learned from. Repeated rows give equal
rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import id_text, materialize, slices

#: Labelled rows that examples are chosen from and that features are ranked on.
EXAMPLES = 9_000
LEAST, NEIGHBOURS, BLOCK, PREFIX, PRIOR, DISTANCE = 15, 15, 32, 5, 0.5, 0.05
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    return found + [w[:PREFIX] + "*" for w in found if len(w) > PREFIX]


def choose_terms(texts: list[str], toxic: np.ndarray) -> list[str]:
    """The terms held by toxic texts most beyond chance, by chi-square of presence."""
    seen, bad = Counter(), Counter()
    for t, y in zip(texts, toxic.tolist(), strict=True):
        s = set(terms_of(t))
        seen.update(s)
        if y:
            bad.update(s)
    n, p = len(texts), toxic.mean()
    scored = []
    for w, b in bad.items():
        k = seen[w]
        if b >= 4 and b / k > 2 * p:
            expect = k * p
            scored.append((-((b - expect) ** 2) / (expect * (1 - p) * max(1 - k / n, 1e-9)), w))
    return [w for s, w in sorted(scored) if s < -LEAST]


@dataclass
class Model:
    terms: list[str]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    postings: list[tuple[np.ndarray, np.ndarray]]  # by term: examples, weights
    bounds: np.ndarray  # by block and term: largest weight
    prior: float
    curve: tuple[float, float]


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.sqrt((v * v).sum(-1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def index(terms: list[str], idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> Model:
    """Examples in the order of their strongest terms, so that blocks are alike."""
    v = _unit(counts, idf)
    order = np.lexsort((ids, -v.max(1), v.argmax(1))) if len(v) else np.zeros(0, np.int64)
    v, ids, labels = v[order], ids[order], labels[order]
    blocks = -(-len(v) // BLOCK)
    bounds = np.array([v[b * BLOCK : (b + 1) * BLOCK].max(0) for b in range(blocks)]).reshape(blocks, len(terms))
    postings = [(np.flatnonzero(v[:, t]), v[np.flatnonzero(v[:, t]), t]) for t in range(len(terms))]
    return Model(terms, idf, ids, labels, postings, bounds, float(labels.mean()) if len(labels) else 0.0, (1.0, 0.0))


def nearest(m: Model, which: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the k examples nearest to a unit vector of those terms;
    examples without any of its terms are not neighbours."""
    bound = m.bounds[:, which] @ weights
    order = np.argsort(-bound, kind="stable")
    best_at, best = np.zeros(0, np.int64), np.zeros(0)
    done, size, slot = 0, 8, np.full(len(order), -1)
    while done < len(order) and bound[order[done]] > 0:
        if len(best) >= k and bound[order[done]] < best[k - 1] - 1e-12:
            break
        take = order[done : done + size]
        take = take[bound[take] > 0]
        done, size = done + len(take), 2 * size
        slot[take] = np.arange(len(take))
        score = np.zeros(len(take) * BLOCK)
        for t, w in zip(which.tolist(), weights.tolist(), strict=True):
            at, x = m.postings[t]
            n = slot[at // BLOCK]
            on = np.flatnonzero(n >= 0)
            score[n[on] * BLOCK + at[on] % BLOCK] += w * x[on]
        slot[take] = -1
        hit = np.flatnonzero(score > 0)
        best_at = np.concatenate([best_at, take[hit // BLOCK] * BLOCK + hit % BLOCK])
        best = np.round(np.concatenate([best, score[hit]]), 12)
        keep = np.lexsort((m.ids[best_at], -best))[:k]
        best_at, best = best_at[keep], best[keep]
    return best_at, best


def vote(m: Model, counts: dict[int, int]) -> tuple[float, list[int]]:
    """The share of votes for toxic and the neighbours' ids."""
    if not counts or not len(m.ids):
        return m.prior, []
    which = np.array(sorted(counts))
    weights = _unit(np.array([counts[int(t)] for t in which], float), m.idf[which])
    at, cos = nearest(m, which, weights)
    w = cos / (1 + DISTANCE - cos)
    return float(((w * m.labels[at]).sum() + PRIOR * m.prior) / (w.sum() + PRIOR)), m.ids[at].tolist()


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a light penalty."""
    a, b = 4.0, -2.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([((p - y) * x).sum() + 0.05 * a, (p - y).sum() + 0.05 * b])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 0.05]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def sparse(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """doc_id, and the numbers and counts of the terms that each text holds."""
    number = {w: i for i, w in enumerate(terms)}
    whole = {w: i for w, i in number.items() if not w.endswith("*")}
    starts = {w[:-1]: i for w, i in number.items() if w.endswith("*")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            which, many = [], []
            for text in batch.column(1).to_pylist():
                c: Counter = Counter()
                for w in _WORD.findall(text.lower()):
                    if w in whole:
                        c[whole[w]] += 1
                    if len(w) > PREFIX and w[:PREFIX] in starts:
                        c[starts[w[:PREFIX]]] += 1
                which.append(sorted(c))
                many.append([c[t] for t in sorted(c)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(which, pa.list_(pa.int32())), pa.array(many, pa.list_(pa.int32()))], names=["doc_id", "terms", "counts"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, terms array<int>, counts array<int>")


def fit_score(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, score and evidence (ids of the neighbours) of every row, learned from
    the labels given. Texts are read once for the examples and once for all."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    rows = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # two numbers for each example
    one = rows.mapInArrow(_shorten, "doc_id long, text string, many array<int>, y int").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * examples).toPandas()
    toxic = one.y.to_numpy() == 1
    terms = choose_terms(one.text.tolist(), toxic) if len(one) and toxic.any() and not toxic.all() else []
    held = materialize(sparse(docs, terms, id_col, text_col), "toxic-terms")
    total = held.count()
    df = {r.t: r["count"] for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # a row a term of EXAMPLES examples
    idf = np.log1p(total / np.maximum([df.get(i, 0) for i in range(len(terms))], 1)) if terms else np.zeros(0)
    number = {w: i for i, w in enumerate(terms)}
    x = np.zeros((len(one), len(terms)))
    for i, (t, many) in enumerate(zip(one.text, one.many, strict=True)):
        for w, n in zip(t.split(), many, strict=True):
            for term in terms_of(w):
                if term in number:
                    x[i, number[term]] += n
    third = np.arange(len(one)) % 3 == 2
    any_ = x.sum(1) > 0
    ids, y = one.doc_id.to_numpy(), toxic.astype(float)
    model = index(terms, idf, ids[~third & any_], y[~third & any_], x[~third & any_])
    rest = y[~any_]
    model.prior = float(rest.mean()) if len(rest) else 0.0
    model.curve = (1.0, 0.0)
    tried = [i for i in np.flatnonzero(third & any_)]
    if len(tried) >= 20:
        votes = np.array([vote(model, {int(t): int(x[i, t]) for t in np.flatnonzero(x[i])})[0] for i in tried])
        model.curve = _logistic(votes, y[tried])
    calibrated = len(tried) >= 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            memo: dict[tuple, tuple[float, list[int]]] = {}
            out = []
            for which, many in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                key = (tuple(which), tuple(many))
                if key not in memo:
                    v, who = vote(model, dict(zip(which, many, strict=True)))
                    if calibrated and which:
                        v = 1 / (1 + np.exp(-(model.curve[0] * v + model.curve[1])))
                    memo[key] = (float(min(max(v, 0.0), 1.0)), who)
                out.append(memo[key])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([w for _, w in out], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    return held.mapInArrow(run, "doc_id long, score double, evidence array<long>")


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each example's text as its distinct lower-case words, in order, and their counts."""
    for batch in batches:
        held = [Counter(_WORD.findall(t.lower())) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(c) for c in held], pa.string()), pa.array([list(c.values()) for c in held], pa.list_(pa.int32())), batch.column(2)], names=["doc_id", "text", "many", "y"])
