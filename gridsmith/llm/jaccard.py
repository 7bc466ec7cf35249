"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (words of letters and digits, ASCII letters in
lower case).  Texts of equal words are one class, stood for by their smallest id.

1. Each class gets HASHES MinHash values and BANDS band keys of ROWS values each.
   A pair of similarity 0.8 shares no band with probability (1 - .8**7)**48 = 1e-5.
2. Classes that share a band are joined in stars about the band's smallest id; the
   stars' components hold every candidate pair. Pairs are never listed.
3. Inside a component members are dealt into blocks by hash, and each pair of blocks
   is one unit of work of bounded members and bytes, whatever the component's.  There, MinHash
   values are compared in steps, and a pair goes when the posterior probability that
   its similarity reaches the threshold (uniform prior) falls below TOLERANCE.
   What survives is joined into smaller components.
4. The same is done in those with the shingle sets at hand, and the pairs left are
   verified exactly.  Each unit gives the number of links of each member and a
   spanning forest of its links, so hot groups give rows in proportion to members.

Classes of equal words are linked to each other without being expanded: n_links
counts other classes, n_copies the rows of the own class.

Nulls: null texts are empty. A text without words is in no group: its class is
itself and it has no links. Texts of one to four words have one shingle. Rows of one
id are one document, whatever their texts: it is in the group of all of them. Null
ids have no class (null) and are never linked. Extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import components, doc_ngrams, grouped, id_text, materialize, mix, partitions, slices, words

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 7, 48
HASHES = ROWS * BANDS
TOLERANCE = 1e-6
#: MinHash values compared between two looks at the posterior.
STEP = 24
#: Members of a block, and bytes of their shingles, about.
BLOCK = 384
BLOCK_BYTES = 32 << 20

_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_C = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def min_hashes(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HASHES values for each non-empty set of shingles grams[at[i]:at[i + 1]]."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((HASHES, len(at) - 1), np.uint32)
    buffer = np.empty_like(x)
    for k in range(HASHES):
        np.multiply(x, _A[k], out=buffer)
        np.add(buffer, _B[k], out=buffer)
        out[k] = np.minimum.reduceat(buffer, at[:-1])
    return out.T


def _prints(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's sequence of words."""
    count = np.diff(first)
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(first[:-1], count).astype(np.uint64)
    some = count > 0
    out = []
    for salt in (1, 2):
        v = mix(h ^ mix(place + np.uint64(salt << 40)))
        total = np.zeros(len(count), np.uint64)
        if some.any():
            total[some] = np.add.reduceat(v, first[:-1][some])
        out.append(mix(total + count.astype(np.uint64)))
    return out[0], out[1]


def sketches(texts: DataFrame) -> DataFrame:
    """doc_id, two prints, the low bytes of the MinHash values, the band keys and the
    number of shingles of every text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, 512 << 10)):
            h, first = words(batch.column(1))
            some = np.flatnonzero(np.diff(first) > 0)
            if not len(some):
                continue
            grams, at = doc_ngrams(h, first, SHINGLE)
            values = min_hashes(grams, np.append(at[:-1][some], at[-1]))
            keys = (values.reshape(len(some), BANDS, ROWS) * _C).sum(-1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
            p, q = _prints(h, first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(some)),
                    pa.array(p[some].view(np.int64)),
                    pa.array(q[some].view(np.int64)),
                    pa.array([row.tobytes() for row in values.astype(np.uint8)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(mix(keys).view(np.int64).ravel())),
                    pa.array(np.diff(at)[some]),
                ],
                names=["doc_id", "p", "q", "low", "bands", "size"],
            )

    return texts.mapInArrow(run, "doc_id long, p long, q long, low binary, bands array<long>, size long")


@lru_cache(maxsize=8)
def least_matches(similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each count of compared values, a multiple of STEP, the fewest matches with
    which the posterior probability of the similarity is at least the tolerance."""
    s = np.linspace(0, 1, 4001)[1:-1]
    agree = s + (1 - s) / 256  # low bytes also agree by chance
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            like = float(comb(n, m)) * agree**m * (1 - agree) ** (n - m)
            if like[s >= similarity].sum() >= tolerance * like.sum():
                out.append(m)
                break
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray, same: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) that pass every look; i < j if both are the same."""
    agree = np.zeros((len(left), len(right)), np.uint16)
    least = least_matches(similarity)
    live = np.triu(np.ones(agree.shape, bool), 1) if same else np.ones(agree.shape, bool)
    for step in range(2):
        for k in range(step * STEP, (step + 1) * STEP):
            agree += left[:, k][:, None] == right[:, k][None]
        live &= agree >= least[step]
    i, j = np.nonzero(live)
    m = agree[i, j].astype(np.int64)
    for step in range(2, len(least)):
        if not len(i):
            break
        out = np.empty(len(i), bool)
        for a in range(0, len(i), 1 << 16):
            b = slice(a, a + (1 << 16))
            m[b] += (left[i[b], step * STEP : (step + 1) * STEP] == right[j[b], step * STEP : (step + 1) * STEP]).sum(1)
            out[b] = m[b] >= least[step]
        i, j, m = i[out], j[out], m[out]
    return i, j


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sets have the similarity, exactly."""
    sizes = np.array([len(x) for x in sets])
    if len(i) < 4 * len(sets):
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    else:
        used = np.unique(np.concatenate([i, j]))
        row = np.zeros(len(sets), np.int64)
        row[used] = np.arange(len(used))
        flat = np.concatenate([sets[k] for k in used])
        owner = np.repeat(np.arange(len(used)), sizes[used])
        _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1  # a shingle of one set counts for no pair
        on = times[col] > 1
        owner, col = owner[on], shared[col[on]]
        order = np.argsort(col, kind="stable")
        owner, col = owner[order], col[order]
        product = np.zeros((len(used), len(used)), np.float32)
        for a in range(0, int(col[-1]) + 1 if len(col) else 0, 2048):
            lo, hi = np.searchsorted(col, [a, a + 2048])
            held = np.zeros((len(used), 2048), np.float32)
            held[owner[lo:hi], col[lo:hi] - a] = 1
            product += held @ held.T
        both = product[row[i], row[j]].astype(np.int64)
    return both >= similarity * (sizes[i] + sizes[j] - both) - 1e-9


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges that join what all the edges join."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _units(members: DataFrame, sized: DataFrame) -> DataFrame:
    """Each member once for each pair of blocks that its block is in: columns comp, x, y, side.
    sized has comp, m (members) and bytes of each component, and is a table, so that the
    join is split where one component is large."""
    n = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("long")
    return (
        members.join(sized, "comp")
        .withColumn("own", F.pmod(F.xxhash64("doc_id"), n))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
        .select("comp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), *[c for c in members.columns if c != "comp"])
    )


def _links(units: DataFrame, similarity: float, exact: bool) -> DataFrame:
    """From each pair of blocks: kind 0 rows (member, links), kind 1 rows (edge of the forest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["comp", "x", "y"]):
            ids, side = t["doc_id"].to_numpy(), t["side"].to_numpy()
            low = np.frombuffer(b"".join(t["low"].to_pylist()), np.uint8).reshape(len(ids), HASHES)
            within = t["x"][0].as_py() == t["y"][0].as_py()
            l, r = (np.arange(len(ids)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            if len(l) == 0 or len(r) == 0:
                continue
            i, j = survivors(low[l], low[r], within, similarity)
            i, j = l[i], r[j]
            if exact and len(i):
                sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
                ok = verified(sets, i, j, similarity)
                i, j = i[ok], j[ok]
            if not len(i):
                continue
            edges = _forest(i, j, len(ids))
            count = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            some = np.flatnonzero(count) if exact else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(some) + [1] * len(edges), pa.int32()), pa.array(ids[some].tolist() + [int(ids[a]) for a, _ in edges], pa.int64()), pa.array(count[some].tolist() + [int(ids[b]) for _, b in edges], pa.int64())],
                names=["kind", "a", "b"],
            )

    n = partitions(units.sparkSession)
    return units.repartition(n, "comp", "x", "y").sortWithinPartitions("comp", "x", "y").mapInArrow(run, "kind int, a long, b long")


def _with_shingles(texts: DataFrame, members: DataFrame) -> DataFrame:
    """members with the sorted shingles of one text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            grams, at = doc_ngrams(*words(batch.column(1)), SHINGLE)
            p, q = _prints(*words(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.view(np.int64)), pa.array(q.view(np.int64)), pa.array([np.unique(grams[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "p", "q", "shingles"])

    wanted = texts.join(members.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    found = wanted.mapInArrow(run, "doc_id long, p long, q long, shingles binary").dropDuplicates(["doc_id", "p", "q"])
    return found.join(members, ["doc_id", "p", "q"])


def classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rep_id (of the texts of equal words), class_id (smallest id of the
    group), n_links and n_copies, one row for each id."""
    texts = id_text(docs, id_col, text_col)
    known = texts.filter("doc_id is not null")
    made = materialize(sketches(known), "join-sketches")
    # only copies are joined with their representative, which is a table of its own, so
    # that a large group of copies is a skewed join that can be split
    reps = materialize(made.groupBy("p", "q").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("n_copies")).filter("n_copies > 1"), "join-reps")
    whose = materialize(made.select("doc_id", "p", "q").join(reps, ["p", "q"], "left").select("doc_id", "p", "q", F.coalesce("rep_id", "doc_id").alias("rep_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies")), "join-copies")
    marked = made.join(reps.drop("n_copies"), ["p", "q"], "left")
    single = marked.filter("rep_id is null").drop("rep_id")
    one = materialize(single.unionByName(marked.filter("doc_id = rep_id").drop("rep_id").dropDuplicates(["doc_id", "p", "q"])), "join-classes")

    banded = one.select("doc_id", F.explode("bands").alias("band"))
    low = banded.groupBy("band").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).filter("n > 1").select("band", "b")
    stars = banded.join(low, "band").select(F.col("doc_id").alias("a"), "b")
    first = materialize(components(stars, "join-stars").withColumnsRenamed({"id": "doc_id"}), "join-first")
    sized = materialize(first.groupBy("comp").agg(F.count("*").alias("m"), F.lit(0).cast("long").alias("bytes")).filter("m > 1"), "join-sizes")
    units = _units(one.select("doc_id", "low").join(first, "doc_id"), sized)
    near = _links(units, similarity, False).filter("kind = 1").select("a", "b")
    second = components(near, "join-near").withColumnsRenamed({"id": "doc_id"})
    members = materialize(one.select("doc_id", "p", "q", "low", "size").join(second, "doc_id"), "join-members")
    sized = materialize(members.groupBy("comp").agg(F.count("*").alias("m"), (8 * F.sum("size")).alias("bytes")).filter("m > 1"), "join-sizes")
    links = materialize(_links(_units(_with_shingles(known, members.drop("size")), sized), similarity, True), "join-links")
    # texts of one id are one document
    same = whose.select(F.col("doc_id").alias("a"), F.col("rep_id").alias("b")).groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("c")).filter("b != c").select(F.col("b").alias("a"), F.col("c").alias("b"))
    groups = components(links.filter("kind = 1").select("a", "b").union(same), "join-groups").withColumnsRenamed({"id": "rep_id", "comp": "class_id"})
    count = links.filter("kind = 0").groupBy(F.col("a").alias("rep_id")).agg(F.sum("b").alias("n_links"))
    rep = whose.groupBy("doc_id").agg(F.min("rep_id").alias("rep_id"), F.max("n_copies").alias("n_copies"))
    found = rep.join(groups, "rep_id", "left").join(count, "rep_id", "left")
    return (
        texts.select("doc_id").distinct().join(found, "doc_id", "left")
        .select("doc_id", F.coalesce("rep_id", "doc_id").alias("rep_id"), F.coalesce("class_id", "rep_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, that of the smallest id, with all its columns; of
    repeated rows of one id, one. Rows without an id stay."""
    name = f"_gone_{uuid.uuid4().hex}"  # no column of docs has it
    gone = classes(docs, similarity, id_col, text_col).filter("doc_id != class_id").select(F.col("doc_id").alias(name))
    kept = docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
    twice = kept.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").limit(1).count()
    return kept.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.filter(F.col(id_col).isNull())) if twice else kept
