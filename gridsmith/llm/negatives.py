"""Hard-negative mining by k-means inverted lists.

Scores are inner products of whole numbers, floor(scale * component), so they and all
comparisons are exact. K-means, fitted on a bounded sample (SAMPLE rows), gives CELLS centroids
at most; every row is in the list of its nearest centroid, and each list keeps its radius, the
largest distance of a row from the centroid. By Cauchy-Schwarz no row of a list scores above
anchor . centroid + |anchor| radius, nor below anchor . centroid - |anchor| radius.

An anchor visits lists from the highest bound down. First those of the highest bounds, until they
hold enough rows (LOOK times those wanted); the kth best score so far is then the floor, and
of the others it visits all but those whose bound is strictly below it. So positives are exact.
The negatives of a positive lie in a window of scores, [low, positive's score]: lists whose
bounds don't meet the window are skipped, and the search is in the same two steps with the kth
best score inside the window. Nothing is approximate; a worse fit only visits more.

A list is kept in blocks of about BLOCK rows, so a very frequent vector is no hot key. One
visit is a row with the anchor's vector, sent to each block of the list; a task holds one block as a
matrix and streams the anchors past it, and gives k rows an anchor and block at most, which are
ranked by window group limits. Visits grow as anchors times lists that aren't ruled out.

Defined cases: rows with a null label, a null vector, a null or non-finite component or a null
id take no part. Shorter vectors are filled with zeros. Rows that repeat an id count as rows of
their own; a row of the anchor's own id is never its positive. Scores that could exceed 64 bits are
an error. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.llm.common import materialize

SCALE = 256
#: Most centroids, rows they are fitted on, rows of a block, and rows of a first look by rows wanted.
CELLS, SAMPLE, BLOCK, LOOK = 1024, 32_768, 32_768, 40
ROUNDS = 8
#: The search by floats is exact below this; beyond, whole numbers are multiplied.
EXACT = 1 << 52


def whole_vectors(rows: DataFrame, vector: str, scale: float, out: str = "q") -> DataFrame:
    """Rows whose vector has only finite components, with floor(scale * component) as longs."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    big = F.exists(x, lambda v: F.abs(v * scale) >= float(1 << 62))
    safe = F.when(big, F.raise_error(F.lit("a component exceeds 64 bits")).cast("array<bigint>")).otherwise(F.transform(x, lambda v: F.floor(v * scale).cast("bigint")))
    return rows.filter(fine).withColumn(out, safe)


def padded(rows: DataFrame, size: int, col: str = "q") -> DataFrame:
    """Vectors filled with zeros to one length."""
    return rows.withColumn(col, F.when(F.size(col) == size, F.col(col)).otherwise(F.concat(col, F.array_repeat(F.lit(0).cast("bigint"), F.lit(size) - F.size(col)))))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a column of lists of equal length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T, 0)


def kmeans(x: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centroids of x by Lloyd's rounds from distinct rows; empty ones go to the farthest rows."""
    rng = np.random.default_rng(seed)
    pool = np.unique(x, axis=0)
    centres = pool[rng.permutation(len(pool))[:cells]].copy()
    for _ in range(rounds):
        d = _squares(x, centres)
        near = d.argmin(1)
        count = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        begins = np.cumsum(count) - count
        full = count > 0
        centres[full] = np.add.reduceat(x[order], begins[full], axis=0) / count[full][:, None]
        if len(empty := np.flatnonzero(~full)):
            centres[empty] = x[np.argsort(-d[np.arange(len(x)), near], kind="stable")[: len(empty)]]
    return centres


def _rows(most: int, size: int) -> int:
    """Rows held at once: at most `most`, fewer of long vectors."""
    return max(256, min(most, (1 << 22) // size))


@dataclass
class Bounds:
    """What tasks know of the lists: centroids, radii and numbers of rows."""

    size: int
    exact: bool
    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray

    @property
    def blocks(self) -> np.ndarray:
        return np.maximum(1, -(-self.count // _rows(BLOCK, self.size)))

    def of(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most that a row of each list can score with each anchor, with room for rounding."""
        a = anchors.astype(float)
        mid = a @ self.centres.T
        norm = np.linalg.norm(a, axis=1)
        reach = norm[:, None] * self.radius[None]
        slack = 1e-9 * norm[:, None] * (self.radius + np.linalg.norm(self.centres, axis=1))[None] + 1e-6
        return mid - reach - slack, mid + reach + slack


@dataclass
class Lists:
    """The index: rows by list and block (cell, block, vec_id, label, q), and the lists' bounds."""

    rows: DataFrame
    bounds: Bounds


def index(rows: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, cells: int = CELLS) -> Lists:
    """The inverted lists of all rows that take part."""
    known = whole_vectors(rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).alias("_v")).filter("vec_id is not null and label is not null"), "_v", scale).select("vec_id", "label", "q")
    known = materialize(known, "vectors")
    total, size, most = known.agg(F.count("*"), F.max(F.size("q")), F.max(F.array_max(F.transform("q", F.abs)))).first()
    size, most = max(size or 0, 1), most or 0
    if most * most * size >= 1 << 63:
        raise ArithmeticError("scores may exceed 64 bits")
    known = padded(known, size)
    sample = known.orderBy(F.xxhash64("vec_id", "q")).limit(_rows(SAMPLE, size)).select("q").toArrow().column(0)
    x = matrix(sample, size).astype(float)
    centres = kmeans(x, max(1, min(cells, round(total**0.5)))) if total else np.zeros((1, size))

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column(2), size).astype(float)
            d = np.concatenate([_squares(q[a : a + 2048], centres).argmin(1) for a in range(0, len(q), 2048)]) if len(q) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, pa.int32()), pa.array(np.linalg.norm(q - centres[d], axis=1))], names=["vec_id", "label", "q", "cell", "away"])

    dealt = materialize(known.mapInArrow(nearest, "vec_id long, label long, q array<long>, cell int, away double"), "lists")
    radius, count = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in dealt.groupBy("cell").agg(F.max("away").alias("away"), F.count("*").alias("n")).collect():  # CELLS rows at most
        radius[r.cell], count[r.cell] = r.away * (1 + 1e-12), r.n
    bounds = Bounds(size, most * most * size < EXACT, centres, radius, count)
    many = F.element_at(F.array(*map(F.lit, bounds.blocks.tolist())), F.col("cell") + 1)
    # dealt by row, not by value: equal rows must not meet in one block
    return Lists(dealt.select("cell", F.pmod(F.monotonically_increasing_id(), many).cast("int").alias("block"), "vec_id", "label", "q"), bounds)


# ------------------------------------------------------------------ visits

_PLAN = "anchor long, vec_id long, label long, q array<long>, parts array<int>, floors array<long>, tops array<long>"
_FOUND = "anchor long, part int, score long, vec_id long"


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def _meets(low: np.ndarray, high: np.ndarray, floors: list[int], tops: list[int]) -> np.ndarray:
    """Lists that can hold a score of some window."""
    return np.any([(high >= f) & (low <= t) for f, t in zip(floors, tops, strict=True)], axis=0) if floors else np.zeros(len(high), bool)


def _planned(bounds: Bounds, plan: DataFrame, wanted: int, name: str) -> DataFrame:
    """The plan with the lists of a first look (`seen`): of those whose bounds meet a window the
    highest by bound that hold LOOK rows for each one wanted. Written, for the second look must know them."""

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(s, 256) for whole in batches for s in range(0, whole.num_rows, 256)):
            low, high = bounds.of(matrix(_column(batch, "q"), bounds.size))
            floors, tops, seen = _column(batch, "floors").to_pylist(), _column(batch, "tops").to_pylist(), []
            for i in range(batch.num_rows):
                may = np.flatnonzero(_meets(low[i], high[i], floors[i], tops[i]) & (bounds.count > 0))
                ranked = may[np.argsort(-high[i][may], kind="stable")]
                seen.append(ranked[: int(np.searchsorted(np.cumsum(bounds.count[ranked]), wanted * LOOK)) + 1].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seen, pa.list_(pa.int32()))], names=[*batch.schema.names, "seen"])

    columns = [c.split()[0] for c in _PLAN.split(", ")]
    return materialize(plan.select(*columns).mapInArrow(choose, _PLAN + ", seen array<int>"), f"{name}-plan")


def _visits(bounds: Bounds, plan: DataFrame, first: bool) -> DataFrame:
    """A row for each block of each list that an anchor visits: in the first look those of `seen`, then
    all others whose bounds meet a window, so none whose bound is strictly below its floor."""
    blocks = bounds.blocks

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(s, 256) for whole in batches for s in range(0, whole.num_rows, 256)):
            low, high = bounds.of(matrix(_column(batch, "q"), bounds.size))
            floors, tops, seen = (_column(batch, c).to_pylist() for c in ("floors", "tops", "seen"))
            rows, cells, places = [], [], []
            for i in range(batch.num_rows):
                go = np.array(seen[i], np.int64)
                if not first:
                    need = _meets(low[i], high[i], floors[i], tops[i]) & (bounds.count > 0)
                    need[go] = False
                    go = np.flatnonzero(need)
                cell = np.repeat(go, blocks[go])
                rows.append(np.full(len(cell), i))
                cells.append(cell)
                places.append(np.arange(len(cell)) - np.repeat(np.cumsum(blocks[go]) - blocks[go], blocks[go]))
            rows, cells, places = np.concatenate(rows), np.concatenate(cells), np.concatenate(places)
            for a in range(0, len(rows), 4096):
                cut = slice(a, a + 4096)
                yield pa.RecordBatch.from_arrays([pa.array(cells[cut].astype(np.int32)), pa.array(places[cut].astype(np.int32)), *(c.take(pa.array(rows[cut])) for c in batch.columns[:7])], names=["cell", "block", *batch.schema.names[:7]])

    return plan.mapInArrow(choose, "cell int, block int, " + _PLAN)


def _best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each row of scores, ties by smaller id."""
    n = scores.shape[1]
    if n > 4 * k:
        kth = np.partition(np.where(allowed, scores, np.iinfo(np.int64).min), n - k, axis=1)[:, n - k]
        allowed = allowed & (scores >= kth[:, None])
    i, j = np.nonzero(allowed)
    order = np.lexsort((ids[j], -scores[i, j], i))
    i, j = i[order], j[order]
    good = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[good], j[good]


def _search(lists: Lists, visits: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best of each anchor's parts in each block that it visits (schema _FOUND)."""
    asked = [F.lit(None).cast(t).alias(c) for c, t in (("anchor", "long"), ("parts", "array<int>"), ("floors", "array<long>"), ("tops", "array<long>"))]
    both = lists.rows.select("cell", "block", "vec_id", "label", "q", *asked).unionByName(visits).withColumn("asks", F.col("anchor").isNotNull().cast("int"))
    both = both.repartition("cell", "block").sortWithinPartitions("cell", "block", "asks")
    size, kind = lists.bounds.size, float if lists.bounds.exact else np.int64

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        data = ids = labels = None
        for begins, batch in _runs(batches):
            if begins:
                held, data = [], None
            n = int(np.searchsorted(_column(batch, "asks").to_numpy(), 1))
            if n:
                held.append(batch.slice(0, n))
            if n == batch.num_rows:
                continue
            if data is None:
                rows = pa.Table.from_batches(held or [batch.slice(0, 0)])
                data = matrix(rows.column("q"), size).astype(kind)
                ids, labels, held = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), []
            for a in range(n, batch.num_rows if len(data) else 0, 128):
                few = batch.slice(a, 128)
                scores = (matrix(_column(few, "q"), size).astype(kind) @ data.T).astype(np.int64)
                own, label, anchor = (_column(few, c).to_numpy() for c in ("vec_id", "label", "anchor"))
                other = labels[None] == label[:, None]
                other = other & (ids[None] != own[:, None]) if same else ~other
                asks = pa.RecordBatch.from_arrays([_column(few, c).flatten() for c in ("parts", "floors", "tops")], names=["part", "floor", "top"])
                of = np.repeat(np.arange(few.num_rows), np.diff(_column(few, "parts").offsets.to_numpy()))
                part, floor, top = (c.to_numpy() for c in asks.columns)
                for p in np.unique(part):
                    at = part == p
                    mine = scores[of[at]]
                    i, j = _best(mine, ids, other[of[at]] & (mine >= floor[at][:, None]) & (mine <= top[at][:, None]), k)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(anchor[of[at]][i]), pa.array(np.full(len(i), p, np.int32)), pa.array(mine[i, j]), pa.array(ids[j])], names=["anchor", "part", "score", "vec_id"])

    return both.mapInArrow(meet, _FOUND)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Runs of rows of one (cell, block), and whether the run begins it: no block is held whole here."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, block = (_column(batch, c).to_numpy() for c in ("cell", "block"))
        cut = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            key = int(cell[a]), int(block[a])
            yield key != last, batch.slice(a, b - a)
            last = key


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor", "part").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _two_looks(lists: Lists, plan: DataFrame, k: int, same: bool, name: str) -> DataFrame:
    """The k best rows inside each window of each anchor: anchor, part, score, vec_id, rank."""
    plan = _planned(lists.bounds, plan, k, name)
    near = materialize(_top(_search(lists, _visits(lists.bounds, plan, True), k, same), k), f"{name}-first")
    # where there are k, the kth score is the new floor of its part
    kth = near.filter(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("part", "score"))).alias("kth"))
    floors = F.zip_with("parts", "floors", lambda p, f: F.greatest(f, F.coalesce(F.try_element_at("kth", p), f)))
    raised = plan.join(kth, "anchor", "left").withColumn("floors", floors).select(plan.columns)
    rest = _search(lists, _visits(lists.bounds, raised, False), k, same)
    return _top(near.drop("rank").unionByName(rest), k)


LEAST, MOST = -(1 << 62), 1 << 62


def mine(rows: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, cells: int = CELLS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (a
    condition on the column vec_id) and each of its first positives, the first rows of another label
    with low * positive <= 100 * score <= high * positive."""
    lists = index(rows, label, id_col, vector_col, scale, cells)
    own = materialize(lists.rows.filter(anchors).select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "q"), "anchors")
    one = lambda v: F.array(F.lit(v).cast("long"))
    plan = own.withColumns({"parts": F.array(F.lit(0)), "floors": one(LEAST), "tops": one(MOST)})
    best = materialize(_two_looks(lists, plan, positives, True, "positives").select("anchor", F.col("rank").alias("part"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "positives")
    # scores are whole, so the window's ends round inwards
    s = F.col("positive_score").cast("decimal(38,0)")
    ends = best.withColumns({"floor": F.ceil(s * low / 100).cast("long"), "top": F.floor(s * high / 100).cast("long")}).filter("floor <= top")
    windows = ends.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("part", "floor", "top"))).alias("w"))
    asked = own.join(windows, "anchor").select("anchor", "vec_id", "label", "q", F.col("w.part").alias("parts"), F.col("w.floor").alias("floors"), F.col("w.top").alias("tops"))
    found = _two_looks(lists, asked, negatives, False, "negatives").withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    ids = own.select("anchor", F.col("vec_id").alias("anchor_id"))
    return found.join(best, ["anchor", "part"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
