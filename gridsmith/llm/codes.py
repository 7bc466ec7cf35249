"""Vector codes by product quantisation, found by partial-distance search.

Components become whole numbers, floor(scale * component), and vectors are cut into PARTS
equal consecutive parts, each with a codebook of ENTRIES entries. A codebook starts as that part of
the rows of the smallest ids; a round assigns every part of every row to the nearest entry
(ties to the lower number) and moves each entry to the floor of the mean of its parts. All
arithmetic is exact, so the codes depend on the rows alone, not on how they are dealt.

Assignment is a partial-distance search: the dimensions of a part are processed in descending
variance of its codebook. The entry that is nearest after the first dimension is summed to the
end first, which gives each part a complete distance; then a dimension at a time is
added to all others, and a mask drops those whose sum strictly exceeds the best complete distance.

A round is one pass over the rows, written once as a table: a task sums what it read, a row for
each entry, and the sums of all tasks are added by Spark before PARTS * ENTRIES rows go to the
driver. So what moves between machines doesn't grow with a task's rows.

Defined cases: rows with a null vector, or a null or non-finite component, are dropped. Null labels are
equal to each other. A null id counts as larger than any; of rows that repeat an id the smaller vector comes
first. Shorter vectors are filled with zeros, and all up to a multiple of PARTS. Fewer rows than ENTRIES give
fewer entries. Components beyond 2^28 are an error, for squares must fit 64 bits. An empty table gives no
codebook and no codes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import materialize
from gridsmith.llm.negatives import matrix, padded, whole_vectors

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: The most of a component; rows handled at once; labels whose sums are sent to all executors.
MOST, ROWS, LABELS = 1 << 28, 4096, 100_000


def order(book: np.ndarray) -> np.ndarray:
    """Dimensions of a codebook (entries x dimensions) in descending variance."""
    return np.argsort(-book.astype(float).var(0), kind="stable")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest entry for each row of x, the lower of equals."""
    dims = order(book)
    rows = np.arange(len(x))
    gap = lambda of, entry, d: np.square(x[of, d] - book[entry, d])
    partial = np.square(x[:, dims[0], None] - book[None, :, dims[0]])
    guess = partial.argmin(1)
    best = partial[rows, guess]
    for d in dims[1:]:
        best = best + gap(rows, guess, d)
    alive = partial <= best[:, None]
    of, entry = np.nonzero(alive)
    held = partial[of, entry]
    for d in dims[1:]:
        held = held + gap(of, entry, d)
        stay = held <= best[of]
        of, entry, held = of[stay], entry[stay], held[stay]
    # what is left is complete; each row has its guess at least, and its entries ascend
    first = np.lexsort((entry, held, of))
    of, entry, held = of[first], entry[first], held[first]
    at = np.searchsorted(of, rows)
    return entry[at], held[at]


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", scale: float = SCALE, parts: int = PARTS) -> tuple[DataFrame, int]:
    """A table (vec_id, label, q) of the rows that take part, in vectors of one length; the length."""
    label = F.col(label_col) if label_col else F.lit(None).cast("long")
    known = whole_vectors(rows.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).alias("_v")), "_v", scale).select("vec_id", "label", "q")
    known = materialize(known, "vectors")
    size, most = known.agg(F.max(F.size("q")), F.max(F.array_max(F.transform("q", F.abs)))).first()
    if (most or 0) > MOST:
        raise ArithmeticError("squared distances may exceed 64 bits")
    size = -(-max(size or 0, 1) // parts) * parts
    return padded(known, size), size


def fit(known: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x components of a part) of a table from vectors()."""
    start = known.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).select("q").toArrow().column(0)
    books = np.ascontiguousarray(matrix(start, size).reshape(-1, parts, size // parts).transpose(1, 0, 2)).copy()
    for _ in range(rounds if len(start) else 0):
        sums = known.select("q").mapInArrow(_sums(books, size), "part int, entry int, many long, total array<long>")
        wide = [F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"d{d}") for d in range(size // parts)]
        for r in sums.groupBy("part", "entry").agg(F.sum("many").alias("many"), *wide).collect():
            books[r.part, r.entry] = [int(r[f"d{d}"]) // r.many for d in range(size // parts)]
    return books


def _sums(books: np.ndarray, size: int):
    parts, entries, width = books.shape

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many, room = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64), 0

        def rows() -> Iterator[pa.RecordBatch]:
            p, e = np.nonzero(many)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(many[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "many", "total"])

        for batch in batches:
            q = matrix(batch.column(0), size).reshape(-1, parts, width)
            for a in range(0, len(q), ROWS):
                for p in range(parts):
                    x = q[a : a + ROWS, p]
                    code = nearest(x, books[p])[0]
                    count = np.bincount(code, minlength=entries)
                    full = np.flatnonzero(count)
                    total[p, full] += np.add.reduceat(x[np.argsort(code, kind="stable")], (np.cumsum(count) - count)[full], axis=0)
                    many[p] += count
            room += len(q)
            if room >= 1 << 33:  # sums of so many components of MOST still fit 64 bits
                yield from rows()
                total[:], many[:], room = 0, 0, 0
        if room:
            yield from rows()

    return add


def encode(known: DataFrame, size: int, books: np.ndarray) -> DataFrame:
    """vec_id, label, codes, error: the entry of each part, and the squared distances summed."""
    kind = known.schema["label"].dataType.simpleString()
    parts, entries, width = books.shape

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                few = batch.slice(a, ROWS)
                q = matrix(few.column(2), size).reshape(-1, parts, width)
                found = [nearest(q[:, p], books[p]) for p in range(parts)]
                codes = np.stack([c for c, _ in found], 1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * parts), pa.array(codes.reshape(-1)))
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), lists, pa.array(sum(d for _, d in found))], names=["vec_id", "label", "codes", "error"])

    return known.mapInArrow(put, f"vec_id long, label {kind}, codes array<int>, error long")


def decode(codes: DataFrame, books: np.ndarray, scale: float = SCALE, col: str = "codes") -> DataFrame:
    """The codes' vectors again, as the column `vector`: the entries end to end, scaled back."""
    table = F.array(*(F.array(*(F.array(*map(F.lit, (e / scale).tolist())) for e in book)) for book in books))
    return codes.withColumn("vector", F.flatten(F.zip_with(table, F.col(col), lambda book, c: book[c])))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> DataFrame:
    """vec_id, label, codes, error, label_error (the errors of all rows of the label), books (the codebooks' digest)."""
    known, size = vectors(rows, id_col, vector_col, label_col, scale, parts)
    books = fit(known, size, parts, entries, rounds)
    if not books.shape[1]:
        return known.select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), *(F.lit(None).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("books")).limit(0)
    coded = materialize(encode(known, size, books), "codes")
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label-errors")
    few = sums.limit(LABELS + 1).count() <= LABELS
    return coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label").withColumn("books", F.lit(digest(books)))
