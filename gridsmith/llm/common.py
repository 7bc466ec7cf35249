"""Shared pieces of the text operators: durable intermediate tables, vectorised
word hashing over Arrow buffers, streaming over sorted groups, and connected
components by alternating stars.

Word hashing works on a whole Arrow text buffer at once.  A polynomial prefix
sum modulo 2**64 gives each word's hash from two lookups, so no Python object
is made per word.  Hashes of 64 bits stand for words and shingles from there on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.session import shared_folder

#: Bytes of text handled at once; temporaries are about 30 times that.
CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_OWN_DIR: list[str] = []


# ------------------------------------------------------------------ tables


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only
    where that is unset and the session is local, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not _OWN_DIR:
        _OWN_DIR.append(shared_folder(spark))
    return _OWN_DIR[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends
    there, so a lost executor never forces the work above to be done again, and
    what is read twice is computed once."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/gridsmith/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; null texts are empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


# ------------------------------------------------------------------ words


def _byte_table(word_bytes: Iterable[int], lower: bool) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for b in word_bytes:
        out[b] = b + 32 if lower and 65 <= b <= 90 else b
    return out


#: Letters and digits of ASCII in lower case, and all bytes beyond ASCII.
ALNUM = _byte_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)], True)
#: Everything but the six ASCII white-space characters (and NUL).
NON_SPACE = _byte_table([b for b in range(1, 256) if b not in (9, 10, 11, 12, 13, 32)], False)
NON_SPACE[0] = 255  # NUL is a word character; 255 is never a byte of UTF-8


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 4096)
            up, down = np.full(size, _P), np.full(size, _P_INV)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


_POWERS = _Powers()


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (one more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def words(texts: pa.Array, kind: np.ndarray = ALNUM, places: bool = False):
    """Hashes of the words of all texts, the index of each text's first word (one
    more than texts) and, if wanted, each word's first and last-but-one byte.

    A text's words are hashes[first[i]:first[i + 1]]."""
    data, offs = text_buffer(texts)
    hashes, begins, ends = [], [], []
    a, cuts = 0, offs[1:-1]
    while a < len(data):
        b = min(len(data), a + CHUNK)
        while b < len(data) and kind[data[b]] and kind[data[b - 1]] and offs[np.searchsorted(offs, b)] != b:
            step = data[b : b + 4096]
            stop = np.flatnonzero(kind[step] == 0)
            nxt = offs[np.searchsorted(offs, b, "right")]
            b = min(b + (int(stop[0]) if len(stop) else len(step)), int(nxt))
        part = kind[data[a:b]]
        w = part != 0
        s, e = w.copy(), w.copy()
        s[1:] &= ~w[:-1]
        e[:-1] &= ~w[1:]
        inner = cuts[np.searchsorted(cuts, a, "right") : np.searchsorted(cuts, b)] - a
        if len(inner):
            s[inner] |= w[inner]
            e[inner - 1] |= w[inner - 1]
        s, e = np.flatnonzero(s), np.flatnonzero(e) + 1
        up, down = _POWERS.get(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(part.astype(np.uint64) * up[: b - a], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        begins.append(s + a)
        ends.append(e + a)
        a = b
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    at = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    first = np.searchsorted(at, offs)
    return (h, first, at, np.concatenate(ends) if ends else at, data, offs) if places else (h, first)


def word_hash(word: bytes) -> int:
    """The hash that words() gives to one word of already lower-cased bytes."""
    total = sum(b * pow(int(_P), i, 1 << 64) for i, b in enumerate(word)) & (1 << 64) - 1
    return int(mix(np.array([total], np.uint64))[0])


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first word; runs may cross texts."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i]
    return mix(out)


def doc_ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-word runs inside each text, and where each text's begin (one
    more than texts). A text of fewer than n words, but some, has one run: all."""
    count = np.diff(first)
    runs = ngrams(h, n)
    keep = np.maximum(count - n + 1, 0)
    at = np.concatenate([[0], np.cumsum(keep)])
    index = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], keep)
    short = np.flatnonzero((count > 0) & (count < n))
    if not len(short):
        return runs[index], at
    size = keep.copy()
    size[short] = 1
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(to[-1], np.uint64)
    out[np.arange(at[-1]) + np.repeat(to[:-1] - at[:-1], keep)] = runs[index]
    for i in short:
        out[to[i]] = ngrams(h[first[i] : first[i + 1]], int(count[i]))[0] ^ np.uint64(count[i])
    return out, to


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with about `most` bytes of text each (column text)."""
    _, offs = text_buffer(batch.column(batch.schema.get_field_index("text")))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, of batches sorted by long keys. Holds one
    group and one batch at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cut = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of many groups of rows with equal keys each, none of which is cut, of batches
    sorted by long keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for k, c in zip(keys, cols, strict=True):
            new[1:] |= c[1:] != c[:-1]
            new[0] |= bool(held) and held[-1].column(batch.schema.get_field_index(k))[-1].as_py() != c[0]
        cut = np.flatnonzero(new)
        if not len(cut):
            held.append(batch)
            continue
        if done := [*held, *([batch.slice(0, int(cut[-1]))] if cut[-1] else [])]:
            yield pa.Table.from_batches(done)
        held = [batch.slice(int(cut[-1]))]
    if held:
        yield pa.Table.from_batches(held)


# ------------------------------------------------------------------ components


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, comp): for each node of the edges (a, b) the smallest node that it is
    joined with. Alternates large and small stars; each round's edges are written
    to the shared folder. A star's centre may have any number of rows: minima are
    pre-aggregated, and the joins are left to skew handling."""
    now = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        now = materialize(small, name)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "id").union(now.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())
