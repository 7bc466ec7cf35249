"""Benchmark decontamination by SimHash of item-sized windows.

Every window of a text as long as an item (in words) is a candidate for it; a text
shorter than the item is one window as a whole.  A
window's fingerprint has 64 bits: the signs of the sum of its shingles'
random vectors, each distinct shingle counted once, as in the items.  Windows that hold no
shingle of an item have similarity zero to it, so postings of the items' shingles name the
windows and items to look at, however many items there are; only such windows are
fingerprinted.  Their fingerprints are matched with those items' by multi-index hashing: the
64 bits are four blocks of 16, and two fingerprints within RADIUS bits differ by RADIUS // 4
bits at most in one block, so pairs without such a block are within the radius of none.  Pairs
within it are then verified exactly: weighted Jaccard similarity of the two shingle sets.
A shingle of the item weighs log(1 + documents / documents that hold it), counted over
all documents; one that the item lacks weighs as much as the item's do on average.

Items are dealt by row to blocks of ITEMS at most, so that what each task holds is bounded; a
benchmark of any size is a loop over its blocks, each of which reads the documents.

Nulls: null texts and null items are empty; items of fewer words than a shingle
are one shingle; empty items match nothing. Null item ids are matched like others.
Equal items give a row each. Repeated rows give their rows again. Long texts are
read whole. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import doc_ngrams, id_text, materialize, mix, ngrams, slices, words

SHINGLE = 5
SIMILARITY = 0.8
#: Bits by which fingerprints of a pair may differ.
RADIUS = 23
BLOCKS, BITS = 4, 16
ITEMS = 50_000


@dataclass
class Items:
    """A block of items: ids, lengths in words, shingle sets and fingerprints."""

    ids: list
    lengths: np.ndarray
    shingles: list[np.ndarray]
    known: np.ndarray
    weights: np.ndarray  # of known shingles
    prints: np.ndarray
    owner: np.ndarray  # items that hold each known shingle, end to end
    owned: np.ndarray  # where each shingle's begin


def _items(ids: list, texts: list[str]) -> Items:
    h, first = words(pa.array(texts, pa.string()))
    grams, at = doc_ngrams(h, first, SHINGLE)
    sets = [np.unique(grams[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    known = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]))
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    which = np.searchsorted(known, np.concatenate([*sets, np.zeros(0, np.uint64)]))
    order = np.argsort(which, kind="stable")
    owned = np.searchsorted(which[order], np.arange(len(known) + 1))
    return Items(ids, np.diff(first), sets, known, np.ones(len(known)), np.zeros(len(ids), np.uint64), of[order], owned)


def _bits(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits of each shingle."""
    r = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    return ((r[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1


def _sign_bits(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(-1, dtype=np.uint64)


def _finish(items: Items, holders: dict[int, int], documents: int) -> Items:
    held = np.array([holders.get(int(k), 0) for k in items.known.view(np.int64)], float)
    items.weights = np.log1p(max(documents, 1) / np.maximum(held, 1))
    for i, s in enumerate(items.shingles):
        if len(s):
            items.prints[i] = _sign_bits(_bits(s).sum(0))
    return items


def pairs_within(prints: np.ndarray, window: np.ndarray, items: np.ndarray, item: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the candidate pairs (window, item; numbers of fingerprints) those within the radius, and how many
    passed the blocks. Two fingerprints within the radius are within radius // BLOCKS bits in some block."""
    differ = prints[window] ^ items[item]
    near = np.zeros(len(differ), bool)
    for b in range(BLOCKS):
        near |= np.bitwise_count((differ >> np.uint64(b * BITS)) & np.uint64((1 << BITS) - 1)) <= radius // BLOCKS
    at = np.flatnonzero(near)
    within = at[np.bitwise_count(differ[at]) <= radius]
    return window[within], item[within], len(at)


def window_prints(grams: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of k shingles, each distinct one counted once in a run: an occurrence
    doesn't count in the runs that hold the one before it."""
    bits = _bits(grams)
    sums = np.concatenate([np.zeros((1, 64), np.float32), np.cumsum(bits, 0, dtype=np.float32)])
    sums = sums[k:] - sums[:-k]
    order = np.argsort(grams, kind="stable")
    before, after = order[:-1], order[1:]
    again = (grams[before] == grams[after]) & (after - before < k)
    if again.any():
        before, after = before[again], after[again]
        # runs that begin in [after - k + 1, before] hold both
        change = np.zeros((len(sums) + 1, 64), np.float32)
        np.add.at(change, np.maximum(after - k + 1, 0), bits[after])
        np.subtract.at(change, np.minimum(before, len(sums) - 1) + 1, bits[after])
        sums = sums - np.cumsum(change[:-1], 0)
    return _sign_bits(sums)


def _matches(h: np.ndarray, grams: np.ndarray, places: np.ndarray, shingle: np.ndarray, items: Items, at_least: float) -> list[tuple]:
    """Rows (item, first word, words, differing bits, similarity) for one text: the best
    window of each item. places: of its shingles that some item holds, whose numbers
    among the known are `shingle`."""
    out: dict[int, tuple] = {}
    n = len(h)
    many = items.owned[shingle + 1] - items.owned[shingle]
    of = items.owner[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(items.owned[shingle], many)]
    lengths, at_place = items.lengths[of], np.repeat(places, many)
    for length in np.unique(lengths).tolist():
        if min(length, n) < SHINGLE:
            continue
        mine = lengths == length
        size = min(length, n)  # of the windows
        k = size - SHINGLE + 1
        # the runs of starts whose windows hold a place, for each item that the place's shingle names
        item, hits = of[mine], at_place[mine]
        lo, hi = np.maximum(hits - k + 1, 0), np.minimum(hits, n - size)
        ok = lo <= hi
        for a, b, who, begin, end in _stretches(item[ok], lo[ok], hi[ok]):
            prints = window_prints(grams[a : b + k], k)
            window = np.concatenate([np.arange(x, y + 1) for x, y in zip(begin, end, strict=True)]) - a
            x, y, _ = pairs_within(prints, window, items.prints, np.repeat(who, end - begin + 1))
            order = np.argsort(x, kind="stable")  # the first of equally similar windows
            for start, i in zip((x[order] + a).tolist(), y[order].tolist(), strict=True):
                theirs = items.weights[np.searchsorted(items.known, items.shingles[i])]
                held = np.unique(grams[start : start + k])
                common = np.isin(items.shingles[i], held, assume_unique=True)
                others = len(held) - int(common.sum())
                similar = float(theirs[common].sum() / (theirs.sum() + others * theirs.mean()))
                if similar >= at_least and similar > out.get(i, (0, 0, 0, 0, 0.0))[4] + 1e-6:
                    out[i] = (i, start, size, int(np.bitwise_count(prints[start - a] ^ items.prints[i])), similar)
    return list(out.values())


def _stretches(item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges [a, b] of starts that overlap, with the disjoint ranges (item, begin, end) of each item in them."""
    if not len(item):
        return
    order = np.lexsort((lo, item))
    item, lo, hi = item[order], lo[order], hi[order]
    # ranges of one item are joined; those of the next lie beyond all before
    shift = np.cumsum(np.diff(item, prepend=item[:1]) != 0) * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + shift)
    first = np.flatnonzero(np.concatenate([[True], (lo + shift)[1:] > reach[:-1]]))
    who, begin, end = item[first], lo[first], np.maximum.reduceat(hi, first)
    order = np.argsort(begin, kind="stable")
    who, begin, end = who[order], begin[order], end[order]
    reach = np.maximum.accumulate(end)
    for part in np.split(np.arange(len(begin)), np.flatnonzero(begin[1:] > reach[:-1]) + 1):
        yield int(begin[part[0]]), int(reach[part[-1]]), who[part], begin[part], end[part]


def _short(h: np.ndarray, length: int) -> np.ndarray:
    return ngrams(h, length) ^ np.uint64(length)


def _text_hits(h: np.ndarray, first: np.ndarray, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts (by number) that hold shingles of items: all their shingles, the places
    of those held and their numbers among the known."""
    runs = ngrams(h, SHINGLE)
    if not len(items.known):
        return
    slot = np.zeros(1 << 20, bool)
    slot[(items.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    maybe = np.flatnonzero(slot[(runs & np.uint64((1 << 20) - 1)).astype(np.int64)])
    where = np.minimum(np.searchsorted(items.known, runs[maybe]), len(items.known) - 1)
    at = maybe[items.known[where] == runs[maybe]]
    doc = np.searchsorted(first, at, "right") - 1
    inside = at + SHINGLE <= first[doc + 1]
    at, doc = at[inside], doc[inside]
    number = np.searchsorted(items.known, runs[at])
    for i in np.unique(doc).tolist():
        a, b = first[i], first[i + 1]
        mine = slice(*np.searchsorted(doc, [i, i + 1]))
        yield i, runs[a : b - SHINGLE + 1], at[mine] - a, number[mine]


def _short_matches(h: np.ndarray, items: Items, short: list[int]) -> list[tuple]:
    """Items of fewer words than a shingle have one shingle: places where they stand."""
    out = []
    for length in {int(items.lengths[i]) for i in short}:
        if length <= len(h):
            grams = _short(h, length)
            for i in short:
                if items.lengths[i] == length and len(found := np.flatnonzero(grams == items.shingles[i][0])):
                    out.append((i, int(found[0]), length, 0, 1.0))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, first_word, n_words, bits, similarity: for each text and each
    item of a similar window the most similar one, the first of equals."""
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col)
    listed = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    blocks = listed.count() // ITEMS + 1
    schema = "doc_id long, item_id long, first_word long, n_words long, bits int, similarity double"
    out = spark.createDataFrame([], schema)
    if blocks > 1:  # dealt by row, so equal items don't meet; written, so every block sees the same deal
        listed = materialize(listed.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))), "bench-items")
    for block in range(blocks):
        rows = (listed.filter(F.col("block") == block) if blocks > 1 else listed).orderBy("item_id", "text").collect()
        items = _items([r.item_id for r in rows], [r.text for r in rows])
        out = out.unionAll(_block(texts, items, similarity, schema))
    return out


def _block(texts: DataFrame, items: Items, similarity: float, schema: str) -> DataFrame:
    spark = texts.sparkSession
    short = [i for i, n in enumerate(items.lengths.tolist()) if 0 < n < SHINGLE]
    held = spark.sparkContext.broadcast(items)  # at most ITEMS items

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that hold a shingle of an item, with the shingles that they hold; and a count of all."""
        it, seen = held.value, 0
        for batch in (s for b in batches for s in slices(b)):
            h, first = words(batch.column(1))
            seen += batch.num_rows
            got = {i: np.unique(grams[at]).view(np.int64).tolist() for i, grams, at, _ in _text_hits(h, first, it)}
            if short:
                for i in range(batch.num_rows):
                    if _short_matches(h[first[i] : first[i + 1]], it, short):
                        got.setdefault(i, [])
            if got:
                pick = pa.array(list(got))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(list(got.values()), pa.list_(pa.int64())), pa.array([None] * len(got), pa.int64())], names=["doc_id", "text", "held", "seen"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([""]), pa.array([[]], pa.list_(pa.int64())), pa.array([seen], pa.int64())], names=["doc_id", "text", "held", "seen"])

    found = materialize(texts.mapInArrow(look, "doc_id long, text string, held array<long>, seen long"), "bench-texts")
    documents = found.agg(F.sum("seen")).first()[0] or 0
    counted = {r.s: r["count"] for r in found.select(F.explode("held").alias("s")).groupBy("s").count().collect()}  # at most the items' shingles
    ready = spark.sparkContext.broadcast(_finish(items, counted, documents))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = ready.value
        for batch in (s for b in batches for s in slices(b)):
            h, first = words(batch.column(1))
            rows, of = [], []
            ids = batch.column(0).to_pylist()
            for i, grams, at, number in _text_hits(h, first, it):
                more = _matches(h[first[i] : first[i + 1]], grams, at, number, it, similarity)
                rows += more
                of += [ids[i]] * len(more)
            for i in range(batch.num_rows) if short else ():
                more = _short_matches(h[first[i] : first[i + 1]], it, short)
                rows += more
                of += [ids[i]] * len(more)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of, pa.int64()), pa.array([it.ids[r[0]] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)), pa.array([r[3] for r in rows], pa.int32()), pa.array([round(r[4], 6) for r in rows], pa.float64())],
                    names=["doc_id", "item_id", "first_word", "n_words", "bits", "similarity"],
                )

    return found.filter("seen is null").select("doc_id", "text").mapInArrow(verify, schema)


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose texts hold no item, with all their columns. Rows without an id stay."""
    hit = matches(docs, benchmark, similarity).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)
