"""Substring deduplication by collinear chaining of shared k-mer seeds.

Words are runs of letters and digits, ASCII letters in lower case. Texts of equal
words are one class; only its text of the smallest id is searched, and the others
are linked to it whole.

1. Seeds: of every WINDOW successive K-word runs the one of lowest hash. Two texts
   that share K + WINDOW - 1 successive words share a seed. A word that is repeated
   gives one seed for its whole run, with its length, and one more if the run by
   itself is as long as a passage.
2. Join: each holder of a seed is linked to its first holder (smallest id), not to the
   others, so a passage of n texts gives n - 1 links. Holders are dealt by ranges of seed
   and id, which splits frequent seeds.
3. Chain: a pair's links are merged into runs on one diagonal, and runs are chained
   in order in both texts, each scored by its words less the chain's gap costs. The
   best predecessor within REACH is a range maximum, kept in a Fenwick tree.
4. Align: the words about a chain, MARGIN to either side, are fetched from both texts; all
   K-word matches between them are merged and chained anew, so that seeds linked to other
   texts are missed no more. A chain's runs are extended word by word and the gaps between them are
   split where most words agree; of the alignment, the stretches that score best
   (+1 a word that agrees, -PENALTY one that doesn't) are the passages, if they
   hold LEAST words with a share of IDENTITY agreeing.  The words come in blocks of
   CUT words, each wanted block of a text once, however many chains want it.

5. Again: chains are aligned widest first, and of those that lie within wider ones of their
   text only such as lie in no passage found by then. Likewise, where SOME words that
   begin with a shared seed lie in no passage (at none of their places, if the text repeats
   them), these whole runs are linked to their first holder.
6. Rest: what still lies in no passage is linked to more than the first holder, so that texts that
   hold parts of a passage hide no text that holds it whole. Each LEAST words that hold a shared
   run of SOME are linked to their first holder. A seed that FEW texts hold at most is linked to
   all of them. More frequent seeds are joined by twos, HULL words or more from the first to the
   last, as a chain has to be; two seeds are linked to one text of each kind of neighbourhood (the
   shared seeds within LEAST words), for texts of one kind share the same seeds. Of more than FEW
   kinds only the first holder is linked, and items that overlap are joined to longer ones, which are
   linked likewise, where no first holder holds them joined. Chains that lie in a
   passage are dropped, the others aligned widest first as before, and of passages that lie in
   one another the widest is kept.

Rows: doc_id, start_word, end_word (exclusive), source_id, source_start, source_end,
n_words and similarity.

Nulls: null texts are empty; texts of fewer words than LEAST hold no passage. Null ids
are left out. Rows of one id and equal words are one; of one id and other words,
each is searched, under the same id, and never against itself. Repeats within one
text are not reported. Extra columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import grouped, id_text, materialize, mix, ngrams, partitions, slices, whole_groups, words
from gridsmith.llm.jaccard import _prints

K, WINDOW = 5, 8
LEAST, IDENTITY, PENALTY = 50, 0.8, 4.0
#: Words that a gap between runs of one chain may have, and the cost of one.
REACH, GAP = 60, 0.25
#: Of LEAST words that two texts share, SOME that begin with a seed are shared at least.
SOME = LEAST - WINDOW + 1
#: Texts that hold a seed, up to which all are linked; beyond, seeds are joined by twos.
FEW = 16
#: Words about a seed that lie in the same passage, where it needs no more links.
SIDE = LEAST // 2
#: Words from a chain's first to its last that are looked into, and words fetched on either side.
HULL, MARGIN = K + WINDOW, 32
CUT = 64
SEED = "h bigint, doc_id bigint, at int, many int, some bigint"
LOOSE = "h long, doc_id long, at long, many long, kind long, lead boolean, open boolean, wanted boolean"
ITEM = "h long, kind long, doc_id long, at long, many long, at2 long, many2 long, head long, tail long, wanted boolean"
PASSAGE = "doc_id long, start_word long, end_word long, source_id long, source_start long, source_end long, n_words long, similarity double"


def seeds_of(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, word, places) of the seeds of all texts; places: successive
    words where the seed stands, over 1 if one word is repeated."""
    runs = ngrams(h, K)
    if not len(runs):
        return runs, *(np.zeros(0, np.int64),) * 3
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = doc[: len(runs)] == doc[K - 1 :]
    value = np.where(inside, runs, np.uint64(0xFFFFFFFFFFFFFFFF))
    low = value.copy()
    for i in range(1, WINDOW):
        np.minimum(low[: len(low) - i], value[i:], out=low[: len(low) - i])
    # a run is a seed if it is the lowest of a window that lies in its text
    ends = first[1:][doc[: len(runs)]] - K + 1  # one beyond the text's last run
    full = np.arange(len(runs)) + WINDOW <= ends
    begin = np.arange(len(runs)) == first[:-1][doc[: len(runs)]]
    open_ = full | begin
    marked = np.zeros(len(runs), bool)
    for i in range(WINDOW):
        n = len(runs) - i
        marked[i:] |= open_[:n] & inside[i:] & (doc[:n] == doc[i : len(runs)]) & (value[i:] == low[:n])
    at = np.flatnonzero(marked)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (runs[at[1:]] != runs[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    begin = np.flatnonzero(new)
    many, at = np.diff(np.append(begin, len(at))), at[begin]
    long_ = many + K - 1 >= LEAST
    key = np.concatenate([runs[at], mix(runs[at[long_]])])
    at, many = np.concatenate([at, at[long_]]), np.concatenate([many, many[long_]])
    return key, doc[at], at - first[doc[at]], many


def _seeds(texts: DataFrame) -> DataFrame:
    """(h, doc_id, at, many, some): seeds, and the hash of the SOME words that begin there,
    null where the text ends before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            h, first = words(batch.column(1))
            key, doc, at, many = seeds_of(h, first)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            fits = first[doc + 1] - first[doc] - at >= SOME
            some = np.zeros(len(key), np.int64)
            some[fits] = long_runs(h, SOME)[(first[doc] + at)[fits]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[doc].astype(np.int64)), pa.array(at.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(some, mask=~fits)], names=["h", "doc_id", "at", "many", "some"])

    return texts.mapInArrow(run, SEED)


def long_runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first word, put together of runs of powers of two."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    part, size, power = h, 1, 0xD6E8FEB86659FD93
    out, have = np.zeros(len(h) + 1, np.uint64), 0
    while n:
        if n & 1:
            m = len(h) - have - size + 1
            out, have = part[:m] * np.uint64(pow(0xD6E8FEB86659FD93, have, 1 << 64)) + out[size : size + m], have + size
        if n := n >> 1:
            m = len(h) - 2 * size + 1
            part, size, power = part[:m] * np.uint64(power) + part[size : size + m], 2 * size, power * power % (1 << 64)
    return mix(out)


def _linked(rows: DataFrame, name: str) -> DataFrame:
    """rows (h, doc_id, at, many and more) of texts that share h, with the place of its first
    holder: source_id, source_at and source_many.

    Rows are dealt by ranges of (h, doc_id, at), so that holders of a frequent h may lie in
    many partitions. The first of a group that begins in an earlier partition is told by
    that one, a row a partition."""
    kept = rows.columns
    types = dict(rows.dtypes)
    place = ("doc_id", "at", "many")
    schema = ", ".join([*(f"{c} {types[c]}" for c in kept), "source_id bigint, source_at int, source_many int, part int, lead boolean, told array<bigint>"])
    names = [*kept, "source_id", "source_at", "source_many", "part", "lead", "told"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: pa.RecordBatch | None = None  # the first row of the last group
        lead: int | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            skip = last is not None
            t = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            h, doc = t["h"].to_numpy(), t["doc_id"].to_numpy()
            lead = int(h[0]) if lead is None else lead
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            group, first = np.cumsum(new) - 1, np.flatnonzero(new)
            shared = np.zeros(len(first), bool)  # by another text too, or perhaps in what follows
            shared[group[doc != doc[first[group]]]] = True
            shared[-1] = True
            ok = shared[group] | (h == lead)
            ok[:skip] = False
            at = np.flatnonzero(ok)
            if len(at):
                take = lambda c, rows_: t[c].combine_chunks().take(pa.array(rows_))  # noqa: B023, E731
                cols = [*(take(c, at) for c in kept), *(take(c, first[group[at]]) for c in place)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(at), part, np.int32)), pa.array(h[at] == lead), pa.nulls(len(at), pa.list_(pa.int64()))], names=names)
            last = t.slice(int(first[-1]), 1).to_batches()[0]
        if last is not None:
            told = [lead, *(last.column(last.schema.get_field_index(c))[0].as_py() for c in ("h", *place))]
            nulls = [pa.nulls(1, last.schema.field(c).type) for c in [*kept, *place]]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array([part], pa.int32()), pa.array([False]), pa.array([told], pa.list_(pa.int64()))], names=names)

    n = partitions(rows.sparkSession)
    dealt = rows.repartitionByRange(n, "h", "doc_id", "at", "many").sortWithinPartitions("h", "doc_id", "at", "many")
    found = materialize(dealt.mapInArrow(run, schema), name)
    carried, before = [], None  # the last group's h and first place
    told = sorted((r.part, r.told) for r in found.filter("told is not null").select("part", "told").collect())  # a row a partition
    for part, x in told:
        if before is not None and before[0] == x[0]:
            carried.append((part, *before[1:]))
        if before is None or not before[0] == x[0] == x[1]:
            before = x[1:]
    carry = rows.sparkSession.createDataFrame(carried, "part int, _id long, _at long, _many long")
    out = found.filter("told is null").join(F.broadcast(carry.withColumn("lead", F.lit(True))), ["part", "lead"], "left")  # a row a partition
    out = out.select(*kept, *(F.coalesce(F.col(a).cast(t), b).alias(b) for a, b, t in (("_id", "source_id", "bigint"), ("_at", "source_at", "int"), ("_many", "source_many", "int"))))
    # groups at the ends of ranges may have one text
    ends = rows.sparkSession.createDataFrame(sorted({(h,) for _, x in told for h in x[:2]}), "h bigint")  # two rows a partition
    single = out.join(F.broadcast(ends), "h", "left_semi").groupBy("h").agg(F.max(F.col("doc_id") != F.col("source_id")).alias("shared")).filter("not shared").select("h")
    return out.join(F.broadcast(materialize(single, "passage-single")), "h", "left_anti")


def _pairs(linked: DataFrame) -> DataFrame:
    """(doc_id, source_id, at, source_at, many): each text's place and the first holder's."""
    return linked.filter("doc_id != source_id").select("doc_id", "source_id", "at", "source_at", F.least("many", "source_many").alias("many"))


def _windows(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, doc_id, at): the LEAST words about each place of wanted (doc_id, places) at which a
    seed is the first of its window, or one of the WINDOW - 1 after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            h, first = words(batch.column(1))
            runs = long_runs(h, LEAST)
            for i, (key, places) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                at = np.unique(np.subtract.outer(np.array(places, np.int64), np.arange(WINDOW)))
                at = at[(at >= 0) & (at + LEAST <= first[i + 1] - first[i])]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(runs[first[i] + at].view(np.int64)), pa.array(np.full(len(at), key, np.int64)), pa.array(at.astype(np.int32))], names=["h", "doc_id", "at"])

    return texts.join(wanted, "doc_id").select("doc_id", "text", "places").mapInArrow(run, "h long, doc_id long, at int")


def _by_doc(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "doc_id").sortWithinPartitions("doc_id")


def _loose(shared: DataFrame, known: DataFrame) -> DataFrame:
    """(h, doc_id, at, many, kind, lead, open, wanted): shared seeds of which REACH words bring
    together HULL or more. kind: hash of the seeds within LEAST words; lead: the first of its
    text with this h and kind; open: no passage of known (doc_id, start_word, end_word) holds it
    and the SIDE words about it, as far as passages that meet reach; wanted: one near it is open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["doc_id"]):
            t = t.combine_chunks()
            h, doc, at, many = (t[c].to_numpy() for c in ("h", "doc_id", "at", "many"))
            new = np.ones(len(doc), bool)
            new[1:] = doc[1:] != doc[:-1]
            place = (np.cumsum(new) << 32) + at  # so that no two texts are near
            spans = t["passage"].to_numpy()
            order = np.argsort(place[spans], kind="stable")
            begins, ends = place[spans][order], np.maximum.accumulate((place + many)[spans][order])
            rows = np.flatnonzero(~spans)
            rows = rows[np.lexsort((h[rows], place[rows]))]
            if not len(rows):
                continue
            h, doc, at, many, p = h[rows], doc[rows], at[rows], many[rows], place[rows]
            e = p + many - 1 + K
            new = np.ones(len(p), bool)
            new[1:] = p[1:] - np.maximum.accumulate(e)[:-1] > REACH
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            low, high = p[first], np.maximum.reduceat(e, first)
            open_ = ~_inside(begins, ends, p, e)
            if len(begins):  # passages that meet or nearly so
                meet = np.append(True, begins[1:] > ends[:-1] + HULL)
                part = (np.cumsum(meet) - 1)[np.maximum(np.searchsorted(begins, p, "right") - 1, 0)]
                left, right = np.maximum(p - SIDE, begins[meet][part]), np.minimum(e + SIDE, np.maximum.reduceat(ends, np.flatnonzero(meet))[part])
                open_ |= ~_inside(begins, ends, left, right)
            wanted = np.logical_or.reduceat(open_, first)[group]
            seed = h.view(np.uint64)
            kind = mix(seed + many.astype(np.uint64))
            for i, j in _near(p, 0, LEAST):
                step = mix((p[j] - p[i]).view(np.uint64) + np.uint64(1))
                kind[i] += mix(seed[j] ^ step)
                kind[j] += mix(seed[i] ^ ~step)
            lead = np.zeros(len(p), bool)
            lead[np.unique(mix(mix(kind ^ seed) + doc.view(np.uint64)), return_index=True)[1]] = True
            ok = (high - low >= HULL)[group]
            yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in (h, doc, at, many, kind.view(np.int64), lead, open_, wanted)], names=["h", "doc_id", "at", "many", "kind", "lead", "open", "wanted"])

    seeds = shared.select("h", "doc_id", F.col("at").cast("long"), F.col("many").cast("long"), F.lit(False).alias("passage"))
    spans = known.select(F.lit(0).cast("long").alias("h"), "doc_id", F.col("start_word").alias("at"), (F.col("end_word") - F.col("start_word")).alias("many"), F.lit(True).alias("passage"))
    return _by_doc(seeds.union(spans)).mapInArrow(run, LOOSE)


def _inside(begins: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether one of the spans holds a to b; spans by begin, ends the farthest so far."""
    k = np.searchsorted(begins, a, "right")
    return (k > 0) & (np.append(ends, 0)[k - 1] >= b)


def _near(place: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (i, j), i < j, of the places, which are in order, that lie low to high words apart."""
    i = np.arange(len(place))
    for step in range(1, len(place)):
        i = i[: np.searchsorted(i, len(place) - step)]
        apart = place[i + step] - place[i]
        i, apart = i[apart <= high], apart[apart <= high]
        if not len(i):
            return
        if (apart >= low).any():
            yield i[apart >= low], i[apart >= low] + step


def _items(key: np.ndarray, kind: np.ndarray, doc: np.ndarray, *cols: np.ndarray) -> pa.RecordBatch:
    """Rows of ITEM, of each key and kind the first of its text."""
    one = np.sort(np.unique(mix(mix(key ^ kind) + doc.view(np.uint64)), return_index=True)[1])
    return pa.RecordBatch.from_arrays([pa.array(c[one]) for c in (key.view(np.int64), kind.view(np.int64), doc, *cols)], names=[f.split()[0] for f in ITEM.split(", ")])


def _twos(held: DataFrame) -> DataFrame:
    """Rows of ITEM: each two seeds of held that lie near and of which one is frequent; wanted, if one
    is frequent and open. head and tail: what the next longer items overlap in, here the places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["doc_id"]):
            t = t.combine_chunks()
            h, doc, at, many, kind, open_, often = (t[c].to_numpy(zero_copy_only=False) for c in ("h", "doc_id", "at", "many", "kind", "open", "often"))
            new = np.ones(len(doc), bool)
            new[1:] = doc[1:] != doc[:-1]
            place = (np.cumsum(new) << 32) + at
            order = np.lexsort((h, place))
            h, doc, at, many, kind, open_, often, place = (c[order] for c in (h, doc, at, many, kind, open_, often, place))
            seed, kind = h.view(np.uint64), kind.view(np.uint64)
            for i, j in _near(place, 1, REACH + HULL):
                ok = (often[i] | often[j]) & (h[i] != h[j]) & (at[j] + many[j] - 1 + K - at[i] >= HULL)
                i, j = i[ok], j[ok]
                if len(i):
                    key, of = mix(seed[i] * np.uint64(0xD6E8FEB86659FD93) + seed[j]), mix(mix(kind[i]) + kind[j])
                    yield _items(key, of, doc[i], at[i], many[i], at[j], many[j], at[i], at[j], (often & open_)[i] | (often & open_)[j])

    return _by_doc(held).mapInArrow(run, ITEM)


def _joined(crowded: DataFrame) -> DataFrame:
    """Rows of ITEM: each two items of a text that overlap in all but their ends, joined, but for
    those that the first holder of the one (first_id, first_head, first_tail) holds joined too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["doc_id"]):
            t = t.combine_chunks()
            doc, at, many, at2, many2, wanted, asked, first_id, first_head, first_tail = (t[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "at", "many", "at2", "many2", "wanted", "asked", "first_id", "first_head", "first_tail"))
            key, kind, head, tail = (t[c].to_numpy().view(np.uint64) for c in ("h", "kind", "head", "tail"))
            text = mix(doc.view(np.uint64))
            begin, end, whole = mix(head + text), mix(tail + text), mix(mix(head) + tail).view(np.int64)
            order = np.argsort(begin, kind="stable")
            low = np.searchsorted(begin[order], end)
            count = np.searchsorted(begin[order], end, "right") - low
            total = np.cumsum(count)
            a = 0
            while a < len(count):  # of about a million pairs at once
                b = max(a + 1, int(np.searchsorted(total, total[a] - count[a] + (1 << 20), "right")))
                n = count[a:b]
                i = np.repeat(np.arange(a, b), n)
                j = order[np.repeat(low[a:b] - np.cumsum(n) + n, n) + np.arange(len(i))]
                ok = (asked[i] | asked[j]) & ((first_id[i] != first_id[j]) | (first_tail[i] != first_head[j]))
                i, j, a = i[ok], j[ok], b
                if len(i):
                    yield _items(mix(mix(key[i]) + key[j]), mix(mix(kind[i]) + kind[j]), doc[i], at[i], many[i], at2[j], many2[j], whole[i], whole[j], wanted[i] | wanted[j])

    return _by_doc(crowded).mapInArrow(run, ITEM)


def _scattered(loose: DataFrame) -> DataFrame:
    """(doc_id, source_id, at, source_at, many): links of loose seeds to all earlier holders, to
    frequent ones by twos, and where these are crowded by longer items."""
    texts = loose.groupBy("h").agg(F.count_distinct("doc_id").alias("texts"), F.max("wanted").alias("any")).filter("texts > 1 and any").select("h", (F.col("texts") > FEW).alias("often"))
    held = materialize(loose.join(texts, "h"), "passage-held")
    few = held.filter("lead and not often")
    source = few.select("h", F.col("doc_id").alias("source_id"), F.col("at").alias("source_at"), F.col("many").alias("source_many"))
    links = few.filter("wanted").join(source, "h").filter("source_id < doc_id").select("doc_id", "source_id", "at", "source_at", F.least("many", "source_many").alias("many"))
    ends = F.array(F.struct("at", F.col("s.at").alias("source_at"), F.least("many", "s.many").alias("many")), F.struct(F.col("at2").alias("at"), F.col("s.at2").alias("source_at"), F.least("many2", "s.many2").alias("many")))
    items = materialize(_twos(held), "passage-items")
    while True:
        kinds = items.groupBy("h", "kind").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("wanted").alias("asked"))
        groups = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("first").alias("first_id"), F.max("last").alias("last"), F.max("asked").alias("asked")).filter("first_id < last")
        groups = groups.select("h", (F.col("kinds") > FEW).alias("crowd"), "first_id", "asked").filter("crowd or asked")
        grouped_ = materialize(items.join(groups, "h"), "passage-grouped")
        sparse = grouped_.filter("not crowd")
        each = sparse.groupBy("h", "kind").agg(F.min(F.struct("doc_id", "at", "many", "at2", "many2")).alias("s")).select("h", "s")
        both = sparse.filter("wanted").join(each, "h")
        crowd = grouped_.filter("crowd").drop("crowd")
        lead = crowd.filter("doc_id = first_id").groupBy("h").agg(F.min(F.struct("at", "many", "at2", "many2", "head", "tail")).alias("s"))
        crowd = crowd.join(lead, "h")
        both = both.drop("crowd", "first_id", "asked").unionByName(crowd.filter("wanted").select(*items.columns, F.struct(F.col("first_id").alias("doc_id"), "s.at", "s.many", "s.at2", "s.many2").alias("s")))
        links = links.union(both.filter("s.doc_id < doc_id").select("doc_id", F.col("s.doc_id").alias("source_id"), F.explode(ends).alias("x")).select("doc_id", "source_id", "x.at", "x.source_at", "x.many"))
        items = materialize(_joined(crowd.withColumn("first_head", F.col("s.head")).withColumn("first_tail", F.col("s.tail")).drop("s")), "passage-items")
        if items.isEmpty():
            return links.distinct()


class Fenwick:
    """Largest (score, number) over a range of places 1 to n, of those put since a time.
    Each node keeps those of its places that no later and larger one hides."""

    def __init__(self, n: int) -> None:
        self.node: list[deque] = [deque() for _ in range(n + 1)]
        self.leaf: list[deque] = [deque() for _ in range(n + 1)]

    @staticmethod
    def _add(held: deque, entry: tuple[float, int, int]) -> None:
        while held and held[-1][0] <= entry[0]:
            held.pop()
        held.append(entry)

    @staticmethod
    def _top(held: deque, since: int) -> tuple[float, int]:
        while held and held[0][2] < since:
            held.popleft()
        return held[0][:2] if held else (-1e18, -1)

    def put(self, i: int, score: float, number: int, time: int) -> None:
        """Times never decrease."""
        self._add(self.leaf[i], (score, number, time))
        while i < len(self.node):
            self._add(self.node[i], (score, number, time))
            i += i & -i

    def best(self, low: int, high: int, since: int) -> tuple[float, int]:
        """Of places low to high; `since` never decreases."""
        out = (-1e18, -1)
        while high >= low:
            below = high - (high & -high)
            if below >= low - 1:
                out, high = max(out, self._top(self.node[high], since)), below
            else:
                out, high = max(out, self._top(self.leaf[high], since)), high - 1
        return out


def diagonal_runs(at: np.ndarray, source: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Rows (start, end, source start, source end): seeds of one diagonal whose gaps are
    within REACH, merged; by start."""
    diagonal = source.astype(np.int64) - at
    order = np.lexsort((at, diagonal))
    a, d = at[order].astype(np.int64), diagonal[order]
    ends = a + many[order] - 1
    new = np.ones(len(a), bool)
    new[1:] = d[1:] != d[:-1]
    shift = (np.cumsum(new) - 1) * (int(ends.max()) + 1)  # the farthest end so far on each diagonal
    far = np.maximum.accumulate(ends + shift) - shift
    new[1:] |= a[1:] - far[:-1] > REACH
    begin = np.flatnonzero(new)
    end = np.maximum.reduceat(ends, begin) + K
    out = np.stack([a[begin], end, a[begin] + d[begin], end + d[begin]], 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def chains(runs: np.ndarray) -> list[list[int]]:
    """Numbers of the runs of each chain, best chains first; no run is in two. A run's
    predecessor is the best that ends REACH words before it at most, in both texts."""
    if len(runs) == 1:
        return [[0]]
    n = len(runs)
    size = (runs[:, 1] - runs[:, 0]).astype(float)
    places = np.unique(runs[:, 3])
    rank = np.searchsorted(places, runs[:, 3]) + 1
    low = np.searchsorted(places, runs[:, 2] - REACH) + 1
    high = np.searchsorted(places, runs[:, 2], "right")
    tree, score, back = Fenwick(len(places)), size.copy(), np.full(n, -1)
    pending = np.argsort(runs[:, 1], kind="stable")
    p = 0
    for i in range(n):
        while p < n and runs[pending[p], 1] <= runs[i, 0]:
            j = int(pending[p])
            tree.put(int(rank[j]), score[j] + GAP * float(runs[j, 1] + runs[j, 3]) / 2, j, int(runs[j, 1]))
            p += 1
        value, j = tree.best(int(low[i]), int(high[i]), int(runs[i, 0]) - REACH)
        got = value - GAP * float(runs[i, 0] + runs[i, 2]) / 2
        if j >= 0 and got > 0:
            score[i] += got
            back[i] = j
    used, out = np.zeros(n, bool), []
    for i in np.lexsort((runs[:, 0], -score)).tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = int(back[i])
        if chain:
            out.append(chain[::-1])
    return out


def _chained(shared: DataFrame) -> DataFrame:
    """(doc_id, source_id, no, runs) of chains that may hold a passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for part in whole_groups(batches, ["doc_id", "source_id"]):
            doc, other, at, source, many = (part[c].to_numpy() for c in ("doc_id", "source_id", "at", "source_at", "many"))
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])
            begin = np.flatnonzero(new)
            wide = np.maximum.reduceat(at + many, begin) - np.minimum.reduceat(at, begin) + K - 1 >= HULL
            for a, b in zip(begin[wide].tolist(), np.append(begin[1:], len(doc))[wide].tolist(), strict=True):
                runs = diagonal_runs(at[a:b], source[a:b], many[a:b])
                for no, chain in enumerate(chains(runs)):
                    r = runs[chain]
                    if r[-1, 1] - r[0, 0] >= HULL:
                        out.append((int(doc[a]), int(other[a]), no, r.ravel().tolist()))
                if len(out) >= 2000:
                    yield _rows(out, "doc_id long, source_id long, no int, runs array<long>")
                    out = []
        if out:
            yield _rows(out, "doc_id long, source_id long, no int, runs array<long>")

    n = partitions(shared.sparkSession)
    return shared.repartition(n, "doc_id", "source_id").sortWithinPartitions("doc_id", "source_id").mapInArrow(run, "doc_id long, source_id long, no int, runs array<long>")


def _widest(chains_: DataFrame) -> DataFrame:
    """chains_ with `widest`: whether a chain holds words of its text that no wider one, in
    falling order of width, has about it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["doc_id"]):
            runs = t["runs"].to_pylist()
            begin, end = (np.array([r[k] for r in runs]) for k in (0, -3))
            order = np.lexsort((t["no"].to_numpy(), t["source_id"].to_numpy(), begin - end))
            about, widest = np.zeros(int(end.max() - begin.min()), bool), np.zeros(len(runs), bool)
            for i in order.tolist():
                mine = about[begin[i] - begin.min() : end[i] - begin.min()]
                widest[i] = not mine.all()
                mine[:] = True
            yield from t.append_column("widest", pa.array(widest)).combine_chunks().to_batches()

    schema = "doc_id long, source_id long, no int, runs array<long>"
    return chains_.repartition(partitions(chains_.sparkSession), "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, schema + ", widest boolean")


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TYPES[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def dense_runs(d: np.ndarray, s: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Runs of all K-word matches of the words d and s near a chain of some of them: each
    K words of d with their place in s that lies nearest to the chain's diagonal there."""
    mine, theirs = ngrams(d, K), ngrams(s, K)
    if not len(mine) or not len(theirs):
        return runs
    order = np.argsort(theirs, kind="stable")
    ranked = theirs[order]
    low, high = np.searchsorted(ranked, mine), np.searchsorted(ranked, mine, "right")
    at = np.flatnonzero(high > low)
    if not len(at):
        return runs
    low, high, m = low[at], high[at], len(theirs)
    new = np.ones(m, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    keys = np.flatnonzero(new)[np.cumsum(new) - 1] * m + order
    of = np.maximum(np.searchsorted(runs[:, 0], at, "right") - 1, 0)
    aim = np.clip(at + runs[of, 2] - runs[of, 0], 0, m - 1)
    right = np.searchsorted(keys, low * m + aim)
    left = np.maximum(right - 1, low)
    right = np.minimum(right, high - 1)
    near = np.where(np.abs(order[left] - aim) <= np.abs(order[right] - aim), order[left], order[right])
    return diagonal_runs(at, near, np.ones(len(at), np.int64))


def align(d: np.ndarray, s: np.ndarray, runs: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Passages (start, end, source start, source end, share) of a chain of runs over
    the words d and s; places are of d and s."""
    a0, b0, a1, b1 = int(runs[0, 0]), int(runs[0, 2]), int(runs[-1, 1]), int(runs[-1, 3])
    while a0 > 0 and b0 > 0 and d[a0 - 1] == s[b0 - 1]:
        a0, b0 = a0 - 1, b0 - 1
    while a1 < len(d) and b1 < len(s) and d[a1] == s[b1]:
        a1, b1 = a1 + 1, b1 + 1
    xs, ys = [], []  # columns of the alignment: places in d and s, -1 for a gap
    at, bt = a0, b0
    for k in range(len(runs)):
        end, far = (a1, b1) if k == len(runs) - 1 else (int(runs[k, 1]), int(runs[k, 3]))
        n = end - at
        xs.append(np.arange(at, end))
        ys.append(np.arange(bt, bt + n))
        at, bt = end, bt + n
        if k + 1 < len(runs):
            na, nb = int(runs[k + 1, 0]) - at, int(runs[k + 1, 2]) - bt
            m = min(na, nb)
            if m < 0:
                na, nb, m = max(na, 0), max(nb, 0), 0
            left = d[at : at + m] == s[bt : bt + m]
            right = d[at + na - m : at + na] == s[bt + nb - m : bt + nb]
            gain = np.concatenate([[0], np.cumsum(left)]) + np.concatenate([np.cumsum(right[::-1])[::-1], [0]])
            cut = int(gain.argmax())
            xs += [np.arange(at, at + cut), np.arange(at + cut, at + na - (m - cut)), np.full(nb - m, -1), np.arange(at + na - (m - cut), at + na)]
            ys += [np.arange(bt, bt + cut), np.full(na - m, -1), np.arange(bt + cut, bt + nb - (m - cut)), np.arange(bt + nb - (m - cut), bt + nb)]
            at, bt = at + na, bt + nb
    x, y = np.concatenate(xs), np.concatenate(ys)
    ok = (x >= 0) & (y >= 0) & (x < len(d)) & (y < len(s))
    same = np.zeros(len(x), bool)
    same[ok] = d[x[ok]] == s[y[ok]]
    out: list[tuple[int, int, int, int, float]] = []
    todo = [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST:
            continue
        total = np.concatenate([[0], np.cumsum(np.where(same[lo:hi], 1.0, -PENALTY))])
        drop = total - np.minimum.accumulate(total)
        stop = int(drop.argmax())
        if drop[stop] < LEAST * 0.5:
            continue
        start = stop - int(total[: stop + 1][::-1].argmin())
        i, j = lo + start, lo + stop
        px, py = x[i:j][x[i:j] >= 0], y[i:j][y[i:j] >= 0]
        n = min(len(px), len(py))
        share = float(same[i:j].sum() / (j - i))
        if n >= LEAST and share >= IDENTITY:
            out.append((int(px[0]), int(px[-1]) + 1, int(py[0]), int(py[-1]) + 1, round(share, 6)))
        todo += [(lo, i), (j, hi)]
    return sorted(out)


def _blocks(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, block, words) for the blocks of each text in wanted (doc_id, blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            h, first = words(batch.column(1))
            out = []
            for i, (key, blocks) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                mine = h[first[i] : first[i + 1]]
                out += [(key, b, mine[b * CUT : (b + 1) * CUT].tobytes()) for b in blocks if b * CUT < len(mine)]
            if out:
                yield _rows(out, "doc_id long, block long, words binary")

    return texts.join(wanted, "doc_id").select("doc_id", "text", "blocks").mapInArrow(run, "doc_id long, block long, words binary")


def _aligned(chains_: DataFrame, texts: DataFrame) -> DataFrame:
    n = F.size("runs")
    block = lambda c: F.floor(c / CUT).cast("long")
    sides = [
        chains_.select("doc_id", "source_id", "no", F.lit(0).alias("side"), F.col("doc_id").alias("of"), F.explode(F.sequence(block(F.greatest(F.lit(0), F.element_at("runs", 1) - MARGIN)), block(F.element_at("runs", n - 2) + MARGIN))).alias("block")),
        chains_.select("doc_id", "source_id", "no", F.lit(1).alias("side"), F.col("source_id").alias("of"), F.explode(F.sequence(block(F.greatest(F.lit(0), F.element_at("runs", 3) - MARGIN)), block(F.element_at("runs", n) + MARGIN))).alias("block")),
    ]
    needs = materialize(sides[0].union(sides[1]), "chain-blocks")
    wanted = materialize(needs.select("of", "block").distinct().groupBy(F.col("of").alias("doc_id")).agg(F.sort_array(F.collect_set("block")).alias("blocks")), "wanted-blocks")  # a text's own blocks
    # a table of its own, so that a block that many chains want is a skewed join that can be split
    held = materialize(_blocks(texts, wanted).withColumnRenamed("doc_id", "of").dropDuplicates(["of", "block"]), "held-blocks")
    pieces = needs.join(held, ["of", "block"]).select("doc_id", "source_id", "no", "side", "block", "words", F.lit(None).cast("array<long>").alias("runs"))
    heads = chains_.select("doc_id", "source_id", "no", F.lit(-1).alias("side"), F.lit(0).cast("long").alias("block"), F.lit(None).cast("binary").alias("words"), "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for t in grouped(batches, ["doc_id", "source_id", "no"]):
            side, blocks, parts = t["side"].to_pylist(), t["block"].to_pylist(), t["words"].to_pylist()
            got = [[(b, w) for k, b, w in zip(side, blocks, parts, strict=True) if k == s] for s in (0, 1)]
            if side[0] != -1 or not got[0] or not got[1]:
                continue
            runs = np.array(t["runs"][0].as_py(), np.int64).reshape(-1, 4)
            shift = [x[0][0] * CUT for x in got]
            d, s = (np.frombuffer(b"".join(w for _, w in x), np.uint64) for x in got)
            runs = dense_runs(d, s, runs - np.array([shift[0], shift[0], shift[1], shift[1]]))
            long_ = (r for r in (runs[chain] for chain in chains(runs)) if r[-1, 1] - r[0, 0] >= LEAST // 2)
            for a, b, c, e, share in (x for r in long_ for x in align(d, s, r)):
                out.append((t["doc_id"][0].as_py(), a + shift[0], b + shift[0], t["source_id"][0].as_py(), c + shift[1], e + shift[1], b - a, share))
            if len(out) >= 2000:
                yield _rows(out, PASSAGE)
                out = []
        if out:
            yield _rows(out, PASSAGE)

    parts_n = partitions(texts.sparkSession)
    return pieces.unionByName(heads).repartition(parts_n, "doc_id", "source_id", "no").sortWithinPartitions("doc_id", "source_id", "no", "side", "block").mapInArrow(run, PASSAGE)


def _printed(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            h, first = words(batch.column(1))
            p, q = _prints(h, first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.view(np.int64)), pa.array(q.view(np.int64)), pa.array(np.diff(first))], names=["doc_id", "p", "q", "n"])

    return texts.mapInArrow(run, "doc_id long, p long, q long, n long")


def _adding(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Of the passages rows, widest first, those that lie in no earlier one and in none of known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["doc_id"]):
            begin, end, source, old = (t[c].to_numpy(zero_copy_only=False) for c in ("start_word", "end_word", "source_id", "old"))
            order = np.lexsort((t["source_start"].to_numpy(), source, begin - end, ~old))
            begins, ends, keep = end[:0], end[:0], []
            for i in order.tolist():
                if old[i] or not ((begins <= begin[i]) & (ends >= end[i])).any():
                    begins, ends = np.append(begins, begin[i]), np.append(ends, end[i])
                    if not old[i]:
                        keep.append(i)
            if keep:
                yield from t.take(pa.array(keep)).select([f.split()[0] for f in PASSAGE.split(", ")]).combine_chunks().to_batches()

    both = rows.withColumn("old", F.lit(False)).unionByName(known.withColumn("old", F.lit(True)), allowMissingColumns=True)
    return _by_doc(both.select(*rows.columns, "old")).mapInArrow(run, PASSAGE)


def _known(found: DataFrame) -> DataFrame:
    """(doc_id, known): a text's own passages."""
    return found.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("known"))


def _lies_open(a: Column, b: Column) -> Column:
    """Whether no one passage of the column known holds the words a to b."""
    return ~F.exists(F.coalesce("known", F.array().cast("array<struct<start_word:bigint,end_word:bigint>>")), lambda x: (x["start_word"] <= a) & (x["end_word"] >= b))


def _longer(runs: DataFrame, n: int) -> DataFrame:
    """Links of runs of n words (h, doc_id, at, open) to their first holder, from the first place that is open."""
    at = F.coalesce(F.min(F.when(F.col("open"), F.col("at"))), F.min("at"))
    once = runs.groupBy("h", "doc_id").agg(at.alias("at"), F.lit(n - K + 1).alias("many"), F.bool_or("open").alias("open"))  # a run that its text repeats, once
    return _pairs(_linked(materialize(once, "passage-runs"), "passage-longer").filter("open"))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The passages of LEAST words or more that texts share with their first holders,
    and for each copy of a text of LEAST words or more the whole text."""
    texts = id_text(docs, id_col, text_col).filter("doc_id is not null")
    made = materialize(_printed(texts).distinct(), "passage-prints")
    reps = materialize(made.groupBy("p", "q").agg(F.min("doc_id").alias("source_id"), F.count("*").alias("m")).filter("m > 1"), "passage-reps")
    copies = materialize(made.join(reps, ["p", "q"]).filter("doc_id != source_id").select("doc_id", "source_id", "n"), "passage-copies")
    # ids with one text only; others are searched whatever their copies
    once = made.groupBy("doc_id").count().filter("count = 1").select("doc_id")
    gone = materialize(copies.select("doc_id").join(once, "doc_id", "left_semi"), "passage-gone")
    own = texts.join(gone, "doc_id", "left_anti")
    shared = _linked(materialize(_seeds(own), "passage-seeds"), "passage-shared")
    found = materialize(_widest(_chained(_pairs(shared))), "passage-chains")
    columns = ["doc_id", "source_id", "no", "runs"]
    begin, end = F.element_at("runs", 1), F.element_at("runs", F.size("runs") - 2)
    near = materialize(_aligned(found.filter("widest"), texts), "passage-near")
    known = _known(near)
    rest = found.filter("not widest").join(known, "doc_id", "left").filter(_lies_open(begin, end))
    longer = shared.filter("some is not null").join(known, "doc_id", "left").select(F.xxhash64("some", F.lit(SOME)).alias("h"), "doc_id", "at", _lies_open(F.col("at"), F.col("at") + SOME).alias("open"))
    more = _chained(_longer(longer, SOME))
    far = materialize(_aligned(materialize(rest.select(columns).union(more.withColumn("no", -1 - F.col("no")).select(columns)), "passage-chains"), texts), "passage-far")
    # what lies in no passage yet
    spans = near.union(far).select("doc_id", "start_word", "end_word")
    known = materialize(_known(spans), "passage-known")
    runs = shared.filter("some is not null").join(known, "doc_id", "left").select("some", "doc_id", "at", _lies_open(F.greatest(F.lit(0), F.col("at") - WINDOW + 1), F.col("at") + LEAST).alias("open"))
    runs = materialize(runs, "passage-runs")
    held = runs.groupBy("some").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("open").alias("open")).filter("open and a < b").select("some")
    wanted = materialize(runs.join(held, "some").groupBy("doc_id").agg(F.collect_set("at").alias("places")), "passage-places")  # a text's own places
    exact = _windows(own, wanted).join(known, "doc_id", "left").select("h", "doc_id", "at", _lies_open(F.col("at"), F.col("at") + LEAST).alias("open"))
    exact = _chained(_longer(exact, LEAST)).withColumn("no", -1 - F.col("no"))
    loose = materialize(_loose(shared, spans), "passage-loose")
    late = exact.select(columns).union(_chained(_scattered(loose)).select(columns)).join(known, "doc_id", "left").filter(_lies_open(begin, end)).select(columns)
    late = materialize(_widest(late), "passage-chains")
    third = materialize(_adding(_aligned(late.filter("widest"), texts), spans), "passage-third")
    rest = late.filter("not widest").join(_known(third), "doc_id", "left").filter(_lies_open(begin, end)).select(columns)
    last = _adding(_aligned(materialize(rest, "passage-chains"), texts), spans.union(third.select(spans.columns)))
    whole = copies.filter(F.col("n") >= LEAST).select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"), "source_id", F.lit(0).cast("long").alias("source_start"), F.col("n").alias("source_end"), F.col("n").alias("n_words"), F.lit(1.0).alias("similarity"))
    return near.union(far).union(third).union(last).union(whole).distinct()
