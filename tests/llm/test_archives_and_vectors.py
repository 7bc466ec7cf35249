"""WARC bundles, hard negatives and vector codes against brute force."""

import base64
import hashlib
import io
import struct

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from gridsmith.llm import codes, negatives, queries, warc

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, sha1 int, size int, first int, payload int, bundle int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 5) for r in rows], PAGES)


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.fixture(scope="module")
def odd_pages(spark):
    long = "größe 😀 " * 400_000
    return [(1, "http://a/x y\r\nWARC-Type: bad", "<p>one\r\n\r\nWARC/1.1\r\n"), (2, None, "same"), (3, "u", "same"), (0, "u", "same"), (None, "u", "same"), (4, "", None), (5, "u", ""), (5, "v", ""), (4, "w", ""), (7, "é", long), (None, None, "alone"), (None, "x", "alone")]


def expected(rows, least=0):
    first = {}
    for p, _, t in rows:
        b = (t or "").encode()
        first.setdefault(b, []).append(p)
    out = []
    for p, _, t in rows:
        b = (t or "").encode()
        low = min((x for x in first[b] if x is not None), default=None)
        again = len(b) >= least and low is not None and p != low
        out.append((p, len(b), sha(b), "revisit" if again else "response", low if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 3, 5])
def test_round_trip_of_odd_pages(spark, odd_pages, tmp_path, least):
    index = warc.write(pages(spark, odd_pages).repartition(3), str(tmp_path), least, frame_bytes=2000, bundle_bytes=3000)
    got = warc.read(index, split=1000).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(odd_pages, least)
    texts = {(t or "").encode() for _, _, t in odd_pages}
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == texts and all(r.payload is None for r in got if r.record_type == "revisit")
    assert index.count() == len(odd_pages) and index.select("bundle").distinct().count() >= 3
    # one by one, through the index alone
    wanted = index.filter("page_id = 7 or page_id = 3").select("record_id")
    assert {(r.page_id, r.record_type) for r in warc.lookup(index, wanted).collect()} == {(7, "response"), (3, "revisit" if least < 5 else "response")}


def test_bundles_are_plain_zstandard(spark, odd_pages, tmp_path):
    """Any reader gets the records end to end; the last frame is skippable and lists the others."""
    index = warc.write(pages(spark, odd_pages).coalesce(1), str(tmp_path), frame_bytes=500)
    (path,) = {r.bundle for r in index.collect()}
    data = open(path, "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    kinds = [f["warc-type"] for f, _ in warc.records(whole)]
    assert kinds[0] == "warcinfo" and len(kinds) == len(odd_pages) + 1
    count = struct.unpack("<I", data[-9:-5])[0]
    assert data[-(count * 8 + 17) :][:4] == struct.pack("<I", 0x184D2A5E) and data[-4:] == struct.pack("<I", 0x8F92EAB1)
    with pa.OSFile(path) as f:
        frames = warc.seek_table(f)
        assert len(frames) == count > 3 and sum(n for _, _, n in frames) == len(whole)
        for r in index.collect():
            part = warc.frame(f, r.frame_offset, r.frame_bytes)[r.offset : r.offset + r.bytes]
            ((fields, _),) = warc.records(part)
            assert fields["warc-record-id"] == r.record_id and fields["warc-type"] == r.record_type
            assert "\r" not in fields["warc-target-uri"] and fields["warc-target-uri"]


def test_damage_is_an_error(spark, tmp_path):
    index = warc.write(pages(spark, [(1, "u", "text of a page")]), str(tmp_path))
    (row,) = index.collect()
    fields, block = next(warc.records(warc.page_record(1, "u", b"text", sha(b"text"), False, None, "d")))
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(fields, block.replace(b"text", b"tent", 2))
    with open(row.bundle, "r+b") as f:
        f.truncate(40)
    with pa.OSFile(row.bundle) as f, pytest.raises(ValueError, match="seek table"):
        warc.seek_table(f)


def test_no_pages(spark):
    assert warc.archive(spark, pages(spark, [])).count() == 0


# ------------------------------------------------------------------ negatives

VECTORS = "vec_id long, embedding array<float>, label int, q int, cell int, block int, anchor int, score int"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    floats = lambda v: v and [x if x is None else float(x) for x in v]
    return spark.createDataFrame([(i, floats(v), k, *[None] * 5) for i, v, k in rows], VECTORS)


def mined(rows, step, positives=5, negatives=5):
    """By definition, in whole numbers of Python."""
    own = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], k) for i, v, k in rows if i is not None and k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a[1], b[1]))  # noqa: E731, B905
    out = []
    for a in own:
        if a[0] % step:
            continue
        best = sorted((-score(a, b), b[0]) for b in own if b[2] == a[2] and b[0] != a[0])[:positives]
        for s, p in best:
            inside = sorted((-score(a, b), b[0]) for b in own if b[2] != a[2] and 80 * -s <= 100 * score(a, b) <= 100 * -s)[:negatives]
            out += [(a[0], p, r + 1, n, -s, -t) for r, (t, n) in enumerate(inside)]
    return sorted(out)


def run(df, step, **more):
    got = negatives.mine(df, F.col("vec_id") % step == 0, F.col("label"), **more)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


def vectors(n, dims, labels, seed=3):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(labels, dims))
    return [(i, [float(x) for x in (centres[i % labels] + g.normal(size=dims)).astype(np.float32)], int(g.integers(labels))) for i in range(n)]


def test_mining_equals_brute_force(spark, monkeypatch):
    rows = vectors(400, 6, 4)
    rows += [(1000 + i, rows[7][1], i % 2) for i in range(150)]  # ties, and a very frequent vector
    rows += [(2000, None, 1), (2001, [1.0, None, 0, 0, 0, 0], 1), (2002, [NAN, 0, 0, 0, 0, 0], 1), (2003, [INF] * 6, 1), (2004, [1.0] * 6, None), (None, [1.0] * 6, 1), (2005, [1.0, 2.0], 1), (2006, [], 0), (20, rows[3][1], 2), (20, rows[20][1], rows[20][2])]
    want = mined(rows, 10)
    assert len(want) > 400
    assert run(table(spark, rows).repartition(3), 10) == want
    monkeypatch.setattr(negatives, "LOOK", 2)
    monkeypatch.setattr(negatives, "_rows", lambda most, size: 64)  # blocks of 64 rows, so frequent vectors have several
    assert run(table(spark, rows), 10) == want
    assert run(table(spark, rows), 10, cells=1) == want


def test_far_clusters_are_not_visited(spark, monkeypatch):
    """Well separated clusters: most lists are ruled out, and the results are whole."""
    g = np.random.default_rng(5)
    centres = np.eye(8) * 20
    rows = [(i, [float(x) for x in centres[i % 8] + g.normal(size=8) * 0.1], i // 8 % 2) for i in range(800)]
    monkeypatch.setattr(negatives, "LOOK", 1)
    made = []
    monkeypatch.setattr(negatives, "_search", lambda lists, visits, k, same, f=negatives._search: (made.append((visits.select("anchor", "cell").distinct().count(), len(lists.bounds.count))), f(lists, visits, k, same))[1])
    assert run(table(spark, rows), 50) == mined(rows, 50)
    anchors = len([r for r in rows if r[0] % 50 == 0])
    assert len(made) == 4 and sum(n for n, _ in made[:2]) < 0.5 * anchors * made[0][1]


def test_bounds_hold(spark):
    lists = negatives.index(table(spark, vectors(300, 5, 3)), F.col("label"))
    rows = lists.rows.collect()
    q = np.array([r.q for r in rows], np.int64)
    low, high = lists.bounds.of(q[:40])
    scores, cell = q[:40] @ q.T, np.array([r.cell for r in rows])
    assert (scores >= low[:, cell]).all() and (scores <= high[:, cell]).all()
    assert [int((cell == c).sum()) for c in range(len(lists.bounds.count))] == lists.bounds.count.tolist()


def test_scores_beyond_floats_and_beyond_longs(spark):
    rows = [(i, [float(2.0**21 + i), float(i * i)], i % 2) for i in range(0, 60, 5)]
    assert run(table(spark, rows), 10) == mined(rows, 10)
    big = [(i, [float(2.0**22) * (1 + i / 8), 3.0], i % 2) for i in range(6)]  # whole numbers past 2^53 as sums
    assert run(table(spark, big), 3) == mined(big, 3)
    with pytest.raises(ArithmeticError):
        run(table(spark, [(0, [1e12], 1)]), 1)


def test_no_vectors(spark):
    assert run(table(spark, []), 1) == [] and run(table(spark, [(0, [1.0], 1)]), 1) == []
    assert codes.compress(table(spark, [])).count() == 0 and codes.compress(table(spark, [(1, None, 1)])).count() == 0


# ------------------------------------------------------------------ codes


def coded(rows, parts=8, entries=16, rounds=6, scale=4096):
    own = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = -(-max(len(v) for _, v, _ in own) // parts) * parts
    own = sorted(((i, v + [0] * (size - len(v)), k) for i, v, k in own), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = size // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in own[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            to = {}
            for _, v, _ in own:
                to.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*to[n], strict=True)] if n in to else e for n, e in enumerate(books[p])]
    out = []
    for i, v, k in own:
        got = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, [n for _, n in got], sum(d for d, _ in got), k))
    by = {}
    for _, _, d, k in out:
        by[k] = by.get(k, 0) + d
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, d, by[k], digest) for i, c, d, k in out), key=repr)


def compressed(df):
    return sorted(((r.vec_id, r.codes, r.error, r.label_error, r.books) for r in codes.compress(df).collect()), key=repr)


@pytest.mark.parametrize("n,dims", [(150, 16), (9, 8), (40, 11), (60, 3)])
def test_codes_equal_brute_force(spark, monkeypatch, n, dims):
    rows = vectors(n, dims, 4, seed=dims)
    rows += [(1000 + i, rows[2][1], None) for i in range(30)] + [(2000, None, 1), (2001, [None] * dims, 1), (2002, [NAN] * dims, 1), (2003, [-INF] * dims, 1), (None, rows[1][1], 3), (5, rows[0][1], 1), (5, rows[0][1], 1), (3000, [0.5], 2), (3001, [], 2)]
    want = coded(rows)
    assert compressed(table(spark, rows).repartition(3)) == want
    monkeypatch.setattr(codes, "LABELS", 1)  # label sums by a plain join
    monkeypatch.setattr(codes, "ROWS", 7)
    assert compressed(table(spark, rows)) == want


def test_partial_distances_equal_whole_ones():
    g = np.random.default_rng(8)
    for size in (1, 2, 8):
        x, book = g.integers(-5, 5, (500, size)), g.integers(-5, 5, (16, size))
        whole = np.square(x[:, None] - book[None]).sum(2)
        entry, d = codes.nearest(x, book)
        assert (entry == whole.argmin(1)).all() and (d == whole.min(1)).all()
    assert codes.order(np.array([[0, 9, 1], [0, -9, 2]])).tolist() == [1, 2, 0]


def test_codes_decode(spark):
    rows = vectors(200, 8, 3)
    known, size = codes.vectors(table(spark, rows))
    books = codes.fit(known, size)
    back = {r.vec_id: r for r in codes.decode(codes.encode(known, size, books), books).collect()}
    for i, v, _ in rows:
        q = np.floor(4096 * np.array(v, np.float32).astype(float))
        assert ((q - np.array(back[i].vector) * 4096) ** 2).sum() == pytest.approx(back[i].error)
    with pytest.raises(ArithmeticError):
        codes.compress(table(spark, [(1, [1e9], 1)]))


@pytest.mark.parametrize("name", ["op11_seekable_warc", "op12_hard_negatives", "op13_vector_codes"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
