"""BPE against the rank coder; shards; word hashes."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gridsmith.llm import bpe, common, sharding

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_words_equal_regex():
    r = random.Random(1)
    texts = ["".join(r.choice("ab é.Z\n\t09\x00") for _ in range(r.randint(0, 60))) for _ in range(300)] + ["", None, "x" * (common.CHUNK + 5), "é " * common.CHUNK]
    for kind, rx in ((common.ALNUM, rb"[0-9a-z\x80-\xff]+"), (common.NON_SPACE, rb"[^\x20\x09-\x0d]+")):
        h, first = common.words(pa.array(texts), kind)
        for i, t in enumerate(texts):
            data = (t or "").encode()
            found = re.findall(rx, data.lower() if kind is common.ALNUM else data)
            assert len(found) == first[i + 1] - first[i]
            if kind is common.ALNUM and len(found) < 99:
                assert [common.word_hash(w) for w in found] == h[first[i] : first[i + 1]].tolist()


def test_encode_equals_rank_coder(ranks):
    c = bpe.coder(PATH, P.PATTERN)
    texts = ["", " ", "it's IT'S 12345", "größe 日本語 🎉👨‍👩‍👧", "<|endoftext|>", "a\u0085b 　c\x1c\x1d  \n\n  x\t", "x" * 5000, "\x00�\U0001e030"]
    for t in texts:
        ids = c.encode([t])[0]
        assert ids.tolist() == ranks.encode_ordinary(t)
        assert c.decode(ids) == t
        start, end = c.char_offsets(ids, t.encode())
        assert all(0 <= a < b <= len(t) for a, b in zip(start, end, strict=True))
    ids = c.encode(["日"])[0]
    start, end = c.char_offsets(ids, "日".encode())
    assert set(start) == {0} and set(end) == {1}, "tokens inside a character have that character"
    assert c.decode(ids[:1]) in ("�", "日")


def test_round_trip_has_offsets(odd):
    both = bpe.encode(odd, PATH, P.PATTERN).collect(), bpe.round_trip(odd, PATH, P.PATTERN).collect()
    want = sorted(hashlib.sha256(np.array(r.token_starts + r.token_ends, "<u4").tobytes()).hexdigest() for r in both[0])
    assert sorted(r.offsets_sha256 for r in both[1]) == want and len(set(want)) > 2


def test_round_trip(docs, odd, nothing, ranks):
    got = {r.doc_id: r for r in bpe.round_trip(docs, PATH, P.PATTERN).collect()}
    for r in docs.collect():
        ids = ranks.encode_ordinary(r.text)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(r.text.encode()))
    rows = bpe.round_trip(odd, PATH, P.PATTERN).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
    assert bpe.round_trip(nothing, PATH, P.PATTERN).count() == 0
    coded = bpe.encode(odd, PATH, P.PATTERN)
    assert all(len(r.ids) == len(r.token_starts) == r.n_tokens for r in coded.collect())
    assert {r.text for r in bpe.decode(coded, PATH, P.PATTERN).collect()} == {r.text or "" for r in odd.collect()}


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(docs, shards):
    import zlib

    rows = sorted(sharding.assign(docs, shards).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    total, upto = sum(r.size for r in rows), 0
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.shard == min(shards - 1, (2 * upto + r.size) * shards // (2 * total)), "contiguous, cut at equal targets"
        upto += r.size
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shards_of_odd_rows(odd, nothing):
    rows = sharding.assign(odd, 4).collect()
    assert len(rows) == odd.count() and sharding.assign(nothing, 4).count() == 0
    assert {r.size for r in rows if r.doc_id == 3} == {1}
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_written_shards_hold_every_row(spark, odd, tmp_path):
    sharding.write(odd, f"{tmp_path}/out", 3)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(got.columns) == sorted([*odd.columns, "_shard"])
    key = lambda r: (r.doc_id or -1, r.text or "", r.lang or "")
    assert sorted(map(key, got.collect())) == sorted(map(key, odd.collect()))
    want = {(r.shard, r["count"]) for r in sharding.assign(odd, 3).groupBy("shard").count().collect()}
    assert {(r["_shard"], r["count"]) for r in got.groupBy("_shard").count().collect()} == want
