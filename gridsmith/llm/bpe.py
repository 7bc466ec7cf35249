"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file is turned into the library's vocabulary and merges: each token of more
than one byte is split by running the merges of lower rank on it, and the two parts
that remain are its merge.  Bytes are mapped to printable characters for the
library and back through the same table.  A piece that is a token as a whole takes
its own id at once, as the rank coder does.  The pattern cuts texts into pieces,
and each distinct piece is encoded once and then looked up: a store of at most
CACHE pieces, emptied when full, so that its size does not grow with the data.

Token ids come from the library; where each token lies in the text follows from
the tokens' byte lengths, and the character places from counting the bytes that
begin a character, so that a token that ends within a character is given the
character it splits.  Decoding joins the tokens' bytes by the reverse table, which
puts split characters together again.

Nulls: a null text is empty. Empty texts have no ids and decode to an empty text.
Special tokens' strings in a text are ordinary text. A text of any length is one
call; batches are cut by bytes so that memory is bounded by the longest text.
Repeated rows are each encoded. Extra columns are not read; results hold id_col
and their own columns only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridsmith.llm.common import id_text, slices

#: Distinct pieces that a worker remembers, and characters that they may have together.
CACHE, CACHE_CHARS = 300_000, 16 << 20
SCHEMA = "doc_id long, n_tokens long, ids array<int>, token_starts array<int>, token_ends array<int>"


@lru_cache(maxsize=1)
def byte_chars() -> list[str]:
    """A printable character for each byte: itself where that is printable, else
    the next free one from 256 on. This is the published byte-level alphabet."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes this one."""
    parts, top = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], top), i) for i in range(len(parts) - 1))
        if rank >= top:
            raise ValueError(f"no merges lead to {token!r}")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


class Coder:
    """A tokenizer of one rank file and its reverse table."""

    def __init__(self, path: str, pattern: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        chars = byte_chars()
        show = lambda token: "".join(chars[b] for b in token)
        merges = [merge_of(t, ranks) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
        model = models.BPE({show(t): i for t, i in ranks.items()}, [(show(a), show(b)) for a, b in merges], ignore_merges=True, cache_capacity=50_000)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.known_chars = 0
        size = max(ranks.values()) + 1
        self.bytes_of = [b""] * size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.lengths = np.array([len(x) for x in self.bytes_of], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            pieces = self.cut(text)
            if fresh := list(set(pieces).difference(self.known)):
                if len(self.known) + len(fresh) > CACHE or self.known_chars > CACHE_CHARS:
                    self.known, self.known_chars = {}, 0
                    fresh = list(set(pieces))
                self.known_chars += sum(map(len, fresh))
                for piece, e in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
                    self.known[piece] = np.array(e.ids, "<u4").tobytes()
            out.append(np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), "<u4"))
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes that form no character become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def char_offsets(self, ids: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token; one inside a character has that character."""
        ends = np.cumsum(self.lengths[ids])
        begin = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        upto = np.concatenate([[0], np.cumsum(begin)])  # characters begun before each byte
        starts = ends - self.lengths[ids]
        inside = np.concatenate([~begin, [False]])
        return upto[starts] - inside[starts], upto[ends]


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids and each token's first and end character (null without offsets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in (s for b in batches for s in slices(b)):
            texts = batch.column(1).to_pylist()
            ids = c.encode(texts)
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = lambda parts: pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32)))  # noqa: B023, E731
            if offsets:
                places = [c.char_offsets(i, t.encode()) for i, t in zip(ids, texts, strict=True)]
                at = [flat([p[0] for p in places]), flat([p[1] for p in places])]
            else:
                at = [pa.nulls(len(ids), pa.list_(pa.int32()))] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), flat(ids), *at], names=["doc_id", "n_tokens", "ids", "token_starts", "token_ends"])

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, the decoded bytes and text of each row's ids (null ids: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            out = [c.decode_bytes(np.array(x or [], np.uint32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in out], pa.string())], names=["doc_id", "decoded", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id long, decoded binary, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (32 bits each, little-endian), of the
    bytes they decode to and of the tokens' first characters, then their end characters
    (likewise): encoding and decoding in one pass, so that the ids themselves are not moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in (s for b in batches for s in slices(b)):
            texts = batch.column(1).to_pylist()
            ids = c.encode(texts)
            places = [np.concatenate(c.char_offsets(i, t.encode())) for i, t in zip(ids, texts, strict=True)]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(x.astype("<u4").tobytes()) for x in ids], pa.string()), pa.array([sha(c.decode_bytes(x)) for x in ids], pa.string()), pa.array([sha(x.astype("<u4").tobytes()) for x in places], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string")
