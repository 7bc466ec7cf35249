"""License scans by a positional rare-token index.

Templates (notices and names of public licences) are indexed by the rarest word of
their mandatory key phrases, rarity being the inverse document frequency counted over
all files. In a file that holds all words of a template's key phrases, each place of
that word where its phrase stands gives alignments of the template, SLACK words to
either side; an alignment holds if every key phrase stands where it puts it, give or
take SLACK words, and VOTES words of the template are in place. No alignment that
holds is left out, whatever other templates a file has.
A template that stands in a file is in the result with the share of its words that
are where they should be.

The base phrases are counted beside that, wherever their words stand consecutively.

Nulls: a null text is empty: no words, no labels, score 0. Files of any length are
read whole. Repeated rows give equal rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import id_text, slices, word_hash, words

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, wording, mandatory key phrases of the added templates.
TEMPLATES = [
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["redistribute it and or modify it", "gnu general public license"]),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", ["lesser general public license version 2 1"]),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ["lesser general public license version 3"]),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["affero general public license version 3"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["in compliance with the license", "apache org licenses"]),
    ("mit-name", "released under the mit license", ["under the mit license"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ["eclipse public license 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ["cc by nc sa 4 0"]),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", ["cc by nc nd 4 0"]),
    ("cc-by-name", "creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("proprietary", "all rights reserved no part of this publication may be reproduced", ["all rights reserved"]),
]
VOTES, SLACK = 2, 2
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<template:string,first_word:long,share:double>>"


def _hashes(phrase: str) -> np.ndarray:
    return np.array([word_hash(w.encode()) for w in phrase.split()], np.uint64)


@dataclass
class Index:
    templates: list[tuple[str, np.ndarray, list[tuple[int, np.ndarray]]]]
    vocabulary: np.ndarray  # sorted word hashes
    needs: np.ndarray  # by template and word: whether a key phrase has it
    anchors: list[list[tuple[int, int, int]]]  # by template: word, key phrase and place in it
    idf: np.ndarray
    base: list[tuple[str, np.ndarray]] = field(default_factory=list)


def build(templates: list[tuple[str, str, list[str]]] = TEMPLATES, base: dict[str, str] = BASE) -> Index:
    """The index, without document frequencies yet."""
    made = []
    for label, wording, keys in templates:
        h = _hashes(wording)
        places = []
        for key in keys:
            k = _hashes(key)
            at = next(i for i in range(len(h) - len(k) + 1) if (h[i : i + len(k)] == k).all())
            places.append((at, k))
        made.append((label, h, places))
    vocabulary = np.unique(np.concatenate([h for _, h, _ in made]))
    anchors = [[(int(x), nth, j) for nth, (_, k) in enumerate(places) for j, x in enumerate(np.searchsorted(vocabulary, k))] for _, _, places in made]
    needs = np.zeros((len(made), len(vocabulary)), bool)
    for t, words_ in enumerate(anchors):
        needs[t, [x for x, _, _ in words_]] = True
    return Index(made, vocabulary, needs, anchors, np.ones(len(vocabulary)), [(label, _hashes(p)) for p, label in base.items()])


def _known(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Place in the vocabulary of each word, or -1."""
    slot = np.zeros(1 << 16, bool)
    slot[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = np.full(len(h), -1, np.int32)
    maybe = np.flatnonzero(slot[(h & np.uint64(0xFFFF)).astype(np.int64)])
    where = np.minimum(np.searchsorted(vocabulary, h[maybe]), len(vocabulary) - 1)
    ok = vocabulary[where] == h[maybe]
    out[maybe[ok]] = where[ok]
    return out


def _stands(h: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the phrase's words stand consecutively."""
    if len(h) < len(phrase):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(h[: len(h) - len(phrase) + 1] == phrase[0])
    for i in range(1, len(phrase)):
        at = at[h[at + i] == phrase[i]]
    return at


def scan_text(h: np.ndarray, known: np.ndarray, index: Index) -> list[tuple[str, int, float]]:
    """(template, first word, share of its words in place) of each template found."""
    places = np.flatnonzero(known >= 0)
    present = np.zeros(len(index.vocabulary), bool)
    present[known[places]] = True
    out = []
    for t in np.flatnonzero(~(index.needs & ~present).any(1)).tolist():
        label, wording, keys = index.templates[t]
        rare, nth, j = min(index.anchors[t], key=lambda x: -index.idf[x[0]])
        at, key = keys[nth]
        start = places[known[places] == rare] - j
        start = start[(start >= 0) & (start + len(key) <= len(h))]
        for k in range(len(key)):
            start = start[h[start + k] == key[k]]
        offset = np.unique(start[:, None] - at + np.arange(-SLACK, SLACK + 1))
        for at, key in keys:
            stands = _stands(h, key)
            next_ = np.append(stands, len(h) + len(wording) + SLACK)[np.searchsorted(stands, offset + at - SLACK)]
            offset = offset[next_ <= offset + at + SLACK]
        n = np.zeros(len(offset), np.int64)
        for q, x in enumerate(wording):
            place = offset + q
            inside = (place >= 0) & (place < len(h))
            n[inside] += h[place[inside]] == x
        if len(n) and n.max() >= VOTES:
            best = int(n.argmax())
            out.append((label, max(0, int(offset[best])), float(n[best] / len(wording))))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Index | None = None) -> Index:
    """The index with document frequencies of its words counted over all texts."""
    index = index or build()
    texts = id_text(docs, id_col, text_col)
    vocabulary = index.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in (s for b in batches for s in slices(b)):
            h, first = words(batch.column(1))
            known = _known(h, vocabulary)
            at = np.flatnonzero(known >= 0)
            doc = np.searchsorted(first, at, "right") - 1
            pairs = np.unique(doc * len(vocabulary) + known[at])
            held += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(held)), -1], pa.int32()), pa.array([*held.tolist(), n], pa.int64())], names=["term", "n"])

    got = {r.term: r.n for r in texts.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each word of the templates
    df = np.array([got.get(i, 0) for i in range(len(vocabulary))], float)
    index.idf = np.log1p(got.get(-1, 0) / np.maximum(df, 1))
    return index


def scan(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA for every row. score: the best share of a template; 1 where a base phrase stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("template", pa.string()), ("first_word", pa.int64()), ("share", pa.float64())]))
        for batch in (s for b in batches for s in slices(b)):
            h, first = words(batch.column(1))
            n = batch.num_rows
            found: list[list[tuple[str, int]]] = [[] for _ in range(n)]
            for label, phrase in index.base:
                at = _stands(h, phrase)
                doc = np.searchsorted(first, at, "right") - 1
                for p, d in zip(at.tolist(), doc.tolist(), strict=True):
                    if p + len(phrase) <= first[d + 1]:
                        found[d].append((label, p - int(first[d])))
            known = _known(h, index.vocabulary)
            # a text with fewer than VOTES licence words can hold no template
            has = np.concatenate([[0], np.cumsum(known >= 0)])
            rows: list[list] = []
            for d in range(n):
                a, b = first[d], first[d + 1]
                more = scan_text(h[a:b], known[a:b], index) if has[b] - has[a] >= VOTES else []
                places = [p for _, p in found[d]]
                base = sorted({x for x, _ in found[d]})
                labels = sorted({*base, *(x for x, _, _ in more)})
                score = 1.0 if places else max((s for _, _, s in more), default=0.0)
                rows.append([int(b - a), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(labels), score, [{"template": x, "first_word": p, "share": s} for x, p, s in sorted(more)]])
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), kind]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
