"""Quality, toxicity, licences, languages, personal data."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from gridsmith.llm import langid, licenses, pii, quality, toxicity

SF = "/root/testdata/sf0.01"


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_counts_equal_brute_force(docs, odd, nothing):
    texts = [r.text for r in docs.collect()] + ["a a a a a a a", "", "x\n\nx\ny\nx", "  　", "é " * 9, "a\x00b c\x0bd"]
    got = quality.count_texts(pa.array(texts))
    assert [tuple(int(got[c][i]) for c in quality.COUNTS[:5]) for i in range(len(texts))] == [brute_counts(t) for t in texts]
    rows = quality.judge(odd, []).collect()
    assert len(rows) == odd.count() and all(r.base_failed and not r.kept for r in rows if r.doc_id in (3, 4, 5, 6))
    assert quality.judge(nothing, []).count() == 0
    assert quality.keep(odd, []).columns == odd.columns


def test_rules_learn(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rules = quality.fit(docs, labels)
    assert rules
    rows = quality.judge(docs, rules).join(labels, "doc_id").collect()
    kept = [r for r in rows if r.kept]
    assert sum(r.quality for r in kept) / len(kept) > 0.97, "what is kept is good"
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) / len(clean) > 0.97, "clean texts stay"
    assert {r.doc_id for r in quality.keep(docs, rules).collect()} == {r.doc_id for r in quality.judge(docs, rules).filter("kept").collect()}
    assert quality.fit(docs, labels.limit(0)) == []


def test_rules_are_covered_in_order():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.FEATURES)))
    bad = (x[:, 1] > 0.8) & (x[:, 3] < 0.5)
    rules = quality.learn(x, bad)
    hit = np.zeros(600, bool)
    for r in rules:
        hit |= quality._covers(r, x)
    assert (hit == bad).mean() > 0.95 and all(len(r) <= 4 for r in rules)


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.15, (400, 30))
    idf = rng.random(30) + 0.5
    m = toxicity.index([f"t{i}" for i in range(30)], idf, np.arange(400), rng.integers(0, 2, 400).astype(float), counts)
    v = toxicity._unit(counts, idf)
    for q in rng.poisson(0.2, (40, 30)):
        which = np.flatnonzero(q)
        if len(which):
            w = toxicity._unit(q[which].astype(float), idf[which])
            at, cos = toxicity.nearest(m, which, w)
            exact = np.round(v[:, which] @ w, 12)
            want = sorted((-s, i) for i, s in enumerate(exact) if s > 0)[: toxicity.NEIGHBOURS]
            assert m.ids[at].tolist() == [i for _, i in want] and np.allclose(cos, [-s for s, _ in want])


def test_every_associated_term_is_kept():
    """More associated terms than any fixed number, and none that both classes hold."""
    many = [" ".join(f"{w}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)) for w in ("t", "c") for _ in range(20)] + ["plain"] * 200
    kept = toxicity.choose_terms(many, np.array([True] * 20 + [False] * 220))
    assert len(kept) == 300 and all(w.startswith("t") for w in kept)


def test_toxicity_held_out(spark, odd, nothing):
    from gridsmith.llm.queries import op3_nearest_toxicity

    rows = op3_nearest_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    out = toxicity.fit_score(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.fit_score(nothing, labels).count() == 0


def test_licenses_equal_brute_force(spark, odd, nothing):
    base = licenses.BASE
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index = licenses.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in licenses.scan(docs, index).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id]))
        hits = sorted((i, x) for p, x in base.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    rows = licenses.scan(odd, licenses.fit(odd)).collect()
    assert len(rows) == odd.count() and {r.score for r in rows if r.doc_id == 4} == {0.0}
    assert licenses.scan(nothing, licenses.fit(nothing)).count() == 0


def test_license_templates(spark):
    texts = ["Some code. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "Licensed under CC BY-SA 4.0.", "free of charge, mit Software", "This work is licensed under the GNU General Public License, version 3."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df, licenses.fit(df)).collect()}
    assert got == {0: "mit-text", 1: "cc-by,cc-by-sa-4.0", 2: "", 3: "gpl,gpl-3.0"}


def test_files_of_several_licenses(spark):
    """Every template's notice is found beside all others, also in a long file."""
    bsd3 = next(w for label, w, _ in licenses.TEMPLATES if label == "bsd-3-clause")
    every = [w for _, w, _ in licenses.TEMPLATES]
    texts = ["Released under the MIT License. Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", f"{bsd3}. Released under the MIT License.", ". ".join(every), " and the software is of any person. ".join(["other words " * 2000, *every, "more " * 2000]), "all rights reserved " * 20_000]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    df = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    index = licenses.fit(docs.union(df))
    got = {r.doc_id: {m.template: m.share for m in r.matches} for r in licenses.scan(df, index).collect()}
    assert set(got[-1]) == {"mit-name", "apache-2.0", "cc-by-nc-4.0"} and set(got[-2]) == {"bsd-3-clause", "mit-name"}
    assert set(got[-3]) == set(got[-4]) == {label for label, _, _ in licenses.TEMPLATES} and min(got[-3].values()) == min(got[-4].values()) == 1
    assert set(got[-5]) == {"proprietary"}


def test_languages(spark, odd, nothing):
    from gridsmith.llm.queries import op6_byte_gru

    rows = op6_byte_gru(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    net = langid.train([b"the and of this", b"der die und das", b"the of and", b"und der das"], ["en", "de", "en", "de"], steps=40)
    got = {r.doc_id: r for r in langid.predict(odd, net).collect()}
    assert (got[3].lang_pred, got[3].score, got[4].lang_pred, got[5].lang_pred) == ("und", 0.0, "und", "und")
    assert got[7].lang_pred in ("en", "de") and langid.predict(nothing, net).count() == 0
    assert langid.fit(nothing) is None and {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


def test_gradients_through_time():
    net = langid.train([b"abcd", b"dcba"], ["x", "y"], steps=1)
    seq = np.frombuffer(b"abcdcbda", np.uint8).reshape(4, 2)
    for d in (0, 1):
        assert np.allclose(langid.states(net, d, seq), langid._forward(net, d, seq)[0], atol=1e-6)
        grad = np.random.default_rng(0).normal(size=(4, 2, langid.HIDDEN)).astype(np.float32)
        gu = langid._backward(net, d, seq, langid._forward(net, d, seq)[1], grad)[1]
        for i, j in ((0, 0), (3, 10), (7, 20)):
            loss = []
            for e in (1e-2, -1e-2):
                net.u[d][i, j] += e
                loss.append((langid._forward(net, d, seq)[0].astype(float) * grad).sum())
                net.u[d][i, j] -= e
            assert abs((loss[0] - loss[1]) / 2e-2 - gu[i, j]) < 1e-2 + 0.02 * abs(gu[i, j])


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (kind, rx) in enumerate(PATTERNS.items()):
        for m in re.finditer(rx, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0
            if {"ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn, "phone": lambda: 10 <= len(digits) <= 15}.get(kind, lambda: True)():  # noqa: B023
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark)


def test_personal_data_equals_brute_force(spark, model):
    odd_texts = ["a@b.c%d@e.f x@y@z.w a..b@c-.d 1.2.3.4.5.6.7.8 +1 (23) 4567-890. 4111 1111-1111 1111 99 300.1.1.1 000255.1.2.3 é😀 +49.30.1234567 +1+12345678901", "", "4111111111111111 " * 50 + "é" * 10 + " x@y.z", "a@" * 3000, "1." * 5000, "+1 " * 3000, "x@" + ".y" * 20000 + " p@q" + ".r" * 9000, "ÀÉa@b.co 😀+1 555 123 4567"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd_texts)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find(docs, model).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in PATTERNS]
        assert set(want) <= set(filter(None, r.spans.split(","))) | {""}


def test_long_runs_need_one_pass(spark, model):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["9" * 100_000, "a" * 100_000, "4" + " 4" * 50_000, "A1" * 50_000])], "doc_id long, text string")
    assert pii.find(df, model).count() == 4


def test_method_adds_spans(spark, model):
    texts = ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "call (555) 123-4567 now", "ssn 123-45-6789", "Kleinkraftwerksbetreibergesellschaft im Dorf", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    assert got == {0: 'token = "[SECRET]"', 1: "call [PHONE] now", 2: "ssn [ID]", 3: texts[3], 4: None}


def test_secrets_after_a_sign_and_before_a_full_stop(spark, model):
    texts = ["secret=abcdef0123456789abcd1", "API_KEY=ghp_a1B2c3D4e5F6g7H8i9J0k1L2 set", "token is ghp_a1B2c3D4e5F6g7H8i9J0k1L2. Then", "the token is ghp_a1B2c3D4e5F6g7H8i9J0k1L2.", "see a1b2c3d4e5f6g7h8i9j0.example.org"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    assert got == {0: "secret=[SECRET]", 1: "API_KEY=[SECRET] set", 2: "token is [SECRET]. Then", 3: "the token is [SECRET].", 4: texts[4]}


def test_odd_rows(odd, nothing, model):
    assert pii.find(odd, model).count() == odd.count() and pii.find(nothing, model).count() == 0
    out = pii.redact(odd, model)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert {r._t for r in out.collect()} == {None}, "columns of the operator's own names stay as they were"


def test_find_is_native(odd, model):
    plan = pii.find(odd.select("doc_id", "text"), model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_many_spans_of_one_text(spark, model):
    """Spans of several parts of PART: placed and redacted as in one."""
    lines = [f"{i:03d}-12-{i:04d} a{i}@b.org 10.0.{i % 256}.1" for i in range(700)]
    text = "ß " + "; ".join(lines)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.find(df, model).first()
    assert (got.n_email, got.n_ip) == (700, 700) and got.base_sha256 == hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest()
    out, at = [], 0
    for s in got.spans.split(","):
        kind, a, b = s.split(":")
        out += [text[at : int(a)], f"[{kind.upper()}]"]
        at = int(b)
    assert pii.redact(df, model).first().text == "".join(out) + text[at:]


def test_marks_are_no_letters(spark):
    """Numbers and signs that are no letters by Unicode: nothing to tell a language by."""
    df = spark.createDataFrame([(1, "² ½ ①"), (2, "Ⅷ 12 ☃"), (3, "ß"), (4, "語")], "doc_id long, text string")
    net = langid.fit(spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate([("the cat sat", "en"), ("die katze saß", "de")] * 5)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, net).collect()}
    assert (got[1], got[2]) == ("und", "und") and "und" not in (got[3], got[4])


def test_keep_and_redact_of_nothing(odd, nothing, model):
    assert quality.keep(nothing, []).count() == 0 and quality.keep(nothing, []).columns == nothing.columns
    assert pii.redact(nothing, model).count() == 0
    kept = quality.keep(odd, [])
    assert kept.schema == odd.schema and sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in quality.judge(odd, []).filter("kept").collect())


def test_rows_that_repeat_an_id_count_once_in_the_fit(spark, monkeypatch):
    """However many rows bear an id, the fit gathers the windows of one of them for each label."""
    seen = []
    monkeypatch.setattr(langid, "train", lambda windows, names: seen.append((windows, names)))
    rows = [(1, f"text number {i:05d} of one id " * 20, "en") for i in range(400)] + [(2, "ein Text " * 50, "de"), (1, "texte " * 50, "fr")]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(seen[0][0]) <= 3 * langid.WINDOWS and set(seen[0][1]) == {"en", "de", "fr"}
