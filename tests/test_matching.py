"""Fuzzy names, lists of domains and stored facts against plain loops."""

import glob
import os
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from gridsmith.functions import urls
from gridsmith.operators import search
from gridsmith.operators.upserts import Facts


def test_ratios_equal_sequence_matching():
    r = random.Random(1)
    word = lambda n, abc: "".join(r.choice(abc) for _ in range(r.randint(0, n)))
    pairs = [(word(30, "ab"), word(30, "ab")) for _ in range(300)] + [(word(60, "abcdefg -"), word(40, "abcdefg -")) for _ in range(200)]
    pairs += [("", ""), ("a", ""), ("", "b"), ("same", "same"), ("ü😀x", "x😀ü"), ("stadtwerke", "stadt werke nord"), ("ab" * 90, "ba" * 90)]
    got = search.ratios(*zip(*pairs, strict=True))
    assert got.tolist() == pytest.approx([SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs])
    assert search.ratios([], []).tolist() == []


def grams(s):
    out = set()
    for w in "".join(ch if ch.isalnum() and ch in "abcdefghijklmnopqrstuvwxyz0123456789äöüß" else " " for ch in s.lower()).split():
        p = f"  {w} "
        out |= {p[i : i + 3] for i in range(len(p) - 2)}
    return out


def names(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(["stadtwerke", "netz", "nord", "ost", "energie", "ag", "eon", "sw"]) for _ in range(r.randint(1, 4))) + r.choice(["", "", " gmbh", "x", "7"]) for _ in range(n)]


@pytest.mark.parametrize("hot,least", [(2_000, 0.3), (3, 0.3), (3, 0.7)])
def test_candidates_equal_brute_force(spark, monkeypatch, hot, least):
    monkeypatch.setattr(search, "HOT", hot)
    a, b = list(enumerate(names(60, 1))), list(enumerate([*names(80, 2), "", "!!"]))
    got = search.candidates(spark.createDataFrame(a, "a int, n string"), spark.createDataFrame(b, "b int, m string"), "a", "n", "b", "m", least).collect()
    want = {}
    for i, x in a:
        for j, y in b:
            g, h = grams(x), grams(y)
            if g and h and len(g & h) / len(g | h) >= least - 1e-12:
                want[i, j] = len(g & h) / len(g | h)
    assert {(r.a, r.b): pytest.approx(r.sim) for r in got} == want and len(got) == len(want) > 50


def test_a_frequent_trigram_is_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(search, "HOT", 50)
    df = lambda k: spark.range(600).select(F.col("id").cast("int").alias(k), F.lit("netz").alias("n" + k))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        got = search.candidates(df("a"), df("b"), "a", "na", "b", "nb", 0.9)
        assert got.count() == 360_000
        assert "hashpartitioning(t#" in (plan := got._jdf.queryExecution().executedPlan().toString()) and any(" i#" in x and " j#" in x for x in plan.split("\n") if "hashpartitioning" in x)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_alike(spark):
    pairs = [
        ("Stadtwerke Musterstadt GmbH", "Stadtwerke Musterstadt AG", True), ("E.ON", "E.ON Energie Deutschland", True), ("E.ON Energie Deutschland", "E.ON", True), ("SWB", "SWO", False), ("EW", "EW Netze", False),
        ("Netze BW (2025)", "netze-bw", True), ("Netzgesellschaft Ostwürttemberg", "Netzgesellschaft Ostwuerttemberg", True), ("Stadtwerke Aachen", "Stadtwerke Bochum", False), ("", "x", False), ("ENERGIE e. V.", "Energie", True), ("Musterwerke", "Musterwerk", True), ("Muster", "Master", False),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert {r.i for r in search.alike(df, "a", "b").collect()} == {i for i, p in enumerate(pairs) if p[2]}


def test_domains_of_a_list(spark):
    hosts = ["a.de", "x.a.de", "xa.de", "A.DE", "b.a.de:8080", "de", "c.org", "", "u@a.de", "a.de.evil.com", None]
    rows = spark.createDataFrame([(i, h if h is None else f"https://{h}/p?a.de") for i, h in enumerate(hosts)], "i int, url string")
    listed = spark.createDataFrame([("A.de",), ("c.org",), ("c.org",), ("",), (None,), ("a.c.org",)], "d string")
    got = urls.in_list(rows, "url", listed, "d")
    assert sorted(r.i for r in got.collect()) == [0, 1, 3, 4, 6, 8] and got.columns == ["i", "url"]
    kept = rows.filter(urls.allowed(F.col("url"), ["a.de", "c.org", "a.c.org"])).collect()
    assert sorted(r.i for r in kept) == [0, 1, 3, 4, 6, 8]


# ------------------------------------------------------------------ stored facts


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "facts")
    old = spark.createDataFrame([(i, 2024 + i % 2, float(i), "verified" if i % 5 == 0 else "pending") for i in range(300)], "k int, year int, price double, verification_status string")
    facts = Facts(spark, path, ["k", "year"], ["price", "verification_status"], 16).create(old)
    before = files(path)
    new = spark.createDataFrame([(3, 2025, 1.0, "flagged", 1), (3, 2025, 2.0, "flagged", 2), (5, 2025, 9.0, "flagged", 1), (1000, 2025, 7.0, "pending", 1)], "k int, year int, price double, verification_status string, n int")
    done = {(r.k, r.price, r.verification_status): r.action for r in facts.upsert(new, F.col("n")).collect() if r.action != "kept"}
    assert done == {(3, 2.0, "flagged"): "updated", (5, 5.0, "verified"): "skipped", (1000, 7.0, "pending"): "inserted"}
    after = files(path)
    gone = {os.path.dirname(f) for f in before.keys() - after.keys()}
    assert 1 <= len(gone) <= 3 and all(after[f] == t for f, t in before.items() if os.path.dirname(f) not in gone) and len(before.keys() & after.keys()) >= 13
    want = {(r.k, r.year): (r.price, r.verification_status) for r in old.collect()} | {(3, 2025): (2.0, "flagged"), (1000, 2025): (7.0, "pending")}
    assert {(r.k, r.year): (r.price, r.verification_status) for r in facts.read().collect()} == want and facts.read().count() == 301
    facts.upsert(new, F.col("n"), force=True)
    assert facts.read().filter("k = 5").first().price == 9.0
    now = files(path)
    facts.upsert(new.limit(0))
    assert files(path) == now
    with pytest.raises(ValueError, match="buckets"):
        Facts(spark, path, ["k", "year"], ["price", "verification_status"], 8).read()
