"""Companies by parts of their names, and bands of coordinates, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from gridsmith.operators import joins, names


def normal(s):
    s = s.lower().strip()
    for a, b in names.SAME:
        s = s.replace(a, b)
    return s.strip()


def made(n, seed):
    r = random.Random(seed)
    words = ["stadt", "werke", "netz", "nord", "süd", "energie", "ag", "e", "GmbH & Co. KG", "gmbh&co.kg", "Strom-Netz", "Gas", "an", "netze", "x.y", "&"]
    return [" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(n)]


def test_normalized(spark):
    rows = ["  Stadtwerke A-B GmbH & Co. KG ", "X & Y, Z.", "a  b", "A   B", "", "GMBH&CO.KG", None]
    got = [r.n for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", names.normalized(F.col("x")).alias("n")).orderBy("i").collect()]
    assert got == [x if x is None else normal(x) for x in rows]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_parts(spark, monkeypatch, hot):
    monkeypatch.setattr(names, "HOT", hot)
    a = [*made(60, 1), "", "e", "ag", "zzz", "😀", "netz"] + made(5, 2)
    b = [*made(80, 2), "", "a😀b", "e", "stadt werke ag"]
    df = lambda x, c: spark.createDataFrame([(v,) for v in [*x, x[0], None]], f"{c} string")
    pairs = names.parts(df(a, "p"), df(b, "w"), "p", "w")
    got = sorted((r.p, r.w) for r in pairs.collect())
    assert got == sorted({(x, y) for x in a for y in b if x and x in y}) and len(got) > 100
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def loop_first(name, known):
    a, index = normal(name), {}
    for k, n in known:
        index.setdefault(normal(n), k)
    if a in index:
        return index[a], "exact"
    for n, k in index.items():
        if a in n or n in a:
            return k, "part"
    words = [w for w in a.split() if len(w) > 3][:3]
    if words:
        for n, k in index.items():
            if all(any(w in x or x in w for x in n.split()) for w in words):
                return k, "words"
    return None


@pytest.mark.parametrize("extra", [[], [""]])
def test_first_named(spark, extra):
    known = list(enumerate(made(40, 3) + ["Netzgesellschaft Ost", "Ostwind Energieverbund"] + extra))
    asked = list(enumerate(made(120, 4) + ["", "Energie Ostwind", "Verbund Wind Energie", "unbekannt gmbh", "ost", None, "Gesellschaft Netzgesell Osten"]))
    got = names.first_named(spark.createDataFrame(asked, "a int, n string"), spark.createDataFrame(known, "k int, m string"), "a", "n", "k", "m")
    want = {(i, *f) for i, n in asked if n is not None and (f := loop_first(n, known))}
    assert {(r.a, r.k, r.how) for r in got.collect()} == want and {w[2] for w in want} == ({"exact", "part"} if extra else {"exact", "part", "words"})
    assert names.first_named(spark.createDataFrame([], "a int, n string"), spark.createDataFrame(known, "k int, m string"), "a", "n", "k", "m").count() == 0
    assert names.first_named(spark.createDataFrame(asked, "a int, n string"), spark.createDataFrame([], "k int, m string"), "a", "n", "k", "m").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner\n") <= 2, "only joins with a one-row side lack a key"


def test_first_in_zip(spark):
    r = random.Random(5)
    known = [(k, r.choice(["1", "2", None]), n) for k, n in enumerate([*made(50, 6), ""])]
    asked = [(i, r.choice(["1", "2", "3", None]), n) for i, n in enumerate([*made(80, 7), "", None])]
    got = names.first_in_zip(spark.createDataFrame(asked, "a int, z string, n string"), spark.createDataFrame(known, "k int, y string, m string"), "a", "z", "n", "k", "y", "m")
    want = {}
    for i, z, n in asked:
        hits = [k for k, y, m in known if z and n is not None and y == z and (normal(n) in normal(m) or normal(m) in normal(n))]
        if hits:
            want[i] = min(hits)
    assert {x.a: x.k for x in got.collect()} == want and want


@pytest.mark.parametrize("hot", [5_000, 7])
def test_band_of_crowded_cells(spark, hot):
    """Most rows in one place, on cells' edges, at negative coordinates, without coordinates."""
    r = random.Random(8)
    some = lambda n: [(r.choice([0.0, 2.0, -2.0, 0.5, r.uniform(-5, 5)]), r.choice([0.0, -0.5, 2.0, r.uniform(-5, 5)])) for _ in range(n)]
    a = [(i, x, y) for i, (x, y) in enumerate([*some(150), *[(1.0, 1.0)] * 120, (None, 1.0), (float("nan"), 1.0)])]
    b = [(i, x, y) for i, (x, y) in enumerate([*some(150), *[(1.2, 0.9)] * 40, (1.0, None)])]
    left, right = spark.createDataFrame(a, "a int, x double, y double"), spark.createDataFrame(b, "b int, u double, v double")
    pairs = joins.band(left, right, "x", "y", "u", "v", 0.5, hot=hot)
    ok = lambda *v: None not in v and abs(v[0] - v[2]) < 0.5 and abs(v[1] - v[3]) < 0.5
    want = sorted((i, j) for i, x, y in a for j, u, v in b if ok(x, y, u, v))
    assert sorted((p.a, p.b) for p in pairs.collect()) == want
    first = joins.band(left, right, "x", "y", "u", "v", 0.5, [F.col("b")], "a", hot=hot)
    assert {(p.a, p.b) for p in first.collect()} == {(i, min(j for k, j in want if k == i)) for i in {k for k, _ in want}}


def test_a_crowded_cell_is_dealt_to_tasks(spark):
    left = spark.range(4000).select(F.col("id").alias("a"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    right = spark.range(3).select(F.col("id").alias("b"), F.lit(1.0).alias("u"), F.lit(1.0).alias("v"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        parts = joins.band(left, right, "x", "y", "u", "v", 0.5, hot=100).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in parts) == 12_000 and len(parts) == 4 and max(r["count"] for r in parts) < 6_000
