"""Jaccard join, passages and decontamination against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridsmith.llm import decontam, jaccard, substrings
from gridsmith.llm.common import components


def tokens(t):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())


def shingles(w):
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute_classes(rows):
    reps, cls = {}, {}
    for i, t in rows:
        cls[i] = reps.setdefault(tuple(tokens(t)), i)
    ids = [i for k, i in reps.items() if k]
    sets = {i: shingles(k) for k, i in reps.items() if k}
    root, links = {i: i for i in reps.values()}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(c), links[c]) for i, c in cls.items()}


def family(seed=5, copies=30):
    """Near copies of one text at all distances about the threshold, among others."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 5000)}" for _ in range(200)]
    out = []
    for i in range(copies):
        w = list(base)
        for _ in range(r.randint(0, 8)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 10**9)}"
        out.append((i, " ".join(w)))
    return out + [(1000 + i, " ".join(f"w{r.randint(0, 5000)}" for _ in range(60))) for i in range(40)]


def test_classes_equal_brute_force(spark, docs):
    rows = sorted([(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, t) for i, t in family()])
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    want = {i: v if tokens(dict(rows)[i]) else (i, 0) for i, v in want.items()}
    assert got == want


def test_blocks_of_a_large_group(spark, monkeypatch):
    """A group of several blocks gives the same links as one block."""
    rows = family(9, 60)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_blocks_of_long_texts(spark, monkeypatch):
    """Blocks bounded in bytes give the same links."""
    rows = family(9, 30)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 2000)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_components_of_a_large_star(spark):
    """One centre, a chain and a ring; the components are those of a search."""
    edges = [(1, i) for i in range(2, 400)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), "test-star").collect())
    assert got == {i: 1 for i in range(1, 400)} | {i: 1000 for i in range(1000, 1041)} | {i: 2000 for i in range(2000, 2007)}


def test_verified_by_matrix():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(12)]
    i, j = np.triu_indices(12, 1)
    ok = jaccard.verified(sets, i, j, 0.5)
    assert ok.tolist() == [len(set(sets[a]) & set(sets[b])) >= 0.5 * len(set(sets[a]) | set(sets[b])) for a, b in zip(i, j, strict=True)]


def test_posterior_bounds():
    least = jaccard.least_matches()
    assert all(0 <= m <= (k + 1) * jaccard.STEP for k, m in enumerate(least))
    assert least == tuple(sorted(least)) and least[-1] < 0.8 * jaccard.HASHES


def test_odd_rows(odd, nothing):
    rows = {r.doc_id: r for r in jaccard.classes(odd).collect()}
    assert rows[2].class_id == 1 and rows[1].n_copies >= 2
    assert (rows[3].class_id, rows[4].class_id, rows[5].class_id) == (3, 4, 5), "texts without words are in no group"
    assert rows[None].class_id is None
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.select("doc_id").collect()) == [-1, -1, 1, 3, 4, 5, 6, 7]
    assert jaccard.classes(nothing).count() == 0


def test_passages(spark, odd, nothing):
    r = random.Random(2)
    word = lambda: f"v{r.randint(0, 10**7)}"
    passage = [word() for _ in range(70)]
    fuzzy = list(passage)
    fuzzy[30] = "changed"
    rows = [(i, " ".join([word() for _ in range(40)] + p + [word() for _ in range(30)])) for i, p in enumerate([passage, passage, fuzzy, passage[:45], [word() for _ in range(70)]])]
    rows.append((9, rows[0][1]))
    got = {(x.doc_id, x.source_id): x for x in substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, 0), (2, 0), (9, 0)}
    assert (got[1, 0].start_word, got[1, 0].end_word, got[1, 0].source_start, got[1, 0].similarity) == (40, 110, 40, 1.0)
    assert (got[2, 0].start_word, got[2, 0].end_word) == (40, 110) and 0.9 < got[2, 0].similarity < 1
    assert got[9, 0].n_words == len(tokens(rows[0][1]))
    assert substrings.passages(odd).count() == 0 and substrings.passages(nothing).count() == 0


def test_passages_whose_parts_stand_elsewhere(spark):
    """Pairs of texts share passages whose parts stand in texts before and between them; one
    part stands in another place of its text too."""
    r = random.Random(6)
    word = lambda: f"v{r.randint(0, 10**7)}"
    some = lambda n: [word() for _ in range(n)]
    rows, want = [], []
    for case in range(60):
        n = [60, 57, 80][case % 3]
        p, at = some(n), 100 * case
        parts = [[p[: n // 2 + 4], p[n // 2 - 2 :]], [p[k : k + 20] for k in range(0, n, 12)], [p[:48], p[-48:]]][case // 3 % 3]
        rows += [(at + k, some(30) + x + some(30)) for k, x in enumerate(parts)]
        rows.append((at + 20, some(20) + parts[0][:8] + some(20) + p + some(25)))
        rows += [(at + 30 + k, some(20) + x + some(10)) for k, x in enumerate(parts)]
        rows.append((at + 50, some(35) + p + some(15)))
        want.append((at + 50, at + 20, 35, 35 + n))
    got = substrings.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.source_id, x.start_word, x.end_word) for x in got) == want


def scattered(n, changed, part, copies, cases, seed):
    """(rows, pairs): pairs of texts with n words in common but for the changed ones, whose first and
    last words, part of them, stand in texts before and between them, copies of each."""
    r = random.Random(seed)
    word = lambda: f"v{r.randint(0, 10**7)}"
    some = lambda n: [word() for _ in range(n)]
    rows, pairs = [], []
    for case in range(cases):
        p, at = some(n), 1000 * case
        other = list(p)
        for k in r.sample(range(4, n - 4), changed):
            other[k] = word()
        for k in range(copies):
            rows += [(at + 2 * k + m + shift, some(30) + x + some(30)) for m, x in enumerate((p[:part], p[-part:])) for shift in (0, 400)]
        rows += [(at + 300, some(20) + p + some(25)), (at + 700, some(35) + other + some(15))]
        pairs.append((at + 700, at + 300, 35, 35 + n))
    return [(i, " ".join(w)) for i, w in rows], pairs


def test_inexact_passages_whose_parts_stand_elsewhere(spark):
    """Parts in few texts or in many; exact passages of 50 to 56 words whose first 43 and more stand elsewhere."""
    for n, changed, part, copies, least in ((60, 3, 34, 1, 0.9), (80, 5, 44, 1, 0.9), (54, 0, 48, 1, 1), (50, 0, 46, 1, 1), (56, 0, 49, 9, 1), (80, 5, 44, 30, 0.9)):
        rows, pairs = scattered(n, changed, part, copies, 40 if copies == 1 else 10, n + copies)
        found = {}
        for x in substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
            found.setdefault((x.doc_id, x.source_id), []).append((x.start_word, x.end_word))
        got = sum(any(a < end - 40 and b > start + 40 for a, b in found.get((i, j), ())) for i, j, start, end in pairs)
        assert got >= least * len(pairs), (n, changed, part, copies, got)
        if not changed:
            assert found == {(i, j): [(start, end)] for i, j, start, end in pairs}


def test_links_of_crowded_seeds_grow_as_the_texts(spark):
    """Two seeds that a hundred texts hold, each among others: a link a text and seed, not one a pair."""
    rows = [(h, i, at, 1, 1000 * i + h, True, True, True) for i in range(100) for h, at in ((1, 0), (2, 20))]
    got = sorted(map(tuple, substrings._scattered(spark.createDataFrame(rows, substrings.LOOSE)).collect()))
    assert got == sorted((i, 0, at, at, 1) for i in range(1, 100) for at in (0, 20))


def test_source_does_not_depend_on_partitions(spark):
    """Holders of one passage dealt over many ranges or few: the same links."""
    r = random.Random(4)
    word = lambda: f"v{r.randint(0, 10**7)}"
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)])) for i in range(80)] + [(100 + i, " ".join(word() for _ in range(90))) for i in range(5)]
    rows += [(200, " ".join(passage + ["mid"] * 70 + passage))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in ("1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(tuple, substrings.passages(df).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
    assert {(x[0], x[3]) for x in seen[0] if x[0] < 100} >= {(i, 0) for i in range(1, 80)}
    assert {x[1] for x in seen[0] if x[0] == 200 and x[3] == 0} == {0, 130}, "both places"


def test_passages_cover_repeated_windows(docs):
    """Every 50 words that stand in an earlier text too, by brute force, lie in a passage."""
    n = substrings.LEAST
    rows = sorted((r.doc_id, tokens(r.text)) for r in docs.collect())
    first, want = {}, set()
    for i, w in rows:
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if len(set(g)) > n // 2 and first.setdefault(g, i) != i:
                want.add((i, k))
    spans = collections.defaultdict(list)
    for x in substrings.passages(docs).collect():
        spans[x.doc_id].append((x.start_word, x.end_word))
    assert want and all(any(a <= k and k + n <= b for a, b in spans[i]) for i, k in want)


def test_chains_take_the_best_order():
    runs = np.array([[0, 20, 0, 20], [25, 45, 27, 47], [30, 35, 5, 10], [60, 90, 62, 92]])
    assert substrings.chains(runs)[0] == [0, 1, 3]
    runs = np.array([[0, 1000, 0, 1000], [1080, 1090, 1080, 1090], [1095, 1130, 1096, 1131]])
    assert sorted(substrings.chains(runs)) == [[0], [1, 2]], "the best before is out of reach, a nearer one is not"


def test_fenwick_equals_brute_force():
    r = random.Random(3)
    tree, put = substrings.Fenwick(20), []
    for time in range(400):
        i, score = r.randint(1, 20), round(r.uniform(0, 50), 3)
        tree.put(i, score, time, time)
        put.append((i, score, time))
        low = r.randint(1, 20)
        high, since = r.randint(low - 1, 20), time - 25
        want = max(((s, t) for i, s, t in put if low <= i <= high and t >= since), default=(-1e18, -1))
        assert tree.best(low, high, since) == want


def test_decontamination_equals_brute_force(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, tokens(r.text)) for r in bench.collect()]
    want = set()
    for r in docs.collect():
        w = tokens(r.text)
        for i, t in items:
            if any(w[k : k + len(t)] == t for k in range(len(w) - len(t) + 1)):
                want.add((r.doc_id, i))
    got = decontam.matches(docs, bench).collect()
    assert want and want <= {(r.doc_id, r.item_id) for r in got}
    assert all(r.similarity >= 0.8 for r in got)
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {r.doc_id for r in docs.collect()} - {r.doc_id for r in got}


def test_near_and_short_items(spark, odd, nothing):
    words = [f"k{i}" for i in range(60)]
    near = list(words)
    near[30] = "changed"
    docs = spark.createDataFrame([(1, "before " + " ".join(near) + " after"), (2, " ".join(words[::-1])), (3, "so alpha beta it is")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words), 1), (7, " ".join(words), 1), (8, "alpha beta", 2), (9, None, 3), (None, "", 4)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id, r.first_word) for r in decontam.matches(docs, bench).collect()}
    assert got == {(1, 7, 1), (3, 8, 1)}
    assert decontam.matches(nothing, bench).count() == 0 and decontam.matches(docs, bench.limit(0)).count() == 0
    assert decontam.clean(odd, bench).count() == odd.count()


def test_items_cut_at_either_end(spark):
    """A text that is an item less its last or first words is a window as a whole."""
    words = [f"k{i}" for i in range(55)]
    docs = spark.createDataFrame([(1, " ".join(words[:50])), (2, " ".join(words[5:])), (3, " ".join(words[:30])), (4, " ".join(words[:4])), (5, " ".join(words[:5]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.first_word, r.n_words) for r in decontam.matches(docs, bench).collect()} == {(1, 7, 0, 50), (2, 7, 0, 50)}
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {3, 4, 5}


def test_blocks_find_all_within_radius():
    rng = np.random.default_rng(1)
    for size in (20, 300):
        prints = rng.integers(0, 1 << 63, size).astype(np.uint64)
        asked = np.array([p ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 13), replace=False))) for p in prints[:20]])
        pairs = np.array([(i, j) for i in range(20) for j in range(size)])
        x, y, passed = decontam.pairs_within(asked, pairs[:, 0], prints, pairs[:, 1], 12)
        want = {(i, j) for i, j in pairs.tolist() if bin(int(asked[i]) ^ int(prints[j])).count("1") <= 12}
        assert set(zip(x.tolist(), y.tolist(), strict=True)) == want and len(want) <= passed < 0.3 * len(pairs)


def test_window_prints_count_distinct_shingles():
    rng = np.random.default_rng(2)
    for n, k, kinds in ((40, 7, 5), (60, 1, 3), (50, 50, 9), (80, 20, 1000)):
        grams = rng.integers(0, kinds, n).astype(np.uint64)
        want = [decontam._sign_bits(decontam._bits(np.unique(grams[i : i + k])).sum(0)) for i in range(n - k + 1)]
        assert decontam.window_prints(grams, k).tolist() == [int(x) for x in want]


def test_copies_of_items_with_refrains_are_found(spark):
    """Verbatim copies of items that repeat a few words many times, between other words."""
    r = random.Random(4)
    word = lambda: f"c{r.randint(0, 10**6)}"
    items = []
    for fresh, size, times in ((30, 3, 12), (60, 3, 40), (60, 5, 40), (40, 1, 80), (80, 1, 120), (20, 2, 20), (60, 2, 60), (100, 4, 50)):
        for _ in range(25):
            items.append([word() for _ in range(fresh)] + [word() for _ in range(size)] * times)
    rows = [(i, [word() for _ in range(r.randint(0, 40))] + t + [word() for _ in range(r.randint(0, 40))]) for i, t in enumerate(items)]
    texts = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontam.matches(texts, bench).collect()}
    assert got == {(i, i): 1.0 for i in range(len(items))}


def test_items_that_share_no_shingle_are_not_compared(monkeypatch):
    """5,000 items of one length: a text is compared with those that its shingles name."""
    r = random.Random(6)
    texts = [" ".join(f"d{r.randint(0, 10**6)}" for _ in range(50)) for _ in range(5_000)]
    items = decontam._finish(decontam._items(list(range(len(texts))), texts), {}, 1)
    asked = []
    monkeypatch.setattr(decontam, "pairs_within", lambda p, w, q, i, f=decontam.pairs_within: (asked.append(set(i.tolist())), f(p, w, q, i))[1])
    h, first = decontam.words(pa.array(["other words " * 30 + texts[17] + " more " + texts[4_000]]))
    ((_, grams, at, number),) = decontam._text_hits(h, first, items)
    assert {m[0] for m in decontam._matches(h, grams, at, number, items, 0.8)} == {17, 4_000}
    assert set().union(*asked) == {17, 4_000}


def test_unit_columns(spark):
    m = spark.createDataFrame([(i, 1 if i < 3 else 2) for i in range(4)], "doc_id long, comp long")
    sized = spark.createDataFrame([(1, 3, 24), (2, 1, 8)], "comp long, m long, bytes long").filter("m > 1")
    assert {r.comp for r in jaccard._units(m, sized).select("comp").distinct().collect()} == {1}
    assert jaccard._units(m, sized).filter(F.col("x") != F.col("y")).count() == 0


def test_weighted_similarity_equals_brute_force(spark, docs, monkeypatch):
    """Items and texts with changed words: the best window's similarity by definition, and the
    same in several blocks of items."""
    r = random.Random(12)
    word = lambda: f"b{r.randint(0, 10**6)}"
    items = [(i, [word() for _ in range(r.choice([30, 30, 41]))]) for i in range(12)]
    rows = []
    for i in range(90):
        w = list(items[i % 12][1])
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = word()
        rows.append((i, [word() for _ in range(r.randint(0, 30))] + w + [word() for _ in range(r.randint(0, 9))]))
    held = collections.Counter(g for _, w in rows for g in shingles(w))
    weight = lambda g: np.log1p(len(rows) / max(held[g], 1))
    want = {}
    for d, w in rows:
        for i, t in items:
            own, best = shingles(t), 0.0
            total, mean = sum(map(weight, own)), sum(map(weight, own)) / len(own)
            for k in range(len(w) - len(t) + 1):
                mine = shingles(w[k : k + len(t)])
                best = max(best, sum(weight(g) for g in own & mine) / (total + mean * len(mine - own)))
            if best >= 0.8:
                want[d, i] = round(best, 5)
    texts = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    got = {(x.doc_id, x.item_id): round(x.similarity, 5) for x in decontam.matches(texts, bench).collect()}
    assert want and got == want
    monkeypatch.setattr(decontam, "ITEMS", 5)
    assert {(x.doc_id, x.item_id): round(x.similarity, 5) for x in decontam.matches(texts, bench).collect()} == want
