"""Near-duplicate groups against all pairs by brute force."""

import random
import re

from tidewater.llm import neardup as N


def brute(docs, k, percent):
    sets = []
    for _, text in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(text or "", "utf-8").lower())
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(docs):
        c = low.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d is not None and d == c))
    return sorted(out, key=str)


def check(spark, docs, k=3, percent=85):
    d = spark.createDataFrame([(*x, 1, "s") for x in docs], "doc_id long, text string, node int, sig string")
    got = sorted(map(tuple, N.groups(d, k, percent).collect()), key=str)
    assert got == brute(docs, k, percent)
    return got


def test_driver_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    check(spark, rows)


def test_chains_of_edits(spark, monkeypatch):
    # small blocks: clusters are compared across many pairs of blocks
    monkeypatch.setattr(N, "BLOCK", 48)
    r = random.Random(4)
    docs, n = [], 0
    for g in range(2):
        base = [f"w{g}_{i}" for i in range(90)]
        for _ in range(45):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 4, 6])):
                w[r.randrange(len(w))] = f"x{r.randrange(10 ** 6)}"
            docs.append((n := n + 1, " ".join(w)))
            if r.random() < 0.3:
                base = w
    r.shuffle(docs)
    got = check(spark, docs)
    assert 2 < len({c for _, _, c, _ in got}) < len(docs)


def test_odd_inputs(spark):
    long = " ".join(f"t{i}" for i in range(60000))
    docs = [(1, None), (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (6, "one two"), (None, "One Two"),
            (8, long), (9, long + " end"), (7, long), (None, None), (12, "É one\u00a0two x y")]
    check(spark, docs)
    check(spark, docs, k=5, percent=80)
    check(spark, [])
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, kept string")
    kept = [r.doc_id for r in N.keep_one(d).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 1, 2, 3, 4, 6, 6, None, None, 7, 12]))
    assert N.keep_one(d).columns == d.columns


def test_rows_of_one_id_go_by_their_own_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (6, a), (6, b), (7, b + " end"), (None, c), (None, c), (None, c + " end"), (None, "alone"), (None, None), (None, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, th int")
    got = N.keep_one(docs)
    assert got.columns == docs.columns
    left = [tuple(r)[:2] for r in got.collect()]
    of_c = [x for x in left if x[1] in (c, c + " end")]
    assert len(of_c) == 1 and of_c[0][0] is None
    want = [(1, a), (6, b), (None, "alone"), (None, None), (None, None), (None, a)]
    assert sorted([x for x in left if x not in of_c], key=str) == sorted(want, key=str)


def test_posterior_bound_and_bands():
    least = N.least_matches(0.85)
    assert list(least) == [32, 64, 96, 128, 160] and all(a < b for a, b in zip(least.values(), list(least.values())[1:]))
    for t in (0.8, 0.85, 0.9):
        rows = N.band_rows(t)
        assert (1 - t ** rows) ** (N.BAND_HASHES // rows) <= N.BAND_MISS
