"""Linked vectors by graph search against all pairs."""

import numpy as np

from tidewater.llm import vecgraph as V


def brute(rows, least=0.93):
    """Per row ``(vec_id, links, component, kept)`` by all pairs."""
    n, unit = len(rows), []
    for _, v, label in rows:
        a = None if not v or any(x is None for x in v) else np.asarray(v, dtype=np.float64)
        ok = label is not None and a is not None and np.isfinite(a).all() and a.any()
        unit.append(a / np.sqrt((a * a).sum()) if ok else None)
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            u, v = unit[i], unit[j]
            if u is not None and v is not None and len(u) == len(v) and rows[i][2] == rows[j][2] and u @ v >= least:
                near[i].append(j)
                near[j].append(i)
    comp = [None] * n
    for i in range(n):
        if comp[i] is None:
            todo, seen = [i], {i}
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            for j in seen:
                comp[j] = (min(ids) if ids else None,)
    return [(r[0], len(near[i]), comp[i][0], r[0] is not None and r[0] == comp[i][0]) for i, r in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, b"x", 5) for r in rows], "vec_id long, embedding array<float>, label int, vec binary, n int").repartition(3)


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def check(spark, rows):
    got = sorted(map(tuple, V.near_duplicates(frame(spark, rows)).collect()), key=key)
    assert got == sorted(brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]), key=key)


def planted(r, n, dim=64, groups=12, size=20, spread=0.02, labels=2):
    """Random vectors with groups of near copies, and exact ones."""
    x = r.normal(size=(n, dim))
    for g in range(groups):
        base = r.normal(size=dim)
        for k in r.integers(0, n, size):
            x[k] = base + spread * np.sqrt(dim) / 8 * r.normal(size=dim)
    x[n - 9:] = x[0]
    return [(i, v.astype(np.float32).tolist(), int(i % labels)) for i, v in enumerate(x)]


def test_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.94, 0.3], 1), (4, [0.9, 0.6], 1), (5, [1.0, 0.0], 2), (6, [1.0, 0.0], None), (7, None, 1),
            (8, [0.0, 0.0], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [None, 1.0], 1), (12, [], 1), (13, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.1], 1), (14, [-1.0, 0.0], 1),
            (None, [5.0, 5.0], 7), (None, [5.0, 5.0], 7), (15, [1e-30, 0.0], 1), (16, [-0.0, 3.0], 3), (17, [0.0, 3.0], 3)]
    check(spark, rows)
    check(spark, [])
    check(spark, [(3, [1.0], 0)])


def test_groups_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL", 12)
    rows = planted(np.random.default_rng(2), 500)
    check(spark, rows)


def test_recall_where_few_cells_are_visited(spark, monkeypatch):
    """A class visits 3 of about 100 cells; nearly all links are still found."""
    monkeypatch.setattr(V, "CELL", 24)
    rows = planted(np.random.default_rng(4), 2500, groups=150, size=8, spread=0.15, labels=1)
    got = {r.vec_id: tuple(r) for r in V.near_duplicates(frame(spark, rows)).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    s = x @ x.T >= 0.93
    true = s.sum(1) - 1
    found = np.array([got[i][1] for i in range(len(rows))])
    assert (found <= true).all() and true.sum() > 4000 and found.sum() >= 0.97 * true.sum()


def test_dense_group_beyond_a_shard():
    """A shard's search finds a dense group whole, and a far start still arrives."""
    r = np.random.default_rng(6)
    x = np.r_[r.normal(size=(300, 16)), r.normal(size=16) * 3 + 0.2 * r.normal(size=(400, 16))]
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    lists = V.prune(x)
    edges = np.full((len(x), max(map(len, lists))), -1)
    for i, o in enumerate(lists):
        edges[i, :len(o)] = o
    q = x[[350, 5, 699]]
    a, b = V.search_chunk(q, x, edges, [np.array([0])] * 3, 0.93, 24)
    want = np.nonzero(q @ x.T >= 0.93)
    assert len(a) >= 0.99 * len(want[0]) and set(zip(a, b)) <= set(zip(*want))
    assert set(zip(*(x.tolist() for x in V.forest(np.array([5, 1, 9]), np.array([1, 7, 8]))))) == {(5, 1), (7, 1), (9, 8)}


def test_audit_widens_a_poor_search(spark, monkeypatch):
    rows = planted(np.random.default_rng(8), 300, groups=6, size=10)
    monkeypatch.setattr(V, "CELL", 10)
    tries = []
    real = V.audit
    monkeypatch.setattr(V, "audit", lambda *a, **k: (tries.append(1), real(*a, **k) if len(tries) > 1 else (100, 10))[1])
    check(spark, rows)
    assert len(tries) == 2
