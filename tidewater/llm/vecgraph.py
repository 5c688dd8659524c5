"""Near-duplicate vectors by search in a robust-pruned flat graph.

1. Equal vectors of a group (label and length) are one class with a count; only
   classes go on, so copies are never paired.
2. Every ``CELL``-th class by hash is a centre, at least one a group.  A class
   belongs to the cells of its ``OVERLAP`` nearest centres; centres are found
   through a sparser level of centres, so that no class meets all of them.  A cell
   of more than ``SHARD`` classes is cut by hash: a class lies in one shard of
   each of its cells, and a search of a cell visits all its shards.
3. Each shard gets a graph: a class's candidates are its nearest others, pruned
   robustly (a candidate goes if a kept one is nearer to it by the factor
   ``ALPHA``), with reverse edges.  A class's lists of all its shards are united.
4. Range-expanding greedy search: every class is searched in its cells' shards,
   from the shard's medoid and its own place.  The beam of the ``EF`` best is expanded
   until nothing better comes; everything found within the range is expanded too,
   whatever its rank.  Where a class within the range also lies in cells not
   yet visited, the search goes on there in the next round, until no new cell is
   met: so a group that spans many cells is followed through all of them.
5. A found pair counts only if its cosine in double precision reaches the
   threshold.  A pair may be met in several cells; it is counted in the
   first.  Tasks write counts a class and a spanning forest of their links, never
   pairs, so a group of m classes makes m rows a shard and not m * m.
6. Audit: the ``AUDIT`` classes of the smallest hashes are compared with all
   classes of their groups; if less than ``RECALL`` of their links was found, beam
   and overlap are doubled and the search is repeated.

Defined results: vectors that are null, empty, zero or hold a null or a
non-finite component, and those of a null label, link with nothing; vectors
of different lengths never link; repeated rows are copies; a null vec_id never
names a component if another member has an id; extra columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import settle
from tidewater.llm.neardup import components, forest

CELL, SHARD, OVERLAP = 256, 1024, 3
NEAR, DEGREE, ALPHA = 48, 16, 1.2
EF, EXPAND, CHUNK = 24, 12, 256
AUDIT, RECALL = 64, 0.95
POINTS = 4096           # rows compared with the centres of a group in one task


def prepare(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(vec_id, grp, print, vec)`` of every row; the last three are null for
    vectors that link with nothing.  ``vec`` holds the components as they came."""
    kind = "float" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "double"
    some = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast(f"array<{kind}>").alias("v"))
    dtype = np.dtype(np.float32 if kind == "float" else np.float64)

    def run(batches):
        for b in batches:
            lists, out = b.column("v"), []
            for i, label in enumerate(b.column("label").to_pylist()):
                v = lists[i].values
                if label is None or v is None or not len(v) or v.null_count:
                    out.append((None, None, None))
                    continue
                a = v.to_numpy().astype(dtype) + dtype.type(0)      # -0.0 is 0.0
                ok = np.isfinite(a).all() and a.any()
                out.append((f"{len(a)}:{label}", hashlib.blake2b(a.tobytes(), digest_size=16).digest(), a.tobytes()) if ok else (None, None, None))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), *(pa.array(c, type=t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.binary())))],
                                             ["vec_id", "grp", "print", "vec"])

    return settle(some.mapInArrow(run, "vec_id bigint, grp string, print binary, vec binary"))


def units(vecs, dtype) -> np.ndarray:
    """Unit vectors in double precision."""
    vecs = list(vecs)
    x = np.frombuffer(b"".join(vecs), dtype=dtype).reshape(len(vecs), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def together(left: DataFrame, right: DataFrame, key: str, chunk: int):
    """Rows of both sides by key, the left ones in chunks: a grouping by
    ``(key, part)`` in which every chunk meets all right rows of its key."""
    parts = left.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("parts"))
    left = left.join(parts, key).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts")
    right = right.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    return left.groupBy(key, "part").cogroup(right.groupBy(key, "part"))


def nearest(points: DataFrame, centres: DataFrame, key: str, count: int, dtype) -> DataFrame:
    """``(node, centre, cosine)``: for each point the ``count`` nearest centres of its key."""
    def run(p, c):
        if not len(p) or not len(c):
            return pd.DataFrame({"node": [], "centre": [], "cosine": []}).astype({"node": "int64", "centre": "int64", "cosine": "float64"})
        s = units(p["vec"], dtype) @ units(c["vec"], dtype).T
        k = min(count, len(c))
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return pd.DataFrame({"node": np.repeat(p["node"].to_numpy(), k), "centre": c["node"].to_numpy()[best].ravel(),
                             "cosine": np.take_along_axis(s, best, 1).ravel()})

    return together(points.select(key, "node", "vec"), centres.select(key, "node", "vec"), key, POINTS).applyInPandas(run, "node bigint, centre bigint, cosine double")


def cells(classes: DataFrame, dtype, overlap: int) -> DataFrame:
    """``(node, cells)``: the cells of each class, the nearest first."""
    tag = F.xxhash64("print", F.lit("centre"))
    first = classes.groupBy("grp").agg(F.min(F.struct(tag.alias("t"), F.col("node")))["node"].alias("node"), F.count(F.lit(1)).alias("size"))
    firsts = first.select("node", F.lit(True).alias("first"))
    centres = settle(classes.join(firsts, "node", "left").filter(F.col("first") | (F.pmod(tag, F.lit(CELL)) == 0)).select("node", "grp", "print", "vec", "first"))
    # the sparser level: about the square root of a group's centres
    coarse = centres.join(first.select("grp", F.ceil(F.sqrt(F.col("size") / CELL)).cast("bigint").alias("every")), "grp")
    coarse = settle(coarse.filter(F.col("first") | (F.pmod(F.xxhash64("print", F.lit("coarse")), F.col("every")) == 0)).select("node", "grp", "vec"))
    home = nearest(centres, coarse, "grp", 1, dtype).select("node", F.col("centre").alias("over"))
    fine = settle(centres.join(home, "node").select("node", "over", "vec"))
    seen = settle(nearest(classes, coarse, "grp", 2, dtype).select("node", F.col("centre").alias("over")))
    points = classes.select("node", "vec").join(seen, "node")
    got = nearest(points, fine, "over", overlap, dtype)
    return settle(got.groupBy("node").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("cosine")).alias("far"), F.col("centre")))), 1, overlap)["centre"].alias("cells")))


def prune(x: np.ndarray) -> list[np.ndarray]:
    """Robustly pruned neighbours of each row, with reverse edges."""
    n = len(x)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    k = min(NEAR, n - 1)
    if k < 1:
        return [np.zeros(0, dtype=np.int64) for _ in range(n)]
    cand = np.argpartition(-s, k - 1, axis=1)[:, :k]
    cand = np.take_along_axis(cand, np.argsort(-np.take_along_axis(s, cand, 1), axis=1, kind="stable"), 1)
    far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(s, cand, 1)))
    alive, kept = np.ones(cand.shape, dtype=bool), np.zeros(cand.shape, dtype=bool)
    for r in range(k):
        take = alive[:, r] & (kept.sum(1) < DEGREE)
        kept[:, r] = take
        between = np.sqrt(np.maximum(0, 2 - 2 * s[cand[:, r][:, None], cand]))
        between[cand == cand[:, r][:, None]] = 0
        alive &= ~(take[:, None] & (ALPHA * between <= far))
    out = [set(cand[i, kept[i]].tolist()) for i in range(n)]
    for i in range(n):
        for j in cand[i, kept[i]].tolist():
            out[j].add(i)
    return [np.fromiter(sorted(o), dtype=np.int64, count=len(o)) for o in out]


def graph(members: DataFrame, dtype) -> DataFrame:
    """``(shard, cell, node, n, vec, cells, medoid, near)`` of every class in each
    of its shards; ``near`` unites its lists of all shards.  Written."""
    def run(t):
        x = units(t["vec"], dtype)
        node = t["node"].to_numpy()
        middle = int((x @ x.mean(0)).argmax())
        return pd.DataFrame({"shard": t["shard"], "node": node, "medoid": np.arange(len(t)) == middle, "near": [node[o] for o in prune(x)]})

    lists = settle(members.groupBy("shard").applyInPandas(run, "shard bigint, node bigint, medoid boolean, near array<bigint>"))
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return settle(members.join(lists.select("shard", "node", "medoid"), ["shard", "node"]).join(united, "node"))


def search_chunk(q: np.ndarray, x: np.ndarray, edges: np.ndarray, starts: list[np.ndarray], low: float, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(row of q, row of x)`` with a cosine of ``low`` or more that the
    search finds.  ``edges`` pads the neighbours of each x by -1."""
    m, n = len(q), len(x)
    sim, open_ = np.full((m, n), -2.0), np.zeros((m, n), dtype=bool)
    met = np.zeros((m, n), dtype=bool)

    def look(rows, ids):
        flat = np.unique(rows * n + ids)
        flat = flat[~met.ravel()[flat]]
        r, i = flat // n, flat % n
        met[r, i] = open_[r, i] = True
        sim[r, i] = np.einsum("ij,ij->i", q[r], x[i])

    look(np.repeat(np.arange(m), [len(s) for s in starts]), np.concatenate(starts))
    active = np.arange(m)
    while len(active):
        s = sim[active]
        kth = np.partition(s, n - ef, axis=1)[:, n - ef] if ef < n else np.full(len(active), -2.0)
        score = np.where(open_[active] & ((s >= low) | (s >= kth[:, None])), s, -3.0)
        e = min(EXPAND, n)
        pick = np.argpartition(-score, e - 1, axis=1)[:, :e]
        good = np.take_along_axis(score, pick, 1) > -3
        rows = np.repeat(active, good.sum(1))
        ids = pick[good]
        open_[rows, ids] = False
        near = edges[ids]
        ok = near >= 0
        look(np.repeat(rows, ok.sum(1)), near[ok])
        active = active[good.any(1)]
    return np.nonzero(sim >= low)


def visit(graphs: DataFrame, visits: DataFrame, low: float, ef: int, dtype) -> DataFrame:
    """Search of ``visits`` ``(shard, node, vec, seen, now, via)`` in their
    shards.  Rows ``(kind, u, v, n)``: 0 links of u, 1 a cell v to visit
    next from u, entered at n, 2 an edge u-v of the spanning forest.  Written."""
    def run(p, g):
        if not len(p) or not len(g):
            return pd.DataFrame({"kind": [], "u": [], "v": [], "n": []}).astype("int64")
        node, times, cell = g["node"].to_numpy(), g["n"].to_numpy(), int(g["cell"].iloc[0])
        place = {int(k): i for i, k in enumerate(node)}
        local = [[place[j] for j in o if j in place] for o in g["near"]]
        edges = np.full((len(g), max([1, *map(len, local)])), -1, dtype=np.int64)
        for i, o in enumerate(local):
            edges[i, :len(o)] = o
        x, of = units(g["vec"], dtype), np.array(_even(g["cells"]), dtype=np.int64)
        middle = int(np.flatnonzero(g["medoid"].to_numpy())[0])
        ids, q = p["node"].to_numpy(), units(p["vec"], dtype)
        starts = [np.array(sorted({middle, *(place[int(k)] for k in (i, v) if not pd.isna(k) and int(k) in place)}), dtype=np.int64)
                  for i, v in zip(ids, p["via"])]
        found = [search_chunk(q[a:a + CHUNK], x, edges, starts[a:a + CHUNK], low, ef) for a in range(0, len(q), CHUNK)]
        r = np.concatenate([f[0] + a * CHUNK for a, f in enumerate(found)])
        i = np.concatenate([f[1] for f in found])
        other = ids[r] != node[i]
        r, i = r[other], i[other]
        cuts = np.searchsorted(r, np.arange(len(ids) + 1))
        links, more = np.zeros(len(ids), dtype=np.int64), []
        for k in np.unique(r).tolist():
            at = i[cuts[k]:cuts[k + 1]]
            seen, now, mine = p["seen"].iloc[k], p["now"].iloc[k], of[at]
            before = np.isin(mine, seen).any(1)
            first = np.where(np.isin(mine, now), mine, np.iinfo(np.int64).max).min(1) == cell
            links[k] = times[at[~before & first]].sum()
            new = ~np.isin(mine, seen) & ~np.isin(mine, now) & (mine >= 0)
            if new.any():
                rows, cols = np.nonzero(new)
                c, j = np.unique(mine[rows, cols], return_index=True)
                more += zip([int(ids[k])] * len(c), c.tolist(), node[at[rows[j]]].tolist())
        out = [np.array([(0, u, 0, w) for u, w in zip(ids.tolist(), links.tolist()) if w], dtype=np.int64).reshape(-1, 4),
               np.array([(1, *x) for x in more], dtype=np.int64).reshape(-1, 4), np.array([(2, *x, 0) for x in zip(*forest(ids[r], node[i]))], dtype=np.int64).reshape(-1, 4)]
        return pd.DataFrame(np.concatenate(out), columns=["kind", "u", "v", "n"])

    return settle(together(visits, graphs, "shard", 4 * CHUNK).applyInPandas(run, "kind bigint, u bigint, v bigint, n bigint"))


def _even(lists) -> list[list[int]]:
    most = max(map(len, lists))
    return [[*c, *[-1] * (most - len(c))] for c in lists]


def audit(classes: DataFrame, found: DataFrame, low: float, dtype, count: int = AUDIT) -> tuple[int, int]:
    """``(links, found links)`` of the audited classes, by comparing each with
    all classes of its group."""
    some = classes.orderBy(F.xxhash64("print", F.lit("audit")), "node").limit(count).select("node", "grp", "vec").collect()
    by = {}
    for r in some:
        by.setdefault(r.grp, []).append(r)

    def run(batches):
        for b in batches:
            t = b.to_pandas()
            for grp, g in t.groupby("grp", sort=False):
                if grp in by:
                    s = (units([r.vec for r in by[grp]], dtype) @ units(g["vec"], dtype).T) >= low
                    nodes = np.array([r.node for r in by[grp]])
                    s &= nodes[:, None] != g["node"].to_numpy()[None]
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array((s * g["n"].to_numpy()[None]).sum(1).astype(np.int64))], ["node", "links"])

    true = classes.select("grp", "node", "n", "vec").mapInArrow(run, "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))
    both = true.join(found, "node", "left").agg(F.sum("links"), F.sum(F.least("links", F.coalesce("found", F.lit(0))))).first()
    return both[0] or 0, both[1] or 0


def linked(classes: DataFrame, low: float, dtype, overlap: int = OVERLAP, ef: int = EF) -> tuple[DataFrame, DataFrame]:
    """``(node, found)`` and the forest's edges ``(u, v)``; one search."""
    own = cells(classes, dtype, overlap)
    flat = own.select("node", F.explode("cells").alias("cell"))
    parts = settle(flat.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("parts")))
    placed = flat.join(parts, "cell").select("node", "cell", F.xxhash64("cell", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("shard"))
    vec = classes.select("node", "n", "vec")
    graphs = graph(settle(placed.join(own, "node").join(vec, "node")), dtype)
    shards = parts.select("cell", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda p: F.xxhash64("cell", p))).alias("shard"))
    state = own.select("node", F.array().cast("array<bigint>").alias("seen"), F.col("cells").alias("now"), F.lit(None).cast("map<bigint,bigint>").alias("entry"))
    rounds = []
    while True:
        visits = (state.select("node", "seen", "now", F.explode("now").alias("cell"), "entry").join(shards, "cell").join(vec.select("node", "vec"), "node")
                  .select("shard", "node", "vec", "seen", "now", F.element_at("entry", F.col("cell")).alias("via")))
        rounds.append(visit(graphs, visits, low, ef, dtype))
        asked = rounds[-1].filter("kind = 1").groupBy("u", "v").agg(F.min("n").alias("n"))
        asked = settle(asked.groupBy(F.col("u").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("entry")))
        if asked.isEmpty():
            break
        state = settle(asked.join(state.select("node", F.concat("seen", "now").alias("seen")), "node").select("node", "seen", F.map_keys("entry").alias("now"), "entry"))
    every = rounds[0]
    for r in rounds[1:]:
        every = every.union(r)
    found = every.filter("kind = 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("found"))
    return settle(found), every.filter("kind = 2").select("u", "v")


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    overlap: int = OVERLAP, ef: int = EF) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row."""
    dtype = np.dtype(np.float32 if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else np.float64)
    base = prepare(vectors, id_col, vec_col, label_col)
    classes = settle(base.filter("grp IS NOT NULL").groupBy("grp", "print").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("vec").alias("vec"))
                     .withColumn("node", F.monotonically_increasing_id()))
    while True:
        found, edges = linked(classes, least, dtype, overlap, ef)
        links, caught = audit(classes, found, least, dtype)
        if caught >= RECALL * links:
            break
        overlap, ef = 2 * overlap, 2 * ef
    comps = settle(components(edges))
    named = classes.join(comps, "node", "left").join(found, "node", "left")
    named = settle(named.select("grp", "print", "rep", F.coalesce("root", "node").alias("root"), (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    first = named.groupBy("root").agg(F.min("rep").alias("component"))
    names = named.join(first, "root").select("grp", "print", "n_links", "component")
    return base.select("vec_id", "grp", "print").join(names, ["grp", "print"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.when(F.col("grp").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
