"""Exact top-k inner products with a pivot-distance index.

Components become ``floor(SCALE * x)``.  With M the largest norm, a vector x is
extended to (x, sqrt(M^2 - |x|^2)) and a query q to (q, 0); then
``dist^2 = |q|^2 + M^2 - 2 <q, x>``, so the highest products are the nearest
neighbours.  Every vector is keyed by its nearest pivot and the distance to it;
each pivot's vectors form annuli of ``WIDTH`` times M, sorted by distance, and an
annulus of many vectors is cut into blocks by a hash, so that no key is large.

Queries go in chunks of a home pivot.  The triangle inequality bounds the
distance from a query to any vector of an annulus:

    LB = max(0, d(q, pivot) - outer, inner - d(q, pivot)),   score <= (|q|^2 + M^2 - LB^2) / 2

A chunk's annuli are expanded in the order of rising bounds, in rounds: the
``FIRST`` nearest, then ``GROWTH`` times as many, and so on.  After each round every
query's k-th score is the one to beat.  A query takes no part in an annulus whose
bound cannot reach it, and a chunk leaves when none of its queries can win
in any annulus left.  So the result is exact whatever the pivots, which come
from a sample of ``SAMPLE`` vectors of the smallest hashes.

Defined results: vectors that are null, empty, without id, or hold a null or a
non-finite component take no part; rows of equal id are different vectors;
vectors are compared with those of equal length; equal scores go to the smaller
vec_id; a query with fewer than k others gets all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import settle

SCALE, PIVOTS, SAMPLE, WIDTH = 64, 24, 2048, 1 / 8
BLOCK, CHUNK = 4096, 512
FIRST, GROWTH = 4, 8
EXACT = float(2 ** 53)


def prepare(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(rid, vec_id, dim, vec, norm2)`` of the vectors that take part; ``vec``
    holds whole numbers as doubles."""
    def run(batches):
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not v or any(x is None for x in v):
                    continue
                a = np.asarray(v, dtype=np.float64)
                if np.isfinite(a).all():
                    ids.append(i)
                    out.append(np.floor(scale * a))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, type=pa.int64()), pa.array([len(v) for v in out], type=pa.int32()), pa.array([v.tobytes() for v in out], type=pa.binary()),
                 pa.array([float(v @ v) for v in out], type=pa.float64())], ["vec_id", "dim", "vec", "norm2"])

    some = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).alias("v"))
    got = some.mapInArrow(run, "vec_id bigint, dim int, vec binary, norm2 double")
    return settle(got.withColumn("rid", F.monotonically_increasing_id()))


def _rows(vecs) -> np.ndarray:
    vecs = list(vecs)
    return np.frombuffer(b"".join(vecs), dtype=np.float64).reshape(len(vecs), -1)


def choose_pivots(base: DataFrame, m2: float) -> dict[int, np.ndarray]:
    """Per vector length, pivots that lie far apart in a bounded sample."""
    out: dict[int, np.ndarray] = {}
    rows = base.orderBy(F.xxhash64("vec"), "rid").limit(SAMPLE).select("dim", "vec", "norm2").collect()
    for dim in {r.dim for r in rows}:
        x = _rows(r.vec for r in rows if r.dim == dim)
        x = np.c_[x, np.sqrt(np.maximum(0, m2 - (x * x).sum(1)))]
        got, far = [0], ((x - x[0]) ** 2).sum(1)
        while len(got) < PIVOTS and far.max() > 0:
            got.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[got[-1]]) ** 2).sum(1))
        for _ in range(4):                      # a few steps towards the middle of each cell
            p = x[got] if isinstance(got, list) else got
            near = ((x[:, None, :] - p[None]) ** 2).sum(2).argmin(1)
            got = np.array([x[near == k].mean(0) if (near == k).any() else p[k] for k in range(len(p))])
        out[dim] = got
    return out


def distances(x: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    y = np.c_[x, last]
    return np.sqrt(np.maximum(0, (y * y).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * y @ pivots.T))


def index(base: DataFrame, pivots: dict[int, np.ndarray], m2: float) -> tuple[DataFrame, pd.DataFrame]:
    """``(rid, vec_id, dim, vec, norm2, pivot, ring, block)`` of every vector, and
    the annuli ``(pivot, ring, dim, inner, outer, n, parts)``: at most ``PIVOTS``
    times 2 / ``WIDTH`` for each vector length."""
    width = max(np.sqrt(m2) * WIDTH, 1e-9)

    def run(batches):
        for b in batches:
            t = b.to_pandas()
            for dim, g in t.groupby("dim", sort=False):
                x = _rows(g["vec"])
                d = distances(x, np.sqrt(np.maximum(0, m2 - g["norm2"].to_numpy())), pivots.get(dim, np.zeros((1, dim + 1))))
                near = d.argmin(1)
                dist = d[np.arange(len(d)), near]
                out = g.assign(pivot=(near + (np.int64(dim) << 16)).astype("int64"), dist=dist, ring=(dist // width).astype("int64"))
                yield pa.RecordBatch.from_pandas(out[["rid", "vec_id", "dim", "vec", "norm2", "pivot", "dist", "ring"]], preserve_index=False)

    keyed = settle(base.mapInArrow(run, "rid bigint, vec_id bigint, dim int, vec binary, norm2 double, pivot bigint, dist double, ring bigint"))
    rings = keyed.groupBy("pivot", "ring", "dim").agg(F.min("dist").alias("inner"), F.max("dist").alias("outer"), F.count(F.lit(1)).alias("n"))
    annuli = rings.toPandas()
    annuli["parts"] = -(-annuli["n"] // BLOCK)
    parts = keyed.sparkSession.createDataFrame(annuli[["pivot", "ring", "parts"]], "pivot bigint, ring bigint, parts bigint")
    return settle(keyed.join(F.broadcast(parts), ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts"))).drop("parts", "dist")), annuli


def bounds(d: np.ndarray, annuli: pd.DataFrame) -> np.ndarray:
    """The least distance from each query (rows of ``d``, its distances to the
    pivots) to each annulus (columns)."""
    at = d[:, annuli["pivot"].to_numpy() & 0xFFFF]
    return np.maximum(0, np.maximum(at - annuli["outer"].to_numpy(), annuli["inner"].to_numpy() - at))


def plan(queries: DataFrame, annuli: pd.DataFrame, pivots: dict[int, np.ndarray], m2: float, done: int, upto: int) -> DataFrame:
    """``(chunk, pivot, ring, part, inner, outer, wins, n, last)``: the blocks of the annuli
    from the ``done``-th to before the ``upto``-th nearest that a query of the chunk
    may still win in; ``wins`` counts such queries.  A row of part -1 gives in
    ``last`` the annuli farther out in which some may."""
    slack = 1e-6 * (m2 + 1)                    # rounding of distances only lets more in

    def run(t):
        dim = int(t["dim"].iloc[0])
        a = annuli[annuli["dim"] == dim]
        low = bounds(distances(_rows(t["vec"]), np.zeros(len(t)), pivots.get(dim, np.zeros((1, dim + 1)))), a)
        best = (t["norm2"].to_numpy()[:, None] + m2 - low * low) / 2 + slack
        wins = (best >= t["beat"].fillna(-np.inf).to_numpy(dtype=np.float64)[:, None]).sum(0)
        a = a.assign(wins=wins).iloc[np.argsort(low.min(0), kind="stable")]
        rest = int((a["wins"].iloc[upto:] > 0).sum())
        a = a.iloc[done:upto]
        a = a[a["wins"] > 0]
        a = a.loc[a.index.repeat(a["parts"])]
        out = a.assign(chunk=t["chunk"].iloc[0], part=a.groupby(["pivot", "ring"]).cumcount(), last=0)
        out = pd.concat([out, pd.DataFrame({"chunk": [t["chunk"].iloc[0]], "part": [-1], "last": [rest]})]).fillna(0)   # one row says what is left
        return out[["chunk", "pivot", "ring", "part", "inner", "outer", "wins", "n", "parts", "last"]]

    return settle(queries.select("chunk", "dim", "vec", "norm2", "beat").groupBy("chunk").applyInPandas(
        run, "chunk bigint, pivot bigint, ring bigint, part bigint, inner double, outer double, wins bigint, n bigint, parts bigint, last bigint"))


def visit(blocks: DataFrame, idx: DataFrame, queries: DataFrame, pivots: dict[int, np.ndarray], m2: float, k: int) -> DataFrame:
    """``(qid, query_id, vec_id, score)``: the best of each query in each planned block."""
    slack = 1e-6 * (m2 + 1)
    p = blocks.filter("part >= 0").select("chunk", "pivot", "ring", "part", "inner", "outer", F.xxhash64("chunk", "pivot", "ring", "part").alias("pair"))
    none = F.lit(None).cast("double")
    left = idx.join(p.select("pivot", "ring", "part", "pair"), ["pivot", "ring", "part"]).select(
        "pair", F.lit(0).alias("side"), "rid", "vec_id", "vec", "pivot", none.alias("norm2"), none.alias("inner"), none.alias("outer"), none.alias("beat"))
    right = queries.drop("pivot").join(p.drop("ring", "part"), "chunk").select("pair", F.lit(1).alias("side"), "rid", "vec_id", "vec", "pivot", "norm2", "inner", "outer", "beat")

    def scan(t):
        v, q = t[t["side"] == 0], t[t["side"] == 1]
        if not len(v):
            return pd.DataFrame({"qid": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        x, y = _rows(v["vec"]), _rows(q["vec"])
        pivot, dim = int(q["pivot"].iloc[0]), y.shape[1]
        low = bounds(distances(y, np.zeros(len(y)), pivots.get(dim, np.zeros((1, dim + 1)))),
                     pd.DataFrame({"pivot": [pivot], "inner": [q["inner"].iloc[0]], "outer": [q["outer"].iloc[0]]}))[:, 0]
        beats = q["beat"].fillna(-np.inf).to_numpy(dtype=np.float64)
        may = (q["norm2"].to_numpy() + m2 - low * low) / 2 + slack >= beats
        q, y, beats = q[may], y[may], beats[may]
        top = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1]
        s = y @ x.T if top < EXACT else (y.astype(object) @ x.T.astype(object))
        ids, rid = v["vec_id"].to_numpy(), v["rid"].to_numpy()
        order = np.argsort(ids, kind="stable")
        out = []
        for i, (qrid, qid, beat) in enumerate(zip(q["rid"].to_numpy(), q["vec_id"].to_numpy(), beats)):
            row = s[i][order]
            at = np.flatnonzero((rid[order] != qrid) & np.asarray(row >= beat, dtype=bool))
            if len(at) > k:
                # the k highest, ties in the order of ids
                cut = np.sort(row[at])[-k]
                more, same = at[row[at] > cut], at[row[at] == cut]
                at = np.r_[more, same[:k - len(more)]]
            out += [(qrid, qid, int(ids[order][j]), int(row[j])) for j in at]
        return pd.DataFrame(out, columns=["qid", "query_id", "vec_id", "score"]).astype("int64")

    return left.union(right).groupBy("pair").applyInPandas(scan, "qid bigint, query_id bigint, vec_id bigint, score bigint")


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE,
           report: dict | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every vector for which
    ``is_query`` (a condition on ``vec_id``) holds, its k highest products.
    ``report`` receives the number of rounds, of products computed, and of all."""
    base = prepare(vectors, id_col, vec_col, scale)
    m2 = base.agg(F.max("norm2")).first()[0] or 0.0
    pivots = choose_pivots(base, m2)
    idx, annuli = index(base, pivots, m2)
    q = idx.filter(is_query).select("rid", "vec_id", "dim", "vec", "norm2", "pivot")
    size = q.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    plain = settle(q.join(size, "pivot").withColumn("chunk", F.xxhash64("pivot", F.pmod(F.xxhash64("rid"), F.col("parts")))).drop("parts"))
    q, best = plain.withColumn("beat", F.lit(None).cast("double")), None
    w = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    done, upto, rounds, products = 0, FIRST, 0, 0
    while True:
        blocks = plan(q, annuli, pivots, m2, done, upto)
        ahead = blocks.agg(F.sum(F.when(F.col("part") >= 0, F.col("wins") * F.col("n") / F.col("parts"))), F.max("last")).first()
        found = visit(blocks, idx, q, pivots, m2, k)
        best = found if best is None else best.unionByName(found)
        best = settle(best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank"))
        rounds, products, done, upto = rounds + 1, products + (ahead[0] or 0), upto, upto * GROWTH
        if not ahead[1]:
            break
        beat = best.groupBy(F.col("qid").alias("rid")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("beat"))
        q = settle(plain.join(beat, "rid", "left"))
    if report is not None:
        by = plain.groupBy("dim").count().toPandas().set_index("dim")["count"]
        report.update(rounds=rounds, products=int(products), all=int(sum(by.get(d, 0) * n for d, n in annuli.groupby("dim")["n"].sum().items())))
    return best.withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "vec_id", "score")
