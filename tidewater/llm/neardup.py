"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts makes each document's set of distinct word shingles,
   its fingerprint and its MinHash signature.  Documents of equal sets form a
   class at once; only classes go on, so copies are never paired.
2. Signatures are cut into bands.  In every bucket of equal bands the smallest
   class is the hub, and each other class is paired with it: a bucket of m
   classes gives m - 1 pairs.
3. A pair is verified sequentially: signature positions are compared batch by
   batch, and it is pruned as soon as the posterior probability (uniform prior)
   of a similarity at or above the threshold falls below ``MISS``.  Survivors
   are verified on their full sets.
4. Buckets whose classes (other than the hub) are not all linked together may
   hold links that the hub does not show.  Their classes are gathered into
   clusters, ordered by component and cut into blocks; pairs of blocks that hold
   more than one component are compared (same bands, same verification), and
   only links that join components are written.
5. Connected components of the links, by alternating large-star and small-star
   steps on checkpointed edges.

Bands miss a pair at the threshold with a probability below ``BAND_MISS``.

Defined results: a text without words (also a null one) is in a group of its
own; repeated rows are copies; a null doc_id never names a group if another
member has one; an empty table gives an empty table; other columns are ignored
by ``groups`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewater.llm import wordhash as H
from tidewater.llm.common import id_text, settle
from tidewater.session import scratch_path

HASHES = 160            # positions of a signature
BAND_HASHES = 125       # of which bands are made
BAND_MISS = 1e-6
MISS = 1e-7             # pruning a pair that is at the threshold
BATCH = 32              # positions compared at a time
BLOCK = 1024            # classes of a cluster compared in one task with as many others
GROUP = 1 << 20         # characters hashed at a time

_RNG = np.random.default_rng(77)
MUL = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


def band_rows(threshold: float) -> int:
    """The longest bands that miss a pair at the threshold rarely enough."""
    return max(r for r in range(1, 11) if r == 1 or (1 - threshold ** r) ** (BAND_HASHES // r) <= BAND_MISS)


def least_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """For n compared positions, the fewest matches with which a pair stays:
    P(similarity >= threshold | matches) >= miss under a uniform prior, where
    the posterior Beta tail equals a binomial sum."""
    out = {}
    for n in [*range(BATCH, HASHES, BATCH), HASHES]:
        log = [math.lgamma(n + 2) - math.lgamma(i + 1) - math.lgamma(n + 2 - i) + i * math.log(threshold)
               + (n + 1 - i) * math.log(1 - threshold) for i in range(n + 2)]
        tail = np.cumsum(np.exp(log))        # P(Binomial(n + 1, t) <= m) = P(J >= t | m)
        out[n] = int(np.searchsorted(tail, miss))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(s), 2048):
        part = s[at:at + 2048, None] * MUL + ADD
        best = np.minimum(best, (part >> np.uint64(32)).min(0).astype(np.uint32))
    return best


def _grouped(batches):
    """``(rows, texts)`` a bounded number of characters at a time."""
    for b in batches:
        at, texts = 0, b.column(1)
        while at < len(texts):
            group, chars = [], 0
            while at < len(texts) and chars < GROUP:
                group.append(texts[at].as_py())
                chars += len(group[-1])
                at += 1
            yield b.slice(at - len(group), len(group)), group


def _sets(texts: list[str], k: int):
    h, offsets = H.words(texts)
    return [np.unique(H.shingles(h[a:b], k)) for a, b in zip(offsets, offsets[1:])]


def _print(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, th, n_shingles, print, sig)`` of every row ``(doc_id, text,
    th)``; the last two are null without words."""
    def run(batches):
        for rows, texts in _grouped(batches):
            sets = _sets(texts, k)
            yield pa.RecordBatch.from_arrays([
                rows.column(0), rows.column(2), pa.array([len(s) for s in sets], type=pa.int64()),
                pa.array([_print(s) if len(s) else None for s in sets], type=pa.binary()),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], type=pa.binary())],
                ["doc_id", "th", "n_shingles", "print", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, th bigint, n_shingles bigint, print binary, sig binary")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(node, items)`` of the wanted classes ``(node, rep, print)``, made
    again from the text of their first document."""
    def run(batches):
        for _, texts in _grouped(batches):
            sets = _sets(texts, k)
            yield pa.RecordBatch.from_arrays([pa.array([_print(s) for s in sets], type=pa.binary()),
                                              pa.array([s.tobytes() for s in sets], type=pa.binary())], ["print", "items"])

    some = docs.join(wanted.select(F.col("rep").alias("__rep")).distinct(), F.col("doc_id").eqNullSafe(F.col("__rep")), "left_semi")
    made = some.mapInArrow(run, "print binary, items binary").dropDuplicates(["print"])
    return settle(made.join(wanted, "print").select("node", "items"))


def bands(classes: DataFrame, rows: int) -> DataFrame:
    """``(band, node)``: a 64-bit key for each band of each class."""
    def run(batches):
        for b in batches:
            sig = _matrix(b.column(1))
            keys = band_keys(sig, rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)),
                                              pa.array(np.repeat(np.asarray(b.column(0)), keys.shape[1]))], ["band", "node"])

    return classes.select("node", "sig").mapInArrow(run, "band bigint, node bigint")


def _matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist() if hasattr(col, "to_pylist") else col), dtype=np.uint32).reshape(-1, HASHES)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    count = BAND_HASHES // rows
    parts = sig[:, :count * rows].astype(np.uint64).reshape(len(sig), count, rows)
    key = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), (len(sig), count)).copy()
    for j in range(rows):
        key = H.mix(key * np.uint64(H.P) + parts[:, :, j])
    return key


# positions outside the bands come first: they say most about a pair of a bucket
ORDER = np.r_[BAND_HASHES:HASHES, 0:BAND_HASHES]


def sequential(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs (rows of ``a`` and ``b``) stay after all batches."""
    alive, same, done = np.arange(len(a)), np.zeros(len(a), dtype=np.int64), 0
    for n, fewest in least.items():
        cols = ORDER[done:n]
        same[alive] += (a[alive][:, cols] == b[alive][:, cols]).sum(1)
        alive, done = alive[same[alive] >= fewest], n
        if not len(alive):
            break
    return alive


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def star_pairs(banded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(band, hub, node)`` for the classes other than the hub of all buckets
    of two or more, and the distinct pairs ``(hub, node)``."""
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "hub")
    members = settle(banded.join(hubs, "band").filter("node <> hub").select("band", "hub", "node"))
    return members, members.select("hub", "node").distinct()


def verify_pairs(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``(u, v)`` among pairs ``(hub, node)``."""
    least = least_matches(percent / 100)
    sigs = classes.select("node", "sig")

    def prune(batches):
        for b in batches:
            keep = sequential(_matrix(b.column(2)), _matrix(b.column(3)), least)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep))], ["u", "v"])

    def confirm(batches):
        for b in batches:
            keep = [similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent)
                    for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, type=pa.bool_())),
                                              b.column(1).filter(pa.array(keep, type=pa.bool_()))], ["u", "v"])

    both = (pairs.join(sigs.withColumnRenamed("sig", "sv"), "node")
            .join(sigs.select(F.col("node").alias("hub"), F.col("sig").alias("su")), "hub")
            .select(F.col("hub").alias("u"), F.col("node").alias("v"), "su", "sv"))
    left = settle(both.mapInArrow(prune, "u bigint, v bigint"))
    nodes = left.select(F.col("u").alias("node")).union(left.select("v")).distinct()
    sets = full_sets(docs, classes.join(nodes, "node").select("node", "rep", "print"), k)
    full = (left.join(sets.select(F.col("node").alias("v"), F.col("items").alias("iv")), "v")
            .join(sets.select(F.col("node").alias("u"), F.col("items").alias("iu")), "u").select("u", "v", "iu", "iv"))
    return settle(full.mapInArrow(confirm, "u bigint, v bigint"))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars ``(node, smallest node)`` that join what the pairs join."""
    names, flat = np.unique(np.r_[u, v], return_inverse=True)
    a, b = flat[:len(u)], flat[len(u):]
    root = np.arange(len(names))
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    some = root != np.arange(len(names))
    return names[some], names[root[some]]


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of a link; the root is the smallest
    node.  Every task first joins what its own links join; then alternating
    large-star and small-star steps until neither changes an edge, which the
    steps themselves count.

    Each step writes its edges to the shared folder: read back, they have true
    sizes, where a chain of checkpoints would multiply the planner's estimates
    with every join."""
    spark = links.sparkSession
    folder = scratch_path(spark, "components")

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def joined(batches):
        for b in batches:
            u, v = forest(*(np.asarray(b.column(c)) for c in ("u", "v")))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    edges, turn = put(links.filter("u <> v").select("u", "v").mapInArrow(joined, "u bigint, v bigint").distinct(), "begin"), 0
    while True:
        moved, kept = Observation(), Observation()
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").observe(moved, F.count_if(F.col("m") != F.col("u")).alias("n"))
        large = put(large.select(F.col("v").alias("u"), F.col("m").alias("v")), f"large{turn}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").observe(kept, F.count_if(F.col("v") != F.col("m")).alias("n"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = put(small.select("e.*").filter("u <> v").distinct(), f"edges{turn}")
        if not edges.isEmpty() and moved.get["n"] + kept.get["n"]:
            turn += 1
            continue
        break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def block_links(members: DataFrame, comps: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components that no hub shows (step 4)."""
    rows, least = band_rows(percent / 100), least_matches(percent / 100)
    # buckets whose members other than the hub lie in more than one component
    members = members.select("band", "node")
    rooted = members.join(comps, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    mixed = settle(rooted.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min("node").alias("first"))
                   .filter("a <> b").select("band", "first"))
    edges = members.join(mixed, "band").select(F.col("first").alias("u"), F.col("node").alias("v")).distinct()
    clusters = settle(components(edges).select("node", F.col("root").alias("cluster")))
    c = (clusters.join(comps, "node", "left").select("node", "cluster", F.coalesce("root", "node").alias("root"))
         .join(classes.select("node", "sig", "rep", "print"), "node"))
    sets = full_sets(docs, c.select("node", "rep", "print"), k)
    # a component of many classes is cut into blocks of its own, small ones
    # share blocks; all by hashes, so that no cluster is sorted or numbered
    size = settle(c.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n")))
    small = F.col("n") <= BLOCK // 4
    shared = size.filter(small).groupBy("cluster").agg(F.ceil(F.sum("n") / (BLOCK // 2)).alias("shared"))
    size = settle(size.join(shared, "cluster", "left").select(
        "cluster", "root", "n", F.when(small, F.xxhash64("cluster", F.pmod(F.xxhash64("root"), F.col("shared")))).alias("block")))
    own = settle(c.join(size, ["cluster", "root"]).withColumn("block", F.coalesce("block", F.xxhash64(
        F.lit("own"), F.col("root"), F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / (BLOCK // 2)))))).join(sets, "node")
                 .select("node", "root", "cluster", "block", "sig", "items"))
    blocks = settle(own.groupBy("cluster", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi")))
    x, y = (blocks.select("cluster", *[F.col(n).alias(n + t) for n in ("block", "lo", "hi")]) for t in "ab")
    pairs = (x.join(y, "cluster").filter("blocka <= blockb").filter("loa <> hia OR lob <> hib OR loa <> lob")
             .select("blocka", "blockb", F.xxhash64("blocka", "blockb").alias("pair")))
    left = own.join(pairs.select(F.col("blocka").alias("block"), "pair", (F.col("blocka") == F.col("blockb")).alias("within")), "block")
    right = own.join(pairs.filter("blocka <> blockb").select(F.col("blockb").alias("block"), "pair", F.lit(False).alias("within")), "block")
    cols = ("pair", "within", "node", "root", "sig", "items")
    rows_in = left.select(*cols, F.lit(0).alias("side")).union(right.select(*cols, F.lit(1).alias("side")))

    def compare(t):
        node, root, side = (t[n].to_numpy() for n in ("node", "root", "side"))
        sig, items = _matrix(t["sig"]), [np.frombuffer(x, dtype=np.uint64) for x in t["items"]]
        keys, within = band_keys(sig, rows), bool(t["within"].iloc[0])
        a, b = (np.arange(len(node)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        near = np.zeros((len(a), len(b)), dtype=bool)
        for j in range(keys.shape[1]):
            near |= keys[a, j][:, None] == keys[b, j][None, :]
        near &= root[a][:, None] != root[b][None, :]
        if within:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        i, j = a[i], b[j]
        parent: dict[int, int] = {}

        def find(r: int) -> int:
            while parent.get(r, r) != r:
                parent[r] = r = parent.get(parent[r], parent[r])
            return r

        out = []
        for at in range(0, len(i), 1 << 16):
            p, q = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            for n in sequential(sig[p], sig[q], least).tolist():
                ru, rv = find(int(root[p[n]])), find(int(root[q[n]]))
                if ru != rv and similar(items[p[n]], items[q[n]], percent):
                    parent[ru] = rv
                    out.append((int(node[p[n]]), int(node[q[n]])))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return rows_in.groupBy("pair").applyInPandas(compare, "u bigint, v bigint")


def _hash(text_col: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _grouped_rows(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, th, n_shingles, component_id, root)`` for every row; ``th`` is
    the hash of its text, and rows with words of an equal ``root`` form a group."""
    docs = id_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    base = settle(sketches(docs, k))
    classes = settle(base.filter("n_shingles > 0").groupBy("print").agg(F.min("doc_id").alias("rep"), F.max("sig").alias("sig"))
                     .withColumn("node", F.monotonically_increasing_id()))
    banded = settle(bands(classes, band_rows(percent / 100)))
    members, pairs = star_pairs(banded)
    links = verify_pairs(pairs, classes, docs, k, percent)
    comps = settle(components(links))
    more = settle(block_links(members, comps, classes, docs, k, percent))
    if more.head(1):
        comps = settle(components(links.union(more)))
    tied = classes.select("node", "rep").join(comps, "node")
    first = tied.groupBy("root").agg(F.min("rep").alias("component"))
    named = tied.join(first, "root").select("node", "component", "root")
    names = settle(classes.select("node", "print", "rep").join(named, "node", "left")
                   .select("print", F.coalesce("component", "rep").alias("component"), F.coalesce("root", "node").alias("root")))
    return base.select("doc_id", "th", "n_shingles", "print").join(names, "print", "left").select(
        "doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "root")


def groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row: shingles of
    ``k`` words, links at a Jaccard similarity of ``percent`` / 100 or more."""
    return _grouped_rows(docs, k, percent, id_col, text_col).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that another member of their group stands
    for; all columns as they were.  Rows are told apart by doc_id and text:
    repeated rows of a kept id stay, and another text of an id goes or stays by
    its own group.  Of the rows of a group that have a null doc_id, one stays,
    of the smallest text hash."""
    rows = _grouped_rows(docs, k, percent, id_col, text_col)
    some = rows.filter("doc_id IS NOT NULL AND component_id IS NOT NULL AND doc_id <> component_id").select("doc_id", "th")
    null = settle(rows.filter("doc_id IS NULL AND n_shingles > 0").select("doc_id", "th", "root").distinct())
    least = null.groupBy("root").agg(F.min("th").alias("least"))
    more = null.join(least, "root").filter("th <> least").select("doc_id", "th")
    gone = some.union(more).distinct().select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    left = docs.withColumn("__key", _hash(text_col)).join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__th")), "left_anti")
    # null ids with words: equal texts are one group, of which one row stays
    once = F.col(id_col).isNull() & F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return left.filter(~once).union(left.filter(once).dropDuplicates(["__key"])).drop("__key")
