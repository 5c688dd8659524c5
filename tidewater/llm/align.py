"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers A and B cut the same bytes.  An interval of a text is split at a
byte offset where tokens of both end, found near its middle: the middle end of
A is looked up among B's ends by bisection, then its neighbours on both sides,
ever farther out.  Both halves are split again; an interval without a shared
cut inside is a leaf group.  All intervals of a batch of texts are halved level
by level, so each step of the search is one vectorised bisection, and a level
holds no more than the batch's tokens.

Tokens of a group are linked, each of A with each of B.  A pair of ids counts
the documents that hold it linked.  Counting takes one pass:

1. Each task tokenizes, aligns, writes per document its distinct linked id pairs
   with their multiplicities, and adds up document counts of pairs in a bounded
   table, which it writes as extra rows.
2. The partial counts are summed by pair; the best count of each A id follows.
3. The ``HOT`` pairs of the highest counts (a fixed number, so a broadcast of
   bounded size) answer the frequent pairs of all documents in place; only the
   rest is shuffled to its counts and back.  So a pair that every document holds
   is never a hot key.

Defined results: texts that are null, empty or whose joined token bytes differ
from ``" " + text`` have no tokens: zeros and an empty ``groups``; repeated rows
are documents of their own; null ids stay; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.bpe import byte_symbols
from tidewater.llm.common import id_text, settle

GROUP = 1 << 19         # characters of texts aligned at a time
COUNTED = 1 << 20       # pairs whose counts a task holds before it writes them
HOT = 1 << 18           # pairs of the highest counts that are broadcast (4 MB)
PAIRS = 1 << 20         # links that are listed at a time; larger groups are multiplied from counts


class Side:
    """A tokenizer's ids with the bytes and the written form of each."""

    def __init__(self, encode, pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)

    def ids(self, texts: list[str], wanted: list[bytes]) -> list[np.ndarray | None]:
        """Ids of each text, or None if their bytes are not the wanted ones."""
        return [np.array(i, dtype=np.int64) if b"".join(map(self.pieces.__getitem__, i)) == w else None
                for i, w in zip(self.encode(texts), wanted)]


# the split of byte-level vocabularies; a fixed value
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANKS = 10_000         # a longer run of white space is too deep for tiktoken's matcher


def byte_level(path: str) -> Side:
    """A byte-level vocabulary file of the tokenizers library; the text gets a
    leading space.  If the file has nothing but the usual split and merges whose
    ids follow their order, tiktoken encodes by the same table, several times
    faster; texts with very long runs of white space go to the library itself."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    value = {s: b for b, s in enumerate(byte_symbols())}
    names = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
    pieces = [bytes(value[c] for c in n) if all(c in value for c in n) else n.encode() for n in names]

    def library(texts):
        return [e.ids for e in t.encode_batch([" " + x for x in texts], add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model.get("merges", [])]
    plain = (not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
             and merged == sorted(set(merged)) and len(model["vocab"]) == len(merged) + 256 and all(c in value for n in model["vocab"] for c in n))
    if not plain:
        return Side(library, pieces)
    import tiktoken

    table = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks={pieces[i]: i for i in model["vocab"].values()}, special_tokens={})

    def fast(texts):
        return [library([x])[0] if len(x) >= BLANKS and re.search(r"\s{%d}" % BLANKS, x) else table.encode_ordinary(" " + x) for x in texts]

    return Side(fast, pieces)


def piece_level(path: str) -> Side:
    """A sentencepiece model with byte fallback, which adds the space itself."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    pieces = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]
    return Side(lambda texts: sp.encode(texts, num_threads=1), pieces)


_SIDES: dict[tuple, Side] = {}


def side(kind, path: str) -> Side:
    """The worker's own copy; loaded once a process."""
    if (kind.__name__, path) not in _SIDES:
        _SIDES[kind.__name__, path] = kind(path)
    return _SIDES[kind.__name__, path]


def leaf_groups(ea: np.ndarray, eb: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaf groups ``(alo, ahi, blo, bhi)``, half open, in order.  ``ea`` and
    ``eb`` hold ascending end offsets of the tokens of several texts; ``a`` and
    ``b`` the token numbers at which the texts begin, and the last ends."""
    # each end of A bisected among B's ends; ascending, so the sweep is cheap
    place = np.searchsorted(eb, ea)
    shared = eb[np.minimum(place, max(len(eb) - 1, 0))] == ea if len(eb) else np.zeros(0, dtype=bool)
    todo = (a[:-1], a[1:], b[:-1], b[1:])
    leaves = []
    while len(todo[0]):
        single = (todo[1] - todo[0] == 1) | (todo[3] - todo[2] == 1)
        leaves.append(np.stack([x[single] for x in todo]))
        alo, ahi, blo, bhi = (x[~single] for x in todo)
        cut = np.full(len(alo), -1, dtype=np.int64)
        middle = alo + (ahi - alo - 1) // 2
        open_, step = np.arange(len(alo)), 0
        while len(open_):       # the middle end first, then its neighbours on both sides
            for i in ((middle[open_],) if not step else (middle[open_] + step, middle[open_] - step)):
                hit = (i < ahi[open_] - 1) & (i >= alo[open_]) & (cut[open_] < 0)
                hit[hit] = shared[i[hit]]
                cut[open_[hit]] = i[hit] + 1
            step += 1
            open_ = open_[(cut[open_] < 0) & ((middle[open_] + step < ahi[open_] - 1) | (middle[open_] - step >= alo[open_]))]
        split = cut >= 0
        leaves.append(np.stack([x[~split] for x in (alo, ahi, blo, bhi)]))
        c = cut[split]
        d = place[c - 1] + 1
        todo = (np.r_[alo[split], c], np.r_[c, ahi[split]], np.r_[blo[split], d], np.r_[d, bhi[split]])
    out = np.concatenate(leaves, axis=1) if leaves else np.zeros((4, 0), dtype=np.int64)
    return tuple(out[:, np.argsort(out[0], kind="stable")])


def group_links(ida, idb, doc, groups, width: int):
    """``(doc, key, times)`` of the distinct linked id pairs of each text,
    ascending; ``doc`` numbers the text of each group, a key is ``a * width + b``."""
    alo, ahi, blo, bhi = groups
    na, nb = ahi - alo, bhi - blo
    size = na * nb
    docs, keys, times = [], [], []
    large = size > PAIRS
    ends = np.cumsum(np.where(large, 0, size))
    parts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, PAIRS), side="left")
    bounds = np.unique(np.r_[parts, len(size)]) if len(size) else np.zeros(0, dtype=np.int64)
    lo = 0
    for hi in bounds.tolist():
        g = np.arange(lo, hi)[~large[lo:hi]]
        lo = hi
        if not len(g):
            continue
        of = np.repeat(g, size[g])
        k = np.arange(len(of)) - np.repeat(np.cumsum(size[g]) - size[g], size[g])
        docs.append(doc[of])
        keys.append(ida[alo[of] + k // nb[of]] * width + idb[blo[of] + k % nb[of]])
        times.append(np.ones(len(of), dtype=np.int64))
        docs[-1], keys[-1], times[-1] = _merged(docs[-1], keys[-1], times[-1])
    for g in np.flatnonzero(large).tolist():
        ua, ta = np.unique(ida[alo[g]:ahi[g]], return_counts=True)
        ub, tb = np.unique(idb[blo[g]:bhi[g]], return_counts=True)
        docs.append(np.full(len(ua) * len(ub), doc[g]))
        keys.append((ua[:, None] * width + ub[None]).ravel())
        times.append((ta[:, None] * tb[None]).ravel())
    if not docs:
        return (np.zeros(0, dtype=np.int64),) * 3
    return _merged(*(np.concatenate(x) for x in (docs, keys, times)))


def _merged(doc, key, times):
    order = np.lexsort((key, doc))
    doc, key, times = doc[order], key[order], times[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]) if len(key) else np.zeros(0, dtype=np.int64)
    return doc[first], key[first], np.add.reduceat(times, first) if len(first) else times


class Writer:
    """Written groups of a text: ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, na: int, nb: int):
        self.na = na
        self.parts = [f"{i}{s}".encode() for n, ends in ((na, ",|"), (nb, ",;")) for i in range(n) for s in ends]

    def ordered(self, ida, idb, groups) -> np.ndarray:
        """Part numbers of all tokens, in the written order."""
        alo, ahi, blo, bhi = groups
        out = np.empty(len(ida) + len(idb), dtype=np.int64)
        of_a, of_b = np.repeat(np.arange(len(alo)), ahi - alo), np.repeat(np.arange(len(alo)), bhi - blo)
        ia, ib = np.arange(len(ida)), np.arange(len(idb))
        out[ia + blo[of_a]] = ida * 2 + (ia + 1 == ahi[of_a])
        out[ib + ahi[of_b]] = 2 * self.na + idb * 2 + (ib + 1 == bhi[of_b])
        return out

    def text(self, codes: np.ndarray) -> bytes:
        return b"".join(map(self.parts.__getitem__, codes.tolist()))[:-1]


class PairCounts:
    """Document counts of pairs, held up to a bound and then handed on."""

    def __init__(self):
        self.keys, self.n, self.fresh = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []

    def add(self, keys: np.ndarray):
        """Takes one key per document and pair; yields what no longer fits."""
        self.fresh.append(keys)
        if sum(map(len, self.fresh)) >= COUNTED:
            self._merge()
            if len(self.keys) >= COUNTED:
                yield from self.rest()

    def _merge(self):
        k, n = np.unique(np.concatenate([*self.fresh, np.zeros(0, dtype=np.int64)]), return_counts=True)
        _, self.keys, self.n = _merged(np.zeros(len(k) + len(self.keys), dtype=np.int64), np.r_[self.keys, k], np.r_[self.n, n])
        self.fresh = []

    def rest(self):
        self._merge()
        for at in range(0, len(self.keys), 1 << 16):
            yield self.keys[at:at + (1 << 16)], self.n[at:at + (1 << 16)]
        self.keys, self.n = self.keys[:0], self.n[:0]


def align_texts(texts: list[str], sa: Side, sb: Side):
    """``(usable, ida, idb, starts_a, starts_b, groups, doc)`` of texts: which
    have tokens, all their ids one text after the other, and the leaf groups."""
    wanted = [(" " + t).encode() if t else b"" for t in texts]
    some = [k for k, t in enumerate(texts) if t]
    got = [(k, a, b) for k, a, b in zip(some, sa.ids([texts[k] for k in some], [wanted[k] for k in some]),
                                        sb.ids([texts[k] for k in some], [wanted[k] for k in some])) if a is not None and b is not None]
    none = np.zeros(0, dtype=np.int64)
    ida, idb = np.concatenate([none, *(a for _, a, _ in got)]), np.concatenate([none, *(b for _, _, b in got)])
    a0, b0 = (np.cumsum([0, *(len(x[n]) for x in got)]).astype(np.int64) for n in (1, 2))
    # one running offset over all texts: ends are ascending, texts end where both sides do
    groups = leaf_groups(np.cumsum(sa.sizes[ida]), np.cumsum(sb.sizes[idb]), a0, b0)
    doc = np.searchsorted(a0, groups[0], side="right") - 1
    return [k for k, _, _ in got], ida, idb, a0, b0, groups, doc


def _batches(batches):
    for b in batches:
        at, col = 0, b.column(1)
        while at < len(col):
            group, chars = [], 0
            while at < len(col) and chars < GROUP:
                group.append(col[at].as_py())
                chars += len(group[-1])
                at += 1
            yield b.column(0)[at - len(group):at], group


def aligned(docs: DataFrame, path_a: str, path_b: str, kind_a=byte_level, kind_b=piece_level) -> DataFrame:
    """Step 1: rows of documents ``(doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, keys, times)`` and, with ``counted`` true, of partial
    document counts of pairs (``keys`` and ``times`` only).  Written."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["counted", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"]

    def run(batches):
        sa, sb = side(kind_a, path_a), side(kind_b, path_b)
        width, write, total, no_id = len(sb.pieces), Writer(len(sa.pieces), len(sb.pieces)), PairCounts(), None

        def counts(parts):
            for k, n in parts:
                yield pa.RecordBatch.from_arrays([
                    pa.array([True]), pa.nulls(1, no_id), *(pa.nulls(1, pa.int64()),) * 4, pa.nulls(1, pa.string()),
                    pa.array([k.tobytes()], type=pa.binary()), pa.array([n.tobytes()], type=pa.binary())], names)

        for ids, texts in _batches(batches):
            no_id, n = ids.type, len(texts)
            usable, ida, idb, a0, b0, groups, doc = align_texts(texts, sa, sb)
            codes = write.ordered(ida, idb, groups)
            d, key, times = group_links(ida, idb, doc, groups, width)
            cuts = np.searchsorted(d, np.arange(len(usable) + 1))
            where = dict(zip(usable, range(len(usable))))
            n_groups = np.bincount(doc, minlength=len(usable)) if len(usable) else np.zeros(0, dtype=np.int64)
            rows = []
            for k in range(n):
                if (u := where.get(k)) is None:
                    rows.append((0, 0, 0, 0, "", None, None))
                    continue
                s = slice(cuts[u], cuts[u + 1])
                sha = hashlib.sha256(write.text(codes[a0[u] + b0[u]:a0[u + 1] + b0[u + 1]])).hexdigest()
                rows.append((int(a0[u + 1] - a0[u]), int(b0[u + 1] - b0[u]), int(n_groups[u]), int(times[s].sum()), sha,
                             np.diff(key[s], prepend=0).astype(np.uint32 if width * len(sa.pieces) < 1 << 32 else np.uint64).tobytes(),
                             None if (times[s] == 1).all() else times[s].astype(np.uint32 if times[s].max() < 1 << 32 else np.uint64).tobytes()))
            cols = list(zip(*rows))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([False] * n), ids, *(pa.array(c, type=t) for c, t in zip(cols, kinds))], names)
            yield from counts(total.add(key))
        if no_id is not None:
            yield from counts(total.rest())

    return settle(docs.mapInArrow(run, f"counted boolean, doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
                                       "groups_sha256 string, keys binary, times binary"))


def _pairs(keys: bytes, times: bytes | None, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a document row; ``wide`` keys are 8 bytes each."""
    k = np.cumsum(np.frombuffer(keys, dtype=np.uint64 if wide else np.uint32).astype(np.int64))
    if times is None:
        return k, np.ones(len(k), dtype=np.int64)
    return k, np.frombuffer(times, dtype=np.uint32 if len(times) == 4 * len(k) else np.uint64).astype(np.int64)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """Step 2: ``(key, n, best)`` of every pair; best: no pair of its A id has
    a higher count.  Written."""
    def run(batches):
        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, dtype=np.int64)), pa.array(np.frombuffer(n, dtype=np.int64))], ["key", "n"])

    n = settle(rows.filter("counted").select("keys", "times").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
               .withColumn("a", F.floor(F.col("key") / width).cast("bigint")))
    most = n.groupBy("a").agg(F.max("n").alias("most"))
    return settle(n.join(most, "a").select("key", "n", (F.col("n") == F.col("most")).alias("best")))


def weighed(rows: DataFrame, counts: DataFrame, wide: bool) -> DataFrame:
    """Step 3: ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256)``."""
    spark = rows.sparkSession
    hot = counts.orderBy(F.desc("n"), "key").limit(HOT).toPandas().sort_values("key")
    table = spark.sparkContext.broadcast((hot["key"].to_numpy(dtype=np.int64), hot["n"].to_numpy(dtype=np.int64), hot["best"].to_numpy(dtype=bool)))
    docs = rows.filter("NOT counted").withColumn("rid", F.monotonically_increasing_id())

    def looked_up(keys, times):
        hk, hn, hb = table.value
        k, t = _pairs(keys, times, wide)
        at = np.minimum(np.searchsorted(hk, k), max(len(hk) - 1, 0))
        hit = hk[at] == k if len(hk) else np.zeros(len(k), dtype=bool)
        return k, t, hit, at[hit], hn, hb

    def frequent(batches):
        for b in batches:
            best, total = [], []
            for keys, times in zip(b.column("keys").to_pylist(), b.column("times").to_pylist()):
                if keys is None:
                    best.append(0), total.append(0)
                    continue
                _, t, hit, at, hn, hb = looked_up(keys, times)
                best.append(int(t[hit][hb[at]].sum()))
                total.append(int((t[hit] * hn[at]).sum()))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in head] + [pa.array(best, type=pa.int64()), pa.array(total, type=pa.int64())], [*head, "best", "total"])

    def rest(batches):
        for b in batches:
            for rid, keys, times in zip(*(b.column(c).to_pylist() for c in ("rid", "keys", "times"))):
                k, t, hit, *_ = looked_up(keys, times)
                if not hit.all():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int((~hit).sum()), rid)), pa.array(k[~hit]), pa.array(t[~hit])], ["rid", "key", "t"])

    head = ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in head)
    part = docs.select(*head, "keys", "times").mapInArrow(frequent, f"{kinds}, best bigint, total bigint")
    rare = (docs.filter("keys IS NOT NULL").select("rid", "keys", "times").mapInArrow(rest, "rid bigint, key bigint, t bigint").join(counts, "key").groupBy("rid")
            .agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("more_best"), F.sum(F.col("t") * F.col("n")).alias("more_total")))
    return part.join(rare, "rid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("total") + F.coalesce("more_total", F.lit(0))).alias("count_sum"), "groups_sha256")


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", kind_a=byte_level, kind_b=piece_level) -> DataFrame:
    """One row per document: its tokens on both sides, groups, links, and how
    the links' id pairs count over the corpus."""
    rows = aligned(id_text(docs, id_col, text_col), path_a, path_b, kind_a, kind_b)
    width = len(side(kind_b, path_b).pieces)
    return weighed(rows, pair_counts(rows, width), width * len(side(kind_a, path_a).pieces) >= 1 << 32)


def groups_of(text: str, path_a: str, path_b: str, kind_a=byte_level, kind_b=piece_level) -> list[tuple[list[int], list[int]]]:
    """The groups of one text as lists of ids."""
    _, ida, idb, _, _, (alo, ahi, blo, bhi), _ = align_texts([text], side(kind_a, path_a), side(kind_b, path_b))
    return [(ida[p:q].tolist(), idb[r:s].tolist()) for p, q, r, s in zip(alo, ahi, blo, bhi)]
