"""Conversation prefix trie with subtree totals by time-forward processing.

1. ``numbered``: turns are range-partitioned and sorted, and every turn gets its
   position in its conversation and a running hash of the conversation up to it.
   The hash is a polynomial modulo 2^127 - 1 over 128-bit digests of the turns, so a
   prefix that begins in an earlier partition is carried on by one
   multiplication.  A conversation of any length is thus cut anywhere; only one
   carry a partition passes through the driver.
2. ``paths`` lists the conversations' prefixes ``(conv_id, depth, key, pkey, size, len)``;
   ``rebuilt`` makes them for conversations that begin with turns of another,
   by arithmetic on the running hashes.
3. ``trie`` groups the prefixes to nodes.  The weight of a node is the number
   of prefixes at or below it, so weights fall along every path.  A topmost node
   of weight at most ``SHARD`` is the root of a shard; the nodes above are the crown.
   Shards are dealt to tasks.  Each task sorts its nodes by reverse level order
   (Spark's sort, which spills) and processes them forward in time: a node takes
   the messages that wait for it in a priority queue, and sends its subtree's
   totals to its parent through the queue.  A queue beyond ``HELD`` messages
   spills sorted runs to the folders Spark gives a task for spilling.  Shard
   roots send to the crown, summed by receiver.
4. The crown is processed in the same way, in bands of ``BAND`` levels: first all
   bands below the topmost at once, each by itself; then the tops of their
   pieces, as a much smaller tree; then all bands with what the pieces below
   them hold.  So a single conversation of any depth is spread over tasks too.

A node's ``ends`` digest streams over its sorted members: pieces of the list
are written where the sorted ranges lie, and joined in one digest a node.

Defined results: a row without conv_id belongs to no conversation; null roles
and texts are empty; rows of a conversation follow turn (null first), then
role, then text; repeated rows are turns of their own; extra columns are
ignored; an empty table gives an empty table.  Prefixes are told apart by 127
bits of hash and their depth.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import settle

PRIME = (1 << 127) - 1
RADIX = int.from_bytes(hashlib.blake2b(b"prefix radix", digest_size=15).digest(), "big") | 1
SHARD = 1 << 12         # prefixes in a shard, at most
BAND = 1 << 12          # levels of the crown that one task takes
HELD = 1 << 18          # messages of a queue in memory
CHUNK = 1 << 13         # ids of an ends list in one row
ROOT = bytes(16)


def _power(n: int) -> int:
    return pow(RADIX, n, PRIME)


def _int(b: bytes) -> int:
    return int.from_bytes(b, "big")


def _bytes(n: int) -> bytes:
    return n.to_bytes(16, "big")


def turn_hash(role: str, text: str) -> int:
    r = role.encode()
    return _int(hashlib.blake2b(b"%d:%b%b" % (len(r), r, text.encode()), digest_size=16).digest()) % PRIME


def numbered(chats: DataFrame) -> DataFrame:
    """``(conv_id, pos, key, pkey, size)``: every turn's place, the hashes of the
    conversation up to and before it, and its text's bytes.  Written."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "role"))
    rows = chats.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role, text)
    # the range's sample holds the beginning of texts only
    rows = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")

    def local(batches):
        part, conv, at, state = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            out = []
            for c, r, t in zip(*(b.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if c != conv:
                    conv, at, state = c, 0, 0
                before, at, state = state, at + 1, (state * RADIX + turn_hash(r, t)) % PRIME
                out.append((part, at, _bytes(state), _bytes(before), len(t.encode())))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(c, type=k) for c, k in zip(cols, kinds))], ["conv_id", "part", "at", "key", "pkey", "size"])

    cut = settle(rows.select("conv_id", "role", "text").mapInArrow(local, "conv_id bigint, part int, at bigint, key binary, pkey binary, size bigint"))
    ends = cut.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "at", "key")).alias("last")).orderBy("part").collect()
    carry: dict[int, tuple[int, int, int]] = {}
    conv, n, state = None, 0, 0
    for e in ends:
        if e.first == conv:
            carry[e.part] = (conv, n, state)
        if e.last.conv_id == conv:
            n, state = n + e.last["at"], (state * _power(e.last["at"]) + _int(e.last.key)) % PRIME
        else:
            conv, n, state = e.last.conv_id, e.last["at"], _int(e.last.key)

    def whole(batches):
        for b in batches:
            at, key, pkey = (b.column(c).to_pylist() for c in ("at", "key", "pkey"))
            for i, (c, p) in enumerate(zip(b.column("conv_id").to_pylist(), b.column("part").to_pylist())):
                conv, n, state = carry.get(p, (None, 0, 0))
                if c == conv:
                    shift = state * _power(at[i] - 1) % PRIME
                    pkey[i] = _bytes((shift + _int(pkey[i])) % PRIME)
                    key[i] = _bytes((shift * RADIX + _int(key[i])) % PRIME)
                    at[i] += n
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(at, type=pa.int64()), pa.array(key, type=pa.binary()), pa.array(pkey, type=pa.binary()),
                                              b.column("size")], ["conv_id", "pos", "key", "pkey", "size"])

    return settle(cut.mapInArrow(whole, "conv_id bigint, pos bigint, key binary, pkey binary, size bigint"))


def paths(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are: ``(conv_id, depth, key, pkey, size, len)``
    of every prefix but the empty one, and ``(conv_id, len)``."""
    rows = numbered(chats)
    lens = settle(rows.groupBy("conv_id").agg(F.max("pos").alias("len")))
    return rows.withColumnRenamed("pos", "depth").join(lens, "conv_id"), lens


def rebuilt(chats: DataFrame, base: F.Column, head: F.Column, most: int) -> tuple[DataFrame, DataFrame]:
    """As ``paths``, of conversations made of the first ``head`` (at most
    ``most``) turns of conversation ``base`` and their own turns after as many."""
    rows = numbered(chats)
    heads = rows.filter(F.col("pos") <= most)
    lens = rows.groupBy("conv_id").agg(F.max("pos").alias("own"))
    lens = settle(lens.withColumn("base", base).withColumn("h", head.cast("bigint")))
    at_base = heads.select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "key", "pkey", "size")
    begun = lens.join(at_base, "base").filter(F.col("depth") <= F.col("h"))
    begun = settle(begun.select("conv_id", "depth", "key", "pkey", "size"))
    took = begun.groupBy("conv_id").agg(F.max("depth").alias("took"), F.max(F.struct("depth", "key"))["key"].alias("there"))
    left = heads.join(lens.select("conv_id", "h"), "conv_id").filter(F.col("pos") == F.col("h")).select("conv_id", F.col("key").alias("here"))
    plan = (lens.join(took, "conv_id", "left").join(left, "conv_id", "left").select(
        "conv_id", "h", F.coalesce("took", F.lit(0)).alias("took"), "there", "here", (F.coalesce("took", F.lit(0)) + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")))
    plan = settle(plan)

    def moved(batches):
        for b in batches:
            key, pkey = [], []
            for n, k, p, there, here in zip(*(b.column(c).to_pylist() for c in ("n", "key", "pkey", "there", "here"))):
                shift = (_int(there or ROOT) - _int(here or ROOT)) * _power(n - 1) % PRIME
                pkey.append(_bytes((shift + _int(p)) % PRIME))
                key.append(_bytes((shift * RADIX + _int(k)) % PRIME))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("depth"), pa.array(key, type=pa.binary()), pa.array(pkey, type=pa.binary()),
                                              b.column("size"), b.column("len")], ["conv_id", "depth", "key", "pkey", "size", "len"])

    own = rows.join(plan, "conv_id").filter(F.col("pos") > F.col("h")).withColumn("n", F.col("pos") - F.col("h"))
    own = own.select("conv_id", (F.col("took") + F.col("n")).alias("depth"), "n", "key", "pkey", "there", "here", "size", "len")
    own = own.mapInArrow(moved, "conv_id bigint, depth bigint, key binary, pkey binary, size bigint, len bigint")
    return own.unionByName(begun.join(plan.select("conv_id", "len"), "conv_id")), plan.select("conv_id", "len")


class Queue:
    """A priority queue of ``(time, receiver, *amounts)`` that holds at most
    ``held`` messages in memory; what is more goes to sorted runs on disk."""

    def __init__(self, held: int):
        self.held, self.heap, self.runs, self.tie = held, [], [], itertools.count()
        self.spilled = 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) >= self.held:
            self._spill()

    def _spill(self) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        f = tempfile.TemporaryFile(dir=folder)     # no name: gone with the task, whatever ends it
        self.heap.sort()
        for at in range(0, len(self.heap), 1 << 10):
            pickle.dump(self.heap[at:at + (1 << 10)], f, pickle.HIGHEST_PROTOCOL)
        self.spilled += len(self.heap)
        self.heap = []
        f.seek(0)
        self._open(self._read(f))

    @staticmethod
    def _read(f) -> Iterator[tuple]:
        with f:
            while True:
                try:
                    yield from pickle.load(f)
                except EOFError:
                    return

    def _open(self, run: Iterator[tuple]) -> None:
        if (first := next(run, None)) is not None:
            heapq.heappush(self.runs, (first, next(self.tie), run))

    def take(self, time: int, receiver) -> tuple[int, int, int]:
        """The sums of all messages for a receiver, which is the least in time."""
        total = [0, 0, 0]
        while True:
            inner = self.heap[0] if self.heap else None
            outer = self.runs[0][0] if self.runs else None
            least = inner if outer is None or inner is not None and inner <= outer else outer
            if least is None or least[:2] != (time, receiver):
                return tuple(total)
            if least is inner:
                heapq.heappop(self.heap)
            else:
                _, _, run = heapq.heappop(self.runs)
                self._open(run)
            for k in range(3):
                total[k] += least[2 + k]


def forward(nodes: DataFrame, held: int) -> DataFrame:
    """``nodes`` has ``(shard, depth, key, pkey, stop, n, saved, leaves)``: ``n``
    and ``leaves`` and ``saved`` are what a node has before its children's
    messages; one with ``stop`` sends none.  Returns the rows with their totals
    (``leaves`` of a childless node is one)."""
    dealt = nodes.repartition("shard").sortWithinPartitions(F.desc("depth"), "key")

    def run(batches):
        queue = Queue(held)
        for b in batches:
            n, leaves, saved = [], [], []
            for depth, key, pkey, stop, n0, l0, s0 in zip(*(b.column(c).to_pylist() for c in ("depth", "key", "pkey", "stop", "n", "leaves", "saved"))):
                children, below, more = queue.take(-depth, key)
                n.append(n0 + children)
                leaves.append(l0 + below if n[-1] else 1)
                saved.append(s0 + more)
                if not stop:
                    queue.push((1 - depth, pkey, 1, leaves[-1], saved[-1]))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("depth", "key", "pkey", "stop")] + [pa.array(x, type=pa.int64()) for x in (n, leaves, saved)],
                                             ["depth", "key", "pkey", "stop", "n", "leaves", "saved"])

    cols = ("depth", "key", "pkey", "stop", "n", "leaves", "saved")
    return dealt.select(*cols).mapInArrow(run, "depth bigint, key binary, pkey binary, stop boolean, n bigint, leaves bigint, saved bigint")


def _sent(done: DataFrame, n: str = "count(1)", leaves: str = "sum(leaves)", saved: str = "sum(saved)") -> DataFrame:
    """What stopped nodes would send, by receiver."""
    return done.filter("stop").groupBy((F.col("depth") - 1).alias("depth"), F.col("pkey").alias("key")).agg(
        F.expr(n).alias("more_n"), F.expr(leaves).alias("more_leaves"), F.expr(saved).alias("more_saved"))


def _received(nodes: DataFrame, sent: DataFrame) -> DataFrame:
    got = nodes.join(sent, ["depth", "key"], "left")
    for c in ("n", "leaves", "saved"):
        got = got.withColumn(c, F.col(c) + F.coalesce(f"more_{c}", F.lit(0)))
    return got.drop("more_n", "more_leaves", "more_saved")


def totals(nodes: DataFrame, rows: DataFrame, shard: int, band: int, held: int) -> DataFrame:
    """``(depth, key, n, leaves, saved)`` of every node: children, childless
    nodes below and savings below, itself included."""
    none = F.lit(0).cast("bigint")
    own = nodes.select("depth", "key", "pkey", "conv_id", "weight", none.alias("n"), none.alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    high = (F.col("weight") > shard) | (F.col("depth") == 0)
    crown = settle(own.filter(high))
    # a conversation's first prefix outside the crown is the root of its shard
    marked = rows.select("conv_id", "depth", "key").join(crown.select("depth", "key", F.lit(True).alias("high")), ["depth", "key"], "left")
    top = marked.filter("high IS NULL").groupBy("conv_id").agg(F.min(F.struct("depth", "key")).alias("top"))
    light = own.filter(~high).join(top, "conv_id").select(
        F.xxhash64("top").alias("shard"), "depth", "key", "pkey", (F.col("depth") == F.col("top")["depth"]).alias("stop"), "n", "leaves", "saved")
    below = settle(forward(light, held))
    # the crown: bands below the topmost by themselves, then the tops of their
    # pieces, then all; a parent knows beforehand of children in the next band
    crown = _received(crown, _sent(below)).withColumn("shard", F.floor(F.col("depth") / band)).withColumn("stop", F.col("depth") % band == 0)
    crown = settle(crown)
    cols = ("shard", "depth", "key", "pkey", "stop", "n", "leaves", "saved")
    crown = settle(_received(crown, _sent(crown.filter("depth > 0"), leaves="0L", saved="0L")))
    pieces = forward(crown.filter("shard > 0").select(*cols), held).filter("stop").join(crown.select("depth", "key", "conv_id"), ["depth", "key"])
    pieces = settle(pieces)
    over = rows.select("conv_id", (F.col("depth") + band).alias("depth"), F.col("key").alias("over"))
    tree = settle(pieces.join(over, ["conv_id", "depth"], "left").select(
        F.lit(0).alias("shard"), (F.col("depth") / band).cast("bigint").alias("depth"), "key", F.col("over").alias("pkey"), (F.col("depth") == band).alias("stop"),
        F.lit(1).cast("bigint").alias("n"), "leaves", "saved", F.col("pkey").alias("parent")))
    whole = forward(tree.select(*cols), held).select("depth", "key", "leaves", "saved").join(tree.select("depth", "key", "parent"), ["depth", "key"])
    whole = whole.select((F.col("depth") * band).alias("depth"), F.col("parent").alias("pkey"), F.lit(True).alias("stop"), "leaves", "saved")
    done = settle(forward(_received(crown, _sent(whole, n="0L")).select(*cols), held))
    return below.select("depth", "key", "n", "leaves", "saved").union(done.select("depth", "key", "n", "leaves", "saved"))


def ends(rows: DataFrame, lens: DataFrame) -> DataFrame:
    """``(depth, key, ends_sha256)`` of the nodes at which conversations end."""
    last = rows.filter(F.col("depth") == F.col("len")).select("depth", "key", "conv_id").union(
        lens.filter("len = 0").select(F.lit(0).cast("bigint"), F.lit(ROOT), "conv_id"))
    spread = last.repartitionByRange("depth", "key", "conv_id").sortWithinPartitions("depth", "key", "conv_id")

    def lists(batches):
        for b in batches:
            out, node, ids = [], None, []
            for d, k, c in zip(*(b.column(x).to_pylist() for x in ("depth", "key", "conv_id"))):
                if (d, k) != node or len(ids) >= CHUNK:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = (d, k), []
                ids.append(c)
            if ids:
                out.append((*node, ids[0], ",".join(map(str, ids))))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.string()))], ["depth", "key", "first", "ids"])

    def digests(batches):
        node, sha, out = None, None, []
        for b in batches:
            for d, k, ids in zip(*(b.column(x).to_pylist() for x in ("depth", "key", "ids"))):
                if (d, k) != node:
                    if sha:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (d, k), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if len(out) > 1 << 13:
                yield batch(out)
                out = []
        if sha:
            out.append((*node, sha.hexdigest()))
        yield batch(out)

    def batch(out):
        cols = list(zip(*out)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.string()))], ["depth", "key", "ends_sha256"])

    parts = spread.mapInArrow(lists, "depth bigint, key binary, first bigint, ids string")
    return parts.repartition("depth", "key").sortWithinPartitions("depth", "key", "first").select("depth", "key", "ids").mapInArrow(
        digests, "depth bigint, key binary, ends_sha256 string")


def trie(rows: DataFrame, lens: DataFrame, shard: int = SHARD, band: int = BAND, held: int = HELD) -> DataFrame:
    """One row per distinct prefix of the conversations' ``paths``, the empty one
    included: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    rows = settle(rows)
    agg = (F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    nodes = rows.groupBy("depth", "key").agg(*agg, F.max("pkey").alias("pkey"), F.max("size").alias("size"), F.sum(F.col("len") - F.col("depth") + 1).alias("weight"))
    root = lens.agg(*agg, F.sum(F.col("len") + 1).alias("weight")).filter("n_convs > 0")
    nodes = settle(nodes.select("depth", "key", "conv_id", "n_convs", "pkey", "size", "weight").union(root.select(
        F.lit(0).cast("bigint"), F.lit(ROOT), "conv_id", "n_convs", F.lit(None).cast("binary"), F.lit(0).cast("bigint"), "weight")))
    sums = totals(nodes, rows, shard, band, held)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("pkey"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.select("depth", "key", "pkey", "conv_id", "n_convs").join(sums, ["depth", "key"]).join(ends(rows, lens), ["depth", "key"], "left")
            .join(parents, ["depth", "pkey"], "left").select(
                "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


def families(chats: DataFrame, of: int = 5, most: int = 8, **bounds: int) -> DataFrame:
    """The trie of conversations that share beginnings: conversation c begins
    with the first h turns of conversation ``c - c % of`` (SQL's remainder), and
    goes on with its own after as many; h is crc32(c) modulo ``most`` + 1."""
    c = F.col("conv_id")
    rows, lens = rebuilt(chats, c - c % of, F.crc32(c.cast("string").cast("binary")) % (most + 1), most)
    return trie(rows, settle(lens), **bounds)
