"""The prefix trie against a dictionary of prefixes."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import prefixtrie as P


def truncated(a, n):
    return int(np.fmod(a, n))


def rebuild(rows, of=5, most=8):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        out[c] = own.get(c - truncated(c, of), [])[:h] + v[h:]
    return out


def brute(chats):
    if not chats:
        return []
    members = defaultdict(list)
    for c in sorted(chats):
        for d in range(len(chats[c]) + 1):
            members[tuple(chats[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in m if len(chats[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int").repartition(4)


def check(spark, rows, **bounds):
    got = sorted(map(tuple, P.families(frame(spark, rows), **bounds).collect()))
    assert got == brute(rebuild(rows))


def talk(r, n, hot=True):
    """Conversations that share beginnings, some of them whole."""
    rows = []
    for c in range(n):
        kind = int(r.integers(0, 4))
        length = int(r.integers(1, 9))
        for t in range(length):
            text = "same first" if hot and kind < 2 and t < 3 else f"word {int(r.integers(0, 3))} é"
            rows.append((c * int(1 + kind // 3) + 3, t, "user" if t % 2 else "assistant", text))
    return rows


ODD = [(None, 1, "user", "no conversation"), (1, None, "user", "null turn"), (1, 1, None, "null role"), (1, 2, "user", None), (1, 2, "user", "tie"), (1, 2, "user", "tie"),
       (-7, 0, "user", "</s>"), (-7, 1, "assistant", "</s>"), (-5, 0, "user", "</s>"), (2**40 + 1, 0, "", ""), (10, 3, "user", "x" * 100_000), (11, 0, "us", "er"), (12, 0, "user", ""),
       (11, 5, "user", "日本語"), (13, 1, "user", "a"), (14, 1, "user", "a"), (10, 3, "user", "x" * 100_000)]


def test_odd_rows(spark):
    check(spark, ODD)
    check(spark, [(1, 0, "user", "one")])
    assert P.families(frame(spark, []).filter("false")).collect() == []


def test_shards_bands_and_spilled_queues(spark):
    rows = talk(np.random.default_rng(5), 120)
    check(spark, rows)
    check(spark, rows, shard=6, band=2, held=3)
    check(spark, rows, shard=25, band=3, held=2)
    # a long conversation over many bands, and many copies of one
    long = [(7, t, "user", f"turn {t}") for t in range(150)] + [(9, t, "user", f"turn {t}") for t in range(90)]
    copies = [(c, t, "user", f"copy {t}") for c in range(100, 260) for t in range(4)]
    check(spark, long + copies, shard=10, band=4, held=5)


def test_conversations_cut_by_ranges(spark):
    """Positions and running hashes hold across partitions of a hot conversation."""
    rows = [(5, t % 40 if t % 3 else None, "user", f"t{t % 7}") for t in range(400)] + [(4, 0, "user", "a"), (6, 0, "user", "b")]
    got = P.numbered(frame(spark, rows))
    assert got.filter("conv_id = 5").agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first() == (1, 400, 400)
    want = sorted((t is not None, t or 0, r, x) for c, t, r, x in rows if c == 5)
    state = 0
    keys = {0: P.ROOT}
    for k, w in enumerate(want):
        state = (state * P.RADIX + P.turn_hash(*w[2:])) % P.PRIME
        keys[k + 1] = state.to_bytes(16, "big")
    for r in got.filter("conv_id = 5").collect():
        assert bytes(r.key) == keys[r.pos] and bytes(r.pkey) == keys[r.pos - 1]


def test_plain_paths_and_queue(spark):
    rows = talk(np.random.default_rng(9), 40)
    own = defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((t, r, x))
    assert sorted(map(tuple, P.trie(*P.paths(frame(spark, rows))).collect())) == brute({c: [t[1:] for t in sorted(v)] for c, v in own.items()})
    q, r = P.Queue(8), np.random.default_rng(1)
    sent = [(int(a), bytes([b]), 1, int(v), 2) for a, b, v in r.integers(0, 9, (500, 3))]
    for m in sent:
        q.push(m)
    assert q.spilled >= 480
    for at in sorted({m[:2] for m in sent}):
        assert q.take(*at) == tuple(sum(m[k] for m in sent if m[:2] == at) for k in (2, 3, 4))
