"""Alignment of two tokenizers against a plain set of common ends."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm import align as A

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """Groups by the set of common ends, links one by one."""
    t = Tokenizer.from_file(PATHS[0])
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    rows, count = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        want = (" " + text).encode()
        a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        plain = {c: v for v, c in enumerate(A.byte_symbols())}
        pa = [bytes(plain[c] for c in t.id_to_token(i)) for i in a]
        pb = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
        if b"".join(pa) != want or b"".join(pb) != want:
            rows.append(None)
            continue
        ends = [set(), set()]
        for k, ps in enumerate((pa, pb)):
            n = 0
            for p in ps:
                n += len(p)
                ends[k].add(n)
        both = sorted(ends[0] & ends[1])
        groups, at, i, j, n, m = [], 0, 0, 0, 0, 0
        for e in both:
            g = ([], [])
            while n < e:
                n += len(pa[i])
                g[0].append(a[i])
                i += 1
            while m < e:
                m += len(pb[j])
                g[1].append(b[j])
                j += 1
            groups.append(g)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        count.update(links.keys())
        rows.append((len(a), len(b), groups, links))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, groups, links = r
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((na, nb, len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == top[p[0]]),
                    sum(n * count[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


def check(spark, texts):
    rows = [(k, t, "x", 7) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keys string, n_a int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in A.alignment(df, *PATHS).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


ODD = [None, "", " ", "  two  spaces ", "a▁b", "tab\tand\nline\r\n", "<|endoftext|> </s> <s> <unk> <0x41>", "﻿bom   nbsp", "日本語のテキスト と emoji 👩‍👩‍👧 🇫🇷",
       "é combining", "‮ rtl \u0000 nul", "same text", "same text", "x" * 5000, " " * 3000, "1234567890" * 300, "word " * 20000, "ÀÉÎİßﬁ", "a" + " " * 12000 + "b" + "\n" * 11000 + "<|endoftext|>"]


def test_odd_texts(spark):
    check(spark, ODD)


def test_documents_rare_pairs_and_spilled_counts(spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    check(spark, texts)
    # few hot pairs, small tables, links listed in parts: the same result
    seen = A.HOT, A.COUNTED, A.PAIRS
    monkeypatch.setattr(A, "HOT", 40)
    rows = A.aligned(A.id_text(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), "doc_id", "text"), *PATHS)
    width = len(A.side(A.piece_level, PATHS[1]).pieces)
    got = {r.doc_id: tuple(r)[1:] for r in A.weighed(rows, A.pair_counts(rows, width), False).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts) and seen[0] > 40


def test_bounded_steps(monkeypatch):
    """Small bounds on listed links and held counts change nothing."""
    import numpy as np
    r = np.random.default_rng(3)
    for _ in range(30):
        total = int(r.integers(1, 400))
        ends = [np.unique(np.r_[r.integers(1, total + 1, int(r.integers(1, 60))), total]) for _ in range(2)]
        ida, idb = (r.integers(0, 9, len(e)) for e in ends)
        a0, b0 = np.array([0, len(ida)]), np.array([0, len(idb)])
        g = A.leaf_groups(*ends, a0, b0)
        both = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        assert ends[0][g[1] - 1].tolist() == both == ends[1][g[3] - 1].tolist()
        doc = np.zeros(len(g[0]), dtype=np.int64)
        want = Counter(int(x) * 9 + int(y) for p, q, u, v in zip(*g) for x in ida[p:q] for y in idb[u:v])
        for bound in (1 << 20, 7, 1):
            monkeypatch.setattr(A, "PAIRS", bound)
            d, k, t = A.group_links(ida, idb, doc, g, 9)
            assert dict(zip(k.tolist(), t.tolist())) == want
    monkeypatch.setattr(A, "COUNTED", 5)
    c, out = A.PairCounts(), Counter()
    for _ in range(9):
        for k, n in c.add(np.unique(r.integers(0, 30, 6))):
            out.update(dict(zip(k.tolist(), n.tolist())))
    for k, n in c.rest():
        out.update(dict(zip(k.tolist(), n.tolist())))
    assert sum(out.values()) > 20


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, "one")], "doc_id long, text string")
    got = A.alignment(df, *PATHS).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [r.doc_id for r in got] == [None, None, 3] and got[0].n_links == got[0].n_best and got[0].count_sum == got[1].count_sum == 5
    assert A.alignment(df.limit(0), *PATHS).collect() == []
    assert A.groups_of("one two", *PATHS)
