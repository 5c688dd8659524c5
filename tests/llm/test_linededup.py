"""Line dedup against a rule written out line by line: no hashes, no chosen
boundaries, every pair of neighbouring lines."""

import random
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import linededup as L


def repeats(docs):
    """Per document, the numbers of the lines (with words) that some earlier
    equal pair, or an equal long line, repeats."""
    seen, out = set(), {}
    for d, t in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = [x for x in (t or "").split("\n") if x.split()]
        gone = set()
        for i, x in enumerate(lines):
            pair = (lines[i - 1], x) if i else None
            if pair and sum(len(y.split()) for y in pair) >= L.LEAST_WORDS:
                gone |= {i - 1, i} if pair in seen else set()
                seen.add(pair)
            if len(x.split()) >= L.LONG:
                gone |= {i} if x in seen else set()
                seen.add(x)
        out[d] = (lines, gone)
    return out


def agree(docs, texts, share=0.9):
    """``texts``: what is left of each document.  Only repetitions go, nearly all
    of them go, and some occurrence of every line stays."""
    want, found, all_ = repeats(docs), 0, 0
    for d, text in texts.items():
        lines, gone = want[d]
        left = [x for x in text.split("\n") if x.split()]
        rest = iter(lines)
        assert all(any(x == y for y in rest) for x in left)                      # what is left stands in its order
        lost = Counter(lines) - Counter(left)
        assert not lost - Counter(lines[i] for i in gone)
        found, all_ = found + sum(lost.values()), all_ + len(gone)
    assert found >= share * all_
    kept = {x for text in texts.values() for x in text.split("\n")}
    assert all(x in kept for lines, _ in want.values() for x in lines)


def check(spark, docs):
    d = spark.createDataFrame([(*x, "k", 1) for x in docs], "doc_id long, text string, key string, at int")
    got = L.dedup(d).collect()
    assert len(got) == len(docs)
    agree(docs, {r.doc_id: r.text for r in got})
    for r in got:
        assert r.n_lines - r.n_removed == (len(r.text.split("\n")) if r.text or not r.n_removed else 0)
    left = L.apply(d)
    assert left.columns == d.columns
    empty = {r.doc_id for r in got if r.n_removed and not r.text}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(x[0]) for x in docs if x[0] not in empty)
    return {r.doc_id: r.text for r in got}


def test_driver_table(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def sentence(r, n=8):
    return " ".join(str(r.randrange(10 ** 6)) for _ in range(n))


@pytest.mark.parametrize("size", [2, 3, 4, 6, 12])
def test_recall_of_planted_passages(spark, size):
    """Passages of some lines, each in two documents at different places,
    with blank lines inside: the second occurrence goes whole."""
    r = random.Random(size)
    docs, passages = [], []
    for i in range(150):
        p = [sentence(r) for _ in range(size)]
        passages.append(p)
        for k in range(2):
            around = [[sentence(r) for _ in range(r.randint(0, 4))] for _ in range(2)]
            docs.append((2 * i + k, "\n".join([*around[0], *("\n".join(p[:2]), "", *p[2:]), *around[1]])))
    got = check(spark, docs)
    whole = sum(not set(p) & set(got[2 * i + 1].split("\n")) for i, p in enumerate(passages))
    lines = sum(len(set(p) - set(got[2 * i + 1].split("\n"))) for i, p in enumerate(passages)) / (150 * size)
    assert lines >= 0.9 and (size == 2 or lines >= 0.97) and whole >= 0.85 * 150
    assert all(set(p) <= set(got[2 * i].split("\n")) for i, p in enumerate(passages))


def test_long_lines_and_hot_passages(spark):
    r = random.Random(2)
    passage = "\n".join(sentence(r) for _ in range(12))
    one = " ".join(f"p{i}" for i in range(60))
    docs = [(i, "\n".join([*[sentence(r) for _ in range(r.randint(0, 5))], passage, sentence(r), one, sentence(r)])) for i in range(60)]
    got = check(spark, docs)
    assert one in got[0] and passage in got[0]
    for i in range(1, 60):
        assert one not in got[i] and not any(x in got[i] for x in passage.split("\n"))


def test_odd_inputs(spark):
    long = "\n".join(f"line {i} of a long text with some words" for i in range(30000))
    same = "\n".join(["one line that stands here again and again"] * 5)
    check(spark, [(1, None), (2, ""), (2, ""), (3, "\n\n\n"), (4, long), (5, long), (5, long), (None, "a b\nc d\ne f"), (6, "é\r\nx\n"), (7, "a b\nc d\ne f"),
                  (8, same), (9, same + "\n\nend of it"), (10, "\n \n" + same), (11, "yes\nno"), (12, "yes\nno")])
    check(spark, [])


def test_boundaries_move_with_their_lines():
    r = np.random.default_rng(1)
    h = r.integers(0, 2**63, 400, dtype=np.uint64)
    roll, cut = L.boundaries(h)
    more = L.boundaries(np.r_[r.integers(0, 2**63, 7, dtype=np.uint64), h])
    assert (more[0][7:] == roll).all() and (more[1][7:] == cut).all() and 0.85 < cut.mean() < 1
    assert len(L.boundaries(h[:1])[0]) == 0
