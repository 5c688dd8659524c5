"""Decontamination against a plain-Python scan and its SQL statement."""

import hashlib
import random
import re

from tidewater.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench, n=10):
    out = []
    for doc_id, text in docs:
        ws, hit, items = words(text), set(), set()
        for item, t in bench:
            g = words(t)
            k = min(n, len(g))
            grams = {tuple(g[i:i + k]) for i in range(len(g) - k + 1)} if k else set()
            for i in range(len(ws) - k + 1):
                if k and tuple(ws[i:i + k]) in grams:
                    hit.update(range(i, i + k))
                    items.add(item)
        ids = sorted(str(i) for i in items if i is not None)
        out.append((doc_id, len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, bench, n=10):
    d = spark.createDataFrame([(*x, "c", 1) for x in docs], "doc_id long, text string, key string, at int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(map(tuple, D.digests(D.report(d, b, n)).collect()), key=str)
    assert got == brute(docs, bench, n)
    kept = sorted(str(r.doc_id) for r in D.clean(d, b, n).collect())
    assert kept == sorted(str(x[0]) for x in got if not x[-1])
    assert D.clean(d, b, n).columns == d.columns


def test_random_small_alphabet(spark):
    r = random.Random(5)
    text = lambda k: " ".join(r.choice(["a", "B", "cé", "d,"]) for _ in range(k))
    docs = [(i, text(r.randint(0, 60))) for i in range(60)]
    check(spark, docs, [(i, text(r.randint(0, 9))) for i in range(12)], n=4)
    check(spark, docs, [(i, text(r.randint(5, 9))) for i in range(12)], n=4)


def test_odd_inputs(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, passage.upper()), (1, passage.upper()), (1, "other text"), (2, None), (3, ""), (None, "x " + passage),
            (4, "ÉCOLE é9 short item"), (5, "word " * 200000 + passage)]
    bench = [(10, passage), (2, passage), (7, "Short, ITEM"), (8, None), (9, "..."), (None, "é9")]
    check(spark, docs, bench)
    check(spark, docs, [])
    check(spark, [], bench)


def test_cut_takes_out_the_passage(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, f"Before, it. {passage}! After."), (2, "Clean text.  Stays"), (3, passage)], "doc_id long, text string")
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r.text for r in D.cut(d, b).collect()}
    assert got == {1: "Before, it. ! After.", 2: "Clean text.  Stays", 3: ""}
    assert D.report(D.cut(d, b), b).filter("contaminated").count() == 0


def test_shuffled_look_up(spark, monkeypatch):
    """A benchmark beyond the broadcast bound: the same results by the other
    path, which shuffles no texts with its windows."""
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    test_random_small_alphabet(spark)
    test_odd_inputs(spark)
    test_cut_takes_out_the_passage(spark)
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = D.scan(d, b)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()
