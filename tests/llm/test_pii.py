"""Base spans against Python's regular expressions, and the added spans."""

import functools
import hashlib
import random
import re

import regex

from tidewater.llm import pii as P

PAT = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        t = [int(c) * (1 + i % 2) for i, c in enumerate(d[::-1])]
        return 13 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in t) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


# A local part or a number ends where its run of characters ends, so a match
# that fails at the run's start (or where the search went on inside it) fails
# everywhere in the run: tried once a run, the patterns are linear.
ONCE = {"email": r"(?:(?<![A-Za-z0-9._%+-])|\G)" + PAT["email"], "ip": "(?<![0-9])" + PAT["ip"]}


@functools.cache
def brute(text):
    return [(k, m.start(), m.end()) for k, p in PAT.items() for m in regex.finditer(ONCE.get(k, p), text or "") if good(k, m.group())]


def check(spark, docs):
    df = spark.createDataFrame([(*x, "s", 0) for x in docs], "doc_id long, text string, spans string, start int")
    got = P.digests(P.spans(df)).collect()
    assert len(got) == len(docs)
    want = sorted(((d, *(sum(s[0] == k for s in brute(t)) for k in PAT), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(t)).encode()).hexdigest())
                   for d, t in docs), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    for r in got:
        text = next(t for d, t in docs if d == r.doc_id) or ""
        assert {f"{k}:{a}:{b}" for k, a, b in brute(text)} <= set(r.spans.split(",") if r.spans else []) or sum(d == r.doc_id for d, _ in docs) > 1
    return {r.doc_id: r.spans for r in got}


def test_driver_table(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()])


def test_random_strings(spark):
    r = random.Random(9)
    parts = ["a@b.com", "_", "@", ".", "1.2.3.4", "255.256.1.1", ".5", "4111 1111 1111 1111", "0", "12", "+1 (555) 010-99", "+", " ", "-", "é", "\ue000", "x", "(", ")", "000", "%"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    for t in texts:
        assert brute(t) == [(k, m.start(), m.end()) for k, p in PAT.items() for m in re.finditer(p, t) if good(k, m.group())]
    check(spark, list(enumerate(texts)))


def test_odd_inputs(spark):
    token = 'my token = "abe29cfcdae4f03e1e339fcaa4c5bb04d43d9331" end'
    docs = [(1, None), (2, ""), (3, "x@y.z"), (3, "x@y.z"), (3, "1.1.1.1"), (None, "call +1 (555) 010-9999"), (4, token), (5, "a" * 300000), (6, "1" * 100000),
            (7, "1.2.3.4 " * 20000), (8, "@" * 1000 + "a.b" * 20000), (9, "+1" * 20000), (10, "word " * 100000 + "a@b.co")]
    got = check(spark, docs)
    assert got[4].startswith("secret:") and got[5] == "" and got[2] == ""
    check(spark, [])


def test_mask(spark):
    df = spark.createDataFrame([(1, "mail é x@y.org, ip 1.2.3.4!", 5), (2, "clean", None), (3, None, 1)], "doc_id long, text string, extra int")
    got = {r.doc_id: r.text for r in P.mask(df).collect()}
    assert got == {1: "mail é <EMAIL>, ip <IP>!", 2: "clean", 3: None}


def test_em_finds_reliable_labelers(spark):
    r = random.Random(1)
    rows = []
    for _ in range(4000):
        y = r.random() < 0.3
        say = lambda acc: str(int(y if r.random() < acc else not y))
        rows.append(("secret", say(0.95) + say(0.9) + "-" + say(0.85) + say(0.55), y))
    df = spark.createDataFrame([x[:2] for x in rows], "kind string, votes string")
    post = P.reliabilities(df)["secret"]
    assert sum((post[v] >= 0.5) == y for _, v, y in rows) / len(rows) > 0.95


def test_classifier_learns_from_posteriors_and_traits(spark):
    """Labelers that err often; the span's length tells true ones apart, and
    the classifier makes use of it where the votes alone cannot."""
    r = random.Random(3)
    rows = []
    for _ in range(6000):
        y = r.random() < 0.4
        say = lambda acc: str(int(y if r.random() < acc else not y))
        rows.append(("secret", say(0.8) + say(0.75) + "-" + say(0.7) + "-", ("5" if r.random() < 0.95 else "3") + "20" if y else ("3" if r.random() < 0.95 else "5") + "20", y))
    df = spark.createDataFrame([x[:3] for x in rows], "kind string, votes string, traits string")
    post = P.reliabilities(df)
    w = P.classifier(df, post)["secret"]
    got = {(x.votes, x.traits): x.p for x in df.distinct().withColumn("p", P.score(w, post["secret"])).collect()}
    by_votes = sum((post["secret"][v] >= 0.5) == y for _, v, _, y in rows) / len(rows)
    by_model = sum((got[v, t] >= 0.5) == y for _, v, t, y in rows) / len(rows)
    assert by_model > by_votes + 0.02, (by_model, by_votes)


def test_added_spans_found_and_left_alone(spark):
    """Recall and precision of the added kinds on texts whose spans are known."""
    r = random.Random(11)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    docs, want = [], {"secret": set(), "name": set()}
    for i in range(400):
        kind = i % 4
        value = {0: hexes(r.choice([32, 40])), 1: r.choice(P.GIVEN[:60]) + " " + r.choice(["Miller", "Lopez", "Schmidt"]), 2: r.choice(["The", "This", "Your"]), 3: "x" * r.randrange(20, 24)}[kind]
        lead = {0: 'my token = "', 1: "contact Dr. ", 2: "Dr. ", 3: "key = "}[kind]
        text = f"word {i} " + lead + value + (" wrote" if kind in (1, 2) else '" end')
        at = text.index(value, len(f"word {i} " + lead) - 1)
        if kind < 2:
            want["secret" if kind == 0 else "name"].add(f"{i}:{at}:{at + len(value)}")
        docs.append((i, text))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {"secret": set(), "name": set()}
    for x in P.spans(df).collect():
        for s in x.spans:
            if s["kind"] in got:
                got[s["kind"]].add(f"{x.doc_id}:{s['start']}:{s['end']}")
    for k in got:
        assert len(got[k] & want[k]) >= 0.95 * len(want[k]) and len(got[k] & want[k]) >= 0.95 * len(got[k]), (k, len(got[k]), len(want[k]))
