"""The length histogram and its answers against brute force."""

import public_tokenizers
from tokenizers import Tokenizer

from tidewater.llm import lengths as L

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_every_limit_and_quantile(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    t = Tokenizer.from_file(PATH)
    n = sorted(len(t.encode(r.text, add_special_tokens=False).ids) for r in docs.collect())
    sums = L.length_report(docs, PATH).cache()
    got = {r["length"]: r for r in sums.collect()}
    assert set(got) == set(n)
    for k, r in got.items():
        assert r.n_docs == n.count(k)
        assert r.docs_at_least == sum(x >= k for x in n)
        assert r.tokens_at_least == sum(x for x in n if x >= k)
        assert (r.docs_total, r.tokens_total) == (len(n), sum(n))
        assert r.truncated_total == sum(min(x, k) for x in n)
        assert abs(r.share_within - sum(x <= k for x in n) / len(n)) < 1e-12
    limits = [0, 1, 100, 555, 2048, 10**6]
    assert {r.limit: r.truncated_total for r in L.truncated(sums, limits).collect()} == {c: sum(min(x, c) for x in n) for c in limits}
    q = {r.share: r.length for r in L.quantiles(sums, [0.01, 0.5, 0.9, 1.0]).collect()}
    assert q == {s: min(k for k in n if sum(x <= k for x in n) / len(n) >= s) for s in q}
    sums.unpersist()


def test_odd_inputs(spark):
    rows = [(1, None, 1), (1, None, 2), (2, "", 3), (None, "one two", 4), (5, "word " * 30000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = {r["length"]: (r.n_docs, r.docs_at_least, r.truncated_total) for r in L.length_report(docs, PATH).collect()}
    assert got == {0: (3, 5, 0), 2: (1, 2, 4), 30000: (1, 1, 30002)}
    assert L.length_report(docs.limit(0), PATH).collect() == []
