"""The quality classifier: held-out accuracy, exact moments, odd inputs."""

import numpy as np

from tidewater.llm import quality as Q

SF = "/root/testdata/sf0.01"


def tables(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    got = Q.classify(docs, labels)
    assert got.count() == docs.count()
    df = got.join(labels, "doc_id").filter("held_out").toPandas()
    assert len(df) > 50
    assert (df.predicted == df.quality).mean() > 0.97
    assert df.score.between(0, 1).all()


def test_held_out_labels_are_not_used(spark):
    docs, labels = tables(spark)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a = {r.doc_id: r.score for r in Q.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in Q.classify(docs, turned).collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_moments_equal_brute_force(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.001")
    feats = Q.features(docs)
    train = feats.join(labels.selectExpr("doc_id", "quality AS y"), "doc_id")
    rows = train.collect()
    got = {(r.y, r.pos): r.total for r in Q.moments(train).collect()}
    for c in (0, 1):
        x = np.array([r.x for r in rows if r.y == c])
        want = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        assert np.allclose([got[c, k] for k in range(len(want))], want)


def test_score_is_the_density_difference():
    r = np.random.default_rng(0)
    x = {c: r.normal(c, 1 + c, (200, Q.D)) for c in (0, 1)}
    m = Q.Model({c: np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()]) for c, v in x.items()}, alpha=0, gamma=0)
    q = r.normal(0.5, 1, (5, Q.D))
    dens = {}
    for c, v in x.items():
        d, cov = q - v.mean(0), np.cov(v.T, bias=True)
        dens[c] = -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(-(dens[1] - dens[0]) / Q.TEMPERATURE))
    assert np.allclose(m.score(q), want, atol=1e-6)


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    good = [f"A sentence number {i} that reads like any other one, with words and a stop." for i in range(12)]
    junk = [f"$$ ## {i} @@ %% ^^ ** !! {i * 7} <> == ++" for i in range(12)]
    rows = [(i, t) for i, t in enumerate(good + junk)]
    labels = spark.createDataFrame([(i, int(i < 12)) for i in range(24)], "doc_id long, quality int")
    odd = [(None, good[0]), (None, junk[0]), (100, good[1]), (100, junk[1])]
    left = [tuple(r) for r in Q.keep(spark.createDataFrame(rows + odd, "doc_id long, text string"), labels).collect()]
    assert sorted(left, key=str) == sorted([x for x in rows + odd if x[1] in good], key=str)


def test_odd_inputs(spark):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "b"), (None, "Some words here.", "c"), (4, "x" * 300000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    got = Q.classify(docs, none).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 0 for r in got)
    assert {r.doc_id: r.held_out for r in got}[None] is False
    one = spark.createDataFrame([(d, 1) for d in (1, 2, 4)], "doc_id long, quality int")
    assert all(0.5 < r.score < 1 for r in Q.classify(docs, one).collect())
    assert Q.classify(docs.limit(0), one).collect() == []
    both = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (2, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in Q.classify(docs, both).collect())
