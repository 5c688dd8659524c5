"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline as C
from test_decontam import brute as contaminated
from test_linededup import agree
from test_neardup import brute as grouped

from tidewater.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    cols, before, stages = docs.columns, None, dict(C.STAGES)
    for name in ("quality_classifier", "line_dedup", "near_dedup", "decontamination", "bpe_encoding"):
        rows = {r.doc_id: r.text for r in docs.collect()}
        got = stages[name](spark, docs, SF)
        after = {r.doc_id: r for r in got.collect()}
        if name == "quality_classifier":
            bad = {r.doc_id for r in quality.classify(docs, labels).collect() if r.score < quality.THRESHOLD}
            assert bad and set(after) == set(rows) - bad
        elif name == "line_dedup":
            agree(list(rows.items()), {d: after[d].text if d in after else "" for d in rows})
            assert all(r.text or not rows[d] for d, r in after.items())
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near_dedup":
            assert set(after) == {d for d, _, _, kept in grouped(list(rows.items()), 5, 80) if kept}
        elif name == "decontamination":
            assert set(after) == {x[0] for x in contaminated(list(rows.items()), bench) if not x[-1]}
        else:
            assert got.columns == ["doc_id", "ids", "n_tokens"] and set(after) == set(rows)
            assert all(len(r.ids) == r.n_tokens for r in after.values())
            break
        assert got.columns == cols and len(after) < len(rows) + (name != "quality_classifier")
        docs = spark.createDataFrame(got.collect(), docs.schema)
        before = set(after)
    assert {r.doc_id for r in C.run(spark, SF).collect()} == before


def test_odd_rows_through_all_stages(spark):
    """Null ids and texts, repeated ids, empty and long texts: no stage fails,
    each keeps the columns and adds no row; an empty table stays empty."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = docs.orderBy("doc_id").limit(40).collect()
    names = docs.columns

    def row(i, text):
        return tuple({"doc_id": i, "text": text, "n_chars": None if text is None else len(text)}.get(c, "en" if c == "lang" else None) for c in names)

    odd = [row(None, None), row(None, plain[0].text), row(None, plain[0].text), row(1, ""), row(1, plain[1].text), row(10**9, "a text of its own " * 3), row(10**9, None),
           row(10**9 + 1, "word " * 50_000), row(10**9 + 2, "line\n" * 5_000), row(10**9 + 3, " \n\t ")]
    table = spark.createDataFrame([tuple(r) for r in plain] + odd, docs.schema)
    for name, stage in C.STAGES:
        got = stage(spark, table, SF)
        rows = got.collect()
        assert len(rows) <= table.count()
        if name == "bpe_encoding":
            assert len(rows) == table.count()
            break
        assert got.columns == names
        table = spark.createDataFrame(rows, docs.schema)
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in C.STAGES:
        assert stage(spark, empty, SF).collect() == []
