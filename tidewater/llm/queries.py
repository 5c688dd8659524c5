"""The operators bound to the driver tables, each over its whole table.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``ORACLE`` holds
DuckDB statements where SQL can express the result.  The other operators are
compared with brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import align, bpe, chat, decontam, htmltext, lengths, linededup, neardup, pii, prefixtrie, quality, topk, vecgraph
from tidewater.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_report(table(spark, sf_dir, "documents"), vocabulary_path())


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLE["op4_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, ws[i:i + least(len(ws), 10) - 1] AS gram
          FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT k FROM grams),
wins AS (SELECT doc_id, k, i, ws[i:i + k - 1] AS gram FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes WHERE len(ws) >= k)),
hits AS (SELECT doc_id, w.k, i, item_id FROM wins w JOIN grams g ON w.k = g.k AND w.gram = g.gram),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS list
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), k=3, percent=85)


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(table(spark, sf_dir, "documents"))


@query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("""SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '</s>[INST] ok [/INST]' AS text
                         FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)""")
    return chat.digests(chat.windows(chats.unionByName(extra)))


@query
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


ORACLE["op7_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.spans(table(spark, sf_dir, "documents")))


@query
def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecgraph.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


ORACLE["op11_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS r, b.r AS s FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT r, r AS s FROM v UNION SELECT reach.r, links.s FROM reach JOIN links ON reach.s = links.r),
comp AS (SELECT reach.r, min(w.vec_id) AS component_id FROM reach JOIN v w ON reach.s = w.r GROUP BY reach.r)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(v.vec_id = component_id, false) AS kept
FROM v JOIN comp USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM links GROUP BY r) USING (r)
"""


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.families(table(spark, sf_dir, "conversations"))


# prefixes as strings of turns with their lengths in front; a node's ancestors
# lie on its smallest member's path
ORACLE["op13_prefix_trie"] = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 5 AS base, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
              lambda s, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END + k, xor(s, b)),
              CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h
          FROM (SELECT DISTINCT c FROM t)),
begun AS (SELECT convs.c, b.pos AS depth, role, text FROM convs JOIN t b ON b.c = base AND b.pos <= h),
took AS (SELECT convs.c, h, count(depth) AS n FROM convs LEFT JOIN begun USING (c) GROUP BY convs.c, h),
turns AS (SELECT * FROM begun UNION ALL SELECT t.c, n + pos - h, role, text FROM t JOIN took USING (c) WHERE pos > h),
paths AS (SELECT c, depth, strlen(text) AS size,
                 string_agg(len(role) || ':' || role || len(text) || ':' || text, '' ORDER BY depth) OVER (PARTITION BY c ORDER BY depth) AS p FROM turns
          UNION ALL SELECT c, 0, 0, '' FROM convs),
lens AS (SELECT c, max(depth) AS n FROM paths GROUP BY c),
nodes AS (SELECT depth, p, min(c) AS conv_id, count(*) AS n_convs, max(size) AS size,
                 coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = depth), '') AS ends FROM paths JOIN lens USING (c) GROUP BY depth, p),
up AS (SELECT s.depth, s.p, q.p AS over FROM nodes s JOIN paths q ON q.c = s.conv_id AND q.depth = s.depth - 1),
kids AS (SELECT over AS p, depth - 1 AS depth, count(*) AS n FROM up GROUP BY over, depth),
below AS (SELECT q.depth, q.p, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((n_convs - 1) * s.size) AS saved
          FROM nodes s JOIN paths q ON q.c = s.conv_id AND q.depth <= s.depth LEFT JOIN kids ON kids.p = s.p AND kids.depth = s.depth GROUP BY q.depth, q.p)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, x.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x JOIN below USING (depth, p) LEFT JOIN kids USING (depth, p) LEFT JOIN up USING (depth, p)
LEFT JOIN nodes o ON o.p = up.over AND o.depth = x.depth - 1
"""


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go, and documents of which nothing is left."""
    kept = linededup.apply(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.keep_one(docs, k=5, percent=80)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_tokens)`` of what is left."""
    return bpe.encode(docs, vocabulary_path())
