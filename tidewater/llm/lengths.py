"""Token counts: one exact histogram of encoded lengths answers every limit.

Documents are encoded and counted per length; what is shuffled is one row per
length and task.  Suffix sums over the lengths then give, for every context
limit, how many documents are at least that long and how many tokens remain if
each is cut to the limit.  The sums are taken within blocks of ``BLOCK``
lengths and over the block totals, so no window holds more than a block of
lengths or one row per block.

Defined results: a null or empty text has length 0; repeated rows count each;
an empty table gives an empty histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm import bpe
from tidewater.llm.common import settle

BLOCK = 1024


def histogram(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(length, n_docs)`` over all documents."""
    counts = bpe.token_counts(docs, path, id_col, text_col)
    return counts.groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length ``L``: ``n_docs`` of exactly L, ``docs_at_least`` and
    ``tokens_at_least`` of length L or more, ``docs_total``, ``tokens_total``,
    ``truncated_total`` (tokens left if every document is cut to L) and
    ``share_within`` (documents of at most L: the quantile that L answers)."""
    h = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"),
                    F.floor(F.col("length") / BLOCK).alias("block"))
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = (h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
              .select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"),
                      F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
                      F.sum("d").over(W.partitionBy()).alias("docs_total"), F.sum("t").over(W.partitionBy()).alias("tokens_total")))
    own = W.partitionBy("block").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, 0)
    s = (h.withColumn("d", F.sum("n_docs").over(own)).withColumn("t", F.sum("tokens").over(own)).join(blocks, "block")
         .withColumn("docs_at_least", F.col("d") + F.col("docs_after"))
         .withColumn("tokens_at_least", F.col("t") + F.col("tokens_after")))
    return s.select(
        "length", "n_docs", "docs_at_least", "tokens_at_least", "docs_total", "tokens_total",
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_total")).alias("share_within"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, length)``: the smallest length within which at least that
    share of the documents lies."""
    ask = F.explode(F.array(*[F.lit(float(q)) for q in shares])).alias("share")
    return (sums.select("length", "share_within", ask).filter(F.col("share_within") >= F.col("share"))
            .groupBy("share").agg(F.min("length").alias("length")))


def truncated(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``(limit, truncated_total)`` for any limits, seen lengths or not: the
    first length at or above the limit has all that the sum needs."""
    ask = F.explode(F.array(*[F.lit(int(c)).cast("long") for c in limits])).alias("limit")
    at = (sums.select(ask, "length", "docs_at_least", "tokens_at_least", "tokens_total")
          .groupBy("limit", "tokens_total")
          .agg(F.min(F.when(F.col("length") >= F.col("limit"), F.struct("length", "docs_at_least", "tokens_at_least"))).alias("n")))
    return at.select("limit", F.coalesce(F.col("tokens_total") - F.col("n.tokens_at_least") + F.col("limit") * F.col("n.docs_at_least"),
                                         F.col("tokens_total")).alias("truncated_total"))


def length_report(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    # the sums read the histogram twice; the texts are encoded once
    return suffix_sums(settle(histogram(docs, path, id_col, text_col)))
