"""Benchmark decontamination with a broadcast set of word n-grams.

Texts are normalised (A-Z lower-cased) and cut into words.  Every benchmark
item gives its windows of ``n`` consecutive words (an item of fewer words is
one window); their hashes form a set that is broadcast.  Documents hash all
their windows of the lengths that occur and look each one up; a hit is verified
by comparing the words themselves, and the words that verified hits cover are
marked.  Only DataFrame functions are used.

The broadcast side is the benchmark's distinct windows.  Its size is measured
first; beyond ``BROADCAST_BYTES`` the look-up is a shuffled join of window hashes
alone, and only its few candidates meet their texts again to be verified.

Defined results: a null or empty text has no words and is clean; an item
without words has no window; repeated items share a window and are each
reported; repeated rows each get their own result; a null item_id takes part in
hits but is left out of the list of items; other columns are ignored by
``scan``, ``report`` and ``cut`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import id_text, settle

N = 10
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text) -> F.Column:
    """Lower-cased words of a text."""
    cut = F.split(F.translate(text, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(cut, lambda w: w != "")


def windows(ws, k: int) -> F.Column:
    """Hashes of all windows of ``k`` words, in order."""
    return F.when(F.size(ws) >= k, F.transform(F.sequence(F.lit(1), F.size(ws) - (k - 1)),
                                               lambda i: F.xxhash64(F.slice(ws, i, F.lit(k)))))


def benchmark_windows(bench: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(k, gram, items)``: each distinct window once, with its items."""
    b = bench.select(F.col(id_col).cast("string").alias("item"), words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("ws"))
    b = b.filter(F.size("ws") > 0).withColumn("k", F.least(F.size("ws"), F.lit(n)))
    grams = b.select("item", "k", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("ws") - F.col("k") + 1), lambda i: F.slice(F.col("ws"), i, F.col("k")))).alias("gram"))
    return grams.groupBy("k", "gram").agg(F.collect_set("item").alias("items"))


SCAN = "array<struct<at:int,a:int,h:bigint>>"


def _placed(hashes, k: int) -> F.Column:
    return F.transform(hashes, lambda h, i: F.struct((i + 1).alias("at"), F.lit(k).alias("a"), h.alias("h"))).cast(SCAN)


def scan(docs: DataFrame, bench: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, key, n_words, at, k, items)``: one row per document row with
    ``at`` 0 and its word count, and one per verified hit (words from 1).
    ``key`` tells different texts under one doc_id apart.

    Windows are looked up by the hash of their first ``a`` words: all ``n`` of
    a full window, and for the items of fewer words as many as the shortest
    has, so that two scans of a text serve every length.
    """
    grams = settle(benchmark_windows(bench, n))
    # one row: the size of the set, and the shortest window
    known = grams.agg(F.sum(F.length(F.array_join("gram", " ")) + F.length(F.array_join("items", " ")) + 64).alias("b"),
                      F.min(F.when(F.col("k") < n, F.col("k"))).alias("short"), F.max("k").alias("long")).first()
    anchors = sorted({x for x in (known.short, n if known.long == n else None) if x})
    a = F.when(F.col("k") == n, F.lit(n)).otherwise(F.lit(known.short))
    grams = grams.select(F.col("k"), "gram", "items", a.alias("a"), F.xxhash64(F.slice("gram", F.lit(1), a)).alias("h"))
    small = (known.b or 0) <= BROADCAST_BYTES
    d = id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("ws"))
    ws = F.col("ws")
    rows = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("a"), F.lit(0).cast("bigint").alias("h"))).cast(SCAN),
                    *[F.coalesce(_placed(windows(ws, k), k), F.array().cast(SCAN)) for k in anchors])
    # explode() would have its input's size tested first, in a filter that
    # cuts the text anew for every window
    carried = ["ws"] if small else [F.size("ws").cast("bigint").alias("n_words")]
    w = (d.select("doc_id", "key", *carried, rows.alias("rows")).select("doc_id", "key", carried[0] if small else "n_words", F.explode_outer("rows").alias("w"))
         .select("doc_id", "key", "ws" if small else "n_words", "w.at", "w.a", "w.h"))
    hit = F.slice("ws", F.greatest("at", F.lit(1)), F.coalesce("k", F.lit(1))) == F.col("gram")
    if small:
        found = w.join(F.broadcast(grams), ["a", "h"], "left").filter((F.col("at") == 0) | hit)
        return found.select("doc_id", "key", F.when(F.col("at") == 0, F.size("ws").cast("bigint")).alias("n_words"),
                            "at", "k", F.when(F.col("at") > 0, F.col("items")).alias("items"))
    heads = w.filter("at = 0").select("doc_id", "key", "n_words", "at", F.lit(None).cast("int").alias("k"), F.lit(None).cast("array<string>").alias("items"))
    likely = w.filter("at > 0").select("doc_id", "key", "at", "a", "h").distinct().join(grams, ["a", "h"]).select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "at", "k", "gram", "items")
    texts = d.dropDuplicates(["doc_id", "key"])         # equal rows have equal hits
    found = texts.join(likely, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))).filter(hit)
    return heads.unionByName(found.select("doc_id", "key", F.lit(None).cast("bigint").alias("n_words"), "at", "k", "items"))


def report(docs: DataFrame, bench: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, key, n_words, n_hit, item_ids, spans, contaminated)`` for
    every row; ``spans`` are the hit windows ``(at, k)`` in order, and
    ``item_ids`` a sorted list of strings."""
    per = scan(docs, bench, n, id_col, text_col).groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("at") > 0, F.struct("at", "k")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", zero, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["at"] + s["k"] - 1 - F.greatest(s["at"] - 1, acc["end"]))).cast("bigint").alias("n"),
        F.greatest(acc["end"], s["at"] + s["k"] - 1).alias("end")))
    per = per.withColumn("n_hit", covered["n"]).withColumn("one", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return per.select("doc_id", "key", "n_words", "n_hit", "item_ids", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, bench: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that hold a benchmark window, all columns
    as they were."""
    bad = report(docs, bench, n, id_col, text_col).filter("contaminated").select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__key")), "left_anti")


def cut(docs: DataFrame, bench: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with the hit words, and what stands between hit
    words, taken out; texts without a hit stay as they are."""
    spans = report(docs, bench, n, id_col, text_col).filter("contaminated").select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "spans").dropDuplicates(["__id", "__key"])
    d = id_text(docs, id_col, text_col)
    j = d.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left")
    # words and what stands between them alternate; word i is part 2 * i - 1 or 2 * i
    parts = F.regexp_extract_all("text", F.lit("(?s)" + WORDS.replace("\\x60", "\\x40\\x5B-\\x60") + r"|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    j = j.withColumn("parts", parts).withColumn("lead", F.when(F.col("parts")[0].rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 1).otherwise(0))
    word = lambda i: F.floor((i - F.col("lead")) / 2) + 1                                   # noqa: E731
    is_word = lambda i: (i - F.col("lead")) % 2 == 0                                        # noqa: E731
    hit = lambda k: F.exists("spans", lambda s: (s["at"] <= k) & (k < s["at"] + s["k"]))
    keep = F.filter("parts", lambda p, i: ~F.when(is_word(i), hit(word(i))).otherwise(hit(word(i)) & hit(word(i) + 1)))
    return j.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(keep, "")).alias("text"))


def digests(rep: DataFrame) -> DataFrame:
    """The report's lists as counts and digests."""
    return rep.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
