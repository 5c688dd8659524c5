"""Exact order statistics without a single-task sort.

``percent_rank() OVER (ORDER BY x)`` without a partition, ``percentile`` and
``median`` all need the rank of values inside a whole table or group.
Spark's built-ins plan them as one task (``Exchange SinglePartition``) or
one aggregation buffer holding every distinct value of a group.  Here the
same exact results come from distributed steps, the same at every size:

1. every value falls into a bucket of a fixed scale (``octave``: 32 buckets
   between a number and its double), so histograms of any rows can be added;
2. a histogram per group, added up before the shuffle, with the counts below
   each bucket: only the buckets that hold a wanted rank go on;
3. while a wanted bucket still holds too many rows, its own range is cut into
   ``buckets`` equal parts and counted again, until every one fits;
4. the values of what is left are collapsed to (value, count) before the
   shuffle and ranked.

``medians_by_level`` takes the medians of a hierarchy's entities from one
histogram of its leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewater.operators import ranges
from tidewater.operators.joins import join_null_safe
from tidewater.operators.ranges import ROWS, cut_lineage

MAX_EXACT_ROWS = 1_000_000      # rows of a wanted bucket that one task ranks
BUCKETS = 1024                  # parts of a wanted bucket that holds more


def octave(v: Column) -> Column:
    """A bucket number that never falls as ``v`` (double) grows; NaN is largest."""
    steps = F.floor(F.log2(F.abs(v)) * 32).cast("int")
    return (F.when(v.isNull(), F.lit(None).cast("int")).when(F.isnan(v), F.lit(1_000_000)).when(v == 0, F.lit(0))
            .when(F.abs(v) == float("inf"), F.when(v > 0, F.lit(900_000)).otherwise(F.lit(-900_000)))
            .when(v > 0, 400_000 + steps).otherwise(-400_000 - steps))


def select_kth(df: DataFrame, keys: Sequence[str], value: str, targets: Callable[[Column, Column], Column],
               buckets: int = BUCKETS, max_exact_rows: int = MAX_EXACT_ROWS) -> DataFrame:
    """k-th smallest non-NULL ``value`` per group, exactly.

    ``targets`` is a function ``(n, N) -> array<bigint>`` of wanted 0-based
    ranks among the group's ``n`` non-NULL values (``N`` counts the NULLs
    too).  Ranks outside ``[0, n)`` are ignored.  Returns ``keys + ['__k',
    '__v', '__n']``.
    """
    keys = list(keys)
    v = F.col(f"`{value}`").cast("double")
    data = df.select(*[F.col(f"`{k}`") for k in keys], v.alias("__v"), octave(v).alias("__b"))
    hist = data.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    return _pick(data.where(F.col("__v").isNotNull()), _wanted(hist, keys, targets), keys, buckets, max_exact_rows)


def _wanted(hist: DataFrame, keys: list[str], targets: Callable[[Column, Column], Column]) -> DataFrame:
    """``keys + [__n, __k, __b, __j, __lo, __hi, __c]``: the bucket that holds
    each wanted rank ``__k`` and the rank ``__j`` inside it.  ``hist`` has the
    rows and the range of every bucket, NULL's among them."""
    group = W.partitionBy(*keys)        # the buckets of a group: a bounded number
    known = F.when(F.col("__b").isNotNull(), F.col("__c"))
    h = hist.withColumns({"__n": F.coalesce(F.sum(known).over(group), F.lit(0)), "__nall": F.sum("__c").over(group),
                          "__before": F.sum("__c").over(group.orderBy("__b").rowsBetween(W.unboundedPreceding, 0)) - F.col("__c")})
    h = h.withColumn("__before", F.col("__before") - (F.col("__nall") - F.col("__n"))).where(F.col("__b").isNotNull())   # NULLs sort first
    wants = F.filter(F.array_distinct(targets(F.col("__n"), F.col("__nall"))), lambda k: (k >= F.col("__before")) & (k < F.col("__before") + F.col("__c")))
    h = h.select(*keys, "__n", "__b", "__lo", "__hi", "__c", "__before", F.explode(wants).alias("__k"))
    return cut_lineage(h.select(*keys, "__n", "__k", "__b", (F.col("__k") - F.col("__before")).alias("__j"), "__lo", "__hi", "__c"))


def _pick(data: DataFrame, wanted: DataFrame, keys: list[str], buckets: int, max_exact_rows: int) -> DataFrame:
    """The values at the wanted ranks; ``data`` has ``keys + [__b, __v]``."""
    def candidates(w: DataFrame) -> DataFrame:
        j = join_null_safe(data, w, [*keys, "__b"], "inner")
        return j.where(F.col("__v").eqNullSafe(F.col("__lo")) | ((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))))

    by = [*keys, "__k"]
    while True:
        large = wanted.agg(F.max(F.when(F.col("__lo") < F.col("__hi"), F.col("__c")))).first()[0]
        if large is None or large <= max_exact_rows:
            break
        part = F.when(F.col("__lo") < F.col("__hi"), F.least(F.lit(buckets - 1), F.floor(
            (F.col("__v") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2) * buckets)))
        h = candidates(wanted).withColumn("__part", part).groupBy(*by, "__n", "__b", "__j", "__part").agg(
            F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        below = F.sum("__c").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("__c")
        h = h.withColumn("__below", below).where((F.col("__below") <= F.col("__j")) & (F.col("__j") < F.col("__below") + F.col("__c")))
        wanted = cut_lineage(h.select(*keys, "__n", "__k", "__b", (F.col("__j") - F.col("__below")).alias("__j"), "__lo", "__hi", "__c"))
    vc = candidates(wanted).groupBy(*by, "__n", "__j", "__v").agg(F.count(F.lit(1)).alias("__c"))
    vc = vc.withColumn("__to", F.sum("__c").over(W.partitionBy(*by).orderBy("__v").rowsBetween(W.unboundedPreceding, 0)))
    return vc.where((F.col("__to") - F.col("__c") <= F.col("__j")) & (F.col("__j") < F.col("__to"))).select(*keys, "__k", "__v", "__n")


def _middle(n: Column, _all: Column) -> Column:
    return F.array(F.floor((n - 1) / 2).cast("long"), F.ceil((n - 1) / 2).cast("long"))


def medians_by_level(rows: DataFrame, keys: Sequence[str], leaf: str, levels: DataFrame, value: str,
                     buckets: int = BUCKETS, max_exact_rows: int = MAX_EXACT_ROWS) -> DataFrame:
    """Exact medians (NULLs ignored) of every entity of a hierarchy, per ``keys``.

    ``levels`` maps each ``leaf`` to the entities ``(level, code)`` it belongs to,
    a fixed number of rows.  Rows are counted once, per leaf and bucket; the
    entities' histograms are sums of their leaves', and only rows of wanted
    buckets meet the entities that want them.  Returns ``keys + [level, code,
    median, n]``.
    """
    keys, ent = list(keys), [*keys, "level", "code"]
    v = F.col(f"`{value}`").cast("double")
    data = rows.select(*keys, leaf, v.alias("__v"), octave(v).alias("__b")).where(F.col("__v").isNotNull())
    hist = cut_lineage(data.groupBy(*keys, leaf, "__b").agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")))
    levels = F.broadcast(levels)
    rolled = join_null_safe(hist, levels, [leaf], "inner").groupBy(*ent, "__b").agg(
        F.sum("__c").alias("__c"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    wanted = _wanted(rolled, ent, _middle)
    # the leaves that hold rows of a bucket their entity wants
    asked = join_null_safe(hist.select(*keys, leaf, "__b"), levels, [leaf], "inner")
    asked = join_null_safe(asked, wanted.select(*ent, "__b").distinct(), [*ent, "__b"], "left_semi")
    some = join_null_safe(data, asked, [*keys, leaf, "__b"], "inner").select(*ent, "__b", "__v")
    got = _pick(some, wanted, ent, buckets, max_exact_rows)
    return got.groupBy(*ent).agg(F.avg("__v").alias("median"), F.max("__n").alias("n"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    fractions: Sequence[float], names: Sequence[str] | None = None,
                    **kw) -> DataFrame:
    """Exact interpolating percentiles per group (``percentile`` /
    ``quantile_cont`` / R ``quantile(type=7)``), NULLs ignored.

    Returns ``keys + names + ['n']`` (``n`` = non-NULL values); a group
    whose values are all NULL does not appear (callers left-join).
    """
    keys = list(keys)
    names = list(names) if names else [f"p{str(f).replace('.', '_')}" for f in fractions]

    def positions(n: Column, _N: Column) -> Column:
        ks = []
        for f in fractions:
            pos = F.lit(float(f)) * (n - 1)
            ks += [F.floor(pos).cast("long"), F.ceil(pos).cast("long")]
        return F.array(*ks)

    kth = select_kth(df, keys, value, positions, **kw)
    # fold the few selected ranks of a group back into one row
    by_k = kth.groupBy(*keys, "__n").agg(F.map_from_entries(F.collect_list(F.struct("__k", "__v"))).alias("__m"))
    outs = []
    for f, name in zip(fractions, names):
        pos = F.lit(float(f)) * (F.col("__n") - 1)
        lo_k, hi_k = F.floor(pos).cast("long"), F.ceil(pos).cast("long")
        lo_v, hi_v = F.element_at("__m", lo_k), F.element_at("__m", hi_k)
        outs.append(F.when(lo_k == hi_k, lo_v).otherwise(lo_v + (pos - lo_k) * (hi_v - lo_v)).alias(name))
    return by_k.select(*keys, *outs, F.col("__n").alias("n"))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", **kw) -> DataFrame:
    """Exact median per group (R ``median(x, na.rm=TRUE)``)."""
    return exact_quantiles(df, keys, value, [0.5], [name], **kw)


def percent_rank_thresholds(df: DataFrame, measures: dict[str, bool],
                            cutoffs: Sequence[float], **kw) -> DataFrame:
    """Order-statistic thresholds that decide ``PERCENT_RANK() OVER (ORDER BY
    m [DESC]) > q`` for every measure ``m`` and cutoff ``q`` without ranking
    rows.  ``measures`` maps column → descending?  All measures go through
    one grouped selection (long form, one group per measure).

    Ascending (NULLs first): a non-NULL ``v`` ranks above ``q`` iff
    ``v > s[j]``, ``s`` the sorted column including NULLs,
    ``j`` the largest rank with ``j / (N - 1) <= q``; when ``s[j]`` is a NULL every non-NULL value
    qualifies.  Descending (NULLs last): iff ``v < t[j]``, ``t`` sorted
    descending; when ``t[j]`` is a NULL no non-NULL value qualifies.
    Returns one row per measure: ``measure, N, nn, j<i>, t<i>``.
    """
    names = list(measures)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(f"`{m}`").cast("double").alias("x")) for m in names
    ])).alias("__s")).select("__s.measure", "__s.x")
    desc = F.col("measure").isin([m for m in names if measures[m]])

    def js(N: Column) -> list[Column]:
        # the largest rank r with r / (N - 1) <= q, in the division that
        # PERCENT_RANK itself makes: q * (N - 1) alone may round either way
        out, m = [], (N - 1).cast("double")
        for q in cutoffs:
            j = F.floor(F.lit(float(q)) * m).cast("long")
            out.append(F.when(N <= 1, F.lit(0).cast("long")).when((j + 1) / m <= q, j + 1).when(j / m > q, j - 1).otherwise(j))
        return out

    def targets(n: Column, N: Column) -> Column:
        # descending: t[j] is the (n-1-j)-th smallest; ascending: s[j] follows N-n NULLs
        return F.array(*[F.when(desc, n - 1 - j).otherwise(j - (N - n)) for j in js(N)])

    kth = select_kth(long, ["measure"], "x", targets, **kw)
    # the few selected ranks of a measure as one map k -> value
    picked = kth.groupBy("measure").agg(F.map_from_entries(F.collect_list(F.struct("__k", "__v"))).alias("__kv"))
    counts = long.groupBy("measure").agg(F.count("*").alias("N"), F.count("x").alias("nn"))
    N, nn = F.col("N"), F.col("nn")
    cols = []
    for i, j in enumerate(js(N)):
        k = F.when(desc, nn - 1 - j).otherwise(j - (N - nn))
        cols += [j.alias(f"j{i}"), F.try_element_at(F.col("__kv"), k).alias(f"t{i}")]
    # measures rows on both sides
    out = counts.join(picked, "measure", "left").select("measure", "N", "nn", *cols)
    # one row per measure, read once per measure by the caller: cut here so
    # the selection runs once
    return cut_lineage(out)


def above_cutoff(v: Column, prefix: str, i: int, descending: bool) -> Column:
    """Boolean ``PERCENT_RANK > cutoff[i]`` for one row, given the threshold
    row of its measure joined with column prefix ``prefix``."""
    t, N, nn, j = (F.col(f"{prefix}{c}") for c in (f"t{i}", "N", "nn", f"j{i}"))
    if descending:
        nonnull = F.when(t.isNull(), F.lit(False)).otherwise(v < t)
        null_rank = nn  # NULLs follow every non-NULL value
    else:
        nonnull = F.when(t.isNull(), F.lit(True)).otherwise(v > t)
        null_rank = F.lit(0)
    # rank/(N-1) > q  <=>  rank > j   (integer rank)
    return F.when(v.isNull(), (N > 1) & (null_rank > j)).otherwise(nonnull)


def exact_percent_rank(df: DataFrame, value: str, out: str = "percent_rank", descending: bool = False,
                       keys: Sequence[str] = (), buckets: int | None = None, max_exact_rows: int = ROWS) -> DataFrame:
    """``PERCENT_RANK() OVER ([PARTITION BY keys] ORDER BY value [DESC])`` as a
    column, exact, without a window over a whole table or group."""
    return ranges.percent_rank(df, keys, value, out, descending, max_exact_rows, buckets - 1 if buckets else None)


def exact_percent_ranks(df: DataFrame, measures: dict[str, tuple[str, bool]], keys: Sequence[str] = ()) -> DataFrame:
    """Several percent ranks.  ``measures`` maps column → (output name,
    descending).  Each measure's table of values and shares comes from ``df``
    itself, and rows look their values up, so repeated rows stay as they are."""
    out = df
    for m, (name, desc) in measures.items():
        out = join_null_safe(out, ranges.rank_shares(df, keys, m, name, desc), [*keys, m], "left")
    return out
