"""Groups cut into sorted ranges, and what an unbounded window would compute.

A window over a whole table, or over a group that holds a third of it, sorts
all those rows in one task.  Here every group is first cut into ranges of its
order:

1. One aggregate per level gives each large group, from a bounded sketch merged
   before the shuffle, split points; a group of few rows has none.
2. A row's range is its place among the split points (a binary search in plain
   expressions).  Rows equal to a split point form a range of their own, which
   the next order column cuts again if it is still large: so ties are cut too.
3. Rows find their group's split points without meeting the rest of the group:
   those of the few largest groups are broadcast (``attach_large``).
4. Windows run inside ranges.  What crosses a range's edge is one row per range
   (sums, counts, edge rows), combined over the ranges of a group and joined
   back on the range.

Ranges are numbered in order; NULLs of an order column come first.  Rows that are
equal in all order columns stay together.  Order columns are numbers, dates
or timestamps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewater.operators.joins import join_null_safe
from tidewater.session import checkpoint_dir

ROWS = 4096             # a group of more rows is cut
GRID, GRID_ALL = 255, 1023      # split points a group, and of a whole table, at most
LARGEST = 1024          # a group with more than this part of all cut groups' rows is one of the largest: there are fewer
RANGE = "__range"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's shared checkpoint folder
    (cuts lineage between steps; survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def split_points(value: str, n: Column, rows: int, grid: int) -> Column:
    """Aggregate: at most ``grid`` ascending split points, one for about
    every ``rows`` rows; none for a group of ``n`` <= ``rows``."""
    # as text: a literal at a time would cost the driver more than the job
    shares = ", ".join(f"{i / (grid + 1)!r}D" for i in range(1, grid + 1))
    sketch = F.expr(f"percentile_approx(`{value}`, array({shares}), {10 * (grid + 1)})")
    every = F.greatest(F.lit(1), F.floor(F.lit(grid + 1) * rows / n)).cast("int")
    return F.when(n > rows, F.array_distinct(F.filter(sketch, lambda _, i: (i + 1) % every == 0)))


def place(df: DataFrame, value: str, splits: str, most: int, out: str) -> DataFrame:
    """Add ``out`` = number of split points <= ``value`` (``splits`` ascending, at
    most ``most``; 0 without any).  A binary search unrolled into one projection
    a step, so it stays in generated code and no expression doubles."""
    step = 1 << (most.bit_length() - 1)
    df = df.withColumn(out, F.lit(0))
    while step:
        probe = F.try_element_at(F.col(splits), F.col(out) + F.lit(step))
        df = df.withColumn(out, F.col(out) + F.when(F.coalesce(probe <= F.col(value), F.lit(False)), step).otherwise(0))
        step //= 2
    return df


def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str], bounded: bool = False) -> DataFrame:
    """Left join on NULL-safe keys.  Without keys ``per_key`` is one row;
    ``bounded`` tables have a fixed number of rows: both are broadcast."""
    if not keys:
        return df.crossJoin(F.broadcast(per_key))
    return join_null_safe(df, F.broadcast(per_key) if bounded else per_key, keys, "left")


def with_share(n: DataFrame) -> DataFrame:
    """``n`` (groups with their ``__n`` rows) with ``__large``: one of fewer than
    ``LARGEST`` groups that may hold any share of the rows."""
    every = F.broadcast(n.agg(F.sum("__n").alias("__every")))
    return n.crossJoin(every).withColumn("__large", F.col("__n") * LARGEST > F.col("__every")).drop("__every")


def attach_large(df: DataFrame, per_group: DataFrame, keys: Sequence[str], out: str, spread: Sequence[str]) -> DataFrame:
    """Left join of ``out``, never NULL in ``per_group``, without bringing a large group's
    rows to one task: the rows marked ``__large`` are broadcast.  Only if there are
    others the rest is shuffled by its keys, and what has its value by then by ``spread``."""
    large, rest = per_group.where("__large"), per_group.where("NOT __large")
    df = join_null_safe(df, F.broadcast(large.select(*keys, out)), keys, "left")
    if rest.isEmpty():
        return df
    found = F.col(out).isNotNull()
    df = df.withColumn("__deal", F.when(found, 1 + F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread]), F.lit(1 << 20))).otherwise(F.lit(0).cast("long")))
    rest = rest.select(*keys, F.lit(0).cast("long").alias("__deal"), F.col(out).alias("__other"))
    return join_null_safe(df, rest, [*keys, "__deal"], "left").withColumn(out, F.coalesce(out, "__other")).drop("__deal", "__other")


def with_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = ROWS, grid: int | None = None) -> DataFrame:
    """``df`` with ``__range``: ascending numbers of the ranges of each group."""
    keys, whole = list(keys), not keys
    grid = grid or (GRID_ALL if whole else GRID)
    wide = 2 * grid + 2
    by, first = keys, True
    for c in order:
        if by:      # only large groups are sketched; within a range, only one of a single value may be cut by the next column
            # the filter is on aggregates: one on the range itself would be pushed below the search and repeat it in every step
            odd = F.lit(0) if first else F.max(F.pmod(F.col(RANGE), F.lit(2)))
            n = cut_lineage(df.groupBy(*by).agg(F.count(c).alias("__n"), odd.alias("__odd")).where((F.col("__n") > rows) & (F.col("__odd") == 0)).drop("__odd"))
            some = df.select(*[F.col(f"`{k}`") for k in dict.fromkeys([*by, *order])])
            if whole:       # one range a split point at most
                some = join_null_safe(some, F.broadcast(n), by, "inner")
            else:
                some = attach_large(some, with_share(n), by, "__n", order).where(F.col("__n").isNotNull())
            stats = some.withColumnRenamed("__n", "__of").groupBy(*by).agg(F.max("__of").alias("__n"), split_points(c, F.max("__of"), rows, grid).alias("__splits"))
        else:
            stats = df.agg(split_points(c, F.count(c), rows, grid).alias("__splits"))
        stats = cut_lineage(stats)
        if whole:
            df = attach(df, stats.drop("__n"), by, bounded=True)
        else:
            df = attach_large(df, with_share(stats), by, "__splits", order)
        df = place(df, c, "__splits", grid, "__at")
        at_split = F.get("__splits", F.col("__at") - 1) == F.col(c)
        here = F.when(F.col(c).isNull(), F.lit(-1)).otherwise(2 * F.col("__at") + F.when(at_split, 0).otherwise(1))
        # a group that is not cut is range 1, NULLs are -1; later columns refine
        here = here.cast("long") if first else F.when(F.col("__splits").isNull(), F.col(RANGE) * wide + 1).otherwise(F.col(RANGE) * wide + 1 + here)
        df = df.withColumn("__next", here).drop("__splits", "__at", RANGE).withColumnRenamed("__next", RANGE)
        by, first = [*keys, RANGE], False
    return df


def _ordered(order: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`").asc_nulls_first() for c in order]


def _over_ranges(keys: Sequence[str]):
    """The ranges of a group in order: at most the grid's number of rows."""
    return W.partitionBy(*keys).orderBy(RANGE) if keys else W.orderBy(RANGE)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, strict: bool = True,
                  ties: Sequence[str] = (), rows: int = ROWS, grid: int | None = None) -> DataFrame:
    """Cumulative sum per group in ``order``, then ``ties`` (of any type; they cut
    no ranges).  ``strict`` (R ``cumsum``): NULL from the first NULL on; otherwise
    NULLs are skipped.  Two passes: sums and first-NULL flags of the ranges,
    then the sums inside ranges on top of them."""
    keys, order = list(keys), list(order)
    cut = with_ranges(df, keys, order, rows, grid)
    v = F.col(f"`{value}`")
    sums = cut.groupBy(*keys, RANGE).agg(F.sum(v).alias("__sum"), F.bool_or(v.isNull()).alias("__gap"))
    w = _over_ranges(keys).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, RANGE, F.sum("__sum").over(w).alias("__before"), F.coalesce(F.bool_or("__gap").over(w), F.lit(False)).alias("__gap"))
    cut = attach(cut, sums, [*keys, RANGE], bounded=not keys)
    w = W.partitionBy(*keys, RANGE).orderBy(*_ordered([*order, *ties])).rowsBetween(W.unboundedPreceding, 0)
    inside = F.sum(v).over(w)
    total = F.coalesce(F.col("__before") + inside, F.col("__before"), inside)
    if strict:
        total = F.when(~(F.col("__gap") | F.bool_or(v.isNull()).over(w)), total)
    return cut.withColumn(out, total).drop(RANGE, "__before", "__gap")


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, previous: str | None = None, following: str | None = None,
               ties: Sequence[str] = (), rows: int = ROWS, grid: int | None = None) -> DataFrame:
    """``lag`` (as ``previous``) and ``lead`` (as ``following``) of ``value`` per
    group in ``order``, then ``ties``, which together should tell rows apart.  A range's first and last
    rows take the edge rows of the ranges next to it."""
    keys, order = list(keys), list(order)
    cut = with_ranges(df, keys, order, rows, grid)
    v, at = F.col(f"`{value}`"), F.struct(*[F.col(f"`{c}`") for c in [*order, *ties]])
    # one row more in a struct: a NULL value at an edge is still an edge
    edges = cut.groupBy(*keys, RANGE).agg(F.max_by(F.struct(v.alias("v")), at).alias("__last"), F.min_by(F.struct(v.alias("v")), at).alias("__first"))
    w = _over_ranges(keys)
    edges = edges.select(*keys, RANGE, F.lag("__last").over(w)["v"].alias("__left"), F.lead("__first").over(w)["v"].alias("__right"))
    cut = attach(cut, edges, [*keys, RANGE], bounded=not keys)
    w = W.partitionBy(*keys, RANGE).orderBy(*_ordered([*order, *ties]))
    here = F.struct(v.alias("v"))
    if previous:
        cut = cut.withColumn("__p", F.lag(here).over(w))
    if following:
        cut = cut.withColumn("__f", F.lead(here).over(w))
    for name, inner, outer in ((previous, "__p", "__left"), (following, "__f", "__right")):
        if name:
            cut = cut.withColumn(name, F.when(F.col(inner).isNull(), F.col(outer)).otherwise(F.col(inner)["v"])).drop(inner)
    return cut.drop(RANGE, "__left", "__right")


def local_extrema(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, peak: str = "local_peak", dip: str = "local_dip",
                  ties: Sequence[str] = (), rows: int = ROWS, grid: int | None = None) -> DataFrame:
    """Rows above (below) both neighbouring rows of their group; NULL at its
    ends and beside a NULL, unless the other side decides."""
    d = neighbours(df, keys, order, value, "__prev", "__next", ties, rows, grid)
    v, p, n = F.col(f"`{value}`"), F.col("__prev"), F.col("__next")
    return d.withColumns({peak: (v > p) & (v > n), dip: (v < p) & (v < n)}).drop("__prev", "__next")


def row_numbers(df: DataFrame, keys: Sequence[str], order: str, out: str, ties: Sequence[str] = (),
                rows: int = ROWS, grid: int | None = None) -> DataFrame:
    """``ROW_NUMBER()`` per group by ``order``, then ``ties``; NULLs last."""
    keys = list(keys)
    cut = with_ranges(df, keys, [order], rows, grid).withColumn(RANGE, F.when(F.col(RANGE) < 0, F.lit(1 << 40)).otherwise(F.col(RANGE)))
    counts = cut.groupBy(*keys, RANGE).agg(F.count(F.lit(1)).alias("__in"))
    counts = counts.select(*keys, RANGE, (F.sum("__in").over(_over_ranges(keys).rowsBetween(W.unboundedPreceding, 0)) - F.col("__in")).alias("__off"))
    w = W.partitionBy(*keys, RANGE).orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in (order, *ties)])
    return attach(cut, counts, [*keys, RANGE], bounded=not keys).withColumn(out, F.col("__off") + F.row_number().over(w)).drop(RANGE, "__off")


def rank_shares(df: DataFrame, keys: Sequence[str], value: str, out: str, descending: bool = False, rows: int = ROWS, grid: int | None = None) -> DataFrame:
    """``keys + [value, out]``: the percent rank of every distinct value of a group.

    A value's rank is the number of rows in earlier ranges plus that of
    smaller values inside its range, where equal values are counted once,
    before the shuffle."""
    keys = list(keys)
    x = F.col(f"`{value}`").cast("double")
    cut = with_ranges(df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{value}`"), (-x if descending else x).alias("__x")), keys, ["__x"], rows, grid)
    values = cut.groupBy(*keys, RANGE, "__x").agg(F.count(F.lit(1)).alias("__c"), F.first(F.col(f"`{value}`")).alias(value))
    ranges = values.groupBy(*keys, RANGE).agg(F.sum("__c").alias("__in"))
    w = _over_ranges(keys)
    nulls = F.coalesce(F.sum(F.when(F.col(RANGE) < 0, F.col("__in"))).over(W.partitionBy(*keys)), F.lit(0))
    ranges = ranges.select(*keys, RANGE, (F.sum("__in").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("__in")).alias("__off"),
                           F.sum("__in").over(W.partitionBy(*keys)).alias("__n"), nulls.alias("__nulls"))
    w = W.partitionBy(*keys, RANGE).orderBy("__x").rowsBetween(W.unboundedPreceding, 0)
    values = values.withColumn("__under", F.sum("__c").over(w) - F.col("__c"))
    rank = F.col("__off") + F.col("__under")
    if descending:      # NULLs come last, not first
        rank = F.when(F.col("__x").isNull(), F.col("__n") - F.col("__nulls")).otherwise(rank - F.col("__nulls"))
    share = F.when(F.col("__n") > 1, rank.cast("double") / (F.col("__n") - 1).cast("double")).otherwise(F.lit(0.0))
    return attach(values, ranges, [*keys, RANGE], bounded=not keys).select(*keys, F.col(f"`{value}`"), share.alias(out))


def percent_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "percent_rank", descending: bool = False,
                 rows: int = ROWS, grid: int | None = None) -> DataFrame:
    """``PERCENT_RANK() OVER (PARTITION BY keys ORDER BY value [DESC])``: NULLs
    first, or last when descending; 0 in a group of one row.  Rows look their
    value's share up; a hot value's rows are split by AQE's skew join."""
    return join_null_safe(df, rank_shares(df, keys, value, out, descending, rows, grid), [*keys, value], "left")
