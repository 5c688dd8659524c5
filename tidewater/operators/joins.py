"""Join helpers: null-safe composite keys,
group-attached aggregates, interval (band) joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

def listed(df: DataFrame, column: str, members: DataFrame, member_column: str) -> DataFrame:
    """Rows whose value is in a list of any length, as a semi join: no row is
    repeated, and a short list is broadcast by its measured size."""
    m = members.select(F.col(f"`{member_column}`").alias("__member"))
    return df.join(m, F.col(f"`{column}`") == F.col("__member"), "left_semi")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "left") -> DataFrame:
    """Join on same-named keys where NULL matches NULL (dplyr's default).

    ``<=>`` keys are still equi-join keys for the planner, so this is a hash
    or sort-merge join, not a nested loop.  Output keeps the left keys
    (right keys for ``how='right'``), like ``join(on=[...])``.
    """
    keys = list(keys)
    if not keys:
        return left.crossJoin(right)
    tmp = {k: f"__r_{k}" for k in keys}
    r = right.select(*[F.col(f"`{c}`").alias(tmp[c]) if c in tmp else F.col(f"`{c}`")
                       for c in right.columns])
    cond = None
    for k in keys:
        e = left[f"`{k}`"].eqNullSafe(r[tmp[k]])
        cond = e if cond is None else cond & e
    out = left.join(r, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti", "leftsemi", "leftanti"):
        return out
    if how in ("right", "right_outer", "rightouter"):
        for k in keys:
            out = out.withColumn(k, F.col(tmp[k]))
        return out.drop(*tmp.values()).select(*left.columns, *[c for c in right.columns if c not in keys])
    if how in ("full", "outer", "full_outer", "fullouter"):
        for k in keys:
            out = out.withColumn(k, F.coalesce(left[f"`{k}`"], F.col(tmp[k])))
        return out.drop(*tmp.values())
    return out.drop(*tmp.values())


def attach_group_agg(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """``agg(x) OVER (PARTITION BY keys)`` without a window.

    A window sorts every row of a key in one task, so one hot key would
    sit in a single task.  Here the aggregate runs partially on the map
    side (skew-safe) and is joined back.  The per-key table is derived, so
    no hint is given: Catalyst broadcasts it when its estimate is small, AQE
    when its shuffle output is, and otherwise it is a sort-merge join whose
    hot partitions AQE's skew join splits.
    """
    per_key = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    if not keys:
        return df.crossJoin(F.broadcast(per_key))       # one row
    return join_null_safe(df, per_key, keys, "left")


def _number(df: DataFrame, c: str) -> Column:
    """A number that orders as the column does: days for dates, microseconds for
    timestamps (without a time zone's jumps), the value itself otherwise."""
    kind, x = df.schema[c].dataType.typeName(), F.col(f"`{c}`")
    if kind == "date":
        return F.unix_date(x).cast("double")
    if kind == "timestamp":
        return F.unix_micros(x).cast("double")
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{c}`)").cast("double")
    return x.cast("double")


def interval_join(df: DataFrame, x: str, bands: DataFrame, lo: str, hi: str, on: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Pairs of a row and a band with ``lo <= x <= hi`` (closed at both ends)
    and equal ``on`` columns; ``how="left"`` keeps rows without a band.

    A band of length d is entered in the bins of width 2^k that it touches,
    with 2^(k-1) < d <= 2^k: two or three, however long it is.  A row is entered
    in one bin of every width that occurs.  So the join is an equi-join on
    (on, width, bin), the exact test follows, and every pair is met once.  Neither
    side is broadcast by a hint, and AQE splits a hot bin.  Bounds are finite;
    a NULL matches nothing.
    """
    on = list(on)
    length = _number(bands, hi) - _number(bands, lo)
    width = F.when(length > 0, F.ceil(F.log2(length))).when(length == 0, F.lit(0)).cast("int")
    entered = bands.withColumn("__k", width).where(F.col("__k").isNotNull())
    widths = [r[0] for r in entered.select("__k").distinct().collect()]     # exponents of a double: a bounded number
    size = F.pow(F.lit(2.0), F.col("__k"))
    entered = entered.withColumn("__bin", F.explode(F.sequence(F.floor(_number(bands, lo) / size), F.floor(_number(bands, hi) / size))))
    renamed = {c: f"__b_{c}" for c in on}
    entered = entered.withColumnsRenamed(renamed)
    rows = df
    if how == "left":
        from tidewater.operators.ranges import cut_lineage
        rows = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()))     # row ids that stay
    spread = rows.withColumn("__k2", F.explode(F.array(*[F.lit(int(k)) for k in widths]).cast("array<int>"))) \
        .withColumn("__bin2", F.floor(_number(df, x) / F.pow(F.lit(2.0), F.col("__k2"))))
    cond = (F.col("__k2") == F.col("__k")) & (F.col("__bin2") == F.col("__bin"))
    for c in on:
        cond = cond & (F.col(f"`{c}`") == F.col(f"`{renamed[c]}`"))
    pairs = spread.join(entered, cond).where((F.col(f"`{x}`") >= F.col(f"`{lo}`")) & (F.col(f"`{x}`") <= F.col(f"`{hi}`")))
    pairs = pairs.drop("__k", "__k2", "__bin", "__bin2", *renamed.values())
    if how == "left":
        single = rows.join(pairs.select("__row").distinct(), "__row", "left_anti")
        pairs = pairs.unionByName(single, allowMissingColumns=True).drop("__row")
    return pairs


def band_join(df: DataFrame, x: str, bands: DataFrame, how: str = "left") -> DataFrame:
    """Interval join ``band_lo <= x <= band_hi`` (closed both ends, so a
    value on a shared edge falls into both bands)."""
    return interval_join(df, x, bands, "band_lo", "band_hi", how=how)
