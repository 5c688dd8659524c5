"""Customer retention and RFM segmentation over an order-header table.

Steps of the segmentation (each a function, all lazily composed):
``order_profile`` → ``rfm_metrics`` → ``rfm_percent_ranks`` / ``rfm_tiers``
→ ``rfm_labels`` → ``segment_summary``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from tidewater.functions.dates import add_years, day_diff, shifted_open_range, to_day
from tidewater.functions.text import concat_codes, like_class
from tidewater.operators.joins import attach_group_agg
from tidewater.operators.order_stats import (above_cutoff, cut_lineage, exact_percent_ranks,
                                             percent_rank_thresholds)

# ---- fixed values: segmentation rules (first match wins), tier cutoffs ----
# Each rule is a T-SQL LIKE pattern with [..] classes over the 3-digit
# "r f m" tier score, tier 1 = most recent / most frequent / highest spend.
SEGMENT_RULES: tuple[tuple[str, str], ...] = (
    ("111", "Best Customers"),
    ("[3-4][3-4][1-4]", "Lost Bad Customer"),
    ("[3-4]2[1-4]", "Lost Customers"),
    ("21[1-4]", "Almost Lost"),
    ("11[2-4]", "Loyal Customers"),
    ("[1-2][1-3]1", "Big Spenders"),
    ("[1-2]4[1-4]", "New Customers"),
    ("[3-4]1[1-4]", "Hibernating"),
    ("[1-2][2-3][2-4]", "Potential Loyalists"),
)
SEGMENT_DEFAULT = "unknown"
TIER_CUTOFFS: tuple[float, ...] = (0.25, 0.5, 0.75)
RETENTION_LABELS = ("New Customers", "Retained Customers")


@dataclass(frozen=True)
class OrderCols:
    """Column names of the order-header table."""
    customer: str = "o_custkey"
    order_ts: str = "o_orderdate"
    amount: str = "o_totalprice"
    order_id: str = "o_orderkey"


@dataclass(frozen=True)
class RfmWindow:
    """Date shift and open window: ``shift(ts) > lo and shift(ts) < hi``;
    recency counts days from the last shifted order to ``as_of``."""
    shift_years: int = 10
    lo: str = "2010-01-01"
    hi: str = "2011-01-01"
    as_of: str = "2010-12-31"


# ----------------------------------------------------------------- retention

def customer_retention(orders: DataFrame, cols: OrderCols = OrderCols()) -> DataFrame:
    """Per order: its day, the customer's first order day, days since then
    and 'New Customers' (same day) vs 'Retained Customers'.

    ``MIN(day) OVER (PARTITION BY customer)`` is computed as a map-side
    partial aggregate joined back, so a customer with a huge share of the
    orders never lands in one window task.
    """
    base = orders.select(F.col(cols.customer).alias("customer_id"),
                         to_day(cols.order_ts).alias("transaction_day"))
    out = attach_group_agg(base, ["customer_id"], {"first_day": F.min("transaction_day")})
    sub = day_diff("first_day", "transaction_day")
    return out.withColumns({
        "subsequent_day": sub,
        "retention": F.when(sub == 0, F.lit(RETENTION_LABELS[0])).otherwise(F.lit(RETENTION_LABELS[1])),
    })


# ----------------------------------------------------------------- RFM

def order_profile(orders: DataFrame, win: RfmWindow = RfmWindow(),
                  cols: OrderCols = OrderCols()) -> DataFrame:
    """Orders inside the shifted open window with their shifted day and the
    customer's last shifted order time (window ``MAX`` as agg + join)."""
    shifted = add_years(cols.order_ts, win.shift_years)
    rows = orders.where(shifted_open_range(cols.order_ts, win.lo, win.hi, win.shift_years)) \
        .select(F.col(cols.customer).alias("customer_id"),
                shifted.alias("__shifted"),
                F.col(cols.amount).alias("total_due"))
    out = attach_group_agg(rows, ["customer_id"], {"recency_ts": F.max("__shifted")})
    return out.select("customer_id", to_day("__shifted").alias("transaction_day"), "recency_ts", "total_due")


def rfm_metrics(orders: DataFrame, win: RfmWindow = RfmWindow(),
                cols: OrderCols = OrderCols()) -> DataFrame:
    """Recency (days from the last order to ``as_of``), frequency (orders)
    and monetary value (sum, to the cent) per customer.

    ``MIN(DATEDIFF(day, MAX(ts) OVER (PARTITION BY c), as_of))`` of the
    source is one aggregate: the datediff of the group's maximum.
    """
    shifted = add_years(cols.order_ts, win.shift_years)
    rows = orders.where(shifted_open_range(cols.order_ts, win.lo, win.hi, win.shift_years))
    return rows.groupBy(F.col(cols.customer).alias("customer_id")).agg(
        day_diff(F.max(shifted), F.lit(win.as_of).cast("date")).alias("recency"),
        F.count("*").alias("frequency"),
        F.round(F.sum(cols.amount), 2).alias("monetary"))


def rfm_percent_ranks(rfm: DataFrame) -> DataFrame:
    """Exact ``PERCENT_RANK()`` of recency (asc), frequency and monetary
    (desc) over all customers, without a single-partition sort."""
    return exact_percent_ranks(rfm, {"recency": ("r_percent_rank", False),
                                                    "frequency": ("f_percent_rank", True),
                                                    "monetary": ("m_percent_rank", True)})


def _tier(v, thr_prefix: str, descending: bool, cutoffs: Sequence[float]):
    # CASE WHEN pr > .75 THEN 4 WHEN pr > .5 THEN 3 WHEN pr > .25 THEN 2 ELSE 1
    expr = None
    for i in reversed(range(len(cutoffs))):
        cond = above_cutoff(F.col(v), thr_prefix, i, descending)
        expr = F.when(cond, F.lit(i + 2)) if expr is None else expr.when(cond, F.lit(i + 2))
    return expr.otherwise(F.lit(1))


def rfm_tiers(rfm: DataFrame, cutoffs: Sequence[float] = TIER_CUTOFFS) -> DataFrame:
    """Tier 1..4 per measure from the percent-rank cutoffs.

    Each cutoff is turned into one exact order statistic of the measure
    (see ``percent_rank_thresholds``); the nine statistics come from one
    grouped selection instead of three global sorts.
    """
    spec = (("recency", "r_tier", False, "r_"), ("frequency", "f_tier", True, "f_"),
            ("monetary", "m_tier", True, "m_"))
    thr = percent_rank_thresholds(rfm, {m: d for m, _, d, _ in spec}, cutoffs)
    # the per-measure rows side by side in one row (prefixed columns)
    fields = [c for c in thr.columns if c != "measure"]
    one = thr.agg(*[F.first(F.when(F.col("measure") == m, F.col(c)), ignorenulls=True).alias(p + c)
                    for m, _, _, p in spec for c in fields])
    out = rfm.crossJoin(F.broadcast(one))  # exactly one row
    out = out.withColumns({tier: _tier(m, p, desc, cutoffs) for m, tier, desc, p in spec})
    return out.drop(*one.columns)


def segment_of(score_col: str = "rfm_score",
               rules: Sequence[tuple[str, str]] = SEGMENT_RULES,
               default: str = SEGMENT_DEFAULT):
    """Searched CASE over bracket-class patterns, first match wins."""
    expr = None
    for pattern, label in rules:
        cond = like_class(score_col, pattern)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def rfm_labels(tiers: DataFrame, rules: Sequence[tuple[str, str]] = SEGMENT_RULES) -> DataFrame:
    out = tiers.withColumn("rfm_score", concat_codes("r_tier", "f_tier", "m_tier"))
    return out.withColumn("segment", segment_of("rfm_score", rules))


def segment_summary(labels: DataFrame) -> DataFrame:
    """Customers per segment, all customers and the share.  The grand total
    is a window over the (at most len(rules)+1) aggregated rows."""
    per = labels.groupBy("segment").agg(F.count("customer_id").alias("number_users"))
    total = F.sum("number_users").over(W.partitionBy())
    return per.withColumns({
        "total_users": total,
        "pct": F.col("number_users").cast("double") / total.cast("double"),
    })


def segmentation(orders: DataFrame, win: RfmWindow = RfmWindow(), cols: OrderCols = OrderCols(),
                 checkpoint: bool = True) -> DataFrame:
    """Full pipeline: orders → per-customer RFM → tiers → labels.

    The per-customer table feeds three threshold jobs and the final plan;
    it is checkpointed once so the order scan and aggregation run once.
    """
    rfm = rfm_metrics(orders, win, cols)
    if checkpoint:
        rfm = cut_lineage(rfm)
    return rfm_labels(rfm_tiers(rfm))
