"""Series of raw rows: one group holds whole tables, so nothing here may sort a
group in one task (``operators.ranges``, ``operators.joins.interval_join``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.catalog import register
from tidewater.functions.na import pct_change
from tidewater.operators import ranges
from tidewater.operators.joins import interval_join
from tidewater.sources.tables import Tables

TIME = ["o_orderdate", "o_orderkey"]


@register("order_running_total", """
SELECT o_orderkey, o_orderdate, ROUND(SUM(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running_total
FROM orders""")
def order_running_total(spark, root):
    """The running total of all orders in time order."""
    o = Tables(spark, root).orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    return ranges.running_total(o, [], TIME, "o_totalprice", "t").select("o_orderkey", "o_orderdate", F.round("t", 2).alias("running_total"))


@register("status_running_total", """
SELECT o_orderkey, o_orderstatus, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running_total
FROM orders""")
def status_running_total(spark, root):
    """The same within the few order states, each a large share of the rows."""
    o = Tables(spark, root).orders.select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    return ranges.running_total(o, ["o_orderstatus"], TIME, "o_totalprice", "t").select("o_orderkey", "o_orderstatus", F.round("t", 2).alias("running_total"))


@register("order_neighbours", """
SELECT o_orderkey, LAG(o_totalprice) OVER w AS previous_total, LEAD(o_totalprice) OVER w AS next_total,
       ROUND((o_totalprice - LAG(o_totalprice) OVER w) / NULLIF(LAG(o_totalprice) OVER w, 0) * 100, 6) AS pct_change
FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)""")
def order_neighbours(spark, root):
    """Every order with the totals of the orders before and after it."""
    o = Tables(spark, root).orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    d = ranges.neighbours(o, [], TIME, "o_totalprice", "previous_total", "next_total")
    return d.select("o_orderkey", "previous_total", "next_total", F.round(pct_change("o_totalprice", "previous_total"), 6).alias("pct_change"))


@register("order_extrema", """
SELECT o_orderkey, o_totalprice > LAG(o_totalprice) OVER w AND o_totalprice > LEAD(o_totalprice) OVER w AS local_peak,
       o_totalprice < LAG(o_totalprice) OVER w AND o_totalprice < LEAD(o_totalprice) OVER w AS local_dip
FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)""")
def order_extrema(spark, root):
    """Orders above or below both neighbours in time."""
    o = Tables(spark, root).orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    return ranges.local_extrema(o, [], TIME, "o_totalprice").select("o_orderkey", "local_peak", "local_dip")


@register("customer_rank_by_nation", """
SELECT c_custkey, c_nationkey, PERCENT_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST) AS balance_rank,
       CAST(ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal NULLS LAST, c_custkey) AS BIGINT) AS balance_number
FROM customer""")
def customer_rank_by_nation(spark, root):
    """Customers ranked by balance within their nation."""
    c = Tables(spark, root).customer.select("c_custkey", "c_nationkey", "c_acctbal")
    d = ranges.percent_rank(c, ["c_nationkey"], "c_acctbal", "balance_rank", descending=True)
    d = ranges.row_numbers(d, ["c_nationkey"], "c_acctbal", "balance_number", ties=["c_custkey"])
    return d.select("c_custkey", "c_nationkey", "balance_rank", F.col("balance_number").cast("bigint").alias("balance_number"))


@register("line_price_rank", """
SELECT l_orderkey, l_linenumber, PERCENT_RANK() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS price_rank FROM lineitem""")
def line_price_rank(spark, root):
    """All lines ranked by price within their return flag: three groups."""
    li = Tables(spark, root).lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return ranges.percent_rank(li, ["l_returnflag"], "l_extendedprice", "price_rank").select("l_orderkey", "l_linenumber", "price_rank")


# Every purchase opens a period of 1 to 240 hours for its user.
_PERIODS = """
WITH periods AS (
    SELECT event_id AS period_id, user_id, ts AS opened, ts + to_hours(CAST(1 + event_id % 240 AS INTEGER)) AS closed FROM events WHERE event_type = 'purchase')"""


def _periods(events):
    p = events.where("event_type = 'purchase'")
    return p.select(F.col("event_id").alias("period_id"), "user_id", F.col("ts").alias("opened"),
                    (F.col("ts") + F.make_dt_interval(F.lit(0), (1 + F.col("event_id") % 240).cast("int"))).alias("closed"))


@register("event_periods", _PERIODS + """
SELECT period_id, p.user_id, COUNT(*) AS n_events, ROUND(SUM(value), 4) AS total, MAX(ts) AS last_ts
FROM events e JOIN periods p ON e.user_id = p.user_id AND e.ts BETWEEN p.opened AND p.closed GROUP BY period_id, p.user_id""")
def event_periods(spark, root):
    """Events that fall into each of their user's periods."""
    e = Tables(spark, root).events.select("user_id", "ts", "value", "event_type", "event_id")
    j = interval_join(e.select("user_id", "ts", "value"), "ts", _periods(e), "opened", "closed", on=["user_id"])
    return j.groupBy("period_id", "user_id").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("last_ts"))


@register("period_overlap", _PERIODS + """
SELECT event_id, COUNT(period_id) AS n_periods FROM events e LEFT JOIN periods p ON e.user_id = p.user_id AND e.ts BETWEEN p.opened AND p.closed GROUP BY event_id""")
def period_overlap(spark, root):
    """How many of its user's periods hold each event; most hold none."""
    e = Tables(spark, root).events.select("user_id", "ts", "event_type", "event_id")
    j = interval_join(e.select("event_id", "user_id", "ts"), "ts", _periods(e).drop("event_id"), "opened", "closed", on=["user_id"], how="left")
    return j.groupBy("event_id").agg(F.count("period_id").alias("n_periods"))
