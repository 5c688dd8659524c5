"""Retention and RFM segmentation on ``orders`` (header surrogate:
``o_orderkey`` order, ``o_custkey`` customer, ``o_orderdate`` order time,
``o_totalprice`` amount due)."""

from __future__ import annotations

from tidewater.catalog import register
from tidewater.plans import customers as C
from tidewater.sources.tables import Tables

WIN = C.RfmWindow()  # +10 years, 2010-01-01 < shifted < 2011-01-01, as of 2010-12-31

# Orders moved ten years on, of the year 2010 without its first instant.
_MOVED = """moved AS (
    SELECT o_custkey AS customer_id, o_orderdate + INTERVAL 10 YEAR AS moved_at, o_totalprice AS total_due FROM orders
    WHERE moved_at > TIMESTAMP '2010-01-01' AND moved_at < TIMESTAMP '2011-01-01')"""

# One aggregate per customer gives all three measures.
_MEASURES = _MOVED + """,
measures AS (
    SELECT customer_id, CAST(DATE '2010-12-31' - CAST(MAX(moved_at) AS DATE) AS INTEGER) AS recency,
           COUNT(*) AS frequency, ROUND(SUM(total_due), 2) AS monetary
    FROM moved GROUP BY customer_id)"""

# Share of the other customers that come before: recent, frequent, high first.
_SHARES = _MEASURES + """,
shares AS (
    SELECT measures.*,
           coalesce((rank() OVER (ORDER BY recency NULLS FIRST) - 1) / nullif(COUNT(*) OVER () - 1, 0), 0) AS r_percent_rank,
           coalesce((rank() OVER (ORDER BY frequency DESC NULLS LAST) - 1) / nullif(COUNT(*) OVER () - 1, 0), 0) AS f_percent_rank,
           coalesce((rank() OVER (ORDER BY monetary DESC NULLS LAST) - 1) / nullif(COUNT(*) OVER () - 1, 0), 0) AS m_percent_rank
    FROM measures)"""

# A tier is one more than the number of cutoffs below the share.
_TIERS = _SHARES + """,
cutoffs(q) AS (VALUES (0.25), (0.5), (0.75)),
tiers AS (
    SELECT customer_id, recency, frequency, monetary, """ + ", ".join(
    f"CAST(1 + (SELECT COUNT(*) FROM cutoffs WHERE {c}_percent_rank > q) AS INTEGER) AS {c}_tier" for c in "rfm") + """
    FROM shares)"""

# Labels: the first rule whose pattern a score matches.
_LABELS = _TIERS + """,
rules(place, pattern, label) AS (VALUES """ + ", ".join(
    f"({k}, '{pattern}', '{label}')" for k, (pattern, label) in enumerate((
        ("111", "Best Customers"), ("[3-4][3-4][1-4]", "Lost Bad Customer"), ("[3-4]2[1-4]", "Lost Customers"), ("21[1-4]", "Almost Lost"),
        ("11[2-4]", "Loyal Customers"), ("[1-2][1-3]1", "Big Spenders"), ("[1-2]4[1-4]", "New Customers"), ("[3-4]1[1-4]", "Hibernating"),
        ("[1-2][2-3][2-4]", "Potential Loyalists")))) + """),
scored AS (SELECT *, r_tier || f_tier || m_tier AS rfm_score FROM tiers),
named AS (SELECT rfm_score, arg_min(label, place) AS label
          FROM (SELECT DISTINCT rfm_score FROM scored) JOIN rules ON regexp_full_match(rfm_score, pattern) GROUP BY rfm_score),
labelled AS (SELECT scored.*, coalesce(label, 'unknown') AS segment FROM scored LEFT JOIN named USING (rfm_score))"""


def _t(spark, root):
    return Tables(spark, root)


@register("rfm_window_profile", "WITH " + _MOVED + """,
latest AS (SELECT customer_id, MAX(moved_at) AS recency_ts FROM moved GROUP BY customer_id)
SELECT moved.customer_id, CAST(moved_at AS DATE) AS transaction_day, recency_ts, total_due
FROM moved JOIN latest ON moved.customer_id IS NOT DISTINCT FROM latest.customer_id""")
def rfm_window_profile(spark, root):
    return C.order_profile(_t(spark, root).orders, WIN)


@register("rfm_metrics", "WITH " + _MEASURES + " SELECT * FROM measures")
def rfm_metrics(spark, root):
    return C.rfm_metrics(_t(spark, root).orders, WIN)


@register("rfm_percent_rank", "WITH " + _SHARES + " SELECT * FROM shares")
def rfm_percent_rank(spark, root):
    return C.rfm_percent_ranks(C.cut_lineage(C.rfm_metrics(_t(spark, root).orders, WIN)))


@register("rfm_tiers", "WITH " + _TIERS + " SELECT * FROM tiers")
def rfm_tiers(spark, root):
    return C.rfm_tiers(C.cut_lineage(C.rfm_metrics(_t(spark, root).orders, WIN)))


@register("rfm_labels", "WITH " + _LABELS + " SELECT * FROM labelled")
def rfm_labels(spark, root):
    return C.segmentation(_t(spark, root).orders, WIN)


@register("rfm_segments", "WITH " + _LABELS + """
SELECT segment, n AS number_users, total AS total_users, n / total AS pct
FROM (SELECT segment, COUNT(customer_id) AS n FROM labelled GROUP BY segment), (SELECT COUNT(customer_id) AS total FROM labelled)""")
def rfm_segments(spark, root):
    return C.segment_summary(C.segmentation(_t(spark, root).orders, WIN))


@register("customer_retention", """
WITH days AS (SELECT o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS day FROM orders),
start AS (SELECT customer_id, MIN(day) AS first_day FROM days GROUP BY customer_id)
SELECT d.customer_id, day AS transaction_day, first_day, CAST(day - first_day AS INTEGER) AS subsequent_day,
       if(day = first_day, 'New Customers', 'Retained Customers') AS retention
FROM days d JOIN start s ON d.customer_id IS NOT DISTINCT FROM s.customer_id""")
def customer_retention(spark, root):
    return C.customer_retention(_t(spark, root).orders)

