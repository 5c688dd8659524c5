"""Star-schema queries.  Surrogates: customer → nation → region is the
snowflake (product → subcategory → category); nation is the territory
dimension; orders the header fact; lineitem ⟕ part the detail fact."""

from __future__ import annotations

import hashlib

from tidewater.catalog import register
from tidewater.plans import star as S
from tidewater.operators.joins import listed
from tidewater.sources.tables import Tables, publish_view, store_view


@register("dim_snowflake", """
SELECT c.c_custkey AS customer_id, c.c_name AS customer_name, c.c_acctbal AS acct_balance,
       c.c_nationkey AS nation_id, n.n_name AS nation_name,
       r.r_regionkey AS region_id, r.r_name AS region_name
FROM customer c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def dim_snowflake(spark, root):
    t = Tables(spark, root)
    return S.dim_snowflake(t.customer, t.nation, t.region, "c_nationkey", "n_nationkey", "n_regionkey",
                           "r_regionkey", {"customer_id": "c_custkey", "customer_name": "c_name",
                                           "acct_balance": "c_acctbal", "nation_id": "c_nationkey",
                                           "nation_name": "n_name", "region_id": "r_regionkey",
                                           "region_name": "r_name"})


@register("dim_territory", """
SELECT n_nationkey AS territory_id, n_name AS region, n_regionkey AS continent_id FROM nation""")
def dim_territory(spark, root):
    return S.project(Tables(spark, root).nation,
                     {"territory_id": "n_nationkey", "region": "n_name", "continent_id": "n_regionkey"})


@register("fact_header", """
SELECT o_orderkey AS sales_order_id, o_orderdate AS order_date, o_custkey AS customer_id,
       o_orderstatus AS status, o_totalprice AS total_due
FROM orders""")
def fact_header(spark, root):
    return S.project(Tables(spark, root).orders,
                     {"sales_order_id": "o_orderkey", "order_date": "o_orderdate", "customer_id": "o_custkey",
                      "status": "o_orderstatus", "total_due": "o_totalprice"})


@register("fact_margin", """
SELECT l.l_orderkey AS sales_order_id, l.l_linenumber AS detail_id, l.l_quantity AS order_qty,
       l.l_partkey AS product_id,
       l.l_extendedprice * (1 - l.l_discount) AS line_total,
       l.l_extendedprice * (1 - l.l_discount) - l.l_quantity * p.p_retailprice AS profit_margin
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey""")
def fact_margin(spark, root):
    t = Tables(spark, root)
    return S.line_margin(t.lineitem, t.part)


@register("sales_by_region", """
SELECT r.r_name AS region, COUNT(*) AS n_orders, ROUND(SUM(o.o_totalprice), 2) AS total_sales
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_name""")
def sales_by_region(spark, root):
    t = Tables(spark, root)
    return S.sales_by_region(t.orders, t.customer, t.nation, t.region)


@register("sales_by_product", """
SELECT p.p_brand AS product_group,
       ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue,
       ROUND(SUM(l.l_extendedprice * (1 - l.l_discount) - l.l_quantity * p.p_retailprice), 2) AS margin,
       SUM(l.l_quantity) AS quantity
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY p.p_brand""")
def sales_by_product(spark, root):
    t = Tables(spark, root)
    return S.sales_by_product_group(t.lineitem, t.part)


@register("sales_by_month", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(*) AS n_orders,
       ROUND(SUM(o_totalprice), 2) AS total_sales
FROM orders GROUP BY 1""")
def sales_by_month(spark, root):
    return S.sales_by_month(Tables(spark, root).orders)


@register("monthly_view", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(*) AS n_orders,
       ROUND(SUM(o_totalprice), 2) AS total_sales
FROM orders GROUP BY 1 HAVING COUNT(*) > 1""")
def monthly_view(spark, root):
    publish_view(S.sales_by_month(Tables(spark, root).orders), "monthly_sales")
    return spark.sql("SELECT month, n_orders, total_sales FROM monthly_sales WHERE n_orders > 1")


@register("stored_monthly_view", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) AS total_sales
FROM orders GROUP BY 1, 2""")
def stored_monthly_view(spark, root):
    """A view in the catalogue over the table's path, read by name from another
    session of the application."""
    t = Tables(spark, root)
    name = "monthly_sales_" + hashlib.sha256(t.path("orders").encode()).hexdigest()[:12]     # one view a table
    store_view(spark, name, """SELECT CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS month, o_orderstatus, COUNT(*) AS n_orders,
                                      ROUND(SUM(o_totalprice), 2) AS total_sales FROM {orders} GROUP BY 1, 2""", orders=t.path("orders"))
    return spark.newSession().table(name)


@register("listed_orders", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def listed_orders(spark, root):
    t = Tables(spark, root)
    chosen = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return listed(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", chosen, "c_custkey")
