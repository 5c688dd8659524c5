"""Star-schema shaping: cleaned dimensions and facts, margin, sales trends.

Small fixed dimensions (region, nation: row counts fixed by definition)
are broadcast.  Dimensions that grow with the data (customer, part) are
joined without a hint — broadcast only if the planner or AQE knows the size,
sort-merge otherwise — and facts are aggregated *before* they meet a
growing dimension so the shuffle carries one row per key, not per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F



def dim_snowflake(child: DataFrame, mid: DataFrame, top: DataFrame,
                  child_key: str, mid_key: str, mid_parent: str, top_key: str,
                  select: dict[str, str]) -> DataFrame:
    """Left-join chain child → mid → top where the second key comes from the
    nullable middle side (a child without a parent keeps NULL top columns).
    ``select`` maps output name → source column."""
    j = child.join(mid, child[child_key] == mid[mid_key], "left") \
             .join(top, F.col(mid_parent) == top[top_key], "left")
    return j.select(*[F.col(src).alias(out) for out, src in select.items()])


def project(df: DataFrame, select: dict[str, str]) -> DataFrame:
    """Cleaned table: keep and rename a subset of columns."""
    return df.select(*[F.col(f"`{src}`").alias(out) for out, src in select.items()])


def line_margin(lines: DataFrame, products: DataFrame, *, line_key: str = "l_partkey",
                product_key: str = "p_partkey", qty: str = "l_quantity",
                price: str = "l_extendedprice", discount: str = "l_discount",
                unit_cost: str = "p_retailprice") -> DataFrame:
    """Fact ⟕ product: line total and ``line_total - qty * unit_cost``
    (NULL margin for a line whose product is unknown)."""
    p = products.select(F.col(product_key).alias("__pk"), F.col(unit_cost).alias("__cost"))
    line_total = F.col(price) * (F.lit(1) - F.col(discount))
    j = lines.join(p, lines[line_key] == F.col("__pk"), "left")
    return j.select(
        F.col("l_orderkey").alias("sales_order_id"),
        F.col("l_linenumber").alias("detail_id"),
        F.col(qty).alias("order_qty"),
        F.col(line_key).alias("product_id"),
        line_total.alias("line_total"),
        (line_total - F.col(qty) * F.col("__cost")).alias("profit_margin"))


def sales_by_region(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Orders and sales per region.  Orders are pre-aggregated per customer
    (map-side partial aggregate), so the join with the customer table moves
    one row per customer; nation and region are fixed-size and broadcast."""
    per_cust = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    c = customer.select("c_custkey", "c_nationkey")
    # orders of unknown customers, nations or regions count under a NULL region
    j = per_cust.join(c, per_cust.o_custkey == c.c_custkey, "left") \
        .join(F.broadcast(nation.select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"), "left") \
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.groupBy(F.col("r_name").alias("region")).agg(
        F.sum("n").alias("n_orders"), F.round(F.sum("s"), 2).alias("total_sales"))


def sales_by_product_group(lines: DataFrame, products: DataFrame, group_col: str = "p_brand") -> DataFrame:
    """Revenue, margin and quantity per product group.  Lines are summed per
    product first; margin is linear in the lines, so
    ``sum(line_total) - sum(qty) * unit_cost`` per product is exact."""
    line_total = F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))
    per_part = lines.groupBy("l_partkey").agg(F.sum(line_total).alias("rev"), F.sum("l_quantity").alias("qty"))
    p = products.select("p_partkey", group_col, "p_retailprice")
    j = per_part.join(p, per_part.l_partkey == p.p_partkey, "left")
    return j.groupBy(F.col(group_col).alias("product_group")).agg(
        F.round(F.sum("rev"), 2).alias("revenue"),
        F.round(F.sum(F.col("rev") - F.col("qty") * F.col("p_retailprice")), 2).alias("margin"),
        F.sum("qty").alias("quantity"))


def sales_by_month(orders: DataFrame, ts: str = "o_orderdate", amount: str = "o_totalprice") -> DataFrame:
    """Orders and sales per calendar month."""
    return orders.groupBy(F.trunc(F.to_date(ts), "month").alias("month")).agg(
        F.count("*").alias("n_orders"), F.round(F.sum(amount), 2).alias("total_sales"))
