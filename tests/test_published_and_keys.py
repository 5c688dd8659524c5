"""Published result rows as a tiny fixture; unmatched and NULL join keys."""

from tidewater.plans.affordability import ranked_districts
from tidewater.plans.star import dim_snowflake, line_margin

# ---- fixed values: the report's two published tables (2022, ratio to one decimal) ----
# (region, local authority, affordability ratio)
LOWEST_TEN = [
    ("North West", "Copeland", 2.9), ("North West", "Barrow-in-Furness", 3.9), ("North West", "Hyndburn", 4.1),
    ("North East", "Hartlepool", 4.1), ("North East", "County Durham", 4.3), ("North East", "Middlesbrough", 4.4),
    ("Yorkshire and The Humber", "Kingston upon Hull, City", 4.4), ("North West", "Blackburn with Darwen", 4.6),
    ("West Midlands", "Stoke-on-Trent", 4.6), ("North West", "Burnley", 4.6),
]
HIGHEST_TEN = [
    ("London", "Kensington and Chelsea", 38.4), ("London", "Westminster", 22.0),
    ("London", "Richmond upon Thames", 20.7), ("South East", "Elmbridge", 20.0),
    ("South East", "Epsom and Ewell", 20.0), ("London", "Hammersmith and Fulham", 19.6),
    ("London", "Wandsworth", 18.9), ("East of England", "St Albans", 18.4), ("London", "Haringey", 18.0),
    ("London", "Camden", 18.0),
]


def test_published_rankings_reproduced_from_their_rows(spark):
    rows = [(r, n, f"LA{i:02d}", 2022, v) for i, (r, n, v) in enumerate(LOWEST_TEN + HIGHEST_TEN)]
    rows.append(("London", "Missing ratio", "LA99", 2022, None))  # NA sorts last both ways
    dy = spark.createDataFrame(rows, "Region_Name string, Local_Authority_Name string, "
                                     "Local_Authority_Code string, Year int, Affordability_Ratio double")
    low = ranked_districts(dy, 10).collect()
    high = ranked_districts(dy, 10, least_affordable=True).collect()
    assert [r.Affordability_Ratio for r in low] == sorted(v for _, _, v in LOWEST_TEN)
    assert {r.Local_Authority_Name for r in low} == {n for _, n, _ in LOWEST_TEN}
    assert [r.Affordability_Ratio for r in high] == sorted((v for _, _, v in HIGHEST_TEN), reverse=True)
    assert {r.Local_Authority_Name for r in high} == {n for _, n, _ in HIGHEST_TEN}
    # rounded ties are broken by name: Elmbridge before Epsom and Ewell, Camden before Haringey
    names = [r.Local_Authority_Name for r in high]
    assert names.index("Elmbridge") < names.index("Epsom and Ewell")
    assert names.index("Camden") < names.index("Haringey")


def test_snowflake_keeps_unmatched_and_null_keys(spark):
    child = spark.createDataFrame([(1, "a", 10), (2, "b", 99), (3, "c", None)], "c_custkey long, c_name string, c_nationkey int")
    mid = spark.createDataFrame([(10, "N10", 1), (11, "N11", None)], "n_nationkey int, n_name string, n_regionkey int")
    top = spark.createDataFrame([(1, "R1"), (None, "RNULL")], "r_regionkey int, r_name string")
    out = {r.customer_id: (r.nation_name, r.region_name) for r in dim_snowflake(
        child, mid, top, "c_nationkey", "n_nationkey", "n_regionkey", "r_regionkey",
        {"customer_id": "c_custkey", "nation_name": "n_name", "region_name": "r_name"}).collect()}
    assert out == {1: ("N10", "R1"), 2: (None, None), 3: (None, None)}  # NULL keys never match in SQL


def test_margin_null_for_unknown_product(spark):
    lines = spark.createDataFrame([(1, 1, 5, 2.0, 100.0, 0.1), (1, 2, 6, 1.0, 50.0, 0.0), (2, 1, None, 1.0, 10.0, 0.0)],
                                  "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, "
                                  "l_extendedprice double, l_discount double")
    parts = spark.createDataFrame([(5, 20.0)], "p_partkey long, p_retailprice double")
    out = {(r.sales_order_id, r.detail_id): (r.line_total, r.profit_margin) for r in line_margin(lines, parts).collect()}
    assert out[(1, 1)] == (90.0, 50.0)
    assert out[(1, 2)] == (50.0, None) and out[(2, 1)] == (10.0, None)


def test_retention_first_day_and_labels(spark):
    import datetime as dt
    from tidewater.plans.customers import customer_retention
    o = spark.createDataFrame([(1, 7, dt.datetime(2020, 1, 1, 9)), (2, 7, dt.datetime(2020, 1, 1, 18)),
                               (3, 7, dt.datetime(2020, 1, 5)), (4, 8, dt.datetime(2021, 3, 1))],
                              "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    out = sorted((r.customer_id, r.subsequent_day, r.retention) for r in customer_retention(o).collect())
    assert out == [(7, 0, "New Customers"), (7, 0, "New Customers"), (7, 4, "Retained Customers"),
                   (8, 0, "New Customers")]
