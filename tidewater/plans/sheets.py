"""Sheet-shaped inputs derived from the star tables.

The source analyses start from spreadsheets: long entity-year sheets
(country, region and world rows) and wide sheets with one text column per
year where ``':'`` marks a suppressed cell.  These functions derive sheets
of the same shape from the order and line facts so that every analysis
grows with the data:

* entities: nations (with a code), their regions and the world (no code);
* long sheets: order totals, totals per customer ("per capita"), line
  consumption and gross value per customer, customer counts;
* wide sheets: median order value ("price") by customer nation/region and
  median line revenue ("earnings") by supplier nation/region per year,
  with ``':'`` in the cells that a parameter lists as withheld.

Facts are aggregated before every join with a growing dimension; the
entity-year tables after that are tiny (entities x years).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.operators.order_stats import medians_by_level
from tidewater.operators.ranges import cut_lineage

WORLD = "World"


@dataclass(frozen=True)
class Star:
    orders: DataFrame
    lineitem: DataFrame
    customer: DataFrame
    supplier: DataFrame
    nation: DataFrame
    region: DataFrame


def nation_code(key: Column) -> Column:
    return F.concat(F.lit("NAT"), key.cast("string"))


def region_code(key: Column) -> Column:
    return F.concat(F.lit("REG"), key.cast("string"))


def _geo(s: Star) -> DataFrame:
    # nation and region have fixed row counts: broadcast is bounded
    return F.broadcast(s.nation.join(F.broadcast(s.region), s.nation.n_regionkey == s.region.r_regionkey)
                       .select("n_nationkey", "n_name", "r_regionkey", "r_name"))


def _levels(per_nation: DataFrame, s: Star, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Nation rows plus region and world roll-ups of additive columns
    (``rollup`` over the tiny per-nation table)."""
    # rows without a known nation stay: under a NULL entity, and in the world row
    named = per_nation.join(_geo(s), per_nation["__nk"] == F.col("n_nationkey"), "left")
    r = named.rollup(*by, "r_name", "n_name").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.max("n_nationkey").alias("__nk"), F.grouping_id().alias("__gid"))
    # drop the grand total over `by` (a NULL year is a group), and the unknown
    # region, whose rows are the unknown nation's
    r = r.where((F.col("__gid") < 4) & ~((F.col("__gid") == 1) & F.col("r_name").isNull()))
    entity = F.when(F.col("__gid") == 0, F.col("n_name")).when(F.col("__gid") == 1, F.col("r_name")) \
              .otherwise(F.lit(WORLD))
    code = F.when(F.col("__gid") == 0, nation_code(F.col("__nk")))
    return r.select(entity.alias("entity"), code.alias("code"), *by, *sums)


def customer_counts(s: Star) -> DataFrame:
    """Customers per entity ("population")."""
    per_nation = s.customer.groupBy(F.col("c_nationkey").alias("__nk")).agg(F.count("*").alias("population"))
    out = _levels(per_nation, s, [], ["population"])
    return out.select("entity", "population")


def order_totals(s: Star) -> DataFrame:
    """entity, code, year, amount: order value per entity and year.

    Orders are summed per (customer, year) map-side, joined to the
    customer's nation (one row per customer-year crosses the shuffle),
    then summed per nation and rolled up."""
    per_cy = s.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")) \
        .agg(F.sum("o_totalprice").alias("amount"))
    c = s.customer.select("c_custkey", F.col("c_nationkey").alias("__nk"))
    per_n = per_cy.join(c, per_cy.o_custkey == c.c_custkey, "left").groupBy("__nk", "year") \
        .agg(F.sum("amount").alias("amount"))
    out = _levels(per_n, s, ["year"], ["amount"])
    return out.withColumn("amount", F.round("amount", 2))


def per_customer_totals(s: Star, totals: DataFrame | None = None) -> DataFrame:
    """entity, code, year, amount_capita = amount / customers."""
    totals = totals if totals is not None else order_totals(s)
    pop = customer_counts(s)
    return totals.join(pop, "entity", "left").select(
        "entity", "code", "year", F.try_divide(F.col("amount"), F.col("population")).alias("amount_capita"))


def line_values(s: Star) -> DataFrame:
    """entity, year, consumption_capita, gross_capita, population.

    Lines are summed per order first; that table is hash-partitioned by the
    order key, so the join with orders shuffles only the order side."""
    ext, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    per_order = s.lineitem.groupBy("l_orderkey").agg(
        F.sum(ext * (F.lit(1) - disc) * (F.lit(1) + tax)).alias("cons"), F.sum(ext).alias("gross"))
    o = s.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    per_cy = per_order.join(o, per_order.l_orderkey == o.o_orderkey, "left") \
        .groupBy("o_custkey", "year").agg(F.sum("cons").alias("cons"), F.sum("gross").alias("gross"))
    c = s.customer.select("c_custkey", F.col("c_nationkey").alias("__nk"))
    per_n = per_cy.join(c, per_cy.o_custkey == c.c_custkey, "left").groupBy("__nk", "year") \
        .agg(F.sum("cons").alias("cons"), F.sum("gross").alias("gross"))
    lv = _levels(per_n, s, ["year"], ["cons", "gross"])
    pop = customer_counts(s)
    return lv.join(pop, "entity", "left").select(
        "entity", "year",
        F.try_divide(F.round("cons", 2), F.col("population")).alias("consumption_capita"),
        F.try_divide(F.round("gross", 2), F.col("population")).alias("gross_capita"),
        "population")


# ------------------------------------------------------------------ wide sheets

@dataclass(frozen=True)
class WideSpec:
    years: tuple[int, ...] = tuple(range(1995, 2002))
    # withheld cells (code, year), shown as ':' whatever their number of rows
    withheld_price: tuple[tuple[str, int], ...] = (
        ("NAT3", 1996), ("NAT7", 1998), ("NAT7", 1999), ("NAT12", 1997), ("NAT18", 1995), ("REG1", 1996))
    withheld_earnings: tuple[tuple[str, int], ...] = (
        ("NAT5", 1995), ("NAT9", 2000), ("NAT12", 1997), ("NAT20", 2001), ("REG3", 1999))
    price_header: str = "Year {y}"
    earnings_header: str = "Earnings {y}"


def _cell(median: Column, withheld: Column) -> Column:
    # printed sheet values: the median to 3 decimals (medians of cents)
    return F.when(withheld, F.lit(":")).otherwise(F.round(median, 3).cast("string"))


def _withheld(pairs: Sequence[tuple[str, int]]) -> Column:
    out = F.lit(False)
    for code, year in pairs:
        out = out | ((F.col("code") == code) & (F.col("year") == year))
    return F.coalesce(out, F.lit(False))


WORLD_CODE = "WLD"


def _pivot(cells: DataFrame, ids: list[str], spec: WideSpec, header: str) -> DataFrame:
    # the spec's years, then any other that the cells have; cells without a
    # year get a column of their own, whose header names none
    found = {r.year for r in cells.select("year").distinct().collect()}      # one row a sheet column
    years = [*sorted({*spec.years, *(y for y in found if y is not None)}), *(["NA"] if None in found else [])]
    year = F.coalesce(F.col("year").cast("string"), F.lit("NA"))
    label = F.concat(F.lit(header.split("{y}")[0]), year, F.lit(header.split("{y}")[1]))
    return cells.withColumn("__label", label).groupBy(*ids).pivot("__label", [header.format(y=y) for y in years]).agg(F.first("cell"))


def entity_levels(s: Star) -> DataFrame:
    """``(__nk, level, code)``: each nation's own code, its region's and the
    world's; an unknown nation (NULL) belongs to the world only."""
    geo, nk = _geo(s), F.col("n_nationkey").alias("__nk")
    known = geo.select(nk, F.lit("n").alias("level"), nation_code(F.col("n_nationkey")).alias("code")) \
        .union(geo.select(nk, F.lit("r"), region_code(F.col("r_regionkey")))).union(geo.select(nk, F.lit("w"), F.lit(WORLD_CODE)))
    return known.unionByName(s.region.agg(F.lit(None).cast("int").alias("__nk"), F.lit("w").alias("level"), F.lit(WORLD_CODE).alias("code")))


def sheet_rows(s: Star, which: Sequence[str] = ("price", "earnings")) -> DataFrame:
    """``(sheet, year, __nk, v)``: order values by customer nation and line
    revenues by supplier nation.  Rows whose customer, supplier or nation is
    unknown have a NULL nation."""
    known = F.broadcast(_geo(s).select("n_nationkey"))
    parts = []
    if "price" in which:
        facts = s.orders.select(F.col("o_custkey").alias("__key"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("v"))
        parts.append(("price", facts, s.customer.select(F.col("c_custkey").alias("__key"), F.col("c_nationkey").alias("__n"))))
    if "earnings" in which:
        facts = s.lineitem.select(F.col("l_suppkey").alias("__key"), F.year("l_shipdate").alias("year"),
                                  (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("v"))
        parts.append(("earnings", facts, s.supplier.select(F.col("s_suppkey").alias("__key"), F.col("s_nationkey").alias("__n"))))
    rows = None
    for name, facts, keys in parts:
        keys = keys.join(known, F.col("__n") == F.col("n_nationkey"), "left").select("__key", F.col("n_nationkey").alias("__nk"))
        part = facts.join(keys, "__key", "left").select(F.lit(name).alias("sheet"), "year", "__nk", "v")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def sheet_cells(s: Star, spec: WideSpec = WideSpec(), which: Sequence[str] = ("price", "earnings"), **bounds: int) -> DataFrame:
    """Cells of the price and/or earnings sheets in one table
    (sheet, level, code, year, median, n_obs, cell).  Every fact row is counted
    once, under its nation; regions and the world are sums of their nations'
    histograms.  The small result is checkpointed once."""
    m = medians_by_level(sheet_rows(s, which), ["sheet", "year"], "__nk", entity_levels(s), "v", **bounds)
    m = m.withColumnRenamed("n", "n_obs")
    withheld = F.when(F.col("sheet") == "price", _withheld(spec.withheld_price)).otherwise(_withheld(spec.withheld_earnings))
    return cut_lineage(m.withColumn("cell", _cell(F.col("median"), withheld)))


def price_cells(s: Star, spec: WideSpec = WideSpec(), cells: DataFrame | None = None) -> DataFrame:
    c = cells if cells is not None else sheet_cells(s, spec, ("price",))
    return c.where(F.col("sheet") == "price").drop("sheet")


def earnings_cells(s: Star, spec: WideSpec = WideSpec(), cells: DataFrame | None = None) -> DataFrame:
    c = cells if cells is not None else sheet_cells(s, spec, ("earnings",))
    return c.where(F.col("sheet") == "earnings").drop("sheet")


def _names(s: Star) -> DataFrame:
    g = s.nation.join(F.broadcast(s.region), s.nation.n_regionkey == s.region.r_regionkey)
    return F.broadcast(g.select(nation_code(F.col("n_nationkey")).alias("la_code"), F.col("n_name").alias("la_name"),
                                region_code(F.col("r_regionkey")).alias("rg_code"), F.col("r_name").alias("rg_name")))


def region_sheet(cells: DataFrame, s: Star, spec: WideSpec, header: str) -> DataFrame:
    """Wide region sheet: Code, Name, one text column per year; regions plus
    the world row."""
    names = F.broadcast(s.region.select(region_code(F.col("r_regionkey")).alias("code"), F.col("r_name").alias("Name"))
                        .unionByName(s.region.agg(F.lit(WORLD_CODE).alias("code"), F.lit(WORLD).alias("Name"))))
    wide = _pivot(cells.where(F.col("level") != "n").select("code", "year", "cell"), ["code"], spec, header)
    return names.join(wide, "code", "left").withColumnRenamed("code", "Code")


def district_sheet(cells: DataFrame, s: Star, spec: WideSpec, header: str, earnings_layout: bool) -> DataFrame:
    """Wide district sheet: region code/name, district code/name, years.
    The earnings layout names its district columns ``Code``/``Name``."""
    wide = _pivot(cells.where(F.col("level") == "n").select(F.col("code").alias("la_code"), "year", "cell"),
                  ["la_code"], spec, header)
    out = _names(s).join(wide, "la_code", "left")
    years = wide.columns[1:]
    la_c, la_n = ("Code", "Name") if earnings_layout else ("Local authority code", "Local authority name")
    return out.select(F.col("rg_code").alias("Region code"), F.col("rg_name").alias("Region name"),
                      F.col("la_code").alias(la_c), F.col("la_name").alias(la_n), *[F.col(f"`{y}`") for y in years])


def housing_sheets(s: Star, spec: WideSpec = WideSpec(), which: Sequence[str] | None = None,
                   pc: DataFrame | None = None, ec: DataFrame | None = None) -> dict[str, DataFrame]:
    """The four wide sheets of the affordability analysis (or those named
    in ``which``); precomputed cell tables may be passed in."""
    which = set(which or ("region_price", "region_earnings", "district_price", "district_earnings"))
    need = [k for k, names in (("price", {"region_price", "district_price"}),
                               ("earnings", {"region_earnings", "district_earnings"})) if which & names]
    need = [k for k in need if (pc if k == "price" else ec) is None]
    if need:
        cells = sheet_cells(s, spec, need)
        pc = pc if pc is not None else price_cells(s, spec, cells)
        ec = ec if ec is not None else earnings_cells(s, spec, cells)
    out = {}
    if "region_price" in which:
        out["region_price"] = region_sheet(pc, s, spec, spec.price_header)
    if "region_earnings" in which:
        out["region_earnings"] = region_sheet(ec, s, spec, spec.earnings_header)
    if "district_price" in which:
        out["district_price"] = district_sheet(pc, s, spec, spec.price_header, earnings_layout=False)
    if "district_earnings" in which:
        out["district_earnings"] = district_sheet(ec, s, spec, spec.earnings_header, earnings_layout=True)
    return out


def missing_district_rows(s: Star, spec: WideSpec = WideSpec(), pc: DataFrame | None = None,
                          ec: DataFrame | None = None) -> DataFrame:
    """Hand-collected fill-ins for districts whose ratio is missing: for each
    nation-year whose price or earnings cell is withheld or absent, a ratio of mean
    order value to mean line revenue from all its rows.  Columns as the
    appended sheet: Year, Affordability_Ratio, Region_Name,
    Local_Authority_Code, Local_Authority_Name."""
    geo = _geo(s)
    if pc is None or ec is None:
        cells = sheet_cells(s, spec)
        pc, ec = price_cells(s, spec, cells), earnings_cells(s, spec, cells)
    gaps = pc.where(F.col("level") == "n").select("code", "year", F.col("cell").alias("pcell")) \
        .join(ec.where(F.col("level") == "n").select("code", "year", F.col("cell").alias("ecell")),
              ["code", "year"], "full") \
        .where((F.coalesce(F.col("pcell"), F.lit(":")) == ":") | (F.coalesce(F.col("ecell"), F.lit(":")) == ":"))
    o = s.orders.select("o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    c = s.customer.select("c_custkey", F.col("c_nationkey").alias("__nk"))
    # sums and counts per customer and supplier first: one row per key and year is joined
    o = o.groupBy("o_custkey", "year").agg(F.sum("o_totalprice").alias("s"), F.count("o_totalprice").alias("n"))
    po = o.join(c, o.o_custkey == c.c_custkey).groupBy(nation_code(F.col("__nk")).alias("code"), "year") \
        .agg(F.try_divide(F.sum("s"), F.sum("n")).alias("p"))
    sup = s.supplier.select("s_suppkey", F.col("s_nationkey").alias("__nk"))
    li = s.lineitem.select("l_suppkey", F.year("l_shipdate").alias("year"),
                           (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("revenue"))
    li = li.groupBy("l_suppkey", "year").agg(F.sum("revenue").alias("s"), F.count("revenue").alias("n"))
    el = li.join(sup, li.l_suppkey == sup.s_suppkey).groupBy(nation_code(F.col("__nk")).alias("code"), "year") \
        .agg(F.try_divide(F.sum("s"), F.sum("n")).alias("e"))
    names = geo.select(nation_code(F.col("n_nationkey")).alias("code"), F.col("n_name").alias("Local_Authority_Name"),
                       F.col("r_name").alias("Region_Name"))
    out = gaps.select("code", "year").join(po, ["code", "year"], "left").join(el, ["code", "year"], "left") \
        .join(names, "code", "left")
    return out.select(F.col("year").cast("int").alias("Year"),
                      F.round(F.try_divide(F.col("p"), F.col("e")), 6).alias("Affordability_Ratio"),
                      "Region_Name", F.col("code").alias("Local_Authority_Code"), "Local_Authority_Name")


def new_customers_per_year(s: Star) -> DataFrame:
    """Year, Net_Additional: customers whose first order falls in the year
    (a bar series; two map-side aggregations)."""
    first = s.orders.groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("Year"))
    return first.groupBy("Year").agg(F.count("*").cast("double").alias("Net_Additional"))


def star_from(tables) -> Star:
    return Star(orders=tables.orders, lineitem=tables.lineitem, customer=tables.customer,
                supplier=tables.supplier, nation=tables.nation, region=tables.region)
