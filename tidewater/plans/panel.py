"""Entity-by-year panel analysis (merge, range, change, leaders, shares,
running totals, stacks, map join, elasticity).

Input sheets: ``a`` (entity, code, year, amount), ``b`` (entity, code,
year, amount_capita), ``c`` (entity, year, consumption_capita,
gross_capita, population).  The panel has one row per entity-year, so
per-entity windows and the small sorts below work on bounded data; the
fact-scale work happens when the sheets are derived.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from tidewater.functions.na import in_list, ln_positive, try_div
from tidewater.functions.text import share_label
from tidewater.operators.joins import join_null_safe
from tidewater.operators.series import lag_pct_change, running_total, stack_bounds
from tidewater.operators.topk import top_n, top_n_per_group, with_remainder

PANEL_COLUMNS = ("entity", "code", "year", "amount", "amount_capita", "consumption_capita",
                 "gross_capita", "population")


@dataclass(frozen=True)
class PanelSpec:
    year_lo: int = 1995
    year_hi: int = 2000
    unit: float = 1e6                 # amount_scaled = amount / unit
    world: str = "World"
    last_year: int = 2000
    top_k: int = 5
    rest_label: str = "Rest of the World"
    # allow-list of entities for shares and running totals (a parameter)
    allow: tuple[str, ...] = ("NATION_0", "NATION_1", "NATION_2", "NATION_3",
                              "NATION_4", "NATION_5", "NATION_6", "NATION_7")


def merge_sheets(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """Left-join the three sheets on (entity, year); NULL keys match as in
    dplyr.  The code comes from sheet ``a`` (an explicit choice: the
    source's code provenance depends on which sheets carry one)."""
    m = join_null_safe(a, b.drop("code"), ["entity", "year"], "left")
    m = join_null_safe(m, c, ["entity", "year"], "left")
    return m.select(*PANEL_COLUMNS)


def year_range(panel: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Inclusive year range plus the scaled amount."""
    return panel.where(F.col("year").between(spec.year_lo, spec.year_hi)) \
        .withColumn("amount_scaled", F.col("amount") / F.lit(spec.unit))


def with_change(main: DataFrame) -> DataFrame:
    """Percentage change from the entity's previous row (after the range
    filter, so the first year in range has none)."""
    return lag_pct_change(main, "entity", "year", "amount", "pct_change")


def entity_series(main: DataFrame, entity: str) -> DataFrame:
    return main.where(F.col("entity") == entity).select("year", "amount_scaled", "pct_change")


def running_totals(main: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Allow-listed entities with the cumulative scaled amount (NULL from
    the first missing year on, as R's ``cumsum``)."""
    d = main.where(in_list("entity", spec.allow)) \
        .select("entity", "code", "year", "amount_scaled", "amount_capita", "pct_change")
    out = running_total(d, "entity", "year", "amount_scaled", "cumulative")
    return out.withColumn("cumulative", F.round("cumulative", 6))  # float sums: fixed precision


def entity_order(rt: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Last-year rows in descending cumulative order with their 1-based
    ordinal (the category order of the stacked chart).  The window spans the
    allow-listed entities only."""
    last = rt.where(F.col("year") == spec.last_year)
    w = W.orderBy(F.col("cumulative").desc_nulls_last(), F.col("entity"))
    return last.withColumn("ordinal", F.row_number().over(w))


def stacked(rt: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Per-year stack bounds with entities in last-year order; an entity
    missing from the last year has no ordinal and is stacked last."""
    order = entity_order(rt, spec).select("entity", "ordinal")
    d = rt.join(F.broadcast(order), "entity", "left")  # <= len(allow) rows
    d = d.withColumn("__ord", F.coalesce(F.col("ordinal"), F.lit(10 ** 6)))
    out = stack_bounds(d, "year", ["__ord", "entity"], "cumulative")
    return out.select("entity", "year", "ordinal", "cumulative", F.round("stack_lower", 6).alias("stack_lower"),
                      F.round("stack_upper", 6).alias("stack_upper"))


def top_with_rest(main: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Top ``k`` allow-listed entities in the last year, plus a remainder
    row (world total minus the top ``k``), with the share of the world total
    and a text label."""
    y = main.where(F.col("year") == spec.last_year)
    top = top_n(y.where(in_list("entity", spec.allow)).select("entity", "amount_scaled"),
                "amount_scaled", spec.top_k, ["entity"])
    total = y.where(F.col("entity") == spec.world).agg(F.first("amount_scaled").alias("total"))
    rows = with_remainder(top, "entity", "amount_scaled", total, spec.rest_label)
    pct = try_div(F.col("amount_scaled"), F.col("total")) * F.lit(100.0)
    out = rows.crossJoin(F.broadcast(total)).withColumn("percentage_of_total", pct)  # one-row total
    out = out.withColumn("label", share_label("amount_scaled", "percentage_of_total")).drop("total")
    # values derived from float sums: fixed precision for stable output
    out = out.withColumns({"amount_scaled": F.round("amount_scaled", 6),
                           "percentage_of_total": F.round("percentage_of_total", 6)})
    # re-sorted after the remainder row is appended: bar position (k+1 rows)
    w = W.orderBy(F.col("amount_scaled").desc_nulls_last(), F.col("entity"))
    return out.withColumn("position", F.row_number().over(w))


def leaders(main: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Three rankings of coded entities (nations): latest amount, cumulative
    amount over the range, latest amount per customer; top ``k`` each."""
    coded = main.where(F.col("code").isNotNull())
    cum = coded.groupBy("entity").agg(F.sum("amount_scaled").alias("v"))
    last = coded.where(F.col("year") == spec.last_year)
    long = last.select(F.lit("latest").alias("ranking"), "entity", F.col("amount_scaled").alias("v")) \
        .unionByName(cum.select(F.lit("cumulative").alias("ranking"), "entity", "v")) \
        .unionByName(last.select(F.lit("per_capita").alias("ranking"), "entity", F.col("amount_capita").alias("v")))
    out = top_n_per_group(long, ["ranking"], "v", spec.top_k, ["entity"])
    return out.select("ranking", "rank", "entity", F.round("v", 6).alias("value"))


def boundary_from(nation: DataFrame) -> DataFrame:
    """Boundary table surrogate: code, name and a WKT point per nation."""
    from tidewater.plans.sheets import nation_code
    return nation.select(nation_code(F.col("n_nationkey")).alias("iso_code"), F.col("n_name").alias("name"),
                         F.concat(F.lit("POINT ("), F.col("n_nationkey").cast("string"), F.lit(" "),
                                  F.col("n_regionkey").cast("string"), F.lit(")")).alias("geom_wkt"))


def map_keep_all(boundary: DataFrame, main: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Boundary ⟕ last-year coded rows: unmatched shapes stay with NULL
    values; the colour scale is log per-customer amount."""
    d = main.where((F.col("year") == spec.last_year) & F.col("code").isNotNull()) \
        .select(F.col("code").alias("iso_code"), "entity", "amount_capita")
    j = boundary.join(d, "iso_code", "left")
    return j.withColumn("log_amount_capita", ln_positive("amount_capita"))


def elasticity(main: DataFrame, x: str = "gross_capita", y: str = "amount_capita") -> DataFrame:
    """Log-log slope of ``y`` on ``x`` per entity and overall (positive
    rows only): % change of y per 1 % change of x."""
    pos = main.where((F.col(x) > 0) & (F.col(y) > 0)) \
        .select("entity", F.ln(x).alias("lx"), F.ln(y).alias("ly"))
    per = pos.groupBy("entity").agg(F.round(F.regr_slope("ly", "lx"), 6).alias("slope"), F.count("*").alias("n"))
    allr = pos.agg(F.lit("ALL").alias("entity"), F.round(F.regr_slope("ly", "lx"), 6).alias("slope"),
                   F.count("*").alias("n"))
    return per.unionByName(allr)
