"""Figure datasets over the affordability tables (see ``housing``)."""

from __future__ import annotations

from tidewater.catalog import register
from tidewater.catalog.housing import BASE, _region, _star
from tidewater.plans import figures as G
from tidewater.plans import sheets as SH

SPEC = G.FigureSpec()
_W = f"Region_Name = '{SPEC.series_entity}'"
_BANDS = ", ".join(f"('{n}', {float(lo)}, {float(hi)})" for n, lo, hi in SPEC.bands)


@register("period_bands", BASE + f"""
SELECT r."Year", r.Affordability_Ratio, b.band
FROM (SELECT * FROM region_data WHERE {_W}) r
LEFT JOIN (VALUES {_BANDS}) b(band, band_lo, band_hi) ON r."Year" >= b.band_lo AND r."Year" <= b.band_hi""")
def period_bands(spark, root):
    return G.period_bands(spark, _region(spark, root), SPEC)


@register("threshold_flags", BASE + f"""
SELECT "Year", Affordability_Ratio, Affordability_Ratio > {SPEC.threshold} AS above,
       Affordability_Ratio - {SPEC.threshold} AS gap
FROM region_data WHERE {_W}""")
def threshold_flags(spark, root):
    return G.threshold_flags(_region(spark, root), SPEC)


@register("highlights", BASE + f"""
SELECT "Year", round_even(Median_House_Price / 1000.0, 1) AS price_k_label,
       round_even({SPEC.earnings_multiple} * Median_Earnings / 1000.0, 1) AS earnings5_k_label
FROM region_data WHERE {_W} AND "Year" IN ({", ".join(str(y) for y in SPEC.highlight_years)})""")
def highlights(spark, root):
    return G.highlights(_region(spark, root), SPEC)


@register("region_facets", BASE + f"""
SELECT Region_Name, "Year", Median_House_Price / 1000.0 AS price_k,
       {SPEC.earnings_multiple} * Median_Earnings / 1000.0 AS earnings5_k
FROM region_data WHERE Region_Name <> '{SPEC.series_entity}'""")
def region_facets(spark, root):
    return G.region_facets(_region(spark, root), SPEC)


@register("axis_clip", BASE + f"""
SELECT Region_Name, "Year",
       CASE WHEN Affordability_Ratio BETWEEN {SPEC.ratio_limits[0]} AND {SPEC.ratio_limits[1]}
            THEN Affordability_Ratio END AS ratio_in_axis
FROM region_data""")
def axis_clip(spark, root):
    return G.axis_clip(_region(spark, root), SPEC)


@register("dual_series", BASE + f"""
SELECT "Year", '{SPEC.price_label}' AS series, Median_House_Price / 1000.0 AS value FROM region_data WHERE {_W}
UNION ALL
SELECT "Year", '{SPEC.earnings_label}', {SPEC.earnings_multiple} * Median_Earnings / 1000.0 FROM region_data WHERE {_W}""")
def dual_series(spark, root):
    return G.dual_series(_region(spark, root), SPEC)


@register("bar_totals", f"""
WITH first AS (SELECT o_custkey, MIN(CAST(year(o_orderdate) AS INTEGER)) AS "Year" FROM orders GROUP BY o_custkey)
SELECT "Year", CAST(COUNT(*) AS DOUBLE) / 1000.0 AS value_k,
       CAST(COUNT(*) AS DOUBLE) / 1000.0 >= {SPEC.bar_threshold} AS at_or_above
FROM first GROUP BY "Year" """)
def bar_totals(spark, root):
    return G.bar_totals(SH.new_customers_per_year(_star(spark, root)), spec=SPEC)


@register("supply_sheet_bars", f"""
WITH first AS (SELECT o_custkey, MIN(CAST(year(o_orderdate) AS INTEGER)) AS "Year" FROM orders GROUP BY o_custkey)
SELECT "Year", CAST(COUNT(*) AS DOUBLE) / 1000.0 AS value_k,
       CAST(COUNT(*) AS DOUBLE) / 1000.0 >= {SPEC.bar_threshold} AS at_or_above
FROM first GROUP BY "Year" """)
def supply_sheet_bars(spark, root):
    """The supply series exported as a plain sheet (CSV with header) and read
    back with an explicit schema before the bar totals."""
    from tidewater.catalog.housing import _scratch
    from tidewater.sources.sheets import read_sheet
    from tidewater.sources.sinks import write_datasets
    out = _scratch(spark, "supply")
    write_datasets({"supply": SH.new_customers_per_year(_star(spark, root))}, out, fmt="csv")
    back = read_sheet(spark, f"{out}/supply", "Year int, Net_Additional double", fmt="csv", header=False)
    return G.bar_totals(back, spec=SPEC)
