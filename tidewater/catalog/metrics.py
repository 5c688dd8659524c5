"""Report metrics over the affordability tables and the event roll-up."""

from __future__ import annotations

from tidewater.catalog import register
from tidewater.catalog.housing import BASE, _district, _dy, _region
from tidewater.plans import metrics as M
from tidewater.sources.tables import Tables

SPEC = M.MetricSpec()
T = SPEC.threshold
_R = "Affordability_Ratio"


@register("share_below", BASE + f"""
SELECT "Year", COUNT(*) AS n_areas, COUNT(*) FILTER (WHERE {_R} < {T}) AS n_below,
       AVG(CASE WHEN {_R} < {T} THEN 1.0 ELSE 0.0 END::DOUBLE) AS share_below
FROM district_data WHERE {_R} IS NOT NULL GROUP BY "Year" """)
def share_below(spark, root):
    return M.share_below(_district(spark, root), SPEC)


@register("first_breach", BASE + f"""
, obs AS (SELECT * FROM region_data WHERE {_R} IS NOT NULL),
lo AS (SELECT Region_Name, MAX(CASE WHEN {_R} <= {T} THEN "Year" END) AS last_ok FROM obs GROUP BY Region_Name)
SELECT o.Region_Name, MIN(CASE WHEN lo.last_ok IS NULL OR o."Year" > lo.last_ok THEN o."Year" END) AS above_since
FROM obs o JOIN lo ON o.Region_Name = lo.Region_Name GROUP BY o.Region_Name""")
def first_breach(spark, root):
    return M.first_breach(_region(spark, root), SPEC)


@register("growth_between", BASE + f"""
, g AS (SELECT Region_Name, MAX(CASE WHEN "Year" = {SPEC.growth_from} THEN Median_House_Price END) AS p0,
               MAX(CASE WHEN "Year" = {SPEC.growth_to} THEN Median_House_Price END) AS p1
        FROM region_data GROUP BY Region_Name)
SELECT Region_Name, (p1 - p0) / NULLIF(p0, 0) * 100 AS price_growth_pct FROM g""")
def growth_between(spark, root):
    return M.growth_between(_region(spark, root), SPEC)


@register("growth_multiple", BASE + f"""
SELECT Region_Name,
       MAX(CASE WHEN "Year" = {SPEC.last_year} THEN Median_House_Price END)
         / NULLIF(MAX(CASE WHEN "Year" = {SPEC.base_year} THEN Median_House_Price END), 0) AS price_multiple,
       MAX(CASE WHEN "Year" = {SPEC.last_year} THEN Median_Earnings END)
         / NULLIF(MAX(CASE WHEN "Year" = {SPEC.base_year} THEN Median_Earnings END), 0) AS earnings_multiple
FROM region_data GROUP BY Region_Name""")
def growth_multiple(spark, root):
    return M.growth_multiple(_region(spark, root), SPEC)


@register("position_pct", BASE + f"""
SELECT Local_Authority_Name, Region_Name, {_R},
       PERCENT_RANK() OVER (PARTITION BY "Year" ORDER BY {_R}) * 100.0 AS pct_less_affordable_than
FROM dy WHERE {_R} IS NOT NULL""")
def position_pct(spark, root):
    return M.position_pct(_dy(spark, root))


_RANGES = f"""
, rr AS (
    SELECT Region_Name, MAX({_R}) - MIN({_R}) AS ratio_range, MAX({_R}) / NULLIF(MIN({_R}), 0) AS max_over_min,
           bool_and({_R} >= {T}) AS all_at_or_above, bool_and({_R} < {T}) AS all_below
    FROM dy GROUP BY Region_Name
)"""


@register("region_ranges", BASE + _RANGES + " SELECT * FROM rr")
def region_ranges(spark, root):
    return M.region_ranges(_dy(spark, root), SPEC)


@register("narrowest_range", BASE + _RANGES + """
SELECT FIRST(Region_Name ORDER BY ratio_range ASC, Region_Name ASC) FILTER (WHERE ratio_range IS NOT NULL) AS Region_Name,
       MIN(ratio_range) AS ratio_range
FROM rr""")
def narrowest_range(spark, root):
    return M.narrowest_range(_dy(spark, root), SPEC)


@register("extreme_regions", BASE + f"""
, y AS (SELECT * FROM region_data WHERE "Year" = {SPEC.last_year} AND Region_Name <> '{SPEC.series_entity}')
SELECT FIRST(Region_Name ORDER BY {_R} ASC, Region_Name ASC) FILTER (WHERE {_R} IS NOT NULL) AS most_affordable,
       FIRST(Region_Name ORDER BY {_R} DESC, Region_Name ASC) FILTER (WHERE {_R} IS NOT NULL) AS least_affordable
FROM y""")
def extreme_regions(spark, root):
    return M.extreme_regions(_region(spark, root), SPEC)


@register("peaks_dips", BASE + f"""
, s AS (SELECT "Year", {_R} FROM region_data WHERE Region_Name = '{SPEC.series_entity}')
SELECT "Year", {_R},
       {_R} > LAG({_R}) OVER (ORDER BY "Year") AND {_R} > LEAD({_R}) OVER (ORDER BY "Year") AS local_peak,
       {_R} < LAG({_R}) OVER (ORDER BY "Year") AND {_R} < LEAD({_R}) OVER (ORDER BY "Year") AS local_dip,
       {_R} = MAX({_R}) OVER () AS global_peak
FROM s""")
def peaks_dips(spark, root):
    return M.peaks_dips(_region(spark, root), SPEC)


@register("early_growth", BASE + f"""
, g AS (SELECT Region_Name, "Year",
               (Median_House_Price - LAG(Median_House_Price) OVER w) / NULLIF(LAG(Median_House_Price) OVER w, 0) * 100
                 AS price_growth_pct
        FROM region_data WINDOW w AS (PARTITION BY Region_Name ORDER BY "Year"))
SELECT * FROM g WHERE "Year" <= {SPEC.early_until} AND price_growth_pct > {SPEC.early_growth_pct}""")
def early_growth(spark, root):
    return M.early_growth(_region(spark, root), SPEC)


@register("gap_change", BASE + f"""
, g AS (SELECT Region_Name, "Year", Median_House_Price - {SPEC.earnings_multiple} * Median_Earnings AS gap
        FROM region_data)
SELECT *, gap - LAG(gap) OVER (PARTITION BY Region_Name ORDER BY "Year") AS gap_change FROM g""")
def gap_change(spark, root):
    return M.gap_change(_region(spark, root), SPEC)


@register("error_rollup", """
SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n_events, COUNT(*) FILTER (WHERE event_type = 'error') AS n_errors,
       CAST(GROUPING(CAST(ts AS DATE)) AS BIGINT) AS level,
       CAST(COUNT(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0) AS error_rate
FROM events GROUP BY ROLLUP (CAST(ts AS DATE))""")
def error_rollup(spark, root):
    return M.error_rollup(Tables(spark, root).events)
