"""Report metrics stated in prose (shares below a threshold, first breach,
growth, positions, ranges, extremes, peaks) and the roll-up of error
events.  Inputs are entity-by-year tables except ``error_rollup``, which
aggregates the event table map-side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidewater.functions.na import pct_change, try_div
from tidewater.operators.joins import attach_group_agg
from tidewater.operators.order_stats import exact_percent_rank
from tidewater.operators.ranges import local_extrema
from tidewater.operators.series import lag_change, lag_pct_change
from tidewater.operators.topk import arg_extreme

RATIO, PRICE, EARN = "Affordability_Ratio", "Median_House_Price", "Median_Earnings"


@dataclass(frozen=True)
class MetricSpec:
    threshold: float = 5.0
    growth_from: int = 1996
    growth_to: int = 2000
    base_year: int = 1995
    last_year: int = 2000
    early_until: int = 1998
    early_growth_pct: float = 10.0
    earnings_multiple: float = 5.0
    series_entity: str = "World"


def share_below(district: DataFrame, spec: MetricSpec = MetricSpec()) -> DataFrame:
    """Per year: districts with a ratio, how many are below the threshold,
    and their share."""
    r = F.col(RATIO)
    return district.where(r.isNotNull()).groupBy("Year").agg(
        F.count("*").alias("n_areas"), F.count_if(r < spec.threshold).alias("n_below"),
        F.avg((r < spec.threshold).cast("double")).alias("share_below"))


def first_breach(region: DataFrame, spec: MetricSpec = MetricSpec()) -> DataFrame:
    """Per region: the first year after which the ratio never returns to the
    threshold or below (NULL when the last observed year is not above)."""
    r = F.col(RATIO)
    obs = region.where(r.isNotNull())
    last_ok = obs.groupBy("Region_Name").agg(F.max(F.when(r <= spec.threshold, F.col("Year"))).alias("last_ok"))
    j = obs.join(last_ok, "Region_Name")
    return j.groupBy("Region_Name").agg(
        F.min(F.when(F.col("last_ok").isNull() | (F.col("Year") > F.col("last_ok")), F.col("Year")))
         .alias("above_since"))


def _at(year: int, col: str):
    return F.max(F.when(F.col("Year") == year, F.col(col)))


def growth_between(region: DataFrame, spec: MetricSpec = MetricSpec()) -> DataFrame:
    g = region.groupBy("Region_Name").agg(_at(spec.growth_from, PRICE).alias("p0"), _at(spec.growth_to, PRICE).alias("p1"))
    return g.select("Region_Name", pct_change(F.col("p1"), F.col("p0")).alias("price_growth_pct"))


def growth_multiple(region: DataFrame, spec: MetricSpec = MetricSpec()) -> DataFrame:
    g = region.groupBy("Region_Name").agg(
        try_div(_at(spec.last_year, PRICE), _at(spec.base_year, PRICE)).alias("price_multiple"),
        try_div(_at(spec.last_year, EARN), _at(spec.base_year, EARN)).alias("earnings_multiple"))
    return g


def position_pct(dy: DataFrame) -> DataFrame:
    """Percent of the other districts with a lower ratio (a percent rank over
    the districts of one year; one row per district)."""
    d = exact_percent_rank(dy.where(F.col(RATIO).isNotNull()), RATIO, "__share", keys=["Year"])
    return d.select("Local_Authority_Name", "Region_Name", RATIO, (F.col("__share") * F.lit(100.0)).alias("pct_less_affordable_than"))


def region_ranges(dy: DataFrame, spec: MetricSpec = MetricSpec()) -> DataFrame:
    """Per region: range, max/min multiple and whether all districts are at
    or above / below the threshold."""
    r = F.col(RATIO)
    return dy.groupBy("Region_Name").agg(
        (F.max(r) - F.min(r)).alias("ratio_range"), try_div(F.max(r), F.min(r)).alias("max_over_min"),
        F.bool_and(r >= spec.threshold).alias("all_at_or_above"), F.bool_and(r < spec.threshold).alias("all_below"))


def narrowest_range(dy: DataFrame, spec: MetricSpec = MetricSpec()) -> DataFrame:
    """The region with the smallest range (ties: smallest name)."""
    rr = region_ranges(dy, spec)
    return rr.agg(arg_extreme("Region_Name", "ratio_range").alias("Region_Name"),
                  F.min("ratio_range").alias("ratio_range"))


def extreme_regions(region: DataFrame, spec: MetricSpec = MetricSpec()) -> DataFrame:
    y = region.where((F.col("Year") == spec.last_year) & (F.col("Region_Name") != spec.series_entity))
    return y.agg(arg_extreme("Region_Name", RATIO).alias("most_affordable"),
                 arg_extreme("Region_Name", RATIO, largest=True).alias("least_affordable"))


def peaks_dips(region: DataFrame, spec: MetricSpec = MetricSpec()) -> DataFrame:
    """Local extrema of the series entity's ratio and its global peak."""
    s = region.where(F.col("Region_Name") == spec.series_entity).select("Year", RATIO)
    out = attach_group_agg(local_extrema(s, [], ["Year"], RATIO), [], {"__top": F.max(RATIO)})
    return out.withColumn("global_peak", F.col(RATIO) == F.col("__top")).drop("__top")


def early_growth(region: DataFrame, spec: MetricSpec = MetricSpec()) -> DataFrame:
    g = lag_pct_change(region, "Region_Name", "Year", PRICE, "price_growth_pct")
    return g.where((F.col("Year") <= spec.early_until) & (F.col("price_growth_pct") > spec.early_growth_pct)) \
            .select("Region_Name", "Year", "price_growth_pct")


def gap_change(region: DataFrame, spec: MetricSpec = MetricSpec()) -> DataFrame:
    gap = F.col(PRICE) - F.lit(spec.earnings_multiple) * F.col(EARN)
    return lag_change(region.select("Region_Name", "Year", gap.alias("gap")), "Region_Name", "Year", "gap", "gap_change")


def error_rollup(events: DataFrame, ts: str = "ts", kind: str = "event_type", error_value: str = "error") -> DataFrame:
    """Events and error events per day and overall, with the error share
    (cases / deaths / fatality ratio shape).  ``rollup`` expands each row
    into its levels before the partial aggregate, so it stays map-side."""
    e = events.select(F.to_date(ts).alias("day"), (F.col(kind) == error_value).alias("__err"))
    r = e.rollup("day").agg(F.count("*").alias("n_events"), F.count_if("__err").alias("n_errors"),
                            F.grouping_id().alias("level"))
    return r.withColumn("error_rate", try_div(F.col("n_errors").cast("double"), F.col("n_events").cast("double")))
