"""Datasets behind the charts (drawing itself is out of scope): period
bands, threshold lines, highlighted points, small multiples, axis limits,
two-series overlays and bar totals.  Inputs are entity-by-year tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.functions.binning import bands_frame
from tidewater.functions.na import clip, r_round
from tidewater.operators.joins import band_join

RATIO, PRICE, EARN = "Affordability_Ratio", "Median_House_Price", "Median_Earnings"


@dataclass(frozen=True)
class FigureSpec:
    series_entity: str = "World"
    # named periods (closed both ends, a shared edge year falls in both)
    bands: tuple[tuple[str, float, float], ...] = (("early", 1995, 1997), ("middle", 1997, 1999),
                                                   ("late", 1999, 2001))
    threshold: float = 5.0
    highlight_years: tuple[int, ...] = (1997, 1999, 2000)
    ratio_limits: tuple[float, float] = (0.0, 5.5)
    earnings_multiple: float = 5.0
    bar_threshold: float = 0.1
    price_label: str = "House Price (£000s)"
    earnings_label: str = "5-Year Earnings (£000s)"


def series(region: DataFrame, spec: FigureSpec = FigureSpec()) -> DataFrame:
    return region.where(F.col("Region_Name") == spec.series_entity)


def period_bands(spark: SparkSession, region: DataFrame, spec: FigureSpec = FigureSpec()) -> DataFrame:
    s = series(region, spec).select("Year", RATIO)
    return band_join(s, "Year", bands_frame(spark, spec.bands)).select("Year", RATIO, "band")


def threshold_flags(region: DataFrame, spec: FigureSpec = FigureSpec()) -> DataFrame:
    s = series(region, spec)
    return s.select("Year", RATIO, (F.col(RATIO) > spec.threshold).alias("above"),
                    (F.col(RATIO) - F.lit(spec.threshold)).alias("gap"))


def _k(price: str = PRICE):
    return F.col(price) / F.lit(1000.0)


def _k5(spec: FigureSpec):
    return F.lit(spec.earnings_multiple) * F.col(EARN) / F.lit(1000.0)


def highlights(region: DataFrame, spec: FigureSpec = FigureSpec()) -> DataFrame:
    s = series(region, spec).where(F.col("Year").isin(list(spec.highlight_years)))
    return s.select("Year", r_round(_k(), 1).alias("price_k_label"), r_round(_k5(spec), 1).alias("earnings5_k_label"))


def region_facets(region: DataFrame, spec: FigureSpec = FigureSpec()) -> DataFrame:
    """Small multiples: every region except the series entity, both
    series per year (NULL region names drop, as ``!x == y`` does)."""
    d = region.where(F.col("Region_Name") != spec.series_entity)
    return d.select("Region_Name", "Year", _k().alias("price_k"), _k5(spec).alias("earnings5_k"))


def axis_clip(region: DataFrame, spec: FigureSpec = FigureSpec()) -> DataFrame:
    lo, hi = spec.ratio_limits
    return region.select("Region_Name", "Year", clip(RATIO, lo, hi).alias("ratio_in_axis"))


def dual_series(region: DataFrame, spec: FigureSpec = FigureSpec()) -> DataFrame:
    s = series(region, spec).select("Year", _k().alias(spec.price_label), _k5(spec).alias(spec.earnings_label))
    return s.unpivot(["Year"], [spec.price_label, spec.earnings_label], "series", "value")


def bar_totals(supply: DataFrame, x: str = "Year", y: str = "Net_Additional",
               spec: FigureSpec = FigureSpec()) -> DataFrame:
    """Bars with stat='identity': same-x values stack, i.e. sum per x."""
    b = supply.groupBy(x).agg((F.sum(y) / F.lit(1000.0)).alias("value_k"))
    return b.withColumn("at_or_above", F.col("value_k") >= spec.bar_threshold)
