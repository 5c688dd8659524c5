"""Affordability analysis: wide price and earnings sheets → long tables,
group-median imputation, price-to-earnings ratios for regions and
districts, last-year summaries, rankings, map join and bins.

All tables here are entity-by-year (regions or districts x years); the
fact-scale work (medians over orders and lines) happens when the sheets
are derived (``plans.sheets``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidewater.functions.binning import bin_labels, fixed_bins
from tidewater.functions.na import asc_last, desc_last, not_in_keep_null, try_div
from tidewater.operators.joins import attach_group_agg, join_null_safe
from tidewater.operators.order_stats import exact_median
from tidewater.operators.ranges import row_numbers
from tidewater.operators.reshape import bind_rows, clean_long, cols_by_position, cols_with_prefix
from tidewater.operators.topk import arg_extreme

PRICE = "Median_House_Price"
EARN = "Median_Earnings"
RATIO = "Affordability_Ratio"


@dataclass(frozen=True)
class AffordSpec:
    exclude_regions: tuple[str, ...] = ("MIDDLE EAST",)   # rows left out of the analysis
    last_year: int = 2000
    n_years: int | None = None                            # year columns per sheet (None: all after the names)
    bins: tuple[float, ...] = (0, 4.5, 5, 5.5, 6, 44)     # map colour breaks


def long_region_price(sheet: DataFrame) -> DataFrame:
    return clean_long(sheet, cols_with_prefix(sheet, "Year"), PRICE)


def long_region_earnings(sheet: DataFrame, spec: AffordSpec = AffordSpec()) -> DataFrame:
    return clean_long(sheet, cols_by_position(sheet, 3, len(sheet.columns) if spec.n_years is None else 2 + spec.n_years), EARN)


def long_district_price(sheet: DataFrame) -> DataFrame:
    return clean_long(sheet, cols_with_prefix(sheet, "Year"), PRICE)


def long_district_earnings(sheet: DataFrame, spec: AffordSpec = AffordSpec()) -> DataFrame:
    return clean_long(sheet, cols_by_position(sheet, 5, len(sheet.columns) if spec.n_years is None else 4 + spec.n_years), EARN)


def median_impute(df: DataFrame, groups: Sequence[str], value: str, digits: int | None = None) -> DataFrame:
    """Replace a missing value by the median of its group (NULLs ignored);
    an all-missing group stays missing.  Group medians are an aggregate
    joined back (the table has one row per district-year).  ``digits``
    rounds the filled-in median (printed precision of the sheet)."""
    med = exact_median(df, groups, value, "__med")
    med = med.select(*[F.col(f"`{g}`") for g in groups], F.col("__med") if digits is None else F.round("__med", digits).alias("__med"))
    out = join_null_safe(df, med, groups, "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.col("__med"))).drop("__med")


def region_data(price: DataFrame, earnings: DataFrame, spec: AffordSpec = AffordSpec()) -> DataFrame:
    """Region price ⟕ earnings on (Code, Year, Name), ratio, renamed keys;
    excluded regions dropped but rows without a name kept."""
    j = join_null_safe(price, earnings, ["Code", "Year", "Name"], "left")
    j = j.withColumns({RATIO: try_div(F.col(PRICE), F.col(EARN)),
                       "Region_Code": F.col("Code"), "Region_Name": F.col("Name")})
    return j.where(not_in_keep_null("Region_Name", spec.exclude_regions)) \
            .select("Region_Code", "Region_Name", "Year", PRICE, EARN, RATIO)


def district_data(price: DataFrame, earnings: DataFrame, missing: DataFrame,
                  spec: AffordSpec = AffordSpec()) -> DataFrame:
    """District price ⟕ imputed earnings with differently named keys
    (authority code/name ↔ Code/Name, Year); the earnings side's region
    columns are dropped; the ratio; excluded regions removed (NULL kept);
    then the hand-collected rows appended by name."""
    e = earnings.select(F.col("Code").alias("Local authority code"), F.col("Name").alias("Local authority name"),
                        "Year", EARN)
    j = join_null_safe(price, e, ["Local authority code", "Local authority name", "Year"], "left")
    j = j.withColumns({
        RATIO: try_div(F.col(PRICE), F.col(EARN)),
        "Region_Code": F.col("Region code"), "Region_Name": F.col("Region name"),
        "Local_Authority_Code": F.col("Local authority code"),
        "Local_Authority_Name": F.col("Local authority name"),
    })
    j = j.where(not_in_keep_null("Region_Name", spec.exclude_regions)) \
         .select("Region_Code", "Region_Name", "Local_Authority_Code", "Local_Authority_Name", "Year",
                 PRICE, EARN, RATIO)
    return bind_rows(j, missing)


def district_year(district: DataFrame, spec: AffordSpec = AffordSpec()) -> DataFrame:
    """Last-year rows with the region's median ratio as a column, NULL when
    any ratio of the region is missing (``median`` without ``na.rm``)."""
    y = district.where(F.col("Year") == spec.last_year)
    med = exact_median(y, ["Region_Name"], RATIO, "Median_Value").drop("n")
    out = join_null_safe(attach_group_agg(y, ["Region_Name"], {"__gaps": F.count_if(F.col(RATIO).isNull())}), med, ["Region_Name"], "left")
    return out.withColumn("Median_Value", F.when(F.col("__gaps") == 0, F.col("Median_Value"))).drop("__gaps")


def region_summary(dy: DataFrame) -> DataFrame:
    """Per region: min, max, median ratio (NULLs ignored), the districts at
    the minimum and maximum (ties → smallest name) and the regions' order
    by median (1 = lowest)."""
    s = dy.groupBy("Region_Name").agg(
        F.min(RATIO).alias("min_value"), F.max(RATIO).alias("max_value"),
        arg_extreme("Local_Authority_Name", RATIO).alias("min_district"),
        arg_extreme("Local_Authority_Name", RATIO, largest=True).alias("max_district"))
    s = join_null_safe(s, exact_median(dy, ["Region_Name"], RATIO, "median_value").drop("n"), ["Region_Name"], "left")
    s = row_numbers(s, [], "median_value", "order", ties=["Region_Name"])       # a missing median comes last
    return s.select("Region_Name", "min_value", "max_value", "median_value", "min_district", "max_district", F.col("order").cast("int").alias("order"))


def ranked_districts(dy: DataFrame, n: int = 10, least_affordable: bool = False) -> DataFrame:
    """``arrange([desc](ratio)) %>% head(n)`` over all regions (the source's
    grouping does not apply to arrange/head); NAs last, ties by name."""
    key = desc_last(RATIO) if least_affordable else asc_last(RATIO)
    return dy.orderBy(key, F.col("Local_Authority_Name").asc_nulls_last(),
                      F.col("Local_Authority_Code").asc_nulls_last()) \
             .limit(n).select("Local_Authority_Name", "Region_Name", RATIO)


def boundary(nation: DataFrame) -> DataFrame:
    from tidewater.plans.sheets import nation_code
    return nation.select(nation_code(F.col("n_nationkey")).alias("LAD_CODE"), F.col("n_name").alias("LAD_NAME"),
                         F.concat_ws(" ", F.lit("POINT"), F.concat(F.lit("("), F.col("n_nationkey").cast("string"), F.lit(" "), F.col("n_regionkey").cast("string"), F.lit(")"))).alias("geom"))


def map_matched(bnd: DataFrame, dy: DataFrame, spec: AffordSpec = AffordSpec()) -> DataFrame:
    """Boundary ⟕ last-year districts by code, then keep rows with a ratio in
    the last year (the outer join becomes an inner join in the plan);
    tooltip fields renamed."""
    j = bnd.join(dy, bnd.LAD_CODE == dy.Local_Authority_Code, "left")
    j = j.where(F.col(RATIO).isNotNull() & (F.col("Year") == spec.last_year))
    return j.select("LAD_CODE", "LAD_NAME", F.col("Region_Name").alias("region"),
                    F.col(RATIO).alias("affordability_ratio"))


def map_shapes(bnd: DataFrame, dy: DataFrame, spec: AffordSpec = AffordSpec()) -> DataFrame:
    """As ``map_matched`` for a boundary table of codes and geometries: the
    geometry is passed through."""
    j = bnd.join(dy, bnd.LAD_CODE == dy.Local_Authority_Code, "left").where(F.col(RATIO).isNotNull() & (F.col("Year") == spec.last_year))
    return j.select("LAD_CODE", "geom", F.col("Region_Name").alias("region"), F.col(RATIO).alias("affordability_ratio"))


def ratio_bins(mapped: DataFrame, spec: AffordSpec = AffordSpec()) -> DataFrame:
    labels = bin_labels(spec.bins)
    return mapped.withColumns({"bin": fixed_bins("affordability_ratio", spec.bins),
                               "bin_label": fixed_bins("affordability_ratio", spec.bins, labels)})
