"""Affordability queries on wide sheets derived from the star tables:
price = median order value by customer nation/region/world and
order year, earnings = median line revenue by supplier nation/region/world
and ship year; ':' where a cell is withheld by a parameter.  Districts are
nations, regions are regions plus the world row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.catalog import register
from tidewater.functions.binning import bin_labels
from tidewater.operators.order_stats import cut_lineage
from tidewater.plans import affordability as A
from tidewater.plans import sheets as SH
from tidewater.sources.tables import Tables

WSPEC = SH.WideSpec()
ASPEC = A.AffordSpec()
YEARS = WSPEC.years


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _wide(cells: str, key: str, header: str) -> str:
    cols = ", ".join(f"MAX(CASE WHEN year = {y} THEN cell END) AS {_q(header.format(y=y))}" for y in YEARS)
    return f"SELECT {key}, {cols} FROM {cells} GROUP BY {key}"


_YEARS_SQL = "SELECT CAST(unnest(range(" + str(YEARS[0]) + ", " + str(YEARS[-1] + 1) + ")) AS INTEGER) AS year"

def _pairs(withheld) -> str:
    return ", ".join(f"('{code}', {year})" for code, year in withheld)


BASE = """WITH
geo AS (
    SELECT n.n_nationkey, n.n_name, r.r_regionkey, r.r_name
    FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
),
po AS (
    SELECT g.n_nationkey, g.r_regionkey, CAST(year(o.o_orderdate) AS INTEGER) AS year, o.o_totalprice AS v
    FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN geo g ON c.c_nationkey = g.n_nationkey
),
le AS (
    SELECT g.n_nationkey, g.r_regionkey, CAST(year(l.l_shipdate) AS INTEGER) AS year,
           l.l_extendedprice * (1 - l.l_discount) AS v
    FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey LEFT JOIN geo g ON s.s_nationkey = g.n_nationkey
),
pstat AS (
    SELECT 'n' AS level, 'NAT' || CAST(n_nationkey AS VARCHAR) AS code, year, COUNT(v) AS n_obs, median(v) AS med
    FROM po WHERE n_nationkey IS NOT NULL GROUP BY n_nationkey, year
    UNION ALL SELECT 'r', 'REG' || CAST(r_regionkey AS VARCHAR), year, COUNT(v), median(v) FROM po WHERE r_regionkey IS NOT NULL GROUP BY r_regionkey, year
    UNION ALL SELECT 'w', 'WLD', year, COUNT(v), median(v) FROM po GROUP BY year
),
estat AS (
    SELECT 'n' AS level, 'NAT' || CAST(n_nationkey AS VARCHAR) AS code, year, COUNT(v) AS n_obs, median(v) AS med
    FROM le WHERE n_nationkey IS NOT NULL GROUP BY n_nationkey, year
    UNION ALL SELECT 'r', 'REG' || CAST(r_regionkey AS VARCHAR), year, COUNT(v), median(v) FROM le WHERE r_regionkey IS NOT NULL GROUP BY r_regionkey, year
    UNION ALL SELECT 'w', 'WLD', year, COUNT(v), median(v) FROM le GROUP BY year
),
pc AS (SELECT level, code, year,
              CASE WHEN (code, year) IN (""" + _pairs(WSPEC.withheld_price) + """) THEN ':' ELSE CAST(ROUND(med, 3) AS VARCHAR) END AS cell
       FROM pstat),
ec AS (SELECT level, code, year,
              CASE WHEN (code, year) IN (""" + _pairs(WSPEC.withheld_earnings) + """) THEN ':' ELSE CAST(ROUND(med, 3) AS VARCHAR) END AS cell
       FROM estat),
years AS (""" + _YEARS_SQL + """),
districts AS (
    SELECT 'REG' || CAST(r_regionkey AS VARCHAR) AS rg_code, r_name AS rg_name,
           'NAT' || CAST(n_nationkey AS VARCHAR) AS la_code, n_name AS la_name
    FROM geo
),
regions AS (
    SELECT 'REG' || CAST(r_regionkey AS VARCHAR) AS code, r_name AS name FROM region
    UNION ALL SELECT 'WLD', 'World'
),
-- wide -> long (identity on the cells): every entity x year, text parsed as a number
hp_region AS (
    SELECT g.code AS "Code", g.name AS "Name", y.year AS "Year", TRY_CAST(c.cell AS DOUBLE) AS Median_House_Price
    FROM regions g CROSS JOIN years y LEFT JOIN pc c ON c.level <> 'n' AND c.code = g.code AND c.year = y.year
),
earn_region AS (
    SELECT g.code AS "Code", g.name AS "Name", y.year AS "Year", TRY_CAST(c.cell AS DOUBLE) AS Median_Earnings
    FROM regions g CROSS JOIN years y LEFT JOIN ec c ON c.level <> 'n' AND c.code = g.code AND c.year = y.year
),
hp_district AS (
    SELECT d.rg_code AS "Region code", d.rg_name AS "Region name", d.la_code AS "Local authority code",
           d.la_name AS "Local authority name", y.year AS "Year", TRY_CAST(c.cell AS DOUBLE) AS Median_House_Price
    FROM districts d CROSS JOIN years y LEFT JOIN pc c ON c.level = 'n' AND c.code = d.la_code AND c.year = y.year
),
earn_district_raw AS (
    SELECT d.rg_code AS "Region code", d.rg_name AS "Region name", d.la_code AS "Code",
           d.la_name AS "Name", y.year AS "Year", TRY_CAST(c.cell AS DOUBLE) AS Median_Earnings
    FROM districts d CROSS JOIN years y LEFT JOIN ec c ON c.level = 'n' AND c.code = d.la_code AND c.year = y.year
),
earn_district AS (
    SELECT "Region code", "Region name", "Code", "Name", "Year",
           COALESCE(Median_Earnings, ROUND(median(Median_Earnings) OVER (PARTITION BY "Region code", "Year"), 4))
               AS Median_Earnings
    FROM earn_district_raw
),
region_data AS (
    SELECT p."Code" AS Region_Code, p."Name" AS Region_Name, p."Year",
           p.Median_House_Price, e.Median_Earnings,
           p.Median_House_Price / NULLIF(e.Median_Earnings, 0) AS Affordability_Ratio
    FROM hp_region p LEFT JOIN earn_region e
      ON p."Code" IS NOT DISTINCT FROM e."Code" AND p."Year" IS NOT DISTINCT FROM e."Year"
     AND p."Name" IS NOT DISTINCT FROM e."Name"
    WHERE NOT COALESCE(p."Name" IN (""" + ", ".join(f"'{r}'" for r in ASPEC.exclude_regions) + """), FALSE)
),
gaps AS (
    SELECT COALESCE(p.code, e.code) AS code, COALESCE(p.year, e.year) AS year
    FROM (SELECT code, year, cell FROM pc WHERE level = 'n') p
    FULL JOIN (SELECT code, year, cell FROM ec WHERE level = 'n') e ON p.code = e.code AND p.year = e.year
    WHERE COALESCE(p.cell, ':') = ':' OR COALESCE(e.cell, ':') = ':'
),
pavg AS (
    SELECT 'NAT' || CAST(c.c_nationkey AS VARCHAR) AS code, CAST(year(o.o_orderdate) AS INTEGER) AS year,
           AVG(o.o_totalprice) AS p
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2
),
eavg AS (
    SELECT 'NAT' || CAST(s.s_nationkey AS VARCHAR) AS code, CAST(year(l.l_shipdate) AS INTEGER) AS year,
           AVG(l.l_extendedprice * (1 - l.l_discount)) AS e
    FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2
),
missing AS (
    SELECT g.year AS "Year", ROUND(pa.p / NULLIF(ea.e, 0), 6) AS Affordability_Ratio,
           d.rg_name AS Region_Name, g.code AS Local_Authority_Code, d.la_name AS Local_Authority_Name
    FROM gaps g LEFT JOIN pavg pa ON g.code = pa.code AND g.year = pa.year
    LEFT JOIN eavg ea ON g.code = ea.code AND g.year = ea.year
    LEFT JOIN districts d ON g.code = d.la_code
),
district_data AS (
    SELECT p."Region code" AS Region_Code, p."Region name" AS Region_Name,
           p."Local authority code" AS Local_Authority_Code, p."Local authority name" AS Local_Authority_Name,
           p."Year", p.Median_House_Price, e.Median_Earnings,
           p.Median_House_Price / NULLIF(e.Median_Earnings, 0) AS Affordability_Ratio
    FROM hp_district p LEFT JOIN earn_district e
      ON p."Local authority code" IS NOT DISTINCT FROM e."Code"
     AND p."Local authority name" IS NOT DISTINCT FROM e."Name"
     AND p."Year" IS NOT DISTINCT FROM e."Year"
    WHERE NOT COALESCE(p."Region name" IN (""" + ", ".join(f"'{r}'" for r in ASPEC.exclude_regions) + """), FALSE)
    UNION ALL BY NAME SELECT * FROM missing
),
dy AS (
    SELECT *,
           ROUND(CASE WHEN COUNT(*) FILTER (WHERE Affordability_Ratio IS NULL) OVER (PARTITION BY Region_Name) = 0
                      THEN median(Affordability_Ratio) OVER (PARTITION BY Region_Name) END, 6) AS Median_Value
    FROM district_data WHERE "Year" = """ + str(ASPEC.last_year) + """
)
"""


def _star(spark, root):
    return SH.star_from(Tables(spark, root))


def _sheets(spark, root, *which):
    return SH.housing_sheets(_star(spark, root), WSPEC, which)


# The region-year and district-year tables are small at any scale (entities
# x years).  Each is checkpointed once: the analyses on top of them branch
# (self-joins, rankings, summaries) and then re-read that table instead of
# re-deriving it from the facts, and their plans stay small.

def _region(spark, root):
    sh = _sheets(spark, root, "region_price", "region_earnings")
    return cut_lineage(A.region_data(A.long_region_price(sh["region_price"]),
                                     A.long_region_earnings(sh["region_earnings"], ASPEC), ASPEC))


def _district(spark, root):
    s = _star(spark, root)
    cells = SH.sheet_cells(s, WSPEC)   # both sheets, one selection, computed once
    pc, ec = SH.price_cells(s, WSPEC, cells), SH.earnings_cells(s, WSPEC, cells)
    sh = SH.housing_sheets(s, WSPEC, ("district_price", "district_earnings"), pc=pc, ec=ec)
    earn = A.median_impute(A.long_district_earnings(sh["district_earnings"], ASPEC), ["Region code", "Year"],
                           A.EARN, digits=4)
    return cut_lineage(A.district_data(A.long_district_price(sh["district_price"]), earn,
                                       SH.missing_district_rows(s, WSPEC, pc, ec), ASPEC))


def _dy(spark, root):
    dy = A.district_year(_district(spark, root), ASPEC)
    return cut_lineage(dy.withColumn("Median_Value", F.round("Median_Value", 6)))


@register("sheet_district_price", BASE + ", wide AS (" + _wide("(SELECT code AS la_code, year, cell FROM pc WHERE level = 'n')", "la_code", WSPEC.price_header) + """)
SELECT d.rg_code AS "Region code", d.rg_name AS "Region name", d.la_code AS "Local authority code",
       d.la_name AS "Local authority name", """ + ", ".join(_q(WSPEC.price_header.format(y=y)) for y in YEARS) + """
FROM districts d LEFT JOIN wide w ON d.la_code = w.la_code""")
def sheet_district_price(spark, root):
    return _sheets(spark, root, "district_price")["district_price"]


@register("sheet_region_earnings", BASE + ", wide AS (" + _wide("(SELECT code, year, cell FROM ec WHERE level <> 'n')", "code", WSPEC.earnings_header) + """)
SELECT g.code AS "Code", g.name AS "Name", """ + ", ".join(_q(WSPEC.earnings_header.format(y=y)) for y in YEARS) + """
FROM regions g LEFT JOIN wide w ON g.code = w.code""")
def sheet_region_earnings(spark, root):
    return _sheets(spark, root, "region_earnings")["region_earnings"]


@register("wide_to_long", BASE + " SELECT * FROM hp_district")
def wide_to_long(spark, root):
    return A.long_district_price(_sheets(spark, root, "district_price")["district_price"])


@register("wide_to_long_by_position", BASE + " SELECT * FROM earn_region")
def wide_to_long_by_position(spark, root):
    return A.long_region_earnings(_sheets(spark, root, "region_earnings")["region_earnings"], ASPEC)


@register("median_impute", BASE + " SELECT * FROM earn_district")
def median_impute(spark, root):
    sh = _sheets(spark, root, "district_earnings")
    return A.median_impute(A.long_district_earnings(sh["district_earnings"], ASPEC), ["Region code", "Year"],
                           A.EARN, digits=4)


@register("missing_local_rows", BASE + " SELECT * FROM missing")
def missing_local_rows(spark, root):
    return SH.missing_district_rows(_star(spark, root), WSPEC)


@register("ratio_region", BASE + " SELECT * FROM region_data")
def ratio_region(spark, root):
    return _region(spark, root)


@register("ratio_district", BASE + " SELECT * FROM district_data")
def ratio_district(spark, root):
    return _district(spark, root)


@register("ratio_group_median", BASE + " SELECT * FROM dy")
def ratio_group_median(spark, root):
    return _dy(spark, root)


@register("ratio_region_summary", BASE + """
, s AS (
    SELECT Region_Name, MIN(Affordability_Ratio) AS min_value, MAX(Affordability_Ratio) AS max_value,
           ROUND(median(Affordability_Ratio), 6) AS median_value,
           FIRST(Local_Authority_Name ORDER BY Affordability_Ratio ASC, Local_Authority_Name ASC)
               FILTER (WHERE Affordability_Ratio IS NOT NULL) AS min_district,
           FIRST(Local_Authority_Name ORDER BY Affordability_Ratio DESC, Local_Authority_Name ASC)
               FILTER (WHERE Affordability_Ratio IS NOT NULL) AS max_district
    FROM dy GROUP BY Region_Name
)
SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY median_value ASC NULLS LAST, Region_Name ASC NULLS LAST) AS INTEGER) AS "order"
FROM s""")
def ratio_region_summary(spark, root):
    return A.region_summary(_dy(spark, root)).withColumn("median_value", F.round("median_value", 6))


@register("ratio_lowest10", BASE + """
SELECT Local_Authority_Name, Region_Name, Affordability_Ratio FROM dy
ORDER BY Affordability_Ratio ASC NULLS LAST, Local_Authority_Name ASC NULLS LAST, Local_Authority_Code ASC NULLS LAST
LIMIT 10""")
def ratio_lowest10(spark, root):
    return A.ranked_districts(_dy(spark, root), 10)


@register("ratio_highest10", BASE + """
SELECT Local_Authority_Name, Region_Name, Affordability_Ratio FROM dy
ORDER BY Affordability_Ratio DESC NULLS LAST, Local_Authority_Name ASC NULLS LAST, Local_Authority_Code ASC NULLS LAST
LIMIT 10""")
def ratio_highest10(spark, root):
    return A.ranked_districts(_dy(spark, root), 10, least_affordable=True)


_MAP_SQL = BASE + """
, mapped AS (
    SELECT b.LAD_CODE, b.LAD_NAME, dy.Region_Name AS region, dy.Affordability_Ratio AS affordability_ratio
    FROM (SELECT 'NAT' || CAST(n_nationkey AS VARCHAR) AS LAD_CODE, n_name AS LAD_NAME FROM nation) b
    LEFT JOIN dy ON b.LAD_CODE = dy.Local_Authority_Code
    WHERE dy.Affordability_Ratio IS NOT NULL AND dy."Year" = """ + str(ASPEC.last_year) + """
)"""


@register("map_matched", _MAP_SQL + " SELECT * FROM mapped")
def map_matched(spark, root):
    return A.map_matched(A.boundary(Tables(spark, root).nation), _dy(spark, root), ASPEC)


def _bins_sql() -> str:
    b = ASPEC.bins
    labels = bin_labels(b)
    idx, lab = [], []
    for i in range(len(b) - 1):
        hi_op = "<=" if i == len(b) - 2 else "<"
        cond = f"affordability_ratio >= {b[i]} AND affordability_ratio {hi_op} {b[i + 1]}"
        idx.append(f"WHEN {cond} THEN {i}")
        lab.append(f"WHEN {cond} THEN '{labels[i]}'")
    return f"CASE {' '.join(idx)} END AS bin, CASE {' '.join(lab)} END AS bin_label"


@register("ratio_bins", _MAP_SQL + " SELECT *, " + _bins_sql() + " FROM mapped")
def ratio_bins(spark, root):
    return A.ratio_bins(map_matched(spark, root), ASPEC)


def _scratch(spark, name: str) -> str:
    from tidewater.session import scratch_path
    return scratch_path(spark, f"sheets-{name}")


@register("sheet_roundtrip_long", BASE + " SELECT * FROM hp_district")
def sheet_roundtrip_long(spark, root):
    """District price sheet written as a published CSV (title line, header,
    ':' cells), read back with the preamble reader, then made long."""
    from tidewater.sources.sheets import read_sheet_with_preamble
    from tidewater.sources.sinks import write_sheet_with_preamble
    sheet = _sheets(spark, root, "district_price")["district_price"]
    path = write_sheet_with_preamble(sheet, _scratch(spark, "district_price"),
                                     ["Median price paid by local authority"])
    back = read_sheet_with_preamble(spark, path, skip=1, na=":")
    return A.long_district_price(back)


@register("map_boundary_table", _MAP_SQL + """
SELECT LAD_CODE, 'POINT (' || CAST(n_nationkey AS VARCHAR) || ' ' || CAST(n_regionkey AS VARCHAR) || ')' AS geom, region, affordability_ratio
FROM mapped JOIN nation ON LAD_CODE = 'NAT' || CAST(n_nationkey AS VARCHAR)""")
def map_boundary_table(spark, root):
    """The map join on a boundary table that is read back from its file."""
    from tidewater.sources.sheets import read_boundary
    t, path = Tables(spark, root), _scratch(spark, "boundary")
    A.boundary(t.nation).write.parquet(path)
    return A.map_shapes(read_boundary(spark, path, "LAD_CODE"), _dy(spark, root), ASPEC)


# part names with line ends, quotes, commas and blanks, and some missing cells
_NOTES = """
SELECT p_partkey AS part_key, CASE WHEN p_partkey % 11 = 0 THEN NULL
       ELSE p_name || chr(10) || ' "' || p_type || '", ' || chr(10) || chr(10) || p_brand || ' ' END AS note, CAST(p_size AS VARCHAR) AS size FROM part"""


@register("sheet_multiline_cells", _NOTES)
def sheet_multiline_cells(spark, root):
    """A published sheet whose cells hold line ends, written and read back."""
    from tidewater.sources.sheets import read_sheet_with_preamble
    from tidewater.sources.sinks import write_sheet_with_preamble
    note = F.concat(F.col("p_name"), F.lit("\n \""), F.col("p_type"), F.lit("\", \n\n"), F.col("p_brand"), F.lit(" "))
    sheet = Tables(spark, root).part.select(F.col("p_partkey").alias("part_key"), F.when(F.col("p_partkey") % 11 != 0, note).alias("note"), F.col("p_size").alias("size"))
    path = write_sheet_with_preamble(sheet, _scratch(spark, "notes"), ['Parts: a "title" with one quote more: "', "second line"])
    back = read_sheet_with_preamble(spark, path, skip=2, na=":")
    return back.select(F.col("part_key").cast("bigint").alias("part_key"), "note", "size")


@register("published_ratios", BASE + """
SELECT r.Region_Name, r."Year", r.Affordability_Ratio, COUNT(d.Local_Authority_Code) AS districts, MAX(d.Affordability_Ratio) AS highest
FROM region_data r LEFT JOIN district_data d ON r.Region_Name = d.Region_Name AND r."Year" = d."Year"
GROUP BY r.Region_Name, r."Year", r.Affordability_Ratio""")
def published_ratios(spark, root):
    """Both ratio tables published as one set and read from it."""
    from tidewater.sources.sinks import publish_datasets, read_published
    out = _scratch(spark, "published")
    publish_datasets({"region": _region(spark, root), "district": _district(spark, root)}, out)
    r = read_published(spark, out, "region")
    d = read_published(spark, out, "district").select("Region_Name", "Year", "Local_Authority_Code", F.col("Affordability_Ratio").alias("ratio"))
    return r.join(d, ["Region_Name", "Year"], "left").groupBy("Region_Name", "Year", "Affordability_Ratio").agg(
        F.count("Local_Authority_Code").alias("districts"), F.max("ratio").alias("highest"))
