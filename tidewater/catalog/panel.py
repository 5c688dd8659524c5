"""Entity-year panel queries (nation / region / world x order year)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.catalog import register
from tidewater.operators.order_stats import cut_lineage
from tidewater.plans import panel as P
from tidewater.plans import sheets as SH
from tidewater.sources.tables import Tables

SPEC = P.PanelSpec()
_ALLOW = ", ".join(f"'{e}'" for e in SPEC.allow)

_GEO = """
geo AS (
    SELECT n.n_nationkey, n.n_name, r.r_regionkey, r.r_name
    FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
),
pop AS (
    SELECT g.n_name AS entity, COUNT(*) AS population FROM customer c LEFT JOIN geo g ON c.c_nationkey = g.n_nationkey GROUP BY g.n_name
    UNION ALL SELECT g.r_name, COUNT(*) FROM customer c JOIN geo g ON c.c_nationkey = g.n_nationkey GROUP BY g.r_name
    UNION ALL SELECT 'World', COUNT(*) FROM customer c
)"""

_SHEETS = "WITH" + _GEO + """,
ocy AS (
    SELECT g.n_nationkey, g.n_name, g.r_name, CAST(year(o.o_orderdate) AS INTEGER) AS year, o.o_totalprice AS v
    FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN geo g ON c.c_nationkey = g.n_nationkey
),
sheet_a AS (
    SELECT n_name AS entity, 'NAT' || CAST(n_nationkey AS VARCHAR) AS code, year, ROUND(SUM(v), 2) AS amount
    FROM ocy GROUP BY n_name, n_nationkey, year
    UNION ALL SELECT r_name, NULL, year, ROUND(SUM(v), 2) FROM ocy WHERE r_name IS NOT NULL GROUP BY r_name, year
    UNION ALL SELECT 'World', NULL, year, ROUND(SUM(v), 2) FROM ocy GROUP BY year
),
sheet_b AS (
    SELECT a.entity, a.code, a.year, a.amount / p.population AS amount_capita
    FROM sheet_a a LEFT JOIN pop p ON a.entity = p.entity
),
lo AS (
    SELECT l_orderkey, SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS cons, SUM(l_extendedprice) AS gross
    FROM lineitem GROUP BY l_orderkey
),
lcy AS (
    SELECT g.n_name, g.r_name, CAST(year(o.o_orderdate) AS INTEGER) AS year, lo.cons, lo.gross
    FROM lo LEFT JOIN orders o ON lo.l_orderkey = o.o_orderkey
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN geo g ON c.c_nationkey = g.n_nationkey
),
lv AS (
    SELECT n_name AS entity, year, SUM(cons) AS cons, SUM(gross) AS gross FROM lcy GROUP BY n_name, year
    UNION ALL SELECT r_name, year, SUM(cons), SUM(gross) FROM lcy WHERE r_name IS NOT NULL GROUP BY r_name, year
    UNION ALL SELECT 'World', year, SUM(cons), SUM(gross) FROM lcy GROUP BY year
),
sheet_c AS (
    SELECT lv.entity, lv.year, ROUND(lv.cons, 2) / p.population AS consumption_capita,
           ROUND(lv.gross, 2) / p.population AS gross_capita, p.population
    FROM lv LEFT JOIN pop p ON lv.entity = p.entity
),
panel AS (
    SELECT a.entity, a.code, a.year, a.amount, b.amount_capita, c.consumption_capita, c.gross_capita, c.population
    FROM sheet_a a
    LEFT JOIN sheet_b b ON a.entity IS NOT DISTINCT FROM b.entity AND a.year IS NOT DISTINCT FROM b.year
    LEFT JOIN sheet_c c ON a.entity IS NOT DISTINCT FROM c.entity AND a.year IS NOT DISTINCT FROM c.year
),
main AS (
    SELECT *, amount / 1000000.0 AS amount_scaled FROM panel WHERE year >= 1995 AND year <= 2000
),
pct AS (
    SELECT *, (amount - LAG(amount) OVER w) / NULLIF(LAG(amount) OVER w, 0) * 100 AS pct_change
    FROM main WINDOW w AS (PARTITION BY entity ORDER BY year)
),
rt AS (
    SELECT entity, code, year, amount_scaled, amount_capita, pct_change,
           ROUND(SUM(amount_scaled) OVER (PARTITION BY entity ORDER BY year
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cumulative
    FROM pct WHERE entity IN (""" + _ALLOW + """)
),
ord AS (
    SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY cumulative DESC NULLS LAST, entity) AS INTEGER) AS ordinal
    FROM rt WHERE year = 2000
)"""


def star(spark, root):
    return SH.star_from(Tables(spark, root))


def merged_panel(spark, root):
    """The three sheets merged: entities x years, small at any scale.  It is
    checkpointed once, so the branches built on it (rankings, stacks,
    shares) re-read that table instead of re-deriving it from the facts."""
    s = star(spark, root)
    totals = SH.order_totals(s)
    return cut_lineage(P.merge_sheets(totals, SH.per_customer_totals(s, totals), SH.line_values(s)))


def main_panel(spark, root):
    # written once more: what follows reads it several times
    return cut_lineage(P.with_change(P.year_range(merged_panel(spark, root), SPEC)))


def running_totals(spark, root):
    return cut_lineage(P.running_totals(main_panel(spark, root), SPEC))


@register("panel_sheet_totals", _SHEETS + " SELECT * FROM sheet_a")
def panel_sheet_totals(spark, root):
    return SH.order_totals(star(spark, root))


@register("panel_sheet_lines", _SHEETS + " SELECT * FROM sheet_c")
def panel_sheet_lines(spark, root):
    return SH.line_values(star(spark, root))


@register("clustered_panel_lines", _SHEETS + " SELECT * FROM sheet_c")
def clustered_panel_lines(spark, root):
    """The line sheet from facts laid out by order key: lines meet their orders
    without a shuffle; only sums per customer and year move."""
    from dataclasses import replace
    from tidewater.sources.layout import clustered
    t = Tables(spark, root)
    return SH.line_values(replace(
        star(spark, root), lineitem=clustered(spark, t.path("lineitem"), "l_orderkey", columns=["l_extendedprice", "l_discount", "l_tax"]),
        orders=clustered(spark, t.path("orders"), "o_orderkey", columns=["o_custkey", "o_orderdate"])))


@register("panel_merge", _SHEETS + " SELECT * FROM panel")
def panel_merge(spark, root):
    s = star(spark, root)
    totals = SH.order_totals(s)
    return P.merge_sheets(totals, SH.per_customer_totals(s, totals), SH.line_values(s))


@register("panel_range", _SHEETS + " SELECT * FROM main")
def panel_range(spark, root):
    return panel_merge(spark, root).transform(lambda d: P.year_range(d, SPEC))


@register("panel_pct_change", _SHEETS + " SELECT * FROM pct")
def panel_pct_change(spark, root):
    return main_panel(spark, root)


@register("panel_entity_series", _SHEETS + " SELECT year, amount_scaled, pct_change FROM pct WHERE entity = 'World'")
def panel_entity_series(spark, root):
    return P.entity_series(main_panel(spark, root), SPEC.world)


@register("panel_running_total", _SHEETS + " SELECT * FROM rt")
def panel_running_total(spark, root):
    return P.running_totals(main_panel(spark, root), SPEC)


@register("panel_entity_order", _SHEETS + " SELECT * FROM ord")
def panel_entity_order(spark, root):
    return P.entity_order(running_totals(spark, root), SPEC)


@register("panel_stack", _SHEETS + """
, st AS (
    SELECT rt.entity, rt.year, o.ordinal, rt.cumulative,
           SUM(rt.cumulative) OVER (PARTITION BY rt.year ORDER BY COALESCE(o.ordinal, 1000000), rt.entity
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stack_upper
    FROM rt LEFT JOIN ord o ON rt.entity = o.entity
)
SELECT entity, year, ordinal, cumulative, ROUND(stack_upper - cumulative, 6) AS stack_lower,
       ROUND(stack_upper, 6) AS stack_upper FROM st""")
def panel_stack(spark, root):
    return P.stacked(running_totals(spark, root), SPEC)


def _num_text(x: str) -> str:
    return f"COALESCE(regexp_replace(CAST({x} AS VARCHAR), '\\.0$', ''), 'NA')"


@register("panel_top5_rest", _SHEETS + """
, y AS (SELECT * FROM pct WHERE year = 2000),
top AS (
    SELECT entity, amount_scaled FROM y WHERE entity IN (""" + _ALLOW + """)
    ORDER BY amount_scaled DESC NULLS LAST, entity LIMIT 5
),
tot AS (SELECT MAX(amount_scaled) AS total FROM y WHERE entity = 'World'),
r AS (
    SELECT entity, amount_scaled FROM top
    UNION ALL
    SELECT 'Rest of the World',
           (SELECT total FROM tot) - (SELECT CASE WHEN COUNT(*) FILTER (WHERE amount_scaled IS NULL) = 0
                                                  THEN SUM(amount_scaled) END FROM top)
),
p AS (SELECT r.entity, r.amount_scaled, r.amount_scaled / NULLIF(tot.total, 0) * 100 AS pct FROM r, tot),
q AS (
    SELECT entity, ROUND(amount_scaled, 6) AS amount_scaled, ROUND(pct, 6) AS percentage_of_total,
           """ + _num_text("round_even(amount_scaled, 2)") + " || ' (' || " + _num_text("round_even(pct, 1)") + """ || '%)' AS label
    FROM p
)
SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY amount_scaled DESC NULLS LAST, entity) AS INTEGER) AS position FROM q""")
def panel_top5_rest(spark, root):
    return P.top_with_rest(main_panel(spark, root), SPEC)


@register("panel_leaders", _SHEETS + """
, coded AS (SELECT * FROM pct WHERE code IS NOT NULL),
long AS (
    SELECT 'latest' AS ranking, entity, amount_scaled AS v FROM coded WHERE year = 2000
    UNION ALL SELECT 'cumulative', entity, SUM(amount_scaled) FROM coded GROUP BY entity
    UNION ALL SELECT 'per_capita', entity, amount_capita FROM coded WHERE year = 2000
),
rk AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY ranking ORDER BY v DESC NULLS LAST, entity) AS INTEGER) AS rank
       FROM long)
SELECT ranking, rank, entity, ROUND(v, 6) AS value FROM rk WHERE rank <= 5""")
def panel_leaders(spark, root):
    return P.leaders(main_panel(spark, root), SPEC)


# from the orders straight to the last year's totals of the nations
@register("map_keep_all", f"""
WITH last AS (
    SELECT c_nationkey AS nation, SUM(o_totalprice) AS amount FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderdate >= TIMESTAMP '{SPEC.last_year}-01-01' AND o_orderdate < TIMESTAMP '{SPEC.last_year + 1}-01-01' GROUP BY c_nationkey),
heads AS (SELECT c_nationkey AS nation, COUNT(*) AS population FROM customer GROUP BY c_nationkey)
SELECT 'NAT' || CAST(n_nationkey AS VARCHAR) AS iso_code, n_name AS name,
       'POINT (' || CAST(n_nationkey AS VARCHAR) || ' ' || CAST(n_regionkey AS VARCHAR) || ')' AS geom_wkt,
       CASE WHEN amount IS NOT NULL THEN n_name END AS entity, ROUND(ROUND(amount, 2) / population, 6) AS amount_capita,
       CASE WHEN amount > 0 THEN ROUND(ln(ROUND(amount, 2) / population), 6) END AS log_amount_capita
FROM nation LEFT JOIN last ON last.nation = n_nationkey LEFT JOIN heads ON heads.nation = n_nationkey""")
def map_keep_all(spark, root):
    t = Tables(spark, root)
    out = P.map_keep_all(P.boundary_from(t.nation), main_panel(spark, root), SPEC)
    return out.withColumns({c: F.round(c, 6) for c in ("amount_capita", "log_amount_capita")})


@register("elasticity", _SHEETS + """
, pos AS (SELECT entity, ln(gross_capita) AS lx, ln(amount_capita) AS ly FROM pct
          WHERE gross_capita > 0 AND amount_capita > 0)
SELECT entity, ROUND(regr_slope(ly, lx), 6) AS slope, COUNT(*) AS n FROM pos GROUP BY entity
UNION ALL
SELECT 'ALL', ROUND(regr_slope(ly, lx), 6), COUNT(*) FROM pos""")
def elasticity(spark, root):
    return P.elasticity(main_panel(spark, root))
