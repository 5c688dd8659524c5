"""Regression models: linear ones with an oracle, and the Spark ML comparison
(no SQL form: the driver checks rows only)."""

from __future__ import annotations

from tidewater.catalog import register
from tidewater.plans import models as ML
from tidewater.sources.tables import Tables


@register("regression_models")
def regression_models(spark, root):
    t = Tables(spark, root)
    return ML.compare_models(ML.order_features(t.lineitem, t.orders))


@register("order_features", """
WITH per AS (
    SELECT l_orderkey, CAST(COUNT(*) AS DOUBLE) AS n_lines, SUM(l_quantity) AS quantity,
           AVG(l_discount) AS avg_discount, AVG(l_tax) AS avg_tax, SUM(l_extendedprice) AS gross
    FROM lineitem GROUP BY l_orderkey
)
SELECT per.l_orderkey, ROUND(per.n_lines, 6) AS n_lines, ROUND(per.quantity, 6) AS quantity,
       ROUND(per.avg_discount, 6) AS avg_discount, ROUND(per.avg_tax, 6) AS avg_tax,
       ROUND(per.gross, 2) AS gross, o.o_totalprice AS label
FROM per JOIN orders o ON per.l_orderkey = o.o_orderkey""")
def order_features(spark, root):
    from pyspark.sql import functions as F
    t = Tables(spark, root)
    f = ML.order_features(t.lineitem, t.orders)
    return f.select("l_orderkey", *[F.round(c, 6).alias(c) for c in ("n_lines", "quantity", "avg_discount", "avg_tax")],
                    F.round("gross", 2).alias("gross"), "label")


@register("clustered_order_features", """
SELECT l_orderkey, CAST(COUNT(*) AS DOUBLE) AS n_lines, ROUND(SUM(l_quantity), 6) AS quantity, ROUND(SUM(l_extendedprice), 2) AS gross, MAX(o_totalprice) AS label
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""")
def clustered_order_features(spark, root):
    """Order features from facts laid out by order key: no exchange at all."""
    from pyspark.sql import functions as F
    from tidewater.sources.layout import clustered
    t = Tables(spark, root)
    f = ML.order_features(clustered(spark, t.path("lineitem"), "l_orderkey", columns=["l_quantity", "l_discount", "l_tax", "l_extendedprice"]),
                          clustered(spark, t.path("orders"), "o_orderkey", columns=["o_totalprice"]))
    return f.select("l_orderkey", "n_lines", F.round("quantity", 6).alias("quantity"), F.round("gross", 2).alias("gross"), "label")


LSPEC = ML.LinearSpec()
_X = ("n_lines", "quantity", "avg_discount", "avg_tax", "label")
_Y = "gross"        # the order's gross line value, from the other columns
_P = len(_X)


def _pairs(fn) -> str:
    return "[" + ", ".join("[" + ", ".join(fn(a, b) for b in _X) + "]" for a in _X) + "]"


# Both models by cyclic coordinate descent as a fold over step numbers, scores
# row by row: nothing is shared with the library's algebra on sums.
LINEAR_SQL = f"""
WITH f AS (
    SELECT l_orderkey % {LSPEC.folds} = 0 AS held, CAST(COUNT(*) AS DOUBLE) AS n_lines, SUM(l_quantity) AS quantity,
           AVG(l_discount) AS avg_discount, AVG(l_tax) AS avg_tax, SUM(l_extendedprice) AS gross, MAX(o_totalprice) AS label
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey
),
s AS (
    SELECT [{", ".join(f"AVG({x})" for x in _X)}] AS mx, [{", ".join(f"STDDEV_POP({x})" for x in _X)}] AS dx,
           AVG({_Y}) AS my, STDDEV_POP({_Y}) AS dy, {_pairs(lambda a, b: f"CORR({a}, {b})")} AS c,
           [{", ".join(f"CORR({x}, {_Y})" for x in _X)}] AS cy
    FROM f WHERE NOT held
),
m AS (
    SELECT 'ridge' AS model, CAST(unnest({list(LSPEC.ridge)}) AS DOUBLE) AS penalty
    UNION ALL SELECT 'lasso', CAST(unnest({list(LSPEC.lasso)}) AS DOUBLE)
),
b AS (
    SELECT model, penalty, mx, my,
           list_transform(list_reduce(list_transform(range({_P} * 3000), lambda k: [CAST(k % {_P} + 1 AS DOUBLE)]),
               lambda acc, k: list_transform(acc, lambda v, i: CASE WHEN i <> k[1] THEN v
                   WHEN model = 'ridge' THEN (cy[i] - list_dot_product(c[i], acc) + v) / (1 + penalty)
                   ELSE sign(cy[i] - list_dot_product(c[i], acc) + v)
                        * greatest(abs(cy[i] - list_dot_product(c[i], acc) + v) - penalty, 0) END),
               list_value({", ".join("CAST(0 AS DOUBLE)" for _ in _X)})), lambda v, i: v * dy / dx[i]) AS w
    FROM m, s
),
full_b AS (SELECT model, penalty, my - list_dot_product(w, mx) AS w0, w FROM b),
scored AS (
    SELECT model, penalty, SQRT(AVG(POWER(y - w0 - list_dot_product(w, x), 2))) AS rmse,
           1 - SUM(POWER(y - w0 - list_dot_product(w, x), 2)) / (VAR_POP(y) * COUNT(*)) AS r2
    FROM (SELECT {_Y} AS y, [{", ".join(_X)}] AS x FROM f WHERE held), full_b GROUP BY model, penalty
)
SELECT model, penalty, unnest(['intercept', {", ".join(f"'{x}'" for x in _X)}]) AS term,
       unnest(list_transform(list_concat([w0], w), lambda v: ROUND(v, 3) + 0.0)) AS coefficient, ROUND(rmse, 3) AS rmse, ROUND(r2, 6) AS r2
FROM full_b JOIN scored USING (model, penalty)"""


@register("linear_models", LINEAR_SQL)
def linear_models(spark, root):
    from pyspark.sql import functions as F
    t = Tables(spark, root)
    out = ML.linear_models(ML.order_features(t.lineitem, t.orders), _X, _Y, spec=LSPEC)
    return out.select("model", "penalty", "term", (F.round("coefficient", 3) + F.lit(0.0)).alias("coefficient"), F.round("rmse", 3).alias("rmse"), F.round("r2", 6).alias("r2"))
