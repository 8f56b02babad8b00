"""Summaries of feature contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import explanation
from . import inputs
from .inputs import CONTRIBUTIONS
from .registry import query, r6

_IMPORTANCE = "f AS (SELECT fold, feature, avg(abs(contrib * weight)) AS m, var_pop(contrib * weight) AS v FROM contrib GROUP BY ALL), t AS (SELECT feature, avg(m) AS importance, stddev_samp(m) AS importance_sd, avg(v) AS variance, count(*) AS folds FROM f GROUP BY feature)"


@query(f"WITH {CONTRIBUTIONS}, {_IMPORTANCE} SELECT feature, {r6('importance', 'importance')}, {r6('importance_sd', 'importance_sd')}, {r6('variance', 'variance')}, folds, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM t")
def x01_importance(spark, sf_dir) -> DataFrame:
    return explanation.importance(inputs.contributions(spark, sf_dir))


@query(f"WITH {CONTRIBUTIONS} SELECT feature, {r6('avg(abs(contrib))', 'mean_abs')} FROM contrib GROUP BY feature")
def x02_global_attribution(spark, sf_dir) -> DataFrame:
    return explanation.global_attribution(inputs.contributions(spark, sf_dir))


@query(f"WITH {CONTRIBUTIONS}, c AS (SELECT feature % 8 AS feature, fold, round(x, 2) AS x, avg(contrib) AS y FROM contrib GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY feature, fold ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY feature, fold) AS n FROM c), k AS (SELECT feature, fold, n, k, round_even(k * ((n - 1) / 15.0::DOUBLE), 0) AS i FROM (SELECT DISTINCT feature, fold, n FROM n), (SELECT unnest(range(0, 16)) AS k)) SELECT n.feature, n.fold, {r6('n.x', 'x')}, {r6('n.y', 'y')} FROM n WHERE n.n <= 16 OR EXISTS (SELECT 1 FROM k WHERE k.feature = n.feature AND k.fold = n.fold AND k.i = n.i)")
def x03_shape_curve(spark, sf_dir) -> DataFrame:
    rows = inputs.contributions(spark, sf_dir).withColumns({"feature": F.col("feature") % 8, "x": F.round("x", 2)})
    return explanation.shape_curve(rows, ["feature", "fold"], 16)


_BAND = f"""{CONTRIBUTIONS}, c AS (SELECT feature, fold, x, avg(contrib) AS y FROM contrib GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY feature, fold ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY feature, fold) AS n FROM c),
k AS (SELECT feature, fold, round_even(k * ((n - 1) / 49.0::DOUBLE), 0) AS i FROM (SELECT DISTINCT feature, fold, n FROM n), (SELECT unnest(range(0, 50)) AS k)),
cv AS (SELECT n.feature, n.fold, n.x, n.y FROM n WHERE n.n <= 50 OR EXISTS (SELECT 1 FROM k WHERE k.feature = n.feature AND k.fold = n.fold AND k.i = n.i)),
g0 AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY feature) AS n FROM (SELECT DISTINCT feature, x FROM cv)),
gk AS (SELECT DISTINCT feature, round_even(k * ((n - 1) / 49.0::DOUBLE), 0) AS i FROM (SELECT DISTINCT feature, n FROM g0), (SELECT unnest(range(0, 50)) AS k)),
gx AS (SELECT g0.feature, g0.x FROM g0 WHERE n <= 50 OR EXISTS (SELECT 1 FROM gk WHERE gk.feature = g0.feature AND gk.i = g0.i)),
gf AS (SELECT gx.feature, f.fold, gx.x FROM gx JOIN (SELECT DISTINCT feature, fold FROM cv) f USING (feature)),
lo AS (SELECT gf.feature, gf.fold, gf.x, cv.x AS x0, cv.y AS y0 FROM gf ASOF JOIN cv ON gf.feature = cv.feature AND gf.fold = cv.fold AND gf.x >= cv.x),
hi AS (SELECT lo.*, cv.x AS x1, cv.y AS y1 FROM lo ASOF JOIN cv ON lo.feature = cv.feature AND lo.fold = cv.fold AND lo.x <= cv.x),
v AS (SELECT feature, x, CASE WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) / (x1 - x0) * (x - x0) END AS y FROM hi)"""


@query(f"WITH {_BAND} SELECT feature, {r6('x', 'x')}, {r6('avg(y)', 'mean')}, {r6('coalesce(stddev_samp(y), 0)', 'sd')}, count(*) AS folds FROM v GROUP BY feature, x")
def x04_shape_band(spark, sf_dir) -> DataFrame:
    return explanation.shape_band(inputs.contributions(spark, sf_dir), 50)


@query(f"""WITH {CONTRIBUTIONS}, e AS (SELECT feature, list_distinct(quantile_cont(x, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS q FROM contrib GROUP BY feature),
b AS (SELECT c.feature, len(list_filter(q, lambda v: v < x)) AS bin, x, contrib FROM contrib c JOIN e USING (feature)),
t AS (SELECT feature, CAST(bin AS INTEGER) AS bin, median(x) AS xm, avg(contrib) AS ym, count(*) AS n FROM b GROUP BY ALL)
SELECT feature, bin, {r6('xm', 'x_median')}, {r6('ym', 'y_mean')}, n, {r6('(coalesce(lag(ym) OVER w, ym) + ym + coalesce(lead(ym) OVER w, ym)) / 3', 'y_smooth')} FROM t WINDOW w AS (PARTITION BY feature ORDER BY bin)""")
def x05_quantile_bins(spark, sf_dir) -> DataFrame:
    return explanation.quantile_bins(inputs.contributions(spark, sf_dir), ["feature"], "x", "contrib", 10)


@query()
def x06_cut_points(spark, sf_dir) -> DataFrame:
    t = explanation.cut_points(inputs.contributions(spark, sf_dir), ["task", "feature"], "x", "contrib", [0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9], 3)
    return t.select("task", "feature", F.col("bounds")[0].alias("low"), F.col("bounds")[1].alias("high"), "score", F.col("ns")[0].alias("n1"), F.col("ns")[1].alias("n2"), F.col("ns")[2].alias("n3"))


_PDP = "v AS (SELECT vec_id, label % 3 AS task, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)"


@query(f"WITH {_PDP}, m AS (SELECT task, median(a) AS ma, unnest(list_distinct(quantile_cont(a, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS x FROM v GROUP BY task) SELECT CAST(task AS INTEGER) AS task, {r6('x', 'x')}, {r6('2.0 * (x - ma)', 'effect')} FROM m")
def x07_partial_dependence(spark, sf_dir) -> DataFrame:
    e = inputs.table(spark, sf_dir, "embeddings")
    rows = e.select((F.col("label") % 3).cast("int").alias("task"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return explanation.partial_dependence(rows, 0, [2.0, *[(i % 5 - 2) / 2 for i in range(1, 64)]], 0.5, "task", 5)


@query(f"""WITH {CONTRIBUTIONS}, c AS (SELECT feature, round(x, 1) AS x, avg(contrib * CASE WHEN feature % 2 = 0 THEN 1 ELSE -1 END) AS y FROM contrib GROUP BY ALL), s AS (SELECT *, y - lag(y) OVER (PARTITION BY feature ORDER BY x) AS d FROM c)
SELECT feature, {r6('coalesce(avg(CAST(d < 0 AS INTEGER)), 0)', 'raw_rate')}, {r6('coalesce(avg(CAST(-0.5 * d < 0 AS INTEGER)), 0)', 'weighted_rate')}, {r6('arg_max(y, x) - arg_min(y, x)', 'net')} FROM s GROUP BY feature""")
def x08_monotone_steps(spark, sf_dir) -> DataFrame:
    sign = F.when(F.col("feature") % 2 == 0, 1).otherwise(-1)
    curve = inputs.contributions(spark, sf_dir).groupBy("feature", F.round("x", 1).alias("x")).agg(F.avg(F.col("contrib") * sign).alias("y"))
    return explanation.monotone_steps(curve, ["feature"], 1, -0.5)


@query(f"WITH {CONTRIBUTIONS} SELECT sample_id, 'f' || (feature % 16) AS feature, {r6('sum(contrib)', 'contrib')} FROM contrib GROUP BY sample_id, 'f' || (feature % 16)")
def p29_with_interactions(spark, sf_dir) -> DataFrame:
    rows = inputs.contributions(spark, sf_dir).select("sample_id", "feature", "contrib")
    terms = spark.range(64).select(F.col("id").cast("int").alias("term"), F.concat(F.lit("f"), (F.col("id") % 16).cast("string")).alias("feature"))
    return explanation.with_interactions(rows, terms)
