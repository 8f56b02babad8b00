"""Decoding, metrics, calibration and thresholds over predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coral
from ..operators import bootstrap, calibration, metrics, thresholds
from . import inputs
from .inputs import CLASSES, PREDICTIONS
from .registry import query, r6

NINE = [*metrics.COUNT_METRICS, "spearman", "ccc"]


def _metric_sql(keys: list[str], source: str = "pred", extra: str = "", exact: bool = False) -> str:
    """SQL of the nine metrics by the given keys; `exact`: not rounded."""
    k = "".join(f"{x}, " for x in keys)
    on = " AND ".join(f"a.{x} = b.{x}" for x in keys) or "TRUE"
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    joins = lambda other: f"JOIN {other} USING ({', '.join(keys)})" if keys else f"CROSS JOIN {other}"
    over = lambda *more: "PARTITION BY " + ", ".join([*keys, *more]) if keys or more else ""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""WITH {PREDICTIONS}{extra},
src AS (SELECT * FROM {source}),
g AS (SELECT DISTINCT {k}1 AS one FROM src),
grid AS (SELECT g.*, t.t AS y_true, p.p AS y_pred FROM g, (SELECT unnest(range(1, {CLASSES + 1})) AS t) t, (SELECT unnest(range(1, {CLASSES + 1})) AS p) p),
cm AS (SELECT {"".join(f"b.{x}, " for x in keys)}b.y_true, b.y_pred, CAST(count(a.y_true) AS DOUBLE) AS n FROM grid b LEFT JOIN src a ON {on} AND a.y_true = b.y_true AND a.y_pred = b.y_pred GROUP BY ALL),
cell AS (SELECT *, sum(n) OVER ({over('y_true')}) AS t, sum(n) OVER ({over('y_pred')}) AS p FROM cm),
counted AS (SELECT {k}CAST(sum(n) AS BIGINT) AS n, sum(n * abs(y_true - y_pred)) / sum(n) AS mae, sum(n) FILTER (y_true = y_pred) / sum(n) AS acc,
  sum(n) FILTER (abs(y_true - y_pred) <= 1) / sum(n) AS acc_pm1,
  coalesce(sum(n / t) FILTER (y_true = y_pred AND t > 0), 0) / {CLASSES} AS bacc,
  coalesce(sum(2 * n / (t + p)) FILTER (y_true = y_pred AND t + p > 0), 0) / {CLASSES} AS macro_f1,
  coalesce(sum(2 * n * t / (t + p)) FILTER (y_true = y_pred AND t + p > 0), 0) / sum(n) AS weighted_f1,
  CASE WHEN count(*) FILTER (y_true = y_pred AND t > 0) < 2 OR count(*) FILTER (y_true = y_pred AND p > 0) < 2 THEN 0
    ELSE 1 - sum(n * (y_true - y_pred) * (y_true - y_pred)) * sum(n) / sum(t * p * (y_true - y_pred) * (y_true - y_pred)) END AS kappa_quadratic
  FROM cell {group}),
ranked AS (SELECT *, rank() OVER ({part} ORDER BY y_true) + (count(*) OVER ({over('y_true')}) - 1) / 2.0 AS ra,
  rank() OVER ({part} ORDER BY y_cont) + (count(*) OVER ({over('y_cont')}) - 1) / 2.0 AS rb FROM src),
other AS (SELECT {k}coalesce(corr(ra, rb), 0) AS spearman,
  coalesce(2 * covar_pop(y_true, y_cont) / (var_pop(y_true) + var_pop(y_cont) + power(avg(y_true) - avg(y_cont), 2)), 0) AS ccc FROM ranked {group})
SELECT {k}n, {', '.join(m if exact else r6(m, m) for m in NINE)} FROM counted {joins('other')}"""


def _sets_sql(sets: list[list[str]], keys: list[str]) -> str:
    named = lambda s: ", ".join([*(k if k in s else f"CAST(NULL AS INTEGER) AS {k}" for k in keys), f"'{'+'.join(s) or 'all'}' AS grouping", "n", *NINE])
    return " UNION ALL ".join(f"SELECT {named(s)} FROM ({_metric_sql(s)})" for s in sets)


SETS = [[], ["task"], ["fold"], ["fold", "task"]]


@query(f"WITH {PREDICTIONS}, d AS (SELECT DISTINCT task FROM pred), g AS (SELECT task, t AS y_true, p AS y_pred FROM d, (SELECT unnest(range(1, 6)) AS t), (SELECT unnest(range(1, 6)) AS p)), c AS (SELECT g.task, g.y_true, g.y_pred, count(pred.task) AS n FROM g LEFT JOIN pred USING (task, y_true, y_pred) GROUP BY ALL) SELECT task, CAST(y_true AS INTEGER) AS y_true, CAST(y_pred AS INTEGER) AS y_pred, n, {r6('coalesce(n / nullif(sum(n) OVER (PARTITION BY task, y_true), 0), 0)', 'share')} FROM c")
def e01_confusion(spark, sf_dir) -> DataFrame:
    return metrics.normalized(metrics.confusion(inputs.predictions(spark, sf_dir), ["task"], CLASSES), ["task"])


@query(_metric_sql([]))
def e02_metrics_pooled(spark, sf_dir) -> DataFrame:
    return metrics.ordinal_metrics(inputs.predictions(spark, sf_dir), [], CLASSES)


@query(_metric_sql(["task"]))
def e06_metrics_by_task(spark, sf_dir) -> DataFrame:
    return metrics.ordinal_metrics(inputs.predictions(spark, sf_dir), ["task"], CLASSES)


@query(_metric_sql(["fold", "task"]))
def e06_metrics_by_fold_and_task(spark, sf_dir) -> DataFrame:
    return metrics.ordinal_metrics(inputs.predictions(spark, sf_dir), ["fold", "task"], CLASSES)


@query(_sets_sql(SETS, ["fold", "task"]))
def e06_metrics_by_sets(spark, sf_dir) -> DataFrame:
    return metrics.metrics_by_sets(inputs.predictions(spark, sf_dir), SETS, CLASSES)


@query(f"WITH {PREDICTIONS} SELECT fold, count(*) AS n, count(DISTINCT orig_index) AS distinct_n, sum(y_pred) AS total FROM pred GROUP BY fold")
def e07_pooled_folds(spark, sf_dir) -> DataFrame:
    rows = inputs.predictions(spark, sf_dir)
    every = metrics.pooled([rows.where(F.col("fold") == k) for k in range(5)], "orig_index")
    return every.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("orig_index").alias("distinct_n"), F.sum("y_pred").alias("total"))


@query(f"WITH {PREDICTIONS} SELECT task, count(*) FILTER (y_true = 2) AS support, count(*) FILTER (y_true = 2 AND y_pred = 1) AS mistaken, {r6('coalesce(count(*) FILTER (y_true = 2 AND y_pred = 1) / nullif(count(*) FILTER (y_true = 2), 0), 0)', 'rate')} FROM pred GROUP BY task")
def e10_two_taken_for_one(spark, sf_dir) -> DataFrame:
    return metrics.mistaken(inputs.predictions(spark, sf_dir), ["task"], 2, 1)


_RELIABLE = "rel AS (SELECT task, CAST(least(floor(conf * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(conf) AS confidence, avg(CAST(hit AS DOUBLE)) AS accuracy FROM (SELECT task, greatest(c1, c2, c3, c4, c5) AS conf, CAST(y_pred = y_true AS INTEGER) AS hit FROM pred) GROUP BY ALL)"


def _confident(spark, sf_dir) -> DataFrame:
    rows = inputs.predictions(spark, sf_dir)
    return rows.select("task", calibration.top_confidence(F.col("p_cls")).alias("conf"), (F.col("y_pred") == F.col("y_true")).alias("hit"))


@query(f"WITH {PREDICTIONS}, {_RELIABLE} SELECT task, bin, n, {r6('confidence', 'confidence')}, {r6('accuracy', 'accuracy')} FROM rel")
def e12_reliability(spark, sf_dir) -> DataFrame:
    return calibration.reliability(_confident(spark, sf_dir), ["task"], "conf", "hit")


@query(f"WITH {PREDICTIONS}, {_RELIABLE} SELECT task, CAST(sum(n) AS BIGINT) AS n, {r6('sum(n * abs(accuracy - confidence)) / sum(n)', 'ece')} FROM rel GROUP BY task")
def e12_expected_calibration_error(spark, sf_dir) -> DataFrame:
    return calibration.expected_error(calibration.reliability(_confident(spark, sf_dir), ["task"], "conf", "hit"), ["task"])


_TOP = "greatest(c1, c2, c3, c4, c5)"
_ARG = f"CASE {_TOP} WHEN c1 THEN 1 WHEN c2 THEN 2 WHEN c3 THEN 3 WHEN c4 THEN 4 ELSE 5 END"
_MULTI = " + ".join(f"power(c{k} - CAST(y_true = {k} AS INTEGER), 2)" for k in range(1, 6))


@query(f"WITH {PREDICTIONS} SELECT task, {r6(f'avg(power({_TOP} - CAST({_ARG} = y_true AS INTEGER), 2))', 'brier_top')}, {r6(f'avg({_MULTI})', 'brier_multi')} FROM pred GROUP BY task")
def e13_brier(spark, sf_dir) -> DataFrame:
    return calibration.brier(inputs.predictions(spark, sf_dir), ["task"])


def _rest_sql(column: str, upto: int, sign: str) -> str:
    long = " UNION ALL ".join(f"SELECT task, {k} AS k, {column}{k} AS p, CAST(y_true {sign} {k} AS INTEGER) AS hit FROM pred" for k in range(1, upto + 1))
    return f"WITH {PREDICTIONS}, l AS ({long}), b AS (SELECT task, k, least(floor(p * 10), 9) AS bin, count(*) AS n, sum(p) AS sp, sum(hit) AS sh, sum(power(p - hit, 2)) AS se FROM l GROUP BY ALL) SELECT task, k, CAST(sum(n) AS BIGINT) AS n, {r6('sum(abs(sp - sh)) / sum(n)', 'ece')}, {r6('sum(se) / sum(n)', 'brier')} FROM b GROUP BY task, k"


@query(_rest_sql("c", 5, "="))
def e14_class_calibration(spark, sf_dir) -> DataFrame:
    return calibration.one_against_rest(inputs.predictions(spark, sf_dir), ["task"], "p_cls", lambda k: F.col("y_true") == k)


@query(_rest_sql("p", 4, ">"))
def e14_bound_calibration(spark, sf_dir) -> DataFrame:
    return calibration.one_against_rest(inputs.predictions(spark, sf_dir), ["task"], "p_gt", lambda k: F.col("y_true") > k)


def _ba_sql(source: str) -> str:
    ccc = "2 * covar_pop(x, y) / (var_pop(x) + var_pop(y) + power(avg(x) - avg(y), 2))"
    return f"WITH {PREDICTIONS}, ba AS ({source}) SELECT count(*) AS n, {r6('avg(y - x)', 'bias')}, {r6('stddev_samp(y - x)', 'sd')}, {r6('avg(y - x) - 1.96 * stddev_samp(y - x)', 'low')}, {r6('avg(y - x) + 1.96 * stddev_samp(y - x)', 'high')}, {r6(ccc, 'ccc')} FROM ba"


@query(_ba_sql("SELECT CAST(y_true AS DOUBLE) AS x, y_cont AS y FROM pred"))
def e15_bland_altman_discs(spark, sf_dir) -> DataFrame:
    return calibration.bland_altman(inputs.predictions(spark, sf_dir))


@query(_ba_sql("SELECT avg(CAST(y_true AS DOUBLE)) AS x, avg(y_cont) AS y FROM pred GROUP BY patient_id"))
def e15_bland_altman_patients(spark, sf_dir) -> DataFrame:
    return calibration.bland_altman(inputs.predictions(spark, sf_dir), by="patient_id")


#: Fixed value: 0.975 quantile of Student's t with 4 degrees of freedom, for five folds.
_T4 = 2.7764451051977987
_FOLD = "SELECT '{m}' AS metric, {mean}, {sd}, count(*) AS n, {low}, {high} FROM f"


@query(f"WITH f AS ({_metric_sql(['fold'], exact=True)}) " + " UNION ALL ".join(_FOLD.format(m=m, mean=r6(f"avg({m})", "mean"), sd=r6(f"stddev_samp({m})", "sd"), low=r6(f"avg({m}) - {_T4} * stddev_samp({m}) / sqrt(count(*))", "low"), high=r6(f"avg({m}) + {_T4} * stddev_samp({m}) / sqrt(count(*))", "high")) for m in ("mae", "kappa_quadratic")))
def e16_fold_interval(spark, sf_dir) -> DataFrame:
    by_fold = metrics.ordinal_metrics(inputs.predictions(spark, sf_dir), ["fold"], CLASSES)
    return metrics.fold_interval(by_fold, "mae").unionByName(metrics.fold_interval(by_fold, "kappa_quadratic"))


@query(f"WITH {PREDICTIONS}, d AS (SELECT task, CAST(k AS INTEGER) AS distance FROM (SELECT DISTINCT task FROM pred), (SELECT unnest(range(0, 5)) AS k)), c AS (SELECT d.task, d.distance, count(p.task) AS n FROM d LEFT JOIN pred p ON p.task = d.task AND abs(p.y_true - p.y_pred) = d.distance GROUP BY ALL) SELECT task, distance, n, {r6('n / sum(n) OVER (PARTITION BY task)', 'share')} FROM c")
def e17_distance_shares(spark, sf_dir) -> DataFrame:
    return metrics.distance_shares(inputs.predictions(spark, sf_dir), ["task"], CLASSES)


@query(f"""WITH {PREDICTIONS}, t AS (
  (SELECT 1 AS rank, 'top' AS kind, * FROM pred WHERE y_true = y_pred AND y_true = 5 ORDER BY y_cont DESC, orig_index LIMIT 1) UNION ALL
  (SELECT 2, 'bottom', * FROM pred WHERE y_true = y_pred AND y_true = 1 ORDER BY y_cont, orig_index LIMIT 1) UNION ALL
  (SELECT 3, 'worst', * FROM pred ORDER BY abs(y_true - y_cont) DESC, y_cont DESC, orig_index LIMIT 1))
SELECT rank, kind, orig_index, y_true, y_pred, {r6('y_cont', 'y_cont')} FROM t QUALIFY row_number() OVER (PARTITION BY orig_index ORDER BY rank) = 1""")
def e18_typical_cases(spark, sf_dir) -> DataFrame:
    rows = inputs.predictions(spark, sf_dir).select("orig_index", "y_true", "y_pred", "y_cont")
    return metrics.typical_cases(rows, "orig_index", CLASSES)


@query(f"WITH {PREDICTIONS} SELECT orig_index, {', '.join(r6(f'p{k}', f'p_gt_{k}') for k in range(1, 5))}, {', '.join(r6(f'c{k}', f'p_cls_{k}') for k in range(1, 6))}, {r6('y_cont', 'y_cont')}, y_pred, CAST({_ARG} AS INTEGER) AS y_argmax, CAST({' + '.join(f'CAST(y_true > {k} AS INTEGER)' for k in range(1, 5))} AS INTEGER) AS rank_sum FROM pred")
def p15_coral_decode(spark, sf_dir) -> DataFrame:
    rows = inputs.predictions(spark, sf_dir)
    targets = F.aggregate(coral.rank_targets(F.col("y_true"), CLASSES), F.lit(0), lambda a, x: a + x)
    return rows.select(
        "orig_index", *[F.col("p_gt")[k - 1].alias(f"p_gt_{k}") for k in range(1, 5)], *[F.col("p_cls")[k - 1].alias(f"p_cls_{k}") for k in range(1, 6)], "y_cont", "y_pred", coral.decode_argmax(F.col("p_gt")).alias("y_argmax"), targets.alias("rank_sum")
    )


@query(f"WITH {PREDICTIONS}, t AS (SELECT * FROM (VALUES (0, 0.4, 0.5, 0.6, 0.5), (1, 0.5, 0.45, 0.5, 0.55), (2, 0.6, 0.6, 0.4, 0.4)) v(task, a, b, c, d)) SELECT orig_index, task, CAST(1 + CAST(p1 > CAST(a AS DOUBLE) AS INTEGER) + CAST(p2 > CAST(b AS DOUBLE) AS INTEGER) + CAST(p3 > CAST(c AS DOUBLE) AS INTEGER) + CAST(p4 > CAST(d AS DOUBLE) AS INTEGER) AS INTEGER) AS y_pred_calibrated FROM pred JOIN t USING (task)")
def p17_decode_by_task(spark, sf_dir) -> DataFrame:
    spec = {"by_task": {0: [0.4, 0.5, 0.6, 0.5], 1: [0.5, 0.45, 0.5, 0.55], 2: [0.6, 0.6, 0.4, 0.4]}, "default": 0.5}
    rows = thresholds.decode_by_task(inputs.predictions(spark, sf_dir), spec, CLASSES)
    return rows.select("orig_index", "task", "y_pred_calibrated")


@query(f"WITH {PREDICTIONS} SELECT orig_index, CAST(1 + CAST(y_cont > 1.4 AS INTEGER) + CAST(y_cont > 2.5 AS INTEGER) + CAST(y_cont > 3.6 AS INTEGER) + CAST(y_cont > 4.5 AS INTEGER) AS INTEGER) AS by_offset, CAST(greatest(1, least(5, floor(y_cont + 0.5))) AS INTEGER) AS by_round FROM pred")
def p18_decode_regression(spark, sf_dir) -> DataFrame:
    rows = inputs.predictions(spark, sf_dir)
    y = F.col("y_cont")
    return rows.select("orig_index", coral.decode_offsets(y, [0.4, 0.5, 0.6, 0.5]).alias("by_offset"), coral.decode_round(y, 1, CLASSES).alias("by_round"))


@query(f"WITH {PREDICTIONS}, m AS (SELECT fold, y_true, avg(s) AS m FROM pred GROUP BY ALL), b AS (SELECT fold, y_true, (m + lead(m) OVER (PARTITION BY fold ORDER BY y_true)) / 2 AS cut FROM m) SELECT orig_index, fold, CAST(1 + count(b.cut) FILTER (s > b.cut) AS INTEGER) AS y_axis FROM pred JOIN b USING (fold) GROUP BY orig_index, fold")
def p23_axis_thresholds(spark, sf_dir) -> DataFrame:
    return thresholds.axis_decode(inputs.predictions(spark, sf_dir), "fold").select("orig_index", "fold", "y_axis")


@query(f"WITH {PREDICTIONS} SELECT orig_index, {r6(' + '.join(f'(CAST(y_true > {k} AS INTEGER) - p{k})' for k in range(1, 5)), 'residual')}, {r6('(' + ' + '.join(f'CASE WHEN y_true > {k} THEN -ln(p{k}) ELSE -ln(1 - p{k}) END' for k in range(1, 5)) + ') / 4', 'loss')} FROM pred")
def p24_residual_and_loss(spark, sf_dir) -> DataFrame:
    rows = inputs.predictions(spark, sf_dir)
    return rows.select("orig_index", coral.residual(F.col("y_true"), F.col("p_gt")).alias("residual"), coral.loss(F.col("y_true"), coral.logits(F.col("s"), inputs.THETA)).alias("loss"))


_SLOPED = ", ".join(f"1.0/(1.0+exp(-1.7 * (s - ({t})))) AS q{k}" for k, t in enumerate(inputs.THETA, 1))


@query(f"WITH {PREDICTIONS}, q AS (SELECT orig_index, {_SLOPED} FROM pred) SELECT orig_index, {r6('1.0 + q1 + q2 + q3 + q4', 'y_cont')}, {' + '.join(['1'] + [f'CAST(q{k} > 0.5 AS INTEGER)' for k in range(1, 5)])} AS y_pred FROM q")
def p15_slope_decode(spark, sf_dir) -> DataFrame:
    """Decoding with a slope beside the cut points."""
    rows = inputs.predictions(spark, sf_dir)
    p = coral.bounds(F.col("s"), inputs.THETA, 1.7)
    return rows.select("orig_index", coral.expected(p).alias("y_cont"), coral.decode(p).alias("y_pred"))


@query()
def e08_threshold_calibration(spark, sf_dir) -> DataFrame:
    return thresholds.calibrate(inputs.predictions(spark, sf_dir), ["task"], CLASSES)


@query()
def e08_threshold_variants(spark, sf_dir) -> DataFrame:
    return thresholds.variants(inputs.predictions(spark, sf_dir), CLASSES)


@query()
def e08_offset_calibration(spark, sf_dir) -> DataFrame:
    return thresholds.calibrate_offsets(inputs.predictions(spark, sf_dir), ["task"], CLASSES)


@query()
def e09_nested_thresholds(spark, sf_dir) -> DataFrame:
    return thresholds.nested_medians(inputs.predictions(spark, sf_dir), CLASSES)


@query()
def e11_patient_bootstrap(spark, sf_dir) -> DataFrame:
    return bootstrap.intervals(inputs.predictions(spark, sf_dir), "patient_id", CLASSES, resamples=1000)
