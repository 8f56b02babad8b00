"""Linear models on moments, sparse PLS-DA, thresholds of scores, choice of iterations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cutpoints, linear
from . import inputs
from .inputs import CLASSES, DISCS, PREDICTIONS
from .registry import query, r6
from .evaluation import _metric_sql
from .selection import NAMES, _vectors


def _rows(spark, sf_dir) -> DataFrame:
    return _vectors(spark, sf_dir)


@query()
def m01_enet_path(spark, sf_dir) -> DataFrame:
    p = len(NAMES)
    cell = linear.group_moments(_rows(spark, sf_dir).withColumn("all", F.lit(0)), ["all"], p).first()
    gram, moment, _, _ = linear.centred(linear.Moments.unpacked(cell["moments"], p))
    penalties = linear.lambda_max(gram, moment, 0.5, np.ones(p)) * 0.001 ** (np.arange(100) / 99)
    path = linear.enet_path(gram, moment, 0.5, penalties)
    rows = [(i, float(a), n, float(b)) for i, (a, bs) in enumerate(zip(penalties, path, strict=True)) for n, b in zip(NAMES, bs, strict=True)]
    return spark.createDataFrame(rows, "step int, penalty double, feature string, beta double")


_V = "v AS (SELECT vec_id, CAST(1 + label % 5 AS DOUBLE) AS y, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"


@query(f"WITH {_V}, t AS (SELECT vec_id, y, pos, CASE WHEN pos < 8 THEN x + CAST(0.05 AS DOUBLE) * y ELSE x END AS x FROM v) SELECT a.pos AS i, b.pos AS j, {r6('sum(a.x * b.x)', 'xx')}, {r6('sum(a.x * a.y)', 'xy')} FROM t a JOIN t b ON a.vec_id = b.vec_id GROUP BY a.pos, b.pos")
def m01_gram(spark, sf_dir) -> DataFrame:
    """The moments all fits work on, unweighted."""
    p = len(NAMES)
    order = [int(n.split("_")[1]) for n in NAMES]
    cell = linear.group_moments(_rows(spark, sf_dir).withColumn("w", F.lit(1.0)).withColumn("all", F.lit(0)), ["all"], p).first()
    m = linear.Moments.unpacked(cell["moments"], p)
    return spark.createDataFrame([(order[i], order[j], float(m.xx[i, j]), float(m.xy[i])) for i in range(p) for j in range(p)], "i long, j long, xx double, xy double")


@query()
def m02_grid_search(spark, sf_dir) -> DataFrame:
    return linear.grid_search(_rows(spark, sf_dir).withColumn("w", F.lit(1.0)), "fold", len(NAMES), CLASSES, [0.2, 0.5, 0.9])


@query()
def p28_design_path(spark, sf_dir) -> DataFrame:
    """Base features, segment dummies and interactions with their own penalty factors."""
    levels = ["L1-L2", "L2-L3", "L3-L4", "L4-L5", "L5-S1"]
    p = len(NAMES)
    rows = _rows(spark, sf_dir).withColumn("x", linear.design(F.col("x"), F.col("segment"), levels, "L3-L4")).withColumn("w", F.lit(1.0))
    factors = linear.penalty_factors(p, len(levels))
    return linear.grid_search(rows, "fold", len(factors), CLASSES, [0.2, 0.5, 0.9], factors=factors)


_DUMMY = "CASE WHEN segment = {k} THEN 1.0 ELSE 0.0 END"


@query(f"WITH {DISCS} SELECT patient_id, l_partkey, l_suppkey, l_linenumber, {r6('l_quantity * ' + _DUMMY.format(k=1), 'q1')}, {r6('l_tax * ' + _DUMMY.format(k=2), 't2')}, {r6(_DUMMY.format(k=1), 'd1')} FROM discs")
def p28_design_matrix(spark, sf_dir) -> DataFrame:
    d = inputs.discs(spark, sf_dir)
    x = linear.design(F.array("l_quantity", "l_tax"), F.col("segment"), [0, 1, 2], 0)
    return d.withColumn("x", x).select("patient_id", "l_partkey", "l_suppkey", "l_linenumber", F.col("x")[4].alias("q1"), F.col("x")[7].alias("t2"), F.col("x")[2].alias("d1"))


def _pls(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("task", (F.col("fold") % 3).cast("int"))
    model = linear.sparse_pls(rows, len(NAMES), list(range(1, CLASSES + 1)), [8, 8])
    return rows, model, linear.pls_scores(rows, model)


@query()
def m03_sparse_pls(spark, sf_dir) -> DataFrame:
    _, model, _ = _pls(spark, sf_dir)
    return spark.createDataFrame([(n, k + 1, float(model.rotation[i, k])) for i, n in enumerate(NAMES) for k in range(model.rotation.shape[1])], "feature string, component int, weight double")


@query()
def m04_pls_scores(spark, sf_dir) -> DataFrame:
    _, _, scored = _pls(spark, sf_dir)
    return scored.select("case_id", "segment", F.col("t")[0].alias("t1"), F.col("t")[1].alias("t2"), "y_pred", "y_cont")


def _given(spark, sf_dir) -> DataFrame:
    """Predictions as samples with two given component scores."""
    rows = inputs.predictions(spark, sf_dir)
    return rows.select("orig_index", "task", F.col("y_true").cast("double").alias("y"), F.array(F.col("s"), F.col("y_cont") / 2).alias("t"))


_GIVEN = f"{PREDICTIONS}, g AS (SELECT orig_index, task, CAST(y_true AS DOUBLE) AS y, s AS t1, y_cont / 2 AS t2 FROM pred), c AS (SELECT y, avg(t1) AS c1, avg(t2) AS c2 FROM g GROUP BY y)"


@query(f"WITH {_GIVEN}, k AS (SELECT task, y, count(*) AS n, avg(t1) AS k1, avg(t2) AS k2 FROM g GROUP BY ALL) SELECT task, y, n, {r6('n / (n + 10.0) * k1 + (1 - n / (n + 10.0)) * c1', 'c1')}, {r6('n / (n + 10.0) * k2 + (1 - n / (n + 10.0)) * c2', 'c2')} FROM k JOIN c USING (y)")
def m05_mixed_centroids_given(spark, sf_dir) -> DataFrame:
    rows = _given(spark, sf_dir)
    mixed = linear.mixed_centroids(linear.centroids(rows, 2, []), linear.centroids(rows, 2, ["task"]))
    return mixed.select("task", "y", "n", F.col("c")[0].alias("c1"), F.col("c")[1].alias("c2"))


@query(f"""WITH {_GIVEN}, d AS (SELECT orig_index, y, sqrt(power(t1 - c1, 2) + power(t2 - c2, 2)) AS d FROM (SELECT orig_index, t1, t2 FROM g) g JOIN c ON TRUE),
e AS (SELECT orig_index, min_by(y, (d, y)) AS near, sum(exp(m - d) * y) / sum(exp(m - d)) AS cont FROM (SELECT *, min(d) OVER (PARTITION BY orig_index) AS m FROM d) GROUP BY orig_index)
SELECT orig_index, {r6('near', 'y_near')}, {r6('cont', 'y_near_cont')} FROM e""")
def m06_nearest_centroid_given(spark, sf_dir) -> DataFrame:
    rows = _given(spark, sf_dir)
    near = linear.nearest_centroid(rows, linear.centroids(rows, 2, []), [float(c) for c in range(1, CLASSES + 1)])
    return near.select("orig_index", "y_near", "y_near_cont")


@query()
def m05_mixed_centroids(spark, sf_dir) -> DataFrame:
    _, _, scored = _pls(spark, sf_dir)
    mixed = linear.mixed_centroids(linear.centroids(scored, 2, []), linear.centroids(scored, 2, ["task"]))
    return mixed.select("task", "y", "n", F.col("c")[0].alias("c1"), F.col("c")[1].alias("c2"))


@query()
def m06_nearest_centroid(spark, sf_dir) -> DataFrame:
    _, _, scored = _pls(spark, sf_dir)
    table = linear.centroids(scored, 2, [])
    classes = [float(c) for c in range(1, CLASSES + 1)]
    plain = linear.nearest_centroid(scored, table, classes).select("case_id", "segment", F.col("y_near").alias("euclid"), F.col("y_near_cont").alias("euclid_cont"))
    scaled = linear.nearest_centroid(scored, table, classes, linear.inverse_diagonal(scored, 2)).select("case_id", "segment", F.col("y_near").alias("mahalanobis"), F.col("y_near_cont").alias("mahalanobis_cont"))
    return plain.join(scaled, ["case_id", "segment"])


_TWO = ", two AS (SELECT *, 1 AS candidate FROM pred UNION ALL SELECT * REPLACE (3 AS y_pred), 2 AS candidate FROM pred)"


@query(f"WITH j AS (SELECT candidate, sum((-mae + 0.1 * (kappa_quadratic + spearman + acc_pm1)) * n) / sum(n) AS score FROM ({_metric_sql(['candidate', 'fold'], 'two', _TWO, exact=True)}) GROUP BY candidate) SELECT candidate, {r6('score', 'score')}, row_number() OVER (ORDER BY score DESC, candidate) = 1 AS best FROM j")
def m07_tuning_score(spark, sf_dir) -> DataFrame:
    rows = inputs.predictions(spark, sf_dir)
    two = rows.withColumn("candidate", F.lit(1)).unionByName(rows.withColumn("candidate", F.lit(2)).withColumn("y_pred", F.lit(3)))
    return linear.tuning_score(two, "candidate", "fold", CLASSES)


@query()
def m09_fit_thresholds(spark, sf_dir) -> DataFrame:
    t = cutpoints.fit_thresholds(inputs.predictions(spark, sf_dir), ["fold"], CLASSES, slope=True, held_out=0.2, by="orig_index")
    return t.select("fold", *[F.col("theta")[k].alias(f"theta{k + 1}") for k in range(CLASSES - 1)], "slope")


_LOSS = "(" + " + ".join(f"CASE WHEN y_true > {k} THEN -ln(p{k}) ELSE -ln(1 - p{k}) END" for k in range(1, 5)) + ") / 4"


@query(f"WITH {PREDICTIONS} SELECT fold, task, {r6(f'avg({_LOSS})', 'loss')} FROM pred GROUP BY ALL")
def m10_coral_loss(spark, sf_dir) -> DataFrame:
    from ..functions import coral

    return inputs.predictions(spark, sf_dir).groupBy("fold", "task").agg(F.avg(coral.loss(F.col("y_true"), coral.logits(F.col("s"), inputs.THETA))).alias("loss"))


@query(f"WITH {PREDICTIONS}, i AS (SELECT fold, task AS iteration, avg(abs(y_true - y_pred)) AS mae, avg({_LOSS}) AS loss FROM pred GROUP BY ALL) SELECT fold, iteration, {r6('mae', 'mae')}, {r6('loss', 'loss')}, row_number() OVER (PARTITION BY fold ORDER BY round(mae, 12), round(loss, 12), iteration) AS rank FROM i QUALIFY rank <= 2")
def m11_choose_iteration(spark, sf_dir) -> DataFrame:
    from ..functions import coral

    rows = inputs.predictions(spark, sf_dir).select("fold", F.col("task").alias("iteration"), "y_true", "y_pred", coral.loss(F.col("y_true"), coral.logits(F.col("s"), inputs.THETA)).alias("loss"))
    return linear.choose_iteration(rows, CLASSES, 2)


_HISTORY = f"{PREDICTIONS}, h AS (SELECT fold, CAST(orig_index % 20 AS INTEGER) AS iteration, avg(abs(y_true - y_pred)) AS value FROM pred GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(value, 12), iteration) AS place FROM h)"


def _history(spark, sf_dir) -> DataFrame:
    rows = inputs.predictions(spark, sf_dir)
    return rows.groupBy("fold", (F.col("orig_index") % 20).cast("int").alias("iteration")).agg(F.round(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))), 12).alias("value"))


@query(f"WITH {_HISTORY} SELECT h.fold, h.iteration FROM h JOIN b ON b.fold = h.fold AND b.place = 1 AND abs(h.iteration - b.iteration) <= 3")
def m11_window_candidates(spark, sf_dir) -> DataFrame:
    return linear.iteration_candidates(_history(spark, sf_dir), "window", window=3)


@query(f"WITH {_HISTORY} SELECT fold, iteration FROM b WHERE place <= 4")
def m11_top_candidates(spark, sf_dir) -> DataFrame:
    return linear.iteration_candidates(_history(spark, sf_dir), "topk_reg", top=4)


@query(f"WITH {_HISTORY} SELECT fold, iteration FROM h")
def m11_all_candidates(spark, sf_dir) -> DataFrame:
    return linear.iteration_candidates(_history(spark, sf_dir), "all")


@query(f"WITH {PREDICTIONS} SELECT task, {r6(f'sum({_LOSS} * (1 + orig_index % 3)) / sum(1 + orig_index % 3)', 'loss')} FROM pred GROUP BY task")
def m10_weighted_coral_loss(spark, sf_dir) -> DataFrame:
    from ..functions import coral

    loss = coral.loss(F.col("y_true"), coral.logits(F.col("s"), inputs.THETA))
    return inputs.predictions(spark, sf_dir).groupBy("task").agg(coral.mean_loss(loss, (1 + F.col("orig_index") % 3).cast("double")).alias("loss"))


@query()
def m12_logistic_grid(spark, sf_dir) -> DataFrame:
    """C and class weights of the logistic step, each by predictions of held-out folds."""
    _, _, scored = _pls(spark, sf_dir)
    return linear.logistic_grid(scored.select("fold", "t", "y"), "fold", CLASSES)


@query()
def m12_logistic_postprocess(spark, sf_dir) -> DataFrame:
    _, _, scored = _pls(spark, sf_dir)
    rows = scored.select("case_id", "segment", "t", F.col("y").cast("int").alias("y"))
    return linear.logistic_postprocess(rows).select("case_id", "segment", "y", "y_cont", F.col("y_pred").alias("y_hat"))
