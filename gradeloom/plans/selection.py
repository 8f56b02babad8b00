"""Robust feature selection: repeatability, relevance, redundancy, stability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cleaning, harmonize, interactions, linear, selection
from ..operators.lineage import settled
from . import inputs
from .inputs import _BASE, FEATURES, PLANTED
from .registry import query, r6

#: The features' table behind the one of the embeddings, which the planted ones have too.
_FEAT = FEATURES[len(_BASE) + 2 :]

_ICC = """cells AS (SELECT *, value - avg(value) OVER (PARTITION BY feature) AS v FROM feat),
byrow AS (SELECT feature, count(*) AS n, sum(m * m) AS rr, sum(ss) AS total FROM (SELECT feature, case_id, segment, avg(v) AS m, sum(v * v) AS ss FROM cells GROUP BY ALL) GROUP BY feature),
bycol AS (SELECT feature, count(*) AS k, sum(m * m) AS cc FROM (SELECT feature, condition, avg(v) AS m FROM cells GROUP BY ALL) GROUP BY feature),
ms AS (SELECT feature, n, k, k * rr / (n - 1) AS s, n * cc / (k - 1) AS r, greatest(0, total - k * rr - n * cc) / ((n - 1) * (k - 1)) AS e FROM byrow JOIN bycol USING (feature)),
icc AS (SELECT feature, n, k, greatest(-1, least(1, (s - e) / (s + (k - 1) * e + k * (r - e) / n))) AS icc FROM ms)"""


@query(f"WITH {FEATURES}, {_ICC} SELECT feature, n, k, {r6('icc', 'icc')}, icc >= 0.9 AS keep FROM icc")
def f01_icc(spark, sf_dir) -> DataFrame:
    return selection.icc21(inputs.features(spark, sf_dir), 0.9)


_RHO = """ranks AS (SELECT feature, pfirrmann, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY feature ORDER BY pfirrmann) + (count(*) OVER (PARTITION BY feature, pfirrmann) - 1) / 2.0 AS ry FROM planted),
rho AS (SELECT feature, count(*) AS n, corr(rx, ry) AS rho FROM ranks GROUP BY feature)"""


@query(f"WITH {PLANTED}, {_RHO} SELECT feature, n, {r6('rho', 'rho')} FROM rho")
def f03_spearman(spark, sf_dir) -> DataFrame:
    return selection.spearman_with(inputs.planted(spark, sf_dir))


@query(f"WITH {PLANTED}, {_RHO}, p AS (SELECT *, exp(-round(rho, 9) * round(rho, 9) * n / 4) AS p FROM rho), k AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS r, count(*) OVER () AS m FROM p) SELECT feature, {r6('p', 'p')}, {r6('least(1, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING))', 'q')} FROM k")
def f04_benjamini_hochberg(spark, sf_dir) -> DataFrame:
    """q-values of a bound on the p-value that SQL has too."""
    rho = F.round("rho", 9)
    tests = selection.spearman_with(inputs.planted(spark, sf_dir)).withColumn("p", F.exp(-rho * rho * F.col("n") / 4))
    return selection.benjamini_hochberg(tests).select("feature", "p", "q")


def _tests(spark, sf_dir) -> DataFrame:
    t = settled(selection.spearman_with(inputs.planted(spark, sf_dir)))
    return selection.benjamini_hochberg(t.withColumn("p", selection.p_value(F.col("rho"), F.col("n"))))


# Student's t by its integral over the angle: A(t) is that of cos^(n-3) from 0 to atan(t / sqrt(n - 2)), as a share of that to a right angle
_P = """grid AS (SELECT unnest(range(0, 4001)) AS i), weighted AS (SELECT i, CASE WHEN i = 0 OR i = 4000 THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END AS w FROM grid),
angles AS (SELECT feature, n, rho, asin(least(1, abs(rho))) AS theta FROM rho),
tests0 AS (SELECT feature, n, rho, greatest(0, 1 - theta * sum(w * power(cos(theta * i / 4000), n - 3)) / (pi() / 2 * sum(w * power(greatest(0, cos(pi() / 2 * i / 4000)), n - 3)))) AS p FROM angles, weighted GROUP BY feature, n, rho, theta),
tests1 AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS r, count(*) OVER () AS m FROM tests0),
tests AS (SELECT feature, n, rho, p, least(1, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM tests1)"""


@query(f"WITH {PLANTED}, {_RHO}, {_P} SELECT feature, n, {r6('rho', 'rho')}, {r6('p', 'p')}, {r6('q', 'q')} FROM tests")
def f03_spearman_p_values(spark, sf_dir) -> DataFrame:
    return _tests(spark, sf_dir)


@query(f"WITH {PLANTED}, {_FEAT}, {_RHO}, {_P}, {_ICC} SELECT feature, n, {r6('rho', 'rho')}, {r6('p', 'p')}, {r6('q', 'q')}, {r6('icc', 'icc')}, {r6('abs(rho) * icc', 'score')} FROM (SELECT tests.*, icc.icc FROM tests JOIN icc USING (feature)) WHERE q < 0.05 AND abs(rho) >= 0.1 AND icc >= 0.75")
def f05_relevant_features(spark, sf_dir) -> DataFrame:
    return selection.relevant(_tests(spark, sf_dir), selection.icc21(inputs.features(spark, sf_dir), 0.75))


def _few(spark, sf_dir) -> DataFrame:
    """Planted features and near copies of the first four."""
    f = inputs.planted(spark, sf_dir)
    copies = f.where(F.col("feature").isin("Deep_0", "Deep_1", "Deep_2", "Deep_3"))
    k = F.substring_index("feature", "_", -1).cast("int")
    copies = copies.withColumn("value", F.col("value") * (k + 1) + 0.001 * k).withColumn("feature", F.concat("feature", F.lit("_copy")))
    return f.unionByName(copies)


_FEW = PLANTED + """,
few AS (SELECT case_id, segment, feature, value, pfirrmann FROM planted UNION ALL SELECT case_id, segment, feature || '_copy', value * (CAST(substr(feature, 6) AS INTEGER) + 1) + 0.001 * CAST(substr(feature, 6) AS INTEGER), pfirrmann FROM planted WHERE feature IN ('Deep_0', 'Deep_1', 'Deep_2', 'Deep_3')),
fr AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM few)"""


@query(f"WITH {_FEW} SELECT a.feature AS feature1, b.feature AS feature2, {r6('corr(a.r, b.r)', 'rho')} FROM fr a JOIN fr b ON a.case_id = b.case_id AND a.segment = b.segment AND a.feature < b.feature GROUP BY ALL")
def f07_pairwise_spearman(spark, sf_dir) -> DataFrame:
    return selection.pairwise_spearman(_few(spark, sf_dir))


_DEDUP = f"""{_FEW}, pr AS (SELECT a.feature AS f1, b.feature AS f2, corr(a.r, b.r) AS rho FROM fr a JOIN fr b ON a.case_id = b.case_id AND a.segment = b.segment AND a.feature < b.feature GROUP BY ALL),
gr AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY pfirrmann) + (count(*) OVER (PARTITION BY feature, pfirrmann) - 1) / 2.0 AS g FROM fr),
sc AS (SELECT feature, abs(corr(r, g)) AS score FROM gr GROUP BY feature),
ov AS (SELECT f1, f2, rho, row_number() OVER (ORDER BY round(abs(rho), 9) DESC, f1, f2) AS i FROM pr WHERE abs(rho) > 0.95),
step AS (SELECT i, rho, CASE WHEN round(a.score, 9) < round(b.score, 9) THEN f1 ELSE f2 END AS loser, CASE WHEN round(a.score, 9) < round(b.score, 9) THEN f2 ELSE f1 END AS winner FROM ov JOIN sc a ON a.feature = f1 JOIN sc b ON b.feature = f2),
greedy AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS gone, ''::VARCHAR AS loser, ''::VARCHAR AS winner, 0.0::DOUBLE AS rho UNION ALL
  SELECT s.i, CASE WHEN list_contains(g.gone, s.loser) OR list_contains(g.gone, s.winner) THEN g.gone ELSE list_append(g.gone, s.loser) END,
    CASE WHEN list_contains(g.gone, s.loser) OR list_contains(g.gone, s.winner) THEN '' ELSE s.loser END, s.winner, s.rho FROM greedy g JOIN step s ON s.i = g.i + 1),
removed AS (SELECT loser AS feature, winner AS removed_by, rho AS removed_rho, CAST(len(gone) AS INTEGER) AS removed_order FROM greedy WHERE loser <> ''),
most AS (SELECT feature, max(abs(rho)) AS max_abs_rho, count(*) FILTER (abs(rho) > 0.95) AS n_over FROM (SELECT f1 AS feature, rho FROM pr UNION ALL SELECT f2, rho FROM pr) GROUP BY feature)"""


@query(f"WITH RECURSIVE {_DEDUP} SELECT feature, {r6('score', 'score')}, removed_by IS NULL AS kept, removed_by, {r6('removed_rho', 'removed_rho')}, removed_order, {r6('coalesce(max_abs_rho, 0)', 'max_abs_rho')}, coalesce(n_over, 0) AS n_over FROM sc LEFT JOIN most USING (feature) LEFT JOIN removed USING (feature)")
def f08_deduplicate(spark, sf_dir) -> DataFrame:
    rows = _few(spark, sf_dir)
    scores = selection.spearman_with(rows).select("feature", F.abs("rho").alias("score"))
    near, extremes = selection.redundancy(rows)
    return selection.deduplicate(near, scores, 0.95, extremes)


@query(f"WITH {PLANTED}, {_RHO} SELECT feature, {r6('abs(rho)', 'score')} FROM rho ORDER BY abs(rho) DESC, feature LIMIT 20")
def f09_top_features(spark, sf_dir) -> DataFrame:
    return selection.top_features(selection.spearman_with(inputs.planted(spark, sf_dir)).select("feature", F.abs("rho").alias("score")), 20)


@query()
def f10_grade_monotonicity(spark, sf_dir) -> DataFrame:
    rows = inputs.planted(spark, sf_dir)
    return selection.monotonicity(rows, selection.spearman_with(rows), 0.1)


@query(f"WITH {FEATURES}, {_ICC}, t AS (SELECT unnest(range(0, 101)) AS b) SELECT {r6('b / 100.0', 'threshold')}, count(icc) AS n FROM t LEFT JOIN icc ON icc >= 0 AND least(100, floor(icc * 100 + 1e-9)) >= b GROUP BY b")
def f17_retained_curve(spark, sf_dir) -> DataFrame:
    return selection.retained_curve(selection.icc21(inputs.features(spark, sf_dir)))


@query(f"WITH {PLANTED}, e AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM planted GROUP BY feature), c AS (SELECT feature, CAST(least(19, floor((value - lo) / ((hi - lo) / 20))) AS INTEGER) AS bin, count(*) AS n FROM planted JOIN e USING (feature) GROUP BY ALL) SELECT feature, bin, n, {r6('n / max(n) OVER (PARTITION BY feature)', 'density')} FROM c")
def f18_histogram(spark, sf_dir) -> DataFrame:
    return selection.histogram(inputs.planted(spark, sf_dir), ["feature"], "value", 20)


def _vectors(spark, sf_dir) -> DataFrame:
    """Vectors of samples with grade, patient weight and fold."""
    rows = inputs.planted(spark, sf_dir)
    v = harmonize.feature_vectors(rows, ["case_id", "segment", "pfirrmann"])
    v = cleaning.patient_weights(v, "case_id")
    return v.select("case_id", "segment", (F.col("case_id").cast("long") % 5).cast("int").alias("fold"), "x", F.col("pfirrmann").cast("double").alias("y"), F.col("weight").alias("w"))


NAMES = sorted(f"Deep_{i}" for i in range(64))


@query()
def f12_lambda_choice(spark, sf_dir) -> DataFrame:
    return linear.choose_lambda(_vectors(spark, sf_dir), "fold", "segment", len(NAMES))


@query()
def f13_stability_selection(spark, sf_dir) -> DataFrame:
    return linear.stability(_vectors(spark, sf_dir), "case_id", "segment", NAMES, alpha=0.05)


@query()
def f13_tuned_stability(spark, sf_dir) -> DataFrame:
    return linear.tuned_stability(_vectors(spark, sf_dir), "case_id", "segment", NAMES, linear.lambda_grid(np.array([0.4]), 0.5), start=30, most=8)


_SIX = ["Deep_63", "Deep_0"]


@query(f"WITH {PLANTED}, {_RHO}, best AS (SELECT feature, CAST(row_number() OVER (ORDER BY round(abs(rho), 9) DESC, feature) AS INTEGER) AS position FROM rho QUALIFY position <= 6), more AS (SELECT f AS feature, i FROM (VALUES " + ", ".join(f"('{f}', {i})" for i, f in enumerate(_SIX)) + ") v(f, i) WHERE f NOT IN (SELECT feature FROM best)) SELECT * FROM best UNION ALL SELECT feature, CAST(6 + row_number() OVER (ORDER BY i) AS INTEGER) FROM more")
def f15_final_features(spark, sf_dir) -> DataFrame:
    """The best six by rank correlation, then the forced ones that are not among them."""
    scores = selection.spearman_with(inputs.planted(spark, sf_dir)).select("feature", F.round(F.abs("rho"), 9).alias("score"))
    ranked = selection.top_features(scores, 6).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "feature")))
    return selection.final_features(ranked, 6, _SIX)


@query()
def f15_model_input(spark, sf_dir) -> DataFrame:
    rows = inputs.planted(spark, sf_dir)
    ranked = linear.stability(_vectors(spark, sf_dir), "case_id", "segment", NAMES, alpha=0.05)
    final = selection.final_features(ranked.where("stable"), 6, ["Deep_63", "Deep_0"])
    names = [r["feature"] for r in final.orderBy("position").collect()]
    return selection.model_input(rows, names)


_ALONE = f"""fp AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM planted),
close AS (SELECT count(*) AS n FROM (SELECT corr(a.r, b.r) AS rho FROM fp a JOIN fp b ON a.case_id = b.case_id AND a.segment = b.segment AND a.feature < b.feature GROUP BY a.feature, b.feature) WHERE abs(rho) > 0.95)"""


@query(f"WITH {PLANTED}, {_FEAT}, {_RHO}, {_P}, {_ICC}, {_ALONE} SELECT feature, {r6('icc', 'icc')}, icc >= 0.75 AS pass_icc, {r6('rho', 'rho')}, {r6('p', 'p')}, {r6('q', 'q')}, (SELECT n FROM close) = 0 AS pass_dedup, CAST(NULL AS VARCHAR) AS removed_by FROM icc JOIN tests USING (feature)")
def f16_feature_audit(spark, sf_dir) -> DataFrame:
    rows = inputs.planted(spark, sf_dir)
    tests = settled(_tests(spark, sf_dir))  # a row a feature, for the scores too
    near, extremes = selection.redundancy(rows)
    dedup = selection.deduplicate(near, tests.select("feature", F.abs("rho").alias("score")), 0.95, extremes)
    return selection.audit(rows.select("feature").distinct(), selection.icc21(inputs.features(spark, sf_dir)), tests, dedup)


@query(f"""WITH {PLANTED}, v AS (SELECT case_id, segment, pfirrmann, feature, value FROM planted),
p AS (SELECT a.feature AS feature1, b.feature AS feature2, a.value * b.value AS product, CAST(a.pfirrmann AS DOUBLE) AS y FROM v a JOIN v b ON a.case_id = b.case_id AND a.segment = b.segment AND a.feature < b.feature),
r AS (SELECT *, rank() OVER (PARTITION BY feature1, feature2 ORDER BY product) + (count(*) OVER (PARTITION BY feature1, feature2, product) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY feature1, feature2 ORDER BY y) + (count(*) OVER (PARTITION BY feature1, feature2, y) - 1) / 2.0 AS rb FROM p),
c AS (SELECT feature1, feature2, corr(ra, rb) AS rho FROM r GROUP BY ALL)
SELECT feature1, feature2, {r6('rho', 'rho')}, {r6('abs(rho)', 'abs_rho')} FROM c ORDER BY round(abs(rho), 9) DESC, feature1, feature2 LIMIT 10""")
def f19_interactions(spark, sf_dir) -> DataFrame:
    return interactions.interactions(_vectors(spark, sf_dir), NAMES, "y", 10)


@query()
def w1_robust_selection(spark, sf_dir) -> DataFrame:
    """The whole chain: align, clean, ICC, relevance, redundancy, stability."""
    long = inputs.features(spark, sf_dir)
    pos = F.substring_index("feature", "_", -1).cast("int")
    long = long.withColumn("value", F.when(pos < 8, F.col("value") + 0.05 * F.col("pfirrmann")).otherwise(F.col("value")))
    clean = settled(cleaning.drop_constant(cleaning.drop_incomplete(cleaning.align(settled(long), len(inputs.CONDITIONS)))))
    gold = clean.where(F.col("condition") == "gold")
    tests = settled(selection.spearman_with(gold))
    tests = selection.benjamini_hochberg(tests.withColumn("p", selection.p_value(F.col("rho"), F.col("n"))))
    strong = settled(selection.relevant(tests, selection.icc21(clean, 0.75)))
    kept = settled(gold.join(strong, "feature", "left_semi"))
    near, extremes = selection.redundancy(kept)
    audit = selection.deduplicate(settled(near), strong, 0.95, extremes).where("kept")
    names = sorted(r["feature"] for r in audit.select("feature").collect())
    if not names:
        return spark.createDataFrame([], "feature string, pi double, mean_abs_beta double, score double, stable boolean, rank int")
    v = cleaning.patient_weights(harmonize.feature_vectors(kept.where(F.col("feature").isin(names)), ["case_id", "segment", "pfirrmann"]), "case_id")
    vectors = settled(v.select("case_id", "segment", (F.col("case_id").cast("long") % 5).cast("int").alias("fold"), "x", F.col("pfirrmann").cast("double").alias("y"), F.col("weight").alias("w")))
    alpha = linear.choose_lambda(vectors, "fold", "segment", len(names), one_se=False).where("selected").first()["alpha"]
    return linear.stability(vectors, "case_id", "segment", names, alpha)
