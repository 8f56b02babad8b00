"""Standardisation and batch harmonisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import harmonize
from . import inputs
from .inputs import DISCS, PLANTED
from .registry import query, r6

ROW = ["patient_id", "l_partkey", "l_suppkey", "l_linenumber"]


def _long(spark, sf_dir) -> DataFrame:
    """Disc features as a long table with batch, segment and fold."""
    d = inputs.discs(spark, sf_dir)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in inputs.DISC_FEATURES])
    return d.select(*ROW, "segment", "batch", (F.col("patient_id") % 5).cast("int").alias("fold"), F.explode(cells).alias("e")).select(*ROW, "segment", "batch", "fold", "e.*")


_LONG = DISCS + ", long AS (" + " UNION ALL ".join(f"SELECT patient_id, l_partkey, l_suppkey, l_linenumber, segment, batch, CAST(patient_id % 5 AS INTEGER) AS fold, '{c}' AS feature, {c} AS value FROM discs" for c in inputs.DISC_FEATURES) + ")"


def _summary(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy("feature", *by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.max("value").alias("high"))


_SUM = f"count(*) AS n, {r6('avg(value)', 'mean')}, {r6('stddev_pop(value)', 'sd')}, {r6('max(value)', 'high')}"


@query(f"WITH {_LONG}, f AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM long WHERE fold <> 0 GROUP BY feature), z AS (SELECT feature, fold, (value - m) / s AS value FROM long JOIN f USING (feature)) SELECT feature, fold, {_SUM} FROM z GROUP BY feature, fold")
def n01_zscore(spark, sf_dir) -> DataFrame:
    rows = _long(spark, sf_dir)
    return _summary(harmonize.zscore_apply(rows, harmonize.zscore_fit(rows.where("fold <> 0"))), "fold")


@query(f"WITH {_LONG}, t AS (SELECT feature, value, sum(count(*)) OVER (PARTITION BY feature ORDER BY value) AS k, sum(count(*)) OVER (PARTITION BY feature) AS n FROM long WHERE fold <> 0 GROUP BY feature, value), u AS (SELECT l.feature, l.fold, (greatest(1, coalesce(t.k, 0)) - 0.5) / (SELECT max(n) FROM t x WHERE x.feature = l.feature) AS value FROM long l ASOF LEFT JOIN t ON l.feature = t.feature AND l.value >= t.value) SELECT feature, fold, {_SUM} FROM u GROUP BY feature, fold")
def n02_rank_share(spark, sf_dir) -> DataFrame:
    rows = _long(spark, sf_dir).select("feature", "fold", "value")  # rows are kept on the way, so only what is summed up
    u = harmonize.rank_share(rows.where("fold <> 0"), rows)
    return _summary(u.select("feature", "fold", F.col("u").alias("value")), "fold")


@query()
def n02_rank_gauss(spark, sf_dir) -> DataFrame:
    rows = _long(spark, sf_dir).select("feature", "fold", "value")
    return _summary(harmonize.rank_gauss(rows.where("fold <> 0"), rows), "fold")


@query(f"WITH {_LONG}, b AS (SELECT feature, batch, avg(value) AS mu, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END AS sd FROM long WHERE fold <> 0 AND batch <> 'NATION_3' GROUP BY ALL), a AS (SELECT feature, avg(value) AS mu_all, stddev_pop(value) AS sd_all FROM long WHERE fold <> 0 AND batch <> 'NATION_3' GROUP BY ALL), x AS (SELECT l.feature, l.batch, CASE WHEN b.mu IS NULL THEN value ELSE (value - mu) / (sd + 1e-8) * sd_all + mu_all END AS value FROM long l LEFT JOIN b USING (feature, batch) LEFT JOIN a USING (feature)) SELECT feature, batch, {_SUM} FROM x GROUP BY feature, batch")
def n03_mean_variance(spark, sf_dir) -> DataFrame:
    rows = _long(spark, sf_dir)
    fitted = harmonize.mean_variance_fit(rows.where("fold <> 0 AND batch <> 'NATION_3'"), "batch")
    return _summary(harmonize.mean_variance_apply(rows, fitted, "batch"), "batch")


@query()
def n04_combat(spark, sf_dir) -> DataFrame:
    rows = _long(spark, sf_dir)
    fitted = harmonize.combat_fit(rows.where("fold <> 0"), "batch", "segment")
    return _summary(harmonize.combat_apply(rows, fitted, "batch", "segment"), "batch")


@query()
def n04_combat_by_likelihood(spark, sf_dir) -> DataFrame:
    """The non-parametric prior."""
    rows = _long(spark, sf_dir)
    fitted = harmonize.combat_fit(rows.where("fold <> 0"), "batch", "segment", parametric=False)
    return _summary(harmonize.combat_apply(rows, fitted, "batch", "segment"), "batch")


@query(f"WITH {_LONG} SELECT feature, batch, segment, count(value) AS n, {r6('sum(value)', 's')}, {r6('sum(value * value) / count(value)', 'q')} FROM long GROUP BY ALL")
def n04_combat_cells(spark, sf_dir) -> DataFrame:
    """The sums by batch and covariate from which the model is fitted."""
    return _long(spark, sf_dir).groupBy("feature", "batch", "segment").agg(F.count("value").alias("n"), F.sum("value").alias("s"), (F.sum(F.col("value") * F.col("value")) / F.count("value")).alias("q"))


@query()
def n06_pca(spark, sf_dir) -> DataFrame:
    rows = inputs.features(spark, sf_dir, ["gold"])
    _, variance = harmonize.pca_fit(rows, ["case_id", "segment"])
    return variance


@query()
def n06_pca_scores(spark, sf_dir) -> DataFrame:
    """All conditions projected by the loadings of gold; the spread of each component."""
    keys = ["case_id", "segment", "condition"]
    rows = inputs.features(spark, sf_dir)
    gold = rows.where("condition = 'gold'")
    loadings, _ = harmonize.pca_fit(gold, keys[:2])
    scores = harmonize.pca_apply(rows, keys, harmonize.zscore_fit(gold), loadings)
    return scores.groupBy("condition", "feature").agg(F.count(F.lit(1)).alias("n"), F.var_pop("value").alias("variance"))


@query(f"WITH {PLANTED}, m AS (SELECT feature, median(value) AS m FROM planted WHERE CAST(case_id AS BIGINT) % 5 <> 0 AND feature IN ('Deep_2', 'Deep_7') GROUP BY feature), v AS (SELECT case_id, segment, feature, CASE WHEN feature = 'Deep_2' AND segment = 'L1-L2' THEN NULL ELSE value END AS value FROM planted WHERE CAST(case_id AS BIGINT) % 5 = 0 AND feature IN ('Deep_2', 'Deep_7')) SELECT case_id, segment, {r6('max(coalesce(value, m)) FILTER (feature = $$Deep_7$$)', 'Deep_7')}, {r6('max(coalesce(value, m)) FILTER (feature = $$Deep_2$$)', 'Deep_2')} FROM v JOIN m USING (feature) GROUP BY case_id, segment")
def n07_apply_selector(spark, sf_dir) -> DataFrame:
    rows = inputs.planted(spark, sf_dir)
    fold = F.col("case_id").cast("long") % 5
    kept = ["Deep_2", "Deep_7"]
    medians = rows.where((fold != 0) & F.col("feature").isin(kept)).groupBy("feature").agg(F.median("value").alias("median"))
    new = rows.where((fold == 0) & ~((F.col("feature") == "Deep_2") & (F.col("segment") == "L1-L2")))
    return harmonize.apply_selector(new, kept, medians, ["Deep_7", "Deep_2"], ["case_id", "segment"])
