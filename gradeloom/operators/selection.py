"""Feature selection statistics over a long table (case_id, segment, condition, feature, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import pool_adjacent, t_two_sided
from . import gram
from .lineage import settled
from .metrics import weighted_correlation
from .ranks import average_rank, median, with_rank

SAMPLE = ["case_id", "segment"]


def icc21(long: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(feature, n, k, icc, keep): two-way random, single-measure ICC of an aligned table; undefined: null, and not kept.

    Values are centred on their feature's mean first, so large offsets cost no digits.
    """
    means = F.broadcast(long.groupBy("feature").agg(F.avg("value").alias("__mean")))  # a row a feature
    centred = long.join(means, "feature").withColumn("v", F.col("value") - F.col("__mean"))
    rows = centred.groupBy("feature", *SAMPLE).agg(F.avg("v").alias("m"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    by_row = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("m") * F.col("m")).alias("rr"), F.sum("ss").alias("total"))
    by_col = centred.groupBy("feature", "condition").agg(F.avg("v").alias("m")).groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("m") * F.col("m")).alias("cc"))
    n, k = F.col("n"), F.col("k")
    t = by_row.join(by_col, "feature")
    t = t.withColumns({"s": k * F.col("rr"), "r": n * F.col("cc")})
    t = t.withColumns(
        {
            "ms_s": F.try_divide(F.col("s"), n - 1),
            "ms_r": F.try_divide(F.col("r"), k - 1),
            "ms_e": F.try_divide(F.greatest(F.lit(0.0), F.col("total") - F.col("s") - F.col("r")), (n - 1) * (k - 1)),
        }
    )
    icc = F.try_divide(F.col("ms_s") - F.col("ms_e"), F.col("ms_s") + (k - 1) * F.col("ms_e") + k * (F.col("ms_r") - F.col("ms_e")) / n)
    icc = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(~F.isnan(icc), icc)))
    icc = F.when(F.try_divide(F.col("ms_s"), F.col("ms_s") + F.col("ms_e")).isNotNull() | (F.col("ms_r") != 0), icc)
    return t.select("feature", "n", "k", icc.alias("icc"), F.coalesce(icc >= threshold, F.lit(False)).alias("keep"))


def p_value(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation by Student's t with n-2 degrees of freedom; null where undefined."""

    @F.pandas_udf("double")
    def tail(rho: pd.Series, n: pd.Series) -> pd.Series:
        r, dof = rho.to_numpy(dtype=float), n.to_numpy(dtype=float) - 2
        with np.errstate(divide="ignore", invalid="ignore"):
            t = r * np.sqrt(dof / np.maximum(1 - r * r, 0))
        p = pd.Series(t_two_sided(t, dof), index=rho.index)
        return p.where(p.notna(), None)

    return F.nanvl(tail(rho, n), F.lit(None).cast("double"))


def spearman_with(long: DataFrame, grade: str = "pfirrmann") -> DataFrame:
    """(feature, n, rho): rank correlation of every feature with the grade; null if either is constant.

    Ranks are made on counts of distinct values, so a feature with many equal values is a short list.
    """
    pairs = long.where(F.col("value").isNotNull() & F.col(grade).isNotNull()).groupBy("feature", "value", grade).agg(F.count(F.lit(1)).alias("n"))
    pairs = settled(pairs)
    ranked = pairs.join(average_rank(pairs, ["feature"], "value").withColumnRenamed("rank", "rank_x"), ["feature", "value"]).join(
        F.broadcast(average_rank(pairs, ["feature"], grade, few=True).withColumnRenamed("rank", "rank_y")), ["feature", grade]
    )
    spread = pairs.groupBy("feature").agg(F.sum("n").alias("n"), F.count_distinct("value").alias("vx"), F.count_distinct(grade).alias("vy"))
    rho = weighted_correlation(ranked, ["feature"], "rank_x", "rank_y", "n", "rho").join(spread, "feature")
    return rho.select("feature", "n", F.when((F.col("vx") > 1) & (F.col("vy") > 1), F.col("rho")).alias("rho"))


def benjamini_hochberg(rows: DataFrame, p: str = "p", q: str = "q") -> DataFrame:
    """Rows with their q-value over all rows with a p; null p gives null q. Rows are features, so one window holds them."""
    some = rows.where(F.col(p).isNotNull())
    counted = some.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy())).withColumn("__rank", F.row_number().over(Window.orderBy(p, "feature")))
    raw = F.col(p) * F.col("__n") / F.col("__rank")
    least = F.min(raw).over(Window.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0))
    done = counted.withColumn(q, F.least(F.lit(1.0), F.greatest(F.lit(0.0), least))).drop("__n", "__rank")
    return done.unionByName(rows.where(F.col(p).isNull()).withColumn(q, F.lit(None).cast("double")))


def relevant(tests: DataFrame, icc: DataFrame, alpha: float = 0.05, least_rho: float = 0.1) -> DataFrame:
    """Features with q < alpha, |rho| >= least_rho that the ICC keeps too, with the score |rho| * ICC."""
    strong = tests.where((F.col("q") < alpha) & (F.abs("rho") >= least_rho))
    return strong.join(icc.where("keep").select("feature", "icc"), "feature").withColumn("score", F.abs("rho") * F.col("icc"))


def rank_vectors(long: DataFrame) -> DataFrame:
    """(case_id, segment, r): average ranks of all features, in the order of their names, centred and scaled to unit length per feature."""
    joined = settled(with_rank(long.select(*SAMPLE, "feature", "value"), ["feature"], "value"))
    m = joined.groupBy("feature").agg(F.avg("rank").alias("m"), F.stddev_pop("rank").alias("s"), F.count(F.lit(1)).alias("c"))
    z = joined.join(F.broadcast(m), "feature").select(*SAMPLE, "feature", F.coalesce(F.try_divide(F.col("rank") - F.col("m"), F.col("s") * F.sqrt("c")), F.lit(0.0)).alias("z"))
    return z.groupBy(*SAMPLE).agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "z"))), lambda x: x["z"]).alias("r"))


def pairwise_spearman(long: DataFrame) -> DataFrame:
    """(feature1, feature2, rho) for feature1 < feature2 of an aligned table: a Gram matrix of rank vectors, summed by tiles."""
    names = sorted(r["feature"] for r in long.select("feature").distinct().collect())
    if not names:
        return long.sparkSession.createDataFrame([], "feature1 string, feature2 string, rho double")
    cells = gram.cells(gram.gram(rank_vectors(long), len(names), "r"), len(names))
    at = F.lit(names)
    return cells.select(at[F.col("i")].alias("feature1"), at[F.col("j")].alias("feature2"), F.col("x").alias("rho"))


def redundancy(long: DataFrame, threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(pairs over the threshold: feature1, feature2, rho; extremes of all features: feature, max_abs_rho, n_over), of an aligned table.

    Both are read off the tiles of the rank vectors' Gram matrix, so of features squared cells only those over the threshold become rows.
    """
    names = sorted(r["feature"] for r in long.select("feature").distinct().collect())
    spark = long.sparkSession
    if not names:
        return spark.createDataFrame([], "feature1 string, feature2 string, rho double"), spark.createDataFrame([], "feature string, max_abs_rho double, n_over long")
    matrix, at = gram.gram(rank_vectors(long), len(names), "r"), F.lit(names)
    near = gram.over(matrix, len(names), threshold).select(at[F.col("i")].alias("feature1"), at[F.col("j")].alias("feature2"), F.col("x").alias("rho"))
    return near, gram.extremes(matrix, len(names), threshold).select(at[F.col("i")].alias("feature"), F.col("most").alias("max_abs_rho"), F.col("n").alias("n_over"))


def deduplicate(pairs: DataFrame, scores: DataFrame, threshold: float = 0.95, extremes: DataFrame | None = None) -> DataFrame:
    """Audit of greedy removal: (feature, kept, removed_by, removed_rho, removed_order, max_abs_rho, n_over).

    Pairs over the threshold are taken from the strongest on (ties by names); the lower score goes, of equal scores the later name.
    Only these pairs reach the driver; they are fewer than features squared, however many samples there are. `pairs` are all pairs, or those
    over the threshold if `extremes` (of `redundancy`) says what the others amount to.
    """
    spark = pairs.sparkSession
    over = pairs.where(F.abs("rho") > threshold)
    # sums of another order differ in their last digits, which must not decide
    listed = over.select("feature1", "feature2", "rho").orderBy(F.desc(F.round(F.abs("rho"), 9)), "feature1", "feature2").collect()
    score = {r["feature"]: (float("-inf") if r["score"] is None else round(r["score"], 9)) for r in scores.select("feature", "score").collect()}
    gone: dict[str, tuple[str, float, int]] = {}
    for a, b, rho in listed:
        if a in gone or b in gone:
            continue
        sa, sb = score.get(a, float("-inf")), score.get(b, float("-inf"))
        loser, winner = (a, b) if sa < sb else (b, a) if sb < sa else (max(a, b), min(a, b))
        gone[loser] = (winner, rho, len(gone) + 1)
    removed = spark.createDataFrame([(f, *x) for f, x in gone.items()], "feature string, removed_by string, removed_rho double, removed_order int")
    both = pairs.select(F.col("feature1").alias("feature"), "rho").union(pairs.select(F.col("feature2").alias("feature"), "rho"))
    most = extremes if extremes is not None else both.groupBy("feature").agg(F.max(F.abs("rho")).alias("max_abs_rho"), F.count_if(F.abs("rho") > threshold).alias("n_over"))
    audit = scores.select("feature", "score").join(most, "feature", "left").join(removed, "feature", "left")
    return audit.select("feature", "score", F.col("removed_by").isNull().alias("kept"), "removed_by", "removed_rho", "removed_order", F.coalesce("max_abs_rho", F.lit(0.0)).alias("max_abs_rho"), F.coalesce("n_over", F.lit(0)).alias("n_over"))


def top_features(scores: DataFrame, n: int = 80) -> DataFrame:
    return scores.orderBy(F.desc_nulls_last("score"), "feature").limit(n)


def monotonicity(long: DataFrame, signs: DataFrame, tau: float = 0.1, grade: str = "pfirrmann") -> DataFrame:
    """(feature, delta, keep): how far the medians by grade are from monotone, as a share of their weighted spread.

    signs: (feature, rho); medians are fitted by a non-decreasing (or, for negative rho, non-increasing) sequence weighted by counts.
    """
    counts = long.groupBy("feature", grade).agg(F.count("value").alias("n"))
    cells = counts.join(median(long, ["feature", grade], "value"), ["feature", grade])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(grade)
        v, w = frame["median"].to_numpy(float), frame["n"].to_numpy(float)
        sign = -1.0 if frame["rho"].iloc[0] < 0 else 1.0
        fitted = sign * pool_adjacent(sign * v, w)
        spread = float((w * (v - np.average(v, weights=w)) ** 2).sum())
        delta = float((w * (v - fitted) ** 2).sum()) / spread if spread > 0 else 0.0
        return pd.DataFrame({"feature": [frame["feature"].iloc[0]], "delta": [delta], "keep": [delta <= tau]})

    return cells.join(signs.select("feature", "rho"), "feature").groupBy("feature").applyInPandas(fit, "feature string, delta double, keep boolean")


def retained_curve(icc: DataFrame, steps: int = 100) -> DataFrame:
    """(threshold, n): features with ICC >= 0, 0.01, ..., 1, from counts by bucket."""
    bucket = F.least(F.lit(steps), F.floor(F.col("icc") * steps + 1e-9)).cast("int")
    cells = icc.where(F.col("icc") >= 0).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    grid = icc.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("b"))
    over = F.sum(F.coalesce("c", F.lit(0))).over(Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(cells, "b", "left").select((F.col("b") / steps).alias("threshold"), over.cast("long").alias("n"))


def histogram(rows: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """(keys, bin, n, density): equal-width bins between each group's extremes; the largest value is in the last bin; density is n over the group's fullest bin."""
    ends = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    width = (F.col("__high") - F.col("__low")) / bins
    b = F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(value) - F.col("__low"), width))), F.lit(0)).cast("int")
    cells = rows.where(F.col(value).isNotNull()).join(ends, keys).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("density", F.col("n") / F.max("n").over(Window.partitionBy(*keys)))


def final_features(ranked: DataFrame, most: int, forced: list[str]) -> DataFrame:
    """(feature, position): the best `most` by rank, then forced features that are not among them, in their order."""
    spark = ranked.sparkSession
    best = ranked.where(F.col("rank") <= most).select("feature", F.col("rank").cast("int").alias("position"))
    more = spark.createDataFrame([(f, i) for i, f in enumerate(forced)], "feature string, i int").join(best, "feature", "left_anti")
    more = more.select("feature", (F.lit(most) + F.row_number().over(Window.orderBy("i"))).cast("int").alias("position"))
    return best.unionByName(more)


def model_input(long: DataFrame, features: list[str]) -> DataFrame:
    """One row per sample, a column per feature, in the given order."""
    return long.where(F.col("feature").isin(features)).groupBy(*SAMPLE).pivot("feature", features).agg(F.first("value"))


def audit(features: DataFrame, icc: DataFrame, tests: DataFrame, dedup: DataFrame, stability: DataFrame | None = None) -> DataFrame:
    """Every statistic and flag of every feature; a flag is null where a step did not see the feature."""
    out = features.join(icc.select("feature", "icc", F.col("keep").alias("pass_icc")), "feature", "left")
    out = out.join(tests.select("feature", "rho", "p", "q"), "feature", "left")
    out = out.join(dedup.select("feature", F.col("kept").alias("pass_dedup"), "removed_by"), "feature", "left")
    if stability is not None:
        out = out.join(stability.select("feature", "pi", "mean_abs_beta"), "feature", "left")
    return out
