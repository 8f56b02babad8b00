"""Standardisation and batch harmonisation of long tables (…, feature, value), fitted on training rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import norm_ppf
from . import gram, ranks
from .lineage import settled
from .ranks import attached, running_counts


def zscore_fit(long: DataFrame) -> DataFrame:
    """(feature, mean, sd) with the population deviation; 1 instead of 0."""
    m = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return m.withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))


def zscore_apply(long: DataFrame, fitted: DataFrame) -> DataFrame:
    fitted = F.broadcast(fitted)  # a row a feature
    return long.join(fitted, "feature").withColumn("value", (F.col("value") - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def _shares(train: DataFrame, rows: DataFrame) -> DataFrame:
    """(feature, value, c, r, u) for the distinct values of both: how often training and the rows have it, and its rank share."""
    none = F.lit(0).cast("long")
    some = lambda df, c, r: df.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(c.alias("c"), r.alias("r"))
    each = some(train, F.count(F.lit(1)), none).unionByName(some(rows, none, F.count(F.lit(1))))
    cells = each.groupBy("feature", "value").agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    total = train.groupBy("feature").agg(F.count("value").alias("n")).where("n > 0")
    run = running_counts(cells, ["feature"], "value", "c").join(total, "feature")
    return run.select("feature", "value", "c", "r", ((F.greatest(F.lit(1), F.col("before") + F.col("c")) - 0.5) / F.col("n")).alias("u"))


def rank_share(train: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with `u`: (number of training values <= x, at least 1, less a half) over their number, per feature.

    Only distinct values with counts are ranked, in ranges; rows meet them in a broadcast of up to ranks.WHOLE values; of more, in a join
    by value, and only frequent values (of a feature that mostly is 0) in a broadcast. Rows of features that training lacks go.
    """
    rows = settled(rows)
    return _with_shares(rows, settled(_shares(train, rows)), F.col("u"), "u")


def _with_shares(rows: DataFrame, table: DataFrame, what: Column, name: str) -> DataFrame:
    known = table.select("feature").distinct()
    found = attached(rows.where(F.col("value").isNotNull()), table.select("feature", "value", "r", what.alias(name)).where("r > 0"), ["feature", "value"], "r", ranks.WHOLE)
    lost = rows.where(F.col("value").isNull()).join(known, "feature", "left_semi").withColumn(name, F.lit(None).cast("double"))
    return found.select(*rows.columns, name).unionByName(lost)


def normal_quantile(u: Column) -> Column:
    @F.pandas_udf("double")
    def quantile(u: pd.Series) -> pd.Series:
        return pd.Series(norm_ppf(u.to_numpy(dtype=float)), index=u.index)

    return quantile(u)


def rank_gauss(train: DataFrame, rows: DataFrame, gauss: bool = True) -> DataFrame:
    """Values as normal quantiles of their rank share (or the share itself), then standardised by the training rows' mean and deviation.

    Both follow from the table of distinct values, so the rows are joined once.
    """
    rows = settled(rows)
    table = settled(_shares(train, rows)).withColumn("g", normal_quantile(F.col("u")) if gauss else F.col("u"))
    c, g = F.col("c"), F.col("g")
    moments = table.groupBy("feature").agg((F.sum(c * g) / F.sum(c)).alias("mean"), (F.sum(c * g * g) / F.sum(c)).alias("square"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean")))
    fitted = moments.select("feature", "mean", F.when(sd > 1e-12, sd).otherwise(1.0).alias("sd"))
    shared = table.join(fitted, "feature").select("feature", "value", "r", ((g - F.col("mean")) / F.col("sd")).alias("g"))
    return _with_shares(rows, shared, F.col("g"), "g").drop("value").withColumnRenamed("g", "value")


def mean_variance_fit(long: DataFrame, batch: str) -> DataFrame:
    """(feature, batch, mu, sd, mu_all, sd_all); a deviation of 0 is 1."""
    one = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1.0)
    by = long.groupBy("feature", batch).agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd")).withColumn("sd", one("sd"))
    every = long.groupBy("feature").agg(F.avg("value").alias("mu_all"), F.stddev_pop("value").alias("sd_all")).withColumn("sd_all", one("sd_all"))
    return by.join(every, "feature")


def mean_variance_apply(long: DataFrame, fitted: DataFrame, batch: str, eps: float = 1e-8) -> DataFrame:
    """(x - mu_b) / (sd_b + eps) * sd + mu; rows of a batch that was not fitted stay."""
    moved = (F.col("value") - F.col("mu")) / (F.col("sd") + eps) * F.col("sd_all") + F.col("mu_all")
    return long.join(fitted, ["feature", batch], "left").withColumn("value", F.when(F.col("mu").isNull(), F.col("value")).otherwise(moved)).drop("mu", "sd", "mu_all", "sd_all")


def combat_fit(long: DataFrame, batch: str, covariate: str, *, parametric: bool = True, mean_only: bool = False, ref_batch: str | None = None, least: int = 2, rounds: int = 200) -> DataFrame:
    """(feature, batch, covariate, stand, scale, gamma, delta): location and scale of each batch beside a discrete covariate.

    The design is categorical, so counts and sums by (batch, covariate) are all that a feature's least-squares fit needs; each feature's
    few cells are solved in one group. gamma and delta are shrunk by empirical Bayes over the features of a batch, by the parametric prior
    or by the likelihoods of the other features' values (`parametric=False`). Batches with fewer than `least` rows per feature are left
    out. With `ref_batch` the others move to it. The table, of a size that does not follow the rows, is kept for what is done with it.
    """
    cells = long.groupBy("feature", batch, covariate).agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    sizes = cells.groupBy("feature", batch).agg(F.sum("n").alias("b_n"))
    cells = cells.join(sizes.where(F.col("b_n") >= least), ["feature", batch])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        b, batches = pd.factorize(frame[batch].astype(str), sort=True)
        c, levels = pd.factorize(frame[covariate].astype(str), sort=True)
        n, s, q = (frame[x].to_numpy(float) for x in ("n", "s", "q"))
        design = np.zeros((len(frame), len(batches) + len(levels) - 1))
        design[np.arange(len(frame)), b] = 1
        rest = c > 0
        design[np.flatnonzero(rest), len(batches) + c[rest] - 1] = 1
        beta = np.linalg.lstsq(design.T @ (design * n[:, None]), design.T @ s, rcond=None)[0]
        by_batch = np.bincount(b, weights=n)
        names = list(batches)
        grand = beta[names.index(str(ref_batch))] if ref_batch is not None else float((by_batch * beta[: len(batches)]).sum() / by_batch.sum())
        fitted = design @ beta
        error = q - 2 * fitted * s + n * fitted**2
        pool = (b == names.index(str(ref_batch))) if ref_batch is not None else np.ones(len(frame), bool)
        scale = max(float(error[pool].sum() / n[pool].sum()), 1e-12) ** 0.5
        stand = grand + design[:, len(batches) :] @ beta[len(batches) :]
        total = np.bincount(b, weights=(s - n * stand) / scale)
        square = np.bincount(b, weights=(q - 2 * stand * s + n * stand**2) / scale**2)
        gamma = total / by_batch
        delta = np.maximum((square - by_batch * gamma**2) / np.maximum(by_batch - 1, 1), 1e-12)
        return pd.DataFrame(
            {"feature": frame["feature"], batch: frame[batch], covariate: frame[covariate], "stand": stand, "scale": scale, "gamma_hat": gamma[b], "delta_hat": delta[b], "b_n": by_batch[b].astype(np.int64)}
        )

    kinds = dict(long.dtypes)
    schema = f"feature string, {batch} {kinds[batch]}, {covariate} {kinds[covariate]}, stand double, scale double, gamma_hat double, delta_hat double, b_n long"
    hats = cells.groupBy("feature").applyInPandas(fit, schema)
    per = hats.groupBy("feature", batch).agg(F.first("gamma_hat").alias("g"), F.first("delta_hat").alias("d"))
    prior = per.groupBy(batch).agg(F.avg("g").alias("g_bar"), F.coalesce(F.var_samp("g"), F.lit(0.0)).alias("t2"), F.avg("d").alias("m"), F.coalesce(F.var_samp("d"), F.lit(0.0)).alias("s2"))
    joined = hats.join(prior, batch)

    @F.pandas_udf("gamma double, delta double")
    def shrink(g_hat: pd.Series, d_hat: pd.Series, n: pd.Series, g_bar: pd.Series, t2: pd.Series, m: pd.Series, s2: pd.Series) -> pd.DataFrame:
        """Alternate the posterior means; sums of squares about a new mean follow from the sample variance."""
        gh, dh, n, gb, t2, m, s2 = (x.to_numpy(dtype=float) for x in (g_hat, d_hat, n, g_bar, t2, m, s2))
        if mean_only:
            return pd.DataFrame({"gamma": np.where(t2 > 0, (t2 * n * gh + gb) / (t2 * n + 1), gh), "delta": 1.0})
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = (2 * s2 + m**2) / s2, (m * s2 + m**3) / s2
            g, d = gh.copy(), dh.copy()
            for _ in range(rounds):
                g_new = np.where(t2 > 0, (t2 * n * gh + d * gb) / (t2 * n + d), gh)
                d_new = np.where(s2 > 0, (b + 0.5 * ((n - 1) * dh + n * (gh - g_new) ** 2)) / (n / 2 + a - 1), dh)
                moved = max(np.abs(g_new - g).max(initial=0), np.abs(d_new - d).max(initial=0))
                g, d = g_new, d_new
                if moved < 1e-10:
                    break
        return pd.DataFrame({"gamma": g, "delta": d})

    if parametric:
        eb = joined.withColumn("eb", shrink("gamma_hat", "delta_hat", "b_n", "g_bar", "t2", "m", "s2"))
    else:
        by_batch = hats.groupBy("feature", batch).agg(F.first("gamma_hat").alias("g"), F.first("delta_hat").alias("d"), F.first("b_n").alias("n"))
        found = by_batch.groupBy(batch).applyInPandas(lambda frame: _by_likelihood(frame, batch, mean_only), f"feature string, {batch} {kinds[batch]}, gamma double, delta double")
        eb = hats.join(found, ["feature", batch]).withColumn("eb", F.struct("gamma", "delta"))
    kept = (F.col(batch).cast("string") == F.lit(str(ref_batch))) if ref_batch is not None else F.lit(False)
    return settled(eb.select("feature", batch, covariate, "stand", "scale", F.when(kept, 0.0).otherwise(F.col("eb.gamma")).alias("gamma"), F.when(kept, 1.0).otherwise(F.col("eb.delta")).alias("delta")))


def _by_likelihood(frame: pd.DataFrame, batch: str, mean_only: bool, rows: int = 256) -> pd.DataFrame:
    """A batch's gamma and delta of each feature: the other features' estimates, weighted by the likelihood that they give the feature's
    rows. Counts, means and variances are enough for it; some features at a time meet all."""
    g, d, n = (frame[c].to_numpy(float) for c in ("g", "d", "n"))
    spread = np.ones_like(d) if mean_only else d
    gamma, delta = g.copy(), spread.copy()
    for i in range(0, len(g) if len(g) > 1 else 0, rows):
        some = slice(i, i + rows)
        square = ((n - 1) * d)[some, None] + n[some, None] * (g[some, None] - g[None, :]) ** 2
        log = -0.5 * n[some, None] * np.log(2 * np.pi * spread[None, :]) - square / (2 * spread[None, :])
        log[np.arange(len(log)), np.arange(i, i + len(log))] = -np.inf
        w = np.exp(log - log.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        gamma[some] = w @ g
        delta[some] = 1.0 if mean_only else w @ d
    return pd.DataFrame({"feature": frame["feature"], batch: frame[batch], "gamma": gamma, "delta": delta})


def combat_apply(long: DataFrame, fitted: DataFrame, batch: str, covariate: str) -> DataFrame:
    """Adjusted values. Rows of a batch that was not fitted stay; a covariate level that was not fitted is a ValueError."""
    levels = fitted.select(covariate).distinct()
    new = long.join(levels, covariate, "left_anti").limit(1).collect()
    if new:
        raise ValueError(f"{covariate} {new[0][covariate]!r} was not fitted")
    # the standing mean of a level holds in every batch, so a cell that training lacks still has one
    stand = fitted.groupBy("feature", covariate).agg(F.first("stand").alias("stand"))
    by_batch = fitted.groupBy("feature", batch).agg(F.first("scale").alias("scale"), F.first("gamma").alias("gamma"), F.first("delta").alias("delta"))
    joined = long.join(by_batch, ["feature", batch], "left").join(stand, ["feature", covariate], "left")
    moved = (((F.col("value") - F.col("stand")) / F.col("scale")) - F.col("gamma")) / F.sqrt("delta") * F.col("scale") + F.col("stand")
    return joined.withColumn("value", F.when(F.col("gamma").isNull(), F.col("value")).otherwise(moved)).drop("stand", "scale", "gamma", "delta")


def feature_vectors(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x): values in the order of the features' names."""
    return long.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "value"))), lambda v: v["value"]).alias("x"))


def pca_fit(long: DataFrame, keys: list[str], eta: float = 0.95, most: int = 50):
    """Loadings of the fewest components with a share `eta` of the variance (1 to `most`), on standardised values.

    Returns (loadings: feature, component, weight; variance: component, share, cumulative). The Gram matrix is summed by tiles, and of many
    features it never is in one place (`gram.leading`); a component's largest weight is positive.
    """
    spark = long.sparkSession
    names = sorted(r["feature"] for r in long.select("feature").distinct().collect())
    if not names:
        return spark.createDataFrame([], "feature string, component int, weight double"), spark.createDataFrame([], "component int, share double, cumulative double")
    vectors = feature_vectors(zscore_apply(long, zscore_fit(long)), keys)
    matrix = gram.gram(vectors, len(names))
    values, basis = gram.leading(matrix, len(names), most)
    total = gram.trace(matrix, len(names))
    share = np.clip(values, 0, None) / total if total > 0 else np.zeros(len(values))
    k = int(min(max(1, np.searchsorted(np.cumsum(share), eta - 1e-12) + 1), len(values)))
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    loadings = spark.createDataFrame([(f, c, float(basis[i, c])) for i, f in enumerate(names) for c in range(k)], "feature string, component int, weight double")
    variance = spark.createDataFrame([(c, float(share[c]), float(share[: c + 1].sum())) for c in range(k)], "component int, share double, cumulative double")
    return loadings, variance


def pca_apply(long: DataFrame, keys: list[str], fitted: DataFrame, loadings: DataFrame, prefix: str = "PC") -> DataFrame:
    """(keys, feature = prefix_component, value): standardised by `fitted`, then projected.

    A value meets its feature's weights of all components at once and adds to a sum of each, so only a sample's sums become a row a component.
    """
    found = {r["component"]: r["n"] for r in loadings.groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = loadings.groupBy("feature").pivot("component", sorted(found)).agg(F.sum("weight"))
    p = weights.count()
    z = zscore_apply(long.select(*keys, "feature", "value"), fitted).join(F.broadcast(weights), "feature")
    # a component that lacks features is one that a sample may lack
    part = lambda c, n: F.struct(F.lit(f"{prefix}_{c}").alias("feature"), F.sum(F.col("value") * F.col(f"`{c}`")).alias("value"), (F.lit(True) if n == p else F.count(f"`{c}`") > 0).alias("there"))
    sums = z.groupBy(*keys).agg(F.array(*[part(c, n) for c, n in sorted(found.items())]).alias("sums"))
    return sums.select(*keys, F.inline("sums")).where("there").drop("there")


def apply_selector(long: DataFrame, kept: list[str], medians: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """Wide rows of new samples for a fitted selection: kept features, stored medians where values are missing, columns in the stored order."""
    names = long.sparkSession.createDataFrame([(f,) for f in kept], "feature string")
    grid = long.select(*keys).distinct().select("*", F.explode(F.lit(kept)).alias("feature"))
    filled = grid.join(long.select(*keys, "feature", "value").join(names, "feature", "left_semi"), [*keys, "feature"], "left").join(medians, "feature", "left")
    return filled.withColumn("value", F.coalesce("value", "median")).groupBy(*keys).pivot("feature", order).agg(F.first("value"))


