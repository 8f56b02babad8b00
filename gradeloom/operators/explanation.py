"""Summaries of feature contributions: importance, shape curves, cut points, partial dependence."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled
from .ranks import median, percentiles


def with_interactions(contrib: DataFrame, terms: DataFrame) -> DataFrame:
    """(sample_id, feature, contrib): main terms plus the interaction terms that the map (term, feature) gives to a feature."""
    return contrib.withColumnRenamed("feature", "term").join(F.broadcast(terms), "term").groupBy("sample_id", "feature").agg(F.sum("contrib").alias("contrib"))


def importance(contrib: DataFrame) -> DataFrame:
    """(feature, importance, importance_sd, variance, folds, rank): mean absolute and variance of the task-weighted contribution per fold, then over folds."""
    g = F.col("contrib") * F.col("weight")
    by_fold = contrib.groupBy("fold", "feature").agg(F.avg(F.abs(g)).alias("m"), F.var_pop(g).alias("v"))
    t = by_fold.groupBy("feature").agg(F.avg("m").alias("importance"), F.stddev_samp("m").alias("importance_sd"), F.avg("v").alias("variance"), F.count(F.lit(1)).alias("folds"))
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def global_attribution(contrib: DataFrame) -> DataFrame:
    return contrib.groupBy("feature").agg(F.avg(F.abs("contrib")).alias("mean_abs"))


def shape_curve(contrib: DataFrame, keys: list[str], most: int = 200) -> DataFrame:
    """(keys, x, y): mean contribution at each distinct x, thinned to `most` evenly spaced places."""
    each = contrib.groupBy(*keys, "x").agg(F.avg("contrib").alias("y"))
    w = Window.partitionBy(*keys)
    t = each.withColumn("__i", F.row_number().over(w.orderBy("x")) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    # place i is kept if it is the nearest (halves to even) to some k (n-1)/(most-1)
    step = (F.col("__n") - 1) / F.lit(float(most - 1))
    k = F.round(F.col("__i") / step)
    near = lambda j: F.bround(j * step) == F.col("__i")
    kept = (F.col("__n") <= most) | near(k) | near(k - 1) | near(k + 1)
    return t.where(kept).select(*keys, "x", "y")


def shape_band(contrib: DataFrame, most: int = 200) -> DataFrame:
    """(feature, x, mean, sd, folds): the folds' curves interpolated on a common grid, each inside its own range only."""
    curves = shape_curve(contrib, ["feature", "fold"], most)

    def band(frame: pd.DataFrame) -> pd.DataFrame:
        grid = np.unique(frame["x"].to_numpy(float))
        if len(grid) > most:
            grid = grid[np.unique(np.linspace(0, len(grid) - 1, most).round().astype(int))]
        lines = []
        for _, part in frame.sort_values("x").groupby("fold"):
            x, y = part["x"].to_numpy(float), part["y"].to_numpy(float)
            lines.append(np.where((grid < x[0]) | (grid > x[-1]), np.nan, np.interp(grid, x, y)))
        stack = np.stack(lines)
        n = (~np.isnan(stack)).sum(axis=0)
        mean = np.nansum(stack, axis=0) / np.maximum(n, 1)
        sd = np.sqrt(np.nansum((stack - mean) ** 2, axis=0) / np.maximum(n - 1, 1))
        out = pd.DataFrame({"feature": frame["feature"].iloc[0], "x": grid, "mean": mean, "sd": np.where(n > 1, sd, 0.0), "folds": n})
        return out[n > 0]

    kind = dict(contrib.dtypes)["feature"]
    return curves.groupBy("feature").applyInPandas(band, f"feature {kind}, x double, mean double, sd double, folds long")


def quantile_bins(rows: DataFrame, keys: list[str], x: str, y: str, bins: int = 10) -> DataFrame:
    """(keys, bin, x_median, y_mean, n, y_smooth): right-closed bins between distinct quantiles of x; equal widths where these collapse."""
    ok = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    q = percentiles(ok, keys, x, [i / bins for i in range(bins + 1)]).withColumn("q", F.array_distinct("q"))
    distinct = ok.groupBy(*keys, x).agg(F.lit(1).alias("__one"))
    edges = q.join(distinct.groupBy(*keys).agg(F.min(x).alias("low"), F.max(x).alias("high"), F.least(F.lit(bins), F.count(F.lit(1))).cast("int").alias("m")), keys)
    equal = F.transform(F.sequence(F.lit(0), F.col("m")), lambda i: F.col("low") + (F.col("high") - F.col("low")) * i / F.col("m"))
    edges = edges.select(*keys, F.when((F.size("q") > 2) | (F.col("m") <= 1), F.col("q")).otherwise(equal).alias("q"))
    inner = F.when(F.size("q") > 2, F.slice("q", F.lit(2), F.size("q") - 2)).otherwise(F.array().cast("array<double>"))
    joined = ok.join(edges.select(*keys, inner.alias("__q")), keys).withColumn("bin", F.size(F.filter("__q", lambda e: e < F.col(x)))).drop("__q")
    t = joined.groupBy(*keys, "bin").agg(F.avg(y).alias("y_mean"), F.count(F.lit(1)).alias("n")).join(median(joined, [*keys, "bin"], x, "x_median"), [*keys, "bin"])
    t = t.select(*keys, "bin", "x_median", "y_mean", "n")
    w = Window.partitionBy(*keys).orderBy("bin")
    before, after = F.coalesce(F.lag("y_mean").over(w), F.col("y_mean")), F.coalesce(F.lead("y_mean").over(w), F.col("y_mean"))
    smooth = (before + F.col("y_mean") + after) / 3
    return t.withColumn("y_smooth", F.when(F.count(F.lit(1)).over(Window.partitionBy(*keys)) < 3, F.col("y_mean")).otherwise(smooth))


def cut_points(rows: DataFrame, keys: list[str], x: str, g: str, quantiles: list[float], segments: int = 3, lam: float = 1.0) -> DataFrame:
    """(keys, bounds, score, ns, means, vars): candidate quantiles as bounds, maximising 2 sum (mean_a - mean_b)^2 - lam sum var.

    Sums between neighbouring candidates are made in Spark; combinations are tried on these few cells per key.
    """
    distinct = rows.groupBy(*keys, x).agg(F.lit(1).alias("__one")).groupBy(*keys).agg(F.count(x).alias("__d"))
    edges = percentiles(rows, keys, x, list(quantiles), "__q").withColumn("__q", F.array_sort(F.array_distinct("__q"))).join(distinct, keys)
    edges = edges.where(F.col("__d") >= segments)
    cell = F.size(F.filter("__q", lambda e: e < F.col(x)))
    cells = rows.join(edges, keys).groupBy(*keys, "__q", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum(g).alias("s"), F.sum(F.col(g) * F.col(g)).alias("ss"))
    kinds = dict(rows.dtypes)

    def best(key, frame: pd.DataFrame) -> pd.DataFrame:
        q = list(frame["__q"].iloc[0])
        n, s, ss = (np.zeros(len(q) + 1) for _ in range(3))
        at = frame["cell"].to_numpy()
        n[at], s[at], ss[at] = frame["n"], frame["s"], frame["ss"]
        n, s, ss = (np.concatenate(([0.0], np.cumsum(v))) for v in (n, s, ss))
        top = None
        for chosen in itertools.combinations(range(len(q)), segments - 1):
            ends = [0, *[c + 1 for c in chosen], len(q) + 1]
            k = np.diff(n[ends])
            if (k <= 0).any():
                continue
            mean = np.diff(s[ends]) / k
            var = np.maximum(np.diff(ss[ends]) / k - mean**2, 0)
            score = 2 * sum((a - b) ** 2 for a, b in itertools.combinations(mean, 2)) - lam * var.sum()
            if top is None or score > top[1]:
                top = ([float(q[c]) for c in chosen], float(score), [int(v) for v in k], [float(v) for v in mean], [float(v) for v in var])
        return pd.DataFrame([(*key, *top)] if top else [], columns=[*keys, "bounds", "score", "ns", "means", "vars"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", bounds array<double>, score double, ns array<long>, means array<double>, vars array<double>"
    return cells.groupBy(*keys).applyInPandas(best, schema)


def partial_dependence(rows: DataFrame, feature: int, weights: list[float], intercept: float, by: str, most: int = 200) -> DataFrame:
    """(by, x, effect): the linear prediction with one feature over its distinct (or `most` quantile) values and the others at their medians, less that with all at the medians.

    rows: by, x array. Medians and quantiles come from counts of distinct values in ranges; null values do not count.
    """
    value = F.col("x")[feature].cast("double")
    each = rows.select(by, F.posexplode("x").alias("i", "v"))
    medians = median(each, [by, "i"], "v").groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "median"))), lambda c: c["median"]).alias("m"))
    varied = settled(rows.select(by, value.alias("v")).where(F.col("v").isNotNull()))
    seen = varied.distinct()
    few = seen.groupBy(by).agg(F.count(F.lit(1)).alias("d")).where(F.col("d") <= most).select(by)  # these have `most` values at most
    listed = seen.join(few, by, "left_semi").select(by, F.col("v").alias("x"))
    many = percentiles(varied.join(few, by, "left_anti"), [by], "v", [i / (most - 1) for i in range(most)])
    grid = listed.union(many.select(by, F.explode(F.array_distinct("q")).alias("x"))).join(medians, by)
    predict = lambda at: sum((F.col("m")[i] * float(w) for i, w in enumerate(weights) if i != feature), F.lit(float(intercept))) + at * float(weights[feature])
    return grid.select(by, "x", (predict(F.col("x")) - predict(F.col("m")[feature])).alias("effect"))


def monotone_steps(curve: DataFrame, keys: list[str], direction: Column | int = 1, weight: Column | float = 1.0) -> DataFrame:
    """(keys, raw_rate, weighted_rate, net): share of steps of a curve (x, y) against the direction, unweighted and times the weight, and the signed net change."""
    w = Window.partitionBy(*keys).orderBy("x")
    d = direction if isinstance(direction, Column) else F.lit(direction)
    v = weight if isinstance(weight, Column) else F.lit(float(weight))
    t = curve.withColumn("__step", F.col("y") - F.lag("y").over(w)).withColumns({"__d": d, "__w": v})
    against = lambda c: F.coalesce(F.avg(F.when(F.col("__step").isNotNull(), (c < 0).cast("double"))), F.lit(0.0))
    return t.groupBy(*keys).agg(
        against(F.col("__d") * F.col("__step")).alias("raw_rate"),
        against(F.col("__d") * F.col("__w") * F.col("__step")).alias("weighted_rate"),
        (F.first("__d") * (F.max_by("y", "x") - F.min_by("y", "x"))).alias("net"),
    )
