"""Ordinal metrics from predictions (y_true, y_pred, y_cont), by any grouping keys.

Count metrics come from a confusion table, which is small whatever the number of rows; rank and moment metrics from
one aggregation over distinct (y_true, y_cont) values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled
from .ranks import average_rank

COUNT_METRICS = ["mae", "acc", "acc_pm1", "bacc", "macro_f1", "weighted_f1", "kappa_quadratic"]


def confusion(rows: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """(keys, y_true, y_pred, n) for all classes x classes, zeros included; rows with a class outside 1..K or null are left out."""
    inside = F.col("y_true").between(1, classes) & F.col("y_pred").between(1, classes)
    seen = rows.where(inside).groupBy(*keys, F.col("y_true").cast("int").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    return _filled(seen, keys, classes)


def _filled(seen: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """The dense table, made in one aggregation: a map of the cells seen, then all cells."""
    cell = (F.col("y_true") - 1) * classes + F.col("y_pred")
    grid = F.explode(F.sequence(F.lit(1), F.lit(classes * classes))).alias("cell")
    one = seen.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(cell.cast("int").alias("k"), F.col("n").alias("v")))).alias("cells"))
    return one.select(*keys, "cells", grid).select(
        *keys,
        (F.floor((F.col("cell") - 1) / classes) + 1).cast("int").alias("y_true"),
        (F.pmod(F.col("cell") - 1, F.lit(classes)) + 1).cast("int").alias("y_pred"),
        F.coalesce(F.element_at("cells", F.col("cell")), F.lit(0)).alias("n"),
    )


def normalized(table: DataFrame, keys: list[str]) -> DataFrame:
    """A confusion table with each row's share of its true class; 0 for an absent class."""
    total = F.sum("n").over(Window.partitionBy(*keys, "y_true"))
    return table.withColumn("share", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)))


def _marginals(rows: DataFrame, keys: list[str], classes: int, n=None) -> DataFrame:
    """One row per group: counts by true class (t), predicted class (p) and both (d), and sums over distances. A single aggregation, combined before its shuffle."""
    w = F.lit(1) if n is None else n
    t, p = F.col("y_true"), F.col("y_pred")
    gap = F.abs(t - p)
    count = lambda where: F.sum(F.when(where, w).otherwise(0)).cast("double")
    by_class = [count(c == k).alias(f"{name}{k}") for name, c in (("t", t), ("p", p)) for k in range(1, classes + 1)] + [count((t == k) & (p == k)).alias(f"d{k}") for k in range(1, classes + 1)]
    return rows.where(t.between(1, classes) & p.between(1, classes)).groupBy(*keys).agg(*by_class, F.sum(w).alias("n"), F.sum(w * gap).alias("gap"), count(gap <= 1).alias("near"), F.sum(w * gap * gap).alias("seen"))


def _of_marginals(table: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """MAE, accuracies, F1 scores and quadratic kappa.

    A class that is absent from truth counts as recall 0, and one absent from both as F1 0. Kappa is 0 if truth or prediction has one class.
    """
    ks, c = range(1, classes + 1), F.col
    total = lambda terms: sum(terms, F.lit(0.0))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f1 = {i: share(2 * c(f"d{i}"), c(f"t{i}") + c(f"p{i}")) for i in ks}
    chance = total(c(f"t{i}") * c(f"p{j}") * (i - j) ** 2 for i in ks for j in ks if i != j)
    several = lambda side: total((c(f"{side}{i}") > 0).cast("int") for i in ks) > 1
    kappa = F.when(several("t") & several("p"), 1 - F.try_divide(c("seen") * c("n"), chance)).otherwise(0.0)
    return table.where(c("n") > 0).select(
        *keys,
        c("n").cast("long").alias("n"),
        (c("gap") / c("n")).alias("mae"),
        (total(c(f"d{i}") for i in ks) / c("n")).alias("acc"),
        (c("near") / c("n")).alias("acc_pm1"),
        (total(share(c(f"d{i}"), c(f"t{i}")) for i in ks) / classes).alias("bacc"),
        (total(f1.values()) / classes).alias("macro_f1"),
        (total(f1[i] * c(f"t{i}") for i in ks) / c("n")).alias("weighted_f1"),
        F.coalesce(kappa, F.lit(0.0)).alias("kappa_quadratic"),
    )


def count_metrics(rows: DataFrame, keys: list[str], classes: int, n: str | None = None) -> DataFrame:
    """The metrics that follow from the confusion table of each group; `n` may name a column of counts."""
    return _of_marginals(_marginals(rows, keys, classes, F.col(n) if n else None), keys, classes)


def spearman(rows: DataFrame, keys: list[str], x: str = "y_true", y: str = "y_cont", n: str | None = None) -> DataFrame:
    """(keys, spearman): correlation of average ranks; 0 where either side is constant. `n` may name a column of counts. `y_true` is a grade, of few values."""
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.sum(F.col(n) if n else F.lit(1)).alias("n"))
    pairs = settled(pairs)
    ranks_x = average_rank(pairs, keys, x, few=x == "y_true").withColumnRenamed("rank", "rank_x")
    ranks_y = average_rank(pairs, keys, y).withColumnRenamed("rank", "rank_y")
    joined = pairs.join(ranks_x, [*keys, x]).join(ranks_y, [*keys, y]) if keys else pairs.join(ranks_x, x).join(ranks_y, y)
    return weighted_correlation(joined, keys, "rank_x", "rank_y", "n", "spearman")


def weighted_correlation(rows: DataFrame, keys: list[str], x: str, y: str, w: str, name: str) -> DataFrame:
    """Pearson correlation with integer weights; 0 where it is undefined. The sums are taken about the means."""
    if not keys:
        return weighted_correlation(rows.withColumn("__all", F.lit(1)), ["__all"], x, y, w, name).drop("__all")
    total = rows.groupBy(*keys).agg(F.sum(w).alias("__w"), F.sum(F.col(w) * F.col(x)).alias("__x"), F.sum(F.col(w) * F.col(y)).alias("__y"))
    centred = rows.join(total, keys).select(*keys, w, (F.col(x) - F.col("__x") / F.col("__w")).alias("dx"), (F.col(y) - F.col("__y") / F.col("__w")).alias("dy"))
    sums = centred.groupBy(*keys).agg(F.sum(F.col(w) * F.col("dx") * F.col("dy")).alias("xy"), F.sum(F.col(w) * F.col("dx") * F.col("dx")).alias("xx"), F.sum(F.col(w) * F.col("dy") * F.col("dy")).alias("yy"))
    return sums.select(*keys, F.coalesce(F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))), F.lit(0.0)).alias(name))


def lin_ccc(rows: DataFrame, keys: list[str], x: str = "y_true", y: str = "y_cont", n: str | None = None) -> DataFrame:
    """(keys, ccc): concordance with population moments; 0 in degenerate cases. `n` may name a column of counts."""
    u, v = F.col(x).cast("double"), F.col(y).cast("double")
    if n is None:
        moments = [F.avg(u).alias("mu"), F.avg(v).alias("mv"), F.var_pop(u).alias("vu"), F.var_pop(v).alias("vv"), F.covar_pop(u, v).alias("c")]
        m = rows.groupBy(*keys).agg(*moments)
    else:
        both = rows.where(u.isNotNull() & v.isNotNull())
        mean = lambda c: F.sum(F.col(n) * c) / F.sum(n)
        m = both.groupBy(*keys).agg(mean(u).alias("mu"), mean(v).alias("mv"), mean(u * u).alias("uu"), mean(v * v).alias("vv"), mean(u * v).alias("uv"))
        m = m.select(*keys, "mu", "mv", (F.col("uu") - F.col("mu") * F.col("mu")).alias("vu"), (F.col("vv") - F.col("mv") * F.col("mv")).alias("vv"), (F.col("uv") - F.col("mu") * F.col("mv")).alias("c"))
    value = F.when((F.col("vu") <= 0) | (F.col("vv") <= 0), 0.0).otherwise(F.try_divide(2 * F.col("c"), F.col("vu") + F.col("vv") + F.pow(F.col("mu") - F.col("mv"), 2)))
    return m.select(*keys, F.coalesce(value, F.lit(0.0)).alias("ccc"))


def ordinal_metrics(rows: DataFrame, keys: list[str], classes: int, n: str | None = None) -> DataFrame:
    """The nine metrics and n for each group; without keys, for all rows. `n` may name a column of counts."""
    if not keys:
        return ordinal_metrics(rows.withColumn("__all", F.lit(1)), ["__all"], classes, n).drop("__all")
    counted = count_metrics(rows, keys, classes, n)
    ranked, ccc = spearman(rows, keys, n=n), lin_ccc(rows, keys, n=n)
    return counted.join(ranked, keys).join(ccc, keys)


def metrics_by_sets(rows: DataFrame, sets: list[list[str]], classes: int) -> DataFrame:
    """The nine metrics for several groupings at once, as grouping sets: rows are counted once by all keys and outputs, and the
    counts are summed for each set. A key that a set lacks is null; `grouping` names the set."""
    every = sorted({k for s in sets for k in s})
    outputs = ["y_true", "y_pred", "y_cont"]
    seen = rows.groupBy(*every, *outputs).agg(F.count(F.lit(1)).alias("n"))
    of_set = lambda s: F.struct(F.lit("+".join(s) or "all").alias("grouping"), *[(F.col(k) if k in s else F.lit(None).cast(rows.schema[k].dataType)).alias(k) for k in every])
    each = seen.select(F.explode(F.array(*[of_set(s) for s in sets])).alias("__set"), *outputs, "n")
    cells = each.groupBy("__set", *outputs).agg(F.sum("n").alias("n"))
    out = ordinal_metrics(cells, ["__set"], classes, "n")
    return out.select(*[F.col(f"__set.{k}").alias(k) for k in every], F.col("__set.grouping").alias("grouping"), "n", *COUNT_METRICS, "spearman", "ccc")


def mistaken(rows: DataFrame, keys: list[str], true: int, pred: int) -> DataFrame:
    """How many rows of class `true` were predicted as `pred`: support, count and rate (0 without support)."""
    t = F.col("y_true") == true
    m = rows.groupBy(*keys).agg(F.count_if(t).alias("support"), F.count_if(t & (F.col("y_pred") == pred)).alias("mistaken"))
    return m.withColumn("rate", F.coalesce(F.try_divide(F.col("mistaken"), F.col("support")), F.lit(0.0)))


def pooled(parts: list[DataFrame], index: str) -> DataFrame:
    """All folds' predictions in one table; ValueError unless every index comes once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    again = out.groupBy(index).count().where("count > 1").limit(10).collect()
    if again:
        raise ValueError(f"{index} is not unique: {[r[index] for r in again]}")
    return out


def distance_shares(rows: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """Share of rows at each absolute error from 0 to K-1."""
    table = confusion(rows, keys, classes)
    each = table.groupBy(*keys, F.abs(F.col("y_true") - F.col("y_pred")).alias("distance")).agg(F.sum("n").alias("n"))
    return each.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def typical_cases(rows: DataFrame, index: str, classes: int, n: int = 3) -> DataFrame:
    """Right at the top grade with the largest y_cont, right at the lowest with the least, and the worst error; each row once, n rows at most."""
    right = F.col("y_true") == F.col("y_pred")
    error = F.abs(F.col("y_true") - F.col("y_cont"))
    take = lambda kind, rank, where, *order: rows.where(where).orderBy(*order, index).limit(1).select(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), *rows.columns)
    three = (
        take("top", 1, right & (F.col("y_true") == classes), F.desc("y_cont"))
        .union(take("bottom", 2, right & (F.col("y_true") == 1), F.asc("y_cont")))
        .union(take("worst", 3, F.lit(True), F.desc(error), F.desc("y_cont")))
    )
    first = F.row_number().over(Window.partitionBy(index).orderBy("rank"))
    return three.withColumn("__n", first).where("__n = 1").drop("__n").orderBy("rank").limit(n)


def fold_interval(values: DataFrame, metric: str, level: float = 0.975) -> DataFrame:
    """(mean, sd, n, low, high): mean of a metric over folds with its t interval."""
    from ..functions.numeric import t_quantile

    m = values.agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.count(metric).alias("n"))
    folds = m.first()["n"]  # one number
    half = F.lit(t_quantile(level, folds - 1) if folds > 1 else None).cast("double") * F.col("sd") / F.sqrt("n")
    return m.select(F.lit(metric).alias("metric"), "mean", "sd", "n", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))
