"""Grouped cross-validation splits. Spark makes one small row per group class; the greedy assignment works on these.

Groups with the same counts are interchangeable, so a class is dealt to all folds in whole rounds and only what is left, fewer groups
than folds, goes by the greedy rule: a pass has the size of the number of distinct count vectors, not of groups. Which group of a
class goes to which fold follows from the groups' order by a hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def group_counts(rows: DataFrame, group: str, y: str, classes: int, scanner: str | None = None) -> DataFrame:
    """(group, n, c array of counts by grade, scanner). A group with two scanners is a ValueError."""
    counts = [F.count_if(F.col(y) == k) for k in range(1, classes + 1)]
    extra = [F.min(scanner).alias("scanner"), F.max(scanner).alias("__other")] if scanner else []
    out = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.array(*counts).alias("c"), *extra)
    if scanner:
        bad = out.where(~F.col("scanner").eqNullSafe(F.col("__other"))).limit(1).collect()
        if bad:
            raise ValueError(f"{group} {bad[0][group]!r} has more than one {scanner}")
        out = out.drop("__other")
    return out


def _numbered(groups: DataFrame, group: str, by: list[str], seed: int) -> DataFrame:
    """Groups with their number within their class, in the order of a seeded hash."""
    # a class may hold most groups: it is numbered in 1,024 ranges of the hash, each from the count of those before it
    rows = groups.withColumn("__h", F.xxhash64(F.col(group), F.lit(seed))).withColumn("__b", F.shiftright("__h", 54))
    counts = rows.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__b").alias("__range"), F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", group)) - 1
    here = F.col("__b") == F.col("__range")
    for c in by:
        here = here & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.withColumn("__inside", inside).join(starts, here).select(*groups.columns, (F.col("__start") + F.col("__inside")).alias("__i"))


def _assign(groups: DataFrame, group: str, by: list[str], table: pd.DataFrame, seed: int) -> DataFrame:
    """(group, fold) from a table (class columns, first, last, fold): the class's groups numbered first..last-1 go to the fold."""
    spark = groups.sparkSession
    schema = groups.select(*by).schema.add("first", T.LongType()).add("last", T.LongType()).add("fold", T.IntegerType())
    t = spark.createDataFrame([tuple(list(v) if isinstance(v, tuple | np.ndarray) else v for v in r) for r in table.itertuples(index=False)], schema)
    numbered = _numbered(groups, group, by, seed)
    t = t.withColumnsRenamed({c: f"__{c}" for c in by})
    here = (F.col("__i") >= F.col("first")) & (F.col("__i") < F.col("last"))
    for c in by:
        here = here & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return numbered.join(t, here).select(group, "fold")


def group_kfold(rows: DataFrame, group: str, folds: int, seed: int = 0) -> DataFrame:
    """(group, fold): groups by size, the largest first, each to the fold with the fewest rows; ties to the lowest fold.

    Fewer groups than folds is a ValueError. The seed decides among groups of the same size.
    """
    groups = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    sizes = groups.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).collect()  # distinct sizes
    if sum(r["k"] for r in sizes) < folds:
        raise ValueError(f"fewer than {folds} groups")
    load = np.zeros(folds, np.int64)
    out = []
    for n, k in ((r["n"], r["k"]) for r in sizes):
        counts = np.zeros(folds, np.int64)
        left = k
        # whole rounds at once: level the folds, then deal the rest evenly, the lightest first
        while left:
            order = np.lexsort((np.arange(folds), load + counts * n))
            lightest = order[0]
            if left >= folds and (load + counts * n).max() - (load + counts * n).min() <= n:
                whole = left // folds
                counts += whole
                left -= whole * folds
            else:
                counts[lightest] += 1
                left -= 1
        ends = np.cumsum(counts)
        out += [(n, int(e - c), int(e), f) for f, (c, e) in enumerate(zip(counts, ends, strict=True)) if c]
        load += counts * n
    return _assign(groups, group, ["n"], pd.DataFrame(out, columns=["n", "first", "last", "fold"]), seed)


#: Groups up to which a split is also tried group by group, and classes of a fold whose swaps are all tried.
GREEDY, SWAPPED = 20_000, 128


def _greedy(vectors: np.ndarray, counts: np.ndarray, folds: int, cost, order: np.ndarray, whole: bool = True) -> tuple[np.ndarray, float]:
    """Groups of each class per fold, and the total cost: whole rounds to all folds, if wanted, then each group that is left goes where the
    total cost grows least, ties to the fold with fewer rows."""
    rounds = counts // folds if whole else np.zeros_like(counts)
    given = np.repeat(rounds[:, None], folds, axis=1)
    state = np.repeat((rounds @ vectors)[None, :].astype(float), folds, axis=0)
    costs = cost(state)
    for i in order:
        for _ in range(int(counts[i] - rounds[i] * folds)):
            new = cost(state + vectors[i])
            grow = new - costs
            near = np.flatnonzero(grow <= grow.min() + 1e-12)
            f = near[np.argmin(state[near, 0])]
            state[f] += vectors[i]
            costs[f] = new[f]
            given[i, f] += 1
    return given, float(costs.sum())


def _polished(vectors: np.ndarray, given: np.ndarray, cost, steps: int = 10_000) -> tuple[np.ndarray, float]:
    """A split, and its cost, from which no move of one group to another fold, and no swap of two groups, lowers the total cost.

    Each step takes the move or swap that lowers it most. Of classes beyond SWAPPED in a fold, those that it does best without are swapped.
    """
    given = given.copy()
    state = given.T @ vectors
    folds = len(state)
    of = lambda states: cost(states.reshape(-1, states.shape[-1])).reshape(states.shape[:-1])
    for _ in range(steps):
        costs = cost(state)
        out = of(state[:, None] - vectors[None]) - costs[:, None]  # fold x class: without one group, with one more
        more = of(state[:, None] + vectors[None]) - costs[:, None]
        out[given.T == 0] = np.inf
        move = out[:, None] + more[None]
        move[np.arange(folds), np.arange(folds)] = np.inf
        at = np.unravel_index(np.argmin(move), move.shape)
        best, change = move[at], [(at[2], at[0], -1), (at[2], at[1], 1)]
        near = [np.argsort(out[f], kind="stable")[: min(SWAPPED, int((given[:, f] > 0).sum()))] for f in range(folds)]
        for f in range(folds):
            for g in range(f):
                turn = vectors[near[g]][None] - vectors[near[f]][:, None]
                gain = of(state[f] + turn) + of(state[g] - turn) - costs[f] - costs[g]
                if gain.size and gain.min() < best:
                    i, j = np.unravel_index(np.argmin(gain), gain.shape)
                    best, change = gain[i, j], [(near[f][i], f, -1), (near[f][i], g, 1), (near[g][j], g, -1), (near[g][j], f, 1)]
        if not best < -1e-12:
            break
        for i, f, n in change:
            given[i, f] += n
            state[f] = state[f] + n * vectors[i]
    return given, float(cost(state).sum())


def stratified_group_kfold(rows: DataFrame, group: str, y: str, classes: int, folds: int, seed: int = 0) -> DataFrame:
    """(group, fold): grade counts so even that no move of a group and no swap of two makes them more even.

    The start is the better of two greedy passes, groups of uneven counts first: one that deals whole rounds of equal groups, and,
    up to GREEDY groups, one of group by group; so the split is never less even than either. No groups give no rows.
    """
    groups = group_counts(rows, group, y, classes)
    table = groups.groupBy("n", "c").agg(F.count(F.lit(1)).alias("k")).orderBy("n", "c").toPandas()
    if not len(table):
        return groups.select(group, F.lit(0).alias("fold"))
    c = np.stack(table["c"].to_numpy()).astype(float)
    total = np.maximum((c * table["k"].to_numpy()[:, None]).sum(axis=0), 1)
    vectors = np.hstack([table[["n"]].to_numpy(float), c])

    def cost(state):
        share = state[:, 1:] / total
        return ((share - 1 / folds) ** 2).sum(axis=1)

    draw = np.random.default_rng(seed).random(len(table))
    k, order = table["k"].to_numpy(), np.lexsort((draw, -c.std(axis=1)))
    starts = [_greedy(vectors, k, folds, cost, order, whole) for whole in ([True, False] if k.sum() <= GREEDY else [True])]
    given, _ = _polished(vectors, min(starts, key=lambda s: s[1])[0], cost)
    return _assign(groups, group, ["n", "c"], _spread(table[["n", "c"]], given), seed)


def _spread(classes: pd.DataFrame, given: np.ndarray) -> pd.DataFrame:
    out = []
    for row, counts in zip(classes.itertuples(index=False), given, strict=True):
        ends = np.cumsum(counts)
        out += [(*row, int(e - k), int(e), f) for f, (k, e) in enumerate(zip(counts, ends, strict=True)) if k]
    return pd.DataFrame(out, columns=[*classes.columns, "first", "last", "fold"])


def balanced_split(rows: DataFrame, group: str, y: str, scanner: str, classes: int, folds: int, trials: int = 200, weights: tuple = (1.0, 1.0, 0.2, 0.2), seed: int = 0) -> DataFrame:
    """(group, fold, score): grades and scanners balanced together; the best of `trials` greedy passes in different orders.

    The cost of a fold is the weighted sum of squared relative errors of its grade counts, scanner counts, rows and groups against an even share.
    First go groups with the largest 5 (1 / groups of the scanner) + 3 (largest share of a grade) + share of all rows; a trial shuffles
    within equal priority. Trials run in parallel over the table of classes.
    """
    spark = rows.sparkSession
    groups = group_counts(rows, group, y, classes, scanner).persist()
    table = groups.groupBy("n", "c", "scanner").agg(F.count(F.lit(1)).alias("k")).orderBy("n", "c", "scanner").toPandas()
    levels = sorted(table["scanner"].dropna().unique())
    c = np.stack(table["c"].to_numpy()).astype(float)
    s = np.stack([(table["scanner"] == v).to_numpy(float) for v in levels], axis=1) if levels else np.zeros((len(table), 0))
    k = table["k"].to_numpy()
    vectors = np.hstack([table[["n"]].to_numpy(float), np.ones((len(table), 1)), c, s])
    totals = (vectors * k[:, None]).sum(axis=0)
    target = np.maximum(totals / folds, 1e-9)
    w = np.concatenate([[weights[2], weights[3]], np.full(classes, weights[0]), np.full(s.shape[1], weights[1])]) * (totals > 0)
    scanner_share = (s / np.maximum(totals[2 + classes :], 1)).sum(axis=1)
    rarity = 5 * scanner_share + 3 * (c / np.maximum(totals[2 : 2 + classes], 1)).max(axis=1) + vectors[:, 0] / max(totals[0], 1)
    shared = spark.sparkContext.broadcast((vectors, k, target, w, rarity))

    def once(trial: int):
        vectors, k, target, w, rarity = shared.value
        order = np.random.default_rng([seed, trial]).permutation(len(vectors))
        order = order[np.argsort(-rarity[order], kind="stable")]
        return _greedy(vectors, k, folds, lambda state: (w * ((state - target) / target) ** 2).sum(axis=1), order)

    def run(frames):
        for frame in frames:
            for t in frame["id"]:
                yield pd.DataFrame({"trial": [t], "score": [once(int(t))[1]]})

    scores = spark.range(trials).repartition(min(trials, 64), "id").mapInPandas(run, "trial long, score double")
    best = scores.orderBy(F.round("score", 12), "trial").first()
    given, score = once(best["trial"])
    out = _assign(groups, group, ["n", "c", "scanner"], _spread(table[["n", "c", "scanner"]], given), seed)
    return out.withColumn("score", F.lit(float(score)))


def nested_split(rows: DataFrame, group: str, outer: DataFrame, folds: int, seed: int = 0) -> DataFrame:
    """(outer, group, fold): for each outer fold a split of the other folds' groups."""
    out = None
    for f in sorted(r["fold"] for r in outer.select("fold").distinct().collect()):
        inside = rows.join(outer.where(F.col("fold") != f).select(group), group, "left_semi")
        part = group_kfold(inside, group, folds, seed + f).select(F.lit(f).alias("outer"), group, "fold")
        out = part if out is None else out.unionByName(part)
    return out


def balance_report(rows: DataFrame, value: str, fold: str = "fold") -> DataFrame:
    """(fold, value, n_val, n_train, pct_val, pct_train, pct_diff, max_abs_diff) in percentage points; values a side lacks count 0."""
    cells = rows.groupBy(fold, value).agg(F.count(F.lit(1)).alias("n"))
    of_fold = Window.partitionBy(fold)
    folds = rows.select(fold).distinct()
    dense = cells.groupBy(value).agg(F.sum("n").alias("all")).join(F.broadcast(folds), F.lit(True)).join(cells, [fold, value], "left").withColumn("n_val", F.coalesce("n", F.lit(0)))
    t = dense.withColumn("n_train", F.col("all") - F.col("n_val"))
    t = t.withColumns({"pct_val": 100 * F.try_divide(F.col("n_val"), F.sum("n_val").over(of_fold)), "pct_train": 100 * F.try_divide(F.col("n_train"), F.sum("n_train").over(of_fold))})
    t = t.withColumn("pct_diff", F.coalesce("pct_val", F.lit(0.0)) - F.coalesce("pct_train", F.lit(0.0)))
    return t.select(fold, value, "n_val", "n_train", "pct_val", "pct_train", "pct_diff", F.max(F.abs("pct_diff")).over(of_fold).alias("max_abs_diff"))
