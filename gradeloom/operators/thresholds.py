"""Decision thresholds: decoding with them and searching them from counts.

A search step for bound k needs, per group, only how many rows there are by true class, by the number of other bounds they
exceed, and by how many grid values lie under p_k. One small aggregation gives the confusion counts of all candidates at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coral

GRID = np.round(np.arange(0.25, 0.75 + 1e-9, 0.01), 10)


def threshold_array(spec, task: Column, classes: int) -> Column:
    """Array of K-1 thresholds for a task from a number, a list, {"default": ..., "by_task": {task: ...}} or a list of lists."""
    row = lambda x: F.lit([float(x)] * (classes - 1) if np.isscalar(x) else [float(v) for v in x])
    if isinstance(spec, list | tuple) and spec and not np.isscalar(spec[0]):
        spec = {"by_task": dict(enumerate(spec))}
    if not isinstance(spec, dict):
        return row(spec)
    default = row(spec.get("default", 0.5))
    chosen = default
    for t, x in spec.get("by_task", {}).items():
        chosen = F.when(task == int(t), row(x)).otherwise(chosen)
    return chosen


def decode_by_task(rows: DataFrame, spec, classes: int, out: str = "y_pred_calibrated") -> DataFrame:
    return rows.withColumn(out, coral.decode(F.col("p_gt"), threshold_array(spec, F.col("task"), classes)))


def axis_decode(rows: DataFrame, key: str, out: str = "y_axis") -> DataFrame:
    """Grade from a score by midpoints between the means of adjacent grades, within each key."""
    means = rows.groupBy(key, "y_true").agg(F.avg("s").alias("m"))
    listed = means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("y_true", "m"))), lambda x: x["m"]).alias("m"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("m") - 1), lambda i: (F.element_at("m", i) + F.element_at("m", i + 1)) / 2)
    cuts = F.when(F.size("m") > 1, cuts).otherwise(F.array().cast("array<double>"))
    # one row per key (a fold), whatever the number of rows
    table = listed.select(key, cuts.alias("__cuts"))
    joined = rows.join(table, key)
    return joined.withColumn(out, F.aggregate("__cuts", F.lit(1), lambda a, t: a + (F.col("s") > t).cast("int"))).drop("__cuts")


def scores_of(cm: np.ndarray) -> dict[str, np.ndarray]:
    """Metrics of a stack of confusion tables [..., y_true, y_pred]."""
    n = np.maximum(cm.sum(axis=(-2, -1)), 1e-300)
    k = cm.shape[-1]
    gap = np.abs(np.arange(k)[:, None] - np.arange(k)[None, :])
    t, p, hit = cm.sum(axis=-1), cm.sum(axis=-2), np.diagonal(cm, axis1=-2, axis2=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        recall = np.where(t > 0, hit / t, 0)
        f1 = np.where(t + p > 0, 2 * hit / (t + p), 0)
        chance = np.einsum("...i,...j,ij->...", t, p, gap**2)
        qwk = np.where(((t > 0).sum(axis=-1) < 2) | ((p > 0).sum(axis=-1) < 2) | (chance == 0), 0, 1 - (cm * gap**2).sum(axis=(-2, -1)) * n / chance)
    return {"acc": hit.sum(axis=-1) / n, "acc_pm1": (cm * (gap <= 1)).sum(axis=(-2, -1)) / n, "bacc": recall.mean(axis=-1), "qwk": qwk, "mae": (cm * gap).sum(axis=(-2, -1)) / n, "macro_f1": f1.mean(axis=-1), "weighted_f1": (f1 * t).sum(axis=-1) / n}


def best_candidate(cm: np.ndarray, objective: list[str]) -> int:
    """The first candidate with the largest tuple of signed metrics."""
    m = scores_of(cm)
    columns = [-m[name[1:]] if name.startswith("-") else m[name] for name in objective]
    order = list(zip(*[c.tolist() for c in columns], strict=True))
    return max(range(len(order)), key=lambda i: (order[i], -i))


def bucketed(rows: DataFrame, keys: list[str], classes: int, grid: np.ndarray, p: str = "p_gt") -> DataFrame:
    """(keys, y_true, m array, n): rows by how many grid values each probability exceeds. All search steps work on this table."""
    values = F.lit([float(g) for g in grid])
    m = F.transform(F.col(p), lambda x: F.size(F.filter(values, lambda g: x > g)))
    return rows.where(F.col("y_true").between(1, classes)).groupBy(*keys, "y_true", m.alias("m")).agg(F.count(F.lit(1)).alias("n"))


#: Rows of a bucket table that the driver takes at once to search on; on a larger one every step is an aggregation.
DRIVER_ROWS = 200_000


def _tables(y: np.ndarray, others: np.ndarray, m: np.ndarray, n: np.ndarray, size: int, classes: int) -> np.ndarray:
    """Confusion tables for each grid position as the bound's threshold: a row exceeds those that its m is over."""
    held = np.zeros((size + 1, classes, classes))
    np.add.at(held, (m, y - 1, others), n)
    upto = np.cumsum(held, axis=0)[:size]
    cm = upto.copy()
    cm[:, :, 1:] += (held.sum(axis=0) - upto)[:, :, :-1]
    return cm


def search(table: DataFrame, keys: list[str], classes: int, grid: np.ndarray, objective: list[str], rounds: int = 3, start: float = 0.5) -> dict[tuple, np.ndarray]:
    """Thresholds of each group by coordinate descent over the bounds; one aggregation for all groups in each step."""
    table = table.persist()
    try:
        groups = [tuple(r) for r in table.select(*keys).distinct().collect()] if keys else [()]
        at = int(np.argmin(np.abs(grid - start)))
        where = {g: np.full(classes - 1, at) for g in groups}  # positions in the grid
        local = table.limit(DRIVER_ROWS + 1).toPandas() if groups else None
        if local is not None and len(local) <= DRIVER_ROWS:
            parts = {(): local} if not keys else dict(list(local.groupby(keys if len(keys) > 1 else keys[0])))
            return {g: grid[w] for g, w in ((k if isinstance(k, tuple) else (k,), _search_local(part, classes, len(grid), at, objective, rounds)) for k, part in parts.items())}
        for _ in range(rounds):
            before = {g: w.copy() for g, w in where.items()}
            for k in range(classes - 1):
                others = _exceeded(table, keys, where, k, classes)
                seen = others.groupBy(*keys, "y_true", "others", F.col("m")[k].alias("mk")).agg(F.sum("n").alias("n")).toPandas()  # classes x classes x grid rows a group at most
                parts = dict(list(seen.groupby(keys if len(keys) > 1 else keys[0]))) if keys else {(): seen}
                for g, part in parts.items():
                    g = g if isinstance(g, tuple) else (g,)
                    y, o, m, n = (part[c].to_numpy(dtype=np.int64) for c in ("y_true", "others", "mk", "n"))
                    where[g][k] = best_candidate(_tables(y, o, m, n, len(grid), classes), objective)
            if all((where[g] == before[g]).all() for g in groups):
                break
        return {g: grid[w] for g, w in where.items()}
    finally:
        table.unpersist()


def _search_local(part: pd.DataFrame, classes: int, size: int, start: int, objective: list[str], rounds: int) -> np.ndarray:
    """The same descent on one group's buckets."""
    where = np.full(classes - 1, start)
    m = np.stack(part["m"].to_numpy()).astype(np.int64)
    y, n = part["y_true"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
    for _ in range(rounds):
        before = where.copy()
        for k in range(classes - 1):
            over = m > where
            others = over.sum(axis=1) - over[:, k]
            where[k] = best_candidate(_tables(y, others, m[:, k], n, size, classes), objective)
        if (where == before).all():
            break
    return where


def _exceeded(table: DataFrame, keys: list[str], where: dict[tuple, np.ndarray], k: int, classes: int) -> DataFrame:
    """Number of the other bounds whose threshold (the grid value at its position) a row exceeds."""
    if not keys:
        return table.withColumn("others", _count_over({i: F.lit(int(w)) for i, w in enumerate(where[()])}, k, classes))
    schema = table.select(*keys).schema
    spark = table.sparkSession
    rows = [(*g, [int(x) for x in w]) for g, w in where.items()]
    at = spark.createDataFrame(rows, schema.add("__at", T.ArrayType(T.IntegerType())))
    joined = table.join(F.broadcast(at), keys)  # a row per group of the search
    return joined.withColumn("others", _count_over({i: F.col("__at")[i] for i in range(classes - 1)}, k, classes)).drop("__at")


def _count_over(at: dict[int, Column], k: int, classes: int) -> Column:
    out = F.lit(0)
    for i in range(classes - 1):
        if i != k:
            out = out + (F.col("m")[i] > at[i]).cast("int")
    return out


def _as_rows(spark, found: dict[tuple, np.ndarray], schema, classes: int) -> DataFrame:
    for k in range(1, classes):
        schema = schema.add(f"thr{k}", "double")
    return spark.createDataFrame([(*g, *[float(x) for x in t]) for g, t in found.items()], schema)


def calibrate(rows: DataFrame, keys: list[str], classes: int, grid: np.ndarray = GRID, objective: tuple[str, ...] = ("acc", "bacc", "qwk", "-mae"), rounds: int = 3) -> DataFrame:
    """(keys, thr1..): thresholds of each group."""
    found = search(bucketed(rows, keys, classes, grid), keys, classes, grid, list(objective), rounds)
    return _as_rows(rows.sparkSession, found, rows.select(*keys).schema, classes)


def calibrate_offsets(rows: DataFrame, keys: list[str], classes: int, grid: np.ndarray = GRID) -> DataFrame:
    """(keys, thr1..): offsets of y_cont over k, by (accuracy, kappa, -MAE)."""
    over = F.array(*[F.col("y_cont") - k for k in range(1, classes)])
    return calibrate(rows.withColumn("__over", over).drop("p_gt").withColumnRenamed("__over", "p_gt"), keys, classes, grid, ("acc", "qwk", "-mae"))


def _others(table: DataFrame, fold: str) -> DataFrame:
    """Each bucket once for every other fold, as `held`."""
    folds = [r[0] for r in table.select(fold).distinct().collect()]
    return table.withColumn("held", F.explode(F.filter(F.lit(sorted(folds)), lambda f: f != F.col(fold))))


def variants(rows: DataFrame, classes: int, fold: str = "fold", grid: np.ndarray = GRID, objective: tuple[str, ...] = ("acc", "bacc", "qwk", "-mae")) -> DataFrame:
    """Metrics of decoding with fixed thresholds, and with ones fitted on all rows, on the own fold, on the other folds, and on the median of the folds."""
    spark = rows.sparkSession
    table = bucketed(rows, [fold], classes, grid).persist()
    want = list(objective)
    own = search(table, [fold], classes, grid, want)
    rest = search(_others(table, fold).groupBy("held", "y_true", "m").agg(F.sum("n").alias("n")), ["held"], classes, grid, want)
    whole = search(table.groupBy("y_true", "m").agg(F.sum("n").alias("n")), [], classes, grid, want)[()]
    middle = np.median(np.stack(list(own.values())), axis=0)
    fixed = np.full(classes - 1, 0.5)
    folds = sorted(own)
    sets = {"baseline": {f: fixed for f in folds}, "all_to_all": {f: whole for f in folds}, "fold_to_fold": own, "others_to_fold": rest, "median_to_all": {f: middle for f in folds}}
    # decode on the buckets: a probability exceeds a threshold if it exceeds the last grid value that is not over it
    flat = [(name, f[0], [int(np.searchsorted(grid, t - 1e-12, side="left")) for t in thr]) for name, by in sets.items() for f, thr in by.items()]
    kind = dict(rows.dtypes)[fold]
    at = spark.createDataFrame(flat, f"variant string, {fold} {kind}, at array<int>")
    exceed = F.aggregate(F.zip_with("m", "at", lambda m, a: (m > a).cast("int")), F.lit(1), lambda a, x: a + x)
    cells = table.join(F.broadcast(at), fold).groupBy("variant", "y_true", exceed.alias("y_pred")).agg(F.sum("n").alias("n"))
    counts = cells.toPandas()
    table.unpersist()
    out = []
    for name, part in counts.groupby("variant"):
        cm = np.zeros((classes, classes))
        np.add.at(cm, (part["y_true"].to_numpy() - 1, part["y_pred"].to_numpy() - 1), part["n"].to_numpy())
        m = {k: float(v) for k, v in scores_of(cm).items()}
        out.append((name, int(cm.sum()), m["acc"], m["bacc"], m["qwk"], m["mae"], m["macro_f1"]))
    return spark.createDataFrame(out, "variant string, n long, acc double, bacc double, qwk double, mae double, macro_f1 double")


def nested_medians(rows: DataFrame, classes: int, fold: str = "fold", grid: np.ndarray = GRID, objective: tuple[str, ...] = ("acc", "bacc", "qwk", "-mae")) -> DataFrame:
    """(task, thr1..): median over folds of thresholds that are fitted, by task, on the other folds' rows; 0.5 where no fold has any."""
    table = bucketed(rows, [fold, "task"], classes, grid)
    others = _others(table, fold).groupBy("held", "task", "y_true", "m").agg(F.sum("n").alias("n"))
    found = search(others, ["held", "task"], classes, grid, list(objective))
    frame = pd.DataFrame([(t, *thr) for (_, t), thr in found.items()], columns=["task", *[f"thr{k}" for k in range(1, classes)]])
    middle = frame.groupby("task").median().fillna(0.5)
    return _as_rows(rows.sparkSession, {(int(t),): r.to_numpy() for t, r in middle.iterrows()}, rows.select("task").schema, classes)
