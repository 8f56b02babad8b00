"""Linear models from moments: rows are read once, and every fit works on sums over them.

Vectors are rows (…, x array<double>, y double, w double). Moments are summed per group in each partition and merged by group, so
what is shuffled has the size of features squared, not of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import elastic_net
from .bootstrap import draw_matrix, with_draws
from .sums import added


@dataclass
class Moments:
    """Sums over rows with weight m·w (m: times a row is drawn): counts, unweighted and weighted first and second moments."""

    n: float
    w: float
    u: np.ndarray  # sum m x
    uu: np.ndarray  # sum m x x'
    x: np.ndarray  # sum m w x
    xx: np.ndarray  # sum m w x x'
    y: float
    yy: float
    xy: np.ndarray

    @staticmethod
    def zero(p: int) -> Moments:
        return Moments(0.0, 0.0, np.zeros(p), np.zeros((p, p)), np.zeros(p), np.zeros((p, p)), 0.0, 0.0, np.zeros(p))

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray, w: np.ndarray, m: np.ndarray | None = None) -> Moments:
        m = np.ones(len(y)) if m is None else m
        v = m * w
        return Moments(m.sum(), v.sum(), m @ x, (x * m[:, None]).T @ x, v @ x, (x * v[:, None]).T @ x, v @ y, v @ (y * y), (v * y) @ x)

    def __add__(self, o: Moments) -> Moments:
        return Moments(*[a + b for a, b in zip(self.parts(), o.parts(), strict=True)])

    def __sub__(self, o: Moments) -> Moments:
        return Moments(*[a - b for a, b in zip(self.parts(), o.parts(), strict=True)])

    def parts(self) -> list:
        return [self.n, self.w, self.u, self.uu, self.x, self.xx, self.y, self.yy, self.xy]

    def packed(self) -> bytes:
        return np.concatenate([np.ravel(a) for a in self.parts()]).astype(np.float64).tobytes()

    @staticmethod
    def unpacked(data: bytes, p: int) -> Moments:
        flat = np.frombuffer(data)
        cuts = np.cumsum([1, 1, p, p * p, p, p * p, 1, 1])
        n, w, u, uu, x, xx, y, yy, xy = np.split(flat, cuts)
        return Moments(n[0], w[0], u, uu.reshape(p, p), x, xx.reshape(p, p), y[0], yy[0], xy)


def group_moments(vectors: DataFrame, groups: list[str], p: int) -> DataFrame:
    """(groups, moments): one packed row per group."""
    kinds = dict(vectors.dtypes)
    schema = ", ".join(f"{g} {kinds[g]}" for g in groups) + ", moments binary, part long"

    def partial(frames):
        held: dict[tuple, Moments] = {}
        for frame in frames:
            for key, part in frame.groupby(groups):
                key = key if isinstance(key, tuple) else (key,)
                held[key] = held.get(key, Moments.zero(p)) + Moments.of(np.stack(part["x"].to_numpy()), part["y"].to_numpy(float), part["w"].to_numpy(float))
        if held:
            yield pd.DataFrame([(*k, m.packed(), TaskContext.get().partitionId()) for k, m in held.items()], columns=[*groups, "moments", "part"])

    return added(vectors.select(*groups, "x", "y", "w").mapInPandas(partial, schema), groups, "moments")


#: Bytes of moments of one segment that a task may hold; more replicates go in further passes over the rows.
HELD_BYTES = 64 << 20


def replicate_moments(vectors: DataFrame, cluster: str, segment: str, p: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, segment, moments) with clusters drawn with replacement, as many as there are, in one pass over the rows for as many
    replicates as HELD_BYTES hold. Rows without a cluster are left out."""
    each = max(1, HELD_BYTES // (16 * p * p))
    rows = with_draws(vectors.select(F.col(cluster).alias("cluster"), segment, "x", "y", "w"), replicates, seed, "draws")
    out = None
    for first in range(0, replicates, each):
        part = _some_replicates(rows, segment, p, replicates, first, min(replicates, first + each))
        out = part if out is None else out.unionByName(part)
    return out


def _some_replicates(rows: DataFrame, segment: str, p: int, replicates: int, first: int, last: int) -> DataFrame:
    kind = dict(rows.dtypes)[segment]
    schema = f"replicate int, {segment} {kind}, moments binary, part long"

    def partial(frames):
        held: dict[tuple, Moments] = {}
        for frame in frames:
            drawn = draw_matrix(frame["draws"], replicates + 1)[:, 1 + first : 1 + last].astype(float)
            for s, at in frame.groupby(segment).indices.items():
                x, y, w = np.stack(frame["x"].to_numpy()[at]), frame["y"].to_numpy(float)[at], frame["w"].to_numpy(float)[at]
                for b in range(first, last):
                    held[b, s] = held.get((b, s), Moments.zero(p)) + Moments.of(x, y, w, drawn[at, b - first])
        if held:
            yield pd.DataFrame([(b, s, m.packed(), TaskContext.get().partitionId()) for (b, s), m in held.items()], columns=["replicate", segment, "moments", "part"])

    return added(rows.select("draws", segment, "x", "y", "w").mapInPandas(partial, schema), ["replicate", segment], "moments")


def standardized(by_segment: list[Moments], fit: list[Moments] | None = None):
    """Gram, moment vector, y'y (averages over weights), and the standardisation, of rows less their segment's weighted mean.

    Residuals are centred and scaled by their unweighted mean and deviation, as the models' scaler does; `fit` gives other moments
    (the training rows) for means and scale. A segment without training rows keeps its values.
    """
    fit = fit or by_segment
    p = len(fit[0].x)
    means = [m.x / m.w if m.w > 0 else np.zeros(p) for m in fit]
    y_means = [m.y / m.w if m.w > 0 else 0.0 for m in fit]
    n = sum(m.n for m in fit)
    first = sum(m.u - m.n * mu for m, mu in zip(fit, means, strict=True))
    second = sum(np.diag(m.uu) - 2 * mu * m.u + m.n * mu**2 for m, mu in zip(fit, means, strict=True))
    shift = first / n
    scale = np.sqrt(np.maximum(second / n - shift**2, 0))
    scale = np.where(scale > 1e-12, scale, 1.0)
    total = sum(m.w for m in by_segment)
    gram, moment, square = np.zeros((p, p)), np.zeros(p), 0.0
    for m, mu, my in zip(by_segment, means, y_means, strict=True):
        c = mu + shift
        gram += m.xx - np.outer(m.x, c) - np.outer(c, m.x) + m.w * np.outer(c, c)
        moment += m.xy - my * m.x - c * m.y + m.w * my * c
        square += m.yy - 2 * my * m.y + m.w * my**2
    return gram / np.outer(scale, scale) / total, moment / scale / total, square / total


def lambda_grid(moment: np.ndarray, l1_ratio: float, n: int = 100, epsilon: float = 1e-3) -> np.ndarray:
    """Geometric path from the least penalty without a coefficient down to `epsilon` of it."""
    top = max(float(np.abs(moment).max(initial=0)) / max(l1_ratio, 1e-12), 1e-6)
    return top * epsilon ** (np.arange(n) / (n - 1))


def enet_path(gram: np.ndarray, moment: np.ndarray, l1_ratio: float, penalties, factors: np.ndarray | None = None) -> np.ndarray:
    """Coefficients along a decreasing path, each fit started from the one before."""
    out, b = [], None
    for penalty in penalties:
        b = elastic_net(gram, moment, float(penalty), l1_ratio, factors, b, tolerance=1e-7)
        out.append(b)
    return np.stack(out)


def choose_lambda(vectors: DataFrame, fold: str, segment: str, p: int, l1_ratio: float = 0.5, n: int = 100, epsilon: float = 1e-3, one_se: bool = True) -> DataFrame:
    """(alpha, cv_mean_mse, cv_se, selected): grouped K-fold error of each penalty; the largest within one standard error of the best, or the best.

    The validation error is a quadratic form of the validation moments, so no penalty needs the rows again.
    """
    spark = vectors.sparkSession
    rows = group_moments(vectors, [fold, segment], p).collect()  # folds x segments rows
    folds, segments = sorted({r[fold] for r in rows}), sorted({r[segment] for r in rows})
    cell = {(r[fold], r[segment]): Moments.unpacked(r["moments"], p) for r in rows}
    get = lambda f, s: cell.get((f, s), Moments.zero(p))
    whole = [sum((get(f, s) for f in folds[1:]), get(folds[0], s)) for s in segments]
    alphas = lambda_grid(standardized(whole)[1], l1_ratio, n, epsilon)
    errors = []
    for f in folds:
        train = [t - get(f, s) for t, s in zip(whole, segments, strict=True)]
        gram, moment, _ = standardized(train)
        path = enet_path(gram, moment, l1_ratio, alphas)
        vg, vm, vy = standardized([get(f, s) for s in segments], train)
        errors.append(vy - 2 * path @ vm + np.einsum("ki,ij,kj->k", path, vg, path))
    e = np.stack(errors)
    mean, se = e.mean(axis=0), e.std(axis=0, ddof=1) / np.sqrt(len(e)) if len(e) > 1 else np.zeros(n)
    best = int(mean.argmin())
    chosen = int(np.flatnonzero(mean <= mean[best] + se[best])[0]) if one_se else best
    return spark.createDataFrame([(float(a), float(m), float(s), i == chosen) for i, (a, m, s) in enumerate(zip(alphas, mean, se, strict=True))], "alpha double, cv_mean_mse double, cv_se double, selected boolean")


def stability(vectors: DataFrame, cluster: str, segment: str, names: list[str], alpha: float, l1_ratio: float = 0.5, replicates: int = 50, delta: float = 1e-6, tau: float = 0.6, seed: int = 0, moments: DataFrame | None = None) -> DataFrame:
    """(feature, pi, mean_abs_beta, score, stable, rank): how often a feature is chosen over bootstrap replicates of the clusters."""
    p = len(names)
    moments = moments if moments is not None else replicate_moments(vectors, cluster, segment, p, replicates, seed)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        gram, moment, _ = standardized([Moments.unpacked(d, p) for d in frame["moments"]])
        b = np.abs(elastic_net(gram, moment, alpha, l1_ratio, tolerance=1e-7))
        return pd.DataFrame({"feature": names, "chosen": (b > delta).astype(float), "b": b})

    each = moments.groupBy("replicate").applyInPandas(fit, "feature string, chosen double, b double")
    out = each.groupBy("feature").agg(F.avg("chosen").alias("pi"), F.avg("b").alias("mean_abs_beta"))
    out = out.withColumn("score", F.col("pi") * F.col("mean_abs_beta")).withColumn("stable", F.col("pi") >= tau)
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("stable"), F.desc("score"), F.desc("pi"), F.desc("mean_abs_beta"), "feature")
    return out.withColumn("rank", F.when(F.col("stable"), F.row_number().over(order)))


def tuned_stability(vectors: DataFrame, cluster: str, segment: str, names: list[str], alphas: np.ndarray, start: int, most: int, **options) -> DataFrame:
    """Stability at the penalty nearest to position `start` of a decreasing path that chooses 1 to `most` features: sparser while there are more, denser while there is none.

    All penalties work on the same replicate moments, which are read once.
    """
    p = len(names)
    moments = replicate_moments(vectors, cluster, segment, p, options.get("replicates", 50), options.get("seed", 0)).persist()
    seen: set[int] = set()
    at = start
    while True:
        found = stability(vectors, cluster, segment, names, float(alphas[at]), moments=moments, **options).persist()
        n = found.where("stable").count()
        seen.add(at)
        step = -1 if n > most else 1 if n == 0 else 0
        if not step or not 0 <= at + step < len(alphas) or at + step in seen:
            moments.unpersist()
            return found
        at += step


def design(x: Column, level: Column, levels: list, reference) -> Column:
    """[x, dummies of the levels but the reference, dummy times x for each of them]."""
    others = [v for v in levels if v != reference]
    dummy = [F.when(level == F.lit(v), 1.0).otherwise(0.0) for v in others]

    def times(d: Column) -> Column:
        return F.transform(x, lambda v: v * d)

    return F.concat(x, F.array(*dummy), *[times(d) for d in dummy])


def penalty_factors(p: int, levels: int, main: float = 1.0, dummies: float = 0.0, inter: float = 2.0) -> np.ndarray:
    return np.concatenate([np.full(p, main), np.full(levels - 1, dummies), np.full(p * (levels - 1), inter)])


def centred(m: Moments):
    """Gram, moment vector, means of x and y: of rows with an intercept."""
    mx, my = m.x / m.w, m.y / m.w
    return m.xx / m.w - np.outer(mx, mx), m.xy / m.w - my * mx, mx, my


def lambda_max(gram: np.ndarray, moment: np.ndarray, l1_ratio: float, factors: np.ndarray) -> float:
    """Least penalty without a penalised coefficient; unpenalised columns are regressed out first."""
    free, held = factors <= 0, factors > 0
    if not held.any():
        return 0.0
    b = np.linalg.lstsq(gram[np.ix_(free, free)], moment[free], rcond=None)[0] if free.any() else np.zeros(0)
    left = moment[held] - gram[np.ix_(held, free)] @ b
    top = float(np.max(np.abs(left) / factors[held])) / l1_ratio
    return top if np.isfinite(top) and top > 0 else 0.0


def grid_search(vectors: DataFrame, fold: str, p: int, classes: int, l1_ratios: list[float], n: int = 20, epsilon: float = 1e-2, factors: np.ndarray | None = None) -> DataFrame:
    """(l1_ratio, alpha, mae, se, rule_min, rule_1se): grouped CV of decoded grades over a grid of models.

    Fits need moments by fold only. All candidates of a fold go to its rows as one table of coefficients, and the rows are read once.
    """
    spark = vectors.sparkSession
    factors = np.ones(p) if factors is None else factors
    cell = {r[fold]: Moments.unpacked(r["moments"], p) for r in group_moments(vectors, [fold], p).collect()}
    folds = sorted(cell)
    whole = sum((cell[f] for f in folds[1:]), cell[folds[0]])
    rows = []
    for ratio in l1_ratios:
        gram, moment, _, _ = centred(whole)
        alphas = lambda_max(gram, moment, ratio, factors) * epsilon ** (np.arange(n) / max(n - 1, 1))
        for f in folds:
            g, m, mx, my = centred(whole - cell[f])
            for i, b in enumerate(enet_path(g, m, ratio, alphas, factors)):
                rows.append((f, float(ratio), i, float(alphas[i]), [float(v) for v in b], float(my - b @ mx)))
    shared = spark.sparkContext.broadcast({f: (np.array([r[4] for r in rows if r[0] == f]), np.array([r[5] for r in rows if r[0] == f]), [(r[1], r[2], r[3]) for r in rows if r[0] == f]) for f in folds})

    def errors(frames):
        for frame in frames:
            for f, part in frame.groupby(fold):
                b, b0, names = shared.value[f]
                y = np.stack(part["x"].to_numpy()) @ b.T + b0
                wrong = np.abs(np.clip(np.floor(y + 0.5), 1, classes) - part["y"].to_numpy(float)[:, None])
                yield pd.DataFrame({fold: f, "l1_ratio": [k[0] for k in names], "i": [k[1] for k in names], "alpha": [k[2] for k in names], "wrong": wrong.sum(axis=0), "n": len(part)})

    kind = dict(vectors.dtypes)[fold]
    by_fold = vectors.select(fold, "x", "y").mapInPandas(errors, f"{fold} {kind}, l1_ratio double, i int, alpha double, wrong double, n long").groupBy(fold, "l1_ratio", "i", "alpha").agg((F.sum("wrong") / F.sum("n")).alias("mae"))
    table = by_fold.groupBy("l1_ratio", "i", "alpha").agg(F.avg("mae").alias("mae"), (F.coalesce(F.stddev_samp("mae"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("se")).toPandas()
    table = table.sort_values(["alpha", "l1_ratio"], ascending=[False, True]).reset_index(drop=True)
    best = int((table["mae"] <= table["mae"].min() + 1e-12).to_numpy().argmax())  # of ties the largest penalty
    limit = table["mae"][best] + table["se"][best]
    one = int(((table["mae"] <= limit) & (table["l1_ratio"] == table["l1_ratio"][best])).to_numpy().argmax())
    return spark.createDataFrame([(float(r.l1_ratio), float(r.alpha), float(r.mae), float(r.se), i == best, i == one) for i, r in table.iterrows()], "l1_ratio double, alpha double, mae double, se double, rule_min boolean, rule_1se boolean")


@dataclass
class PlsModel:
    classes: list[int]
    x_mean: np.ndarray
    y_mean: np.ndarray
    rotation: np.ndarray
    coefficients: np.ndarray


def sparse_pls(vectors: DataFrame, p: int, classes: list[int], keep: list[int], eps: float = 1e-6) -> PlsModel:
    """Sparse PLS-DA from sums by class: components, deflation and rotation are all functions of the centred Gram matrices.

    Of each component's weights the `keep` largest stay. The first singular vector's largest weight is made positive.
    """
    rows = group_moments(vectors.select(F.col("y").cast("int").alias("cls"), "x", F.lit(0.0).alias("y"), F.lit(1.0).alias("w")), ["cls"], p).collect()
    cell = {r["cls"]: Moments.unpacked(r["moments"], p) for r in rows}
    classes = [c for c in classes if c in cell]
    whole = sum((cell[c] for c in classes[1:]), cell[classes[0]])
    n = whole.n
    mx, my = whole.x / n, np.array([cell[c].n / n for c in classes])
    a = whole.xx - n * np.outer(mx, mx)
    cross = np.stack([cell[c].x for c in classes], axis=1) - n * np.outer(mx, my)
    weights, loads, queues = [], [], []
    for k in keep:
        w = np.linalg.svd(cross, full_matrices=False)[0][:, 0]
        w = w * np.sign(w[np.abs(w).argmax()])
        drop = np.lexsort((np.arange(p), -np.abs(w)))[min(max(1, k), p) :]
        w[drop] = 0
        w /= np.linalg.norm(w)
        size = float(w @ a @ w)
        if size <= 0:
            raise ValueError("a component has no variance")
        load, queue = a @ w / size, cross.T @ w / size
        a, cross = a - size * np.outer(load, load), cross - size * np.outer(load, queue)
        weights.append(w), loads.append(load), queues.append(queue)
    W, P, Q = np.stack(weights, 1), np.stack(loads, 1), np.stack(queues, 1)
    rotation = W @ np.linalg.inv(P.T @ W + eps * np.eye(len(keep)))
    return PlsModel(list(classes), mx, my, rotation, rotation @ Q.T)


def _dot(x: Column, row: np.ndarray, constant: float = 0.0) -> Column:
    used = np.flatnonzero(row)
    return sum((x[int(i)] * float(row[i]) for i in used), F.lit(float(constant)))


def pls_scores(vectors: DataFrame, model: PlsModel) -> DataFrame:
    """Rows with `t` (component scores), `prob` (softmax of the dummy scores), `y_pred` (first of the likeliest) and `y_cont` (expected label)."""
    x = F.col("x")
    t = F.array(*[_dot(x, r, -float(model.x_mean @ r)) for r in model.rotation.T])
    z = F.array(*[_dot(x, b, float(m - model.x_mean @ b)) for b, m in zip(model.coefficients.T, model.y_mean, strict=True)])
    rows = vectors.withColumns({"t": t, "z": z})
    e = F.transform("z", lambda v: F.exp(v - F.array_max("z")))
    rows = rows.withColumn("e", e).withColumn("prob", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda s, u: s + u)))
    at = F.lit(model.classes)
    expect = F.aggregate(F.zip_with("prob", at, lambda q, c: q * c), F.lit(0.0), lambda s, u: s + u)
    return rows.withColumns({"y_pred": at[(F.array_position("prob", F.array_max("prob")) - 1).cast("int")].cast("int"), "y_cont": expect}).drop("z", "e")


def centroids(rows: DataFrame, h: int, keys: list[str]) -> DataFrame:
    """(keys, y, n, c): mean component scores by class, globally or by more keys."""
    return rows.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("t")[i]) for i in range(h)]).alias("c"))


def mixed_centroids(by_all: DataFrame, by_task: DataFrame, least: float = 10.0) -> DataFrame:
    """(task, y, c): task's centroid and the global one, weighted n/(n + least)."""
    both = by_task.withColumnsRenamed({"c": "ct"}).join(by_all.select("y", F.col("c").alias("cg")), "y")
    share = F.col("n") / (F.col("n") + least)
    return both.select("task", "y", "n", F.zip_with("ct", "cg", lambda a, b: share * a + (1 - share) * b).alias("c"))


def inverse_diagonal(rows: DataFrame, h: int, reg: float = 1e-3, pooled: bool = True) -> np.ndarray:
    """Diagonal of the inverse of the scores' covariance (within classes, or total) plus reg on its diagonal."""
    pairs = [(i, j) for i in range(h) for j in range(i, h)]
    agg = [F.sum(F.col("t")[i] * F.col("t")[j]).alias(f"s{i}_{j}") for i, j in pairs] + [F.sum(F.col("t")[i]).alias(f"m{i}") for i in range(h)] + [F.count(F.lit(1)).alias("n")]
    groups = rows.groupBy(*(["y"] if pooled else [])).agg(*agg).collect()
    cov, n = np.zeros((h, h)), sum(r["n"] for r in groups)
    for r in groups:
        m = np.array([r[f"m{i}"] for i in range(h)])
        for i, j in pairs:
            cov[i, j] += r[f"s{i}_{j}"] - m[i] * m[j] / r["n"]
    cov = np.triu(cov) + np.triu(cov, 1).T
    cov = cov / max(1, n - (len(groups) if pooled else 1))
    return np.diag(np.linalg.inv(cov + reg * np.eye(h))).copy()


def nearest_centroid(rows: DataFrame, table: DataFrame, classes: list[int], scale: np.ndarray | None = None, alpha: float = 1.0, by_task: bool = False) -> DataFrame:
    """Rows with `prob` = exp(-alpha d)/sum, `y_near` (nearest class) and `y_near_cont`; a class without a centroid has distance 1e9.

    With `scale` (diagonal of an inverse covariance) the distance is Mahalanobis as the models code it, on the diagonal alone; else Euclidean.
    """
    listed = table.groupBy(*(["task"] if by_task else [F.lit(0).alias("task")])).agg(F.map_from_entries(F.collect_list(F.struct("y", "c"))).alias("by"))
    joined = rows.join(F.broadcast(listed), "task") if by_task else rows.withColumn("__task", F.lit(0)).join(F.broadcast(listed.withColumnRenamed("task", "__task")), "__task").drop("__task")  # a row per task
    s = F.lit([float(v) for v in (scale if scale is not None else [])])
    def distance(c):
        mean = F.element_at("by", F.lit(c))
        gap = F.zip_with("t", mean, lambda a, b: (a - b) * (a - b))
        gap = F.zip_with(gap, s, lambda g, v: g * v) if scale is not None else gap
        return F.coalesce(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, v: a + v)), F.lit(1e9))
    d = joined.withColumn("d", F.array(*[distance(c) for c in classes])).drop("by")
    e = F.transform("d", lambda v: F.exp(-F.lit(float(alpha)) * (v - F.array_min("d"))))
    d = d.withColumn("e", e).withColumn("prob", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda a, u: a + u)))
    at = F.lit(classes)
    expect = F.aggregate(F.zip_with("prob", at, lambda q, c: q * c), F.lit(0.0), lambda a, u: a + u)
    return d.withColumns({"y_near": at[(F.array_position("d", F.array_min("d")) - 1).cast("int")], "y_near_cont": expect}).drop("e")


def tuning_score(rows: DataFrame, candidate: str, fold: str, classes: int, eta: float = 0.1) -> DataFrame:
    """(candidate, score, best): fold-size-weighted mean of -MAE + eta (kappa + Spearman + acc within 1); ties go to the smaller candidate."""
    from .metrics import ordinal_metrics

    m = ordinal_metrics(rows, [candidate, fold], classes)
    j = -F.col("mae") + eta * (F.col("kappa_quadratic") + F.col("spearman") + F.col("acc_pm1"))
    mean = m.groupBy(candidate).agg((F.sum(j * F.col("n")) / F.sum("n")).alias("score"))
    from pyspark.sql import Window

    return mean.withColumn("best", F.row_number().over(Window.orderBy(F.desc("score"), candidate)) == 1)


def choose_iteration(rows: DataFrame, classes: int, keep: int = 5) -> DataFrame:
    """(fold, iteration, mae, loss, rank): the candidates of each fold by (MAE, loss, iteration); rows have fold, iteration, y_true, y_pred, loss."""
    from pyspark.sql import Window

    m = rows.groupBy("fold", "iteration").agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"), F.avg("loss").alias("loss"))
    rank = F.row_number().over(Window.partitionBy("fold").orderBy(F.round("mae", 12), F.round("loss", 12), "iteration"))
    return m.withColumn("rank", rank).where(F.col("rank") <= keep)


def iteration_candidates(history: DataFrame, strategy: str, metric: str = "mae", top: int = 5, window: int = 10) -> DataFrame:
    """(fold, iteration) to choose among, from a training history (fold, iteration, value of `metric`).

    topk_reg: the `top` best iterations of a fold (ties: the earlier); window: those within `window` of the best; all: every one.
    Areas under a curve, mean average precision and NDCG are better when larger, all else when smaller.
    """
    from pyspark.sql import Window

    larger = any(name in metric.lower() for name in ("auc", "map", "ndcg"))
    place = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("value") if larger else F.asc("value"), "iteration"))
    ranked = history.where(F.col("value").isNotNull()).withColumn("__place", place)
    if strategy == "all":
        return history.select("fold", "iteration").distinct()
    if strategy == "topk_reg":
        return ranked.where(F.col("__place") <= max(1, top)).select("fold", "iteration")
    if strategy == "window":
        best = ranked.where("__place = 1").select("fold", F.col("iteration").alias("__best"))
        return history.select("fold", "iteration").distinct().join(best, "fold").where(F.abs(F.col("iteration") - F.col("__best")) <= max(0, window)).drop("__best")
    raise ValueError(f"strategy is 'topk_reg', 'window' or 'all', not {strategy!r}")


def balanced_weights(rows: DataFrame, y: str, name: str = "w") -> DataFrame:
    """Rows with the weight n / (classes x count of the row's class)."""
    counts = rows.groupBy(y).agg(F.count(F.lit(1)).alias("__c"))
    sums = counts.agg(F.sum("__c").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return rows.join(F.broadcast(counts), y).withColumn(name, F.lit(float(sums["n"] or 0)) / (F.lit(sums["k"]) * F.col("__c"))).drop("__c")  # a row per class


def logistic_grid(rows: DataFrame, fold: str, classes: int, cs: tuple[float, ...] = (0.1, 1.0, 10.0), weights: tuple[str, ...] = ("none", "balanced"), features: str = "t", y: str = "y") -> DataFrame:
    """(inverse_penalty, class_weight, n, nine metrics): for each setting, every fold predicted by a logistic regression of the other folds.

    All settings of all folds are fitted together, so the rows are read once a Newton step. Rows without a fold or class are left out.
    """
    from . import logistic
    from .lineage import settled
    from .metrics import ordinal_metrics

    known = rows.where(F.col(fold).isNotNull() & F.col(y).isNotNull())
    folds = sorted(r[0] for r in known.select(fold).distinct().collect())
    place = F.array_position(F.lit(folds), F.col(fold)).cast("int") if folds else F.lit(0)
    data = settled(known.select(place.alias("f"), F.col(y).cast("int").alias("y"), F.col(features).alias("x")))
    counts = data.groupBy("f", "y").count().collect()  # folds times classes
    levels = sorted({r["y"] for r in counts})
    first = data.select(F.size("x")).first()
    settings, named = [], []
    for f in range(1, len(folds) + 1):
        n = np.array([sum(r["count"] for r in counts if r["y"] == v and r["f"] != f) for v in levels], float)
        if not n.any():
            raise ValueError(f"no rows outside fold {folds[f - 1]!r}")
        balanced = np.where(n > 0, n.sum() / ((n > 0).sum() * np.maximum(n, 1)), 0.0)
        for c in cs:
            for weight in weights:
                settings.append((f, 1.0 / c, balanced if weight == "balanced" else (n > 0).astype(float)))
                named.append((f, f"{weight}:{c!r}"))
    fits = logistic.fit(data, settings, levels, first[0]) if first else []
    out = logistic.predicted(data, [(f, name, beta) for (f, name), beta in zip(named, fits, strict=True)], levels)
    parts = F.split("model", ":")
    out = out.select(parts[1].cast("double").alias("inverse_penalty"), parts[0].alias("class_weight"), "y_true", "y_pred", "y_cont")
    return ordinal_metrics(settled(out), ["inverse_penalty", "class_weight"], classes)


def logistic_postprocess(rows: DataFrame, features: str = "t", y: str = "y", c: float = 1.0, weight: str | None = None) -> DataFrame:
    """Rows with `prob` and `y_cont` (expected label) of a multinomial logistic regression on an array column, regParam 1/(C n)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.withColumns({"__v": array_to_vector(F.col(features)), "__y": F.col(y).cast("double")})
    n = rows.count()
    fit = LogisticRegression(featuresCol="__v", labelCol="__y", family="multinomial", standardization=False, regParam=1.0 / (c * max(n, 1)), probabilityCol="__p", rawPredictionCol="__r", predictionCol="__q", **({"weightCol": weight} if weight else {})).fit(data)
    out = fit.transform(data).withColumn("prob", vector_to_array("__p"))
    expect = F.aggregate(F.transform("prob", lambda q, i: q * i), F.lit(0.0), lambda a, v: a + v)
    return out.withColumns({"y_cont": expect, "y_pred": F.col("__q").cast("int")}).drop("__v", "__y", "__p", "__r", "__q")
