"""Ordered cut points of a score by Newton steps, each one aggregation over the rows for all keys together."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import settled

#: Log odds of a bound that no row, or every row, is over.
FAR = float(np.log(1e6))
LEAST_SLOPE = 1e-3


@dataclass
class _Fit:
    """The state of one key: parameters (slope, then intercepts), the step tried from them, and the best ones by the held-out loss."""

    x: np.ndarray
    free: np.ndarray
    mean: float
    step: np.ndarray = field(init=False)
    loss: float = np.inf
    best: np.ndarray = field(init=False)
    best_loss: float = np.inf
    worse: int = 0
    done: bool = False

    def __post_init__(self):
        self.step, self.best = np.zeros_like(self.x), self.x

    def trial(self) -> np.ndarray:
        return self.x + self.step

    def take(self, loss: float, held_loss: float | None, gradient: np.ndarray, hessian: np.ndarray, patience: int, tolerance: float) -> None:
        """The loss and its derivatives at the trial: take it and step on, or try half the step."""
        if loss > self.loss + 1e-12 * abs(self.loss):
            self.step = self.step / 2
            self.done = np.abs(self.step).max() < tolerance
            return
        self.x, self.loss = self.trial(), loss
        if held_loss is None or held_loss < self.best_loss:
            self.best, self.best_loss, self.worse = self.x, loss if held_loss is None else held_loss, 0
        else:
            self.worse += 1
        free = self.free.copy()
        free[0] &= self.x[0] > LEAST_SLOPE + 1e-9 or gradient[0] < 0  # at the least slope it only may rise
        self.step = np.zeros_like(self.x)
        if free.any():
            h = hessian[np.ix_(free, free)]
            self.step[free] = np.linalg.solve(h + 1e-12 * np.trace(h) / len(h) * np.eye(len(h)), -gradient[free])
        if self.x[0] + self.step[0] < LEAST_SLOPE:  # the same direction, up to the least slope
            self.step *= (LEAST_SLOPE - self.x[0]) / self.step[0]
        self.done = np.abs(self.step).max() < tolerance or self.worse >= patience

    def theta(self) -> list[float]:
        """Cut points; a bound that isn't fitted keeps its distance from the mean score, in log odds."""
        at = np.where(self.free[1:], -self.best[1:], self.mean * self.best[0] - (self.best[1:] + self.mean)) / self.best[0]
        return [float(t) for t in np.maximum.accumulate(at)]


def _sums(classes: int) -> list[Column]:
    """Of each bound the loss and its derivatives by its intercept and the slope, and the loss of the rows held out."""
    s, w, v = F.col("s"), F.when(F.col("held"), 0.0).otherwise(F.col("w")), F.when(F.col("held"), F.col("w")).otherwise(0.0)
    out = []
    for k in range(1, classes):
        z = F.col("x")[0] * s + F.col("x")[k]
        p = 1 / (1 + F.exp(-z))
        miss = p - (F.col("y") > k).cast("double")
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - (F.col("y") > k).cast("double") * z
        spread = w * p * (1 - p)
        out += [F.sum(c).alias(f"{name}{k}") for name, c in (("g", w * miss), ("gs", w * miss * s), ("h", spread), ("hs", spread * s), ("hss", spread * s * s), ("loss", w * loss), ("held_loss", v * loss))]
    return [*out, F.sum(v).alias("held_w")]


def fit_thresholds(rows: DataFrame, keys: list[str], classes: int, *, slope: bool = False, weight: str | None = None, held_out: float = 0.0, by: str | None = None, patience: int = 5, rounds: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """(keys, theta, slope, n_rounds): ordered cut points t_k, and a slope a > 0 if wanted, of P(y > k) = sigmoid(a (s - t_k)), by the weighted loss summed over bounds.

    rows: keys, s, y_true (1..classes). The loss is convex; steps that raise it are halved. With `held_out`, so large a share of the rows,
    chosen by a hash of the column `by`, teaches nothing, and the parameters of the step with the least loss on it are returned; `patience` steps
    without a gain end the fit. A bound that no row or every row is over lies where the mean score has a chance of one in a million.
    Rows with a null or NaN score, weight or key, or another class, are left out. The driver sees a row of sums a key and round.
    """
    s, y, w = F.col("s").cast("double"), F.col("y_true").cast("int"), (F.col(weight) if weight else F.lit(1.0)).cast("double")
    held = F.shiftrightunsigned(F.xxhash64(F.col(by), F.lit(41)), 11) < F.lit(int(held_out * (1 << 53))) if held_out else F.lit(False)
    data = rows.where(y.between(1, classes)).select(*keys, s.alias("s"), y.alias("y"), w.alias("w"), held.alias("held")).dropna()
    data = settled(data if keys else data.withColumn("__all", F.lit(1)))
    names = keys or ["__all"]
    taught = data.where(~F.col("held")).groupBy(*names).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("s")).alias("ws"), *[F.sum(F.when(F.col("y") > k, F.col("w")).otherwise(0.0)).alias(f"over{k}") for k in range(1, classes)])
    fits: dict[tuple, _Fit] = {}
    for r in taught.where("w > 0").collect():
        share = np.array([r[f"over{k}"] / r["w"] for k in range(1, classes)])
        inside = (share > 0) & (share < 1)
        odds = np.where(inside, np.log(np.where(inside, share, 0.5) / (1 - np.where(inside, share, 0.5))), np.where(share > 0, FAR, -FAR))
        fits[tuple(r[k] for k in names)] = _Fit(np.concatenate([[1.0], odds - r["ws"] / r["w"]]), np.concatenate([[slope and inside.any()], inside]), r["ws"] / r["w"])
    taken = dict.fromkeys(fits, 0)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.select(*names).schema)
    for _ in range(rounds):
        going = [(*key, [float(v) for v in f.trial()]) for key, f in fits.items() if not f.done]
        if not going:
            break
        now = F.broadcast(data.sparkSession.createDataFrame(going, f"{kinds}, x array<double>"))
        for r in data.join(now, names).groupBy(*names).agg(*_sums(classes)).collect():
            key = tuple(r[k] for k in names)
            at = lambda name: np.array([r[f"{name}{k}"] for k in range(1, classes)]) * fits[key].free[1:]  # noqa: B023, E731
            hessian = np.diag(np.concatenate([[at("hss").sum()], at("h")]))
            hessian[0, 1:] = hessian[1:, 0] = at("hs")
            fits[key].take(at("loss").sum(), at("held_loss").sum() if r["held_w"] > 0 else None, np.concatenate([[at("gs").sum()], at("g")]), hessian, patience, tolerance)
            taken[key] += 1
    out = [(*key, f.theta(), float(f.best[0]), taken[key]) for key, f in fits.items()]
    return data.sparkSession.createDataFrame(out, f"{kinds}, theta array<double>, slope double, n_rounds int").select(*keys, "theta", "slope", "n_rounds")
