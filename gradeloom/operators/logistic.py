"""Multinomial logistic regressions of many settings at once: every Newton step of all of them is one pass over the rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sums import added

#: Rows that are multiplied at once, passes at most, and the step's gain (as a share of the loss) at which a fit is done.
ROWS, PASSES, GAIN = 5000, 100, 1e-12


def _chances(x: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows x classes, and the logarithms of their scale; beta: classes x columns of x, the last of them 1; a class that a fit has not has -inf there."""
    z = x[:, :-1] @ beta[:, :-1].T + beta[:, -1]
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - top)
    return e / e.sum(axis=1, keepdims=True), z - top - np.log(e.sum(axis=1, keepdims=True))


def _design(x: pd.Series) -> np.ndarray:
    x = np.stack(x.to_numpy()).astype(float)
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def _sums(data: DataFrame, models: dict[int, tuple[int, np.ndarray, np.ndarray]], classes: np.ndarray) -> dict[int, np.ndarray]:
    """By model, (loss, gradient, curvature) flat; models: (fold left out, weight of each class, beta); data: f, y, x."""

    def run(frames):
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for a in range(0, len(frame), ROWS):
                part = frame.iloc[a : a + ROWS]
                x, f = _design(part["x"]), part["f"].to_numpy()
                at = np.searchsorted(classes, part["y"].to_numpy())
                xx = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                for m, (left_out, weight, beta) in models.items():
                    w = np.where(f == left_out, 0.0, weight[at])
                    used = w > 0
                    p, logs = _chances(x[used], beta)
                    wu, au, k, d = w[used], at[used], len(classes), x.shape[1]
                    loss = -(wu * logs[np.arange(len(au)), au]).sum()
                    gap = p * wu[:, None]
                    gap[np.arange(len(au)), au] -= wu
                    pairs = -(p[:, :, None] * p[:, None, :]) * wu[:, None, None]
                    pairs[:, np.arange(k), np.arange(k)] += p * wu[:, None]
                    curve = (pairs.reshape(len(p), -1).T @ xx[used]).reshape(k, k, d, d).transpose(0, 2, 1, 3)
                    out = np.concatenate([[loss], (gap.T @ x[used]).ravel(), curve.ravel()])
                    total[m] = total[m] + out if m in total else out
        if total:
            yield pd.DataFrame({"m": list(total), "sums": [v.tobytes() for v in total.values()], "part": TaskContext.get().partitionId()})

    parts = data.mapInPandas(run, "m int, sums binary, part long")
    return {r["m"]: np.frombuffer(r["sums"]) for r in added(parts, ["m"], "sums").collect()}  # a row a model


def fit(data: DataFrame, settings: list[tuple[int, float, np.ndarray]], classes: list[int], width: int) -> list[np.ndarray]:
    """Weights (classes x columns and intercept) of each setting (fold left out, penalty, weight of each class, 0 where the fit has none).

    Each minimises the weighted loss plus half the penalty times its squared weights without the intercepts. data: f int, y int, x array of
    `width` doubles. A step that does not lower the loss is halved. ValueError if a fit is not settled after PASSES passes.
    """
    k, d, at = len(classes), width + 1, np.array(classes)
    shrink = np.tile(np.append(np.ones(width), 0.0), k)
    shut = [np.where(weight > 0, 0.0, -np.inf) for _, _, weight in settings]  # intercepts of the classes that a fit has not
    shaped = lambda flat, m: flat.reshape(k, d) + np.pad(shut[m][:, None], ((0, 0), (width, 0)))
    now = [shaped(np.zeros(k * d), m) for m in range(len(settings))]
    held: list[tuple | None] = [None] * len(settings)  # what was reached, its loss and the step from there
    open_ = set(range(len(settings)))
    for _ in range(PASSES):
        found = _sums(data, {m: (settings[m][0], settings[m][2], now[m]) for m in sorted(open_)}, at)
        for m in sorted(open_):
            _, penalty, weight = settings[m]
            there = np.repeat(weight > 0, d)
            flat = np.where(there, now[m].ravel(), 0.0)
            sums = found[m]
            loss = sums[0] + penalty / 2 * (shrink * flat**2).sum()
            if held[m] is not None and loss > held[m][1] * (1 + 1e-13):
                base, before, step = held[m]
                held[m] = (base, before, step / 2)
                if np.abs(step).max() < 1e-12 * max(1.0, np.abs(base).max()):
                    now[m] = shaped(base, m)
                    open_.discard(m)
            else:
                slope = (sums[1 : 1 + k * d] + penalty * shrink * flat)[there]
                curve = (sums[1 + k * d :].reshape(k * d, k * d) + np.diag(penalty * shrink))[np.ix_(there, there)]
                step = np.zeros(k * d)
                step[there] = -np.linalg.pinv(curve, rcond=1e-13, hermitian=True) @ slope  # a shift of all intercepts changes nothing
                held[m] = (flat, loss, step)
                if -step[there] @ slope <= GAIN * max(loss, 1e-300):
                    open_.discard(m)
                    continue
            if m in open_:
                base, _, step = held[m]
                now[m] = shaped(base + step, m)
        if not open_:
            return now
    raise ValueError(f"{len(open_)} fits are not settled after {PASSES} passes")


def predicted(data: DataFrame, models: list[tuple[int, str, np.ndarray]], classes: list[int]) -> DataFrame:
    """(model, y_true, y_pred, y_cont): rows of each model's own fold, the likeliest class (the first of several) and the expected one; models: (fold, name, beta)."""
    at = np.array(classes)

    def run(frames):
        for frame in frames:
            for f, name, beta in models:
                part = frame[frame["f"] == f]
                for a in range(0, len(part), ROWS):
                    some = part.iloc[a : a + ROWS]
                    p, _ = _chances(_design(some["x"]), beta)
                    yield pd.DataFrame({"model": name, "y_true": some["y"], "y_pred": at[p.argmax(axis=1)], "y_cont": p @ at})

    return data.mapInPandas(run, "model string, y_true int, y_pred int, y_cont double")
