"""Gram matrices of many features by tiles, and their leading eigenvectors, without a row per cell and without the matrix on the driver.

A partition sums the products of column tiles, packed; tiles are added in two levels and stay a table of packed rows. Where the tiles of
a matrix don't fit a task together, they go in several passes over the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settled
from .sums import added

#: Columns of a tile, and bytes of the tiles that a task may hold.
TILE, HELD_BYTES = 512, 256 << 20
#: Rows that are multiplied at once.
ROWS = 1000
#: Features up to which eigenvectors are found from the whole matrix (32 MB) on the driver.
DENSE = 2048
#: Vectors beyond those wanted, products with the matrix before a restart, and restarts at most.
SPARE, PRODUCTS, RESTARTS = 16, 8, 40


def tiles(p: int, tile: int) -> list[tuple[int, int]]:
    """(i, j) with i <= j: tiles on and above the diagonal."""
    n = -(-p // tile)
    return [(i, j) for i in range(n) for j in range(i, n)]


def gram(rows: DataFrame, p: int, column: str = "x", tile: int | None = None) -> DataFrame:
    """(i, j, cells): tiles on and above the diagonal of the sum of x x' over rows with arrays of `p` doubles, as bytes. No rows give no tiles."""
    tile = tile or TILE
    every = tiles(p, tile)
    if not every:
        return rows.sparkSession.createDataFrame([], "i int, j int, cells binary")
    at_once = max(1, HELD_BYTES // (8 * min(tile, p) ** 2))
    cut = lambda x, k: x[:, k * tile : (k + 1) * tile]

    def summed(chosen):
        def run(frames):
            held: dict[tuple[int, int], np.ndarray] = {}
            for frame in frames:
                for a in range(0, len(frame), ROWS):
                    x = np.stack(frame[column].to_numpy()[a : a + ROWS]).astype(float)
                    for i, j in chosen:
                        product = cut(x, i).T @ cut(x, j)
                        held[i, j] = held[i, j] + product if (i, j) in held else product
            if held:
                part = TaskContext.get().partitionId()
                for (i, j), cells in held.items():
                    yield pd.DataFrame({"i": [i], "j": [j], "cells": [cells.tobytes()], "part": [part]})

        return run

    out = None
    for a in range(0, len(every), at_once):
        part = added(rows.select(column).mapInPandas(summed(every[a : a + at_once]), "i int, j int, cells binary, part long"), ["i", "j"], "cells")
        out = part if out is None else out.unionByName(part)
    return settled(out)


def _shape(i: int, j: int, p: int, tile: int) -> tuple[int, int]:
    return min(tile, p - i * tile), min(tile, p - j * tile)


def cells(matrix: DataFrame, p: int, tile: int | None = None) -> DataFrame:
    """(i, j, x) for i < j: what lies above the diagonal, as rows."""
    tile = tile or TILE

    def run(frames):
        for frame in frames:
            for i, j, packed in zip(frame["i"], frame["j"], frame["cells"], strict=True):
                x = np.frombuffer(packed).reshape(_shape(i, j, p, tile))
                a, b = np.triu_indices(len(x), 1) if i == j else map(np.ravel, np.indices(x.shape))
                yield pd.DataFrame({"i": a + i * tile, "j": b + j * tile, "x": x[a, b]})

    return matrix.mapInPandas(run, "i int, j int, x double")


def over(matrix: DataFrame, p: int, threshold: float, tile: int | None = None) -> DataFrame:
    """(i, j, x) for i < j with |x| over the threshold; no other cell becomes a row."""
    tile = tile or TILE

    def run(frames):
        for frame in frames:
            for i, j, packed in zip(frame["i"], frame["j"], frame["cells"], strict=True):
                x = np.frombuffer(packed).reshape(_shape(i, j, p, tile))
                a, b = np.nonzero(np.abs(np.triu(x, 1) if i == j else x) > threshold)
                yield pd.DataFrame({"i": a + i * tile, "j": b + j * tile, "x": x[a, b]})

    return matrix.mapInPandas(run, "i int, j int, x double")


def extremes(matrix: DataFrame, p: int, threshold: float, tile: int | None = None) -> DataFrame:
    """(i, most, n): of each feature the largest |x| with another, and with how many it is over the threshold; a row a feature and tile is added up."""
    tile = tile or TILE

    def run(frames):
        for frame in frames:
            for i, j, packed in zip(frame["i"], frame["j"], frame["cells"], strict=True):
                x = np.abs(np.frombuffer(packed).reshape(_shape(i, j, p, tile)))
                if i == j:
                    x = x.copy()
                    np.fill_diagonal(x, -1.0)
                for k, y in ((i, x), *([(j, x.T)] if i < j else [])):
                    yield pd.DataFrame({"i": k * tile + np.arange(len(y)), "most": y.max(axis=1), "n": (y > threshold).sum(axis=1)})

    each = matrix.mapInPandas(run, "i int, most double, n long").where("most >= 0")  # a lone feature has no other
    return each.groupBy("i").agg(F.max("most").alias("most"), F.sum("n").alias("n"))


def dense(matrix: DataFrame, p: int, tile: int | None = None) -> np.ndarray:
    """The whole matrix on the driver, for few features."""
    tile = tile or TILE
    out = np.zeros((p, p))
    for r in matrix.toLocalIterator():
        a, b = r["i"] * tile, r["j"] * tile
        x = np.frombuffer(r["cells"]).reshape(_shape(r["i"], r["j"], p, tile))
        out[a : a + len(x), b : b + x.shape[1]] = x
    return np.triu(out) + np.triu(out, 1).T


def times(matrix: DataFrame, q: np.ndarray, tile: int | None = None) -> np.ndarray:
    """The matrix times q (features x vectors); every tile is multiplied where it lies."""
    tile = tile or TILE
    p, k = q.shape

    def run(frames):
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for i, j, packed in zip(frame["i"], frame["j"], frame["cells"], strict=True):
                x = np.frombuffer(packed).reshape(_shape(i, j, p, tile))
                for to, part in ((i, x @ q[j * tile : (j + 1) * tile]), *([(j, x.T @ q[i * tile : (i + 1) * tile])] if i < j else [])):
                    held[to] = held[to] + part if to in held else part
        for to, part in held.items():
            yield pd.DataFrame({"i": [to], "y": [part.tobytes()], "part": [TaskContext.get().partitionId()]})

    out = np.zeros((p, k))
    for r in added(matrix.mapInPandas(run, "i int, y binary, part long"), ["i"], "y").toLocalIterator():
        y = np.frombuffer(r["y"]).reshape(-1, k)
        out[r["i"] * tile :][: len(y)] = y
    return out


def trace(matrix: DataFrame, p: int, tile: int | None = None) -> float:
    tile = tile or TILE

    @F.pandas_udf("double")
    def diagonal(i: pd.Series, packed: pd.Series) -> pd.Series:
        return pd.Series([np.trace(np.frombuffer(c).reshape(_shape(k, k, p, tile))) for k, c in zip(i, packed, strict=True)])

    return float(matrix.where("i = j").agg(F.sum(diagonal("i", "cells"))).first()[0] or 0.0)


def leading(matrix: DataFrame, p: int, k: int, tile: int | None = None, tolerance: float = 1e-9, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns): the k largest eigenvalues of the positive semidefinite matrix, in descending order.

    Of at most DENSE features they come from the whole matrix. Beyond, a block of vectors is multiplied again and again, and the best
    vectors of all these products together start the next round; it ends when what is left over by each wanted vector is `tolerance` of the
    largest value (ValueError if it never is). The driver holds (PRODUCTS + 1) (k + SPARE) vectors.
    """
    k = min(k, p)
    if p <= DENSE:
        values, basis = np.linalg.eigh(dense(matrix, p, tile))
        return values[::-1][:k], basis[:, ::-1][:, :k]
    start = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, min(p, k + SPARE))))[0]
    for _ in range(RESTARTS):
        basis, images, block = [], [], start
        for _ in range(PRODUCTS):
            image = times(matrix, block, tile)
            basis.append(block)
            images.append(image)
            known = np.concatenate(basis, axis=1)
            rest = image - known @ (known.T @ image)
            rest -= known @ (known.T @ rest)  # once more, for digits
            u, s, _ = np.linalg.svd(rest, full_matrices=False)
            block = u[:, s > 1e-12 * max(1e-300, np.abs(image).max())]
            if not block.shape[1] or known.shape[1] + block.shape[1] > p:
                break
        q, gq = np.concatenate(basis, axis=1), np.concatenate(images, axis=1)
        inner = q.T @ gq
        values, w = np.linalg.eigh((inner + inner.T) / 2)
        values, w = values[::-1], w[:, ::-1]
        vectors = q @ w[:, :k]
        left = np.linalg.norm(gq @ w[:, :k] - vectors * values[:k], axis=0)
        if (left <= tolerance * max(values[0], 1e-300)).all():
            return values[:k], vectors
        start = np.linalg.qr(q @ w[:, : min(w.shape[1], k + SPARE)])[0]
    raise ValueError(f"eigenvectors are not settled after {RESTARTS} rounds")
