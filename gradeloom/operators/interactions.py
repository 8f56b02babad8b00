"""Which products of two features go with a residual, by rank: all pairs are bounded, and only those that may be among the best are ranked.

Ranks within a bucket of a pair's products are unknown, but they sum to a known number and spread no further than distinct ranks do. So
counts and sums of residual ranks by bucket hold the rank correlation between two bounds, with buckets fine or coarse. Each partition
sums them for a tile of pairs; no row per sample and pair is made. Rounds of finer buckets drop the pairs whose upper bound is under
the lower bounds of enough others. What is left is ranked exactly: each partition hands on the distinct products of a pair, packed
by ranges of the product, and a range's ranks start at the counts of the ranges before it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled
from .ranks import with_rank
from .sums import added

#: Buckets of the products in each round.
ROUNDS = (64, 1024)
#: Samples, chosen by hash, whose products' quantiles part buckets and ranges, and the bytes that they may have.
SAMPLED, SAMPLED_BYTES = 8192, 32_000_000
#: Bytes of a task's sums for a tile of pairs, and of the samples that it holds before it hands on their products.
HELD_BYTES = 32_000_000
#: Distinct products (about) of a range, and the most ranges of a pair.
RANGE_ROWS, RANGES = 200_000, 1024
#: Pairs whose sums are one packed row.
BLOCK = 64
#: Sums by bucket: samples, ranks of the residual, their squares.
SUMS = 3


def pair_indices(p: int) -> np.ndarray:
    """(i, j) with i < j of all pairs of p features, row by row."""
    return np.stack(np.triu_indices(p, 1), axis=1)


def edges(sample: np.ndarray, pair, buckets: int) -> np.ndarray:
    """Ascending bounds between buckets (fewer than `buckets`) at the quantiles of the sample's products."""
    z = np.sort(sample[:, pair[0]] * sample[:, pair[1]])
    return np.unique(z[(np.arange(1, buckets) * len(z)) // buckets]) if len(z) else z


def bucket_sums(x: np.ndarray, r: np.ndarray, pair, bounds: np.ndarray, buckets: int) -> np.ndarray:
    """SUMS x buckets: number, sum and sum of squares of the residual ranks `r` of the samples in each bucket."""
    at = np.searchsorted(bounds, x[:, pair[0]] * x[:, pair[1]], side="left")
    return np.stack([np.bincount(at, w, buckets) for w in (None, r, r * r)])


def rho_bounds(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of |rho| of each pair; sums: pairs x SUMS x buckets, of ranks about their mean."""
    n, s, ss = sums[:, 0], sums[:, 1], sums[:, 2]
    total = n.sum(axis=1, keepdims=True)
    middle = np.cumsum(n, axis=1) - n / 2 - total / 2  # a bucket's mean rank about the mean of all
    free = np.maximum(n**3 - n, 0) / 12  # most that ranks in a bucket spread about its mean
    inner = np.maximum(ss - np.divide(s * s, n, out=np.zeros_like(s), where=n > 0), 0)
    known, unknown = np.abs((middle * s).sum(axis=1)), np.sqrt(free * inner).sum(axis=1)
    least = (n * middle**2).sum(axis=1)
    spread = ss.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        low = np.maximum(known - unknown, 0) / np.sqrt((least + free.sum(axis=1)) * spread)
        high = (known + unknown) / np.sqrt(least * spread)
    return np.nan_to_num(low, nan=0.0, posinf=0.0), np.where(spread > 0, np.minimum(np.nan_to_num(high, nan=1.0, posinf=1.0), 1.0), 0.0)


def _sums_of(rows: DataFrame, sample: np.ndarray, pairs: np.ndarray, buckets: int) -> np.ndarray:
    """pairs x SUMS x buckets over all rows (x, r), a pass for each tile of pairs whose sums a task can hold."""
    size = SUMS * buckets
    tile = max(1, HELD_BYTES // (8 * size))
    out = np.zeros((len(pairs), SUMS, buckets))

    def summed(chosen):
        def run(frames):
            total, some = np.zeros((len(chosen), SUMS, buckets)), False
            bounds = [edges(sample, pair, buckets) for pair in chosen]
            for frame in frames:
                if len(frame):
                    some = True
                    x, r = np.stack(frame["x"].to_numpy()), frame["r"].to_numpy()
                    for k, pair in enumerate(chosen):
                        total[k] += bucket_sums(x, r, pair, bounds[k], buckets)
            if some:
                first = range(0, len(chosen), BLOCK)
                yield pd.DataFrame({"pair": first, "sums": [total[k : k + BLOCK].tobytes() for k in first], "part": TaskContext.get().partitionId()})

        return run

    for a in range(0, len(pairs), tile):
        parts = rows.mapInPandas(summed(pairs[a : a + tile]), "pair long, sums binary, part long")
        for row in added(parts, ["pair"], "sums").toLocalIterator():
            sums = np.frombuffer(row["sums"]).reshape(-1, SUMS, buckets)
            out[a + row["pair"] :][: len(sums)] = sums
    return out


def candidates(rows: DataFrame, sample: np.ndarray, p: int, top: int) -> np.ndarray:
    """The pairs whose |rho| may be among the `top` largest; rows: x, r (rank of the residual about the mean)."""
    pairs = pair_indices(p)
    for buckets in ROUNDS:
        if len(pairs) <= top:
            break
        low, high = rho_bounds(_sums_of(rows, sample, pairs, buckets))
        pairs = pairs[high >= np.sort(low)[-top] - 1e-6]
    return pairs


def packed_products(x: np.ndarray, r: np.ndarray, pair, bounds: np.ndarray) -> list[tuple[int, bytes]]:
    """By range of the product: its distinct values with their counts and sums of `r`, as bytes of a 3-row matrix."""
    z, inverse, n = np.unique(x[:, pair[0]] * x[:, pair[1]], return_inverse=True, return_counts=True)
    table = np.stack([z, n.astype(float), np.bincount(inverse, r, len(z))])
    at = np.searchsorted(bounds, z, side="left")
    cuts = np.flatnonzero(np.diff(at, prepend=-1))
    return [(int(at[a]), table[:, a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(z)], strict=True)]


def range_moments(tables: list[np.ndarray]) -> tuple[float, float, float, float]:
    """Of a range's packed tables: samples, sum of `r`, and of its own ranks (about their mean) the product with `r` and the square."""
    z, n, s = np.concatenate(tables, axis=1)
    _, at = np.unique(z, return_inverse=True)
    n, s = np.bincount(at, n), np.bincount(at, s)
    rank = np.cumsum(n) - n / 2 - n.sum() / 2
    return n.sum(), s.sum(), float((rank * s).sum()), float((n * rank * rank).sum())


def exact(rows: DataFrame, sample: np.ndarray, pairs: np.ndarray, n: int) -> DataFrame:
    """(i, j, rho): rank correlations of the pairs' products with the residual; 0 where either is constant."""
    ranges = int(np.clip(-(-n // RANGE_ROWS), 1, RANGES))

    def products(frames):
        bounds = [edges(sample, pair, ranges) for pair in pairs]
        held, size = [], 0
        for frame in frames:
            if len(frame):
                held.append((np.stack(frame["x"].to_numpy()), frame["r"].to_numpy()))
                size += held[-1][0].nbytes
            if size >= HELD_BYTES:
                yield from handed(held, bounds)
                held, size = [], 0
        if held:
            yield from handed(held, bounds)

    def handed(held, bounds):
        x, r = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        for k, pair in enumerate(pairs):
            found = packed_products(x, r, pair, bounds[k])
            yield pd.DataFrame({"pair": k, "at": [at for at, _ in found], "table": [t for _, t in found]})

    def ranked(frame: pd.DataFrame) -> pd.DataFrame:
        moments = range_moments([np.frombuffer(t).reshape(3, -1) for t in frame["table"]])
        return pd.DataFrame([(frame["pair"].iloc[0], frame["at"].iloc[0], *map(float, moments))], columns=["pair", "at", "n", "s", "own", "square"])

    packed = rows.mapInPandas(products, "pair int, at int, table binary")
    parts = packed.groupBy("pair", "at").applyInPandas(ranked, "pair int, at int, n double, s double, own double, square double")
    of_pair = Window.partitionBy("pair")
    start = F.coalesce(F.sum("n").over(of_pair.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    parts = parts.withColumn("off", start + F.col("n") / 2 - F.sum("n").over(of_pair) / 2)  # a range's mean rank about the mean of all
    sums = parts.groupBy("pair").agg(F.sum(F.col("own") + F.col("off") * F.col("s")).alias("xy"), F.sum(F.col("square") + F.col("n") * F.col("off") * F.col("off")).alias("xx"))
    yy = rows.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    of = F.lit([int(i) for i in pairs[:, 0]]), F.lit([int(j) for j in pairs[:, 1]])
    rho = F.coalesce(F.try_divide("xy", F.sqrt(F.col("xx") * F.lit(float(yy)))), F.lit(0.0))
    return sums.select(of[0][F.col("pair")].alias("i"), of[1][F.col("pair")].alias("j"), rho.alias("rho"))


def interactions(vectors: DataFrame, names: list[str], residual: str, top: int = 20) -> DataFrame:
    """(feature1, feature2, rho, abs_rho): the `top` pairs whose product's ranks go most with those of the residual; ties by names.

    vectors: (x array in the order of names, residual). Samples with a missing residual or feature are left out; with fewer than three
    samples or two features there are no pairs. Products of equal value share their rank, and a constant product has rho 0. Every sample
    is read once for each round of a tile of pairs (all 2,016 pairs of 64 features: ten tiles at most), and what is shuffled are sums,
    and the distinct products of the pairs that are left.
    """
    x = F.transform("x", lambda v: v.cast("double"))
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))
    y = F.col(residual).cast("double")
    ranked = with_rank(vectors.where(whole & ~F.isnan(y)).select(x.alias("x"), y.alias("y")), [], "y")
    n = ranked.count()
    rows = settled(ranked.select("x", (F.col("rank") - (n + 1) / 2).alias("r")))
    spark, schema = vectors.sparkSession, "feature1 string, feature2 string, rho double, abs_rho double"
    if n < 3 or len(names) < 2 or top < 1:
        return spark.createDataFrame([], schema)
    most = max(64, min(SAMPLED, SAMPLED_BYTES // (8 * len(names))))
    chosen = rows if n <= most else rows.where(F.shiftrightunsigned(F.xxhash64("x", F.lit(3)), 1) < F.lit((most << 63) // n)).limit(4 * most)
    sample = np.array([r["x"] for r in chosen.select("x").collect()], float).reshape(-1, len(names))
    cells = exact(rows, sample, candidates(rows, sample, len(names), top), n)
    at = F.lit(names)
    out = cells.select(at[F.col("i")].alias("feature1"), at[F.col("j")].alias("feature2"), "rho", F.abs("rho").alias("abs_rho"))
    return out.orderBy(F.desc(F.round("abs_rho", 9)), "feature1", "feature2").limit(top)
