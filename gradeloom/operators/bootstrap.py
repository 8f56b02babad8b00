"""Bootstrap over clusters of rows: as many draws as there are clusters, exact ranks, one pass over the rows for all replicates.

Draws go down a tree: clusters lie in leaves by the first bits of their hash, and each node's draws are split between its halves by a
binomial of their numbers of clusters, those of a leaf evenly among its own. Every node draws from a generator of its own, so a
leaf's draws can be made anywhere, and are the same in any partitioning. A cluster then carries its numbers of draws in all replicates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settled
from .ranks import attached
from .sums import added
from .thresholds import scores_of

#: Clusters (about) of a leaf, and the most levels of the tree.
LEAF, DEPTH = 4096, 20
#: Replicates whose sums are one packed row, and those whose rank sums are made in one task.
BLOCK = 50
#: Rows whose draws a task multiplies at once, and those that it sorts before it hands on their ranks' shares.
ROWS, SORTED = 2000, 20_000
#: Distinct values of y_cont (about) of a range, and the most ranges.
RANGE_ROWS, RANGES = 50_000, 4096
#: Partitions, and then groups of them, whose packed weights of a range are added in one task.
FANS = (8, 64)
#: Bytes of packed weights that a task gathers before it adds them up.
HELD_BYTES = 64 << 20


def leaf_draws(counts: np.ndarray, leaf: int, resamples: int, seed: int) -> np.ndarray:
    """Draws (a number for each replicate) that reach a leaf; counts: clusters of each leaf, 2^depth of them."""
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    draws = np.full(resamples, before[-1])
    low, high, node = 0, len(counts), 1
    while high - low > 1:
        mid = (low + high) // 2
        left, all_of = before[mid] - before[low], before[high] - before[low]
        share = left / all_of if all_of else 0.0
        halved = np.random.Generator(np.random.Philox(key=[seed, node])).binomial(draws, share)
        if leaf < mid:
            draws, high, node = halved, mid, 2 * node
        else:
            draws, low, node = draws - halved, mid, 2 * node + 1
    return draws


def cluster_draws(counts: np.ndarray, leaf: int, resamples: int, seed: int) -> np.ndarray:
    """Numbers of draws, replicates x clusters, of the clusters of a leaf in the order of their hashes. A number beyond 255 is an error: 1 in 10^500."""
    draws = leaf_draws(counts, leaf, resamples, seed)
    of = int(counts[leaf])
    rng = np.random.Generator(np.random.Philox(key=[seed, (1 << 63) + leaf]))
    out = np.empty((resamples, of), np.uint8)
    for a in range(0, resamples, BLOCK):
        some = draws[a : a + BLOCK]
        at = np.repeat(np.arange(len(some)), some) * of + rng.integers(0, of, int(some.sum()))
        block = np.bincount(at, minlength=len(some) * of)
        if block.max(initial=0) > 255:
            raise ValueError("a cluster is drawn more than 255 times")
        out[a : a + BLOCK] = block.reshape(len(some), of)
    return out


def with_draws(rows: DataFrame, resamples: int, seed: int, name: str = "w") -> DataFrame:
    """`rows` with a byte for each replicate, how often their `cluster` is drawn in it; the first byte is a 1, for the rows as they are.

    Rows without a cluster go. Draws of frequent clusters are broadcast, so their rows stay where they are; the others' meet them in a join.
    """
    rows = settled(rows.where(F.col("cluster").isNotNull()))
    clusters = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("__rows")).withColumn("__hash", F.xxhash64("cluster"))
    total = clusters.count()
    depth = int(np.clip(np.ceil(np.log2(max(1, total) / LEAF)), 0, DEPTH))
    leaf = F.shiftrightunsigned("__hash", 64 - depth).cast("int") if depth else F.lit(0)
    clusters = settled(clusters.withColumn("__leaf", leaf))
    counts = np.zeros(1 << depth, np.int64)
    for r in clusters.groupBy("__leaf").count().collect():  # 2^DEPTH numbers at most
        counts[r["__leaf"]] = r["count"]

    def drawn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["__hash", "cluster"])
        w = cluster_draws(counts, int(frame["__leaf"].iloc[0]), resamples, seed).T
        w = np.concatenate([np.ones((len(w), 1), np.uint8), w], axis=1)
        return frame[["cluster", "__rows"]].assign(**{name: [row.tobytes() for row in w]})

    kind = rows.schema["cluster"].dataType.simpleString()
    table = clusters.groupBy("__leaf").applyInPandas(drawn, f"cluster {kind}, __rows long, `{name}` binary")
    return settled(attached(rows, settled(table), ["cluster"], "__rows"))


def draw_matrix(packed: pd.Series, width: int) -> np.ndarray:
    """Rows x replicates of the packed draws."""
    return np.frombuffer(b"".join(packed), np.uint8).reshape(-1, width)


def _moments(frame: pd.DataFrame, classes: int) -> np.ndarray:
    """rows x (classes squared + 5): the cell of the confusion table, and y, c and their products, times the rows' number."""
    y, pred, c, n = (frame[k].to_numpy(float) for k in ("y_true", "y_pred", "y_cont", "n"))
    out = np.zeros((len(frame), classes * classes + 5))
    out[np.arange(len(frame)), ((y - 1) * classes + pred - 1).astype(int)] = 1
    out[:, -5:] = np.stack([y, c, y * y, c * c, y * c], axis=1)
    return out * n[:, None]


def replicate_sums(rows: DataFrame, classes: int, width: int) -> DataFrame:
    """(block, sums): for each block of replicates the weighted sums of the rows' moments, as bytes of a matrix; rows: y_true, y_pred, y_cont, n, w."""

    def partial(frames):
        total, some = np.zeros((width, classes * classes + 5)), False
        for frame in frames:
            for a in range(0, len(frame), ROWS):
                part = frame.iloc[a : a + ROWS]
                total += draw_matrix(part["w"], width).T.astype(float) @ _moments(part, classes)
                some = True
        if some:
            first = range(0, width, BLOCK)
            yield pd.DataFrame({"block": np.arange(len(first)), "sums": [total[i : i + BLOCK].tobytes() for i in first], "part": TaskContext.get().partitionId()})

    return added(rows.mapInPandas(partial, "block long, sums binary, part long"), ["block"], "sums")


def merged(value: np.ndarray, group: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (value, class) pairs in ascending order, and their summed weights (pairs x replicates)."""
    order = np.lexsort((group, value))
    value, group = value[order], group[order]
    first = np.flatnonzero((np.diff(value, prepend=np.nan) != 0) | (np.diff(group, prepend=-1) != 0))
    return value[first], group[first], np.add.reduceat(weight[order], first, axis=0, dtype=np.uint32)


def packed_values(value: np.ndarray, group: np.ndarray, weight: np.ndarray, bounds: np.ndarray):
    """By range of the value: its distinct (value, class) pairs and their summed weights (pairs x replicates), in ascending order."""
    value, group, weight = merged(value, group, weight)
    at = np.searchsorted(bounds, value, side="left")
    cuts = np.flatnonzero(np.diff(at, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(value)], strict=True):
        yield int(at[a]), value[a:b], group[a:b], weight[a:b]


def range_sums(value: np.ndarray, group: np.ndarray, weight: np.ndarray, classes: int) -> np.ndarray:
    """replicates x (2 + 2 classes): of a range's rows their number, the squares of their average ranks about the range's mean, and by class the number and sum of these ranks."""
    order = np.argsort(value, kind="stable")
    value, group, weight = value[order], group[order], weight[order].astype(float)
    first = np.flatnonzero(np.diff(value, prepend=np.nan) != 0)
    at = np.cumsum(np.isin(np.arange(len(value)), first)) - 1
    n = np.add.reduceat(weight, first, axis=0)  # of each distinct value
    total = n.sum(axis=0)
    rank = np.cumsum(n, axis=0) - n / 2 - total / 2
    out = np.zeros((weight.shape[1], 2 + 2 * classes))
    out[:, 0], out[:, 1] = total, (n * rank * rank).sum(axis=0)
    for k in range(classes):
        inside = group == k + 1
        out[:, 2 + k] = weight[inside].sum(axis=0)
        out[:, 2 + classes + k] = (weight[inside] * rank[at[inside]]).sum(axis=0)
    return out


def rank_sums(rows: DataFrame, classes: int, width: int, bounds: np.ndarray, fans: tuple[int, ...] = ()) -> DataFrame:
    """(replicate, at, sums): `range_sums` of every range of y_cont in every replicate; rows: y_true, y_cont, n, w.

    Partitions add up the weights of equal values and hand them on packed by range and block of replicates: four bytes at most a distinct
    value of a partition and replicate, however many rows share it. `fans`: groups of so many partitions, then of groups, add theirs up.
    """

    def values(frames):
        held, size = None, 0
        for frame in frames:
            for a in range(0, len(frame), ROWS):
                part = frame.iloc[a : a + ROWS]
                weight = draw_matrix(part["w"], width) * part["n"].to_numpy(np.uint32)[:, None]
                more = merged(part["y_cont"].to_numpy(float), part["y_true"].to_numpy(), weight)
                held = [*(held or []), more]
                size += len(more[0])
                if size >= SORTED:
                    held = [merged(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > SORTED // 2:  # mostly distinct: waiting for more would merge little
                        yield from handed(*held[0])
                        held, size = None, 0
        if held:
            yield from handed(*merged(*map(np.concatenate, zip(*held, strict=True))))

    def handed(value, group, weight):
        part = TaskContext.get().partitionId()
        for at, value, group, w in packed_values(value, group, weight, bounds):
            blocks = range(0, width, BLOCK)
            yield pd.DataFrame({"at": at, "block": np.arange(len(blocks)), "v": value.tobytes(), "g": group.astype(np.uint8).tobytes(), "w": [np.ascontiguousarray(w[:, b : b + BLOCK]).tobytes() for b in blocks], "part": part})

    def unpacked(frame):
        value, group, weight = (np.concatenate([np.frombuffer(b, kind) for b in frame[c]]) for c, kind in (("v", float), ("g", np.uint8), ("w", np.uint32)))
        return value, group, weight.reshape(len(value), -1)

    def added_up(frame: pd.DataFrame) -> pd.DataFrame:
        held, size = [], 0
        for i in range(len(frame)):
            held.append(unpacked(frame.iloc[i : i + 1]))
            size += held[-1][2].nbytes
            if size > HELD_BYTES:
                held = [merged(*map(np.concatenate, zip(*held, strict=True)))]
                size = held[0][2].nbytes
        value, group, weight = merged(*map(np.concatenate, zip(*held, strict=True)))
        return frame[["at", "block", "part"]].iloc[:1].assign(v=[value.tobytes()], g=[group.astype(np.uint8).tobytes()], w=[np.ascontiguousarray(weight).tobytes()])

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        value, group, weight = merged(*unpacked(frame))
        first = int(frame["block"].iloc[0]) * BLOCK
        sums = range_sums(value, group, weight, classes)
        return pd.DataFrame({"replicate": first + np.arange(len(sums)), "at": frame["at"].iloc[0], "sums": list(sums)})

    kind = "at int, block int, part long, v binary, g binary, w binary"
    packed = rows.mapInPandas(values, "at int, block int, v binary, g binary, w binary, part long").select("at", "block", "part", "v", "g", "w")
    for fan in fans:  # so that no task holds the weights of all partitions
        packed = packed.withColumn("part", F.floor(F.col("part") / fan)).groupBy("at", "block", "part").applyInPandas(added_up, kind)
    return packed.groupBy("at", "block").applyInPandas(summed, "replicate long, at int, sums array<double>")


def spearman_of(sums: np.ndarray, classes: int) -> float:
    """Rank correlation from the sums of all ranges in ascending order; 0 where either side is constant."""
    n, squares, by_class, ranks = sums[:, 0], sums[:, 1], sums[:, 2 : 2 + classes], sums[:, 2 + classes :]
    off = np.cumsum(n) - n / 2 - n.sum() / 2
    of_class = by_class.sum(axis=0)
    rank = np.cumsum(of_class) - of_class / 2 - of_class.sum() / 2
    spread = (squares + n * off * off).sum() * (of_class * rank * rank).sum()
    return float(((ranks + by_class * off[:, None]).sum(axis=0) * rank).sum() / np.sqrt(spread)) if spread > 0 else 0.0


def intervals(rows: DataFrame, cluster: str, classes: int, resamples: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(metric, estimate, low, high, n_resamples) of nine ordinal metrics, clusters drawn with replacement, as many as there are.

    The estimate is that of the rows themselves. Rows without a cluster, or with a class outside 1..K or null, or y_cont null or NaN, are
    left out. Undefined metrics of a replicate count as 0. Fewer than two clusters: no interval. A cluster's rows may lie in any number of
    partitions; of frequent clusters the draws are broadcast. What is shuffled is a byte or two for each distinct row and replicate.
    """
    width = resamples + 1
    inside = F.col("y_true").between(1, classes) & F.col("y_pred").between(1, classes) & ~F.isnan(F.col("y_cont").cast("double"))
    outputs = [F.col("y_true").cast("int").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred"), F.col("y_cont").cast("double").alias("y_cont")]
    kept = rows.where(inside).select(F.col(cluster).alias("cluster"), *outputs)
    cells = with_draws(kept.groupBy(*kept.columns).agg(F.count(F.lit(1)).alias("n")), resamples, seed)

    values = cells.select("y_cont").distinct()
    distinct = values.count()
    ranges = int(np.clip(-(-distinct // RANGE_ROWS), 1, RANGES))
    shared = cells.count() > 4 * distinct  # else a range has few rows more than values
    bounds = np.array(values.agg(F.percentile_approx("y_cont", [k / ranges for k in range(1, ranges)], 20 * RANGES)).first()[0] if ranges > 1 else [], float)
    several = cells.select("cluster").distinct().limit(2).count() > 1

    def count_metrics(frames):
        for frame in frames:
            for block, data in zip(frame["block"], frame["sums"], strict=True):
                values = of_moments(np.frombuffer(data).reshape(-1, classes * classes + 5), classes)
                for name, v in values.items():
                    yield pd.DataFrame({"metric": name, "replicate": block * BLOCK + np.arange(len(v)), "value": v})

    def rank_metric(frame: pd.DataFrame) -> pd.DataFrame:
        sums = np.stack(frame.sort_values("at")["sums"].to_numpy())
        return pd.DataFrame({"metric": ["spearman"], "replicate": [frame["replicate"].iloc[0]], "value": [spearman_of(sums, classes)]})

    measured = "metric string, replicate long, value double"
    counted = replicate_sums(cells, classes, width).mapInPandas(count_metrics, measured)
    ranked = rank_sums(cells, classes, width, np.unique(bounds), FANS if shared else ())
    ranked = ranked.groupBy("replicate").applyInPandas(rank_metric, measured)
    own, again = F.col("replicate") == 0, F.when(F.col("replicate") > 0, F.col("value"))
    low, high = (F.percentile(again, F.lit(s)) if several else F.max(F.lit(None).cast("double")) for s in (alpha / 2, 1 - alpha / 2))
    return counted.union(ranked).groupBy("metric").agg(F.max(F.when(own, F.col("value"))).alias("estimate"), low.alias("low"), high.alias("high"), F.count(again).alias("n_resamples"))


def of_moments(m: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    """The eight metrics other than the rank correlation, of each row of summed moments."""
    out = scores_of(m[:, :-5].reshape(-1, classes, classes))
    out["kappa_quadratic"] = out.pop("qwk")
    n = np.maximum(m[:, :-5].sum(axis=1), 1e-300)
    mu, mv, uu, vv, uv = (m[:, -5:] / n[:, None]).T
    vu, vv, c = uu - mu**2, vv - mv**2, uv - mu * mv
    with np.errstate(divide="ignore", invalid="ignore"):
        out["ccc"] = np.where((vu > 0) & (vv > 0), 2 * c / (vu + vv + (mu - mv) ** 2), 0)
    return out
