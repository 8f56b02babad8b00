"""The draws of a bootstrap, made again outside Spark."""

import math

import numpy as np
from pyspark.sql import functions as F

from gradeloom.operators import bootstrap


def draws_by_cluster(rows, cluster, resamples, seed=0):
    """Numbers of draws of each cluster in all replicates."""
    some = rows.where(F.col(cluster).isNotNull()).select(F.col(cluster).alias("c")).distinct()
    listed = [(r["h"], r["c"]) for r in some.select("c", F.xxhash64("c").alias("h")).collect()]
    depth = min(bootstrap.DEPTH, max(0, math.ceil(math.log2(max(1, len(listed)) / bootstrap.LEAF))))
    leaves = [[] for _ in range(1 << depth)]
    for h, c in sorted(listed):
        leaves[(h % (1 << 64)) >> (64 - depth)].append(c)
    counts = np.array([len(x) for x in leaves])
    out = {}
    for k, held in enumerate(leaves):
        out.update(zip(held, bootstrap.cluster_draws(counts, k, resamples, seed).T.tolist(), strict=True))
    return out
