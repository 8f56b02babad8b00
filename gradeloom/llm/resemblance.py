"""Links between texts whose five-word shingle sets reach a resemblance, by banded MinHash and exact verification.

Texts of resemblance r share a given band of ROWS minima with probability r^ROWS; at 0.8 all BANDS are missed once in 38,000 pairs.
Candidates are verified on their whole shingle sets. Within a band key of more than CROWD texts all are compared with two of them first,
which links whole groups of copies. Where that leaves a key's texts in several components, their pairs across components are found
by common rare shingles: every shingle has a place in one order, rare ones first, and two texts of the resemblance share one among the
first of both. That is exact, so a crowded key loses no link. Pairs that cannot reach the resemblance by their sizes, by what follows
the shingle or by the bits of both sets are left out where they meet; and of a text's pairs with one component the best is
verified first, so that the rest is asked only of components that are still apart.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCKS, blocks, rows_in, saved, tree_sum
from .components import components

SHINGLE = 5
RESEMBLANCE = 0.8
BANDS, ROWS = 20, 4
#: Texts of a key whose pairs are listed; those of a shingle that are compared with as many others at once; and rows of such tiles in a task.
CROWD, TILE, TASK_ROWS = 32, 2048, 8_000
#: Words of 64 bits in which a set's shingles are marked.
MARKS = 64
#: Buckets of the shingles' counts, which make the order.
BUCKETS = 1 << 21
#: Candidates of one text that are verified together.
PART = 1000
#: Slack of sizes against rounding.
SLACK = 1e-6

_MIX = np.random.default_rng(5).integers(0, 1 << 64, (BANDS * ROWS, 2), np.uint64)
_MIX[:, 0] |= np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, a wordless one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[j:] for j in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(0)), np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Keys (sets x BANDS) of sets that are not empty."""
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    start = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for a, b in _MIX[band * ROWS : (band + 1) * ROWS]:
            key = (key ^ np.minimum.reduceat((flat ^ b) * a, start)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out


def band_table(docs: DataFrame) -> DataFrame:
    """Distinct (node, key) of the nodes of `docs` (node, text) that have words."""

    def keyed(frames):
        for frame in rows_in(frames, size=2_000_000):
            sets = [shingle_set(t) for t in frame["text"]]
            full = [k for k, s in enumerate(sets) if len(s)]
            if full:
                keys = band_keys([sets[k] for k in full])
                yield pd.DataFrame({"node": np.repeat(frame["node"].to_numpy()[full], BANDS), "key": keys.view(np.int64).ravel()})

    return docs.select("node", "text").mapInPandas(keyed, "node long, key long").distinct()


def _ordered(pairs: DataFrame, *more: str) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *more)


def first_candidates(bands: DataFrame, busy: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: all pairs of keys of at most CROWD nodes, and of larger ones those with either of two nodes, drawn anew for each key."""
    calm = bands.join(busy.where(F.col("n") <= CROWD).select("key"), "key")
    few = calm.select("key", F.col("node").alias("a")).join(calm.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
    many = bands.join(busy.where(F.col("n") > CROWD).select("key", "heads"), "key").select(F.col("node").alias("a"), F.explode("heads").alias("b")).where("a != b")
    return few.union(_ordered(many)).distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows of `pairs` (a, b) whose sets resemble each other by `least` or more. A text of many candidates meets them in parts of PART."""

    def with_set(rows: DataFrame, end: str, name: str) -> DataFrame:
        parts = rows.groupBy(F.col(end).alias("node")).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
        many = saved(parts.where("parts > 1"), "hot-ends")  # fewer than one in PART of the rows
        other = "b" if end == "a" else "a"
        rows = rows.join(many.withColumnRenamed("node", end), end, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1)))).drop("parts")
        held = sets.join(many, "node", "left").select(F.col("node").alias(end), F.col("set").alias(name), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)).alias("part"))
        return rows.join(held, [end, "part"]).drop("part")

    def verify(frames):
        for frame in frames:
            near = []
            for x, y in zip(frame["x"], frame["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= least * max(len(x), len(y)) else 0
                near.append(both >= least * (len(x) + len(y) - both))
            yield frame.loc[near, ["a", "b"]]

    return with_set(with_set(pairs, "a", "x"), "b", "y").select("a", "b", "x", "y").mapInPandas(verify, "a long, b long")


def rooted(rows: DataFrame, links: DataFrame, *more: str) -> DataFrame:
    """(more, node, root): `rows` with the component of their node by `links`."""
    roots = components(links).withColumnRenamed("node", "__node")
    return rows.join(roots, F.col("node") == F.col("__node"), "left").select(*more, "node", F.coalesce("root", "node").alias("root"))


def unresolved(bands: DataFrame, busy: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of nodes in a key of more than CROWD whose nodes `links` leave in several components."""
    members = bands.join(busy.where(F.col("n") > CROWD).select("key"), "key")
    members = saved(rooted(members, links, "key"), "crowds")
    split = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return members.join(split, "key", "left_semi").select("node", "root").distinct()


def _marked(x: np.ndarray) -> bytes:
    """Bits of a set, one for each hash value of its shingles that occurs."""
    bits = np.zeros(64 * MARKS, bool)
    bits[((x >> np.uint64(32)) % np.uint64(64 * MARKS)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def rare_first(sets: DataFrame, least: float) -> DataFrame:
    """(shingle, node, size, pos, marks): of each set (node, set) the shingles that come first, as many as must hold one that any set of the resemblance shares.

    The order is by counts of hash buckets over all these sets, rare ones first, then by the shingle itself; any one order gives right results.
    """

    def count(frames):
        total = np.zeros(BUCKETS)
        for frame in frames:
            flat = np.frombuffer(b"".join(frame["set"]), np.uint64)
            total += np.bincount((flat % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        yield from blocks(0, total)

    (counts,) = tree_sum(sets.mapInPandas(count, BLOCKS), [BUCKETS])
    shared = sets.sparkSession.sparkContext.broadcast(counts.astype(np.float32))

    def first(frames):
        for frame in frames:
            for a in range(0, len(frame), 500):
                node, packed = frame["node"].to_numpy()[a : a + 500], [np.frombuffer(x, np.uint64) for x in frame["set"].iloc[a : a + 500]]
                cut = [x[np.lexsort((x, shared.value[(x % np.uint64(BUCKETS)).astype(np.int64)]))[: len(x) - int(np.ceil(least * len(x) - SLACK)) + 1]] for x in packed]
                n = np.array([len(c) for c in cut])
                of = np.repeat(np.arange(len(n)), n)
                marks = np.array([_marked(x) for x in packed], object)
                pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame({"shingle": np.concatenate(cut).view(np.int64), "node": node[of], "size": np.array([len(x) for x in packed])[of], "pos": pos, "marks": marks[of]})

    return sets.mapInPandas(first, "shingle long, node long, size int, pos int, marks binary")


def _meet(left: pd.DataFrame, right: pd.DataFrame, least: float, best: bool):
    """Pairs (a, b) of rows of one shingle and different roots that may reach `least`; if `best`, of each left node and right root the likeliest.

    No more is common than what follows the shingle in both, nor than what either set has whose bit the other has too.
    """
    node, root, size, pos = (right[c].to_numpy() for c in ("node", "root", "size", "pos"))
    marks = np.frombuffer(b"".join(right["marks"]), np.uint64).reshape(-1, MARKS)
    for n, r, s, p, m in zip(left["node"], left["root"], left["size"], left["pos"], left["marks"], strict=True):
        need = (size + s) * (least / (1 + least)) - SLACK
        at = np.flatnonzero((root != r) & (np.minimum(size, s) >= least * np.maximum(size, s) - SLACK) & (np.minimum(size - pos, s - p) >= need))
        if not len(at):
            continue
        mine, other = np.frombuffer(m, np.uint64), marks[at]
        most = np.minimum(s - np.bitwise_count(mine & ~other).sum(axis=1, dtype=np.int64), size[at] - np.bitwise_count(other & ~mine).sum(axis=1, dtype=np.int64))
        may = most >= need[at]
        at, over = at[may], (most - need[at])[may]
        if best and len(at):
            order = np.lexsort((node[at], -over, root[at]))
            at = at[order][np.flatnonzero(np.diff(root[at][order], prepend=root[at][order][0] - 1))]
        for k in at:
            yield (n, node[k]) if n < node[k] else (node[k], n)


def pairs_across(rows: DataFrame, roots: DataFrame, least: float, best: bool) -> DataFrame:
    """Distinct (a, b), a < b, of different roots that may reach `least`; rows: of `rare_first`; roots: (node, root)."""
    rows = saved(rows.join(roots, "node"), "rooted")
    held = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    held = saved(held.select("shingle", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"), "n"), "shingles")
    total = held.agg(F.sum(F.col("n") * F.col("tiles"))).first()[0] or 0
    # a list longer than TILE goes in pairs of tiles; short ones share a task
    met = rows.join(held.drop("n"), "shingle").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    group = F.pmod(F.xxhash64("shingle"), F.lit(total // TASK_ROWS + 1)).alias("group")
    met = met.select(group, "shingle", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "tile", "node", "root", "size", "pos", "marks")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        found = set()
        for _, part in frame.groupby("shingle"):
            found.update(_meet(part[part["tile"] == part["one"].iloc[0]], part[part["tile"] == part["two"].iloc[0]], least, best))
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    return met.groupBy("group", "one", "two").applyInPandas(compare, "a long, b long").distinct()


def pairs(docs: DataFrame, firsts: DataFrame, *, least: float = RESEMBLANCE) -> DataFrame:
    """(a, b) of nodes of `docs` (id, node, text) that resemble each other by `least` or more, enough to connect all that do and share a band; `firsts` has one (id, node) of each node.

    Nodes without words have no pairs; repeated rows and nulls in other columns change nothing; no rows give no pairs.
    """
    bands = saved(band_table(docs), "bands")
    salt = F.xxhash64("key")
    mixed = F.col("node").bitwiseXOR(salt)
    busy = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(mixed).alias("low"), F.max(mixed).alias("high")).where("n > 1")
    busy = saved(busy.select("key", "n", F.array(F.col("low").bitwiseXOR(salt), F.col("high").bitwiseXOR(salt)).alias("heads")), "busy")
    found = saved(first_candidates(bands, busy), "candidates")
    wanted = firsts.join(found.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select(F.col("id").alias("__id"), F.col("node").alias("__node"))

    def cut(frames):
        for frame in rows_in(frames, size=2_000_000):
            yield pd.DataFrame({"node": frame["node"], "set": [shingle_set(t).tobytes() for t in frame["text"]]})

    texts = docs.join(wanted, docs["id"].eqNullSafe(wanted["__id"]) & (docs["node"] == wanted["__node"]), "left_semi").select("node", "text")
    sets = saved(texts.mapInPandas(cut, "node long, set binary").groupBy("node").agg(F.first("set").alias("set")), "sets")
    links = saved(verified(found, sets, least), "links")
    if busy.where(F.col("n") > CROWD).isEmpty():
        return links
    open_nodes = saved(unresolved(bands, busy, links), "unresolved")
    if open_nodes.isEmpty():
        return links
    rows = saved(rare_first(sets.join(open_nodes.select("node"), "node"), least), "rare-shingles")
    near = saved(verified(saved(pairs_across(rows, open_nodes, least, True), "across"), sets, least), "links")
    links = links.union(near)
    if not near.isEmpty():  # else the roots are those of the first time
        open_nodes = saved(rooted(open_nodes.select("node"), links), "unresolved")
    return links.union(verified(saved(pairs_across(rows, open_nodes, least, False), "across"), sets, least))
