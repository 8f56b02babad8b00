"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments. If two fingerprints differ in at most two bits, either their low
segments are equal or their high ones differ in at most one bit; so each fingerprint probes the low table with its own segment
and the high table with the Hamming ball of radius one around its own. Of two high segments one bit apart, the one with the bit
set reaches the other by clearing it, so only set bits are flipped. Matches are verified on all 64 bits.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import resemblance
from .common import masked, rows_in, saved, unmasked
from .components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Probes times table rows of one key that the join may verify one by one. Keys beyond go by shared neighbours, which is exact too.
KEY_PAIRS = 4096

# 16 bits spread over four 16-bit lanes of two words: lane j of _SPREAD[b] is bit j of the nibble b
_SPREAD = np.array([sum(((b >> j) & 1) << (16 * j) for j in range(4)) for b in range(16)], dtype=np.uint64)


def bits_of(hashes: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Fingerprint of each run of hashes: bit i is set if over half of the run's hashes have it; 0 for an empty run."""
    out = np.zeros(len(sizes), np.uint64)
    n = np.asarray(sizes, np.int64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    start = (np.cumsum(n) - n)[full]
    # runs are counted in parts of at most 65535, so that no lane runs over
    cuts = np.concatenate([np.arange(a, a + m, 65535) for a, m in zip(start.tolist(), n[full].tolist(), strict=True)])
    owner = np.searchsorted(start, cuts, side="right") - 1
    found = np.zeros(len(full), np.uint64)
    for nibble in range(16):
        lanes = np.add.reduceat(_SPREAD[((hashes >> np.uint64(4 * nibble)) & np.uint64(15)).astype(np.int64)], cuts)
        for j in range(4):
            count = np.bincount(owner, weights=((lanes >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.float64), minlength=len(full))
            found |= (2 * count > n[full]).astype(np.uint64) << np.uint64(4 * nibble + j)
    out[full] = found
    return out


def simhash_texts(texts, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    hashes: list[np.ndarray] = []
    sizes: list[int] = []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII blanks only
        n = max(len(words) - shingle + 1, min(1, len(words)))
        runs = map(b" ".join, zip(*(words[j:] for j in range(shingle)), strict=False)) if len(words) >= shingle else ([b" ".join(words)] if words else [])
        hashes.append(np.fromiter(map(digest, runs, repeat(seed)), np.uint64, n))
        sizes.append(n)
    return bits_of(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), sizes)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fingerprint of every row's whole text as a signed long. Null and wordless texts: 0."""

    def hashed(frames):
        for frame in rows_in(frames, size=2_000_000):
            yield pd.DataFrame({"id": frame["id"], "fp": simhash_texts(frame["text"], shingle).view(np.int64)})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(hashed, "id string, fp long")
    return rows.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "fp")


def _probes(fp: Column) -> Column:
    """Keys (segment number and value) that a fingerprint looks up."""
    high, low = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))
    ball = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("getbit", high, i) == 1),
        lambda i: high.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)),
    )
    return F.concat(F.array(high, low.bitwiseOR(F.lit(1 << 32))), ball)


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp`, enough to connect all within two bits of each other.

    Where a key has at most KEY_PAIRS candidate pairs, they are verified one by one. For fingerprints at a crowded key, all
    64 one-bit neighbours and the fingerprint itself are listed: two fingerprints are within two bits exactly if they share one
    of these, so each shared neighbour links those that list it to the least of them. Rows stay in proportion to fingerprints.
    """
    probe = fps.select("fp", F.explode(_probes(F.col("fp"))).alias("key"))
    # a table row is the key of a fingerprint's own segment; every fingerprint also probes it
    own = (F.col("key") == F.shiftrightunsigned("fp", 32)) | (F.col("key") >= F.lit(1 << 32))
    probe = saved(probe.withColumn("own", own), "probes")
    busy = probe.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("own").cast("long")).alias("t")).where((F.col("n") > 1) & (F.col("t") > 0))
    busy = saved(busy.withColumn("crowded", F.col("n") * F.col("t") > KEY_PAIRS), "keys")
    calm = probe.join(busy.where(~F.col("crowded")).select("key"), "key")
    pairs = (
        calm.select("key", F.col("fp").alias("a"))
        .join(calm.where("own").select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
        .select("a", "b")
    )
    if busy.where("crowded").isEmpty():
        return pairs
    dense = probe.join(busy.where("crowded").select("key"), "key", "left_semi").select("fp").distinct()
    near = dense.select(
        "fp",
        F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("key"),
    )
    least = near.groupBy("key").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "b")
    return pairs.union(near.join(least, "key").where("fp != b").select(F.col("fp").alias("a"), "b"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id) for every row: the least id that links of at most two bits reach from it.

    Equal fingerprints are one node, so groups of copies cost one row. Null and wordless texts have fingerprint 0 and are linked
    like any other. Null ids never become a component's id unless it has no other. Repeated rows give a row each.
    """
    rows = saved(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    nodes = saved(rows.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(links(nodes.select("fp")))
    # nodes of one alone need no lookup: their component is their own id
    known = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    shared = known.join(named, "root").where((F.col("n") > 1) | (F.col("component_id") < F.col("least")) | F.col("least").isNull()).select("fp", "component_id")
    out = rows.join(shared, "fp", "left")
    return out.select(id_col, "fp", F.coalesce("component_id", F.col(id_col)).alias("component_id"))


def hex_of(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float | None = None) -> DataFrame:
    """`docs` with one row of each component, that with the least id (null last); of rows that share its id and text, one.

    Texts are the nodes: they are linked where their fingerprints are within two bits, and with `least` also where their
    five-word resemblance is `least` or more. A row goes by its id and text, so null ids and ids of several texts lose no component.
    Null and wordless texts are copies of each other. Other columns are carried whatever their names; an empty table stays empty.
    """
    rows, i, t = masked(docs, id_col, text_col)
    return unmasked(_kept(rows, i, t, shingle, least), docs.columns)


def _kept(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float | None) -> DataFrame:
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("node"), F.col(text_col).alias("text"))

    def hashed(frames):
        for frame in rows_in(frames, size=2_000_000):
            yield pd.DataFrame({"id": frame["id"], "node": frame["node"], "fp": simhash_texts(frame["text"], shingle).view(np.int64)})

    rows = source.withColumn("id", F.col("id").cast("string")).mapInPandas(hashed, "id string, node long, fp long")
    rows = saved(rows.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)), "fingerprints")
    nodes = saved(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("id").alias("id")), "nodes")
    leads = saved(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
    edges = nodes.join(leads, "fp").where("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    of = lambda side: leads.select(F.col("fp").alias(side), F.col("lead").alias(f"lead_{side}"))
    edges = edges.union(links(leads.select("fp")).join(of("a"), "a").join(of("b"), "b").select("lead_a", "lead_b"))
    if least is not None:
        edges = edges.union(resemblance.pairs(source, nodes.select("id", "node"), least=least))
    roots = components(edges).withColumnRenamed("node", "__node")
    # a text that is linked to none keeps its own least id
    known = rows.groupBy("id", "node").agg(F.count(F.lit(1)).alias("n")).join(roots, F.col("node") == F.col("__node"), "left")
    known = saved(known.select("id", "node", "n", F.coalesce("root", "node").alias("root")), "known")
    order = F.struct(F.col("id").isNull(), "id", "node")
    first = known.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.id").alias("__id"), F.col("first.node").alias("__node"))
    first = saved(first, "first")
    same = lambda left, right: left["id"].eqNullSafe(right["__id"]) & (left["node"] == right["__node"])
    gone = saved(known.join(first, same(known, first), "left_anti").select(F.col("id").alias("__id"), F.col("node").alias("__node")), "gone")
    again = known.where("n > 1").join(first, same(known, first), "left_semi").select(F.col("id").alias("__id"), F.col("node").alias("__node"))
    again = saved(again, "again")
    here = lambda right: docs[id_col].eqNullSafe(right["__id"]) & (F.xxhash64(docs[text_col]) == right["__node"])
    kept = docs.join(gone, here(gone), "left_anti")
    if again.isEmpty():
        return kept
    turn = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(*[F.col(c).asc_nulls_last() for c in docs.columns])
    one = docs.join(again, here(again), "left_semi").withColumn("__n", F.row_number().over(turn)).where("__n = 1").drop("__n")
    return kept.join(again, here(again), "left_anti").unionByName(one)
