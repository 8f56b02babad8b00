"""Audit of how document filters interact, by wide packed counters.

A document's mask has a bit for each filter that it fails, and one each for a good and a toxic label. Every mask maps to one big
integer of 64-bit fields: for each outcome, each order of the filters and each step of that order a field that is 1 if the document
has that outcome there. Integers are summed per part of the corpus, so a field ends as a count of documents; counts of rows stay
under 2^63, hence no field runs over into the next, and the sum unpacks by cutting it into fields.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

FILTERS = "ABCDE"
#: Outcomes of a step, in the order of their fields.
OUTCOMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
#: Part sums that are added in one task before the last addition, and parts that a task keeps before it hands them on.
FAN, HELD = 64, 512
#: A text with more than one in HOT of all rows is frequent: there are fewer than HOT of them.
HOT = 1000
_SIGNS = frozenset("#$%&*|")


def failed(text: str | None, *, least_words: int = 200, distinct_share: int = 50, capital_share: int = 3) -> int:
    """Bits of the filters that see the text alone: A (few words), B (repeated words), C (capitals), D (signs). Shares are percents; null is empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes: ASCII blanks only
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (
        (len(words) < least_words)
        | (100 * len(set(words)) < distinct_share * len(words)) << 1
        | (100 * capitals > capital_share * len(text)) << 2
        | (not _SIGNS.isdisjoint(text)) << 3
    )


@F.pandas_udf(T.IntegerType())
def _failed(text: pd.Series) -> pd.Series:
    return pd.Series([failed(t) for t in text], index=text.index, dtype="int32")


def text_key(text: Column) -> list[Column]:
    """128 bits by which texts are told apart: among 10^12 distinct texts two meet with a chance of 10^-15."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("key"), F.xxhash64(F.lit("second"), text).alias("key2")]


def copies(rows: DataFrame) -> DataFrame:
    """`rows` (id, key, key2, ...) with `later`: is there a smaller id with the same key? Null ids have none, and are none's.

    A frequent key's least id is broadcast (there are fewer than HOT of these), the rest meet in a join.
    """
    found = rows.groupBy("key", "key2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumnsRenamed({"key": "k", "key2": "k2"})
    found = saved(found, "copies")
    frequent = F.col("n") * HOT > rows.count()
    same = lambda right: (F.col("key") == right["k"]) & (F.col("key2") == right["k2"])
    hot = F.broadcast(found.where(frequent).drop("n"))
    one = rows.join(hot, same(hot))
    rest = found.where(~frequent).drop("n")
    other = rows.join(hot, same(hot), "left_anti").join(rest, same(rest), "left")
    return one.unionByName(other).withColumn("later", F.coalesce(F.col("id") > F.col("first"), F.lit(False))).drop("k", "k2", "first")


def masks(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, mask) of every row of `docs`: bits 0 to 4 for the filters A to E, bit 5 for a good label, bit 6 for a toxic one.

    Filter E fails copies of a smaller id's text anywhere in the table. Null texts are empty, null parts are '', a null id has no
    label; of several labels of an id, any 1 counts. Repeated rows count each. Other columns are not read.
    """
    some = F.col(id_col).isNotNull()
    flags = labels.where(some).groupBy(F.col(id_col).alias("label_id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in (good_col, toxic_col)])
    flags = flags.where(F.col(good_col) | F.col(toxic_col)).select("label_id", (F.col(good_col).cast("int") * 32 + F.col(toxic_col).cast("int") * 64).alias("flags"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), *text_key(F.col(text_col)), _failed(F.col(text_col)).alias("fails"))
    rows = copies(saved(rows, "filter-rows")).select("id", "part", (F.col("fails") + F.col("later").cast("int") * 16).alias("mask"))
    known = rows.where("id IS NOT NULL").join(flags, F.col("id") == F.col("label_id"), "left")
    return known.select("part", (F.col("mask") + F.coalesce("flags", F.lit(0))).alias("mask")).union(rows.where("id IS NULL").select("part", "mask"))


def orders(filters: int) -> np.ndarray:
    """All orders of the filters, one a row, in lexicographic order."""
    return np.array(list(permutations(range(filters))), np.int64).reshape(factorial(filters), filters)


@cache
def packed(filters: int) -> list[int]:
    """The big integer of each mask of `filters` bits and the two bits of labels."""
    order = orders(filters)
    out = []
    for mask in range(4 << filters):
        fails = (mask >> order) & 1
        before = np.cumsum(fails, axis=1) - fails  # filters failed at earlier steps
        removed = (fails == 1) & (before == 0)
        fields = {
            "kept": before + fails == 0,
            "removed": removed,
            "redundant": (fails == 1) & (before > 0),
            "unique_fails": (fails == 1) & (fails.sum(axis=1, keepdims=True) == 1),
            "good_lost": removed & bool(mask >> filters & 1),
            "toxic_lost": removed & bool(mask >> filters & 2),
        }
        out.append(int.from_bytes(np.stack([fields[o] for o in OUTCOMES]).astype("<u8").tobytes(), "little"))
    return out


def unpacked(total: int, filters: int) -> np.ndarray:
    """Counts (outcome, order, step) of a sum of packed integers."""
    n = factorial(filters)
    return np.frombuffer(total.to_bytes(8 * len(OUTCOMES) * n * filters, "little"), "<u8").reshape(len(OUTCOMES), n, filters).astype(np.int64)


def audit(rows: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of documents there; rows: part, mask (bits as in `masks`).

    kept: after the step; removed: by it; redundant: fail its filter and went earlier; unique_fails: fail its filter alone; good_lost,
    toxic_lost: removed by it with that label; shapley: removed by the step's filter, summed over all orders. Parts are those that
    occur; no rows give no parts. The number of fields grows with the factorial of the number of filters.
    """
    f = len(filters)
    size = 8 * len(OUTCOMES) * factorial(f) * f

    def count(frames):
        sums: dict[str, int] = {}
        for frame in frames:
            for (part, mask), n in frame.groupby(["part", "mask"]).size().items():
                sums[part] = sums.get(part, 0) + int(n) * packed(f)[mask]
            if len(sums) >= HELD:
                yield handed(sums)
                sums = {}
        if sums:
            yield handed(sums)

    def handed(sums: dict[str, int]) -> pd.DataFrame:
        return pd.DataFrame({"part": list(sums), "total": [t.to_bytes(size, "little") for t in sums.values()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(int.from_bytes(t, "little") for t in frame["total"])
        return pd.DataFrame({"part": frame["part"].iloc[:1], "total": [total.to_bytes(size, "little")]})

    def unpack(frame: pd.DataFrame) -> pd.DataFrame:
        counts = unpacked(int.from_bytes(add(frame)["total"].iloc[0], "little"), f)
        order = orders(f)
        removed = counts[OUTCOMES.index("removed")]
        shapley = np.array([removed[order == k].sum() for k in range(f)])
        names = np.array(["".join(filters[k] for k in o) for o in order])
        out = {"part": frame["part"].iloc[0], "filter_order": np.repeat(names, f), "step": np.tile(np.arange(1, f + 1, dtype=np.int32), len(order))}
        return pd.DataFrame(out | {o: counts[i].ravel() for i, o in enumerate(OUTCOMES)} | {"shapley": shapley[order].ravel()})

    sums = rows.select("part", "mask").mapInPandas(count, "part string, total binary")
    near = sums.withColumn("near", F.floor(F.spark_partition_id() / FAN)).groupBy("part", "near").applyInPandas(add, "part string, total binary")
    return near.groupBy("part").applyInPandas(unpack, "part string, filter_order string, step int, " + ", ".join(f"{o} long" for o in [*OUTCOMES, "shapley"]))
